"""Toxicity with noisy-channel deobfuscation (operator 3).

Writing tricks are undone before scoring: a token with digits, symbols,
separators or a letter three times in a row, and a run of three or more
one-character tokens, becomes a character lattice (look-alike letters,
dropped separators and repeats, word breaks); Viterbi finds its likeliest
reading under a character trigram model of the corpus plus channel costs.
Tokens without such marks have one reading and stay.

Scoring: document frequencies of restored words and their leading 4 to 6
letters in toxic and clean training texts give log odds (the longest feature
with enough support speaks for a word); a small logistic model on the
strongest, second and third word, the number of telling words and the text's
length turns them into a probability. Word counts come from at most
``per_class`` labelled ids per class (by a hash of the id; two thirds for the
word evidence, one third for the logistic model); the character model
counts all learnable texts; every whole text is scored.

Defined cases: null, empty and letterless texts have no evidence and get the
score of a text without telling words; without both labels every score is
the share of label 1 (0 without labels); labels repeated for an id count if
they agree; null ids and labels are not learned from; repeated rows are
scored alike; extra columns are ignored; an empty table gives an empty
result."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, ship, tidy
from .quality import agreed_labels

# Look-alikes, observed character -> letters it may stand for
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
             "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "£": "l", "¥": "y"}
# Channel costs in nats
COST = {"lookalike": 1.0, "plain_lookalike": 4.0, "noise": 6.0, "repeat": 0.7, "separator": 1.5, "space": 0.2,
        "break": 2.5}
ALPHABET = 64             # 0: word edge, 1: any other letter, 2..: the most frequent letters
CACHE_TOKENS = 300_000
OUTER = re.compile(r"^(?:[^\w@$€£|(<+!]|_|([@$!|(<+])\1+)+|(?:[^\w@$€£+]|_|([@$+])\2+)+$")
TRIPLE = re.compile(r"(.)\1\1")


def letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for t in batch.column(0).to_pylist():
            total.update((t or "").lower())
    kept = [(c, n) for c, n in total.items() if c.isalpha()]
    yield pa.RecordBatch.from_pydict({"letter": pa.array([c for c, _ in kept], pa.string()),
                                      "n": pa.array([n for _, n in kept], pa.int64())})


def trigram_counts(letters: str):
    """Texts -> counts of letter trigrams (codes a*64*64 + b*64 + c) of their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.array([1 if chr(i).isalpha() else 0 for i in range(0x110000)], np.int64)
        for k, c in enumerate(letters):
            code[ord(c)] = code[ord(c.upper()[0])] = k + 2
        total = np.zeros(ALPHABET ** 3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                flat = "  ".join(t or "" for t in batch.column(0).slice(at, 64).to_pylist())
                c = code[np.frombuffer(("  " + flat + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)]
                a, b, d = c[:-2], c[1:-1], c[2:]
                keep = (b > 0) | (d > 0)
                # two edges in a row start a word: (0, 0, first letter)
                first = (b == 0) & (d > 0)
                a = np.where(first, 0, a)
                total += np.bincount((a * ALPHABET + b)[keep] * ALPHABET + d[keep], minlength=ALPHABET ** 3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": used, "n": total[used]})
    return run


class Letters:
    """Character trigram model: letters and log-probability table."""

    def __init__(self, letters: str, counts: np.ndarray):
        self.index = {c: k + 2 for k, c in enumerate(letters)}
        n3 = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(np.float64)
        n2, n1 = n3.sum(0), n3.sum((0, 1))
        p1 = (n1 + 0.5) / (n1.sum() + 0.5 * ALPHABET)
        p2 = (n2 + 8 * p1) / (n2.sum(1, keepdims=True) + 8)
        self.log = np.log((n3 + 8 * p2[None]) / (n3.sum(2, keepdims=True) + 8)).astype(np.float32)

    def code(self, c: str) -> int:
        return self.index.get(c, 1)


def fit_letters(df: DataFrame, text_col: str = "text") -> Letters:
    """Count all texts of ``df``: two passes, at most 64^3 rows to the driver."""
    text = df.select(F.col(text_col).alias("text"))
    top = (text.mapInArrow(tidy(letter_counts), "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "letter").limit(ALPHABET - 2).collect())
    letters = "".join(sorted(r.letter for r in top))
    grams = (text.mapInArrow(tidy(trigram_counts(letters)), "gram long, n long").groupBy("gram")
             .agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros(ALPHABET ** 3)
    counts[grams["gram"].to_numpy(np.int64)] = grams["n"].to_numpy()
    return Letters(letters, counts)


def arcs(seen: str, i: int):
    """What the character at i may stand for: (written letters, cost); a space
    is a word break, the empty string nothing."""
    c = seen[i]
    if c.isalpha():
        out = [(c, 0.0)]
        if (i > 0 and seen[i - 1] == c) and (seen[i - 2:i + 1] == c * 3 or seen[i - 1:i + 2] == c * 3
                                             or seen[i:i + 3] == c * 3):
            out.append(("", COST["repeat"]))
        return out
    if c == " ":
        return [("", COST["space"]), (" ", COST["break"])]
    if c in LOOKALIKE:
        out = [(x, COST["lookalike"]) for x in LOOKALIKE[c]] + [("", COST["noise"]), (" ", COST["noise"])]
        if i > 0 and seen[i - 1] == c:
            out.append(("", COST["repeat"]))
        return out
    return [("", COST["separator"]), (" ", COST["break"])]


def decode(seen: str, model: Letters) -> str:
    """Viterbi over the lattice of ``seen``; states are the last two written letters,
    all of which are kept."""
    log, code = model.log, model.code
    best = {(0, 0): (0.0, "")}
    for i in range(len(seen)):
        step: dict = {}
        options = [(x, cost, code(x) if x.strip() else 0) for x, cost in arcs(seen, i)]
        for (a, b), (cost, text) in best.items():
            for x, extra, k in options:
                if not x or (x == " " and b == 0):
                    key, total, out = (a, b), cost + extra, text
                else:
                    total = cost + extra - float(log[a, b, k])
                    key, out = ((0, 0) if x == " " else (b, k)), text + x
                if key not in step or total < step[key][0]:
                    step[key] = (total, out)
        best = step
    ends = [(cost - (float(log[a, b, 0]) if b else 0.0), text) for (a, b), (cost, text) in best.items()]
    return min(ends)[1].strip()


class Restorer:
    """Restored words of tokens and texts, with a cache emptied when full."""

    def __init__(self, model: Letters):
        self.model, self.cache = model, {}

    def token(self, token: str) -> str:
        got = self.cache.get(token)
        if got is None:
            core = OUTER.sub("", token)
            if not core or core.isdigit():
                got = ""
            elif core.isalpha() and not TRIPLE.search(core):
                got = core
            elif any(c.isalpha() for c in core):
                got = decode(core, self.model)
            else:
                got = ""
            if len(self.cache) >= CACHE_TOKENS:
                self.cache.clear()
            self.cache[token] = got
        return got

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """(tokens, runs of at least three one-character tokens joined by spaces)."""
        tokens = text.lower().split()
        single = [i for i, t in enumerate(tokens) if len(t) == 1]
        runs, at = [], 0
        while at < len(single):
            end = at
            while end + 1 < len(single) and single[end + 1] == single[end] + 1:
                end += 1
            if end - at >= 2:
                runs.append((single[at], single[end] + 1))
            at = end + 1
        return tokens, runs

    def text(self, text: str) -> str:
        """The whole restored text, one space between words."""
        tokens, runs = self.parts(text)
        out, at = [], 0
        for a, b in runs:
            out += [self.token(t) for t in tokens[at:a]]
            out.append(self.run(tokens[a:b]))
            at = b
        out += [self.token(t) for t in tokens[at:]]
        return " ".join(w for w in out if w)

    def run(self, tokens: list[str]) -> str:
        seen = " ".join(t for t in tokens if t.isalnum() or t in LOOKALIKE)
        if not any(c.isalpha() for c in seen):
            return ""
        return decode(seen, self.model)

    def words(self, text: str) -> set[str]:
        """Distinct restored words."""
        tokens, runs = self.parts(text)
        out: set[str] = set()
        for t in set(tokens):
            out.update(self.token(t).split())
        for a, b in runs:
            out.update(self.run(tokens[a:b]).split())
        return out


def restore(df: DataFrame, letters: Letters, text_col: str = "text", out: str = "restored") -> DataFrame:
    """``df`` with the restored text (null stays null)."""
    @F.pandas_udf("string")
    def restored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = Restorer(letters)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else r.text(t))
    return df.withColumn(out, restored(F.col(text_col)))


def features(word: str) -> list[str]:
    """The word itself, then its leading 6, 5 and 4 letters: most to least specific."""
    return [word + "$", *(word[:n] for n in (6, 5, 4) if len(word) >= n)]


def count_features(letters: Letters):
    """(label, text) -> (feature, toxic texts, clean texts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen = Restorer(letters), (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update({f for w in restorer.words(text or "") for f in features(w)})
        names = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()),
                                          "toxic": pa.array([seen[1][f] for f in names], pa.int64()),
                                          "clean": pa.array([seen[0][f] for f in names], pa.int64())})
    return run


class Evidence:
    """Log odds of words, and a text's summary for the logistic model."""

    def __init__(self, letters: Letters, odds: dict[str, float]):
        self.restorer, self.odds, self.cache = Restorer(letters), odds, {}

    def word(self, word: str) -> float:
        for f in features(word):
            if f in self.odds:
                return self.odds[f]
        return 0.0

    def token(self, token: str) -> float:
        got = self.cache.get(token)
        if got is None:
            got = max(map(self.word, self.restorer.token(token).split()), default=0.0)
            if len(self.cache) >= CACHE_TOKENS:
                self.cache.clear()
            self.cache[token] = got
        return got

    def summary(self, text: str) -> list[float]:
        tokens, runs = self.restorer.parts(text)
        own = set(tokens)
        found = [e for e in map(self.token, own) if e > 0]
        for a, b in runs:
            found += [e for e in map(self.word, set(self.restorer.run(tokens[a:b]).split())) if e > 0]
        top = sorted(found, reverse=True)[:3] + [0.0] * 3
        return [*top[:3], np.log1p(sum(e > 2 for e in found)), top[0] * top[0] / 10, np.log1p(len(own))]


SUMMARY = 6


def summarise(evidence_of, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(*evidence_of)
        for batch in batches:
            rows = [evidence.summary(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))],
                                             [*names, "x"])
    return run


class Model:
    def __init__(self, letters, odds, weights, prior):
        self.letters, self.odds, self.weights, self.prior = letters, odds, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        z = x @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method with a ridge; the last weight is the constant."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(df: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", per_class: int = 8000, support: int = 4) -> Model:
    """``learn``: rows of ``df`` that may be learned from (over its columns)."""
    known = df.filter(learn & F.col(id_col).isNotNull())
    letters = fit_letters(known, text_col)
    lab = agreed_labels(labels, label_col, id_col)
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    ids = saved(known.select(F.col(id_col).alias("id")).join(lab, "id").withColumn("draw", draw), "toxic-labelled")
    n = {r.label: r.n for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}    # two rows
    if len(n) < 2:
        return Model(letters, {}, None, float(next(iter(n), 0)))
    # at most per_class ids of each class: bounded, so they are broadcast and no text is shuffled
    drawn = [ids.filter(F.col("label") == k).dropDuplicates(["id"]).orderBy("draw", "id").limit(per_class)
             for k in (0, 1)]
    drawn = saved(drawn[0].unionByName(drawn[1]), "toxic-drawn")
    sample = saved(known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                   .join(F.broadcast(drawn), "id").select("label", "draw", "text"), "toxic-sample")
    words, rest = sample.filter("draw % 3 > 0"), sample.filter("draw % 3 = 0")
    counts = {r.label: r.n for r in words.groupBy("label").agg(F.count("*").alias("n")).collect()}
    seen = (words.select("label", "text").mapInArrow(tidy(count_features(letters)), "feature string, toxic long, clean long")
            .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .filter(F.col("toxic") + F.col("clean") >= support).toPandas())
    toxic, clean = seen["toxic"].to_numpy(float), seen["clean"].to_numpy(float)
    log_odds = (np.log((toxic + 0.5) / (counts.get(1, 0) + 1)) - np.log((clean + 0.5) / (counts.get(0, 0) + 1)))
    all_odds = dict(zip(seen["feature"], log_odds.tolist()))
    telling = {f for f, e in all_odds.items() if e > 0.7}
    # a telling feature, or a more specific one that speaks against it
    odds = {f: e for f, e in all_odds.items()
            if f in telling or any(f[:k] in telling for k in (4, 5, 6) if len(f) > k)}
    got = rest.select("label", "text").mapInArrow(tidy(summarise((letters, odds), ["label"])),
                                                  "label int, x array<double>").collect()
    y = np.array([r.label for r in got], float)
    x = np.array([r.x for r in got]).reshape(-1, SUMMARY)
    # sampled classes back to their true shares
    weights = logistic(x, y) if len(set(y)) == 2 else None
    if weights is not None:
        weights[-1] += np.log(n[1] / n[0]) - np.log(max(y.sum(), 1) / max(len(y) - y.sum(), 1))
    return Model(letters, odds, weights, n[1] / (n[0] + n[1]))


def score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(model.letters, model.odds)
        for batch in batches:
            x = np.array([evidence.summary(t or "") for t in batch.column(1).to_pylist()]).reshape(-1, SUMMARY)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["id", "score"])
    return run


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted of every row."""
    inner = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = inner.mapInArrow(tidy(score_batches(model)), f"id {dict(inner.dtypes)['id']}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


ship(__name__)
