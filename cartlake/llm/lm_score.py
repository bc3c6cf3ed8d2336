"""Language-model scores by a weighted backoff automaton (operator 6).

Tokens are words (runs without ASCII white space, A-Z lower-cased) and one
end per text. Every 1-, 2- and 3-gram of the training texts is learned, at
every size of the corpus: counts are exact sums, kept distributed.

Probabilities are Dirichlet-smoothed, P(w | h) = (n(h w) + K(h) P(w | h')) /
(n(h) + K(h)), down to the add-one share of the word among all types and one
unknown; K(h) = a n(h)^b grows with the context's count about as the kinds of
its successors do. Written as an automaton: a state is a context that was seen (two
words, one, or none); a seen n-gram is an arc that carries its log10
probability and leads to the longest context it ends with; any other symbol
takes the failure arc to the next shorter context, of weight K(h) / (n(h) + K(h)).

The automaton of a whole corpus fits nowhere, so texts are dealt into chunks
of about CHUNK tokens, and every chunk gets the part of the automaton that
its own texts can reach:

1. texts are tokenised once and written as chunks (word numbers, packed);
2. each chunk sends its distinct n-grams, with its own training counts, to
   shards; a shard adds the counts up and answers every chunk in the order it
   was asked, so a chunk's n-grams travel once and come back as numbers;
3. a chunk builds its states, arcs and failure arcs from the answers and walks
   all its texts at once, from left to right, each with its state.

Words travel as they are, longer n-grams as 64-bit hashes (two of which could
share a count by chance). Shards are as many as the tokens need, so a shard's
memory does not grow with the corpus; an n-gram, however frequent, reaches its
shard once a chunk.

Defined cases: null text = empty text = its end token alone; null ids are
scored, and learned from only where ``learn`` says so; repeated rows are
counted and scored once each; without training texts every token has base
score log10(1/1) = 0; extra columns are ignored; an empty table gives an empty
result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, saved, ship, shuffle_parts, tidy

CHUNK = 3 << 19                    # tokens of a chunk, at about
SHARD = 1 << 20                    # tokens of the corpus to a shard
SMOOTHING = (2.0, 0.9)             # strength of the shorter context at one occurrence, and its power
SEED = 42


def run_lengths(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


# ------------------------------------------------------------------- packing

def pack(values: np.ndarray, width: int) -> bytes:
    """Numbers as zstandard-compressed byte planes."""
    import zstandard

    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, width: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}")


def pack_words(words: list[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data).split()


# ------------------------------------------------------------------ 1: chunks

CHUNKS = "chunk long, ids array<{0}>, train array<boolean>, sizes binary, words binary, numbers binary, n_tokens long"


def chunk_rows(id_type: pa.DataType, limit: int):
    """(id, train, text) -> chunks of whole texts."""
    def row(part: int, held: list[tuple]) -> dict:
        ids, train, lists = zip(*held)
        words = pa.concat_arrays([x.flatten() for x in lists])
        size = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists])
        coded = words.dictionary_encode()
        return {"chunk": part, "ids": sum(ids, []), "train": sum(train, []), "sizes": pack(size, 4),
                "words": pack_words(coded.dictionary.cast("binary").to_pylist()),
                "numbers": pack(coded.indices.to_numpy(zero_copy_only=False), 4), "n_tokens": len(words) + len(size)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(id_type)), ("train", pa.list_(pa.bool_())),
                            *((c, pa.binary()) for c in ("sizes", "words", "numbers")), ("n_tokens", pa.int64())])
        part, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            step = max(1, min(512, (batch.num_rows << 23) // (batch.nbytes + 1)))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(some.column(2), "")))
                words = lists.flatten()
                real = pc.greater(pc.binary_length(words), 0)
                if not pc.all(real).as_py():       # the empty ones at either end
                    keep = real.to_numpy(zero_copy_only=False)
                    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                    stop = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], np.cumsum(size)))]
                    lists = pa.ListArray.from_arrays(pa.array(stop, pa.int32()), words.filter(real))
                held.append((some.column(0).to_pylist(), some.column(1).to_pylist(), lists))
                n += len(lists.flatten())
                if n >= limit:
                    yield pa.RecordBatch.from_pylist([row(part, held)], schema)
                    part, held, n = part + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pylist([row(part, held)], schema)
    return run


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray, order: int) -> np.ndarray:
    """Key of the n-gram with the context ``a`` and the ending ``b``."""
    return mixed(mixed(a + np.uint64(order)) + b * np.uint64(0x9E3779B97F4A7C15))


class Grams:
    """The n-grams of a chunk by numbers of its own: words 0.., then END and
    START. ``two`` and ``three`` are the distinct n-grams (context * base +
    ending, ascending; a 3-gram's context is the place of its 2-gram); ``at2``
    and ``at3`` say which of them ends at each position (-1: none)."""

    def __init__(self, sizes: np.ndarray, words: list[bytes], numbers: np.ndarray):
        import xxhash

        self.end, self.start = len(words), len(words) + 1
        base = self.base = len(words) + 2
        n, docs = len(numbers) + 2 * len(sizes), len(sizes)
        self.first = np.cumsum(sizes + 2) - sizes - 2           # where the texts begin, with START
        self.sizes = sizes
        x = np.full(n, -1, np.int64)
        x[self.first], x[self.first + sizes + 1] = self.start, self.end
        x[x < 0] = numbers
        self.x, self.doc = x, np.repeat(np.arange(docs, dtype=np.int32), sizes + 2)
        same = self.doc[1:] == self.doc[:-1]
        self.two, place = np.unique(x[:-1][same] * base + x[1:][same], return_inverse=True)
        self.at2 = np.full(n, -1, np.int32)
        self.at2[1:][same] = place
        both = same[1:] & same[:-1]
        self.three, place = np.unique(self.at2[1:-1][both].astype(np.int64) * base + x[2:][both], return_inverse=True)
        self.at3 = np.full(n, -1, np.int32)
        self.at3[2:][both] = place
        del place, same, both
        key = np.array([*(xxhash.xxh64_intdigest(w, SEED) for w in words),
                        xxhash.xxh64_intdigest(b" end", SEED), xxhash.xxh64_intdigest(b" start", SEED)], np.uint64)
        self.word_key = key[:-2]
        two = joined(key[self.two // base], key[self.two % base], 2)
        three = joined(two[self.three // base], key[self.three % base], 3)
        self.key = np.concatenate((two, three))
        del two, three
        self.order = np.argsort(self.key, kind="stable")        # the order in which they are asked for


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Ascending with the key."""
    return (((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def dealt(key: np.ndarray, shards: int):
    """(shard, slice) of ascending keys."""
    cut = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cut)):
        yield int(s), slice(int(cut[s]), int(cut[s + 1]))


# ------------------------------------------------------------------ 2: shards

ASKED = "shard int, chunk long, words boolean, names binary, counts binary"
ANSWERED = "shard int, chunk long, words boolean, counts binary, types long, tokens long"


def grams_of(row: dict) -> tuple[Grams, np.ndarray]:
    """(n-grams, which texts are learned from) of a chunk's row."""
    grams = Grams(unpack(row["sizes"], 4).astype(np.int64), unpack_words(row["words"]),
                  unpack(row["numbers"], 4).astype(np.int64))
    return grams, np.array(row["train"], bool)


def ask(shards: int):
    """Chunks -> their distinct words and n-grams with training counts, a row
    a shard."""
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("words", pa.bool_()), ("names", pa.binary()),
                        ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = unpack_words(row["words"])
                g, train = grams_of(row)
                learned = train[g.doc]
                n2 = np.bincount(g.at2[learned & (g.at2 >= 0)], minlength=len(g.two))
                n3 = np.bincount(g.at3[learned & (g.at3 >= 0)], minlength=len(g.three))
                key, n = g.key[g.order], np.concatenate((n2, n3))[g.order]
                yield pa.RecordBatch.from_pylist([
                    {"shard": s, "chunk": row["chunk"], "words": False, "counts": pack(n[i], 4),
                     "names": pack(np.diff(key[i], prepend=np.uint64(0)), 8)} for s, i in dealt(key, shards)], schema)
                order = np.argsort(g.word_key, kind="stable")
                n = np.bincount(g.x[learned], minlength=g.base)[order]
                yield pa.RecordBatch.from_pylist([
                    {"shard": s, "chunk": row["chunk"], "words": True, "counts": pack(n[i], 4),
                     "names": pack_words([words[k] for k in order[i].tolist()])}
                    for s, i in dealt(g.word_key[order], shards)], schema)
                del g, key, n, order, learned, n2, n3, words
                give_back()
    return run


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard -> to every row its counts over all chunks; to every
    shard a row of its own with its types and tokens."""
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("words", pa.bool_()), ("counts", pa.binary()),
                        ("types", pa.int64()), ("tokens", pa.int64())])
    held, size = [], 0

    def shard(rows):
        spoken, hashed = [r for r in rows if r["words"]], [r for r in rows if not r["words"]]
        total: dict[bytes, int] = {}
        for r in spoken:
            for w, n in zip(unpack_words(r["names"]), unpack(r["counts"], 4).tolist()):
                if n:
                    total[w] = total.get(w, 0) + n
        yield {"shard": rows[0]["shard"], "chunk": None, "types": len(total), "tokens": sum(total.values())}
        for r in spoken:
            n = np.array([total.get(w, 0) for w in unpack_words(r["names"])], np.int64)
            yield {"shard": r["shard"], "chunk": r["chunk"], "words": True, "counts": pack(n, 8)}
        asked = [np.cumsum(unpack(r["names"], 8)) for r in hashed]
        own = [unpack(r["counts"], 4).astype(np.int64) for r in hashed]
        key, n = run_lengths(np.concatenate([np.zeros(0, np.uint64), *(k[c > 0] for k, c in zip(asked, own))]),
                             np.concatenate([np.zeros(0, np.int64), *(c[c > 0] for c in own)]))
        for r, k in zip(hashed, asked):
            spot = np.minimum(np.searchsorted(key, k), max(len(key) - 1, 0))
            found = np.where(key[spot] == k, n[spot], 0) if len(key) else np.zeros(len(k), np.int64)
            yield {"shard": r["shard"], "chunk": r["chunk"], "words": False, "counts": pack(found, 8)}

    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["shard"] != row["shard"]:
                yield pa.RecordBatch.from_pylist(list(shard(held)), schema)
                held = []
            held.append(row)
    if held:
        yield pa.RecordBatch.from_pylist(list(shard(held)), schema)


# -------------------------------------------------------------------- 3: walk

class Automaton:
    """States: 0 no context, 1 + w the word w, then the seen 2-grams. Every
    state but 0 has a failure arc (``fail``, of weight ``back``); the arcs of a
    chunk are its seen n-grams: ``log1``, ``log2``, ``log3`` are their weights,
    ``to1`` and ``to2`` where they lead (a 3-gram to its last two words)."""

    def __init__(self, g: Grams, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray, total: int, smoothing: tuple):
        """Counts over all training texts: of the words, END and START (how
        often START is a context), of g.two and g.three; ``total``: tokens,
        types and one."""
        base = g.base
        p1 = (n1 + 1.0) / total
        h, w = g.two // base, g.two % base
        k1, k2 = (smoothing[0] * np.maximum(n, 1) ** smoothing[1] for n in (n1, n2))
        p2 = (n2 + k1[h] * p1[w]) / (n1[h] + k1[h])
        context, last = g.three // base, np.zeros(len(g.three), np.int64)
        inside = g.at3 >= 0
        last[g.at3[inside]] = g.at2[inside]
        p3 = (n3 + k2[context] * p2[last]) / (n2[context] + k2[context])
        self.grams, self.log1 = g, np.log10(p1)
        # with an unseen one behind, for positions where no n-gram ends (-1)
        self.seen2, self.seen3 = np.append(n2 > 0, False), np.append(n3 > 0, False)
        self.log2, self.log3 = np.append(np.log10(p2), 0.0), np.append(np.log10(p3), 0.0)
        del p2, p3, last, inside, context
        seen = n1 > 0
        seen[g.end] = False                                     # no context
        self.to1 = np.where(seen, 1 + np.arange(base), 0)
        self.to2 = 1 + base + np.arange(len(g.two) + 1)
        self.fail = np.concatenate((np.zeros(1 + base, np.int64), self.to1[w]))
        self.back = np.log10(np.concatenate(([1.0], k1 / (n1 + k1), k2 / (n2 + k2))))
        self.begin = int(self.to1[g.start])

    def walk(self) -> np.ndarray:
        """log10 probabilities of all texts of the chunk. They are read in
        step, longest first, each with its state; a text's last symbol is END."""
        g, base = self.grams, self.grams.base
        order = np.argsort(-g.sizes, kind="stable")
        length, at = g.sizes[order] + 1, g.first[order]
        state, score = np.full(len(order), self.begin, np.int64), np.zeros(len(order))
        # how many texts are that long
        active = np.searchsorted(-length, -np.arange(int(length[0]) + 1 if len(length) else 0), "right")
        for step in range(1, len(active)):
            m = active[step]
            p, s, total = at[:m] + step, state[:m], score[:m]
            two, three, symbol = g.at2[p], g.at3[p], g.x[p]
            # arcs of two-word states, else their failure arcs
            deep = s > base
            hit = deep & self.seen3[three]
            fall = deep & ~hit
            total += np.where(hit, self.log3[three], 0.0) + np.where(fall, self.back[s], 0.0)
            s = np.where(fall, self.fail[s], s)
            # arcs of one-word states
            single = (s > 0) & ~hit
            arc = single & self.seen2[two]
            fall = single & ~arc
            total += np.where(arc, self.log2[two], 0.0) + np.where(fall, self.back[s], 0.0)
            # arcs of the state without context; an unknown word leads back to it
            root = ~(hit | arc)
            total += np.where(root, self.log1[symbol], 0.0)
            state[:m] = np.where(root, self.to1[symbol], self.to2[two])
        out = np.empty(len(order))
        out[order] = score
        return out


def score_chunk(n_tokens: int, n_types: int, docs: int, smoothing: tuple, id_type: pa.DataType):
    """A chunk's row and its answers -> its texts' rows."""
    names = ["id", "n_tokens", "n_known", "base_score", "score"]
    kinds = [id_type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        row = chunk.to_pylist()[0]
        ids = pa.array(row["ids"], id_type)
        g, _ = grams_of(row)
        del row
        give_back()
        said = sorted(answers.to_pylist(), key=lambda r: r["shard"])
        counts = lambda words: np.concatenate(                                                      # noqa: E731
            [np.zeros(0, np.uint64), *(unpack(r["counts"], 8) for r in said if r["words"] is words)])
        n1 = np.zeros(g.base, np.int64)
        n1[np.argsort(g.word_key, kind="stable")] = counts(True)
        n1[g.end] = n1[g.start] = docs
        n = np.zeros(len(g.order), np.int64)
        n[g.order] = counts(False)
        del said
        g.key = g.order = None              # asked and answered
        total = n_tokens + n_types + 1
        scores = Automaton(g, n1, n[:len(g.two)], n[len(g.two):], total, smoothing).walk()
        del n
        # the base score and the known tokens need no context
        inside = g.x != g.start
        x, doc = g.x[inside], g.doc[inside]
        base = np.bincount(doc, np.log10((n1 + 1.0) / total)[x], len(g.sizes))
        known = np.bincount(doc, n1[x] > 0, len(g.sizes)).astype(np.int64)
        out = pa.Table.from_arrays([ids, pa.array(g.sizes + 1), pa.array(known), pa.array(base), pa.array(scores)], names)
        del g, x, doc, inside
        give_back()
        return out
    return run


def lm_score(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
             smoothing: tuple = SMOOTHING) -> DataFrame:
    """Learn from the rows where ``learn`` is true and score every row:
    n_tokens, n_known, train_tokens, base_score, score (log10)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    id_name, id_type = dict(rows.dtypes)["id"], to_arrow_type(rows.schema["id"].dataType)
    chunks = saved(rows.mapInArrow(tidy(chunk_rows(id_type, CHUNK)), CHUNKS.format(id_name)), "lm-chunks")
    sums = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(
        F.sum(F.size(F.filter("train", lambda t: t))), F.lit(0)).alias("docs")).first()
    shards = max(shuffle_parts(spark), -(-sums.n // SHARD))
    asked = chunks.mapInArrow(tidy(ask(shards)), ASKED).repartition(shards, "shard").sortWithinPartitions("shard")
    answers = saved(asked.mapInArrow(tidy(answer), ANSWERED), "lm-answers")
    known = answers.filter("chunk IS NULL").agg(F.coalesce(F.sum("types"), F.lit(0)).alias("types"),
                                                F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    n_tokens, n_types = known.tokens + sums.docs, known.types + (1 if sums.docs else 0)
    run = score_chunk(n_tokens, n_types, sums.docs, smoothing, id_type)
    # about a chunk a task, however many there are
    parts = max(shuffle_parts(spark), sums.chunks)
    said = answers.filter("chunk IS NOT NULL").select("chunk", "shard", "words", "counts").repartition(parts, "chunk")
    out = (chunks.repartition(parts, "chunk").groupBy("chunk").cogroup(said.groupBy("chunk"))
           .applyInArrow(run, f"id {id_name}, n_tokens long, n_known long, base_score double, score double"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"),
                      "base_score", "score")


ship(__name__)
