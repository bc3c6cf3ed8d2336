"""N-gram Jaccard join with adaptive multi-match prefixes (operator 10).

A document is the set of its distinct ``k``-word shingles (64-bit hashes);
documents with equal sets are one node (its smallest id). Shingles are
ordered by estimated frequency (heavy hitters counted per partition, at most
``hot`` of them are broadcast; all others count as rare),
then by hash, and only a prefix of each set enters the inverted index. If two
sets reach the threshold ``t``, their prefixes of
``size - ceil(t * size) + m`` shingles share at least m: each document takes
the m of the smallest estimated cost (index entries plus candidates to
verify), and a pair is verified only if it shares the smaller of its two m.

Links are wanted up to connectivity: star rounds first verify, per node, the
pair with the leading node of its index entries, in another order each round,
as long as they link something and the rest is large (at most ``stars``
rounds); after connecting what they link, only pairs of nodes in different
components remain, all of which are enumerated (index join between components, minority side first), counted,
filtered by size and count and verified exactly on the full sets. Equal sets and pairs inside a
component are never expanded, so a large group of copies costs its size, not
its square.

Defined cases: null, empty or blank text: size 0, own component; fewer than k
words: the whole sequence is the one shingle; rows with one id share a
component; rows whose id is null take part through their text only and get
the component of an equal text with an id, else null; extra columns are
ignored; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, saved, ship, shuffle_parts, texts, tidy
from .components import components
from .lm_score import run_lengths

MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
KNOWN_WORDS = 200_000
SOME = 1 << 21
BITMAP = 1 << 24
DEEPEST = 4                # largest number of prefix matches asked for


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of shingle hashes of texts; word hashes are kept per worker."""

    def __init__(self, k: int):
        self.k, self.known = k, per_worker("word hashes", dict)

    def sets(self, docs: list[bytes]) -> list[np.ndarray]:
        """Ascending distinct shingle hashes of each text."""
        import xxhash

        split = [t.lower().split() for t in docs]
        words = set().union(*split)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        for w in words.difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w)
        size = np.array([len(s) for s in split], np.int64)
        w = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.uint64, int(size.sum()))
        k, end = self.k, np.cumsum(size)
        # all shingles at once, also those across two texts, which no slice below takes
        h = np.full(max(len(w) - k + 1, 0), k, np.uint64)
        for i in range(k):
            h = mixed(h + w[i:i + len(h)] * MULT[i % len(MULT)])
        out = []
        for a, b, n in zip((end - size).tolist(), end.tolist(), size.tolist()):
            if n >= k:
                one = np.sort(h[a:b - k + 1])
                out.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
            else:
                one = np.full(min(n, 1), n, np.uint64)
                for i in range(n):
                    one = mixed(one + w[a + i] * MULT[i % len(MULT)])
                out.append(one)
        return out


def digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


class Common:
    """Estimates of how often shingles occur, for those met at least twice in
    one of the chunks of SOME shingles; the ``hot`` most frequent are kept. An
    estimate only orders shingles, it decides nothing."""

    def __init__(self, hot: int):
        self.hot, self.keys, self.n = hot, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, sets: list[np.ndarray]) -> None:
        self.waiting += sets
        self.size += sum(map(len, sets))
        if self.size > SOME:
            self.fold()

    def fold(self) -> None:
        new = np.sort(np.concatenate([np.zeros(0, np.uint64), *self.waiting]))
        first = np.flatnonzero(np.concatenate(([True], new[1:] != new[:-1]))) if len(new) else np.zeros(0, int)
        n = np.diff(np.concatenate((first, [len(new)])))
        keys, n = new[first][n > 1], n[n > 1]
        keys, n = run_lengths(np.concatenate((self.keys, keys)), np.concatenate((self.n, n)))
        if len(keys) > 2 * self.hot:
            keep = n > np.partition(n, -self.hot)[-self.hot]
            keys, n = keys[keep], n[keep]
        self.keys, self.n, self.waiting, self.size = keys, n, [], 0


def describe(k: int, hot: int):
    """(id, text) -> (id, size, digest) per row; at the end of a partition its
    frequent shingles (token, n) with null digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, common, id_type = Shingler(k), Common(hot), None
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingler.sets(texts(part.column(1)))
                common.add(sets)
                yield pa.RecordBatch.from_pydict({
                    "id": part.column(0), "size": pa.array(list(map(len, sets)), pa.int64()),
                    "digest": pa.array(list(map(digest, sets)), pa.binary()),
                    "token": pa.nulls(len(sets), pa.int64()), "n": pa.nulls(len(sets), pa.int64())})
        common.fold()
        keys, n = common.keys, common.n
        if len(keys):
            yield pa.RecordBatch.from_pydict({
                "id": pa.nulls(len(keys), id_type), "size": pa.nulls(len(keys), pa.int64()),
                "digest": pa.nulls(len(keys), pa.binary()), "token": pa.array(keys.view(np.int64)),
                "n": pa.array(n)})
    return run


def least_shared(size: int, percent: int) -> int:
    """Shingles that any partner shares at least."""
    return -(-percent * size // 100)


def choose_prefix(h: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(prefix shingles, matches asked for) of one set."""
    size = len(h)
    if often.any():
        order = np.argsort(often, kind="stable")
        h, often = h[order], often[order]
    must = least_shared(size, percent)
    lengths = size - must + np.arange(1, min(DEEPEST, must) + 1)
    entries = np.cumsum(often)[lengths - 1]
    # entries to read, and candidates (at most entries / m) to verify at the cost of a set each
    cost = lengths + entries * 0.05 + entries / np.arange(1, len(lengths) + 1) * size / 100
    m = int(np.argmin(cost))
    return h[:lengths[m]], m + 1


def index_entries(k: int, percent: int, hot_tokens: np.ndarray, hot_n: np.ndarray, buckets: int):
    """Texts -> one row per bucket and batch: packed (token, node) entries of
    the prefixes and the nodes (digest, size, matches) they name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(k), set()
        held, size = [], 0

        def pack():
            token = np.concatenate([p for p, _, _, _ in held])
            owner = np.repeat(np.arange(len(held)), [len(p) for p, _, _, _ in held])
            bucket = (token % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            token, owner, bucket = token[order], owner[order], bucket[order]
            names = np.frombuffer(b"".join(d for _, d, _, _ in held), "V16")
            sizes = np.array([s for _, _, s, _ in held], np.int64)
            ask = np.array([m for _, _, _, m in held], np.int64)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cut)):
                own, local = np.unique(owner[cut[b]:cut[b + 1]], return_inverse=True)
                rows.append({"bucket": int(b), "tokens": token[cut[b]:cut[b + 1]].tobytes(),
                             "owners": local.astype("<u4").tobytes(), "nodes": names[own].tobytes(),
                             "sizes": sizes[own].astype("<i8").tobytes(), "asks": ask[own].astype("<u1").tobytes()})
            return pa.RecordBatch.from_pylist(rows, schema)

        schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary())
                                                      for c in ("tokens", "owners", "nodes", "sizes", "asks"))])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = shingler.sets(texts(batch.column(0).slice(at, 512)))
                flat = np.concatenate([np.zeros(0, np.uint64), *sets])
                often = np.zeros(len(flat), np.int64)
                if len(hot_tokens):
                    spot = np.minimum(np.searchsorted(hot_tokens, flat), len(hot_tokens) - 1)
                    often = np.where(hot_tokens[spot] == flat, hot_n[spot], 0)
                end = 0
                for h in sets:
                    begin, end = end, end + len(h)
                    d = digest(h)
                    if not len(h) or d in seen:
                        continue
                    seen.add(d)
                    prefix, ask = choose_prefix(h, often[begin:end], percent)
                    held.append((prefix, d, len(h), ask))
                    size += len(prefix)
                    if size > 1 << 19:
                        yield pack()
                        held, size = [], 0
        if held:
            yield pack()
    return run


ENTRIES = "bucket int, tokens binary, owners binary, nodes binary, sizes binary, asks binary"


def shared_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of buckets -> (token, digest, size, ask) of the tokens that
    at least two nodes hold."""
    tokens, owners, names, sizes, asks, n = [], [], [], [], [], 0
    for batch in batches:
        for r in batch.to_pylist():
            tokens.append(np.frombuffer(r["tokens"], np.uint64))
            owners.append(np.frombuffer(r["owners"], "<u4").astype(np.int64) + n)
            names.append(np.frombuffer(r["nodes"], "V16"))
            sizes.append(np.frombuffer(r["sizes"], "<i8"))
            asks.append(np.frombuffer(r["asks"], "<u1"))
            n += len(names[-1])
    if not tokens:
        return
    names, sizes, asks = np.concatenate(names), np.concatenate(sizes), np.concatenate(asks)
    text = names.view([("a", "<u8"), ("b", "<u8")])
    order = np.lexsort((text["b"], text["a"]))
    new = np.concatenate(([True], (text["a"][order][1:] != text["a"][order][:-1])
                          | (text["b"][order][1:] != text["b"][order][:-1])))
    node_of = np.empty(n, np.int64)
    node_of[order] = np.cumsum(new) - 1
    first = order[new]
    token, node = np.concatenate(tokens), node_of[np.concatenate(owners)]
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    keep = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
    token, node = token[keep], node[keep]
    same = token[1:] == token[:-1]
    shared = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
    for at in range(0, len(shared), 1 << 16):
        some = shared[at:at + (1 << 16)]
        who = first[node[some]]
        yield pa.RecordBatch.from_pydict({
            "token": pa.array(token[some].view(np.int64)), "digest": pa.array(names[who].tolist(), pa.binary()),
            "size": pa.array(sizes[who]), "ask": pa.array(asks[who].astype(np.int32))})


def set_rows(k: int, bitmap: np.ndarray | None):
    """(id, spot, text) -> (id, digest, set) of rows whose spot is in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            spot = batch.column(1).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero((bitmap[spot >> 3] >> (spot & 7)) & 1)
            for at in range(0, len(rows), 512):
                part = batch.take(pa.array(rows[at:at + 512]))
                sets = shingler.sets(texts(part.column(2)))
                yield pa.RecordBatch.from_pydict({
                    "id": part.column(0), "digest": pa.array(list(map(digest, sets)), pa.binary()),
                    "shingles": pa.array([h.tobytes() for h in sets], pa.binary())})
    return run


def verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())],
                                             ["a", "b", "linked"])
    return run


def candidate_sets(df: DataFrame, nodes: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of ``nodes`` (node, digest). A fixed-size bitmap of the
    wanted ids drops most other rows before anything is shuffled."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP))
    words = (nodes.select(spot("node").alias("s")).groupBy(F.shiftright("s", 5).alias("w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 32).cast("int"))).alias("bits")).collect())
    bitmap = np.zeros(BITMAP // 32, "<u4")
    for r in words:
        bitmap[r.w] = r.bits
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), spot(id_col).alias("spot"),
                                                       F.col(text_col).alias("text"))
    shape = f"id {dict(rows.dtypes)['id']}, digest binary, shingles binary"
    sets = rows.mapInArrow(tidy(set_rows(k, bitmap.view(np.uint8))), shape).withColumnRenamed("id", "node")
    return sets.join(nodes, ["node", "digest"]).groupBy("node").agg(F.min("shingles").alias("shingles"))


class Verifier:
    """Exact check of pairs on the full sets, which are computed for the nodes
    of the pairs only, once each."""

    def __init__(self, df: DataFrame, nodes: DataFrame, k: int, percent: int, id_col: str, text_col: str):
        self.df, self.nodes, self.k, self.percent = df, nodes, k, percent
        self.id_col, self.text_col, self.sets = id_col, text_col, None

    def check(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) -> (a, b, linked)."""
        pairs = saved(pairs, "ngram-pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        wanted = saved(self.nodes.join(wanted, "node"), "ngram-wanted")
        if self.sets is None or not wanted.isEmpty():
            more = saved(candidate_sets(self.df, wanted, self.k, self.id_col, self.text_col), "ngram-sets")
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        one = self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        two = self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
        t = dict(both.dtypes)["a"]
        return saved(both.mapInArrow(tidy(verified(self.percent)), f"a {t}, b {t}, linked boolean"), "ngram-verified")


def fits(percent: int):
    """The size filter for columns size and other."""
    return 100 * F.least("size", "other") >= percent * F.greatest("size", "other")


def enough(percent: int):
    """The count filter for a pair that shares n index entries (columns size,
    ask and other, ask2): at least the smaller number asked for, and, as all
    shared shingles beyond the earlier ending prefix lie outside that prefix,
    at least the overlap the threshold needs less what may lie outside."""
    overlap = F.ceil(percent * (F.col("size") + F.col("other")) / (100 + percent))
    outside = F.greatest(F.ceil(percent * F.col("size") / 100) - F.col("ask"),
                         F.ceil(percent * F.col("other") / 100) - F.col("ask2"))
    return F.col("n") >= F.greatest(F.least("ask", "ask2"), overlap - outside)


def star_pairs(entries: DataFrame, percent: int, turn: int) -> DataFrame:
    """For every node the leader it shares most index entries with, if sizes
    and count allow. An entry's leader is the first node of its first
    component; in later turns, first in a hash order."""
    first = ["component", "node"] if not turn else [F.xxhash64("component", F.lit(turn)), F.xxhash64("node", F.lit(turn))]
    lead = entries.groupBy("token").agg(
        F.min(F.struct(*[F.expr(c) if isinstance(c, str) else c for c in first], F.col("component").alias("of"),
                       F.col("node").alias("node_"), "size", "ask")).alias("lead"))
    return (entries.join(lead, "token").filter("component != lead.of")
            .select(F.col("lead.node_").alias("a"), F.col("node").alias("b"), "size", "ask",
                    F.col("lead.size").alias("other"), F.col("lead.ask").alias("ask2")).filter(fits(percent))
            .groupBy("a", "b").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", "ask", "other", "ask2")])
            .filter(enough(percent))
            .groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"))


def cross_size(entries: DataFrame) -> tuple[int, int]:
    """(rows that cross_pairs would meet, index entries)."""
    per = (entries.groupBy("token", "component").agg(F.count("*").alias("n"))
           .groupBy("token").agg(F.sum("n").alias("n"), F.max("n").alias("main")))
    r = per.agg(F.sum((F.col("n") - F.col("main")) * F.col("n")).alias("met"), F.sum("n").alias("rows")).first()
    return r.met or 0, r.rows or 0


MEETING = ("bucket int, nodes binary, sizes binary, asks binary, left binary, right binary, counts binary")


def meet(percent: int, buckets: int):
    """A partition's index entries (token, block, asks, node, size, ask,
    component, main) -> per bucket of the smaller node the packed pairs that
    meet there, with counts: entries of one token and block, of different
    components, whose sizes fit. Which node of a pair asks differs from token
    to token, so pairs are (smaller, larger) node before they are counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        token, block, asks, node, size, ask, component, main = map(np.concatenate, zip(*got))
        asks = asks.astype(bool)
        order = np.lexsort((asks, block, token))
        token, block, asks, node, size, ask, component, main = (
            x[order] for x in (token, block, asks, node, size, ask, component, main))
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (block[1:] != block[:-1])))
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        listed = np.add.reduceat(~asks, first)              # a group's list comes before its askers
        names, of = np.unique(node, return_inverse=True)
        some = np.full(len(names), 0)
        some[of] = np.arange(len(of))
        size_of, ask_of = size[some], ask[some]
        askers = np.flatnonzero(asks)
        work = np.cumsum(listed[group[askers]])
        schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in
                                                      ("nodes", "sizes", "asks", "left", "right", "counts"))])
        at = 0
        while at < len(askers):
            end = max(int(np.searchsorted(work, (work[at - 1] if at else 0) + (1 << 21), "right")), at + 1)
            who = askers[at:end]
            at = end
            n = listed[group[who]]
            x = np.repeat(who, n)
            y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + first[group[x]]
            ok = (component[x] != component[y]) & (main[y].astype(bool) | (node[x] < node[y])) \
                & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
            x, y = of[x[ok]], of[y[ok]]                     # numbered in the order of the nodes
            pair, count = np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y), return_counts=True)
            x, y = pair // len(names), pair % len(names)
            bucket = ((names[x].astype(np.uint64) * MULT[0] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cut)):
                i = order[cut[b]:cut[b + 1]]
                own, local = np.unique(np.concatenate((x[i], y[i])), return_inverse=True)
                rows.append({"bucket": int(b), "nodes": names[own].astype("<i8").tobytes(),
                             "sizes": size_of[own].astype("<i8").tobytes(), "asks": ask_of[own].astype("<u1").tobytes(),
                             "left": local[:len(i)].astype("<u4").tobytes(),
                             "right": local[len(i):].astype("<u4").tobytes(), "counts": count[i].astype("<u4").tobytes()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def enough_shared(percent: int):
    """A partition of buckets -> (a, b) of the pairs that share enough entries
    (see ``enough``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, count, names, sizes, asks, n = [], [], [], [], [], [], 0
        for batch in batches:
            for r in batch.to_pylist():
                left.append(np.frombuffer(r["left"], "<u4").astype(np.int64) + n)
                right.append(np.frombuffer(r["right"], "<u4").astype(np.int64) + n)
                count.append(np.frombuffer(r["counts"], "<u4"))
                names.append(np.frombuffer(r["nodes"], "<i8"))
                sizes.append(np.frombuffer(r["sizes"], "<i8"))
                asks.append(np.frombuffer(r["asks"], "<u1"))
                n += len(names[-1])
        if not left:
            return
        left, right, count, names, sizes, asks = map(np.concatenate, (left, right, count, names, sizes, asks))
        own, first, of = np.unique(names, return_index=True, return_inverse=True)
        pair, back = np.unique(of[left] * len(own) + of[right], return_inverse=True)
        shared = np.bincount(back, count)
        x, y = first[pair // len(own)], first[pair % len(own)]
        overlap = -(-percent * (sizes[x] + sizes[y]) // (100 + percent))
        outside = np.maximum(-(-percent * sizes[x] // 100) - asks[x], -(-percent * sizes[y] // 100) - asks[y])
        ok = shared >= np.maximum(np.minimum(asks[x], asks[y]), overlap - outside)
        yield pa.RecordBatch.from_pydict({"a": pa.array(names[x[ok]]), "b": pa.array(names[y[ok]])})
    return run


def cross_pairs(entries: DataFrame, percent: int, list_size: int = 1 << 16) -> DataFrame:
    """All pairs of nodes in different components that share enough entries:
    the entries outside a token's main component ask all entries of the token.
    Pairs are counted in packed arrays, one row per task and bucket, so that
    a common token makes no rows of its own; tokens of more than
    ``list_size`` entries are dealt to several tasks in blocks, each of which
    hears all askers."""
    parts = shuffle_parts(entries.sparkSession)
    main = (entries.groupBy("token", "component").agg(F.count("*").alias("n"))
            .groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n")))
    rows = entries.join(main, "token").withColumn("blocks", F.ceil(F.col("n") / list_size).cast("int"))
    own = F.struct(F.lit(False).alias("asks"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    asked = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda b: F.struct(F.lit(True).alias("asks"), b.alias("block")))
    outside = F.col("component") != F.col("main")
    roles = F.when(outside, F.concat(F.array(own), asked)).otherwise(F.array(own))
    dealt = rows.select("token", F.explode(roles).alias("role"), "node", "size", "ask", "component", (~outside).alias("in_main"))
    dealt = dealt.select("token", "role.block", "role.asks", "node", "size", "ask", "component", "in_main")
    met = dealt.repartition(parts, "token", "block").mapInArrow(tidy(meet(percent, parts)), MEETING)
    return met.repartition(parts, "bucket").mapInArrow(tidy(enough_shared(percent)), "a long, b long")


def with_components(entries: DataFrame, links: DataFrame | None) -> DataFrame:
    """Entries of tokens whose nodes lie in several components, with these."""
    entries = entries.select("token", "node", "size", "ask")
    if links is None:
        rows = entries.withColumn("component", F.col("node"))
    else:
        rows = entries.join(components(links), "node", "left") \
            .withColumn("component", F.coalesce("component", "node"))
    several = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .filter("lo != hi").select("token")
    return saved(rows.join(several, "token"), "ngram-entries")


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75,
               hot: int = 1 << 16, stars: int = 8) -> DataFrame:
    """Per row: id (an integer), n_shingles, component_id (smallest id
    reachable by links)."""
    spark = df.sparkSession
    df = df.select(F.col(id_col).cast("long").alias(id_col), text_col)
    inner = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = f"id {dict(inner.dtypes)['id']}, size long, digest binary, token long, n long"
    rows = saved(inner.mapInArrow(tidy(describe(k, hot)), shape), "ngram-rows")
    docs = rows.filter("digest IS NOT NULL").select("id", "size", "digest")
    # at most ``hot`` rows
    top = (rows.filter("digest IS NULL").groupBy("token").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "token").limit(hot).toPandas())
    tokens, n = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    parts = shuffle_parts(spark)
    shared = (inner.select("text").mapInArrow(tidy(index_entries(k, percent, tokens[order], n[order], parts)), ENTRIES)
              .repartition(parts, "bucket")
              .mapInArrow(tidy(shared_entries), "token long, digest binary, size long, ask int"))
    nodes = saved(docs.filter("size > 0").groupBy("digest").agg(F.min("id").alias("node")), "ngram-nodes")
    nodes = nodes.filter("node IS NOT NULL")
    entries = saved(shared.join(nodes, "digest").groupBy("token", "node")
                    .agg(*[F.max(c).alias(c) for c in ("size", "ask")]), "ngram-shared")
    verifier = Verifier(df, nodes, k, percent, id_col, text_col)
    entries = with_components(entries, None)
    checked = verifier.check(star_pairs(entries, percent, 0))
    entries = with_components(entries, checked.filter("linked"))
    for turn in range(1, stars):
        met, rows = cross_size(entries)
        if met <= 128 * rows:          # counted in packed arrays, so cheap up to here
            break
        found = verifier.check(star_pairs(entries, percent, turn))
        checked = checked.unionByName(found)
        if found.filter("linked").isEmpty():
            break
        entries = with_components(entries, checked.filter("linked"))
    done = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = verifier.check(cross_pairs(entries, percent).join(done, ["a", "b"], "left_anti"))
    found = components(checked.unionByName(rest).filter("linked"))
    named = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = docs.join(named, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"),
                      F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


ship(__name__)
