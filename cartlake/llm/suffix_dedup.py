"""Repeated-passage removal with longest-previous-factor arrays (operator 7).

A byte goes when a string of ``length`` bytes covering it also starts
earlier (smaller id, or the same text further left); the first occurrence
stays. Texts are UTF-8 bytes; matches never cross texts.

1. Every window of ``length`` bytes is owned by its smallest hashed
   ``GRAM``-byte gram (leftmost on ties), which depends on the window's
   content only; neighbouring windows with one owner form a run, about one
   run per 32 bytes. Runs meet by their gram's hash; grams met once own no
   repeated window. Within a task's chunk a gram is sent once, with its count;
   the runs of a gram met twice there are known to repeat and go on by row.
2. The text pieces of the remaining runs (windows plus their tail) are sent
   to their gram. Pieces equal byte by byte are collapsed to the earliest
   before and after the shuffle, so a passage copied a million times costs one
   piece per task. A gram with more than ``crowd`` runs is split: its windows
   travel one by one to their own hash.
3. In a task, the distinct pieces of whole grams are laid out in corpus order
   and the suffixes at their windows are sorted (word by word, to ``length``
   bytes) with the lengths of common prefixes. Previous and next smaller text
   positions in suffix order give each window's longest previous factor; a
   window whose factor reaches ``length`` repeats an earlier one.
4. Removed windows return to their texts by row number, are merged to spans
   and cut out.

Defined cases: null text = empty text, nothing to remove; texts shorter than
``length`` stay whole; ids order the corpus (null first), rows repeated with
one id follow in reading order; extra columns are ignored; an empty table
gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship, shuffle_parts, texts, tidy

GRAM = 32
CHUNK = 1 << 21            # bytes hashed at once
PIECE = 1 << 20            # a longer text is cut into overlapping parts of this size
PORTION = 1 << 21          # bytes of pieces sorted together, whole grams
CROWDED = 1 << 18          # grams whose runs may be split (the table that goes to all tasks)
BYTE_EDGES = np.array([1 << 8 * k for k in range(1, 8)], np.uint64)
FIRST = -(1 << 63)         # order of a null id
MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM-byte strings at every position, by doubling."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (x ^ (x >> np.uint64(32)))[b]
    step = 1
    for c in MULT:
        h = h[:-step] * np.uint64(c) + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def runs(docs: list[bytes], length: int):
    """(text number, first window, windows, gram hash) of every run of the texts."""
    parts = [(k, at, t[at:at + PIECE + length - 1]) for k, t in enumerate(docs)
             for at in range(0, max(len(t) - length + 1, 0), PIECE)]
    out = []
    while parts:
        take, size = 0, 0
        while take < len(parts) and (not take or size + len(parts[take][2]) <= CHUNK):
            size += len(parts[take][2])
            take += 1
        now, parts = parts[:take], parts[take:]
        flat = np.frombuffer(b"".join(p for _, _, p in now), np.uint8)
        sizes = np.array([len(p) for _, _, p in now])
        end = np.cumsum(sizes)
        h = gram_hashes(flat)
        low = np.uint64((1 << 24) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)       # hash, then leftmost
        owner = (window_min(key, length - GRAM + 1) & low).astype(np.int64)
        part = np.repeat(np.arange(len(now)), sizes)[:len(owner)]
        at = np.flatnonzero(np.arange(len(owner)) + length <= end[part])
        own = owner[at]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        p = part[at[first]]
        out.append((np.array([k for k, _, _ in now])[p],
                    at[first] - (end - sizes)[p] + np.array([a for _, a, _ in now])[p],
                    np.diff(np.concatenate((first, [len(own)]))), h[own[first]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*out))


def dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket and the bucket borders in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def part_of(row: np.ndarray, parts: int) -> np.ndarray:
    return ((row.astype(np.uint64) * np.uint64(MULT[0]) >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


RUNS = "bucket int, grams binary, counts binary, rows binary, starts binary, windows binary"


def send_runs(length: int, buckets: int, words: bytes):
    """(row_no, packed text) -> per bucket packed runs. A gram met twice in a
    chunk is sent once, as a count (its row is -1). Its runs are known to be
    repeated and need no answer: they go by row, as buckets from ``buckets``
    on, so runs of a hot gram never meet in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpack = codec(words)
        held, size = [], 0

        def pack():
            row, start, n, gram = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(gram, kind="stable")
            row, start, n, gram = row[order], start[order], n[order], gram[order]
            new = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            many = np.diff(np.concatenate((new, [len(gram)])))
            count = np.where(np.repeat(many, many) > 1, 0, 1)
            more = many > 1
            gram = np.concatenate((gram, gram[new[more]]))
            count = np.concatenate((count, many[more]))
            row = np.concatenate((row, np.full(more.sum(), -1)))
            start, n = (np.concatenate((c, np.zeros(more.sum(), np.int64))) for c in (start, n))
            bucket = np.where(count > 0, (gram % np.uint64(buckets)).astype(np.int64), buckets + part_of(row, buckets))
            order, cut = dealt(bucket, 2 * buckets)
            rows = []
            for b in np.flatnonzero(np.diff(cut)):
                i = order[cut[b]:cut[b + 1]]
                rows.append({"bucket": int(b), "grams": gram[i].tobytes(), "counts": count[i].astype("<i4").tobytes(),
                             "rows": row[i].astype("<i8").tobytes(), "starts": start[i].astype("<u4").tobytes(),
                             "windows": n[i].astype("<u1").tobytes()})
            return pa.RecordBatch.from_pylist(rows, schema)

        schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary())
                                                      for c in ("grams", "counts", "rows", "starts", "windows"))])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                doc, start, n, gram = runs([unpack(t) for t in part.column(1).to_pylist()], length)
                if len(doc):
                    held.append((part.column(0).to_numpy()[doc], start, n, gram))
                    size += len(doc)
                if size > 1 << 19:
                    yield pack()
                    held, size = [], 0
        if held:
            yield pack()
    return run


SCATTERED = "part int, rows binary, starts binary, windows binary, grams binary"


def scatter(row: np.ndarray, parts: int, **columns) -> pa.RecordBatch:
    """One packed row per part of the row numbers (missing columns empty)."""
    order, cut = dealt(part_of(row, parts), parts)
    used = np.flatnonzero(np.diff(cut))
    packed = {k: [x[order[cut[p]:cut[p + 1]]].tobytes() for p in used] for k, x in ({"rows": row} | columns).items()}
    return pa.RecordBatch.from_pydict({"part": pa.array(used, pa.int32()), **{
        k: pa.array(packed.get(k, [b""] * len(used)), pa.binary()) for k in ("rows", "starts", "windows", "grams")}})


REPEATED = "row_no long, starts binary, windows binary, grams binary"


def gather(windows: str):
    """A partition's scattered rows -> one row per row number, its starts,
    windows (of the given type) and grams packed in order. Rows of part -1 are
    passed on one by one under row -1."""
    types = {"starts": "<u4", "windows": windows, "grams": "<u8"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, got = [], {k: [] for k in types}
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] < 0:
                    n = len(r["grams"]) // 8
                    yield pa.RecordBatch.from_pydict({
                        "row_no": pa.array([-1] * n, pa.int64()),
                        "starts": pa.array([r["rows"][8 * i:8 * i + 8] for i in range(n)], pa.binary()),
                        "windows": pa.array([b""] * n, pa.binary()),
                        "grams": pa.array([r["grams"][8 * i:8 * i + 8] for i in range(n)], pa.binary())})
                    continue
                rows.append(np.frombuffer(r["rows"], "<i8"))
                for k, t in types.items():
                    got[k].append(np.frombuffer(r[k], t))
        if not rows:
            return
        row = np.concatenate(rows)
        got = {k: np.concatenate(v) for k, v in got.items()}
        order = np.lexsort((got["starts"], row))
        row = row[order]
        cut = [*np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))), len(row)]
        got = {k: v[order] if len(v) else None for k, v in got.items()}
        for at in range(0, len(cut) - 1, 4096):
            ends = cut[at:at + 4097]
            yield pa.RecordBatch.from_pydict({"row_no": pa.array(row[ends[:-1]], pa.int64()), **{
                k: pa.array([b"" if v is None else v[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())
                for k, v in got.items()}})
    return run


def repeated_runs(crowd: int, parts: int):
    """A partition's buckets -> the runs of grams met more than once, scattered
    by row; the crowded grams as part -1 with their numbers of runs. Runs that
    came by row are passed on."""
    schema = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("rows", "starts", "windows", "grams"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[], [], [], [], []]
        for batch in batches:
            rows = batch.to_pylist()
            known = [{"part": r["bucket"] - parts} | {c: r[c] for c in ("rows", "starts", "windows", "grams")}
                     for r in rows if r["bucket"] >= parts]
            if known:
                yield pa.RecordBatch.from_pylist(known, schema)
            for r in rows:
                if r["bucket"] >= parts:
                    continue
                for x, c, t in zip(got, ("grams", "counts", "rows", "starts", "windows"),
                                   ("<u8", "<i4", "<i8", "<u4", "<u1")):
                    x.append(np.frombuffer(r[c], t))
        if not got[0]:
            return
        gram, count, row, start, n = map(np.concatenate, got)
        order = np.argsort(gram, kind="stable")
        new = np.concatenate(([True], gram[order][1:] != gram[order][:-1]))
        group = np.cumsum(new) - 1
        total = np.bincount(group, count[order])
        keep = order[(total[group] > 1) & (row[order] >= 0)]
        hot = gram[order][new][total > crowd]
        if len(hot):
            many = total[total > crowd].astype(">u8").tobytes()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([-1], pa.int32()), "rows": pa.array([many], pa.binary()),
                "starts": pa.array([b""], pa.binary()), "windows": pa.array([b""], pa.binary()),
                "grams": pa.array([hot.tobytes()], pa.binary())})
        for at in range(0, len(keep), 1 << 20):
            i = keep[at:at + (1 << 20)]
            yield scatter(row[i], parts, starts=start[i], windows=n[i], grams=gram[i])
    return run


PIECES = "bucket int, grams binary, ids binary, rows binary, starts binary, sizes binary, text binary"


def send_pieces(length: int, buckets: int, crowded: np.ndarray, words: bytes):
    """(row_no, id, packed text, packed runs) -> per bucket the pieces,
    one for equal pieces of a chunk; bucket -1 carries the runs of the later
    ones, which are repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        _, unpack = codec(words)
        squeeze = zstandard.ZstdCompressor(level=3)
        schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in
                                                      ("grams", "ids", "rows", "starts", "sizes", "text"))])
        held: dict[bytes, tuple] = {}
        late, size = [], 0

        def rows_of(bucket, pieces):
            return {"bucket": bucket, "grams": np.array([p[3] for _, p in pieces], "<u8").tobytes(),
                    "ids": np.array([p[0] for _, p in pieces], "<i8").tobytes(),
                    "rows": np.array([p[1] for _, p in pieces], "<i8").tobytes(),
                    "starts": np.array([p[2] for _, p in pieces], "<u4").tobytes(),
                    "sizes": np.array([len(t) for t, _ in pieces], "<u4").tobytes(),
                    "text": squeeze.compress(b"".join(t for t, _ in pieces))}

        def pack():
            dealt_to: dict[int, list] = {}
            for item in held.items():
                dealt_to.setdefault(item[1][3] % buckets, []).append(item)
            out = [rows_of(b, pieces) for b, pieces in dealt_to.items()]
            for at in range(0, len(late), 1 << 14):
                some = late[at:at + (1 << 14)]
                out.append({"bucket": -1 - at % buckets, "grams": b"", "ids": b"",
                            "rows": np.array([r for r, _, _ in some], "<i8").tobytes(),
                            "starts": np.array([s for _, s, _ in some], "<u4").tobytes(),
                            "sizes": np.array([n for _, _, n in some], "<u4").tobytes(), "text": b""})
            return pa.RecordBatch.from_pylist(out, schema)

        for batch in batches:
            cols = batch.to_pydict()
            for row, doc, packed, starts, windows, grams in zip(*(cols[c] for c in (
                    "row_no", "id", "packed", "starts", "windows", "grams"))):
                text = unpack(packed)
                doc = FIRST if doc is None else doc
                start = np.frombuffer(starts, "<u4").tolist()
                n = np.frombuffer(windows, "<u1").tolist()
                gram = np.frombuffer(grams, "<u8")
                split = np.isin(gram, crowded)
                todo = []
                for s, k, g, alone in zip(start, n, gram.tolist(), split.tolist()):
                    if alone:
                        todo += [(s + i, 1, None) for i in range(k)]
                    else:
                        todo.append((s, k, g))
                for s, k, g in todo:
                    piece = text[s:s + k + length - 1]
                    mine = (doc, row, s, xxhash.xxh64_intdigest(piece) if g is None else g)
                    other = held.get(piece)
                    if other is None:
                        held[piece] = mine
                        size += len(piece) + 100
                        continue
                    if mine < other:
                        held[piece], mine = mine, other
                    late.append((mine[1], mine[2], k))
                if size > 48 << 20 or len(late) > 1 << 19:
                    yield pack()
                    held, late, size = {}, [], 0
        if held or late:
            yield pack()
    return run


def suffix_order(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by their first ``length`` bytes (equal
    ones by position) and the common prefix of each with the one before it.
    Sorted by 8-byte words; only ties are looked at again."""
    words = -(-length // 8)
    pad = np.concatenate((text, np.zeros(8 * words + 8, np.uint8)))
    n = len(at)
    order, common = np.arange(n), np.full(n, length, np.int64)
    tied = np.arange(n)                      # places in the order still open
    group = np.zeros(n, np.int64)            # first place of each open place's group
    offsets = np.arange(8)
    for w in range(words):
        if not len(tied):
            break
        spot = at[order[tied]][:, None] + (8 * w + offsets)
        raw = pad[spot]
        if 8 * w + 8 > length:
            raw[:, length - 8 * w:] = 0
        word = raw.view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((word, group)) if w else np.argsort(word, kind="stable")
        order[tied] = order[tied][by]
        word = word[by]
        same_group = np.concatenate(([False], group[1:] == group[:-1]))
        parted = same_group & np.concatenate(([False], word[1:] != word[:-1]))
        if w == 0:
            common[0] = 0
        where = np.flatnonzero(parted)
        diff = word[where] ^ word[where - 1]
        common[tied[where]] = 8 * w + 7 - np.searchsorted(BYTE_EDGES, diff, "right")
        start = np.flatnonzero(~same_group | parted)
        size = np.diff(np.concatenate((start, [len(tied)])))
        group = np.repeat(tied[start], size)
        more = np.repeat(size, size) > 1
        tied, group = tied[more], group[more]
    return order, common


def previous_factor(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, in suffix order: the longer of
    its common prefixes with the previous and the next suffix in the order
    that start at a smaller position. Pointer jumping: a suffix whose
    neighbour starts later takes over that neighbour's neighbour."""
    n = len(position)
    best = np.zeros(n, np.int64)
    for backward in (False, True):
        p = position[::-1] if backward else position
        link = np.arange(n) - 1
        # common prefix between a suffix and its current link
        least = np.concatenate(([0], common[:0:-1])) if backward else common.copy()
        least[0] = 0
        open_ = np.flatnonzero(link >= 0)
        while len(open_):
            open_ = open_[p[link[open_]] > p[open_]]
            to = link[open_]
            least[open_] = np.minimum(least[open_], least[to])
            link[open_] = link[to]
            open_ = open_[link[open_] >= 0]
        factor = np.where(link >= 0, least, 0)
        best = np.maximum(best, factor[::-1] if backward else factor)
    return best


def repeats(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For pieces in corpus order, which windows of each repeat an earlier one."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), np.uint8)
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(pieces)), windows)
    inside = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (np.cumsum(sizes) - sizes)[owner] + inside
    order, common = suffix_order(text, at, length)
    factor = np.empty(len(at), np.int64)
    factor[order] = previous_factor(order, common)     # windows are numbered in corpus order
    hit = factor >= length
    return np.split(hit, np.cumsum(windows)[:-1])


def find_repeats(length: int, parts: int):
    """A partition's pieces -> removed windows, scattered by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        known: dict[bytes, tuple] = {}
        out, n_out = [], 0

        def flush():
            row, start, n = (np.concatenate(c) for c in zip(*out))
            return scatter(row.astype("<i8"), parts, starts=start.astype("<u4"), windows=n.astype("<u4"))

        def late(row, start, n):
            out.append((np.array(row), np.array(start), np.array(n)))
            return len(out[-1][0])

        for batch in batches:
            for r in batch.to_pylist():
                row, start = np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["starts"], "<u4")
                size = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
                if r["bucket"] < 0:
                    n_out += late(row, start, size)
                else:
                    text, again = unpack.decompress(r["text"]), []
                    end = np.cumsum(size).tolist()
                    for a, b, *mine in zip([0, *end], end, np.frombuffer(r["ids"], "<i8").tolist(), row.tolist(),
                                           start.tolist(), np.frombuffer(r["grams"], "<u8").tolist()):
                        piece, mine = text[a:b], tuple(mine)
                        other = known.get(piece)
                        if other is None:
                            known[piece] = mine
                        else:
                            if mine < other:
                                known[piece], mine = mine, other
                            again.append((mine[1], mine[2], b - a - length + 1))
                    if again:
                        n_out += late(*zip(*again))
                if n_out > 1 << 20:
                    yield flush()
                    out, n_out = [], 0
        by_gram = sorted(known.items(), key=lambda item: (item[1][3], item[1][:3]))
        at = 0
        while at < len(by_gram):
            end, size = at, 0
            while end < len(by_gram) and (size < PORTION or by_gram[end][1][3] == by_gram[end - 1][1][3]):
                size += len(by_gram[end][0])
                end += 1
            portion = sorted(by_gram[at:end], key=lambda item: item[1][:3])
            at = end
            for (_, (_, row, start, _)), hit in zip(portion, repeats([p for p, _ in portion], length)):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                if len(edge):
                    n_out += late(np.full(len(edge) // 2, row), start + edge[::2], edge[1::2] - edge[::2])
            if n_out > 1 << 20:
                yield flush()
                out, n_out = [], 0
        if out:
            yield flush()
    return run


def shared_words(df: DataFrame, text_col: str) -> bytes:
    """A compression dictionary from some texts' beginnings, so that short
    texts compress well one by one. Empty where there is too little text; it
    has no bearing on results."""
    import zstandard

    some = [r.t.encode() for r in df.select(F.substring(text_col, 1, 4000).alias("t")).limit(2000).collect() if r.t]
    if sum(map(len, some)) < 1 << 20:
        return b""
    return zstandard.train_dictionary(1 << 16, some).as_bytes()


def codec(words: bytes):
    """(compress, decompress) with the shared dictionary."""
    import zstandard

    known = zstandard.ZstdCompressionDict(words) if words else None
    return (zstandard.ZstdCompressor(level=3, dict_data=known).compress,
            zstandard.ZstdDecompressor(dict_data=known).decompress)


def squeeze_texts(words: bytes):
    """(row_no, id, text) with the text compressed, as it is kept and shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, _ = codec(words)
        for batch in batches:
            packed = [compress(t) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                                             ["row_no", "id", "packed"])
    return run


def cut_out(length: int, words: bytes):
    """(id, packed, packed windows) -> id, spans and the kept text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpack = codec(words)
        for batch in batches:
            cols = batch.to_pydict()
            n_bytes, spans, digest = [], [], []
            for packed, starts, windows in zip(cols["packed"], cols["starts"], cols["windows"]):
                text = unpack(packed)
                keep = text
                merged = []
                if starts:
                    start = np.frombuffer(starts, "<u4").astype(np.int64)
                    stop = np.maximum.accumulate(start + np.frombuffer(windows, "<u4") + length - 1)
                    first = np.concatenate(([True], start[1:] > stop[:-1]))
                    last = np.concatenate((first[1:], [True]))
                    merged = list(zip(start[first].tolist(), stop[last].tolist()))
                    keep, at = [], 0
                    for a, b in merged:
                        keep.append(text[at:a])
                        at = b
                    keep = b"".join([*keep, text[at:]])
                n_bytes.append(len(text))
                spans.append([{"start": a, "stop": b} for a, b in merged])
                digest.append(hashlib.sha256(keep).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                 pa.array(digest, pa.string())], ["id", "n_bytes", "spans", "kept_sha256"])
    return run


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
                 crowd: int = 1 << 16) -> DataFrame:
    """Per row: id, n_bytes, spans (byte offsets removed), kept_sha256 (of the
    text that is left)."""
    spark = df.sparkSession
    parts = shuffle_parts(spark)
    rows = df.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("id"),
                     F.col(text_col).alias("text"))
    # written once: the row numbers must be the same in all three uses
    words = shared_words(df, text_col)
    packed = saved(rows.mapInArrow(tidy(squeeze_texts(words)), "row_no long, id long, packed binary"), "suffix-texts")
    met = saved(packed.select("row_no", "packed").mapInArrow(tidy(send_runs(length, parts, words)), RUNS)
                .repartition(parts, "bucket").mapInArrow(tidy(repeated_runs(crowd, parts)), SCATTERED)
                .repartition(parts, "part").mapInArrow(tidy(gather("<u1")), REPEATED), "suffix-runs")
    # the most crowded grams; one beyond the table's bound merely stays unsplit
    crowded = (met.filter("row_no < 0").orderBy(F.desc("starts"), "grams").limit(CROWDED).select("grams")
               .toPandas()["grams"])
    crowded = np.frombuffer(b"".join(crowded), "<u8")
    wanted = met.filter("row_no >= 0")
    spans = saved(packed.join(wanted, "row_no").mapInArrow(tidy(send_pieces(length, parts, crowded, words)), PIECES)
                  .repartition(parts, "bucket").mapInArrow(tidy(find_repeats(length, parts)), SCATTERED)
                  .repartition(parts, "part").mapInArrow(tidy(gather("<u4")), REPEATED), "suffix-removed")
    out = (packed.join(spans, "row_no", "left").select("id", "packed", "starts", "windows")
           .mapInArrow(tidy(cut_out(length, words)), "id long, n_bytes long, spans array<struct<start:long,stop:long>>, "
                                        "kept_sha256 string"))
    return out.withColumnRenamed("id", id_col)


ship(__name__)
