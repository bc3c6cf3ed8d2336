"""Benchmark decontamination with an Aho-Corasick automaton (operator 5).

Benchmark questions and answers are normalised (A-Z lower-cased, words of
digits, ASCII letters and non-ASCII characters, one space between words);
their windows of ``window`` words (shorter items: one window) are the
patterns of one automaton. Each document is normalised the same way and
scanned once; matches are mapped back to word numbers and to byte offsets of
the original text.

The benchmark is a query set: it is read in blocks of at most
``block_words`` words, one automaton per block (its size is what is shipped
to the executors, hence bounded); documents pass the blocks one after the
other and carry their hits along. Usually there is one block.

Defined cases: null or wordless text has no words, no hits and is never
contaminated; null or wordless items have no window; null item ids count as
items but print as the empty string; repeated items count once per row;
repeated documents are judged row by row; an empty benchmark contaminates
nothing; an empty table gives an empty result; extra columns are ignored
unless named in ``carry``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship, short_batches, slices, texts, tidy

# bytes that belong to words, A-Z lower-cased; every other byte becomes a space
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))


def windows(text: bytes, window: int) -> set[str]:
    """The normalised windows of one item, as ' w1 ... wn '."""
    words = text.translate(WORD_BYTES).split()
    n = min(window, len(words))
    return {" " + b" ".join(words[i:i + n]).decode("utf-8", "replace") + " "
            for i in range(len(words) - n + 1)} if n else set()


def build(items: list[tuple[str, bytes]], window: int):
    """Automaton whose values are (words in the window, item numbers)."""
    import ahocorasick

    owners: dict[str, list[int]] = {}
    for k, (_name, text) in enumerate(items):
        for w in windows(text, window):
            owners.setdefault(w, []).append(k)
    auto = ahocorasick.Automaton()
    for w, ks in owners.items():
        auto.add_word(w, (w.count(" ") - 1, tuple(ks)))
    if owners:
        auto.make_automaton()
    return auto if owners else None


def find(text: bytes, auto) -> tuple[int, np.ndarray, set[int], list[tuple[int, int]]]:
    """(number of words, hit mask by word, item numbers, byte spans of hit words)."""
    flat = text.translate(WORD_BYTES)
    words = flat.split()
    if not words or auto is None:
        return len(words), np.zeros(len(words), bool), set(), []
    norm = " " + b" ".join(words).decode("utf-8", "replace") + " "
    ends, items = {}, set()
    for end, (n, ks) in auto.iter(norm):
        ends[end] = max(n, ends.get(end, 0))
        items.update(ks)
    hit = np.zeros(len(words) + 1, np.int64)
    if ends:
        spaces = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le"), np.uint32) == 32)
        at = np.fromiter(ends, np.int64, len(ends))
        size = np.fromiter(ends.values(), np.int64, len(ends))
        last = np.searchsorted(spaces, at)          # words before this space
        np.add.at(hit, last - size, 1)
        np.add.at(hit, last, -1)
    hit = np.cumsum(hit)[:-1] > 0
    spans = []
    if ends:
        raw = np.frombuffer(flat, np.uint8) != 32
        edge = np.diff(np.concatenate(([0], raw.view(np.int8), [0])))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        run = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
        spans = [(int(start[a]), int(stop[b - 1])) for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1))]
    return len(words), hit, items, spans


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """The benchmark in blocks of bounded size, in a fixed order."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).orderBy("i", "t")
    block, size = [], 0
    for r in rows.toLocalIterator():
        text = (r.t or "").encode()
        n = len(text.translate(WORD_BYTES).split())
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r.i or "", text))
        size += n
    if block:
        yield block


def scan(items: list[tuple[str, bytes]], window: int, names: list[str]):
    """Arrow batches with (text, items, hits, spans so far) -> columns
    ``names`` with this block's findings added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = build(items, window)
        for batch in (x for b in batches for x in slices(b)):
            cols = dict(zip(batch.schema.names, batch.columns))
            found_items, masks, spans = (cols[c].to_pylist() for c in ("items", "hits", "spans"))
            n_words, n_hit = [], []
            for k, text in enumerate(texts(cols["text"])):
                n, hit, found, runs = find(text, auto)
                if masks[k]:
                    hit = hit | np.unpackbits(np.frombuffer(masks[k], np.uint8), count=n).astype(bool)
                n_words.append(n)
                n_hit.append(int(hit.sum()))
                masks[k] = np.packbits(hit).tobytes() if n_hit[-1] else b""
                found_items[k] += [items[i][0] for i in sorted(found)]
                spans[k] += [{"start": a, "stop": b} for a, b in runs]
            cols |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                     "items": pa.array(found_items, pa.list_(pa.string())), "hits": pa.array(masks, pa.binary()),
                     "spans": pa.array(spans, batch.schema.field("spans").type)}
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)
    return run


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20,
                  block_words: int = 500_000, carry: list[str] | None = None) -> DataFrame:
    """Per row: n_words, n_hit, items (ids, sorted as strings), spans (byte
    offsets of hit runs, per block), contaminated (share * n_hit >= n_words)."""
    short_batches(df.sparkSession)
    carry = carry or []
    rest, keep_text = [c for c in carry if c != text_col], text_col in carry
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                    F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                    F.array().cast("array<string>").alias("items"), F.lit(b"").alias("hits"),
                    F.array().cast("array<struct<start:long,stop:long>>").alias("spans"),
                    F.struct(F.lit(0).alias("_"), *rest).alias("carried"))
    blocks = item_blocks(benchmark, item_col, item_text, block_words)
    block = next(blocks, [])
    while block is not None:
        later = next(blocks, None)
        shape = out.schema if later is not None else out.drop("hits", *[] if keep_text else ["text"]).schema
        out = out.mapInArrow(tidy(scan(block, window, shape.names)), shape)
        out = saved(out, "decontaminate-block") if later is not None else out
        block = later
    dirty = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.array_sort("items").alias("items"), "spans",
                      dirty.alias("contaminated"),
                      *[(F.col("text") if c == text_col else F.col("carried")[c]).alias(c) for c in carry])


ship(__name__)
