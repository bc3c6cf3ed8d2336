"""Chunk packing by running lengths, run inside Spark tasks (mapInArrow).

Rules: paragraphs (split on ``sep``, stripped, empties dropped) share a chunk,
joined by a blank line, while it stays within ``size``; every joined
paragraph counts two more than its length, also a chunk's first one. The next
chunk opens with the last ``overlap`` characters of the chunk before it. A
paragraph longer than ``size`` is packed from an empty chunk word by word,
joined by a space and counting one more, in the same way (a first word that
is too long closes the empty chunk).

Both kinds of packing are one step: how far the running costs of the pieces
from here on stay within the room left, found by bisection, and one join of
that slice.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa


class Pieces:
    """Paragraphs or words with their running costs."""

    def __init__(self, pieces: list[str], glue: str, size: int):
        self.pieces, self.glue, self.size = pieces, glue, size
        self.cost = list(accumulate((len(p) + len(glue) for p in pieces), initial=0))

    def fill(self, at: int, start: str) -> tuple[int, str]:
        """(index of the first piece that no longer fits, the filled chunk)."""
        if start:
            room = self.size - len(start)
        elif self.cost[at + 1] - self.cost[at] <= self.size:
            room = self.size + len(self.glue)        # nothing to glue the first piece to
        else:
            return at, ""
        end = max(bisect_right(self.cost, self.cost[at] + room) - 1, at)
        return end, self.glue.join([start, *self.pieces[at:end]] if start else self.pieces[at:end])


def ending(text: str, overlap: int) -> str:
    return text[max(len(text) - overlap, 0):]


def word_chunks(paragraph: str, size: int, overlap: int) -> list[str]:
    """Chunks of a paragraph longer than ``size``; the last one is still open."""
    words = Pieces(paragraph.split(), " ", size)
    at, start, out = 0, "", []
    while True:
        at, chunk = words.fill(at, start) if at < len(words.pieces) else (at, start)
        out.append(chunk)
        if at == len(words.pieces):
            return out
        start = f"{ending(chunk, overlap)} {words.pieces[at]}"
        at += 1


def chunk_text(text: str, size: int, overlap: int, sep: str) -> list[str]:
    paragraphs = Pieces([p for p in (raw.strip() for raw in (text or "").split(sep)) if p], "\n\n", size)
    done: list[str] = []
    at, chunk = 0, ""
    while at < len(paragraphs.pieces):
        at, chunk = paragraphs.fill(at, chunk)
        if at == len(paragraphs.pieces):
            break
        if chunk:
            done.append(chunk.strip())
        head = paragraphs.pieces[at]
        at += 1
        if len(head) > size:
            *full, chunk = word_chunks(head, size, overlap)
            done += [c.strip() for c in full]
        else:
            chunk = f"{ending(done[-1], overlap)}\n\n{head}" if done else head
    return done + [chunk.strip()] * bool(chunk.strip())


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most 256 rows and about 4 MB."""
    step = max(1, min(256, (batch.num_rows << 22) // (batch.nbytes + 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def rows_of(make, keys: list[str], extra: tuple[str, str]):
    """mapInArrow body: ``make(last input column)`` texts per row, numbered,
    beside the key columns. A worker holds one slice of texts and its pieces at
    a time, whatever the size of the input."""
    def made(part: pa.RecordBatch) -> pa.RecordBatch:
        lists = [make(t) for t in part.column(part.num_columns - 1).to_pylist()]
        owner = pa.array([row for row, x in enumerate(lists) for _ in x], pa.int64())
        return pa.RecordBatch.from_arrays(
            [*(part.column(part.schema.get_field_index(k)).take(owner) for k in keys),
             pa.array([i for x in lists for i in range(len(x))], pa.int64()),
             pa.array([c for x in lists for c in x], pa.string())], [*keys, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield made(part)
            batch = part = None      # not held while the next one is read
        pa.default_memory_pool().release_unused()
    return run


def split_batches(size: int, overlap: int):
    """(doc_name, pos, paragraph) batches -> pieces of oversize paragraphs."""
    def pieces(p: str) -> list[str]:
        return [c.strip() for c in word_chunks(p, size, overlap)]
    return rows_of(pieces, ["doc_name", "pos"], ("piece_index", "piece"))


def chunk_batches(size: int, overlap: int, sep: str):
    """(doc_name, text) batches -> (doc_name, chunk_index, content)."""
    return rows_of(lambda t: chunk_text(t, size, overlap, sep), ["doc_name"], ("chunk_index", "content"))


# Executors need not have this package installed: functions of this module
# are shipped by value with the tasks that use them.
from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(sys.modules[__name__])
