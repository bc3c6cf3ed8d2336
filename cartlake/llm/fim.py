"""Fill-in-middle transformation over seekable compressed frames (operator 13).

``store`` cuts every text into independent zstandard frames of about
``FRAME_BYTES`` bytes, with the units (tokens) and code points that start
before each frame. A text is then cut at a unit by opening the one frame in
which that unit starts; the others are only streamed, in order, when a digest
or the moved text is wanted. The output is itself kept as such frames, and the
text is rebuilt from them and the form alone: the markers are found in the
stream and the parts read back in their first order. One frame at a time is
open, whatever the length of a text.

A unit is a run of A-Z and a-z, or one other code point.

Defined cases: null text = empty text (no units, form plain); a null id has
the decimal text ''; ids may repeat, rows never meet, so ties and repeated
rows get equal results; a text that contains a marker stays plain; an empty
table gives no rows; extra columns are ignored, whatever their names."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, ship, slices, texts, tidy

FRAME_BYTES = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

STORED = ("id long, n long, chars long, marked boolean, units array<long>, points array<long>, frames array<binary>")
DONE = "id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def codecs():
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def starts(raw: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a unit, and which begin a code point; ``before`` is
    the byte in front of them (0: none)."""
    low = raw | 0x20
    letter = (low >= 97) & (low <= 122) & (raw < 128)
    point = (raw & 0xC0) != 0x80
    inside = letter.copy()
    if len(raw):
        inside[1:] &= letter[:-1]
        inside[0] &= 97 <= before | 0x20 <= 122 and before < 128
    return point & ~inside, point


def pieces(text: bytes, size: int) -> list[bytes]:
    """Slices of about ``size`` bytes that end between code points."""
    if len(text) <= size:
        return [text] if text else []
    found, at = [], 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        found.append(text[at:end])
        at = end
    return found


def store_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, _ = codecs()
        kinds = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), ("marked", pa.bool_()),
                           ("units", pa.list_(pa.int64())), ("points", pa.list_(pa.int64())),
                           ("frames", pa.list_(pa.binary()))])
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), texts(part.column(1))):
                    n = chars = last = 0
                    units, points, frames = [], [], []
                    for piece in pieces(text, size):
                        unit, point = starts(np.frombuffer(piece, np.uint8), last)
                        units.append(n)
                        points.append(chars)
                        frames.append(compress(piece))
                        n, chars, last = n + int(unit.sum()), chars + int(point.sum()), piece[-1]
                    marked = PREFIX in text or SUFFIX in text or MIDDLE in text
                    rows.append((doc, n, chars, marked, units, points, frames))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
    return run


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Written once: the frames of every text, with the units and code points
    before each frame."""
    return saved(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
                 .mapInArrow(tidy(store_rows(frame_bytes)), STORED), "frames")


class Frames:
    """The frames of one text; a place is (frame, byte in it, code points before)."""

    def __init__(self, frames, units, points, n, chars, decompress):
        self.frames, self.units, self.points, self.n, self.chars = frames, units, points, n, chars
        self.open = decompress

    def place(self, unit: int) -> tuple[int, int, int]:
        """Where a unit starts; only its frame is opened."""
        if unit >= self.n:
            return len(self.frames), 0, self.chars
        k = bisect_right(self.units, unit) - 1
        raw = np.frombuffer(self.open(self.frames[k]), np.uint8)
        begin, point = starts(raw)
        more = (self.units[k + 1] if k + 1 < len(self.units) else self.n) - self.units[k]
        at = np.flatnonzero(begin)
        # the first byte goes on with the letters of the frame before if it counts once too often
        byte = int(at[unit - self.units[k] + len(at) - more])
        return k, byte, self.points[k] + int(point[:byte].sum())

    def stream(self, a: tuple, b: tuple) -> Iterator[bytes]:
        """The bytes from place a up to place b, frame by frame."""
        for k in range(a[0], min(b[0] + 1, len(self.frames))):
            low, high = a[1] if k == a[0] else 0, b[1] if k == b[0] else None
            if high != 0:
                raw = self.open(self.frames[k])
                yield raw[low:high] if low or high is not None else raw


def moved(text: Frames, form: str, first: tuple, second: tuple) -> Iterator[bytes]:
    """The transformed text in order, a frame at a time."""
    start, end = (0, 0, 0), (len(text.frames), 0, text.chars)
    prefix, middle, suffix = (start, first), (first, second), (second, end)
    if form == "plain":
        yield from text.stream(start, end)
        return
    order = ((PREFIX, prefix), (SUFFIX, suffix)) if form == "psm" else ((SUFFIX, suffix), (PREFIX, prefix))
    for mark, part in (*order, (MIDDLE, middle)):
        yield mark
        yield from text.stream(*part)


def framed(chunks: Iterable[bytes], size: int, compress) -> list[bytes]:
    """A stream as frames of at least ``size`` bytes, the last excepted."""
    frames, held, n = [], [], 0
    for chunk in chunks:
        held.append(chunk)
        n += len(chunk)
        if n >= size:
            frames.append(compress(b"".join(held)))
            held, n = [], 0
    if n:
        frames.append(compress(b"".join(held)))
    return frames


def restored(frames: list[bytes], form: str, decompress) -> Iterator[bytes]:
    """The text before the transformation, from the output's frames and the
    form: two passes over the frames, one to find the markers, one to read."""
    if form == "plain":
        for frame in frames:
            yield decompress(frame)
        return
    marks = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    found, tail, at, sizes = {}, b"", 0, []
    for frame in frames:
        raw = decompress(frame)
        sizes.append(len(raw))
        seen = tail + raw
        for mark in marks:
            if mark not in found and (k := seen.find(mark)) >= 0:
                found[mark] = at - len(tail) + k
        at, tail = at + len(raw), seen[-2:]
    ends = dict(zip(marks, [*(found[m] for m in marks[1:]), at]))
    begin = np.concatenate(([0], np.cumsum(sizes))).tolist()
    for mark in (PREFIX, MIDDLE, SUFFIX):
        low, high = found[mark] + len(mark), ends[mark]
        k = bisect_right(begin, low) - 1
        while low < high:
            raw = decompress(frames[k])
            yield raw[low - begin[k]:high - begin[k]]
            low, k = begin[k + 1], k + 1


def transform_rows(size: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, decompress = codecs()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for r in part.to_pylist():
                    text = Frames(r["frames"], r["units"], r["points"], r["n"], r["chars"], decompress)
                    plain = r["form"] == "plain"
                    first, second = (None, None) if plain else (text.place(r["first"]), text.place(r["second"]))
                    digest, back = hashlib.sha256(), hashlib.sha256()
                    # the output's own frames: what the digests and the way back are read from
                    frames = framed(moved(text, r["form"], first, second), size, compress)
                    for frame in frames:
                        digest.update(decompress(frame))
                    for chunk in restored(frames, r["form"], decompress):
                        back.update(chunk)
                    rows.append((r["id"], r["n"], r["form"], None if plain else first[2],
                                 None if plain else second[2] - first[2], digest.hexdigest(), back.hexdigest(),
                                 *([b"".join(map(decompress, frames)).decode("utf-8", "replace")] if out else [])))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
                         pa.string()]
                names = ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", out]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names[:len(rows[0])])
    return run


def part_of_hash(seed: int, k: int) -> Column:
    """The k-th (from 0) group of 8 digits of sha256("seed:id") as a number."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 8 * k + 1, 8), 16, 10).cast("long")


def planned(stored: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Form and cut units of every stored text, from its id alone."""
    one, two = (part_of_hash(seed, k) % (F.col("n") + 1) for k in (0, 1))
    form = (F.when((F.col("n") == 0) | F.col("marked") | (part_of_hash(seed, 2) % 100 >= 100 - plain_percent), "plain")
            .when(part_of_hash(seed, 3) % 100 < spm_percent, "spm").otherwise("psm"))
    return stored.select("*", form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))


def transform(stored: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20,
              frame_bytes: int = FRAME_BYTES, output: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """``store``'s frames -> per text its units, form, code points of prefix
    and middle (null if plain), sha256 of the output and of the text rebuilt
    from it; with ``output`` also the transformed text, under that name."""
    plan = planned(stored, seed, plain_percent, spm_percent)
    kinds = DONE + (f", `{output}` string" if output else "")
    return plan.mapInArrow(tidy(transform_rows(frame_bytes, output)), kinds).withColumnRenamed("id", id_col)


ship(__name__)
