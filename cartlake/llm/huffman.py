"""Token ids as length-limited canonical Huffman blocks (operator 4).

Texts are encoded with a public tokenizer, an end id is appended to each
document, and the id streams are written in ascending document order as
independent blocks of about ``block_ids`` ids: a bit stream of canonical
Huffman codes (built from the global id counts, lengths limited so that one
table lookup decodes a code) plus the bit offset of every ``STEP``-th id, so
that a block is decoded from all its checkpoints at once. A block row also
names its documents and their id counts, so blocks can be read alone.

Files (Parquet, under one folder): ``codes`` (id, length) and ``blocks``.

Only the id counts (one row per vocabulary entry) and one total per written
partition reach the driver. Words are encoded once per worker and kept in a
cache that is emptied when full: white space separates pre-tokens, so a text's
ids are its words' ids in a row, whatever the cache holds (tested against
whole-text encoding, with cold and warm caches).

Defined cases: null text = empty text = just the end id; null ids come
first; repeated ids get their own ranges, in any order among themselves; an
empty table writes no blocks; extra columns are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlake.plans.session import scratch_path

from .common import per_worker, saved, ship, shuffle_parts, texts, tidy

STEP = 64            # ids between two checkpoints
CACHE_WORDS = 1_000_000
LINE = 256           # words the tokenizer gets in one line
# where lower-casing first could matter: combining marks that can compose with
# a Latin letter, and special tokens, which are matched as they are written
AS_WRITTEN = "[\u0300-\u036f]|<[|]"


# ASCII marks, without the apostrophe (which can open a contraction)
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")
# letters up to Cyrillic, which every version of Unicode knows, that stay one letter when normalised
LETTERS = frozenset(c for c in map(chr, range(0x41, 0x530)) if c.isalpha() and len(c.lower()) == 1
                    and is_normalized("NFC", c) and is_normalized("NFC", c.lower()))


class WordIds(dict):
    """Word (UTF-8, no white space) -> its ids as packed bytes.

    The tokenizer itself encodes every distinct word, whole. Only a word of
    letters with marks behind is put together from the two: the splitter cuts
    there whatever surrounds it, so the parts are encoded once each. Which
    words are letters is decided by the word alone, never by what is cached."""

    def __init__(self, path: str, width: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.width = Tokenizer.from_file(path), width
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")

    @staticmethod
    def letters(word: bytes) -> bool:
        """Surely one pre-token."""
        return word.isalpha() or not word.isascii() and LETTERS.issuperset(word.decode("utf-8", "replace"))

    def _single(self, words: list[bytes]) -> list[bytes]:
        """Words of one pre-token each, many a line: an id with a word end ends
        a word."""
        lines = [b" ".join(words[at:at + LINE]).decode() for at in range(0, len(words), LINE)]
        found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, self.width) for e in found])
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(words):
            return self._whole(words)
        packed, unit = ids.tobytes(), ids.itemsize
        cut = [0, *(cut * unit).tolist()]
        return [packed[a:b] for a, b in pairwise(cut)]

    def _whole(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, self.width).tobytes() for e in found]

    def learn(self, words: list[bytes]) -> None:
        missing = [w for w in words if w not in self]
        if len(self) + len(missing) > CACHE_WORDS:
            self.clear()
            missing = words
        single, rest, joined = set(), set(), []
        for w in missing:
            word = w.rstrip(MARKS)
            if not word or not self.letters(word):
                rest.add(w)
            elif len(word) == len(w):
                single.add(w)
            else:
                end = w[len(word):]
                joined.append((w, word, end))
                if word not in self:
                    single.add(word)
                if end not in self:
                    rest.add(end)
        for encode, new in ((self._single, list(single)), (self._whole, list(rest))):
            for at in range(0, len(new), 1 << 15):
                part = new[at:at + (1 << 15)]
                self.update(zip(part, encode(part)))
        for w, word, end in joined:
            self[w] = self[word] + self[end]


def split_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(first word of each text and the end, each word's number, the distinct
    words). A-Z are lower-cased first - the tokenizer's own rule - except
    where that could matter."""
    text = pc.fill_null(text, "")
    plain = pc.if_else(pc.match_substring_regex(text, AS_WRITTEN), text, pc.ascii_lower(text))
    lists = pc.ascii_split_whitespace(plain)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    words = lists.flatten().dictionary_encode()
    first = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
    return first, words.indices.to_numpy(zero_copy_only=False), words.dictionary.cast("binary").to_pylist()


TEXT_BYTES = 12 << 20        # of text that share one pass over their distinct words


def pieces_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * size // (batch.nbytes + 1))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            n += part.nbytes
            if n >= size:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def encode_texts(path: str, end_id: int, width: str):
    """(id, text) batches -> (id, ids packed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker(f"word ids {path} {width}", lambda: WordIds(path, width))
        end, unit = np.array([end_id], width).tobytes(), np.dtype(width).itemsize
        for part in pieces_of(batches, TEXT_BYTES):
            first, word, distinct = split_words(part.column(1))
            known.learn([w for w in distinct if w])
            pieces = [known[w] if w else b"" for w in distinct]
            size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // unit
            flat = np.frombuffer(b"".join(pieces), width)
            n = size[word]
            stop = np.concatenate(([0], np.cumsum(n)))
            shift = (np.cumsum(size) - size)[word] - stop[:-1]
            ids = flat[np.arange(stop[-1]) + np.repeat(shift, n)]
            cut = stop[first].tolist()
            packed = [ids[a:b].tobytes() + end for a, b in pairwise(cut)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["id", "ids"])
    return run


def count_ids(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in texts(batch.column(0)):
                n = np.bincount(np.frombuffer(ids, width))
                if len(n) > len(total):
                    total = np.pad(total, (0, len(n) - len(total)))
                total[:len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": used.astype(np.int64), "n": total[used]})
    return run


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[:len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        level = both[place]
        is_leaf.append(place < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for mask in reversed(is_leaf):
        leaf = int(mask[:take].sum())
        lengths[order[:leaf]] += 1
        take = 2 * (take - leaf)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then symbol."""
    codes = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    size = lengths[order]
    top = int(size[-1]) if len(size) else 0
    # left-aligned codes are running sums of 2^-length
    codes[order] = (np.cumsum(1 << (top - size)) - (1 << (top - size))) >> (top - size)
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit stream (big-endian 32-bit words) and the bit offset of every id."""
    size = lengths[ids]
    at = np.cumsum(size) - size
    placed = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    n = int((at[-1] + size[-1] + 31) >> 5) + 1
    # codes in one word do not overlap, so sums (exact below 2^53) are ors
    words = np.bincount(word, (placed >> np.uint64(32)).astype(np.float64), n)
    words += np.bincount(word + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
    return words.astype(np.uint64).astype(">u4").tobytes(), at


def decode_table(tokens: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next ``top`` bits: symbol and code length."""
    top = int(lengths.max()) if len(lengths) else 1
    symbol, size = np.zeros(1 << top, np.int64), np.ones(1 << top, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    span = 1 << (top - lengths[order])
    used = int(span.sum())
    symbol[:used], size[:used] = np.repeat(tokens[order], span), np.repeat(lengths[order], span)
    return symbol, size, top


def unpack_bits(payload: bytes, checkpoints: np.ndarray, n: int, lookup) -> np.ndarray:
    """Decode n ids, all checkpoints in step."""
    symbol, size, top = lookup
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.zeros((STEP, len(checkpoints)), np.int64)
    at = checkpoints.astype(np.int64)
    last = len(window) - 1
    for k in range(STEP):
        peek = (window[np.minimum(at >> 3, last)] >> (32 - top - (at & 7)).astype(np.uint32)) & ((1 << top) - 1)
        out[k] = symbol[peek]
        at += size[peek]
    return out.T.ravel()[:n]


BLOCKS = ("part int, first long, n_ids long, doc_ids binary, doc_null binary, doc_sizes binary, checkpoints binary, "
          "payload binary")


def write_blocks(tokens: np.ndarray, lengths: np.ndarray, width: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        size = int(tokens.max()) + 1 if len(tokens) else 1
        by_id, code_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
        by_id[tokens], code_of[tokens] = lengths, canonical(lengths)
        held, n_held, first = [], 0, 0

        def block():
            ids = np.concatenate([np.frombuffer(x, width) for _, x in held]).astype(np.int64)
            payload, at = pack_bits(ids, code_of, by_id)
            docs = [d for d, _ in held]
            return {"part": part, "first": first, "n_ids": len(ids),
                    "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(),
                    "doc_null": np.packbits([d is None for d in docs]).tobytes(),
                    "doc_sizes": np.array([len(x) // np.dtype(width).itemsize for _, x in held], "<i8").tobytes(),
                    "checkpoints": at[::STEP].astype("<i8").tobytes(), "payload": payload}

        def emit(row):
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                            *((c, pa.binary()) for c in ("doc_ids", "doc_null", "doc_sizes", "checkpoints", "payload"))])
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                held.append((doc, ids))
                n_held += len(ids) // np.dtype(width).itemsize
                if n_held >= block_ids:
                    yield emit(block())
                    first, held, n_held = first + n_held, [], 0
        if held:
            yield emit(block())
    return run


def read_blocks(tokens: np.ndarray, lengths: np.ndarray, before: dict[int, int]):
    """Blocks -> (id, start, n_tokens, ids_crc32) from the decoded ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = decode_table(tokens, canonical(lengths), lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_bits(row["payload"], np.frombuffer(row["checkpoints"], "<i8"), row["n_ids"], lookup)
                flat = memoryview(ids.astype("<u4").tobytes())
                size = np.frombuffer(row["doc_sizes"], "<i8")
                end = np.cumsum(size)
                null = np.unpackbits(np.frombuffer(row["doc_null"], np.uint8), count=len(size)).astype(bool)
                crc = [zlib.crc32(flat[4 * a:4 * b]) for a, b in zip(end - size, end)]
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=null),
                    "start": pa.array(before[row["part"]] + row["first"] + end - size),
                    "n_tokens": pa.array(size), "ids_crc32": pa.array(crc, pa.int64())})
    return run


def encode(df: DataFrame, folder: str, tokenizer: str, end_id: int = 2, vocabulary: int = 1 << 16,
           id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 16) -> None:
    """Write the Huffman files of ``df`` into ``folder``."""
    spark = df.sparkSession
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    ids = saved(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
                .mapInArrow(tidy(encode_texts(tokenizer, end_id, width)), "id long, ids binary"), "token-ids")
    # one row per used vocabulary entry: bounded by the vocabulary
    counts = (ids.select("ids").mapInArrow(tidy(count_ids(width)), "token long, n long")
              .groupBy("token").agg(F.sum("n").alias("n")).orderBy("token").toPandas())
    tokens, n = counts["token"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    limit = max(16, len(tokens).bit_length() + 1)
    lengths = code_lengths(n, limit)
    (spark.createDataFrame([(int(t), int(x)) for t, x in zip(tokens, lengths)], "token long, length int")
     .coalesce(1).write.parquet(f"{folder}/codes"))
    (ids.repartitionByRange(shuffle_parts(spark), "id").sortWithinPartitions("id")
     .mapInArrow(tidy(write_blocks(tokens, lengths, width, block_ids)), BLOCKS)
     .write.option("compression", "none").parquet(f"{folder}/blocks"))


def decode(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files alone: where its ids start, how many they
    are, and the crc32 of them all as little-endian 32-bit numbers."""
    codes = spark.read.parquet(f"{folder}/codes").orderBy("token").toPandas()
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, run = {}, 0
    for part, n in totals:
        before[part], run = run, run + n
    read = read_blocks(codes["token"].to_numpy(np.int64), codes["length"].to_numpy(np.int64), before)
    out = blocks.mapInArrow(tidy(read), "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def new_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "huffman")


ship(__name__)
