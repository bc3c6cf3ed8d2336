"""Periodic run detection by Baier grouping (operator 11).

The first phase of Baier's suffix sorter groups suffixes by their longest
Lyndon prefix, so the context lengths it ends with are the Lyndon array. It is
run twice, under an order of the words and under the reverse order; every run
has, under one of the two, a Lyndon root that is the longest Lyndon word at
each of its occurrences after the run's first word. Roots that follow
themselves are extended to both sides through longest common extensions into
maximal runs.

A run here is a stretch of words with smallest period q, length at least
``max(least, exponent * q)`` (exponent 3 or more), that no neighbouring word
extends. Such a run lies inside a stretch of words all of whose three-word
windows occur at least ``exponent - 1`` times in the text (a necessary
condition, hence nothing is lost), so grouping is done on these stretches
only; they are found for a whole batch at once.

Work is per text and no rows meet. Defined cases: null, empty and blank texts
have no words and no runs; ties for the strongest run go to the smallest
start, then period; repeated rows get equal results; an empty table gives no
rows; extra columns are ignored unless carried."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, tidy

WINDOW = 3

RUNS = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"


def lyndon_lengths(word: list[int], top: int) -> list[int]:
    """Length of the longest Lyndon word at each position: the context lengths
    that phase one ends with. ``word`` has numbers from 0 to top.

    Groups are taken from the highest down. The suffixes of a group point to
    the nearest suffix before them that is in a lower group; suffixes pointed
    to as often, from one group, move to a new group right above theirs (more
    pointers stand higher), and their contexts grow by the pointing ones."""
    n = len(word)
    length, group = [1] * n, list(word)
    # the ungrouped positions as a linked list: all of them, the current group
    # excepted, are in lower groups. Index n (= -1) is its end.
    left, right = [*range(-1, n)], [*range(1, n + 1), 0]
    members: list = [[] for _ in range(top + 1)]
    for i, w in enumerate(word):
        members[w].append(i)
    below, above = [*range(-1, top)], [*range(1, top + 1), -1]
    at = top
    while at >= 0:
        pointed: dict[int, int] = {}
        size = 0
        for i in members[at]:
            if group[i] == at:           # else moved to a higher group before
                size = length[i]
                p, q = left[i], right[i]
                right[p], left[q] = q, p
                if p >= 0:
                    pointed[p] = pointed.get(p, 0) + 1
        members[at] = None
        at = below[at]
        if at >= 0:
            above[at] = -1
        if not pointed:
            continue
        parts: dict[tuple[int, int], list[int]] = {}
        for p, k in pointed.items():
            length[p] += k * size
            parts.setdefault((k, group[p]), []).append(p)
        for k, home in sorted(parts, reverse=True) if len(parts) > 1 else parts:
            own, new, upper = parts[k, home], len(members), above[home]
            for p in own:
                group[p] = new
            members.append(own)
            below.append(home)
            above.append(upper)
            above[home] = new
            if upper >= 0:
                below[upper] = new
            else:
                at = new
    return length


def extension(word: np.ndarray, i: int, j: int) -> int:
    """Longest common extension to the right of positions i < j."""
    found, step, n = 0, 16, len(word)
    while j + found < n:
        b = word[j + found:j + found + step]
        differ = np.flatnonzero(word[i + found:i + found + len(b)] != b)
        if len(differ):
            return found + int(differ[0])
        found += len(b)
        step *= 2
    return found


def runs_of(word: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a word sequence, by start, then period."""
    n = len(word)
    distinct, rank = np.unique(word, return_inverse=True)
    top, back, found = len(distinct) - 1, word[::-1], set()
    place = np.arange(n)
    for order in (rank, top - rank):
        root = np.array(lyndon_lengths(order.tolist(), top))
        again = place + root
        # roots that follow themselves, as every run has one
        good = (root * exponent <= n) & (again + root <= n)
        good[good] = root[again[good]] == root[good]
        good[good] = word[place[good]] == word[again[good]]
        good[good] = word[again[good] - 1] == word[(again + root)[good] - 1]
        seen: dict[int, int] = {}        # period -> end of the last stretch that has it
        for i in np.flatnonzero(good).tolist():
            q = int(root[i])
            if i + 2 * q <= seen.get(q, 0):
                continue                 # the same stretch again
            right = extension(word, i, i + q)
            left = extension(back, n - i - q, n - i)
            length = left + q + right
            seen[q] = i + q + right
            if length >= max(least, exponent * q):
                found.add((i - left, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(word: np.ndarray, doc: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """(start, stop) of the stretches of a batch's words in which every window
    of three words may occur exponent - 1 times in its document. Windows are
    counted by hash: one that shares its count only makes a stretch longer."""
    if len(word) < max(least, WINDOW):
        return []
    size = 1 << max(10, (4 * len(word)).bit_length())
    w = word.astype(np.uint64) + np.uint64(1)
    mix = doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k, factor in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        mix = (mix ^ w[k:len(w) - 2 + k]) * np.uint64(factor)
        mix ^= mix >> np.uint64(29)
    slot = (mix & np.uint64(size - 1)).astype(np.int64)
    often = np.bincount(slot, minlength=size)[slot] >= exponent - 1
    # windows over the end of a document are none
    often &= doc[:-2] == doc[2:]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], often.view(np.int8), [0]))))
    start, stop = edge[::2], edge[1::2] + WINDOW - 1
    long = stop - start >= least
    return list(zip(start[long].tolist(), stop[long].tolist()))


def batch_runs(text: pa.Array, least: int, exponent: int):
    """(words of each text, their first words and end, all words, runs of each
    text, which words stay)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    words, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(n)), n)
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    words, doc = words.filter(pa.array(real)), doc[real]
    first = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(n)))))
    number = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    stay = np.ones(len(words), bool)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(n))]
    for start, stop in stretches(number, doc, least, exponent):
        d = int(doc[start])
        for a, length, q in runs_of(number[start:stop], least, exponent):
            stay[start + a + q:start + a + length] = False
            runs[d].append((start + a - int(first[d]), length, q))
    return first, words, runs, stay


def run_rows(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in slices(batch):
                first, words, runs, stay = batch_runs(part.column(1), least, exponent)
                kept = np.concatenate(([0], np.cumsum(stay)))[first]
                lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(stay)))
                named = [[{"start": a, "length": b, "period": c} for a, b, c in r] for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(first)), pa.array(named, kind), pc.binary_join(lists, " ")],
                    ["id", "n_words", "runs", "kept"])
    return run


def periodic_runs(df: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per text: its words (``[^\\x20\\x09-\\x0D]+``) counted, its runs as
    (start, length, period) by start and period, and ``kept``: the words that
    are in no run after that run's first period, joined by one space."""
    if exponent < 3:
        raise ValueError("runs of exponent 3 or more are found")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run_rows(least, exponent)), RUNS).withColumnRenamed("id", id_col)


def strongest(runs):
    """The run of greatest length / period, compared exactly (the first of
    equal ones, as runs come by start and period); null without runs."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, 0), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


ship(__name__)
