"""Token blocks: exact round trip against whole-text encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartlake.llm import huffman as hf

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ODD = ["", "  ", "İstanbul ΣΑΣ ΟΔΟΣ. naïve", "J̌ é É. Äb", "don't it's WE'LL <|endoftext|> x<|startoftext|>y",
       "a.b.c ... ?! the!! que%%% 123abc abc123", "日本語 テスト。русский ТЕКСТ ﬁne Ⅷ ǅ", "\x1c\x1d\x85  \x0b\x0c z",
       "word. word, Word. WORD!! word's", "\x00\x01 soft­hyphen ½ ² ª º µ", "ñandú ÉCOLE straße ẞ ŉ"]


def ids_of(text):
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": pa.array([None, text], pa.string())})
    out = next(iter(hf.encode_texts(PATH, 2, "<u2")(iter([batch])))).column(1).to_pylist()
    assert out[0] == b"\x02\x00" and out[1][-2:] == b"\x02\x00"
    return np.frombuffer(out[1][:-2], "<u2").tolist()


@pytest.mark.parametrize("text", ODD)
def test_words_equal_whole_text(text):
    assert ids_of(text) == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAeEsS .,!'́̈Σσé\n<|>")), max_size=60))
def test_words_equal_whole_text_property(text):
    assert ids_of(text) == WHOLE.encode(text, add_special_tokens=False).ids


MARKS = "👍 … — ” 。 • € “ 😂 😂😂 ñ Ω ß ǆ ﬁ 中 ª ½ ٣ é e\u0301 \u0301 ＡＢ ı İ ſ".split()
ENDS = ["", "!", '"', ")", "/", "(", "!!", "'s", "<", "|>", "-", "_", "a", "1", "é", "👍"]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_ids_do_not_depend_on_the_cache(seed):
    """Marks and letters alone, then joined to others, in several orders: one
    worker's cache, every text against the tokenizer's whole-text ids."""
    rng = random.Random(seed)
    known = hf.WordIds(PATH, "<u2")
    words = [a + b + c for a in MARKS for b in ENDS for c in ("", rng.choice(ENDS))] + MARKS
    words += ["".join(rng.choice(MARKS + ENDS) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    words = [w.encode() for w in words if w.split() == [w]]
    if seed:
        rng.shuffle(words)
    else:
        words.sort(key=len)
    want = {w: np.array(WHOLE.encode(w.decode(), add_special_tokens=False).ids, "<u2").tobytes() for w in words}
    for at in range(0, len(words), 150):
        known.learn(list(dict.fromkeys(words[at:at + 150])))
    assert {w: known[w] for w in words} == want


def test_batches_with_a_warm_cache(monkeypatch):
    """One worker over several batches, also when its cache is emptied."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(MARKS) + rng.choice(ENDS) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    texts += [" ".join(rng.choice(MARKS) for _ in range(5)) for _ in range(100)] + ["<|ENDOFTEXT|> <|endoftext|>! x<|endoftext|>"]
    rng.shuffle(texts)
    for cache in (hf.CACHE_WORDS, 60):
        monkeypatch.setattr(hf, "CACHE_WORDS", cache)
        batches = [pa.RecordBatch.from_pydict({"id": list(range(20)), "text": texts[at:at + 20]}) for at in range(0, 500, 20)]
        monkeypatch.setattr(hf, "TEXT_BYTES", 500)
        got = [x for b in hf.encode_texts(PATH, 2, "<u2")(iter(batches)) for x in b.column(1).to_pylist()]
        for text, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u2").tolist() == [*WHOLE.encode(text, add_special_tokens=False).ids, 2], text


def test_lengths_are_optimal_and_limited():
    rng = random.Random(3)
    for n, limit in ((2, 1), (5, 3), (40, 6), (300, 16), (300, 9)):
        counts = np.array([int(rng.paretovariate(0.4)) for _ in range(n)], np.int64)
        size = hf.code_lengths(counts, limit)
        assert size.max() <= limit and (2.0 ** -size).sum() <= 1
        if limit == 16:
            heap = sorted(counts.tolist())
            cost = 0
            while len(heap) > 1:
                a, b = heap.pop(0), heap.pop(0)
                cost += a + b
                heap.append(a + b)
                heap.sort()
            assert (size * counts).sum() == cost or size.max() == limit


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    ids = (rng.pareto(0.5, 5000) % 700).astype(np.int64)
    tokens, counts = np.unique(ids, return_counts=True)
    size = hf.code_lengths(counts, 12)
    dense = np.zeros(700, np.int64), np.zeros(700, np.int64)
    dense[0][tokens], dense[1][tokens] = hf.canonical(size), size
    payload, at = hf.pack_bits(ids, *dense)
    table = hf.decode_table(tokens, hf.canonical(size), size)
    assert (hf.unpack_bits(payload, at[::hf.STEP], len(ids), table) == ids).all()


def test_documents(spark):
    data = [(7, "the cat"), (3, None), (None, "no id"), (3, "twice"), (9, ""), (-2, "word " * 70000), (4, ODD[4])]
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, ids string")
    folder = hf.new_folder(spark)
    hf.encode(df, folder, PATH, block_ids=64)
    got = sorted(hf.decode(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -2, 3, 3, 4, 7, 9]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    crc = lambda t: zlib.crc32(np.array([*WHOLE.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), crc(t)) for i, t in data)


def test_empty_table(spark):
    folder = hf.new_folder(spark)
    hf.encode(spark.createDataFrame([], "doc_id long, text string"), folder, PATH)
    assert hf.decode(spark, folder).count() == 0
