"""The pipeline on a fixture, every stage against a brute-force version."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from edge import odd_rows, words
from test_decontaminate import brute as hits
from test_mixing import targets
from test_ngram_join import shingles, union
from tokenizers import Tokenizer

import corpus_pipeline as cp
from cartlake.llm.common import saved


def test_contract():
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "source_mix", "tokens"]
    import __spark_entry__ as e
    names = {re.match(r"op\d+_|pipeline", n)[0] for n in e.queries() if n.startswith(("op", "pipeline"))}
    assert names == {f"op{n}_" for n in range(1, 14)} | {"pipeline"}


def test_rows_between_two_languages_go(spark, tmp_path):
    """With two languages a torn row has a score near 0.5."""
    rng = np.random.default_rng(3)
    text = lambda n, letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    rows = [(i, text(40, ("abcde", "vwxyz")[i % 2]), ("aa", "zz")[i % 2]) for i in range(60)]
    rows += [(100 + i, f"{text(i, 'abcde')} {text(80 - i, 'vwxyz')}".strip(), None) for i in range(81)]
    docs = spark.createDataFrame([(i, t, lang, "a", len(t)) for i, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    model = cp.language.fit(docs, ~cp.in_fold(3, 1))
    torn = {r.doc_id for r in cp.language.identify(docs, model).filter("ambiguous").collect()}
    kept = {r.doc_id for r in cp.language_id(spark, docs, str(tmp_path)).collect()}
    assert torn and min(torn) >= 100
    assert kept == {r[0] for r in rows} - torn


COLS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_with_repeated_ids(spark, tmp_path):
    """Different texts of one id are judged apart, equal rows leave one."""
    a, b, c, d, e = (words(900 + k, 60) for k in range(5))
    near = c.split()
    near[30] = "changed"
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (6, a, "en", "s"), (2, " ".join(near), "en", "s"), (5, c, "en", "s"),
            (5, d, "en", "s"), (8, e, "en", "z"), (8, e, "en", "y"), (9, "", "en", "s"), (9, None, "en", "s"),
            (10, "", "en", "s"), (None, a, "en", "s"), (None, a, "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLS)
    got = Counter((r.doc_id, r.text, r.source) for r in cp.near_duplicates(spark, docs, str(tmp_path)).collect())
    # a: row 6, as an id on several rows names none of them
    want = Counter([(6, a, "s"), (1, b, "s"), (2, " ".join(near), "s"), (5, d, "s"), (8, e, "y"), (9, "", "s"), (9, None, "s"),
                    (10, "", "s"), (None, a, "s"), (None, a, "s")])
    assert got == want


def test_no_labels_keep_every_row(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", None, "a", 9), (2, None, "en", "a", None)], COLS)
    assert sorted(r.doc_id for r in cp.language_id(spark, docs, str(tmp_path)).collect()) == [1, 2]


def test_empty_table_through_all_stages(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], COLS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "some benchmark item")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = cp.run(spark, d)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == 0


def test_stages(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] != 7]
    rows += [(7, "one more of its own", "en", "b")] * 2 + [(80 + i, words(700 + i, 60), "en", f"s{i % 5}") for i in range(20)]
    items = [(1, words(700, 60)[:150]), (2, words(30, 30))]
    d = str(tmp_path)
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], cols)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs.write.parquet(f"{d}/documents.parquet")
    stages = dict(cp.STAGES)

    one = saved(stages["language_id"](spark, docs, d), "t1")
    assert one.columns == cp.COLUMNS
    letter = Counter((r[0], r[1]) for r in rows if any(c.isalpha() for c in r[1] or ""))
    got = Counter((r.doc_id, r.text) for r in one.collect())
    assert not got - letter and sum((letter - got).values()) <= 2       # only torn rows may go besides

    two = saved(stages["near_duplicates"](spark, one, d), "t2")
    known = [r for r in one.collect() if r.doc_id is not None]
    sets = {(r.doc_id, r.text): shingles(r.text) for r in known}
    top = union({r.doc_id for r in known}, [(a[0], b[0]) for a in sets for b in sets if a < b and sets[a]
                                            and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert sorted(r.doc_id for r in two.filter("doc_id IS NOT NULL").collect()) == sorted(set(top.values()))
    assert two.filter("doc_id IS NULL").count() == one.filter("doc_id IS NULL").count()

    three = saved(stages["decontamination"](spark, two, d), "t3")
    clean = Counter()
    for r in two.collect():
        n, hit, *_ = hits(r.text, items)
        if not (hit and 20 * hit >= n):
            clean[r.doc_id, r.text] += 1
    assert Counter((r.doc_id, r.text) for r in three.collect()) == clean
    assert sum(clean.values()) < two.count()

    four = saved(stages["source_mix"](spark, three, d), "t4")
    assert four.columns == cp.COLUMNS
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    total, taken, most = Counter(), Counter(), Counter()
    for r in three.collect():
        total[r.source] += size(r)
        most[r.source] = max(most[r.source], size(r))
    for r in four.collect():
        taken[r.source] += size(r)
    for s, t in targets(total).items():
        assert abs(taken[s] - t) <= most[s] + 1
    assert max(Counter((r.doc_id, r.text) for r in four.collect()).values()) <= 2

    five = sorted(stages["tokens"](spark, four, d).collect(), key=lambda r: r.start)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    crc = lambda t: zlib.crc32(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in five) == sorted((str(r.doc_id), crc(r.text)) for r in four.collect())
    order = [-1 if r.doc_id is None else r.doc_id for r in five]
    assert order == sorted(order)
    assert hashlib.md5(str(sorted(map(str, cp.run(spark, d).collect()))).encode()).hexdigest() == \
        hashlib.md5(str(sorted(map(str, five))).encode()).hexdigest()
