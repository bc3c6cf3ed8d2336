"""Chunker: the running-length helper and the native fold against the rules
as a left fold in DuckDB SQL."""

import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartlake.functions.chunking import chunk_text
from cartlake.operators import rag
from cartlake.queries.rag import chunks_sql


def model_chunks(texts, size=1000, overlap=200, sep="chr(10) || chr(10)"):
    """Chunks of every text, by SQL."""
    con = duckdb.connect()
    con.execute("CREATE TABLE docs (doc_name BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO docs VALUES (?, ?)", list(enumerate(texts)))
    out = [[] for _ in texts]
    for name, content in con.execute(f"WITH {chunks_sql('docs', size, overlap, sep)} "
                                     "SELECT doc_name, content FROM chunks ORDER BY doc_name, chunk_index").fetchall():
        out[name].append(content)
    return out


def _para(n, ch="a"):
    return (ch * 9 + " ") * (n // 10) + ch * (n % 10)


CASES = [
    "",
    "\n\n\n",
    "short",
    _para(998) + "\n\n" + _para(10),
    _para(999) + "\n\n" + _para(10),
    _para(1000) + "\n\n" + _para(10),
    _para(1001) + "\n\n" + _para(10),
    _para(10) + "\n\n" + _para(998),
    _para(10) + "\n\n" + _para(999),
    _para(10) + "\n\n" + _para(1000),
    _para(10) + "\n\n" + _para(1001),
    "x" * 1500,                      # first word longer than a chunk: empty chunk quirk
    "tiny " + "y" * 1500,            # long word after a short word
    "　 lead 　\n\n　para two　",
    _para(2500) + "\n\n" + "tail paragraph",   # oversize then short: tail packs, no overlap carried in
    "\n\n".join(_para(300 + 37 * i) for i in range(12)),
]


def test_helper_matches_sql():
    assert [chunk_text(t, 1000, 200, "\n\n") for t in CASES] == model_chunks(CASES)


def test_empty_chunk_quirk():
    out = chunk_text("x" * 1500, 1000, 200, "\n\n")
    assert out[0] == "" and len(out) == 2


@given(st.lists(st.lists(st.text(alphabet="ab \u3000\n", min_size=0, max_size=400), max_size=8), min_size=1, max_size=8),
       st.integers(min_value=20, max_value=120), st.integers(min_value=0, max_value=30))
@settings(max_examples=60, deadline=None)
def test_helper_property(docs, size, overlap):
    texts = ["\n\n".join(paras) for paras in docs]
    assert [chunk_text(t, size, overlap, "\n\n") for t in texts] == model_chunks(texts, size, overlap)


@pytest.mark.parametrize("overlap", [0, 1, 7])
def test_fold_equals_helper_at_small_overlaps(spark, overlap):
    texts = [c * 3 for c in ("ab cd ef\n\n", "abcdefghijklm nop\n\nq r s t\n\n", "　x　\n\n" + "yy " * 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_name long, text string")
    for r in rag.chunk_documents(docs, 12, overlap, engine="fold").collect():
        assert r.content == chunk_text(texts[r.doc_name], 12, overlap, "\n\n")[r.chunk_index]


def test_spark_engines_match_model(spark):
    rnd = random.Random(7)
    texts = CASES + ["\n\n".join(_para(rnd.randint(1, 2600)) for _ in range(rnd.randint(1, 9))) for _ in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_name long, text string")
    want = model_chunks(texts)
    for engine in ("arrow", "fold"):
        got = {}
        for r in rag.chunk_documents(docs, engine=engine).collect():
            got.setdefault(r.doc_name, {})[r.chunk_index] = r.content
        for i in range(len(texts)):
            g = got.get(i, {})
            assert [g[k] for k in range(len(g))] == want[i], (engine, i)


def test_chunk_ids_are_md5_prefix(spark):
    import hashlib
    docs = spark.createDataFrame([("policy", _para(1500))], "doc_name string, text string")
    rows = rag.chunk_documents(docs).collect()
    for r in rows:
        assert r.chunk_id == hashlib.md5(f"policy::{r.chunk_index}".encode()).hexdigest()[:16]


def test_a_batch_is_chunked_in_slices():
    """A batch of many long texts leaves in small batches, in order, null ids and texts included."""
    import pyarrow as pa
    from cartlake.functions.chunking import chunk_batches, chunk_text
    docs = [(i if i % 50 else None, _para(4000 + i) if i % 97 else None) for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())],
                                       ["doc_name", "text"])
    out = list(chunk_batches(1000, 200, "\n")(iter([batch])))
    assert max(b.nbytes for b in out) < batch.nbytes / 4
    want = [(i, n, c) for i, t in docs for n, c in enumerate(chunk_text(t, 1000, 200, "\n"))]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want


def test_texts_reach_python_in_short_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rag.chunk_documents(spark.sql("SELECT 1L AS doc_name, 'a' AS text"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
