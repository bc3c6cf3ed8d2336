"""Document files: packed archives and whole files."""

import os

import pytest

from cartlake.sources import io as IO
from cartlake.sources.packed import ESC, RS, pack_documents, packed_docs
from cartlake.sources.tables import Tables
from conftest import SF_CHECK

ODD = [("a", "two\nlines\n"), ("b", ""), ("c", None), ("d\ne", f"x{RS}y{ESC}z{ESC}^{ESC}[{ESC}n"), ("", "no name but one"),
       (f"f{RS}", "\r\n\t"), ("g", "\n"), ("a", "the same name"), ("h", "日本語 👍"), (ESC + "n", ESC)]


def test_odd_documents_come_back(spark, tmp_path):
    path = f"{tmp_path}/p"
    pack_documents(spark.createDataFrame(ODD, "doc_name string, text string").repartition(7), path)
    assert sorted(map(str, ((r.doc_name, r.text) for r in packed_docs(spark, path).collect()))) == sorted(map(str, ODD))


def test_no_name_and_no_documents(spark, tmp_path):
    df = spark.createDataFrame([(None, "x")], "doc_name string, text string")
    with pytest.raises(Exception, match="no name"):
        pack_documents(df, f"{tmp_path}/a")
    pack_documents(df.limit(0), f"{tmp_path}/b")
    assert packed_docs(spark, f"{tmp_path}/b").count() == 0


def test_few_files_split_reading(spark, tmp_path):
    """Many tasks write few files, and a large file is read by several tasks."""
    docs = Tables(spark, SF_CHECK).documents
    path = f"{tmp_path}/p"
    pack_documents(docs.repartition(40), path, "doc_id")
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) <= 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = packed_docs(spark, path)
        assert got.rdd.getNumPartitions() > 4
        assert {(r.doc_name, r.text) for r in got.collect()} == {(str(r.doc_id), r.text) for r in docs.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_whole_files(spark, tmp_path):
    (tmp_path / "b.md").write_text("# B\n\ntext\n")
    (tmp_path / "a.md").write_text("")
    (tmp_path / "a.txt").write_text("no")
    assert sorted((r.doc_name, r.text) for r in IO.markdown_docs(spark, str(tmp_path)).collect()) == [("b", "# B\n\ntext\n")]
