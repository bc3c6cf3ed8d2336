"""Packed document files: many documents a file, for corpora whose documents
are too many to be a file each.

A record is the document's name, a line feed and its text (the name alone: no
text), and records end with the separator RS; the few characters that would
be mistaken for it are escaped. Files are written and read by Spark's text
source with that separator, so a reader splits large files between tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RS, ESC = "\x1e", "\x1b"
# character -> escaped, the escape itself first; a name has no line feed either
TEXT_ESCAPES = [(ESC, ESC + "["), (RS, ESC + "^")]
NAME_ESCAPES = [*TEXT_ESCAPES, ("\n", ESC + "n")]


def _escaped(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for plain, coded in pairs:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def _restored(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for plain, coded in reversed(pairs):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def pack_documents(docs: DataFrame, path: str, name_col: str = "doc_name", text_col: str = "text") -> None:
    """Write all documents; small input partitions are merged first, so that
    the number of files follows the bytes (the session's advisory partition
    size), not the tasks. Documents without a name are refused."""
    name, text = F.col(name_col).cast("string"), F.col(text_col)
    name = F.coalesce(_escaped(name, NAME_ESCAPES), F.raise_error(F.lit("a document has no name")).cast("string"))
    record = F.when(text.isNull(), name).otherwise(F.concat(name, F.lit("\n"), _escaped(text, TEXT_ESCAPES)))
    docs.select(record.alias("value")).hint("rebalance").write.option("lineSep", RS).text(path)


def packed_docs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_name, text) of all documents packed under ``path``."""
    record = F.col("value")
    end = F.instr(record, "\n")
    name = F.when(end > 0, F.left(record, end - 1)).otherwise(record)
    text = F.when(end > 0, F.substring(record, end + 1, F.length(record)))
    return spark.read.option("lineSep", RS).text(path).select(
        _restored(name, NAME_ESCAPES).alias("doc_name"), _restored(text, TEXT_ESCAPES).alias("text"))
