"""The corpus pipeline: language ID, near-duplicate removal, benchmark
decontamination, source mixing, token blocks. Every stage calls one of the
operators in cartlake.llm on all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlake.llm import decontaminate, language, mixing, ngram_join
from cartlake.llm.common import in_fold, saved, table
from cartlake.llm.queries import token_blocks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, and rows torn between languages (the margin of
    the operator, whatever the number of languages), go.

    Null, empty and letterless texts go; null ids stay; repeated rows are
    judged alike and stay as often; where no learnable row has a language,
    nothing can be told and every row is kept; an empty table stays empty."""
    if docs.filter(~in_fold(3, 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).isEmpty():
        return docs.select(*COLUMNS)
    model = language.fit(docs, ~in_fold(3, 1))
    found = language.identify(docs, model, carry=COLUMNS)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Rows without an id stay; rows with an empty text are groups of their own. An
    id on several rows names none of them: such rows take part under a hash of
    id and text, which comes after all ids, so that different texts of one id
    are judged apart, and equal ones leave one row (the least in its other
    columns). An empty table stays empty."""
    known = docs.filter("doc_id IS NOT NULL")
    repeated = saved(known.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        rows = known.withColumn("row_id", F.col("doc_id"))
        first = ngram_join.ngram_join(rows, id_col="row_id").filter("row_id = component_id").select("row_id")
        kept = rows.join(first, "row_id", "left_semi")
    else:
        named = F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2))
        rows = known.join(repeated.withColumn("again", F.lit(True)), "doc_id", "left") \
            .withColumn("row_id", F.when(F.col("again"), named).otherwise(F.col("doc_id"))).drop("again")
        rows = saved(rows, "pipeline-rows")
        first = ngram_join.ngram_join(rows, id_col="row_id").filter("row_id = component_id").select("row_id")
        kept = rows.join(first, "row_id", "left_semi")
        once = kept.groupBy("row_id").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
        kept = once
    return kept.select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Null and empty texts have no words and stay; null ids and repeated rows are
    judged by their text alone; without benchmark items, or without rows,
    nothing changes."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"),
                                        carry=[c for c in COLUMNS if c != "doc_id"])
    return found.filter(~F.col("contaminated")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it (0 to 2 times).

    Null and empty texts have size 0; null sources are a source of their own,
    the last; rows with equal ids (or none) have equal hashes and are taken
    together; an empty table stays empty."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded, written and read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is its end id alone; null ids come first; rows of one
    id have ranges of their own, in any order among themselves; an empty table
    gives no rows."""
    return token_blocks(spark, docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("source_mix", source_mix), ("tokens", tokens)]

# language ID cannot be said in SQL; tests check every stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
