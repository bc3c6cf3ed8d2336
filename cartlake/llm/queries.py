"""The registered queries opN_<name>: thin bindings of the operators to the
driver tables, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as dc
from . import exact_dedup as xd
from . import fim
from . import huffman as hf
from . import language as lg
from . import lm_score as lm
from . import mixing as mx
from . import ngram_join as nj
from . import periodic_runs as pr
from . import quality as ql
from . import suffix_dedup as sd
from . import toxicity as tx
from . import url_filter as uf
from .common import in_fold, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = ql.features(table(spark, sf_dir, "documents"))
    model = ql.fit(feats, table(spark, sf_dir, "labels"),
                   learn=F.col("id").isNotNull() & ~in_fold(3, 1, "id"))
    return ql.score(feats, model).withColumn("held_out", in_fold(3, 1))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mx.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nj.ngram_join(table(spark, sf_dir, "documents"))


# sources fill up in order of 2 * size / weight; the level after which nobody is full gives the targets
MIX_TARGETS_SQL = """
sized AS (SELECT {cols} doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
                 ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM {docs}),
per AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank FROM per),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                   2.0::DOUBLE * source_size AS most FROM ranked),
filled AS (SELECT *, coalesce(sum(most) OVER w, 0.0) AS full_words,
                  sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0) AS open_weight,
                  sum(source_size) OVER () AS words
           FROM weighed WINDOW w AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (1.5::DOUBLE * words - full_words) / open_weight AS own FROM filled),
level AS (SELECT max(own) FILTER (own * weight <= most) AS level FROM levels),
targets AS (SELECT source, rank, source_size::BIGINT AS source_size,
                   CASE WHEN level IS NULL THEN most ELSE least(most, level * weight) END AS target FROM levels, level),
rows_of AS (SELECT s.*, t.rank, t.source_size, t.target, CASE WHEN t.target >= t.source_size THEN 1 ELSE 0 END AS whole
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
running AS (SELECT *, target - whole * source_size AS need,
                   sum(size) OVER (PARTITION BY rank ORDER BY hash RANGE UNBOUNDED PRECEDING) AS upto,
                   sum(size) OVER (PARTITION BY rank, hash) AS tied FROM rows_of),
edge AS (SELECT rank, max(hash) AS hash FROM running WHERE upto - tied < need GROUP BY rank),
cut AS (SELECT DISTINCT e.rank, CASE WHEN 2 * (r.need - (r.upto - r.tied)) >= r.tied THEN e.hash ELSE e.hash - 1 END AS threshold
        FROM edge e JOIN running r USING (rank, hash)),
mixed AS (SELECT r.*, whole + CASE WHEN r.hash <= c.threshold THEN 1 ELSE 0 END AS times
          FROM running r LEFT JOIN cut c USING (rank))"""

OP2_SQL = ("WITH " + MIX_TARGETS_SQL.format(cols="", docs="documents")
           + " SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,"
             " (times * size)::BIGINT AS taken FROM mixed")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = tx.fit(docs, table(spark, sf_dir, "labels"), ~in_fold(5, 0))
    return tx.score(docs, model).withColumn("held_out", in_fold(5, 0))


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks(spark, table(spark, sf_dir, "documents"))


def token_blocks(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    folder = hf.new_folder(spark)
    hf.encode(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return hf.decode(spark, folder)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dc.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.col("doc_id").isNotNull() & ~in_fold(7, 2)
    return lm.lm_score(table(spark, sf_dir, "documents"), learn).withColumn("held_out", in_fold(7, 2))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sd.suffix_dedup(table(spark, sf_dir, "documents"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return d.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                    "kept_sha256")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lg.fit(docs, ~in_fold(3, 1))
    return lg.identify(docs, model).withColumn("held_out", in_fold(3, 1))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = xd.exact_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r"""


# ---------------------------------------------------------------------- runs

def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Of every document with crc32(id) % 10 = 0, the words from a on become
    the p words after a, repeated."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("words"), F.floor(h / 10)
    docs = docs.select("doc_id", "text", F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("words"),
                       g.alias("g")).withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int")))
    p = F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)).cast("int")
    planted = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", F.col("a") + F.pmod(i - F.col("a"), F.col("p")))))
    return docs.withColumn("p", p).select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " "))
                                          .otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pr.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = pr.strongest(F.col("runs"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "runs", "kept", best.alias("best")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))


# ---------------------------------------------------------------------- urls

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
URL_RULE_ROWS = ", ".join(str(r) for r in URL_RULES)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {URL_RULE_ROWS} AS r(action, host, path)")
    return uf.judge(table(spark, sf_dir, "pages"), rules)


OP12_SQL = r"""
WITH rules(action, rule_host, rule_path) AS (VALUES {rules}),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages),
targets AS (
  SELECT url, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''>\s]+)', 1) AS target FROM tags
  WHERE regexp_matches(tag, '(?is)^<link') AND regexp_matches(tag, '(?is)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')
  UNION
  SELECT url, regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''>\s]+)', 1) FROM tags
  WHERE regexp_matches(tag, '(?is)^<meta') AND regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?\s*refresh\b')),
edges AS (SELECT url, CASE WHEN contains(target, '://') THEN target
                           WHEN starts_with(target, '//') THEN 'http:' || target
                           WHEN starts_with(target, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target
                      END AS target FROM targets WHERE target <> ''),
urls AS (SELECT url FROM pages UNION SELECT url FROM edges UNION SELECT target FROM edges),
parts AS (SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                 regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest FROM urls WHERE contains(url, '://')),
nodes AS (SELECT *, host || CASE WHEN starts_with(rest, '/') THEN '' ELSE '/' END || rest AS node FROM parts),
own AS (SELECT url, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
               arg_max(action, length(rule_host || rule_path)) AS action
        FROM nodes JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY url),
links AS (SELECT a.node AS a, b.node AS b FROM edges e JOIN nodes a ON e.url = a.url JOIN nodes b ON e.target = b.url),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM both_ways
                                     UNION SELECT r.a, l.b FROM r JOIN both_ways l ON r.b = l.a) SELECT a, b FROM r),
told AS (SELECT r.a AS node, min(o.action) AS action FROM reach r JOIN nodes n ON r.b = n.node JOIN own o USING (url)
         GROUP BY r.a)
SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, o.rule,
       coalesce(o.action, t.action, 'allow') AS verdict
FROM pages p LEFT JOIN nodes n USING (url) LEFT JOIN own o USING (url) LEFT JOIN told t ON n.node = t.node""".replace(
    "{rules}", URL_RULE_ROWS)


# ----------------------------------------------------------- fill in the middle

def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transform(fim.store(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM d),
h AS (SELECT *, len(units) AS n, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
             ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                    OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
             array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p"""


QUERIES = {
    "op1_quality": (op1_quality, None),
    "op2_mix_sources": (op2_mix_sources, OP2_SQL),
    "op3_toxicity": (op3_toxicity, None),
    "op4_token_blocks": (op4_token_blocks, None),
    "op5_decontaminate": (op5_decontaminate, None),
    "op6_lm_score": (op6_lm_score, None),
    "op7_suffix_dedup": (op7_suffix_dedup, None),
    "op8_language": (op8_language, None),
    "op9_exact_dedup": (op9_exact_dedup, OP9_SQL),
    "op10_ngram_join": (op10_ngram_join, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_url_filter": (op12_url_filter, OP12_SQL),
    "op13_fill_in_middle": (op13_fill_in_middle, OP13_SQL),
}
