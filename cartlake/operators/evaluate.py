"""Deterministic answer scorers and their aggregation.

Scorers are Column expressions (JVM side), so scoring a row is a narrow
projection; the keyword and phrase lists are literal arrays folded per row,
not joined.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import money

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference scorers (in their order; the
# keyword list deliberately contains "48時間" twice, and each copy counts).
POLICY_KEYWORDS = [
    "48時間", "90日", "30日", "7日",
    "¥800", "¥600", "¥400",
    "¥5,000", "¥7,500", "¥10,000", "¥3,000", "¥3,500", "¥2,500",
    "bronze", "silver", "gold", "platinum",
    "¥100につき1ポイント", "1.5ポイント", "2ポイント", "3ポイント",
    "100ポイント", "500ポイント", "1,000ポイント",
    "ダブルフレッシュ保証",
    "サンブライト", "はっぴーファーム", "クランチタイム",
    "大腸菌", "大豆アレルゲン", "乳アレルゲン",
    "0120-", "24時間", "48時間",
    "5〜7営業日", "3〜5営業日",
    "14:00", "16:00", "10km", "15km",
    "9:00", "22:00", "21:00",
    "消費期限", "賞味期限",
    "特定原材料",
]
TONE_EMPATHY = ["申し訳", "お詫び", "ご不便", "ご心配", "お気持ち", "お手伝い", "ご案内", "承知", "かしこまり",
                "もちろん", "ぜひ", "喜んで"]
TONE_ACTION = ["いただけます", "手順", "方法", "サービスカウンター", "お持ちください", "ご連絡", "お電話",
               "おすすめ", "ご提案", "ご確認", "ステップ", "以下の"]
TONE_WARM = ["いらっしゃいませ", "ありがとう", "お越し", "お気軽に", "何でもお聞き", "他にご質問", "お待ちして",
             "またのご来店", "お役に立て"]
TONE_BLAME = ["お客様のせい", "お客様が悪い", "お客様の責任", "対応できません", "当店は関係"]
TONE_WEIGHTS = (0.35, 0.35, 0.30, 0.5)
MIN_RESPONSE_LEN = 10
# ---------------------------------------------------------------------------


def _hits(text: Column, phrases: list[str]) -> Column:
    """How many phrases occur: a sum of compiled substring tests."""
    return sum((text.contains(p.lower()).cast("int") for p in phrases), F.lit(0))


def _any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p.lower()) for p in phrases))


def policy_specificity(answer: Column) -> Column:
    """min(hits / 3, 1) over the keyword list (with multiplicity); 0 for a
    missing answer."""
    t = F.lower(answer)
    return F.when(answer.isNull(), F.lit(0.0)).otherwise(F.least(_hits(t, POLICY_KEYWORDS) / 3.0, F.lit(1.0)))


def tone(answer: Column) -> Column:
    t = F.lower(answer)
    e, a, w, b = TONE_WEIGHTS
    s = F.lit(0.0)
    s = F.when(_any(t, TONE_EMPATHY), s + e).otherwise(s)
    s = F.when(_any(t, TONE_ACTION), s + a).otherwise(s)
    s = F.when(_any(t, TONE_WARM), s + w).otherwise(s)
    s = F.when(_any(t, TONE_BLAME), F.greatest(s - b, F.lit(0.0))).otherwise(s)
    return F.when(answer.isNull(), F.lit(0.0)).otherwise(money(s, 2))


def response_guard(answers: DataFrame, col: str = "answer", min_len: int = MIN_RESPONSE_LEN) -> DataFrame:
    n = F.coalesce(F.length(col), F.lit(0))
    return answers.select("*", n.alias("answer_len"), (n < min_len).alias("flagged"))


def final_answer(messages: DataFrame) -> DataFrame:
    """Per conversation: the last message with non-empty text and no tool
    call; else (nothing qualifies) the last message's text."""
    qualifies = (F.length("text") > 0) & ~F.exists("parts", lambda p: p["type"] == "dynamic-tool")
    g = messages.groupBy("chat_id").agg(
        F.max_by("text", F.when(qualifies, F.struct("created_at", "id"))).alias("final"),
        F.max_by("text", F.struct("created_at", "id")).alias("last"))
    return g.select("chat_id", F.coalesce("final", "last").alias("answer"))


# kinds of tools by substrings of their lower-cased names
TOOL_KINDS = {"data": ("sql",), "search": ("vector", "policy", "search"), "memory": ("memory",)}


def tool_routing(rows: DataFrame, spans: DataFrame, kinds: dict[str, tuple[str, ...]] = TOOL_KINDS) -> DataFrame:
    """unknown (no trace) / no_tools / yes / no, by substrings of the
    lower-cased TOOL span names. One aggregation of the spans per trace."""
    tool = F.col("span_type") == "TOOL"
    known = _any(F.lower("name"), [p for ps in kinds.values() for p in ps])
    per = spans.groupBy("trace_id").agg(
        F.lit(True).alias("traced"), F.bool_or(F.when(tool, known)).alias("routed"),
        F.array_sort(F.collect_set(F.when(tool, F.col("name")))).alias("names"))
    tools = F.when(F.size("names") > 0, F.array_join("names", ", "))
    j = rows.join(per, "trace_id", "left").withColumn("tools", tools)
    value = (F.when(F.col("traced").isNull(), "unknown").when(F.col("tools").isNull(), "no_tools")
             .when(F.col("routed"), "yes").otherwise("no"))
    return j.select("row_id", "trace_id", value.alias("value"), F.col("tools").alias("rationale"))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def fact_coverage(rows: DataFrame, answer: str, facts: str, threshold: float = 0.6) -> DataFrame:
    """Share of expected facts found in the answer: a fact is found when at
    least ``threshold`` of its distinct tokens occur in the answer. A
    lexical stand-in for an LLM correctness judge, not the same measure."""
    at = tokens(F.col(answer))
    found = F.transform(F.col(facts), lambda f: F.when(
        F.size(F.array_distinct(tokens(f))) == 0, F.lit(False)).otherwise(
        F.size(F.array_intersect(F.array_distinct(tokens(f)), at)) / F.size(F.array_distinct(tokens(f))) >= threshold))
    n_found = F.size(F.filter(found, lambda x: x))
    n = F.size(F.col(facts))
    return rows.select("row_id", n.alias("n_facts"), n_found.alias("n_found"),
                       F.when(n > 0, money(n_found / n, 6)).alias("coverage"))


def tool_efficiency(spans: DataFrame) -> DataFrame:
    """Repeated identical tool calls (same name and arguments) per trace."""
    t = spans.filter(F.col("span_type") == "TOOL")
    return t.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_calls"),
                                     F.count_distinct("name", "args").alias("n_distinct")) \
        .withColumn("repeated", F.col("n_calls") - F.col("n_distinct"))


def dataset_union(**sets: DataFrame) -> DataFrame:
    out = None
    for tag, df in sets.items():
        d = df.withColumn("tag", F.lit(tag))
        out = d if out is None else out.unionByName(d)
    return out


def scorer_matrix(rows: DataFrame, scorers: dict[str, Callable[[DataFrame], Column] | Column]) -> DataFrame:
    """rows x scorers -> one feedback row per (row, scorer) via stack, then
    the mean per scorer. A scorer is a Column or a function of the rows
    DataFrame returning a Column (e.g. a pandas UDF applied to columns)."""
    cols = {name: (s(rows) if callable(s) else s).cast("double") for name, s in scorers.items()}
    wide = rows.select("row_id", *[c.alias(f"s_{i}") for i, c in enumerate(cols.values())])
    names = list(cols)
    stack = "stack({}, {}) as (scorer, value)".format(
        len(names), ", ".join(f"'{n}', s_{i}" for i, n in enumerate(names)))
    long = wide.selectExpr("row_id", stack)
    return long.groupBy("scorer").agg(F.count("value").alias("n"), money(F.avg("value"), 6).alias("mean"))
