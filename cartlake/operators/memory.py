"""Long-term memory (namespaced key -> JSON object store) and short-term
checkpoints, as append-only logs compacted per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import top_matches
from ..plans.numbering import rank_within, time_blocks
from .upsert import last_write

KEYS = ["ns_kind", "ns_user", "mem_key"]


def resolve_ids(requests: DataFrame) -> DataFrame:
    """user: the custom_inputs user_id when the key is present (even if its
    value is null) else the context user; thread: non-empty custom thread_id,
    else the conversation id, else a new id (a deterministic hash here);
    session: conversation id, else the custom session_id."""
    ci = F.col("custom_inputs")
    user = F.when(F.map_contains_key(ci, "user_id"), ci["user_id"]).otherwise(F.col("context_user_id"))
    thread = F.coalesce(F.nullif(ci["thread_id"], F.lit("")), F.nullif(F.col("conversation_id"), F.lit("")),
                        F.concat(F.lit("thread-"), F.substring(F.sha2(F.col("request_id").cast("string"), 256), 1, 16)))
    session = F.coalesce(F.nullif(F.col("conversation_id"), F.lit("")), ci["session_id"])
    return requests.select("request_id", user.alias("user_id"), thread.alias("thread_id"), session.alias("session_id"))


def namespace(df: DataFrame, kind: str, user_col: str = "user_id") -> DataFrame:
    """(kind, user with '.' -> '-'); ``n_raw_ids`` > 1 flags users whose
    namespaces collide (a.b and a-b)."""
    ns = df.select(F.col(user_col).alias("raw_user")).distinct().select(
        "raw_user", F.lit(kind).alias("ns_kind"), F.replace(F.col("raw_user"), F.lit("."), F.lit("-")).alias("ns_user"))
    w = Window.partitionBy("ns_kind", "ns_user")
    return ns.withColumn("n_raw_ids", F.count(F.lit(1)).over(w)).withColumn("collides", F.col("n_raw_ids") > 1)


def put_status(value: Column) -> Column:
    """null when ``value`` is a JSON object, else the rejection reason."""
    v = F.try_parse_json(value)
    return (F.when(v.isNull(), F.lit("invalid json"))
            .when(~F.schema_of_variant(v).startswith("OBJECT"), F.lit("not an object")))


def put(log: DataFrame) -> DataFrame:
    """Current store: per key, the latest accepted operation (a put of a JSON
    object, or a delete) wins; rejected puts change nothing."""
    ok = log.filter(F.col("is_delete") | put_status(F.col("value")).isNull())
    g = ok.groupBy(*KEYS).agg(last_write("value"), last_write("is_delete"), F.max("seq").alias("seq"))
    return g.filter(~F.col("is_delete")).drop("is_delete")


def rejected(log: DataFrame) -> DataFrame:
    st = put_status(F.col("value"))
    return log.filter(~F.col("is_delete") & st.isNotNull()).select(*KEYS, "seq", st.alias("reason"))


def delete(log: DataFrame) -> DataFrame:
    """Keys removed by a delete: the latest accepted op is a delete and an
    accepted put came before it."""
    ok = log.filter(F.col("is_delete") | put_status(F.col("value")).isNull())
    g = ok.groupBy(*KEYS).agg(
        F.max_by("is_delete", "seq").alias("last_is_delete"), F.max("seq").alias("deleted_seq"),
        F.min(F.when(~F.col("is_delete"), F.col("seq"))).alias("first_put"))
    return g.filter(F.col("last_is_delete") & F.col("first_put").isNotNull()).select(*KEYS, "deleted_seq")


def iso_ts(ts: Column) -> Column:
    """Python datetime.isoformat(): microseconds only when non-zero."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def _with_fields(value: Column, thread: Column, stamp: Column) -> Column:
    """The JSON object with thread_id and timestamp set: parsed, stored keys
    of these names replaced, written again (values escaped)."""
    kept = F.map_filter(F.from_json(value, "map<string,variant>"), lambda k, _v: ~k.isin("thread_id", "timestamp"))
    own = F.create_map(F.lit("thread_id"), thread.cast("variant"), F.lit("timestamp"), stamp.cast("variant"))
    return F.to_json(F.map_concat(kept, own))


def put_task(events: DataFrame) -> DataFrame:
    """Task summaries are appended under key thread + '_' + timestamp, with
    thread_id and timestamp set in the JSON object; anything but an object is
    rejected (see ``rejected_saves``)."""
    stamp = iso_ts(F.col("ts"))
    return events.filter(put_status(F.col("value")).isNull()).select(
        F.lit("task_summaries").alias("ns_kind"), "ns_user",
        F.concat(F.col("thread_id"), F.lit("_"), stamp).alias("mem_key"),
        _with_fields(F.col("value"), F.col("thread_id"), stamp).alias("value"))


def put_conversation(events: DataFrame) -> DataFrame:
    """Conversation summaries are keyed by thread: the latest accepted save
    wins; anything but a JSON object is rejected."""
    stamp = iso_ts(F.col("ts"))
    rows = events.filter(put_status(F.col("value")).isNull()).select(
        "ns_user", "thread_id", "ts", _with_fields(F.col("value"), F.col("thread_id"), stamp).alias("value"))
    return rows.groupBy("ns_user", "thread_id").agg(F.max_by("value", "ts").alias("value")).select(
        F.lit("conversation_summaries").alias("ns_kind"), "ns_user", F.col("thread_id").alias("mem_key"), "value")


def rejected_saves(events: DataFrame) -> DataFrame:
    """Task or conversation saves that were not stored, with the reason."""
    reason = put_status(F.col("value"))
    return events.filter(reason.isNotNull()).select("ns_user", "thread_id", "ts", reason.alias("reason"))


def search(store: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Top-k items by cosine similarity inside the query's namespace: blocks
    of its items against blocks of its queries, a matrix product each
    (functions/vectors.py), so a hot namespace is many blocks."""
    return top_matches(store, queries, k, id_col="mem_key", within=["ns_kind", "ns_user"], carry=["value"])


# fixed texts of the search tools: (found, nothing found)
RENDERED = {"user_memories": ("relevant memories", "No relevant memories found."),
            "task_summaries": ("past tasks", "No past tasks found."),
            "conversation_summaries": ("past conversations", "No past conversations found.")}


def render(hits: DataFrame, queries: DataFrame, kind: str) -> DataFrame:
    """The text a search tool returns for every query (at most k lines each),
    also for queries without hits."""
    v = F.col("value")
    head, none = RENDERED[kind]
    when = F.coalesce(F.get_json_object(v, "$.timestamp"), F.lit("unknown"))
    summary = F.coalesce(F.get_json_object(v, "$.summary"), F.lit(""))
    if kind == "user_memories":
        line = F.concat(F.lit("- ["), F.col("mem_key").cast("string"), F.lit("]: "), v)
    elif kind == "task_summaries":
        line = F.concat(F.lit("- ["), when, F.lit("] **"),
                        F.coalesce(F.get_json_object(v, "$.title"), F.lit("Untitled")), F.lit("**: "), summary)
    else:
        topics = F.from_json(F.get_json_object(v, "$.topics"), "array<string>")
        line = F.concat(F.lit("- ["), when, F.lit("] Topics: "),
                        F.when(F.size(F.coalesce(topics, F.array())) > 0, F.array_join(topics, ", ")).otherwise(F.lit("N/A")),
                        F.lit(" — "), summary)
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    text = F.concat(F.lit("Found "), F.size("l").cast("string"), F.lit(f" {head}:\n"),
                    F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return queries.select("query_id").join(g, "query_id", "left").select(
        "query_id", F.when(F.col("l").isNull(), F.lit(none)).otherwise(text).alias("text"))


def latest_checkpoint(ckpts: DataFrame) -> DataFrame:
    """Newest snapshot per thread (max_by is a partial aggregate)."""
    return ckpts.groupBy("thread_id").agg(F.max("step").alias("step"),
                                          F.max_by(F.struct("n_messages", "last_role"), "step").alias("s")) \
        .select("thread_id", "step", "s.n_messages", "s.last_role")


def merge_messages(log: DataFrame) -> DataFrame:
    """Message-list reducer: a new id is appended, a known id is replaced in
    place (keeps its first position, takes the last value)."""
    g = log.groupBy("chat_id", "id").agg(F.min(F.struct("seq", "created_at")).alias("first"), last_write("text"))
    g = g.select("chat_id", "id", "text", F.col("first.seq").alias("s0"), F.col("first.created_at").alias("c0"))
    r = rank_within(g, ["chat_id"], [F.col("s0"), F.col("c0"), F.col("id")],
                    [F.col("s0"), *time_blocks(F.col("c0"))], out="position")
    return r.select("chat_id", "id", "position", "text")


def broken_threads(calls: DataFrame, results: DataFrame, ckpts: DataFrame) -> DataFrame:
    """Threads with a tool call that has no tool result; their checkpoints
    are purged (left_anti) and the surviving checkpoints returned."""
    broken = calls.join(results, ["thread_id", "tool_call_id"], "left_anti").select("thread_id").distinct()
    return ckpts.join(broken, "thread_id", "left_anti")
