"""Hand-made fixtures for rules that are easy to get wrong."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartlake.operators import chat as C
from cartlake.operators import evaluate as E
from cartlake.operators import memory as M
from cartlake.operators import retail as R
from cartlake.plans.numbering import offsets
from cartlake.sources.chatdata import PART_FIELDS
from cartlake.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)


def _parts(spark, rows):
    return spark.createDataFrame(rows, f"id long, parts array<struct<{PART_FIELDS.replace(' string', ':string').replace(' boolean', ':boolean').replace(', ', ',')}>>")


def P(type_, text=None, url=None, title=None, state=None, approved=None, tool=None, media=None):
    return (type_, text, url, title, state, approved, tool, media)


def test_upsert_keeps_first_role_and_clears_trace(spark):
    log = spark.createDataFrame([
        (1, 10, 1, "assistant", "hello", T0, "tr-1", [P("text", "a"), P("file", url="u")], ["u"]),
        (2, 10, 1, "user", "hello again", T0 + dt.timedelta(days=1), None, [P("text", "b")], [])],
        "seq int, id long, chat_id long, role string, text string, created_at timestamp_ntz, trace_id string, "
        f"parts array<struct<{PART_FIELDS.replace(' string', ':string').replace(' boolean', ':boolean').replace(', ', ',')}>>, attachments array<string>")
    r = C.upsert_messages(log).first()
    assert (r.role, r.created_at, r.text, r.trace_id) == ("assistant", T0, "hello again", None)
    assert [p.text for p in r.parts] == ["b"] and r.attachments == []


def test_insert_after_delete_revives_the_chat(spark):
    schema = "seq int, op string, id long, user_id long, title string, visibility string, last_context string, created_at timestamp_ntz"
    log = spark.createDataFrame([(1, "insert", 1, 7, None, "private", None, T0), (5, "delete", 1, None, None, None, None, None)], schema)
    again = spark.createDataFrame([(6, 1, 7, "public", None)], "seq int, id long, user_id long, visibility string, created_at timestamp_ntz")
    assert C.compact_chats(log).count() == 0
    r = C.compact_chats(C.insert_chat(log, again, F.lit(T0).cast("timestamp_ntz"))).first()
    assert (r.id, r.visibility, r.created_at) == (1, "public", T0)


def test_saves_are_merged_as_json(spark):
    rows = [("u", "t1", T0, '{}'), ("u", 'q"t', T0, '{"thread_id": "old", "a": [1]}'), ("u", "t3", T0, "[1]"), ("u", "t4", T0, "{")]
    saves = spark.createDataFrame(rows, "ns_user string, thread_id string, ts timestamp_ntz, value string")
    got = {r.mem_key: json.loads(r.value) for r in M.put_task(saves).collect()}
    stamp = T0.isoformat()
    assert got == {f"t1_{stamp}": {"thread_id": "t1", "timestamp": stamp},
                   f'q"t_{stamp}': {"a": [1], "thread_id": 'q"t', "timestamp": stamp}}
    assert sorted((r.thread_id, r.reason) for r in M.rejected_saves(saves).collect()) == [("t3", "not an object"), ("t4", "invalid json")]


def test_missing_chat_is_not_writable(spark):
    chats = spark.createDataFrame([(1, 7, "private")], "id long, user_id long, visibility string")
    asked = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "chat_id long, user_id long")
    got = {(r.chat_id, r.user_id): (r.reason, r.can_write) for r in C.acl(chats, asked).collect()}
    assert got == {(1, 7): ("owner", True), (1, 8): ("forbidden", False), (2, 7): ("not_found", False)}


def test_cursor_strict_compare_skips_equal_timestamps(spark):
    chats = spark.createDataFrame([(1, 7, T0), (2, 7, T0), (3, 7, T0 + dt.timedelta(hours=1)), (4, 7, T0 - dt.timedelta(hours=1))],
                                  "id long, user_id long, created_at timestamp_ntz")
    cur = spark.createDataFrame([(7, 1)], "user_id long, cursor_id long")
    before = sorted(r.id for r in C.history_before(chats, cur, 10).collect())
    after = sorted(r.id for r in C.history_after(chats, cur, 10).collect())
    assert before == [4] and after == [3]


def test_history_page_has_more(spark):
    chats = spark.createDataFrame([(i, 1, T0 + dt.timedelta(minutes=i)) for i in range(5)], "id long, user_id long, created_at timestamp_ntz")
    page = C.history_page(chats, 3).orderBy("rank").collect()
    assert [r.id for r in page] == [4, 3, 2] and all(r.has_more for r in page)
    assert not any(r.has_more for r in C.history_page(chats, 5).collect())


def test_delete_chat_cascades_votes(spark):
    chats = spark.createDataFrame([(1,), (2,)], "id long")
    msgs = spark.createDataFrame([(10, 1), (20, 2)], "id long, chat_id long")
    votes = spark.createDataFrame([(1, 10, True), (2, 20, False)], "chat_id long, message_id long, is_up boolean")
    left = {(r.kind, r.row_id) for r in C.delete_chat(chats, msgs, votes, spark.createDataFrame([(1,)], "id long")).collect()}
    assert left == {("chat", 2), ("message", 20), ("vote", 20)}


def test_visibility_rejects_invalid_and_delete_removes(spark):
    log = spark.createDataFrame([
        (1, "insert", 1, 5, None, "private", None, T0), (2, "visibility", 1, None, None, "secret", None, None),
        (3, "visibility", 1, None, None, "public", None, None), (1, "insert", 2, 5, None, "private", None, T0),
        (4, "delete", 2, None, None, None, None, None)],
        "seq int, op string, id long, user_id long, title string, visibility string, last_context string, created_at timestamp_ntz")
    rows = {r.id: r.visibility for r in C.set_visibility(log).collect()}
    assert rows == {1: "public"}


def test_namespace_collision(spark):
    df = spark.createDataFrame([("a.b",), ("a-b",), ("c",)], "user_id string")
    r = {x.raw_user: (x.ns_user, x.collides) for x in M.namespace(df, "user_memories").collect()}
    assert r == {"a.b": ("a-b", True), "a-b": ("a-b", True), "c": ("c", False)}


def test_mem_put_rejects_non_objects_and_latest_wins(spark):
    log = spark.createDataFrame([(1, "k", "u", "m", '{"a": 1}', False), (2, "k", "u", "m", "[1, 2]", False),
                                 (3, "k", "u", "m", "not json", False), (4, "k", "u", "n", '{"b": 2}', False),
                                 (5, "k", "u", "n", None, True)],
                                "seq long, ns_kind string, ns_user string, mem_key string, value string, is_delete boolean")
    assert [(r.mem_key, r.value) for r in M.put(log).collect()] == [("m", '{"a": 1}')]
    assert {r.seq: r.reason for r in M.rejected(log).collect()} == {2: "not an object", 3: "invalid json"}
    assert [r.mem_key for r in M.delete(log).collect()] == ["n"]


def test_segments_and_citations(spark):
    parts = [P("text", "a"), P("text", "b"), P("source-url", url="u1", title="T1"), P("source-url", url="u2"),
             P("text", "<name>x</name>"), P("text", "| cell |"), P("source-url", url="u3", title="")]
    df = _parts(spark, [(1, parts)])
    segs = [r.segment for r in C.part_segments(df).orderBy("pos").collect()]
    assert segs == [0, 0, 0, 0, 1, 2, 2]
    md = [r.markdown for r in C.join_citations(df).orderBy("segment").collect()]
    assert md == ["ab [T1](u1::citation) [u2](u2::citation)", "<name>x</name>",
                  "| cell  [u3](u3::citation)|"]


def test_feedback_supported_three_states(spark):
    df = _parts(spark, [(1, [P("text", "x")]), (2, [P("text", "x"), P("data-traceId", None)]),
                        (3, [P("data-traceId", "tr")])])
    assert {r.message_id: r.feedback_supported for r in C.feedback_supported(df).collect()} == {1: True, 2: False, 3: True}


def test_mcp_denied(spark):
    df = _parts(spark, [(1, [P("dynamic-tool", state="output-denied")]), (2, [P("dynamic-tool", state="x", approved=False)]),
                        (3, [P("dynamic-tool", state="output-available", approved=True)]), (4, [])])
    assert {r.message_id: r.denied for r in C.mcp_denied(df).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_credential_errors(spark):
    msg = ("Error: credential for user identity(abc) is NOT found for the connection 'github_conn'. "
           "Please login first to the connection by visiting https://login.example/x?y=1 now")
    df = spark.createDataFrame([(msg,), ("nothing here",)], "t string")
    rows = C.credential_errors(df, "t").collect()
    assert (rows[0].is_credential_error, rows[0].login_url, rows[0].connection_name) == (True, "https://login.example/x?y=1", "github_conn")
    assert (rows[1].is_credential_error, rows[1].login_url, rows[1].connection_name) == (False, None, None)


def test_title_fallback_and_sanitize(spark):
    df = spark.createDataFrame([("word " * 40,), ("x" * 200,), (" " + "y" * 200,), ("short",)], "text string")
    got = [r.title for r in C.title_fallback(df, "text", 128).collect()]
    assert got[0] == ("word " * 40)[:128].rsplit(" ", 1)[0] and got[1] == "x" * 128
    assert got[2] == (" " + "y" * 200)[:128] and got[3] == "short"
    s = spark.createDataFrame([("a<has_function_call>b<has_function_call>c",)], "t string")
    assert C.sanitize(s, "t").first().t == "ab<has_function_call>c"


def test_tool_routing_outcomes(spark):
    spans = spark.createDataFrame([("t1", "search_task_history", "TOOL"), ("t2", "sql_query", "TOOL"),
                                   ("t3", "chat_model", "LLM"), ("t4", "calculator", "TOOL")],
                                  "trace_id string, name string, span_type string")
    rows = spark.createDataFrame([("r1", "t1"), ("r2", "t2"), ("r3", "t3"), ("r4", "t4"), ("r5", "nope")], "row_id string, trace_id string")
    got = {r.row_id: r.value for r in E.tool_routing(rows, spans).collect()}
    assert got == {"r1": "yes", "r2": "yes", "r3": "no_tools", "r4": "no", "r5": "unknown"}


def test_tone_and_specificity_arithmetic(spark):
    df = spark.createDataFrame([("申し訳ございません。手順をご案内します。ありがとうございます。対応できません。",),
                                ("48時間以内にどうぞ",), (None,), ("gold and platinum and bronze and 7日",)], "answer string")
    r = df.select(E.tone(F.col("answer")).alias("t"), E.policy_specificity(F.col("answer")).alias("s")).collect()
    assert r[0].t == 0.5
    assert abs(r[1].s - 2 / 3) < 1e-12          # listed twice, counts twice
    assert r[2].t == 0.0 and r[2].s == 0.0
    assert r[3].s == 1.0


def test_stream_outcomes(spark):
    ch = spark.createDataFrame([(1, 0, "error"), (1, 1, "text-start"), (2, 0, "text-start"), (2, 1, "error"),
                                (3, 0, "text-start"), (3, 1, "text-delta")], "stream_id long, seq long, type string") \
        .withColumn("ts", F.lit(T0).cast("timestamp_ntz"))
    assert {r.stream_id: r.outcome for r in S.outcome(ch).collect()} == {1: "failed", 2: "partial", 3: "ok"}


def test_broken_thread_purged(spark):
    calls = spark.createDataFrame([(1, "c1"), (2, "c2")], "thread_id long, tool_call_id string")
    results = spark.createDataFrame([(1, "c1")], "thread_id long, tool_call_id string")
    ck = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "thread_id long, step long")
    assert sorted(r.thread_id for r in M.broken_threads(calls, results, ck).collect()) == [1, 3]


def test_ref_integrity_finds_orphans(spark):
    cust = spark.createDataFrame([(1,)], "customer_id long")
    prod = spark.createDataFrame([(10,)], "product_id long")
    txns = spark.createDataFrame([(100, 1), (101, 2)], "transaction_id long, customer_id long")
    items = spark.createDataFrame([(100, 10), (999, 10), (100, 11)], "transaction_id long, product_id long")
    pays = spark.createDataFrame([(1,), (3,)], "customer_id long")
    got = sorted((r.check, r.row_id) for r in R.ref_integrity(cust, prod, txns, items, pays).collect())
    assert got == [("item_without_product", "11"), ("item_without_transaction", "999"),
                   ("payment_without_customer", "3"), ("transaction_without_customer", "101")]


def test_blocked_offsets_equal_window(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", "b"]), rnd.randint(0, 20), i, rnd.randint(0, 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, id long, c long")
    got = offsets(df.withColumn("one", F.lit(1)), {"c": "off", "one": "rank0"}, [F.col("v"), F.col("id")],
                  [F.shiftright("v", 2), F.col("v"), F.floor(F.col("id") / 7)], ["g"])
    w = Window.partitionBy("g").orderBy("v", "id")
    exp = df.withColumn("off", F.sum("c").over(w) - F.col("c")).withColumn("rank0", F.row_number().over(w) - 1)
    assert sorted(got.select("id", "off", "rank0").collect()) == sorted(exp.select("id", "off", "rank0").collect())


def test_out_of_stock_alternatives_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["hot"] * 5 + ["x", "y"]), float(rnd.randint(100, 130)), rnd.choice([0, 0, 3, 9])) for i in range(400)]
    prods = spark.createDataFrame(rows, "product_id long, category string, price double, stock_quantity int")
    got = sorted((r.product_id, r.alt_rank, r.alt_product_id) for r in R.out_of_stock_alternatives(prods, 3).collect())
    exp = []
    for pid, cat, price, st in rows:
        if st > 0:
            continue
        cands = sorted([(p2, i2) for i2, c2, p2, s2 in rows if c2 == cat and s2 > 0 and p2 <= price], reverse=True)[:3]
        exp += [(pid, k + 1, i2) for k, (_, i2) in enumerate(cands)]
    assert got == sorted(exp)


def test_history_pages_hot_user_equals_window(spark):
    rnd = random.Random(11)
    rows = [(i, 1 if rnd.random() < 0.6 else rnd.randint(2, 5), T0 + dt.timedelta(seconds=rnd.randint(0, 50)))
            for i in range(2000)]
    chats = spark.createDataFrame(rows, "id long, user_id long, created_at timestamp_ntz")
    got = {(r.id, r.page) for r in C.history_pages(chats, 20).collect()}
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    exp = {(r.id, r.page) for r in chats.select("id", F.floor((F.row_number().over(w) - 1) / 20).alias("page")).collect()}
    assert got == exp


def test_points_expiry_blocked_equals_model(spark):
    from cartlake.operators import policy as P
    rnd = random.Random(2)
    rows, t = [], dt.datetime(2010, 1, 1)
    for i in range(600):
        t += dt.timedelta(minutes=rnd.choice([5, 20, 90, 60 * 24 * 40, 60 * 24 * 400]))
        rows.append((i, 1 if i % 3 else 2, t, float(rnd.randint(1, 9))))
    pts = spark.createDataFrame(rows, "transaction_id long, customer_id long, transaction_date timestamp_ntz, points double")
    cust = spark.createDataFrame([(1, "Gold"), (2, "Platinum")], "customer_id long, membership_tier string")
    got = sorted((r.customer_id, r.island, r.points) for r in P.points_expiry(pts, cust).collect())
    exp = []
    for c, tier in ((1, "Gold"), (2, "Platinum")):
        mine = sorted((r[2], r[0], r[3]) for r in rows if r[1] == c)
        island, prev, acc = 0, None, {}
        for ts, _, p in mine:
            if prev is not None and tier != "Platinum":
                y, m = prev.year + (prev.month - 1 + 12) // 12, (prev.month - 1 + 12) % 12 + 1
                if ts > prev.replace(year=y, month=m):
                    island += 1
            acc[island] = acc.get(island, 0.0) + p
            prev = ts
        exp += [(c, k, v) for k, v in acc.items()]
    assert got == sorted(exp)


def test_nothing_found_is_said(spark):
    hits = spark.createDataFrame([(1, 1, 7, '{"a": 1}')], "query_id long, rank long, mem_key long, value string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r.query_id: r.text for r in M.render(hits, asked, "user_memories").collect()}
    assert got == {1: 'Found 1 relevant memories:\n- [7]: {"a": 1}', 2: "No relevant memories found."}


def test_resume_decisions(spark):
    rows = [(1, True, True, False, None, 0, None), (2, False, True, False, "text-delta", 0, None),
            (3, False, True, False, "text-delta", 3, None), (4, False, False, False, "finish", 0, None),
            (5, False, False, False, None, 0, None), (6, False, True, False, "error", 0,
             "Credential for user identity(u) is not found for the connection 'x'")]
    ends = spark.createDataFrame(rows, "stream_id long, is_abort boolean, is_disconnect boolean, is_error boolean, "
                                       "last_part string, attempts int, error_text string")
    assert {r.stream_id: r.decision for r in S.resume_decision(ends).collect()} == {
        1: "no_abort", 2: "resume", 3: "give_up", 4: "done", 5: "resume", 6: "no_credential"}


def _rows_meet_rules_in_place(df):
    """The rules are broadcast; no sort merge join brings the rows of a rule's key together."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_retention_rows_are_not_dealt_by_data_type(spark):
    from cartlake.operators import policy as P
    from cartlake.sources.tables import ts_ntz
    rows = spark.sql("SELECT t AS data_type, CAST(c AS TIMESTAMP_NTZ) AS created_at FROM VALUES ('delivery', '2025-06-29'), "
                     "('delivery', '2025-06-30'), ('points', '1990-01-01'), ('other', '1990-01-01'), ('delivery', NULL) v(t, c)")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # the few rows here stand for many
    try:
        got = P.retention_expired(rows, P.rules(spark, "RETENTION"), ts_ntz("2026-06-30 00:00:00"))
        assert _rows_meet_rules_in_place(got)
        assert sorted(map(tuple, got.collect())) == [("delivery", 3, 1), ("points", 1, 0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_points_are_not_dealt_by_tier(spark):
    from cartlake.operators import policy as P
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        txns = spark.sql("SELECT id AS transaction_id, id % 3 AS customer_id, TIMESTAMP_NTZ '2024-01-01' AS transaction_date, "
                         "250.0D AS total_amount FROM range(6)")
        cust = spark.sql("SELECT * FROM VALUES (0L, 'Gold'), (1L, 'Bronze'), (2L, NULL) v(customer_id, membership_tier)")
        got = P.points_earned(txns, cust, P.rules(spark, "TIER_RULES"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(membership_tier" not in plan and plan.count("SortMergeJoin") == 1
        assert sorted(r.points for r in got.collect()) == [2.0, 2.0, 4.0, 4.0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_price_protection_lists_sale_days_once_a_span(spark):
    """Rows against all pairs, and rows dealt out: a sale day goes to two spans at most, not to eight days."""
    import random
    from datetime import datetime, timedelta
    from cartlake.operators import policy as P
    rnd = random.Random(5)
    day = lambda: datetime(1969, 11, 1) + timedelta(days=rnd.randrange(120), hours=rnd.randrange(24))
    bought = [(f"p{i}", i % 3, float(rnd.randrange(1, 4)), float(rnd.randrange(50, 99)), day()) for i in range(200)]
    sold = [(rnd.randrange(4), day(), float(rnd.randrange(40, 99)) if i % 9 else None) for i in range(300)] + [(0, None, 1.0), (None, day(), 1.0)]
    want = set()
    for i, product, n, price, at in bought:
        low = min((x for q, s, x in sold if q == product and s and x and 0 <= (s.date() - at.date()).days <= 7), default=price)
        if low < price:
            want.add((i, product, price, low, (price - low) * n))
    b = spark.createDataFrame(bought, "purchase_id string, product_id int, quantity double, price double, purchased_at timestamp_ntz")
    s = spark.createDataFrame(sold, "product_id int, sold_at timestamp_ntz, price double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = P.price_protection(b, s)
        assert {tuple(r) for r in got.collect()} == want
        todo, dealt = [got._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange":
                dealt += node.metrics().apply("shuffleRecordsWritten").value()
        assert 0 < dealt <= len(bought) + 3 * len(sold)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
