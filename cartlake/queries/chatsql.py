"""DuckDB versions of the chat-shaped views (same rules as sources/chatdata.py)."""

from __future__ import annotations

from .views import ADAPTERS


def _part_sql(role: str = "role", line: str = "line", i: str = "(i - 1)") -> str:
    n = f"length({line})"
    w1, w2 = f"split_part({line}, ' ', 1)", f"split_part({line}, ' ', 2)"
    src = f"({role} = 'assistant' AND {i} % 4 = 2)"
    tool = f"({role} = 'assistant' AND {i} % 4 = 3)"
    err = f"({role} = 'assistant' AND {i} % 4 = 1 AND {n} % 7 = 0)"
    file = f"({role} = 'user' AND {i} % 3 = 2)"
    name = f"({role} = 'system' AND {i} = 0)"
    errtext = (f"CASE WHEN {n} % 2 = 0 THEN concat('Credential for user identity(', {w1}, ') is not found for the connection ''', "
               f"{w2}, '''. Please login first to the connection by visiting https://login.local/', substr(md5({line}), 1, 6)) "
               f"ELSE concat('Upstream error: ', {w1}) END")
    return ("{" + f"""'type': CASE WHEN {src} THEN 'source-url' WHEN {tool} THEN 'dynamic-tool' WHEN {err} THEN 'data-error'
      WHEN {file} THEN 'file' ELSE 'text' END,
    'text': CASE WHEN {name} THEN concat('<name>', {w1}, '</name>') WHEN {err} THEN {errtext}
      WHEN NOT ({src} OR {tool} OR {file}) THEN {line} END,
    'url': CASE WHEN {src} THEN concat('https://kb.local/', substr(md5({line}), 1, 8))
      WHEN {file} THEN concat('https://files.local/', substr(md5({line}), 1, 8)) END,
    'title': CASE WHEN {src} AND {n} % 2 = 1 THEN {w1} WHEN {file} THEN {w1} END,
    'state': CASE WHEN {tool} THEN CASE WHEN {n} % 5 = 0 THEN 'output-denied' WHEN {n} % 5 = 1 THEN 'approval-responded'
      ELSE 'output-available' END END,
    'approved': CASE WHEN {tool} AND {n} % 5 = 1 THEN {n} % 2 = 0 END,
    'tool_name': CASE WHEN {tool} THEN concat('tool_', CAST({n} % 3 AS VARCHAR)) END,
    'media_type': CASE WHEN {file} THEN CASE WHEN {n} % 3 = 0 THEN 'image/png' WHEN {n} % 3 = 1 THEN 'image/jpeg'
      ELSE 'application/pdf' END END""" + "}")


TRACE = "CASE WHEN turn % 3 = 2 THEN NULL ELSE concat('tr-', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) END"
TS = "TIMESTAMP '2024-01-01 00:00:00' + CAST(conv_id % 3650 AS INT) * INTERVAL '1' DAY + CAST(turn AS INT) * INTERVAL '1' MINUTE"
TRACE_PART = ("{'type': 'data-traceId', 'text': " + TRACE + ", 'url': NULL::VARCHAR, 'title': NULL::VARCHAR, "
              "'state': NULL::VARCHAR, 'approved': NULL::BOOLEAN, 'tool_name': NULL::VARCHAR, 'media_type': NULL::VARCHAR}")


def _truncate_sql(c: str, n: int) -> str:
    sl = f"substr({c}, 1, {n})"
    p = f"strpos(reverse({sl}), ' ')"
    last = f"(length({sl}) - {p} + 1)"
    return (f"CASE WHEN length({c}) <= {n} THEN {c} WHEN {p} > 0 AND {last} > 1 THEN substr({sl}, 1, {last} - 1) "
            f"ELSE {sl} END")


ADAPTERS.update({
    "message_parts": f"""SELECT conv_id * 1048576 + turn AS id, conv_id AS chat_id, role, text,
  CASE WHEN role = 'assistant' AND turn % 3 <> 1
       THEN list_concat(list_transform(string_split(text, chr(10)), lambda line, i: {_part_sql()}), [{TRACE_PART}])
       ELSE list_transform(string_split(text, chr(10)), lambda line, i: {_part_sql()}) END AS parts,
  {TS} AS created_at, {TRACE} AS trace_id
FROM conversations""",
    "chat_log": f"""SELECT 1 AS seq, 'insert' AS op, id, user_id, NULL::VARCHAR AS title, visibility, NULL::VARCHAR AS last_context, created_at FROM chat
UNION ALL SELECT 2, 'title', conv_id, NULL, {_truncate_sql('text', 128)}, NULL, NULL, NULL FROM conversations WHERE turn = 0
UNION ALL SELECT 3, 'visibility', id, NULL, NULL, CASE WHEN id % 15 = 0 THEN 'secret' WHEN visibility = 'public' THEN 'private' ELSE 'public' END, NULL, NULL
  FROM chat WHERE id % 5 = 0
UNION ALL SELECT 4, 'context', id, NULL, NULL, NULL, concat('{{"inputTokens":', CAST((id * 7) % 1000 AS VARCHAR), ',"outputTokens":',
  CAST((id * 13) % 1000 AS VARCHAR), '}}'), NULL FROM chat WHERE id % 2 = 0
UNION ALL SELECT 5, 'delete', id, NULL, NULL, NULL, NULL, NULL FROM chat WHERE visibility = 'public' AND id % 9 = 0""",
    "message_log": f"""SELECT 1 AS seq, id, chat_id, role, text, created_at, trace_id, parts,
  list_transform(list_filter(parts, lambda p: p.type = 'file'), lambda p: p.url) AS attachments FROM message_parts
UNION ALL SELECT 2, id, chat_id, 'user', concat(text, ' (edited)'), created_at + INTERVAL '1' DAY, NULL, parts[1:1], []::VARCHAR[]
FROM message_parts WHERE role = 'assistant' AND chat_id % 5 = 0""",
    "votes": "SELECT chat_id, message_id, arg_max_null(is_up, seq) AS is_up FROM vote_log GROUP BY ALL",
    "requests": """SELECT id AS chat_id, id // 10 + CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS user_id FROM chat
UNION ALL SELECT -1 - id, id // 10 FROM chat WHERE id % 4 = 1""",
})

TRUNCATE_SQL = _truncate_sql


def parts_text(parts: str = "parts") -> str:
    """All fields of all parts as one text (see queries/chat.py parts_text)."""
    fields = " || '|' || ".join(f"coalesce(CAST(p.{f} AS VARCHAR), '')" for f in
                                ("type", "text", "url", "title", "state", "approved", "tool_name", "media_type"))
    return f"coalesce(array_to_string(list_transform({parts}, lambda p: {fields}), chr(30)), '')"
