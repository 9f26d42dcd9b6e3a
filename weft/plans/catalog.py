"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import display_path, preview
from weft.functions.times import clock_millis
from weft.operators import files, insights, postings, search, sessions
from weft.operators import turns as turn_reads
from weft.operators.paging import keyset
from weft.plans import standins as S
from weft.runtime import materialize, scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


TOTALS = """totals AS (SELECT project_id, provider, session_id, count(*) AS turn_count, max(started_at) AS latest_turn_at, arg_min(started_at, turn_ordinal) AS first_turn_at,
  arg_max(status, turn_ordinal) AS latest_status, arg_min(user_message, turn_ordinal) AS first_user_prompt,
  CASE WHEN count(*) = count(total_token_count) THEN sum(total_token_count)::BIGINT END AS total_token_count,
  count(*) FILTER (status = 'aborted') AS aborted_turn_count FROM {} GROUP BY 1, 2, 3)"""
LISTED = ["project_id", "provider", "session_id", "turn_count", "latest_turn_at", "first_turn_at", "latest_status", "first_user_prompt", "total_token_count", "aborted_turn_count"]
COLUMNS = ", ".join(LISTED).replace("aborted_turn_count", "coalesce(aborted_turn_count, 0) AS aborted_turn_count")
NEWEST = "ORDER BY latest_turn_at DESC NULLS LAST, provider, session_id DESC"


# --- sessions and turns --------------------------------------------------------------------------


@query("session_list", with_(S.SQL_CHAT, TOTALS.format("chat_turns")) + f"""SELECT s.project_id, s.provider, s.session_id, coalesce(turn_count, 0) AS turn_count, latest_turn_at, first_turn_at,
  latest_status, first_user_prompt[:500] AS first_user_prompt, total_token_count, coalesce(aborted_turn_count, 0) AS aborted_turn_count
FROM chat_sessions s LEFT JOIN totals USING (project_id, provider, session_id) WHERE origin_kind = 'local' {NEWEST} LIMIT 50""")
def session_list(spark, d):
    return sessions.list_sessions(S.chat_sessions(spark, d), S.chat_turns(spark, d), limit=50).select(*LISTED)


MORE = """more AS (SELECT project_id, provider, session_id, CASE WHEN count(*) = count(output_token_count) THEN sum(output_token_count)::BIGINT END AS output_token_count,
  sum(coalesce(changed_file_count, 0))::BIGINT AS changed_file_count FROM turns GROUP BY 1, 2, 3)"""


@query("session_list_window", with_(S.SQL_SESSIONS, S.SQL_TURNS, S.SQL_USERS, TOTALS.format("turns"), MORE) + f"""SELECT {COLUMNS}, output_token_count, changed_file_count, user_name, user_email
FROM sessions JOIN totals USING (project_id, provider, session_id) JOIN more USING (project_id, provider, session_id) LEFT JOIN (SELECT user_id, display_name AS user_name, email AS user_email FROM users) u ON origin_user_id = user_id
WHERE latest_turn_at >= '1996-01-01T00:00:00Z' AND latest_turn_at < '1999-06-01T00:00:00Z' AND provider = 'codex' {NEWEST} LIMIT 500 OFFSET 20""")
def session_list_window(spark, d):
    out = sessions.list_sessions(
        S.sessions(spark, d), S.turns(spark, d), S.users(spark, d), provider="codex", since="1996-01-01T00:00:00Z", until="1999-06-01T00:00:00Z", origin="all", limit=500, offset=20
    )
    return out.select(*LISTED, "output_token_count", "changed_file_count", "user_name", "user_email")


@query("session_author", with_(S.SQL_SESSIONS, S.SQL_TURNS, S.SQL_USERS, TOTALS.format("turns")) + f"""SELECT {COLUMNS} FROM sessions
LEFT JOIN totals USING (project_id, provider, session_id) JOIN users ON origin_user_id = user_id
WHERE origin_kind = 'shared' AND email = 'c20@example.com' {NEWEST} LIMIT 100""".replace("turn_count,", "coalesce(turn_count, 0) AS turn_count,", 1))
def session_author(spark, d):
    return sessions.list_sessions(S.sessions(spark, d), S.turns(spark, d), S.users(spark, d), origin="shared", author="c20@example.com", limit=100).select(*LISTED)


TOUCHING = "SELECT " + COLUMNS.replace("turn_count,", "coalesce(turn_count, 0) AS turn_count,", 1) + """ FROM sessions LEFT JOIN totals USING (project_id, provider, session_id)
WHERE origin_kind = 'local' AND session_id IN (SELECT session_id FROM accesses WHERE {}) """ + NEWEST + " LIMIT 200"


@query("session_touching_exact", with_(S.SQL_SESSIONS, S.SQL_TURNS, S.SQL_ACCESSES, TOTALS.format("turns")) + TOUCHING.format("access_type IN ('read', 'write', 'edit') AND lower(shown) = 'src/m10/f130.rs'"))
def session_touching_exact(spark, d):
    keys = sessions.touching_exact(S.accesses(spark, d), "SRC/m10/f130.rs", S.ROOT)
    return sessions.sessions_touching(S.sessions(spark, d), S.turns(spark, d), keys, limit=200).select(*LISTED)


@query("session_touching_glob", with_(S.SQL_SESSIONS, S.SQL_TURNS, S.SQL_ACCESSES, TOTALS.format("turns")) + TOUCHING.format("regexp_full_match(lower(shown), 'docs/t3/g1[^/]*\\.md')"))
def session_touching_glob(spark, d):
    keys = sessions.touching_glob(S.accesses(spark, d), "docs/T3/G1*.md", S.ROOT, S.path_dictionary(spark, d))
    return sessions.sessions_touching(S.sessions(spark, d), S.turns(spark, d), keys, limit=200).select(*LISTED)


@query("session_edited_files", with_(S.SQL_ACCESSES) + """SELECT project_id, provider, session_id, array_to_string(list_sort(list(DISTINCT shown)), '|') AS edited_files
FROM accesses WHERE access_type IN ('write', 'edit') GROUP BY 1, 2, 3""")
def session_edited_files(spark, d):
    return sessions.edited_files(S.accesses(spark, d), S.ROOT).withColumn("edited_files", F.array_join("edited_files", "|"))


@query("resolve_prefix", with_(S.SQL_SESSIONS) + """SELECT project_id, provider, session_id, (SELECT count(*) FROM sessions WHERE session_id LIKE 'ord-12%') AS total,
  (SELECT count(*) FROM sessions WHERE session_id LIKE 'ord-12%') > 50 AS truncated FROM sessions WHERE session_id LIKE 'ord-12%' ORDER BY 1, 2, 3 LIMIT 50""")
def resolve_prefix(spark, d):
    return sessions.resolve_prefix(S.sessions(spark, d), "ORD-12")


def assembled(spark, d):
    """The tables that the assembly makes of the conversations' session files."""
    from weft.operators.assemble import all_tables

    return all_tables(S.session_files(spark, d), S.owners(spark))


REDACTED = """regexp_replace({}, '\\btoken = "[^\\s"][^"\\r\\n]{{3,}}"', 'token = "[REDACTED_SECRET]"', 'g')"""


@query("turn_sessionise", with_(S.SQL_FILES) + f"""SELECT project_id, provider, session_id, turn_ordinal, turn_id, started_at, completed_at, status, {REDACTED.format('user_message')} AS user_message,
  {REDACTED.format('final_answer_text')} AS final_answer_text, duration_ms, step_count, primary_model, input_uncached_token_count, output_token_count, input_uncached_token_count + output_token_count AS total_token_count
FROM file_turns LEFT JOIN file_spent USING (session_id, turn_ordinal)""")
def turn_sessionise(spark, d):
    keep = ["turn_id", "started_at", "completed_at", "status", "user_message", "final_answer_text", "duration_ms", "step_count", "primary_model", "input_uncached_token_count", "output_token_count", "total_token_count"]
    return assembled(spark, d)["turns"].select("project_id", "provider", "session_id", "turn_ordinal", *keep)


@query("assembled_sessions", with_(S.SQL_FILES) + """SELECT project_id, provider, session_id, CASE WHEN tail <> '' THEN 'conv-' || conv_id END AS parent_session_id, CASE WHEN tail <> '' THEN 'subagent' ELSE 'primary' END AS session_kind,
  CASE WHEN conv_id % 2 = 0 THEN 'turn_lifecycle' WHEN tail <> '' THEN 'claude.subagent_transcript.2_1_90_to_2_1_160' ELSE 'claude.primary_transcript.2_1_90_to_2_1_160' END AS schema_id, NULL AS reason FROM named
UNION ALL SELECT NULL, 'claude', 'conv-' || conv_id || '/subagents/agent-b2', NULL, NULL, NULL, 'agent id is not b2' FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 11 = 5 AND conv_id % 2 = 1""")
def assembled_sessions(spark, d):
    """Every session file: the session that it became, with kind, parent and owner, or why it was left out."""
    from weft.operators.ingest import archive_kind

    tables = assembled(spark, d)
    none = F.lit(None).cast("string")
    kept = tables["sessions"].select("project_id", "provider", "session_id", "parent_session_id", "session_kind", "schema_id", none.alias("reason"))
    left = tables["skipped"].select(none.alias("project_id"), F.regexp_extract("file", "^/a/([a-z]+)/", 1).alias("provider"), archive_kind(F.col("file"))[0].alias("session_id"), none.alias("parent_session_id"), none.alias("session_kind"), none.alias("schema_id"), "reason")
    return kept.unionByName(left)


@query("refresh_tables", with_(S.SQL_FILES) + f"""SELECT session_id, coalesce(turns, 0) AS turns, coalesce(calls, 0) AS calls, coalesce(calls, 0) AS accesses, coalesce(turns + answered + 3 * calls, 0) AS fragments
FROM named LEFT JOIN (SELECT session_id, count(*) AS turns, sum(calls)::BIGINT AS calls, count(*) FILTER (status = 'completed') AS answered FROM file_turns GROUP BY 1) USING (session_id)""")
def refresh_tables(spark, d):
    """Rows of each stored table by session, after a write and a read of all of them."""
    from weft.operators.assemble import read_table, write_tables

    root = scratch_path(spark, "tables")
    write_tables(assembled(spark, d), root)
    out = read_table(spark, root, "sessions").select("session_id")
    for name, column in (("turns", "turns"), ("tool_calls", "calls"), ("file_accesses", "accesses"), ("turn_evidence", "fragments")):
        out = out.join(read_table(spark, root, name).groupBy("session_id").agg(F.count(F.lit(1)).alias(column)), "session_id", "left").withColumn(column, F.coalesce(column, F.lit(0)))
    return out


@query("refresh_grown", with_(S.SQL_FILES) + """SELECT session_id, turn_ordinal, turn_id, started_at, completed_at, status, primary_model, step_count FROM file_turns""")
def refresh_grown(spark, d):
    """Turns after two refreshes: between them files grow, come, and go; only their sessions are built again."""
    from weft.streaming.refresh import refresh
    from weft.streaming.store import Store

    store = Store(spark, scratch_path(spark, "store"))
    for source in S.session_sources(spark, d):
        snapshot = refresh(store, source, S.owners(spark))
    return snapshot.table("turns").select("session_id", "turn_ordinal", "turn_id", "started_at", "completed_at", "status", "primary_model", "step_count")


@query("stored_by_time", with_(S.SQL_FILES) + """SELECT session_id, turn_ordinal, started_at, status FROM file_turns WHERE started_at >= '2024-01-02T00:00:00Z' AND started_at <= '2024-01-09T12:00:00Z'""")
def stored_by_time(spark, d):
    """Turns of a stored snapshot in a window of time: the index names the sessions, their buckets alone are read."""
    from weft.streaming.store import Store

    tables = assembled(spark, d)
    store = Store(spark, scratch_path(spark, "store"), bucket=1 << 18)
    turns = tables["turns"]
    size = turns.agg(F.sum(F.length("user_message") + F.length(F.coalesce("final_answer_text", F.lit(""))))).first()[0] or 0
    snapshot = store.append({"turns": turns}, None, size, {})
    return snapshot.rows_where("turns", "started_at", "2024-01-02T00:00:00Z", "2024-01-09T12:00:00Z").select("session_id", "turn_ordinal", "started_at", "status")


@query("refresh_tool_calls", with_(S.SQL_FILES) + """SELECT project_id, provider, session_id, turn_ordinal, row_number() OVER (PARTITION BY session_id, turn_ordinal ORDER BY turn) - 1 AS call_ordinal, call_id,
  'Read' AS tool_name, json_object('path', path)::VARCHAR AS arguments_text, 'ok' AS output_text, false AS is_error FROM file_calls""")
def refresh_tool_calls(spark, d):
    return assembled(spark, d)["tool_calls"].drop("timestamp", "status")


@query("refresh_file_accesses", with_(S.SQL_FILES) + "SELECT project_id, provider, session_id, turn_ordinal, call_id, 'read' AS access_type, path, path AS repo_relative_path, regexp_extract(path, '[^/]*$') AS file_name FROM file_calls")
def refresh_file_accesses(spark, d):
    return assembled(spark, d)["file_accesses"].drop("timestamp", "call_ordinal", "tool_name")


SQL_PREVIEW = """CASE WHEN length({0}) <= 500 THEN {0} ELSE {0}[:499] || '…' END"""
COLLAPSED = "trim(regexp_replace({}, '[\\s\\x0b]+', ' ', 'g'))"


@query("turn_list", with_(S.SQL_CHAT, f"c AS (SELECT *, {COLLAPSED.format('user_message')} AS u, {COLLAPSED.format('final_answer_text')} AS a FROM chat_turns)") + f"""SELECT project_id, provider, session_id, turn_ordinal,
  {SQL_PREVIEW.format('u')} AS user_prompt_preview, least(length(u), 500) AS user_prompt_preview_chars, length(u) AS user_prompt_preview_total_chars,
  {SQL_PREVIEW.format('a')} AS agent_answer_preview, final_answer_text IS NOT NULL AS has_final_answer FROM c""")
def turn_list(spark, d):
    out = turn_reads.list_turns(S.chat_turns(spark, d), limit=None)
    keep = ["user_prompt_preview", "user_prompt_preview_chars", "user_prompt_preview_total_chars", "agent_answer_preview", "has_final_answer"]
    return out.select("project_id", "provider", "session_id", "turn_ordinal", *keep)


@query("token_sum_nullpoison", with_(S.SQL_TURNS) + """SELECT project_id, provider, session_id, count(*) AS turn_count,
  CASE WHEN count(*) = count(total_token_count) THEN sum(total_token_count)::BIGINT END AS total_token_count, sum(duration_ms)::BIGINT AS effective_agent_runtime_ms FROM turns GROUP BY 1, 2, 3""")
def token_sum_nullpoison(spark, d):
    return sessions.turn_totals(S.turns(spark, d)).select("project_id", "provider", "session_id", "turn_count", "total_token_count", "effective_agent_runtime_ms")


@query("keyset_page", with_(S.SQL_TURNS) + """SELECT project_id, provider, session_id, turn_ordinal, started_at FROM turns
WHERE started_at < '1998-03-01T00:00:00Z' OR (started_at = '1998-03-01T00:00:00Z' AND (provider, session_id, turn_ordinal) > ('claude', 'ord-5', 2))
ORDER BY started_at DESC, provider, session_id, turn_ordinal LIMIT 300""")
def keyset_page(spark, d):
    after = {"started_at": "1998-03-01T00:00:00Z", "provider": "claude", "session_id": "ord-5", "turn_ordinal": 2}
    return keyset(S.turns(spark, d), after, 300).select("project_id", "provider", "session_id", "turn_ordinal", "started_at")


# --- workspace -----------------------------------------------------------------------------------


@query("project_aggregates", with_(S.SQL_SESSIONS, S.SQL_TURNS) + """SELECT project_id, session_count, coalesce(turn_count, 0) AS turn_count, last_activity_at
FROM (SELECT project_id, count(*) AS session_count FROM sessions GROUP BY 1) LEFT JOIN (SELECT project_id, count(*) AS turn_count, max(started_at) AS last_activity_at FROM turns GROUP BY 1) USING (project_id)""")
def project_aggregates(spark, d):
    return insights.project_aggregates(S.sessions(spark, d), S.turns(spark, d))


@query("workspace_projects", with_(S.SQL_SESSIONS, S.SQL_TURNS) + """SELECT 'p' || n_nationkey AS id, n_name AS name, coalesce(session_count, 0) AS session_count, coalesce(turn_count, 0) AS turn_count, last_activity_at FROM nation
LEFT JOIN (SELECT project_id, count(*) AS session_count FROM sessions GROUP BY 1) s ON s.project_id = 'p' || n_nationkey
LEFT JOIN (SELECT project_id, count(*) AS turn_count, max(started_at) AS last_activity_at FROM turns GROUP BY 1) t ON t.project_id = 'p' || n_nationkey""")
def workspace_projects(spark, d):
    config = table(spark, d, "nation").select(F.concat(F.lit("p"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return insights.workspace(config, S.sessions(spark, d), S.turns(spark, d))


WINDOWED = """w AS (SELECT *, started_at[:10]::DATE AS day FROM turns), edge AS (SELECT max(day) AS e, max(day) - 29 AS b FROM w),
inside AS (SELECT w.* FROM w, edge WHERE day BETWEEN b AND e)"""


@query("insight_workspace_daily", with_(S.SQL_TURNS, WINDOWED) + """SELECT g.date, g.project_id, coalesce(ms, 0)::BIGINT AS active_time_ms
FROM (SELECT unnest(generate_series(b, e, INTERVAL 1 DAY))::DATE AS date, project_id FROM edge, (SELECT DISTINCT project_id FROM turns)) g
LEFT JOIN (SELECT day, project_id, sum(duration_ms) AS ms FROM inside WHERE status = 'completed' AND duration_ms >= 2000 GROUP BY 1, 2) t ON g.date = t.day AND g.project_id = t.project_id""")
def insight_workspace_daily(spark, d):
    return insights.workspace_daily(S.turns(spark, d), 30)


@query("insight_workspace_recent", with_(S.SQL_TURNS, WINDOWED) + """SELECT * FROM (SELECT project_id, provider, session_id,
  coalesce(sum(duration_ms) FILTER (status = 'completed' AND duration_ms >= 2000), 0)::BIGINT AS active_time_ms,
  count(*) FILTER (status = 'completed' AND duration_ms >= 2000) AS included_turn_count,
  count(*) FILTER (NOT (status = 'completed' AND duration_ms >= 2000)) AS excluded_turn_count, max(started_at) AS latest_turn_at FROM inside GROUP BY 1, 2, 3)
WHERE active_time_ms > 0 ORDER BY latest_turn_at DESC, project_id, provider, session_id LIMIT 50""")
def insight_workspace_recent(spark, d):
    return insights.workspace_recent(S.turns(spark, d), 30)


RECENT = "recent AS (SELECT * FROM turns ORDER BY started_at DESC, provider, session_id, turn_ordinal LIMIT 1000)"
CALLS = f"calls AS (SELECT {S.sql_identity('l_orderkey', 'ord-')}, l_linenumber::BIGINT AS turn_ordinal, l_returnflag || '_' || l_linestatus AS tool_name FROM lineitem)"


@query("insight_project_tools", with_(S.SQL_TURNS, RECENT, CALLS) + """SELECT tool_name, count(*) AS call_count FROM calls SEMI JOIN recent USING (project_id, provider, session_id, turn_ordinal)
GROUP BY 1 ORDER BY call_count DESC, tool_name LIMIT 10""")
def insight_project_tools(spark, d):
    return insights.project_tools(insights.latest_turns(S.turns(spark, d)), S.calls(spark, d))


@query("insight_project_failures", with_(S.SQL_TURNS, RECENT) + """SELECT started_at[:10]::DATE AS day, count(*) AS turn_count, count(*) FILTER (status <> 'completed') AS failure_count,
  coalesce(sum(duration_ms) FILTER (status = 'completed' AND duration_ms >= 2000), 0)::BIGINT AS active_time_ms FROM recent GROUP BY 1""")
def insight_project_failures(spark, d):
    return insights.project_daily(insights.latest_turns(S.turns(spark, d)))


@query("insight_project_files", with_(S.SQL_TURNS, S.SQL_ACCESSES, RECENT) + """SELECT shown AS path, count(*) FILTER (access_type IN ('read', 'list')) AS read_count,
  count(*) FILTER (access_type IN ('write', 'edit')) AS write_count FROM accesses SEMI JOIN recent USING (project_id, provider, session_id, turn_ordinal)
GROUP BY 1 HAVING count(*) FILTER (access_type IN ('read', 'list')) > 0 ORDER BY 2 DESC, 2 + 3 DESC, count(*) DESC, path LIMIT 10""")
def insight_project_files(spark, d):
    shown = display_path(F.col("repo_relative_path"), F.col("path"), S.ROOT)
    return insights.project_files(insights.latest_turns(S.turns(spark, d)), S.accesses(spark, d).withColumn("shown", shown), written=False)


# --- files ---------------------------------------------------------------------------------------

FILE_CTES = (S.SQL_SESSIONS, S.SQL_TURNS, S.SQL_ACCESSES, S.SQL_TOUCHES)


def touched(spark, d, **more):
    return files.touches(S.accesses(spark, d), S.turns(spark, d), S.sessions(spark, d), root=S.ROOT, paths=S.path_dictionary(spark, d), **more)


@query("files_raw", with_(*FILE_CTES) + """SELECT provider, session_id, repo_relative_path, path, count(*) AS touch_count, count(*) FILTER (access_type = 'read') AS read_count,
  count(*) FILTER (access_type <> 'read') AS write_count, min(started_at) AS first_touched_at, max(started_at) AS last_touched_at,
  min(turn_ordinal) AS first_turn_ordinal, max(turn_ordinal) AS last_turn_ordinal FROM touches GROUP BY 1, 2, 3, 4""")
def files_raw(spark, d):
    return files.raw_rows(touched(spark, d))


@query("files_top", with_(*FILE_CTES) + """SELECT shown AS path, count(*) AS touch_count, count(DISTINCT session_id) AS session_count, count(*) FILTER (access_type = 'read') AS read_count,
  count(*) FILTER (access_type <> 'read') AS write_count, min(started_at) AS first_touched_at, max(started_at) AS last_touched_at
FROM touches GROUP BY 1 ORDER BY touch_count DESC, session_count DESC, last_touched_at DESC, path LIMIT 100""")
def files_top(spark, d):
    return files.top_files(touched(spark, d), limit=100)


@query("files_path_sessions", with_(*FILE_CTES) + """SELECT provider, session_id, count(*) AS touch_count, count(*) FILTER (access_type = 'read') AS read_count, count(*) FILTER (access_type <> 'read') AS write_count,
  min(started_at) AS first_touched_at, max(started_at) AS last_touched_at, min(turn_ordinal) AS first_turn_ordinal, max(turn_ordinal) AS last_turn_ordinal,
  array_to_string(list_sort(list(DISTINCT shown)), '|') AS matched_paths, count(DISTINCT shown) AS matched_paths_count, false AS matched_paths_truncated
FROM touches WHERE regexp_full_match(shown, 'src/(.*/)?f[^/]*1[^/]\\.rs') GROUP BY 1, 2 ORDER BY touch_count DESC, last_touched_at DESC, provider, session_id LIMIT 300""")
def files_path_sessions(spark, d):
    return files.path_sessions(touched(spark, d), "src/**/f*1?.rs", S.ROOT, limit=300).withColumn("matched_paths", F.array_join("matched_paths", "|"))


@query("files_cotouched", with_(*FILE_CTES) + f""", pairs AS (SELECT DISTINCT provider, session_id, coalesce(repo_relative_path, CASE WHEN path LIKE '{S.ROOT}/%' THEN path[{len(S.ROOT) + 2}:] ELSE path END) AS path FROM touches)
SELECT path, count(*) AS co_touch_count FROM pairs SEMI JOIN (SELECT provider, session_id FROM pairs WHERE lower(path) = 'src/m0/f80.rs') s USING (provider, session_id)
WHERE lower(path) <> 'src/m0/f80.rs' GROUP BY 1 ORDER BY 2 DESC, lower(path), path LIMIT 500""".replace(", pairs AS", ", pairs AS"))
def files_cotouched(spark, d):
    return files.co_touched(touched(spark, d), "SRC/M0/F80.rs", S.ROOT, limit=500)


SQL["files_cotouched"] = SQL["files_cotouched"].replace("\n, pairs AS", ", pairs AS")


@query("session_files", with_(*FILE_CTES, "mine AS (SELECT * FROM touches WHERE session_id = 'ord-42' OR session_id = 'ord-42')") + """SELECT shown AS path, count(*) FILTER (access_type = 'read') AS read_count, count(*) FILTER (access_type <> 'read') AS write_count,
  min(turn_ordinal) AS first_turn_ordinal, max(turn_ordinal) AS last_turn_ordinal, (SELECT count(DISTINCT shown) FROM mine) AS file_count FROM mine GROUP BY 1
ORDER BY count(*) DESC, 3 DESC, 2 DESC, path LIMIT 100""")
def session_files(spark, d):
    return files.session_files(touched(spark, d, origin="local"), {"session_id": "ord-42"})


# --- search --------------------------------------------------------------------------------------

EVIDENCE = "evidence AS (SELECT conv_id, turn AS evidence_ordinal, CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'final_answer' ELSE 'commentary' END AS field, text FROM conversations)"


def chat_evidence(spark, d):
    c = table(spark, d, "conversations")
    field = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "final_answer").otherwise("commentary")
    return c.select("conv_id", F.col("turn").alias("evidence_ordinal"), field.alias("field"), "text")


SQL_SNIPPET = """(CASE WHEN {at} > 80 THEN '…' ELSE '' END) || text[greatest({at} - 80, 0) + 1 : {at} + {n} + 80] || (CASE WHEN {at} + {n} + 80 < length(text) THEN '…' ELSE '' END)"""
HITS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY evidence_ordinal) AS rn FROM m)
SELECT conv_id, count(*) FILTER (rn <= 2) AS matches_count, count(*) > 2 AS matches_truncated,
  string_agg(evidence_ordinal || ':' || field || ':' || snippet, '|' ORDER BY rn) FILTER (rn <= 2) AS matches FROM ranked WHERE rn <= 3 GROUP BY 1"""


def flat_hits(matches):
    out = search.turn_hits(matches, ["conv_id"], 2)
    text = F.transform("matches", lambda m: F.concat(m["evidence_ordinal"], F.lit(":"), m["field"], F.lit(":"), m["snippet"]))
    return out.withColumn("matches", F.array_join(text, "|"))


@query("search_literal", with_(EVIDENCE, f"m AS (SELECT *, {SQL_SNIPPET.format(at='(instr(text, $$ the $$) - 1)', n=5)} AS snippet FROM evidence WHERE field IN ('user_message', 'final_answer') AND contains(text, ' the '))", HITS))
def search_literal(spark, d):
    return flat_hits(search.literal_matches(chat_evidence(spark, d), " the ", ("user_message", "final_answer")))


PATTERN = "(?:tion|ment)[a-z]*[.,]\\s"


@query("search_regex", with_(EVIDENCE, f"x AS (SELECT *, regexp_extract(text, '{PATTERN}') AS hit FROM evidence WHERE regexp_matches(text, '{PATTERN}'))", f"m AS (SELECT *, {SQL_SNIPPET.format(at='(instr(text, hit) - 1)', n='length(hit)')} AS snippet FROM x)", HITS))
def search_regex(spark, d):
    fields = search.check_arguments("regex")
    return flat_hits(search.regex_matches(chat_evidence(spark, d), PATTERN, fields))


STAGED = """staged AS (SELECT project_id, provider, session_id, turn_ordinal, path, {} AS stage FROM accesses)
SELECT project_id, provider, session_id, turn_ordinal, min(stage) AS stage, array_to_string(list_sort(list(DISTINCT path)), '|') AS matched_paths,
  count(DISTINCT path) AS matched_paths_count FROM staged WHERE stage IS NOT NULL GROUP BY 1, 2, 3, 4"""


def flat_paths(hits):
    return hits.withColumn("matched_paths", F.array_join("matched_paths", "|")).drop("matched_paths_truncated")


@query("search_filename_staged", with_(S.SQL_ACCESSES, STAGED.format("CASE WHEN lower(file_name) = 'f12' THEN 0 WHEN lower(file_name) LIKE 'f12%' THEN 1 WHEN lower(file_name) LIKE '%f12%' THEN 2 END")))
def search_filename_staged(spark, d):
    return flat_paths(search.name_search(S.accesses(spark, d), "F12"))


@query("search_path_fragment", with_(S.SQL_ACCESSES, STAGED.format("CASE WHEN lower(path) LIKE 'src/m2%' THEN 1 WHEN lower(path) LIKE '%src/m2%' THEN 2 END")))
def search_path_fragment(spark, d):
    return flat_paths(search.fragment_search(S.accesses(spark, d), "src/M2"))


@query("search_path_glob", with_(S.SQL_ACCESSES, STAGED.format("CASE WHEN regexp_full_match(lower(shown), 'src/m1[^/]/f[^/]*\\.rs') THEN 0 END")))
def search_path_glob(spark, d):
    return flat_paths(search.glob_search(S.accesses(spark, d), "src/m1?/*.rs", S.ROOT, paths=S.path_dictionary(spark, d)))


@query("search_page_glob", """SELECT page_id, url FROM pages WHERE regexp_full_match(lower(url), 'https?://[^/]*\\.com/(.*/)?[0-9][^/]*')""")
def search_page_glob(spark, d):
    from weft.functions.text import fold, glob_to_regex

    https, http = (glob_to_regex(f"{s}://*.com/**/[0-9]*") for s in ("https", "http"))
    u = fold(F.col("url"))
    return table(spark, d, "pages").filter(u.rlike(https) | u.rlike(http)).select("page_id", "url")


SQL_TERMS = r"list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
BM25 = rf"""WITH t AS (SELECT doc_id, {SQL_TERMS} AS ts FROM documents),
len AS (SELECT doc_id, len(ts) AS length FROM t WHERE len(ts) > 0), stats AS (SELECT count(*) AS rows, avg(length) AS mean FROM len),
occ AS (SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM t),
a AS (SELECT doc_id, count(*) AS tf FROM occ WHERE term = 'tion' GROUP BY 1),
b AS (SELECT x.doc_id, count(*) AS tf FROM occ x JOIN occ y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 AND x.term = 'of' AND y.term = 'the' GROUP BY 1)
SELECT a.doc_id, round(greatest(ln((rows - na + 0.5) / (na + 0.5)), 1e-6) * a.tf * 2.2 / (a.tf + 1.2 * (0.25 + 0.75 * length / mean))
  + greatest(ln((rows - nb + 0.5) / (nb + 0.5)), 1e-6) * b.tf * 2.2 / (b.tf + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score
FROM a JOIN b USING (doc_id) JOIN len USING (doc_id), stats, (SELECT count(*) AS na FROM a), (SELECT count(*) AS nb FROM b)"""


@query("search_keyword_bm25", BM25)
def search_keyword_bm25(spark, d):
    docs = table(spark, d, "documents")
    lengths = materialize(search.document_lengths(docs, ("text",), ["doc_id"]), "lengths")
    hits = search.keyword_search(search.index_terms(docs, ("text",), ["doc_id"]), lengths, "tion of-the", ["doc_id"])
    return hits.select("doc_id", F.round("score", 6).alias("score"))


PAGED = rf"""t AS (SELECT *, {SQL_TERMS.replace("text", "coalesce(user_message, '') || ' | ' || coalesce(final_answer_text, '')")} AS ts FROM chat_turns),
len AS (SELECT session_id, turn_ordinal, len(ts) AS length FROM t WHERE len(ts) > 0), stats AS (SELECT count(*) AS rows, avg(length) AS mean FROM len),
occ AS (SELECT session_id, turn_ordinal, unnest(ts) AS term FROM t), a AS (SELECT session_id, turn_ordinal, count(*) AS tf FROM occ WHERE term = 'que' GROUP BY ALL),
b AS (SELECT session_id, turn_ordinal, count(*) AS tf FROM occ WHERE term = 'en' GROUP BY ALL),
p AS (SELECT t.session_id, t.turn_ordinal, user_message, final_answer_text, round(greatest(ln((rows - na + 0.5) / (na + 0.5)), 1e-6) * a.tf * 2.2 / (a.tf + 1.2 * (0.25 + 0.75 * length / mean))
  + greatest(ln((rows - nb + 0.5) / (nb + 0.5)), 1e-6) * b.tf * 2.2 / (b.tf + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score, started_at
FROM a JOIN b USING (session_id, turn_ordinal) JOIN len USING (session_id, turn_ordinal) JOIN t USING (session_id, turn_ordinal), stats, (SELECT count(*) AS na FROM a), (SELECT count(*) AS nb FROM b)
ORDER BY score DESC, started_at DESC, provider, t.session_id, t.turn_ordinal LIMIT 50),
x AS (SELECT session_id, turn_ordinal, 0 AS c, coalesce(user_message, '') AS txt FROM p UNION ALL SELECT session_id, turn_ordinal, 1, coalesce(final_answer_text, '') FROM p),
y AS (SELECT *, regexp_extract_all(txt, '[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*') AS ps FROM x),
o AS (SELECT session_id, turn_ordinal, c, spot, word FROM (SELECT *, unnest(list_transform(ps, lambda q: strip_accents(lower(regexp_replace(q, '^[^\p{{L}}\p{{N}}]+', ''))))) AS word, generate_subscripts(ps, 1) - 1 AS spot FROM y) WHERE word IN ('que', 'en')),
w AS (SELECT session_id, turn_ordinal, c, o.spot, count(DISTINCT n.word) AS different, count(*) AS found, max(n.spot) + 1 AS past FROM o JOIN o n USING (session_id, turn_ordinal, c) WHERE n.spot BETWEEN o.spot AND o.spot + 15 GROUP BY ALL),
f AS (SELECT *, greatest(0, least(spot - ((16 - (past - spot)) // 2), len(ps) - 16)) AS low FROM w JOIN y USING (session_id, turn_ordinal, c)
  QUALIFY row_number() OVER (PARTITION BY session_id, turn_ordinal ORDER BY different DESC, found DESC, c, spot) = 1)
SELECT session_id, turn_ordinal, score, started_at,
  CASE WHEN low > 0 THEN '…' || regexp_replace(array_to_string(ps[low + 1:low + 16], ''), '^[^\p{{L}}\p{{N}}]+', '') ELSE array_to_string(ps[1:16], '') END
  || CASE WHEN low + 16 < len(ps) THEN '…' ELSE substr(txt, length(array_to_string(ps, '')) + 1) END AS snippet
FROM p JOIN f USING (session_id, turn_ordinal)"""


@query("search_keyword_page", with_(S.SQL_CHAT, PAGED))
def search_keyword_page(spark, d):
    """The best page of turns, each with its best snippet, from a stored index of which only blocks that can enter it are read."""
    turns, root = materialize(S.chat_turns(spark, d), "turns"), scratch_path(spark, "search")
    postings.write_index(turns, ("user_message", "final_answer_text"), search.TURN_KEY, root)
    hits = postings.top_hits(spark, root, "Qué EN", search.TURN_KEY, 50)
    return search.ranked_turns(hits, turns, 50, query="Qué EN").select("session_id", "turn_ordinal", "score", "started_at", "snippet")


LINES = r"[a-z]{3}\.$"


@query("search_regex_lines", with_(EVIDENCE) + """SELECT conv_id, evidence_ordinal FROM evidence WHERE regexp_matches(text, '[a-z]{3}\\.\\z')""")
def search_regex_lines(spark, d):
    """``$`` is the very end of a text, also of one that ends with a line end."""
    return search.regex_matches(chat_evidence(spark, d), LINES, search.check_arguments("regex")).select("conv_id", "evidence_ordinal")


@query("share_export", with_(S.SQL_FILES) + f"""SELECT session_id, turn_ordinal, {REDACTED.format('user_message')} AS user_message, calls AS redacted_calls FROM file_turns""")
def share_export(spark, d):
    """Shared turns whose steps were given a planted secret: none leaves."""
    from weft.operators.ingest import make_step
    from weft.operators.share import export

    tables = assembled(spark, d)
    planted = make_step("tool_call", name=F.lit("Bash"), arguments=F.lit('{"cmd":"run","api_key":"hunter22"}'))
    turns = tables["turns"].withColumn("steps", F.transform("steps", lambda s: F.when(s["type"] == "tool_call", planted).otherwise(s)))
    shared = export(turns, tables["sessions"])
    safe = F.size(F.filter("steps", lambda s: s["arguments"] == '{"cmd":"run","api_key":"[REDACTED_SECRET]"}')).cast("long")
    return shared.select("session_id", "turn_ordinal", "user_message", safe.alias("redacted_calls"))


@query("document_preview", f"SELECT doc_id, {SQL_PREVIEW.format('t')} AS preview, least(length(t), 500) AS chars, length(t) AS total_chars FROM (SELECT doc_id, {COLLAPSED.format('text')} AS t FROM documents)")
def document_preview(spark, d):
    text, chars, total = preview(F.col("text"), 500)
    return table(spark, d, "documents").select("doc_id", text.alias("preview"), chars.alias("chars"), total.alias("total_chars"))


# --- ingest and derivation -----------------------------------------------------------------------


@query("dedupe_priority", """SELECT session_id, path, size, mtime_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY parses DESC, size DESC, mtime_ms DESC, path DESC) AS rn FROM (
  SELECT 'user-' || user_id AS session_id, 'f' || event_id AS path, floor(value)::BIGINT AS size, epoch_ms(ts) // 60000 AS mtime_ms, event_type <> 'error' AS parses FROM events)) WHERE rn = 1 AND parses""")
def dedupe_priority(spark, d):
    from weft.operators.ingest import dedupe_priority as first

    rows = table(spark, d, "events").select(
        F.concat(F.lit("user-"), "user_id").alias("session_id"),
        F.concat(F.lit("f"), "event_id").alias("path"),
        F.floor("value").cast("long").alias("size"),
        F.call_function("div", clock_millis(F.col("ts")), F.lit(60_000)).alias("mtime_ms"),  # whole minutes, towards 1970
        (F.col("event_type") != "error").alias("parses"),
    )
    return first(rows, ["session_id"], "size", "mtime_ms", "path", "parses").drop("parses")


@query("counter_delta", """SELECT user_id, event_id, total, CASE WHEN total >= before THEN total - before WHEN total IS NOT NULL THEN coalesce(last, total) ELSE last END AS delta FROM (
  SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (
    SELECT user_id, event_id, ts, CASE WHEN event_id % 11 <> 0 THEN floor(value)::BIGINT END AS total, CASE WHEN event_id % 3 <> 0 THEN event_id % 50 END AS last FROM events))""")
def counter_delta(spark, d):
    from weft.operators.ingest import counter_delta as delta

    e, k = table(spark, d, "events"), F.col("event_id")
    rows = e.select("user_id", "event_id", "ts", F.when(k % 11 != 0, F.floor("value").cast("long")).alias("total"), F.when(k % 3 != 0, k % 50).alias("last"))
    return delta(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "total", "last").select("user_id", "event_id", "total", "delta")


@query("token_dedupe", """SELECT user_id, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM (SELECT user_id, ts::DATE, event_type, max(floor(value)::BIGINT) AS a, max(event_id % 100) AS b FROM events GROUP BY ALL) GROUP BY 1""")
def token_dedupe(spark, d):
    from weft.operators.ingest import token_dedupe as dedupe

    e = table(spark, d, "events")
    rows = e.select("user_id", F.concat(F.to_date("ts"), "event_type").alias("request"), F.floor("value").cast("long").alias("a"), (F.col("event_id") % 100).alias("b"))
    return dedupe(rows, ["user_id"], "request", ("a", "b"))


@query("project_owner", with_("roots AS (SELECT * FROM (VALUES ('/w', 'all'), ('/w/repo', 'repo'), ('/w/repo/src/m2', 'm2'), ('/w/repo/src/m22', 'm22')) t(root, project_id))", S.SQL_ACCESSES, "paths AS (SELECT DISTINCT path FROM accesses)") + """SELECT path, arg_max(project_id, length(root)) AS project_id
FROM paths LEFT JOIN roots ON starts_with(path, root || '/') GROUP BY 1""")
def project_owner(spark, d):
    from weft.operators.ingest import owner_by_prefix

    roots = spark.createDataFrame([("/w", "all"), ("/w/repo", "repo"), ("/w/repo/src/m2", "m2"), ("/w/repo/src/m22", "m22")], "root string, project_id string")
    return owner_by_prefix(S.accesses(spark, d).select("path").distinct(), roots)


@query("evidence_explode", with_(S.SQL_FILES, f"""e AS (SELECT session_id, turn_ordinal, -2 AS turn, 0 AS k, 'user_message' AS field, {REDACTED.format('user_message')} AS text FROM file_turns
  UNION ALL SELECT session_id, turn_ordinal, -1, 0, 'final_answer', {REDACTED.format('final_answer_text')} FROM file_turns
  UNION ALL SELECT session_id, turn_ordinal, turn, 0, 'tool_name', 'Read' FROM file_calls
  UNION ALL SELECT session_id, turn_ordinal, turn, 1, 'tool_arguments', json_object('path', path)::VARCHAR FROM file_calls
  UNION ALL SELECT session_id, turn_ordinal, turn, 2, 'tool_output', 'ok' FROM file_calls)""") + """SELECT session_id, turn_ordinal, row_number() OVER (PARTITION BY session_id, turn_ordinal ORDER BY turn, k) - 1 AS evidence_ordinal, field, text FROM e WHERE trim(text) <> ''""")
def evidence_explode(spark, d):
    return assembled(spark, d)["turn_evidence"].select("session_id", "turn_ordinal", "evidence_ordinal", "field", "text")


@query("redact_assignments", r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\btoken = "[^\s"][^"\r\n]{3,}"', 'token = "[REDACTED_SECRET]"', 'g'), '[A-Za-z0-9+/=_-]{512,}', '[REDACTED_BLOB]', 'g') AS text FROM documents""")
def redact_assignments(spark, d):
    from weft.operators.redact import redact_text

    return table(spark, d, "documents").select("doc_id", redact_text(F.col("text")).alias("text"))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


PLANTED = ", ".join(f"({k}, {quoted(wanted or given)})" for k, (given, wanted) in enumerate(S.REDACTIONS))


@query("redaction_cases", f"""SELECT doc_id, 'doc ' || doc_id || ' ' || wanted || chr(10) || 'end' AS text FROM documents JOIN (VALUES {PLANTED}) c (k, wanted) ON doc_id % {len(S.REDACTIONS)} = k""")
def redaction_cases(spark, d):
    """Every document names one planted case, a secret of each kind or a near-miss, which redaction must find or leave."""
    from weft.operators.redact import redact_text

    given = F.get(F.array(*(F.lit(given) for given, _ in S.REDACTIONS)), (F.col("doc_id") % len(S.REDACTIONS)).cast("int"))
    text = F.concat(F.lit("doc "), "doc_id", F.lit(" "), given, F.lit("\nend"))
    return table(spark, d, "documents").select("doc_id", redact_text(text).alias("text"))


@query("tool_access_kind", """SELECT event_id, CASE WHEN k IN ('glob_view', 'list_signup') THEN 'list' WHEN k = 'edit_click' THEN 'edit' WHEN k = 'write_error' THEN 'write' ELSE 'read' END AS access_type
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'glob_view' WHEN 'signup' THEN 'list_signup' WHEN 'click' THEN 'edit_click' WHEN 'error' THEN 'write_error' ELSE 'grep_x' END AS k FROM events)""")
def tool_access_kind(spark, d):
    from weft.operators.derive import access_kind

    t = F.col("event_type")
    tool = F.when(t == "view", "Glob_view").when(t == "signup", "List_signup").when(t == "click", "EDIT_click").when(t == "error", "Write_error").otherwise("Grep_x")
    return table(spark, d, "events").select("event_id", access_kind(tool).alias("access_type"))


@query("tool_outcome", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN k > 90 THEN 'error' END AS status, event_type = 'error' OR k > 90 AS is_error
FROM (SELECT event_id, event_type, (props->>'k')::BIGINT AS k FROM events)""")
def tool_outcome(spark, d):
    from weft.operators.derive import outcome

    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(F.col("event_type") == "error", F.lit("failed"))
    out = F.to_json(F.struct(status.alias("status"), F.struct(F.when(k > 90, 1).otherwise(0).alias("exit_code")).alias("metadata")))
    s, bad = outcome(out)
    return table(spark, d, "events").select("event_id", s.alias("status"), bad.alias("is_error"))


# --- incremental and share -----------------------------------------------------------------------

MANIFEST = """found AS (SELECT o_orderkey AS id, o_custkey AS size, epoch_ms(o_orderdate) AS mtime_ms, o_orderpriority AS meta FROM orders WHERE o_orderkey % 11 <> 3 OR o_orderkey % 7 = 2),
manifest AS (SELECT o_orderkey AS id, o_custkey + (o_orderkey % 13 = 0)::INT AS size, epoch_ms(o_orderdate) AS mtime_ms, CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE o_orderpriority END AS meta FROM orders WHERE o_orderkey % 7 <> 2)"""


@query("manifest_diff", with_(MANIFEST) + """SELECT id, CASE WHEN m.size IS NULL THEN 'copy' WHEN f.size IS NULL THEN 'remove' WHEN f.size <> m.size OR f.mtime_ms <> m.mtime_ms THEN 'copy'
  WHEN f.meta <> m.meta THEN 'rewrite' ELSE 'keep' END AS action FROM found f FULL JOIN manifest m USING (id)""")
def manifest_diff(spark, d):
    from weft.operators.incremental import manifest_diff as diff

    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    base = [k.alias("id"), clock_millis(F.col("o_orderdate")).alias("mtime_ms")]
    found = o.filter((k % 11 != 3) | (k % 7 == 2)).select(*base, F.col("o_custkey").alias("size"), F.col("o_orderpriority").alias("meta"))
    old = o.filter(k % 7 != 2).select(*base, (F.col("o_custkey") + F.when(k % 13 == 0, 1).otherwise(0)).alias("size"), F.when(k % 17 == 0, "x").otherwise(F.col("o_orderpriority")).alias("meta"))
    return diff(found, old, ["id"])


@query("prune_anti", with_(S.SQL_TURNS) + """SELECT project_id, provider, session_id, turn_ordinal FROM turns
WHERE project_id NOT IN ('p1', 'p2') OR (turn_ordinal <= 3 AND project_id IN ('p1', 'p2'))""")
def prune_anti(spark, d):
    from weft.operators.incremental import prune

    t = S.turns(spark, d).select("project_id", "provider", "session_id", "turn_ordinal")
    keep = t.filter("project_id in ('p1', 'p2') and turn_ordinal <= 3")
    return prune(t, keep, ["project_id"])


@query("sessions_without_turns", with_(S.SQL_SESSIONS, S.SQL_TURNS) + "SELECT project_id, provider, session_id FROM sessions ANTI JOIN turns USING (project_id, provider, session_id)")
def sessions_without_turns(spark, d):
    from weft.operators.incremental import without_turns

    return without_turns(S.sessions(spark, d), S.turns(spark, d)).select("project_id", "provider", "session_id")


@query("session_upsert", """SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL OR (n.id IS NOT NULL AND o.kind = 'shared') THEN n.v ELSE o.v END AS v, CASE WHEN o.id IS NULL OR (n.id IS NOT NULL AND o.kind = 'shared') THEN n.kind ELSE o.kind END AS kind
FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'shared' ELSE 'local' END AS kind, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 0) o
FULL JOIN (SELECT o_orderkey AS id, 'shared' AS kind, o_orderpriority AS v FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 <> 0) n ON o.id = n.id""")
def session_upsert(spark, d):
    from weft.operators.incremental import upsert

    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    old = o.filter(k % 2 == 0).select(k.alias("id"), F.when(k % 5 == 0, "shared").otherwise("local").alias("kind"), F.col("o_orderstatus").alias("v"))
    new = o.filter((k % 3 == 0) | (k % 2 != 0)).select(k.alias("id"), F.lit("shared").alias("kind"), F.col("o_orderpriority").alias("v"))
    return upsert(old, new, ["id"], only="kind = 'shared'")


@query("share_status", with_(S.SQL_SESSIONS) + """SELECT count(*) FILTER (origin_kind = 'local' AND share_state = 'included') AS included, count(*) FILTER (origin_kind = 'local' AND share_state = 'excluded') AS excluded,
  count(*) FILTER (origin_kind = 'local' AND share_state = 'unset') AS unset, count(*) FILTER (origin_kind <> 'local') AS shared, count(*) AS total FROM sessions""")
def share_status(spark, d):
    from weft.operators.share import status

    return status(S.sessions(spark, d))


@query("share_selected", with_(S.SQL_SESSIONS, S.SQL_TURNS) + """SELECT project_id, provider, session_id FROM sessions SEMI JOIN turns USING (project_id, provider, session_id)
WHERE origin_kind = 'local' AND (share_state = 'included' OR (project_id IN ('p1', 'p4') AND share_state <> 'excluded'))""")
def share_selected(spark, d):
    from weft.operators.share import selected

    policies = spark.createDataFrame([("p1", "all"), ("p2", "manual"), ("p4", "all")], "project_id string, default_policy string")
    return selected(S.sessions(spark, d), policies, S.turns(spark, d)).select("project_id", "provider", "session_id")


@query("sessions_by_keys", with_(S.SQL_SESSIONS, S.SQL_TURNS, TOTALS.format("turns"), "keys AS (SELECT 'ord-' || (s_suppkey * 3) AS session_id, s_suppkey AS sort_index FROM supplier)") + """SELECT project_id, provider, session_id, sort_index, coalesce(turn_count, 0) AS turn_count, latest_status
FROM sessions JOIN keys USING (session_id) LEFT JOIN totals USING (project_id, provider, session_id)""")
def sessions_by_keys(spark, d):
    k = F.col("s_suppkey") * 3
    keys = table(spark, d, "supplier").select(*S.identity(k, "ord-"), F.col("s_suppkey").alias("sort_index"))
    return sessions.sessions_by_key(S.sessions(spark, d), S.turns(spark, d), keys).select("project_id", "provider", "session_id", "sort_index", "turn_count", "latest_status")


@query("version_epoch", """SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'e3' WHEN p_size > 20 OR (p_size = 20 AND p_partkey % 10 >= 5) THEN 'e2' WHEN p_size >= 7 THEN 'e1' END AS epoch,
  CASE WHEN p_size < 7 THEN NULL WHEN p_size < 45 OR (p_size = 45 AND p_partkey % 10 <= 2) THEN 'exact' ELSE 'best_effort_forward' END AS determinism FROM part""")
def version_epoch(spark, d):
    from weft.operators.ingest import epoch

    version = F.concat(F.lit("0."), "p_size", F.lit("."), F.col("p_partkey") % 10, F.lit("-rc"))
    name, sure = epoch(version, [("0.7.0", "e1"), ("0.20.5", "e2"), ("0.40.0", "e3")], "0.45.2")
    return table(spark, d, "part").select("p_partkey", name.alias("epoch"), sure.alias("determinism"))


@query("term_statistics", f"""SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS rows FROM (SELECT doc_id, unnest({SQL_TERMS}) AS term FROM documents) GROUP BY 1""")
def term_statistics(spark, d):
    return search.term_statistics(search.index_terms(table(spark, d, "documents"), ("text",), ["doc_id"]), ["doc_id"])


@query("display_paths", with_(S.SQL_ACCESSES) + "SELECT DISTINCT path, shown, file_name FROM accesses")
def display_paths(spark, d):
    a = S.accesses(spark, d).select("path", "repo_relative_path", "file_name").distinct()
    return a.select("path", display_path(F.col("repo_relative_path"), F.col("path"), S.ROOT).alias("shown"), "file_name")
