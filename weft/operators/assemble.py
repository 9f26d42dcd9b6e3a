"""From session files to the tables: one plan for each provider, from lines to derived rows.

Files are independent, so all of it is joins and grouped passes over (file, turn). Metrics are counted
before anything is redacted, derived rows come from what is left after it. Turns are written once and
read again by the four tables that derive from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import derive, ingest
from weft.operators.redact import redact_steps, redact_text
from weft.runtime import materialize
from weft.schema import METRICS, SESSION_KEY, TOKENS, TURN_KEY

#: Parts that each stored table is dealt to by a hash of the session.
BUCKETS = 256
TURN_COLUMNS = ["turn_id", "started_at", "completed_at", "status", "user_message", "final_answer_at", "final_answer_text", "primary_model", *TOKENS, *METRICS, "has_final_answer", "steps"]


def identified(files: DataFrame, about: DataFrame, provider: str) -> DataFrame:
    """Files with the session that their path makes them: session_id, session_kind, parent_session_id, agent, and ``reason`` not to take them.

    A Codex file is the session of its name, or of its header where the name has none. A Claude file is what its
    place in the archive says; a subagent is a session of its own, whose lines carry its parent's id.
    """
    session, kind, parent = ingest.archive_kind(F.col("file"))
    named = files.withColumns({"session_kind": kind, "parent_session_id": parent, "own": session})
    both = named.join(about, "file", "left")
    if provider == "codex":
        wrong = F.when(F.col("own").isNotNull() & (F.col("own") != F.col("told")), F.concat(F.lit("session id is not "), "own"))
        unnamed = F.when(F.col("own").isNull() & F.col("told").isNull(), F.lit("no session id"))
        out = both.withColumns({"session_id": F.coalesce("own", "told"), "session_kind": F.lit("primary"), "parent_session_id": F.lit(None).cast("string"), "__why": F.coalesce(wrong, unnamed)})
    else:
        out = both.withColumns({"session_id": F.col("own"), "__why": F.when(F.col("own").isNull(), F.lit("not a session file"))})
    return out.withColumn("reason", F.coalesce("reason", "__why")).drop("own", "told", "__why")


def provider_turns(files: DataFrame, provider: str, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns by file, files with what they say of their session and the reason why they are left out).

    ``files`` are whole files (file, text, size, mtime_ms), or have no text but their ``lines`` (file, line, json). What is wrong with one file ends no job: a line that isn't
    JSON, ids that don't agree with the path, an item that its version can't have written.
    """
    parsed, bad = ingest.quarantine(ingest.lines(files) if lines is None else lines)
    v = F.col("v")
    if provider == "codex":
        turns = ingest.codex_turns(ingest.codex_events(parsed))
        at = F.when(ingest.text_of(v, "$.type") == "session_meta", F.col("line"))
        values = {n: ingest.text_of(v, f"$.payload.{p}") for n, p in (("told", "id"), ("cwd", "cwd"), ("cli_version", "cli_version"), ("repository_url", "git.repository_url"))}
    else:
        events = ingest.claude_events(parsed)
        turns = ingest.claude_turns(events, parsed)
        at = F.col("line")
        values = {n: ingest.text_of(v, f"$.{p}") for n, p in (("told", "sessionId"), ("cwd", "cwd"), ("cli_version", "version"))} | {"repository_url": F.lit(None).cast("string")}
    first = [F.min(F.when(at.isNotNull() & c.isNotNull(), F.struct(F.col("line"), c.alias("x"))))["x"].alias(n) for n, c in values.items()]
    about = parsed.groupBy("file").agg(*first)
    names = files.select("file", "size", "mtime_ms").join(bad.select("file", "reason"), "file", "left")
    found = identified(names, about, provider)
    if provider == "codex":
        early = ingest.version_key(F.col("cli_version")) < ingest.version_literal(ingest.CODEX_EPOCHS[0][0])
        checks = ingest.codex_unsupported(parsed, about).select("file", F.col("reason").alias("__why"), F.lit(None).cast("string").alias("__sure"))
        found = found.withColumn("reason", F.coalesce("reason", F.when(early, F.lit("unsupported version"))))
    else:
        parent = F.coalesce("parent_session_id", "session_id").alias("session")
        agent = F.when(F.col("session_kind") == "subagent", F.regexp_extract("session_id", "[^/]+$", 0)).alias("agent")
        checks = ingest.identity_checks(events, found.filter("session_id is not null").select("file", parent, agent)).select("file", F.col("reason").alias("__why"), F.col("determinism").alias("__sure"))
    found = found.join(checks, "file", "left").withColumn("reason", F.coalesce("reason", "__why"))
    return turns, materialize(found.drop("__why").withColumnRenamed("__sure", "drift"), "files")


def determinism(provider: str):
    """(schema id, how sure it is) of a session's version."""
    if provider == "codex":
        return ingest.epoch(F.col("cli_version"), list(ingest.CODEX_EPOCHS), ingest.CODEX_EXACT)
    key = ingest.version_key(F.col("cli_version"))
    within = (key >= ingest.version_literal(ingest.CLAUDE_EPOCHS[0][0])) & (key <= ingest.version_literal(ingest.CLAUDE_EPOCHS[-1][0]))
    sure = F.when(within & (F.col("drift") == "exact"), "exact").otherwise("best_effort_forward")
    return ingest.claude_schema(F.col("cli_version"), F.col("session_kind")), sure


def owned(sessions: DataFrame, owners: DataFrame, upstreams: DataFrame | None) -> DataFrame:
    """``sessions`` once for each project that owns their folder and repository; those of no project are left out.

    Owners are found once for each distinct pair of folder and repository.
    """
    spark = sessions.sparkSession
    roots = owners if "linked" in owners.columns else owners.withColumn("linked", F.lit(False))
    known = upstreams if upstreams is not None else spark.createDataFrame([], "project_id string, root string, url string")
    home = F.to_json(F.struct("cwd", "repository_url"))
    homes = sessions.select(home.alias("home"), "cwd", "repository_url").distinct()
    found = ingest.owners_of(homes, roots, known, ["home"]).distinct()
    return sessions.withColumn("home", home).join(found, "home").drop("home")


def provider_tables(raw: DataFrame, provider: str, owners: DataFrame, upstreams: DataFrame | None = None, lines: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of one provider's files (file, text, size, mtime_ms), or of files and their ``lines``.

    ``owners`` maps folders to projects (root, project_id, linked or not), ``upstreams`` repositories (project_id, root,
    url). Of several files of one session the largest and newest one that can be read is taken. A session whose
    folder and repository belong to no project is left out.
    """
    if lines is None:  # read by many steps, so what makes the files runs once
        raw = materialize(raw, "raw")
    turns, files = provider_turns(raw, provider, lines)
    skipped = files.filter("reason is not null").select("file", "reason")
    found = files.filter("session_id is not null").withColumn("__readable", F.col("reason").isNull())
    one = ingest.dedupe_priority(found, ["session_id"], "size", "mtime_ms", "file", "__readable").drop("reason", "__readable")
    name, sure = determinism(provider)
    sessions = owned(one, owners, upstreams).withColumn("provider", F.lit(provider))
    sessions = materialize(
        sessions.select(
            *SESSION_KEY, "parent_session_id", "session_kind", F.col("file").alias("archive_path"), "cwd", "cli_version",
            name.alias("schema_id"), F.coalesce(sure, F.lit("best_effort_forward")).alias("determinism"), F.col("size").alias("source_size"), F.col("mtime_ms").alias("source_mtime_ms"),
            F.lit("local").alias("origin_kind"), F.lit(None).cast("string").alias("origin_user_id"), F.lit("unset").alias("share_state"),
        ),
        "sessions",
    )
    mine = turns.join(sessions.select(*SESSION_KEY, F.col("archive_path").alias("file")), "file")
    measured = derive.metrics(mine)
    clean = measured.withColumns({"user_message": redact_text(F.col("user_message")), "final_answer_text": redact_text(F.col("final_answer_text")), "steps": redact_steps(F.col("steps"))})
    turns = materialize(clean.select(*TURN_KEY, *TURN_COLUMNS), "turns")
    calls = derive.pair_calls(turns)
    return {
        "sessions": sessions,
        "turns": turns,
        "tool_calls": calls,
        "file_accesses": derive.file_accesses(calls, sessions),
        "turn_evidence": derive.evidence(turns),
        "turn_search": derive.search_text(turns),
        "skipped": skipped,
    }


def derived(turns: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """The derived tables, rebuilt from stored turns and sessions."""
    calls = derive.pair_calls(turns)
    return {"tool_calls": calls, "file_accesses": derive.file_accesses(calls, sessions), "turn_evidence": derive.evidence(turns), "turn_search": derive.search_text(turns)}


def all_tables(raw: dict[str, DataFrame], owners: DataFrame, upstreams: DataFrame | None = None, lines: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Tables of every provider's files together."""
    out: dict[str, DataFrame] = {}
    for provider, files in raw.items():
        for name, rows in provider_tables(files, provider, owners, upstreams, (lines or {}).get(provider)).items():
            out[name] = out[name].unionByName(rows) if name in out else rows
    return out


def bucket():
    return F.pmod(F.xxhash64("provider", "session_id"), F.lit(BUCKETS)).cast("int")


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Write each table dealt by session, rows of a session together, so that a session's reads prune to one part."""
    for name, rows in tables.items():
        if "session_id" not in rows.columns:
            rows.write.mode("overwrite").parquet(f"{root}/{name}")
            continue
        key = [c for c in TURN_KEY if c in rows.columns]
        dealt = rows.withColumn("bucket", bucket()).repartition("bucket").sortWithinPartitions("bucket", *key)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str, provider: str | None = None, session_id: str | None = None) -> DataFrame:
    """A stored table; given a session, only the part that can hold it is read."""
    rows = spark.read.parquet(f"{root}/{name}")
    if "bucket" not in rows.columns:
        return rows
    if provider and session_id:
        at = spark.range(1).select(F.pmod(F.xxhash64(F.lit(provider), F.lit(session_id)), F.lit(BUCKETS)).cast("int")).first()[0]
        rows = rows.filter((F.col("bucket") == at) & (F.col("provider") == provider) & (F.col("session_id") == session_id))
    return rows.drop("bucket")
