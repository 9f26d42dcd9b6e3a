"""Session reads: lists, pages, lookups by path, prefix and key."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import display_path, fold, fold_text, glob_to_regex, normal_path
from weft.operators import scope
from weft.operators.paging import page, whole_sum
from weft.schema import METRICS, SESSION_KEY, TOKENS

CAP = 500
#: Change statistics, whose unknown values count as none.
CHANGES = tuple(m for m in METRICS if m.startswith(("changed_", "added_", "removed_")))
#: Largest page whose keys are broadcast.
BROADCAST = 10_000


def turn_totals(turns: DataFrame) -> DataFrame:
    """One row a session: counts, first and latest turn, sums that are null if a turn's value is.

    First and latest values are minima and maxima of structs, so one grouped pass serves them all.
    """
    first = F.min_by(F.struct("user_message", "started_at"), "turn_ordinal")
    last = F.max_by(F.struct("status", "primary_model", "final_answer_text"), "turn_ordinal")
    return turns.groupBy(*SESSION_KEY).agg(
        F.count(F.lit(1)).alias("turn_count"),
        F.max("started_at").alias("latest_turn_at"),
        first["started_at"].alias("first_turn_at"),
        last["status"].alias("latest_status"),
        last["primary_model"].alias("primary_model"),
        last["final_answer_text"].alias("final_agent_message"),
        first["user_message"].alias("first_user_prompt"),
        *(whole_sum(c).alias(c) for c in (*TOKENS, "effective_agent_runtime_ms") if c in turns.columns),
        *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in CHANGES if c in turns.columns),
        F.count_if(F.col("status") == "aborted").alias("aborted_turn_count"),
    )


def newest_first() -> list[Column]:
    """Sessions without turns last; ties by provider up and session id down."""
    return [F.desc_nulls_last("latest_turn_at"), F.asc("provider"), F.desc("session_id"), F.asc("project_id")]


def compact(df: DataFrame, full: bool = False) -> DataFrame:
    """First prompt and last answer with their lengths, cut to CAP characters unless ``full``."""
    for name in ("first_user_prompt", "final_agent_message"):
        whole = F.col(name)
        df = df.withColumn(f"{name}_total_chars", F.length(whole).cast("long"))
        df = df.withColumn(f"{name}_truncated", F.lit(False) if full else F.coalesce(F.length(whole) > CAP, F.lit(False)))
        df = df if full else df.withColumn(name, F.substring(whole, 1, CAP))
        df = df.withColumn(f"{name}_chars", F.length(name).cast("long"))
    return df


def list_sessions(
    sessions: DataFrame,
    turns: DataFrame,
    users: DataFrame | None = None,
    project_id: str | None = None,
    provider: str | None = None,
    since: str | None = None,
    until: str | None = None,
    origin: str = "local",
    author: str | None = None,
    limit: int = 10,
    offset: int = 0,
    full: bool = False,
) -> DataFrame:
    """A page of sessions, newest turn first; time bounds apply to each session's latest turn.

    The page is found from times alone. Texts and sums are then taken for its sessions only, so no
    prompt or answer of another session is shuffled.
    """
    kept = scope.with_author(scope.origin(scope.equal(sessions, project_id=project_id, provider=provider), origin), users, author)
    mine = scope.equal(turns, project_id=project_id, provider=provider)
    latest = scope.in_window(mine.groupBy(*SESSION_KEY).agg(F.max("started_at").alias("latest_turn_at")), since, until, "latest_turn_at")
    bounded = since is not None or until is not None
    rows = page(kept.join(latest, SESSION_KEY, "inner" if bounded else "left"), newest_first(), limit, offset)
    keys = rows.select(*SESSION_KEY)
    if limit <= BROADCAST:
        keys = F.broadcast(keys)  # at most a page of rows
    totals = turn_totals(mine.join(keys, SESSION_KEY, "left_semi")).drop("latest_turn_at")
    out = rows.join(totals, SESSION_KEY, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("turn_count", "aborted_turn_count", *CHANGES) if c in out.columns})
    return compact(out, full).orderBy(*newest_first())


def touching_exact(accesses: DataFrame, path: str, root: str | None = None) -> DataFrame:
    """Keys of sessions that read, wrote or edited the path; only A-Z and a-z compare alike."""
    wanted = fold_text(path)
    hit = (fold(F.col("repo_relative_path")) == wanted) | (fold(F.col("path")) == wanted)
    if root:
        hit = hit | (fold(display_path(F.col("repo_relative_path"), F.col("path"), root)) == wanted)
    return accesses.filter(F.col("access_type").isin("read", "write", "edit") & F.coalesce(hit, F.lit(False))).select(*SESSION_KEY).distinct()


def matches_glob(glob: str, root: str | None, shown: Column | None = None, normal: Column | None = None) -> Column:
    """Whether an access matches in its project-scoped or its plain normal form.

    ``shown`` and ``normal`` are these forms where they are known. A literal of the glob, which raw paths must
    hold as well, goes first, so that most other paths are never normalised.
    """
    plan, literal = selector_plan(glob)
    if plan == "impossible":
        return F.lit(False)
    pattern = glob_to_regex(glob)
    scoped = fold(shown if shown is not None else display_path(F.col("repo_relative_path"), F.col("path"), root))
    same = (lambda c: c == fold_text(glob)) if plan == "exact" else (lambda c: c.rlike(pattern))
    hit = F.coalesce(same(scoped), F.lit(False)) | F.coalesce(same(fold(normal if normal is not None else normal_path(F.col("path")))), F.lit(False))
    if not literal:
        return hit
    raw = F.coalesce(fold(F.col("repo_relative_path")).contains(literal), F.lit(False)) | fold(F.col("path")).contains(literal)
    return F.when(raw, hit).otherwise(F.lit(False))


def selector_plan(glob: str) -> tuple[str, str]:
    """How a glob is matched (exact, pattern, or impossible), and the longest literal within one of its components."""
    if not glob.strip() or glob.startswith("../"):
        return "impossible", ""
    parts = re.split(r"/|\*|\?|\[[^\]]*\]?", fold_text(glob))
    return "pattern" if re.search(r"[*?\[]", glob) else "exact", max(parts, key=len)


def touching_glob(accesses: DataFrame, glob: str, root: str | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Keys of sessions with any access, listings included, that matches the glob; with a dictionary, the paths are matched there."""
    if paths is None:
        return accesses.filter(matches_glob(glob, root)).select(*SESSION_KEY).distinct()
    hits = paths.filter(matches_glob(glob, root, F.col("shown"), F.col("normal"))).select("path_id")
    return accesses.join(hits, "path_id", "left_semi").select(*SESSION_KEY).distinct()


def sessions_touching(sessions: DataFrame, turns: DataFrame, keys: DataFrame, **options) -> DataFrame:
    """The session list over sessions among ``keys``."""
    return list_sessions(sessions.join(keys, SESSION_KEY, "left_semi"), turns, **options)


def sessions_by_key(sessions: DataFrame, turns: DataFrame, keys: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Sessions of ``keys`` in the order of its ``sort_index``."""
    rows = scope.with_author(sessions, users).join(keys, SESSION_KEY).join(turn_totals(turns), SESSION_KEY, "left")
    return compact(rows.withColumn("turn_count", F.coalesce("turn_count", F.lit(0)))).orderBy("sort_index")


def edited_files(accesses: DataFrame, root: str | None = None) -> DataFrame:
    """Sorted distinct project paths each session wrote or edited."""
    shown = display_path(F.col("repo_relative_path"), F.col("path"), root)
    rows = accesses.filter(F.col("access_type").isin("write", "edit")).withColumn("shown", shown).filter(F.col("shown").isNotNull())
    return rows.groupBy(*SESSION_KEY).agg(F.sort_array(F.collect_set("shown")).alias("edited_files"))


def resolve_prefix(sessions: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """Sessions whose id starts so, with the total number of matches and whether the list is cut."""
    found = sessions.filter(fold(F.col("session_id")).startswith(fold_text(prefix))).select(*SESSION_KEY)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    rows = page(found, [F.asc(k) for k in SESSION_KEY], limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)  # total is one row


def find_session(sessions: DataFrame, session_id: str, users: DataFrame | None = None, author: str | None = None) -> list:
    """Sessions of that id, letters A-Z alike; else those it is a prefix of. At most two, to show ambiguity."""
    rows = scope.with_author(sessions, users, author).select(*SESSION_KEY)
    exact = rows.filter(fold(F.col("session_id")) == fold_text(session_id)).orderBy(*SESSION_KEY).limit(2).collect()
    return exact or rows.filter(fold(F.col("session_id")).startswith(fold_text(session_id))).orderBy(*SESSION_KEY).limit(2).collect()
