"""Project and workspace metrics over turns, tools and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.times import local_day
from weft.operators import scope
from weft.operators.paging import page
from weft.schema import SESSION_KEY, TURN_KEY


def project_aggregates(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions, turns and last activity of each project."""
    t = turns.groupBy("project_id").agg(F.count(F.lit(1)).alias("turn_count"), F.max("started_at").alias("last_activity_at"))
    s = sessions.groupBy("project_id").agg(F.count(F.lit(1)).alias("session_count"))
    return s.join(t, "project_id", "left").withColumn("turn_count", F.coalesce("turn_count", F.lit(0)))


def workspace(projects: DataFrame, sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Configured projects, each with its totals or zeros, latest activity first."""
    rows = projects.join(project_aggregates(sessions, turns), projects["id"] == F.col("project_id"), "left").drop("project_id")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("session_count", "turn_count")})
    return rows.orderBy(F.desc_nulls_last("last_activity_at"), "name", "id")


def windowed(turns: DataFrame, days: int) -> DataFrame:
    """Turns of the last ``days`` local days up to the latest day that has any, with ``day`` and the window."""
    t = turns.withColumn("day", local_day(F.col("started_at")))
    edge = t.agg(F.max("day").alias("window_end")).withColumn("window_start", F.date_sub("window_end", days - 1))
    return t.join(F.broadcast(edge), F.col("day").between(F.col("window_start"), F.col("window_end")))  # one row


def workspace_daily(turns: DataFrame, days: int = 7) -> DataFrame:
    """Active milliseconds for each day and project of the window; days without any are zeros."""
    t = windowed(turns, days)
    time = t.filter(scope.active(F.col("status"), F.col("duration_ms"))).groupBy("day", "project_id").agg(F.sum("duration_ms").alias("ms"))
    every = t.select("window_start", "window_end").limit(1).select(F.explode(F.sequence("window_start", "window_end")).alias("date"))
    projects = turns.select("project_id").distinct()
    grid = projects.crossJoin(F.broadcast(every))  # each project by the window's days, at most ``days`` rows
    out = grid.join(time, (F.col("date") == F.col("day")) & (grid["project_id"] == time["project_id"]), "left")
    return out.select("date", grid["project_id"], F.coalesce("ms", F.lit(0)).cast("long").alias("active_time_ms"))


def workspace_recent(turns: DataFrame, days: int = 7, limit: int = 50, offset: int = 0) -> DataFrame:
    """Sessions with active time in the window, latest first, and how many turns count or don't."""
    counts = scope.active(F.col("status"), F.col("duration_ms"))
    out = windowed(turns, days).groupBy(*SESSION_KEY).agg(
        F.coalesce(F.sum(F.when(counts, F.col("duration_ms"))), F.lit(0)).alias("active_time_ms"),
        F.count_if(counts).alias("included_turn_count"),
        F.count_if(~F.coalesce(counts, F.lit(False))).alias("excluded_turn_count"),
        F.max("started_at").alias("latest_turn_at"),
    )
    order = [F.desc("latest_turn_at"), F.asc("project_id"), F.asc("provider"), F.asc("session_id")]
    return page(out.filter("active_time_ms > 0"), order, limit, offset)


def latest_turns(turns: DataFrame, limit: int = 1000, provider: str | None = None) -> DataFrame:
    """The newest ``limit`` turns, which project metrics look at: a top-k by time."""
    order = [F.desc("started_at"), F.asc("provider"), F.asc("session_id"), F.asc("turn_ordinal")]
    return page(scope.equal(turns, provider=provider), order, limit)


def project_tools(recent: DataFrame, calls: DataFrame, limit: int = 10) -> DataFrame:
    """Tools called most in those turns."""
    rows = calls.join(recent.select(*TURN_KEY), TURN_KEY, "left_semi").filter(F.col("tool_name").isNotNull())
    return page(rows.groupBy("tool_name").agg(F.count(F.lit(1)).alias("call_count")), [F.desc("call_count"), F.asc("tool_name")], limit)


def project_files(recent: DataFrame, touched: DataFrame, written: bool, limit: int = 10) -> DataFrame:
    """Files read or written most in those turns; here a listing counts as a read."""
    rows = touched.join(recent.select(*TURN_KEY), TURN_KEY, "left_semi")
    rows = rows.groupBy(F.coalesce("shown", "path").alias("path")).agg(
        F.count_if(F.col("access_type").isin("read", "list")).alias("read_count"), F.count_if(F.col("access_type").isin("write", "edit")).alias("write_count")
    )
    first = "write_count" if written else "read_count"
    order = [F.desc(first), F.desc(F.col("read_count") + F.col("write_count")), F.asc("path")]
    return page(rows.filter(F.col(first) > 0), order, limit)


def project_daily(recent: DataFrame) -> DataFrame:
    """Turns, failures and active time of those turns by day."""
    rows = recent.withColumn("day", local_day(F.col("started_at")))
    counts = scope.active(F.col("status"), F.col("duration_ms"))
    return rows.groupBy("day").agg(
        F.count(F.lit(1)).alias("turn_count"),
        F.count_if(F.col("status") != "completed").alias("failure_count"),
        F.coalesce(F.sum(F.when(counts, F.col("duration_ms"))), F.lit(0)).alias("active_time_ms"),
    )


def turn_insights(key: dict, calls: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tools and files of one turn."""
    tools = scope.equal(calls, **key).groupBy("tool_name").agg(F.count(F.lit(1)).alias("call_count")).orderBy(F.desc("call_count"), "tool_name")
    files = scope.equal(touched, **key).groupBy(F.coalesce("shown", "path").alias("path")).agg(
        F.count_if(F.col("access_type").isin("read", "list")).alias("read_count"), F.count_if(F.col("access_type").isin("write", "edit")).alias("write_count")
    )
    return tools, files.orderBy(F.desc(F.col("read_count") + F.col("write_count")), F.desc("write_count"), F.desc("read_count"), "path")


def turn_commands(key: dict, calls: DataFrame) -> DataFrame:
    """Shell commands of one turn with the folder they ran in."""
    from weft.operators.shell import shell_commands

    folder = F.coalesce(*(F.try_variant_get(F.try_parse_json("arguments_text"), f"$.{k}", "string") for k in ("workdir", "cwd")))
    return shell_commands(scope.equal(calls, **key)).select("tool_name", F.col("command").alias("command_text"), folder.alias("workdir"))


def project_status(projects: DataFrame, sessions: DataFrame, turns: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """The workspace with what a refresh would do: files to copy and to remove, from a manifest diff by project."""
    rows = workspace(projects, sessions, turns)
    if pending is None:
        return rows
    todo = pending.groupBy("project_id").agg(F.count_if(F.col("action") == "copy").alias("to_copy"), F.count_if(F.col("action") == "remove").alias("to_remove"))
    rows = rows.join(todo, rows["id"] == todo["project_id"], "left").drop("project_id")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("to_copy", "to_remove")})
