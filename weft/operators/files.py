"""File pivots: which files were touched most, by which sessions, and with which others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import fold, fold_text
from weft.operators import scope
from weft.operators.paging import page
from weft.operators.paths import RAW, dictionary, keyed, matching
from weft.schema import SESSION_KEY, TURN_KEY

READS, WRITES = ("read",), ("write", "edit")
PATH_CAP = 20


@dataclass(frozen=True)
class Touches:
    """Reads, writes and edits, one row an access with its turn's time and ``path_id``, and the dictionary of their paths."""

    rows: DataFrame
    paths: DataFrame

    def shown(self, rows: DataFrame) -> DataFrame:
        """``rows`` by the canonical path instead of its spelling; null where a path lies outside the project."""
        return rows.join(self.paths.select("path_id", "shown"), "path_id").drop("path_id")


def touches(
    accesses: DataFrame, turns: DataFrame, sessions: DataFrame, project_id: str | None = None, since: str | None = None, until: str | None = None, origin: str = "local", root: str | None = None, paths: DataFrame | None = None
) -> Touches:
    """Reads, writes and edits of project files. Bounds compare times as text here.

    ``paths`` is the stored dictionary; without one it is made of the accesses.
    """
    kinds = F.col("access_type").isin(*READS, *WRITES) & (F.trim("path") != "")
    a = keyed(scope.equal(accesses, project_id=project_id).filter(kinds))
    t = scope.in_window(scope.equal(turns, project_id=project_id), since, until, as_text=True).select(*TURN_KEY, "started_at")
    s = scope.origin(scope.equal(sessions, project_id=project_id), origin).select(*SESSION_KEY)
    rows = a.select(*TURN_KEY, "access_type", "path_id").join(t, TURN_KEY).join(s, SESSION_KEY, "left_semi")
    return Touches(rows, paths if paths is not None else dictionary(a, root))


def counted() -> list[Column]:
    read = F.count_if(F.col("access_type").isin(*READS))
    return [
        F.count(F.lit(1)).alias("touch_count"),
        read.alias("read_count"),
        F.count_if(F.col("access_type").isin(*WRITES)).alias("write_count"),
        F.min("started_at").alias("first_touched_at"),
        F.max("started_at").alias("last_touched_at"),
    ]


#: How totals of parts become totals of their whole.
ADDED = {"touch_count": F.sum, "read_count": F.sum, "write_count": F.sum, "first_touched_at": F.min, "last_touched_at": F.max}
ORDINALS = {"first_turn_ordinal": F.min, "last_turn_ordinal": F.max}


def ordinals() -> list[Column]:
    return [F.min("turn_ordinal").alias("first_turn_ordinal"), F.max("turn_ordinal").alias("last_turn_ordinal")]


def added(rules: dict) -> list[Column]:
    return [f(c).alias(c) for c, f in rules.items()]


def raw_rows(touched: Touches) -> DataFrame:
    """Totals for each session and stored spelling of a path."""
    by = touched.rows.groupBy("provider", "session_id", "path_id").agg(*counted(), *ordinals())
    return by.join(touched.paths.select("path_id", *RAW), "path_id").select("provider", "session_id", *RAW, *ADDED, *ORDINALS)


def top_files(touched: Touches, limit: int = 10, offset: int = 0) -> DataFrame:
    """Most touched files; ties by sessions, then latest touch, then path.

    Counted by (spelling, session), then by (path, session), then by path: each step has few rows for the next,
    and no distinct is spread out.
    """
    by = touched.shown(touched.rows.groupBy("path_id", "provider", "session_id").agg(*counted())).filter(F.col("shown").isNotNull())
    each = by.groupBy("shown", "provider", "session_id").agg(*added(ADDED))
    out = each.groupBy(F.col("shown").alias("path")).agg(*added(ADDED), F.count(F.lit(1)).alias("session_count"))
    order = [F.desc("touch_count"), F.desc("session_count"), F.desc("last_touched_at"), F.asc("path")]
    return page(out, order, limit, offset)


def path_sessions(touched: Touches, glob: str, root: str | None = None, limit: int = 10, offset: int = 0, cap: int = PATH_CAP) -> DataFrame:
    """Sessions that touched files matching the glob, with the first of the matched paths and how many there are.

    The dictionary tells which paths match; only their accesses are counted. Paths are ranked within a session
    before any are gathered.
    """
    if not glob.strip():
        raise ValueError("the path selector is blank")
    hits = matching(touched.paths, glob, root).select("path_id", F.coalesce("shown", "path").alias("shown"))
    by = touched.rows.join(hits, "path_id").groupBy("provider", "session_id", "shown").agg(*counted(), *ordinals())
    ranked = by.withColumn("rn", F.row_number().over(Window.partitionBy("provider", "session_id").orderBy("shown")))
    out = ranked.groupBy("provider", "session_id").agg(
        *added(ADDED | ORDINALS), F.sort_array(F.collect_list(F.when(F.col("rn") <= cap, F.col("shown")))).alias("matched_paths"), F.count(F.lit(1)).alias("matched_paths_count")
    )
    out = out.withColumn("matched_paths_truncated", F.col("matched_paths_count") > cap)
    return page(out, [F.desc("touch_count"), F.desc("last_touched_at"), F.asc("provider"), F.asc("session_id")], limit, offset)


def simple_path(root: str | None) -> Column:
    """The plain display path of the co-touch pivot: the relative path, else the path below the root, else the path."""
    path = F.col("path")
    below = F.when(path.startswith(f"{root}/"), F.substring(path, len(root) + 2, 1 << 20)) if root else F.lit(None)
    return F.coalesce("repo_relative_path", below, path)


def co_touched(touched: Touches, seed: str, root: str | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """Other files of the sessions that touched ``seed``, by how many of these sessions touched them.

    The seed's spellings come from the dictionary, their sessions from it, and only these sessions' accesses are
    told apart by path.
    """
    if not seed.strip():
        raise ValueError("the path selector is blank")
    names = touched.paths.select("path_id", simple_path(root).alias("name"))
    same = fold(F.col("name")) == fold_text(seed)
    key = ["provider", "session_id"]
    seeds = touched.rows.join(names.filter(same).select("path_id"), "path_id", "left_semi").select(*key).distinct()
    mine = touched.rows.select(*key, "path_id").join(seeds, key, "left_semi").distinct()
    pairs = mine.join(names.filter(~same), "path_id").select(*key, F.col("name").alias("path")).distinct()
    out = pairs.groupBy("path").agg(F.count(F.lit(1)).alias("co_touch_count"))
    return page(out, [F.desc("co_touch_count"), fold(F.col("path")).asc(), F.asc("path")], limit, offset)


def session_files(touched: Touches, session: dict, limit: int = 100, offset: int = 0) -> DataFrame:
    """Files of one session, with how many there are before paging."""
    by = scope.equal(touched.rows, **session).groupBy("path_id").agg(*counted(), *ordinals())
    mine = by.join(touched.paths.select("path_id", F.coalesce("shown", "path").alias("path")), "path_id")
    out = mine.groupBy("path").agg(*added({"read_count": F.sum, "write_count": F.sum} | ORDINALS))
    total = out.agg(F.count(F.lit(1)).alias("file_count"))
    order = [F.desc(F.col("read_count") + F.col("write_count")), F.desc("write_count"), F.desc("read_count"), F.asc("path")]
    return page(out, order, limit, offset).crossJoin(F.broadcast(total))  # one row


def select_files(path: str | None, co_touched_with: str | None) -> str:
    """Exactly one selector, and not a blank one."""
    given = [x for x in (path, co_touched_with) if x is not None]
    if len(given) != 1 or not given[0].strip():
        raise ValueError("give exactly one of a path and a co-touched path")
    return "path" if path is not None else "co_touched"
