"""Incremental maintenance: manifests, snapshots, replacement, pruning, upserts.

Tables are immutable versions: an operator builds the next version of a table from the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.schema import METRICS, SESSION_KEY, TURN_KEY


def manifest_diff(found: DataFrame, manifest: DataFrame, key: list[str]) -> DataFrame:
    """What to do with each file: copy new ones and those of another size or time, drop those that went.

    A file whose content is as before but whose recorded metadata differ has only its entry rewritten.
    """
    old = manifest.select(*key, F.col("size").alias("old_size"), F.col("mtime_ms").alias("old_mtime_ms"), F.col("meta").alias("old_meta"), F.lit(True).alias("was"))
    both = found.withColumn("is_now", F.lit(True)).join(old, key, "full")
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime_ms").eqNullSafe(F.col("old_mtime_ms"))
    action = F.when(F.col("was").isNull(), "copy").when(F.col("is_now").isNull(), "remove").when(~same, "copy").when(~F.col("meta").eqNullSafe(F.col("old_meta")), "rewrite").otherwise("keep")
    return both.select(*key, action.alias("action"))


def unchanged(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files of ``found`` whose session is indexed from the same path, size, time and determinism: not parsed again."""
    return found.join(indexed.select("archive_path", "source_size", "source_mtime_ms", "determinism"), ["archive_path", "source_size", "source_mtime_ms", "determinism"], "left_semi")


def to_parse(found: DataFrame, indexed: DataFrame) -> DataFrame:
    return found.join(indexed.select("archive_path", "source_size", "source_mtime_ms", "determinism"), ["archive_path", "source_size", "source_mtime_ms", "determinism"], "left_anti")


def without_gone(sessions: DataFrame, discovered: DataFrame) -> DataFrame:
    """Local sessions that are no longer discovered go; shared ones stay."""
    gone = sessions.filter("origin_kind = 'local'").join(discovered, SESSION_KEY, "left_anti").select(*SESSION_KEY)
    return sessions.join(gone, SESSION_KEY, "left_anti")


def replace_sessions(table: DataFrame, fresh: DataFrame, failed: DataFrame) -> DataFrame:
    """The table with the rows of freshly parsed sessions in place of their old ones.

    Sessions that failed to parse keep their old rows.
    """
    new = fresh.join(failed.select(*SESSION_KEY), SESSION_KEY, "left_anti")
    return table.join(new.select(*SESSION_KEY).distinct(), SESSION_KEY, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_share_state(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """New session rows with the share state of the local row they replace."""
    state = old.filter("origin_kind = 'local'").select(*SESSION_KEY, F.col("share_state").alias("__state"))
    return fresh.join(state, SESSION_KEY, "left").withColumn("share_state", F.coalesce("__state", "share_state")).drop("__state")


def cascade(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Child rows whose parent is still there."""
    return child.join(parent.select(*key), key, "left_semi")


def upsert(table: DataFrame, rows: DataFrame, key: list[str], only: str | None = None) -> DataFrame:
    """The table with ``rows`` merged in by key, the new row winning; under ``only`` just over rows it holds for."""
    old = table.withColumn("__rank", F.lit(1) if only is None else F.when(F.expr(only), 1).otherwise(-1))
    both = old.unionByName(rows.withColumn("__rank", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy("__rank")
    return both.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rank", "__rn")


def without_project(table: DataFrame, project_id: str) -> DataFrame:
    return table.filter(F.col("project_id") != project_id)


def prune(turns: DataFrame, keep: DataFrame, scope: list[str]) -> DataFrame:
    """Turns of the scopes in ``keep`` (project, remote, user) that it doesn't list go; other scopes stay."""
    here = keep.select(*scope).distinct()
    inside = turns.join(here, scope, "left_semi").join(keep, [*scope, *[k for k in TURN_KEY if k not in scope]], "left_semi")
    return turns.join(here, scope, "left_anti").unionByName(inside)


def without_turns(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions that no turn is left of."""
    return sessions.join(turns.select(*SESSION_KEY).distinct(), SESSION_KEY, "left_anti")


# --- manifests, carried and migrated tables ------------------------------------------------------

#: Version of the manifest format.
MANIFEST = 1


def write_manifest(entries: DataFrame, path: str) -> None:
    """Store the manifest (key columns, size, mtime_ms, meta) as JSON lines that name the format's version."""
    entries.withColumn("version", F.lit(MANIFEST)).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored manifest; entries of another version count as none, so that their files are copied again."""
    return spark.read.schema(f"{schema}, version int").json(path).filter(F.col("version") == MANIFEST).drop("version")


def promote_local(sessions: DataFrame) -> DataFrame:
    """Sessions without shared rows whose provider and id a local session has: it has taken their place."""
    local = sessions.filter("origin_kind = 'local'").select("provider", "session_id").distinct()
    shared = sessions.filter("origin_kind <> 'local'").join(local, ["provider", "session_id"], "left_anti")
    return sessions.filter("origin_kind = 'local'").unionByName(shared)


def carry_shared(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rebuilt tables with what only the old ones know: shared sessions and their rows, and share states.

    A shared session that is local now is left out, and its rows with it.
    """
    shared = old["sessions"].filter("origin_kind <> 'local'").join(new["sessions"].select("provider", "session_id").distinct(), ["provider", "session_id"], "left_anti")
    keys = shared.select(*SESSION_KEY)
    out = {"sessions": keep_share_state(new["sessions"], old["sessions"]).unionByName(shared, allowMissingColumns=True)}
    for name in new:
        if name in old and name != "sessions" and "session_id" in new[name].columns:
            out[name] = new[name].unionByName(old[name].join(keys, SESSION_KEY, "left_semi"), allowMissingColumns=True)
    return {**new, **out}


def migrated(turns: DataFrame) -> DataFrame:
    """Stored turns of an older version: metrics where they are missing, and redacted by today's rules."""
    from weft.operators.derive import metrics
    from weft.operators.redact import redact_steps, redact_text

    known = [m for m in METRICS if m in turns.columns]
    fresh = metrics(turns.withColumnsRenamed({m: f"__{m}" for m in known}))
    fresh = fresh.withColumns({m: F.coalesce(f"__{m}", m) for m in known}).drop(*(f"__{m}" for m in known))
    return fresh.withColumns({"user_message": redact_text(F.col("user_message")), "final_answer_text": redact_text(F.col("final_answer_text")), "steps": redact_steps(F.col("steps"))})


def remove_project(tables: dict[str, DataFrame], project_id: str) -> dict[str, DataFrame]:
    """All tables without a project's rows."""
    return {name: without_project(t, project_id) if "project_id" in t.columns else t for name, t in tables.items()}
