"""Refresh: bring the stored tables up to the session files as they are now.

Every refresh takes a snapshot of the source, file names, sizes and times, and compares it with the manifest
that the store keeps beside its tables. Sessions with a file that is new, changed or gone are built again
from all of their files, and the commit replaces their rows in all tables at once and the manifest with
them. What was read is thus part of the state it led to: a restart, a new checkpoint or a batch that is run
twice finds it there, and no file is lost or read for nothing.

A session whose files went loses its rows; one whose files can't be read any more keeps its old ones, and
the manifest says why. ``watch`` runs refreshes by a clock; two at a time are kept apart by the log.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import assemble, incremental
from weft.operators.ingest import archive_kind
from weft.runtime import materialize
from weft.sources import archive
from weft.streaming.store import MANIFEST, Conflict, Snapshot, Store

#: Files that are read by name; of more, the folder is read and joined.
NAMED = 10_000
MANIFEST_COLUMNS = "file string, provider string, session_id string, size long, mtime_ms long, reason string"


class Source(Protocol):
    """Session files somewhere."""

    def snapshot(self) -> DataFrame:
        """(file, provider, size, mtime_ms) of every file; no content is read."""

    def lines(self, files: DataFrame) -> DataFrame:
        """(file, line, json) of these files, numbered from 1."""


@dataclass
class Folder:
    """Files below a folder on any store that Spark reads."""

    spark: SparkSession
    root: str
    pattern: str = "*.jsonl"

    def snapshot(self) -> DataFrame:
        found = archive.files(self.spark, self.root, self.pattern)
        return found.select(F.col("path").alias("file"), F.when(F.col("path").contains("/codex/"), "codex").otherwise("claude").alias("provider"), "size", "mtime_ms")

    def lines(self, files: DataFrame) -> DataFrame:
        names = [r[0] for r in files.select("file").limit(NAMED + 1).collect()]
        if not names:
            return self.spark.createDataFrame([], "file string, line int, json string")
        if len(names) <= NAMED:
            return archive.lines(self.spark, names)
        return archive.lines(self.spark, self.root, self.pattern).join(files.select("file"), "file", "left_semi")


def identified(files: DataFrame, known: DataFrame, source: Source) -> DataFrame:
    """``files`` with the session that each belongs to: by its path, by the manifest, or by its header.

    A file that names no session stands for itself.
    """
    named = files.withColumn("session_id", archive_kind(F.col("file"))[0]).join(known.select("file", F.col("session_id").alias("__known")), "file", "left")
    named = named.withColumn("session_id", F.coalesce("session_id", "__known")).drop("__known")
    loose = named.filter(F.col("session_id").isNull() & (F.col("provider") == "codex"))
    told = archive.headers(source.lines(loose)).select("file", F.col("session_id").alias("__told"))
    return named.join(told, "file", "left").withColumn("session_id", F.coalesce("session_id", "__told", "file")).drop("__told")


def touched(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """(provider, session_id) with a file that is new, changed or gone."""
    action = incremental.manifest_diff(now.withColumn("meta", F.col("session_id")), manifest.withColumn("meta", F.col("session_id")), ["file"])
    changed = action.filter("action <> 'keep'").select("file")
    both = now.select("file", "provider", "session_id").unionByName(manifest.select("file", "provider", "session_id"))
    return both.join(changed, "file", "left_semi").select("provider", "session_id").distinct()


def refresh(store: Store, source: Source, owners: DataFrame, upstreams: DataFrame | None = None, note: dict | None = None, keep_lines: bool = False) -> Snapshot:
    """Commit the tables of the source as it is now; the same version if nothing changed.

    ``keep_lines`` adds the table ``archive``, a copy of every readable session's files by line, in step with the others.
    """
    base = store.snapshot()
    spark = store.spark
    manifest = base.table(MANIFEST)
    if manifest is None:
        manifest = spark.createDataFrame([], MANIFEST_COLUMNS)
    found = materialize(source.snapshot(), "found")
    now = materialize(identified(found, manifest, source), "now")
    sessions = materialize(touched(now, manifest), "touched")
    if sessions.isEmpty():
        return base
    key = ["provider", "session_id"]
    batch = materialize(now.join(sessions, key, "left_semi"), "batch")
    # files go on growing: one copy of each is what all tables are made of
    whole = materialize(batch.select("provider", "session_id", "file").join(source.lines(batch), "file"), "lines")
    there = [r[0] for r in batch.select("provider").distinct().collect()]
    of = lambda rows, *columns: {p: rows.filter(F.col("provider") == p).select(*columns) for p in there}
    tables = assemble.all_tables(of(batch, "file", "size", "mtime_ms"), owners, upstreams, of(whole, "file", "line", "json")) if there else {}
    skipped = materialize(tables.pop("skipped"), "skipped") if there else spark.createDataFrame([], "file string, reason string")
    listed = batch.join(skipped, "file", "left").select(*(c.split()[0] for c in MANIFEST_COLUMNS.split(", ")))
    # a session keeps its rows if it has files and none of them can be read
    failed = listed.groupBy(*key).agg(F.bool_and(F.col("reason").isNotNull()).alias("all")).filter("all").select(*key)
    replaced = sessions.join(failed, key, "left_anti")
    dead = sessions.select(F.lit(MANIFEST).alias("what"), *key).unionByName(replaced.select(F.lit("rows").alias("what"), *key)) if base.runs else None
    old = base.table("sessions")
    if old is not None and there:
        tables["sessions"] = incremental.keep_share_state(tables["sessions"], old)
    if keep_lines:
        tables["archive"] = whole.join(replaced, key, "left_semi").select("provider", "session_id", "file", "line", "json")
    size = batch.agg(F.sum("size")).first()[0] or 0
    done = store.append({**tables, MANIFEST: listed}, dead, size, {**(note or {}), "sessions": sessions.count()}, base)
    return store.compact(done)


def watch(store: Store, source: Source, owners: DataFrame, checkpoint: str, upstreams: DataFrame | None = None, every: str = "60 seconds"):
    """Start a query that refreshes by a clock; its checkpoint counts the ticks and nothing else."""

    def tick(_: DataFrame, epoch: int) -> None:
        try:
            refresh(store, source, owners, upstreams, {"epoch": epoch})
        except Conflict:
            pass  # another refresh has come first; the next tick sees what it left

    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
