"""Sharing: which sessions leave, in what form and chunks, and what is taken in."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.redact import redact_steps, redact_text
from weft.schema import SESSION_KEY, TURN_KEY

SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._/-]{0,199}$"
CHUNK = 64 << 20


def selected(sessions: DataFrame, policies: DataFrame, turns: DataFrame) -> DataFrame:
    """Local sessions with turns and a safe id that are included, or not excluded where the project shares all."""
    p = policies.select("project_id", "default_policy")
    rows = sessions.filter("origin_kind = 'local'").join(p, "project_id", "left")
    rows = rows.filter((F.col("share_state") == "included") | ((F.coalesce("default_policy", F.lit("manual")) == "all") & (F.col("share_state") != "excluded")))
    rows = rows.filter(F.col("session_id").rlike(SAFE_ID) & ~F.col("session_id").contains(".."))
    return rows.join(turns.select(*SESSION_KEY).distinct(), SESSION_KEY, "left_semi").drop("default_policy")


def status(sessions: DataFrame) -> DataFrame:
    """One row: sessions by share state and origin; zeros for an empty table."""
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    local = F.col("origin_kind") == "local"
    return sessions.agg(
        n(local & (F.col("share_state") == "included")).alias("included"),
        n(local & (F.col("share_state") == "excluded")).alias("excluded"),
        n(local & (F.col("share_state") == "unset")).alias("unset"),
        n(~local).alias("shared"),
        F.count(F.lit(1)).alias("total"),
    )


def export(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Turns of the selected sessions, texts and steps redacted once more, each with the hash of its content."""
    rows = turns.join(sessions.select(*SESSION_KEY), SESSION_KEY, "left_semi")
    for c in ("user_message", "final_answer_text"):
        rows = rows.withColumn(c, redact_text(F.col(c)))
    if "steps" in rows.columns:
        rows = rows.withColumn("steps", redact_steps(F.col("steps")))
    content = F.to_json(F.struct(*rows.columns))
    return rows.withColumn("content_sha256", F.sha2(content, 256)).withColumn("bytes", F.octet_length(content).cast("long"))


def chunks(rows: DataFrame, size: str, order: list[str], by: list[str], limit: int = CHUNK) -> DataFrame:
    """``chunk`` numbers in order, cut before a chunk would pass ``limit``; a larger row is a chunk of its own.

    Greedy packing within each group of ``by``: a group's rows stream by in order, and a task holds one
    batch and the running size, however long the group is.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("chunk", T.IntegerType())])
    names, at = rows.columns, rows.columns.index(size)
    keys = [names.index(c) for c in by]

    def run(batches):
        group, chunk, held = None, -1, 0
        for b in batches:
            out = []
            for s, key in zip(b.column(at).to_pylist(), zip(*(b.column(k).to_pylist() for k in keys))):
                if key != group:
                    group, chunk, held = key, -1, 0
                if chunk >= 0 and held + s <= limit:
                    held += s
                else:
                    chunk, held = chunk + 1, s
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*names, "chunk"])

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def same_export(before: DataFrame, after: DataFrame, key: list[str]) -> bool:
    """Whether two exports hold the same keys and hashes: nothing is written then."""
    a, b = (d.select(*key, "content_sha256") for d in (before, after))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def take_in(incoming: DataFrame, sessions: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """Turns to accept, and those rejected with a reason: bad ids or times, a foreign owner, or a local session."""
    local = sessions.filter("origin_kind = 'local'").select(*SESSION_KEY, F.lit(True).alias("__local"))
    theirs = sessions.filter("origin_kind = 'shared'").select(*SESSION_KEY, F.col("origin_user_id").alias("__owner"))
    rows = incoming.join(local, SESSION_KEY, "left").join(theirs, SESSION_KEY, "left")
    reason = (
        F.when(~F.coalesce(F.col("session_id").rlike(SAFE_ID), F.lit(False)), "session id")
        .when(F.try_to_timestamp("started_at").isNull(), "start time")
        .when(F.col("origin_user_id") != owner, "author")
        .when(F.col("__local"), "local session")
        .when(F.col("__owner") != owner, "owner")
    )
    rows = rows.withColumn("reason", reason).drop("__local", "__owner")
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").select(*TURN_KEY, "reason")


def check_manifest(entries: list[dict], most: int = 10_000, most_bytes: int = 256 << 20) -> None:
    """Raises unless a manifest's chunks are few, small and safely named."""
    if len(entries) > most:
        raise ValueError("the manifest lists too many chunks")
    for e in entries:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*(/[A-Za-z0-9][A-Za-z0-9._-]*)*", e["path"]) or ".." in e["path"]:
            raise ValueError(f"unsafe path: {e['path']}")
        if not 0 <= e["bytes"] <= most_bytes:
            raise ValueError(f"chunk of {e['bytes']} bytes")
