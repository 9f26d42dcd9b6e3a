"""Session files on any store that Spark reads: discovery, headers, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.ingest import archive_kind


def encoded_dir(path: str) -> str:
    """A project's folder name: its path with ``-`` for ``/``."""
    return path.replace("/", "-")


def files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, size, mtime_ms): the snapshot of every file below ``root`` whose name fits; no content is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return df.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))


def codex_files(spark: SparkSession, root: str) -> DataFrame:
    return files(spark, root, "rollout-*.jsonl")


def claude_files(spark: SparkSession, root: str, project_paths: list[str]) -> DataFrame:
    """Files of the project folders with exactly those names, at any depth below."""
    names = [encoded_dir(p) for p in project_paths]
    folder = F.regexp_extract("path", r"/projects/([^/]+)/", 1)
    return files(spark, root).filter(folder.isin(*names))


def auxiliary_files(spark: SparkSession, root: str, sessions: DataFrame) -> DataFrame:
    """Files kept beside a session that is there; orphans are left out."""
    aux = files(spark, root, "{*.jsonl,*.txt,*.meta.json}").withColumn("session_id", F.regexp_extract("path", r"/([0-9a-f-]{36})/", 1))
    return aux.filter("session_id <> ''").join(sessions.select("session_id"), "session_id", "left_semi")


def archive(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Session files with provider, id, kind and parent; and the files skipped, with a reason."""
    session, kind, parent = archive_kind(F.col("path"))
    rows = files(spark, root).withColumns({"session_id": session, "session_kind": kind, "parent_session_id": parent, "provider": F.when(F.col("path").contains("/codex/"), "codex").otherwise("claude")})
    return rows.filter("session_kind is not null"), rows.filter("session_kind is null").select("path", F.lit("not a session file").alias("reason"))


def texts(spark: SparkSession, root: str | list[str], pattern: str = "*.jsonl") -> DataFrame:
    """(file, text) of whole files below a folder, or of those named: a session's lines depend on each other."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return df.select(plain_path(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))


def lines(spark: SparkSession, root: str | list[str], pattern: str = "*.jsonl") -> DataFrame:
    """(file, line, json) of the files below a folder, or of those named: 1-based numbers, blank lines left out.

    A large file is read in splits by several tasks and is nowhere held whole. A split's rows come in order and
    know where their split starts, which is the order of the file's lines.
    """
    rows = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter=pattern, lineSep="\n")
    rows = rows.select(plain_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"), F.rtrim("value", F.lit("\r")).alias("json"))
    return rows.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("at", "k"))).filter(F.trim("json") != "").select("file", "line", "json")


def plain_path(path: Column) -> Column:
    """A file's path as it is listed, from the escaped form that rows carry."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def headers(raw: DataFrame) -> DataFrame:
    """First line of each file, of (file, text) or (file, line, json): id, folder, version, repository, and whether the id agrees with the name."""
    if "json" in raw.columns:
        raw = raw.filter("line = 1").withColumn("text", F.col("json"))
    v = F.try_parse_json(F.substring_index("text", "\n", 1))
    get = lambda p: F.try_variant_get(v, f"$.payload.{p}", "string")
    name_id = F.regexp_extract("file", r"([0-9a-f]{8}-[0-9a-f-]{27})\.jsonl$", 1)
    return raw.select("file", get("id").alias("session_id"), get("cwd").alias("cwd"), get("cli_version").alias("cli_version"), get("git.repository_url").alias("repository_url"), (get("id") == name_id).alias("id_agrees"))


def sniff_version(rows: DataFrame, within: int = 128) -> DataFrame:
    """First version in the first lines of each file; rows are (file, line, v)."""
    version = F.try_variant_get(F.col("v"), "$.version", "string")
    return rows.filter(F.col("line") <= within).groupBy("file").agg(F.min(F.when(version.isNotNull(), F.struct("line", version.alias("version")))).alias("x")).select("file", F.col("x.version").alias("version"))


