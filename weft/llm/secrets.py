"""Operator 6, secret scans: an incremental ledger of content-addressed blobs.

Every version of every path is a row with a text. Its blob is the SHA-256 of the text, so a text that
many paths or versions share is one blob. The ledger holds one row for each (blob, rule version) that
was scanned, with its findings. A scan looks up which pairs the ledger lacks, scans one copy of each
of those blobs only, appends the findings, and joins the ledger back to all paths.

Defined results: null text is the empty blob, which has no findings; repeated rows give repeated
results; an empty table gives an empty table and leaves the ledger as it was; only the named columns
are read, so other columns cannot clash; a null path is joined like any other value, by its blob.
A text goes through one shuffle, dealt by its row, and blobs with many paths are dealt out when findings
are joined back or cut out of texts, so a text with many copies makes no large group; only rows that
are equal in all columns stay together. A text is never cut, however long.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.skew import hot_keys_of, salted_join
from weft.llm.spans import digest, joined, map_texts
from weft.runtime import materialize, scratch_path, table

BASE = ("assign", "access", "hex")
RULE_VERSION = "3"
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_HINT = re.compile(r"passw|secret|token|api", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Rules the method adds to the base kinds.
RULES = (
    ("github", "gh", re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", "xox", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    # up to the first dash that starts no header such as Proc-Type: the next marker ends the scan, found or not
    ("private_key", "-----BEGIN", re.compile(r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:[^-]|-(?!----))+-----END [A-Z ]{0,24}PRIVATE KEY-----")),
    ("access_temporary", "ASIA", re.compile(r"(?<![A-Za-z0-9])ASIA[A-Z0-9]{16,}")),
    ("service_key", "sk-", re.compile(r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{16,}")),
    ("npm", "npm_", re.compile(r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{20,}")),
    ("github_fine", "github_pat_", re.compile(r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{20,}")),
    ("bearer", "earer", re.compile(r"(?<![A-Za-z])[Bb]earer\x20+[A-Za-z0-9._~+/=-]{12,}")),
    ("url_login", "://", re.compile(r"(?<=://)[^\s/:@]{1,128}:[^\s/@]{1,256}(?=@)")),
)
RANK = {k: i for i, k in enumerate([*BASE, *(r[0] for r in RULES)])}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ASSIGN_HINT.search(text):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def secret_row(text: str) -> tuple:
    base = base_spans(text)
    more = [(*m.span(), kind) for kind, hint, rule in RULES if hint in text for m in rule.finditer(text)]
    counts = [sum(k == kind for _, _, k in base) for kind in BASE]
    return *counts, digest(joined(base, RANK)), joined([*base, *more], RANK)


FIELDS = [(f"n_{k}", T.LongType()) for k in BASE] + [(c, T.StringType()) for c in ("base_sha256", "spans")]
LEDGER = "blob string, rule_version string, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none if nothing was ever written there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def unseen(history: DataFrame, ledger: DataFrame, path_col: str, text_col: str, rule_version: str) -> DataFrame:
    """(blob, text): one copy of each blob that has no row in the ledger under this rule version.

    Only digests and paths are grouped; the chosen copies are then picked out of the history by a
    semi join on the pair, so no group gathers texts.
    """
    named = history.select(
        F.col(path_col).alias("path"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("blob", F.sha2("text", 256))
    seen = ledger.filter(F.col("rule_version") == rule_version).select("blob")
    # grouped after the anti join's side is known; min over a struct keeps a null path valid
    chosen = (
        named.groupBy("blob")
        .agg(F.min(F.struct(F.col("path"))).alias("p"))
        .join(seen, "blob", "left_anti")
        .select(F.col("blob").alias("b"), F.col("p.path").alias("p"))
    )
    same = named["blob"].eqNullSafe(chosen["b"]) & named["path"].eqNullSafe(chosen["p"])
    return named.join(chosen.hint("shuffle_hash"), same, "left_semi").select("blob", "text")


def scan_history(
    history: DataFrame,
    ledger_path: str,
    path_col: str = "doc_id",
    text_col: str = "text",
    rule_version: str = RULE_VERSION,
) -> DataFrame:
    """Bring the ledger up to date with ``history`` and return the findings of every path.

    Output: ``path_col``, ``blob``, counts of the base kinds, digest of the base spans, all spans.
    """
    spark = history.sparkSession
    todo = unseen(history, ledger_at(spark, ledger_path), path_col, text_col, rule_version)
    found = map_texts(todo, ["blob"], "text", FIELDS, secret_row).withColumn("rule_version", F.lit(rule_version))
    found.select(*(c.split()[0] for c in LEDGER.split(", "))).write.mode("append").parquet(ledger_path)
    # a path with several equal rows makes several equal ledger rows; one is enough
    ledger = ledger_at(spark, ledger_path).filter(F.col("rule_version") == rule_version).dropDuplicates(["blob"])
    paths = history.select(
        F.col(path_col), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("blob")
    )
    both = salted_join(paths, ledger.drop("rule_version"), "blob", hot_keys_of(paths, "blob"), [path_col])
    return both.select(path_col, "blob", *(n for n, _ in FIELDS))


def without(text: str | None, spans: str | None, mark: str) -> str | None:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(df: DataFrame, found: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace the spans of ``found`` (blob, spans) in the texts of ``df``; other rows stay as they are.

    Only blobs with a span take part in the join, each once. Rows travel whole in one column, so that no column
    of ``df`` meets a name used here.
    """
    hits = found.filter(F.col("spans") != "").select("blob", "spans").dropDuplicates(["blob"])
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    keyed = df.select(row, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, s, mark) for t, s in zip(text, spans)], dtype=object)

    both = salted_join(keyed, hits, "blob", hot_keys_of(keyed.select("blob"), "blob"), ["row"], "left")
    text = F.when(F.col("spans").isNotNull(), cut(F.col(f"row.`{text_col}`"), "spans")).otherwise(F.col(f"row.`{text_col}`"))
    return both.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a ledger that starts empty."""
    return scan_history(table(spark, sf_dir, "documents"), scratch_path(spark, "ledger"))


def secrets_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger over three runs: the English documents, all documents, all under a second version of the rules.

    One row a run: the blobs it scanned, the blobs of its rule version that the ledger then holds, its paths, and the
    base findings of all its paths. Only the first run of a rule version over a blob scans it.
    """
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), scratch_path(spark, "ledger")
    out = None
    for run, (history, version) in enumerate(((docs.filter("lang = 'en'"), RULE_VERSION), (docs, RULE_VERSION), (docs, RULE_VERSION + "+1")), 1):
        held = ledger_at(spark, path).filter(F.col("rule_version") == version).agg(F.count(F.lit(1)).alias("held"))
        before = held.first()["held"]
        # the findings are written, as the ledger goes on growing while later runs read it
        found = materialize(scan_history(history, path, rule_version=version).drop("spans"), f"run{run}")
        after = ledger_at(spark, path).filter(F.col("rule_version") == version).count()
        sums = found.agg(F.count(F.lit(1)).alias("n_paths"), *(F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias(f"n_{k}") for k in BASE))
        counts = sums.select(F.lit(run).alias("run"), F.lit(after - before).cast("long").alias("scanned"), F.lit(after).cast("long").alias("in_ledger"), "*")
        out = counts if out is None else out.unionByName(counts)
    return out


INCREMENTAL_SQL = r"""
WITH d AS (SELECT lang, coalesce(text, '') AS text FROM documents),
n AS (SELECT lang, sha256(text) AS blob,
  len(list_filter(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: length(v) >= 6)) AS assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20)) AS access,
  len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda v: length(v) >= 24)) AS hex FROM d),
english AS (SELECT DISTINCT blob FROM n WHERE lang = 'en'),
s AS (SELECT (SELECT count(*) FROM english) AS first, (SELECT count(DISTINCT blob) FROM n) AS every)
SELECT run, CASE run WHEN 1 THEN first WHEN 2 THEN every - first ELSE every END AS scanned, CASE run WHEN 1 THEN first ELSE every END AS in_ledger,
  count(*) AS n_paths, sum(assign)::BIGINT AS n_assign, sum(access)::BIGINT AS n_access, sum(hex)::BIGINT AS n_hex
FROM n, s, (SELECT unnest([1, 2, 3])::INTEGER AS run) WHERE run > 1 OR lang = 'en' GROUP BY run, first, every
"""
