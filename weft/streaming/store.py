"""All tables of the library as one versioned store: runs of rows, tombstones by session, and a log of commits.

A commit names the runs that make up every table, so one number is one state of all of them. A run is what
one refresh wrote: the new rows of each table, and the sessions whose older rows they replace. Rows are alive
unless a later run buries their session, which is decided when they are read. So a refresh writes as much as
its batch holds; runs of one size are merged later, FAN at a time, each row about once a size.

Data are written under names of their own and a commit is one small file that is renamed into the log, so a
crash at any moment leaves the state before it, and two writers can't both make the same version. Readers
hold a version; what it names stays until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of source a bucket; runs of one level that are merged; turns of a session that one task writes.
BUCKET, FAN, BLOCK = 512 << 20, 8, 4096
DEAD = "what string, provider string, session_id string"
#: Columns by whose value or range sessions are found without their tables, and keys of an index part.
INDEXES = {"turns": ("started_at",), "tool_calls": ("tool_name",), "file_accesses": ("file_name",)}
INDEX_ROWS = 1_000_000


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


def bucket_of(provider: Column, session_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(provider, session_id), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Snapshot:
    """The tables as of one version."""

    store: Store
    version: int
    runs: tuple[dict, ...]
    note: dict

    def tables(self) -> list[str]:
        return sorted({name for r in self.runs for name in r["tables"]})

    def dead(self, what: str, from_: int = 0) -> DataFrame | None:
        """(provider, session_id, __buried): the last version that buries each session's rows."""
        spark, parts = self.store.spark, [r for r in self.runs if r["dead"] and r["version"] > from_]
        if not parts:
            return None
        each = [spark.read.schema(DEAD).parquet(f"{self.store.root}/{r['dead']}").withColumn("__buried", F.lit(r["version"])) for r in parts]
        both = each[0]
        for e in each[1:]:
            both = both.unionByName(e)
        return both.filter(F.col("what") == what).groupBy("provider", "session_id").agg(F.max("__buried").alias("__buried"))

    def index_parts(self, name: str, column: str, low=None, high=None) -> list[str]:
        """Paths of the index parts whose range meets ``low <= value <= high``; an open end is None."""
        out = []
        for r in self.runs:
            by = r["tables"].get(name, {}).get("by", {}).get(column)
            for file, least, most in by["parts"] if by else []:
                if (low is None or most >= low) and (high is None or least <= high):
                    out.append(f"{self.store.root}/{by['path']}/{file}")
        return out

    def sessions_where(self, name: str, column: str, low=None, high=None) -> DataFrame | None:
        """(provider, session_id) of the sessions that have, or had, a row with ``low <= column <= high``; None if there is no such part."""
        parts = self.index_parts(name, column, low, high)
        if not parts:
            return None
        rows = self.store.spark.read.parquet(*parts)
        for bound, hit in ((low, F.col(column) >= low), (high, F.col(column) <= high)):
            rows = rows.filter(hit) if bound is not None else rows
        return rows.select("provider", "session_id").distinct()

    def rows_where(self, name: str, column: str, low=None, high=None) -> DataFrame | None:
        """Live rows with ``low <= column <= high``, from the buckets of their sessions alone; None if no run has the table."""
        keys = self.sessions_where(name, column, low, high)
        rows = self.table(name, keys=keys) if keys is not None else self.table(name)
        if rows is None:
            return None
        if keys is None:
            return rows.limit(0)
        for bound, hit in ((low, F.col(column) >= low), (high, F.col(column) <= high)):
            rows = rows.filter(hit) if bound is not None else rows
        return rows

    def table(self, name: str, provider: str | None = None, session_id: str | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        """A table's live rows; given a session or ``keys`` of several, only the buckets that can hold them are read.

        None if no run has the table.
        """
        parts = []
        for r in self.runs:
            if name not in r["tables"]:
                continue
            held = r["tables"][name]
            schema = T.StructType.fromJson(json.loads(held["schema"])).add("bucket", T.IntegerType())
            rows = self.store.spark.read.schema(schema).parquet(f"{self.store.root}/{held['path']}")
            if provider is not None and session_id is not None:
                at = bucket_of(F.lit(provider), F.lit(session_id), held["buckets"])
                rows = rows.filter((F.col("bucket") == at) & (F.col("provider") == provider) & (F.col("session_id") == session_id))
            if keys is not None:
                at = keys.select(bucket_of(F.col("provider"), F.col("session_id"), held["buckets"]).alias("b")).distinct()
                some = [b[0] for b in at.collect()] if held["buckets"] > 1 else [0]  # a row a bucket
                rows = rows.filter(F.col("bucket").isin(some)).join(keys, ["provider", "session_id"], "left_semi").select(*schema.fieldNames())
            parts.append((r["version"], rows.drop("bucket")))
        if not parts:
            return None
        oldest = min(v for v, _ in parts)
        dead = self.dead(MANIFEST if name == MANIFEST else "rows", oldest)
        if dead is None:
            return parts[0][1] if len(parts) == 1 else self.union(parts).drop("__version")
        # in the newest run nothing is buried
        newest = [p for p in parts if p[0] == self.runs[-1]["version"]]
        older = [p for p in parts if p[0] != self.runs[-1]["version"]]
        alive = []
        if older:
            met = self.union(older).join(dead, ["provider", "session_id"], "left")
            alive.append(met.filter(F.col("__buried").isNull() | (F.col("__buried") <= F.col("__version"))).drop("__buried", "__version"))
        alive += [rows for _, rows in newest]
        return alive[0] if len(alive) == 1 else alive[0].unionByName(alive[1], allowMissingColumns=True)

    @staticmethod
    def union(parts: list[tuple[int, DataFrame]]) -> DataFrame:
        out = None
        for version, rows in parts:
            rows = rows.withColumn("__version", F.lit(version))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out


#: The table of source files, whose rows are buried apart from those of the sessions that they hold.
MANIFEST = "manifest"


class Store:
    """A store below ``root``, on any file system that Spark writes."""

    def __init__(self, spark: SparkSession, root: str, bucket: int = BUCKET, fan: int = FAN):
        self.spark, self.root, self.bucket, self.fan = spark, root.rstrip("/"), bucket, fan
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # --- the log

    def versions(self) -> list[int]:
        at = self.path("log")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The tables as of a version, the last one if none is named; version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Snapshot(self, 0, (), {})
        stream = self.fs.open(self.path(f"log/{version:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        state = json.loads(text)
        return Snapshot(self, version, tuple(state["runs"]), state["note"])

    def commit(self, base: Snapshot, runs: list[dict], note: dict) -> Snapshot:
        """Make the version after ``base``; Conflict if someone else has."""
        version, tmp = base.version + 1, self.path(f"log/.{uuid.uuid4().hex}")
        done = self.path(f"log/{version:020d}.json")
        out = self.fs.create(tmp, False)
        out.write(json.dumps({"runs": runs, "note": note}).encode())
        out.close()
        if self.fs.exists(done) or not self.fs.rename(tmp, done):
            self.fs.delete(tmp, False)
            raise Conflict(f"version {version} is there already")
        return Snapshot(self, version, tuple(runs), note)

    # --- runs

    def write(self, tables: dict[str, DataFrame], dead: DataFrame | None, size: int, version: int, level: int = 0) -> dict:
        """Write rows and tombstones of one run; nothing names them before a commit."""
        name, buckets = f"runs/{uuid.uuid4().hex}", max(1, -(-size // self.bucket))
        held = {}
        for table, rows in tables.items():
            block = F.floor(F.col("turn_ordinal") / BLOCK) if "turn_ordinal" in rows.columns else F.lit(0)
            order = [c for c in ("provider", "session_id", "turn_ordinal") if c in rows.columns]
            # long sessions are dealt to several tasks, short ones of a bucket stay together
            dealt = rows.withColumns({"bucket": bucket_of(F.col("provider"), F.col("session_id"), buckets), "__block": block})
            dealt = dealt.repartition(buckets, "bucket", "__block").drop("__block").sortWithinPartitions("bucket", *order)
            dealt.write.partitionBy("bucket").parquet(f"{self.root}/{name}/{table}")
            by = {c: self.indexed(rows.schema, f"{name}/{table}", c) for c in INDEXES.get(table, ()) if c in rows.columns}
            held[table] = {"path": f"{name}/{table}", "buckets": buckets, "schema": rows.schema.json(), "by": by}
        if dead is not None:
            dead.coalesce(max(1, buckets // 16)).write.parquet(f"{self.root}/{name}/dead")
        return {"version": version, "level": level, "size": size, "tables": held, "dead": f"{name}/dead" if dead is not None else None}

    def indexed(self, schema: T.StructType, at: str, column: str) -> dict:
        """Write (value, session) pairs of a written table in ranges of the value; their parts and what each spans."""
        pairs = self.spark.read.schema(schema).parquet(f"{self.root}/{at}").select(column, "provider", "session_id").filter(F.col(column).isNotNull()).distinct()
        parts, path = max(1, -(-pairs.count() // INDEX_ROWS)), f"{at}.by_{column}"
        order = [column, "provider", "session_id"]
        pairs.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(f"{self.root}/{path}")
        spans = self.spark.read.schema(pairs.schema).parquet(f"{self.root}/{path}").groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min(column).alias("a"), F.max(column).alias("b"))
        return {"path": path, "parts": [[r["f"], r["a"], r["b"]] for r in spans.orderBy("f").collect()]}  # a row a part

    def append(self, tables: dict[str, DataFrame], dead: DataFrame | None, size: int, note: dict, base: Snapshot | None = None) -> Snapshot:
        """Commit ``tables`` over the rows of the sessions that ``dead`` (see DEAD) names."""
        base = base or self.snapshot()
        return self.commit(base, [*base.runs, self.write(tables, dead, size, base.version + 1)], note)

    def compact(self, base: Snapshot | None = None) -> Snapshot:
        """Merge the newest FAN runs of one level, if there are so many, into one of the next."""
        base = base or self.snapshot()
        runs, level = list(base.runs), base.runs[-1]["level"] if base.runs else 0
        tail = 0
        while tail < len(runs) and runs[-1 - tail]["level"] <= level:
            tail += 1
        if tail < self.fan:
            return base
        return self.compact(self.merge(base, len(runs) - tail))

    def merge(self, base: Snapshot, first: int) -> Snapshot:
        """Commit a version in which the runs from number ``first`` on are one."""
        runs = list(base.runs)
        mine = Snapshot(self, base.version, tuple(runs[first:]), {})
        tables = {name: mine.table(name) for name in mine.tables()}
        dead = None
        if first:  # older runs still hold rows that these bury
            buried = [d.select(F.lit(what).alias("what"), "provider", "session_id") for what in ("rows", MANIFEST) if (d := mine.dead(what)) is not None]
            for d in buried:
                dead = d if dead is None else dead.unionByName(d)
        one = self.write(tables, dead, sum(r["size"] for r in runs[first:]), runs[-1]["version"], runs[-1]["level"] + 1)
        return self.commit(base, [*runs[:first], one], {**base.note, "merged": len(runs) - first})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete runs and commits that none of the last ``keep`` versions names; their folders' names."""
        versions = self.versions()
        kept = {t["path"].split("/")[1] for v in versions[-keep:] for r in self.snapshot(v).runs for t in r["tables"].values()}
        at, gone = self.path("runs"), []
        for s in self.fs.listStatus(at) if self.fs.exists(at) else []:
            if s.getPath().getName() not in kept:
                self.fs.delete(s.getPath(), True)
                gone.append(s.getPath().getName())
        for v in versions[:-keep]:
            self.fs.delete(self.path(f"log/{v:020d}.json"), False)
        return gone
