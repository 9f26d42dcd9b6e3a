"""Refresh of stored tables: changed and gone files, commits, runs, and what readers see meanwhile."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from weft.streaming import store as store_module
from weft.streaming.refresh import Folder, refresh, watch
from weft.streaming.store import MANIFEST, Conflict, Store

OWNERS = [("/w", "p1")]


def lines(session, *turns, cwd="/w/p"):
    at = "2026-04-01T00:00:{:02d}Z".format
    rows = []
    for k, (ask, answer) in enumerate(turns):
        one = lambda kind, content, **more: json.dumps({"type": kind, "sessionId": session, "cwd": cwd, "version": "2.1.87", "timestamp": at(k), "message": {"role": kind, "content": content, **more}})  # noqa: B023, E731
        rows += [one("user", ask), one("assistant", [{"type": "text", "text": answer}], stop_reason="end_turn")]
    return "\n".join(rows)


class Files:
    """A folder of session files, times of their own so that no change goes unseen."""

    def __init__(self, root):
        self.root, self.clock = root, 1_700_000_000

    def put(self, session, *turns, text=None):
        path = self.root / "claude" / session / f"{session}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(lines(session, *turns) if text is None else text)
        self.clock += 10
        os.utime(path, (self.clock, self.clock))

    def drop(self, session):
        (self.root / "claude" / session / f"{session}.jsonl").unlink()


@pytest.fixture
def files(tmp_path):
    return Files(tmp_path / "src 1")


@pytest.fixture
def owners(spark):
    return spark.createDataFrame(OWNERS, "root string, project_id string")


def told(snapshot, name="turns"):
    rows = snapshot.table(name)
    return sorted((r.session_id, r.turn_ordinal, r.user_message) for r in rows.collect())


def test_files_that_are_new_grow_break_and_go(spark, tmp_path, files, owners):
    files.put("s1", ("a", "b"))
    files.put("s2", ("c", "d"))
    store, source = Store(spark, str(tmp_path / "store")), Folder(spark, str(files.root))
    one = refresh(store, source, owners, keep_lines=True)
    assert (one.version, told(one)) == (1, [("s1", 1, "a"), ("s2", 1, "c")])
    assert refresh(store, source, owners).version == 1  # nothing changed, nothing is written
    files.put("s1", ("a", "b"), ("e", "f"))
    files.put("s3", ("g", "h"))
    two = refresh(Store(spark, str(tmp_path / "store")), source, owners, keep_lines=True)  # another process, nothing but the store
    assert told(two) == [("s1", 1, "a"), ("s1", 2, "e"), ("s2", 1, "c"), ("s3", 1, "g")] and two.note["sessions"] == 2
    kept = two.table("archive").groupBy("session_id").agg(F.max("line").alias("n"), F.count(F.lit(1)).alias("k"))
    assert sorted(map(tuple, kept.collect())) == [("s1", 4, 4), ("s2", 2, 2), ("s3", 2, 2)]
    files.put("s2", text="{")
    files.drop("s3")
    three = refresh(store, source, owners)
    assert told(three) == [("s1", 1, "a"), ("s1", 2, "e"), ("s2", 1, "c")]  # what can't be read keeps its rows, what is gone loses them
    assert sorted((r.session_id, r.reason) for r in three.table(MANIFEST).collect()) == [("s1", None), ("s2", "line 1 is not JSON")]
    assert refresh(store, source, owners).version == 3
    files.put("s2", ("i", "j"))
    four = refresh(store, source, owners)
    assert told(four)[-1] == ("s2", 1, "i") and told(one) == [("s1", 1, "a"), ("s2", 1, "c")]  # a reader of version 1 still has it
    assert sorted(r.user_message_text for r in four.table("turn_search").collect()) == ["a", "e", "i"]
    assert told(four.store.snapshot(2)) == told(two)
    for s in ("s1", "s2"):
        files.drop(s)
    assert told(refresh(store, source, owners)) == []


def test_a_crash_between_two_tables_shows_neither(spark, tmp_path, files, owners, monkeypatch):
    files.put("s1", ("a", "b"))
    store, source = Store(spark, str(tmp_path / "store")), Folder(spark, str(files.root))
    refresh(store, source, owners)
    files.put("s1", ("x", "y"))
    whole, written = store_module.Store.write, []

    def broken(self, tables, dead, size, version, level=0):
        some = dict(list(tables.items())[:2])
        written.extend(some)
        whole(self, some, dead, size, version, level)
        raise OSError("disk gone")

    monkeypatch.setattr(store_module.Store, "write", broken)
    with pytest.raises(OSError):
        refresh(store, source, owners)
    assert len(written) == 2 and store.versions() == [1] and told(store.snapshot()) == [("s1", 1, "a")]
    monkeypatch.undo()
    assert told(refresh(store, source, owners)) == [("s1", 1, "x")]
    assert store.vacuum(keep=1) and told(store.snapshot()) == [("s1", 1, "x")] and store.versions() == [2]


def test_two_writers_make_no_version_twice(spark, tmp_path):
    store, rows = Store(spark, str(tmp_path)), spark.createDataFrame([("c", "s", 1)], "provider string, session_id string, v long")
    base = store.snapshot()
    store.append({"t": rows}, None, 1, {}, base)
    with pytest.raises(Conflict):
        store.append({"t": rows}, None, 1, {}, base)
    assert store.versions() == [1] and store.snapshot().table("t").count() == 1


def test_runs_are_merged_and_bytes_follow_the_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path), fan=3)
    rows = lambda v, ids: spark.createDataFrame([("c", f"s{i}", k, f"{v} " * 50) for i in ids for k in range(3)], "provider string, session_id string, turn_ordinal long, v string")
    dead = lambda ids: spark.createDataFrame([("rows", "c", f"s{i}") for i in ids], store_module.DEAD)
    size = lambda: sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    snapshot = store.append({"t": rows(0, range(2000))}, None, 1 << 20, {})
    whole, want = size(), {f"s{i}": "0 " * 50 for i in range(2000)}
    for v in range(1, 8):
        before = size()
        ids = [v, v + 1, 5000 + v]
        gone = [100 + v]
        snapshot = store.append({"t": rows(v, ids)}, dead(ids + gone), 100, {})
        assert size() - before < 0.2 * whole
        want |= {f"s{i}": f"{v} " * 50 for i in ids}
        want.pop(f"s{100 + v}")
        got = {(r.session_id, r.turn_ordinal): r.v for r in snapshot.table("t").collect()}
        assert got == {(s, k): x for s, x in want.items() for k in range(3)}
        snapshot = store.compact(snapshot)
        assert {(r.session_id, r.turn_ordinal): r.v for r in snapshot.table("t").collect()} == got
    assert len(snapshot.runs) < 6 and any(r["level"] for r in snapshot.runs)
    assert [r.v for r in snapshot.table("t", "c", "s3").collect()] == ["3 " * 50] * 3 and snapshot.table("t", "c", "s101").count() == 0


def test_one_session_is_read_from_its_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path), bucket=10)
    rows = spark.createDataFrame([("c", f"s{i}", 1) for i in range(400)], "provider string, session_id string, turn_ordinal long")
    snapshot = store.append({"t": rows}, None, 80, {})
    one = snapshot.table("t", "c", "s7")
    assert one.count() == 1 and snapshot.runs[0]["tables"]["t"]["buckets"] == 8
    assert len(one.inputFiles()) == 8 and one.select(F.input_file_name()).distinct().count() == 1
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in text


def test_a_bundle_reads_one_version(spark, tmp_path, files, owners):
    from weft.operators.turns import bundle

    files.put("s1", ("a", "b"))
    store, source = Store(spark, str(tmp_path / "store")), Folder(spark, str(files.root))
    held = refresh(store, source, owners)
    files.put("s1", ("a", "b"), ("c", "d"))
    refresh(store, source, owners)
    key = {"project_id": "p1", "provider": "claude", "session_id": "s1"}
    of = lambda snapshot: [x.count() for x in bundle(*(snapshot.table(n, "claude", "s1") for n in ("sessions", "turns", "file_accesses")), key)]
    assert of(held) == [1, 1, 0] and of(store.snapshot()) == [1, 2, 0]


def test_watch_follows_a_clock(spark, tmp_path, files, owners):
    files.put("s1", ("a", "b"))
    store = Store(spark, str(tmp_path / "store"))
    for checkpoint, text in (("c1", "a"), ("c2", "z")):  # a new checkpoint loses nothing
        files.put("s1", (text, "b"))
        query = watch(store, Folder(spark, str(files.root)), owners, str(tmp_path / checkpoint), every="1 second")
        end = time.time() + 120
        while time.time() < end and not (store.versions() and told(store.snapshot()) == [("s1", 1, text)]):
            time.sleep(0.5)
        query.stop()
        assert told(store.snapshot()) == [("s1", 1, text)]


def test_lines_of_files_that_are_read_in_splits(spark, tmp_path):
    from weft.operators import ingest
    from weft.sources import archive

    for name, n in (("a 1", 400), ("b", 1), ("c", 0)):
        (tmp_path / f"{name}.jsonl").write_bytes(b"".join(b"%d %s\r\n%s" % (k, b"x" * (k % 37), b"\n" if k % 50 == 7 else b"") for k in range(n)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = archive.lines(spark, str(tmp_path))
        got = {(r.file, r.line): r.json for r in rows.collect()}
        parts = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert parts > 5 and got == {(r.file, r.line): r.json for r in ingest.lines(archive.texts(spark, str(tmp_path))).collect()} and len(got) == 401


def test_sessions_are_found_by_time_and_tool(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "INDEX_ROWS", 50)
    store = Store(spark, str(tmp_path), bucket=10, fan=100)
    time_of = "2026-01-{:02d}T00:00:00Z".format
    turns = lambda ids, day: spark.createDataFrame([("c", f"s{i}", k, time_of(day(i))) for i in ids for k in range(2)], "provider string, session_id string, turn_ordinal long, started_at string")
    calls = spark.createDataFrame([("c", f"s{i}", 1, "Read" if i % 50 else "Rare") for i in range(400)], "provider string, session_id string, turn_ordinal long, tool_name string")
    one = store.append({"turns": turns(range(400), lambda i: 1 + i // 20), "tool_calls": calls}, None, 160, {})
    dead = spark.createDataFrame([("rows", "c", "s45"), ("rows", "c", "s399")], store_module.DEAD)
    two = store.append({"turns": turns([45], lambda i: 25)}, dead, 10, {})
    every = len(two.index_parts("turns", "started_at"))
    some = two.index_parts("turns", "started_at", time_of(3), time_of(3))
    assert every >= 9 and len(some) <= 2  # a fraction of the parts can hold the day
    day = two.rows_where("turns", "started_at", time_of(3), time_of(3))
    assert sorted({r.session_id for r in day.collect()}) == sorted(f"s{i}" for i in range(40, 60) if i != 45)
    assert sorted({r.session_id for r in one.rows_where("turns", "started_at", time_of(3), time_of(3)).collect()}) == sorted(f"s{i}" for i in range(40, 60))
    assert sorted({r.session_id for r in two.rows_where("turns", "started_at", time_of(20)).collect()}) == sorted([*(f"s{i}" for i in range(380, 399)), "s45"])
    rare = two.sessions_where("tool_calls", "tool_name", "Rare", "Rare")
    assert sorted(r.session_id for r in rare.collect()) == sorted(f"s{i}" for i in range(0, 400, 50))
    read = two.table("turns", keys=rare)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and one.runs[0]["tables"]["turns"]["buckets"] == 16 and read.count() == 16
    assert two.rows_where("turns", "started_at", "2027").count() == 0 and two.rows_where("nothing", "x") is None
    merged = store.merge(two, 0)
    assert sorted({r.session_id for r in merged.rows_where("turns", "started_at", time_of(25)).collect()}) == ["s45"]
