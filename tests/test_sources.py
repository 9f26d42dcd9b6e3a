"""Session files in a folder: discovery, kinds, headers, versions."""

import json

from pyspark.sql import functions as F

from weft.operators import ingest
from weft.sources import archive

UUID = "01234567-89ab-cdef-0123-456789abcdef"


def write(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_archive_headers_and_versions(spark, tmp_path):
    head = {"type": "session_meta", "payload": {"id": UUID, "cwd": "/w", "cli_version": "0.40.0", "git": {"repository_url": "u"}}}
    write(tmp_path / f"codex/rollout-2024-{UUID}.jsonl", head, {"type": "x"})
    write(tmp_path / "codex/other.jsonl", head)
    write(tmp_path / "claude/s1/s1.jsonl", {"type": "user"}, {"type": "user", "version": "2.0.1"}, {"version": "2.0.2"})
    write(tmp_path / "claude/s1/subagents/a.jsonl", {"type": "user"})
    good, skipped = archive.archive(spark, str(tmp_path))
    rows = {r.session_id: (r.provider, r.session_kind, r.parent_session_id, r["size"] > 0, r.mtime_ms > 0) for r in good.collect()}
    assert rows == {UUID: ("codex", "primary", None, True, True), "s1": ("claude", "primary", None, True, True), "s1/subagents/a": ("claude", "subagent", "s1", True, True)}
    assert [r.reason for r in skipped.collect()] == ["not a session file"]
    assert archive.codex_files(spark, str(tmp_path)).count() == 1
    raw = archive.texts(spark, str(tmp_path))
    found = archive.headers(raw.filter(F.col("file").contains("rollout-"))).first()
    assert (found.session_id, found.cwd, found.cli_version, found.repository_url, found.id_agrees) == (UUID, "/w", "0.40.0", "u", True)
    parsed, _ = ingest.quarantine(ingest.lines(raw))
    versions = {r.file.rsplit("/", 1)[-1]: r.version for r in archive.sniff_version(parsed).collect()}
    assert versions["s1.jsonl"] == "2.0.1" and versions["a.jsonl"] is None
    assert archive.encoded_dir("/w/repo") == "-w-repo"


def test_project_folders_match_by_whole_name(spark, tmp_path):
    write(tmp_path / "projects/-w-repo/s.jsonl", {})
    write(tmp_path / "projects/-w-repo2/s.jsonl", {})
    assert archive.claude_files(spark, str(tmp_path), ["/w/repo"]).count() == 1


def test_auxiliary_files_need_their_session(spark, tmp_path):
    write(tmp_path / f"{UUID}/tool.txt", {})
    write(tmp_path / "99999999-89ab-cdef-0123-456789abcdef/tool.txt", {})
    have = spark.createDataFrame([(UUID,)], "session_id string")
    assert [r.session_id for r in archive.auxiliary_files(spark, str(tmp_path), have).collect()] == [UUID]
