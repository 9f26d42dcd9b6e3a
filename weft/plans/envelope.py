"""What a caller sees: result envelopes, errors with codes, project settings, and the refresh lock."""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import os
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame

from weft.functions.text import path_hash, slug

VERSION = 1


#: The codes that callers may rely on.
CODES = (
    "invalid_arguments", "missing_required_identity", "conflicting_identity_arguments", "status_check_failed",
    "invalid_session_id", "unknown_session", "ambiguous_session",
)
#: A canonical UUID, or the start of one.
UUID = "xxxxxxxx-xxxx-xxxx-xxxx-xxxxxxxxxxxx"


def session_id_shape(text: str) -> str:
    """``full``, ``prefix`` or ``invalid``, by how the text fits a UUID from its start."""
    fits = 0 < len(text) <= len(UUID) and all(c == "-" if u == "-" else c in "0123456789abcdefABCDEF" for c, u in zip(text, UUID))
    return "invalid" if not fits else "full" if len(text) == len(UUID) else "prefix"


def checked_session_id(text: str | None, prefix: bool = False) -> str:
    """The id; an error with its code where none is given or the shape is wrong."""
    if not text:
        raise QueryError("missing_required_identity", "a session id is needed")
    shape = session_id_shape(text)
    if shape == "invalid" or (shape == "prefix" and not prefix):
        raise QueryError("invalid_session_id", f"not a session id: {text}", session=text)
    return text


class QueryError(Exception):
    """An error with a stable code and details."""

    def __init__(self, code: str, message: str, **details):
        super().__init__(message)
        self.code, self.details = code, details

    def envelope(self) -> dict:
        return {"schema": "error", "version": VERSION, "error": {"code": self.code, "message": str(self), "details": self.details}}


def envelope(schema: str, page: DataFrame, limit: int, **extra) -> dict:
    """A page of rows, read with one row more than ``limit`` to tell whether more follow."""
    rows = [r.asDict(True) for r in page.limit(limit + 1).collect()]
    now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"schema": schema, "generated_at": now, "version": VERSION, "data": {**extra, "limit": limit, "has_more": len(rows) > limit, "rows": rows[:limit]}}


def one_session(matches: list, text: str, across_providers: bool = False, truncated: bool = False):
    """The only session among ``matches`` (rows with SESSION_KEY); an error that says why there is none.

    A search filter tolerates one id under several providers (``across_providers``): the first stands for all.
    """
    if not matches:
        raise QueryError("unknown_session", f"no session matches {text}", session=text, looks_like_prefix=session_id_shape(text) == "prefix")
    ids = {m["session_id"] for m in matches}
    if len(matches) > 1 and not (across_providers and len(ids) == 1):
        raise QueryError("ambiguous_session", f"several sessions match {text}", query=text, matches=[list(m) for m in matches], truncated=truncated)
    return matches[0]


@dataclass(frozen=True)
class Project:
    id: str
    name: str
    local_path: str
    known_paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    """Settings: projects and where sessions are found."""

    projects: tuple[Project, ...] = ()
    sources: dict[str, str] = field(default_factory=dict)
    debounce_s: int = 30
    min_interval_s: int = 60
    reconcile_s: int = 600

    @staticmethod
    def load(path: str) -> Config:
        raw = tomllib.loads(Path(path).read_text())
        projects = tuple(
            Project(p.get("id") or f"{slug(p['name'])}-{path_hash(p['local_path'])}", p["name"], p["local_path"], tuple(p.get("known_paths", ()))) for p in raw.get("projects", [])
        )
        return Config(projects, raw.get("sources", {}), **raw.get("watch", {}))


    def linked(self, project_id: str, path: str) -> Config:
        """The settings with one more known path of a project."""
        return self.changed(project_id, lambda p: replace(p, known_paths=tuple(dict.fromkeys([*p.known_paths, path]))))

    def renamed(self, project_id: str, name: str) -> Config:
        """The settings with a project under a new name; its id stays."""
        if any(p.name == name and p.id != project_id for p in self.projects):
            raise QueryError("invalid_arguments", f"a project is called {name} already")
        return self.changed(project_id, lambda p: replace(p, name=name))

    def removed(self, project_id: str) -> Config:
        """The settings without a project; ``incremental.remove_project`` takes its rows out of the tables."""
        kept = self.changed(project_id, lambda p: p)
        return replace(kept, projects=tuple(p for p in self.projects if p.id != project_id))

    def changed(self, project_id: str, change) -> Config:
        if all(p.id != project_id for p in self.projects):
            raise QueryError("invalid_arguments", f"no project {project_id}")
        return replace(self, projects=tuple(change(p) if p.id == project_id else p for p in self.projects))


def alive(holder: str) -> bool:
    """Whether the process that a lock file names runs on this machine."""
    try:
        os.kill(int(json.loads(holder)["pid"]), 0)
    except (ValueError, KeyError, ProcessLookupError):
        return False
    except PermissionError:
        return True
    return True


def refresh_status(path: str) -> dict:
    """Who refreshes at the moment, as the lock file tells."""
    at = Path(path)
    if not at.exists():
        return {"running": False}
    holder = at.read_text()
    return {"running": alive(holder), "holder": holder}


@contextlib.contextmanager
def refresh_lock(path: str):
    """One refresh at a time on this driver; the file names who holds it. A dead holder's lock is taken over."""
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        holder = Path(path).read_text()
        if alive(holder):
            raise QueryError("locked", "a refresh is running", holder=holder) from None
        handle = os.open(path, os.O_TRUNC | os.O_WRONLY)
    try:
        os.write(handle, json.dumps({"pid": os.getpid()}).encode())
        os.close(handle)
        yield
    finally:
        os.unlink(path)


def refresh_all(projects: list, refresh) -> dict[str, str]:
    """Refresh each project; one that fails doesn't keep the others from it."""
    out = {}
    for p in projects:
        try:
            refresh(p)
            out[p.id] = "ok"
        except Exception as e:  # each project stands alone
            out[p.id] = f"{type(e).__name__}: {e}"
    return out
