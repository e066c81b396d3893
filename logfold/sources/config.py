"""Strict JSON configuration: hosts, grants, retention, replicas."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from logfold.functions.durations import parse_duration


def strict_json(text: str) -> Any:
    """One JSON value, nothing after it, no key twice."""

    def once(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key comes twice")
        return out

    return json.loads(text, object_pairs_hook=once)


def only(data: Any, known: set[str], what: str) -> dict:
    if not isinstance(data, dict):
        raise ValueError(f"{what} is not an object")
    if extra := set(data) - known:
        raise ValueError(f"unknown fields of {what}: {', '.join(sorted(extra))}")
    return data


@dataclass(frozen=True)
class Repository:
    id: str
    location: str
    scrub_interval: int = 0
    compaction_entries: int = 100
    compaction_bytes: int = 1 << 30
    cache_idle: int = 0


def load_hosts(text: str) -> list[Repository]:
    """Repositories by id; version 1, at least one, ids unique and without path signs, durations not negative."""
    data = only(strict_json(text), {"version", "repositories"}, "the host configuration")
    if data.get("version") != 1:
        raise ValueError("unknown version")
    known, out = {f.name for f in fields(Repository)}, {}
    for r in data.get("repositories") or []:
        r = dict(only(r, known, "a repository"))
        name = r.get("id", "")
        if name in ("", ".", "..") or "/" in name or "\\" in name:
            raise ValueError(f"bad repository id {name!r}")
        if name in out:
            raise ValueError(f"repository {name} comes twice")
        for k in ("scrub_interval", "cache_idle"):
            r[k] = parse_duration(r.get(k, ""))
        out[name] = Repository(**{"location": "", **r})
    if not out:
        raise ValueError("no repositories")
    return [out[k] for k in sorted(out)]


def load_grants(spark: SparkSession, text: str) -> DataFrame:
    """Rows (repo_id, name, sha256, can_read, can_write) of an authorization file."""
    data = only(strict_json(text), {"version", "repositories"}, "the authorization file")
    if data.get("version") != 1:
        raise ValueError("unknown version")
    rows = []
    for repo, grants in (data.get("repositories") or {}).items():
        for g in grants:
            g = only(g, {"name", "sha256", "read", "write"}, "a grant")
            digest = g.get("sha256", "")
            if len(digest) != 64 or set(digest) - set("0123456789abcdef"):
                raise ValueError("a grant needs the sha256 of its token")
            rows.append((repo, g.get("name", ""), digest, bool(g.get("read")), bool(g.get("write"))))
    return spark.createDataFrame(rows, "repo_id string, name string, sha256 string, can_read boolean, can_write boolean")


def retention_policy(duration: str, mode: str = "") -> tuple[int, str]:
    """(days rounded up, mode) of a policy: positive, mode in either case, compliance by default."""
    nanos = parse_duration(duration)
    if nanos <= 0:
        raise ValueError("retention must be positive")
    mode = (mode.strip() or "COMPLIANCE").upper()
    if mode not in ("COMPLIANCE", "GOVERNANCE"):
        raise ValueError(f"unknown retention mode {mode}")
    return -(-nanos // (24 * UNIT_HOUR)), mode


UNIT_HOUR = 3_600_000_000_000


def durability(primary: str, secondary: str = "", required: bool = False) -> str:
    """single or dual; two replicas must lie at different places."""
    place = lambda x: x.strip().removeprefix("file://localhost").removeprefix("file://").rstrip("/")
    if not secondary:
        if required:
            raise ValueError("a second replica is required")
        return "single"
    if place(primary) == place(secondary):
        raise ValueError("both replicas are at one place")
    return "dual"
