import json
import random
import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest

from logfold.operators.lineage import shared_dir
from logfold.sources import files, hadoop
from logfold.streaming import windows
from logfold.streaming.commit import Conflict, LogTable, replayed
from tests.conftest import SF

SCHEMA = "k string, v long"


@pytest.fixture
def table(spark):
    t = LogTable(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}", spark.createDataFrame([], SCHEMA).schema)
    t.initialise()
    return t


def values(t):
    return sorted(r.v for r in t.read().collect())


def rows(spark, *v):
    return spark.createDataFrame([("k", x) for x in v], SCHEMA)


@pytest.mark.parametrize(("boundary", "visible"), [("before-data", False), ("after-data", False), ("before-version", False), ("after-version", True)])
def test_crash_at_each_boundary(spark, table, boundary, visible):
    def crash(at):
        if at == boundary:
            raise RuntimeError("crash")

    table.hook = crash
    with pytest.raises(RuntimeError):
        table.commit(rows(spark, 1), "b1")
    assert values(table) == ([1] if visible else [])
    table.hook = lambda _: None
    table.commit(rows(spark, 1), "b1")
    table.commit(rows(spark, 1), "b1")
    assert values(table) == [1]


def test_a_writer_that_dies_while_its_version_is_written(spark, table, monkeypatch):
    """Its bytes are there under a name of their own; the version isn't, and the next commit takes its number."""
    import os

    link = os.link

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(os, "link", dies)
    with pytest.raises(KeyboardInterrupt):
        table.commit(rows(spark, 1), "b1")
    monkeypatch.setattr(os, "link", link)
    assert table.versions() == [] and table.commit(rows(spark, 2), "b2") == 0 and table.commit(rows(spark, 1), "b1") == 1
    assert values(table) == [1, 2]


def test_commits_read_a_bounded_number_of_files(spark, table, monkeypatch):
    monkeypatch.setattr("logfold.streaming.commit.SUMMARY", 4)
    read, seen = hadoop.read, []
    monkeypatch.setattr(hadoop, "read", lambda *a: (seen.append(a[1]), read(*a))[1])
    one = rows(spark, 1)
    for i in range(11):
        seen.clear()
        assert table.commit(one, f"b{i}") == i and len(seen) <= 8
    assert all(table.commit(one, f"b{i}") == i for i in range(11)) and len(table.versions()) == 11
    seen.clear()
    assert table.read().count() == 11 and len(seen) <= 5 and table.read(after=8).count() == 2


def test_concurrent_writers_all_land_once(spark, table):
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: table.commit(rows(spark, i), f"w{i}"), range(6)))
    assert sorted(numbers) == list(range(6)) and values(table) == list(range(6))


def test_check_fails_the_whole_batch(spark, table):
    table.commit(rows(spark, 1), "a")
    with pytest.raises(Conflict):
        table.commit(rows(spark, 2, 3), "b", check=lambda now: now.count() == 0)
    assert values(table) == [1]


def test_initialise_twice(table):
    table.initialise()
    with pytest.raises(ValueError):
        table.initialise(head="refs/heads/other")


def test_stream_equals_batch(spark):
    u = spark.range(50).selectExpr("'r' as repo_id", "id as event_id", "concat('x', id % 7) as ref", "id as generation", "repeat('a', 40) as new_oid")
    assert sorted(r.event_id for r in replayed(u, 3).collect()) == list(range(50))


def test_windows_equal_a_loop(spark):
    g = random.Random(2)
    data = sorted((r, t, g.randrange(300)) for r in "ab" for t in range(120))
    want = {}
    for repo in "ab":
        start = n = 0
        batch = -1
        for _, at, tx in sorted((r, at, tx) for r, tx, at in data if r == repo):
            if batch < 0 or at - start >= 20 or n >= 5:
                batch, start, n = batch + 1, at, 0
            n += 1
            want[repo, tx] = batch
    got = {(r.repo_id, r.tx): r.batch for r in windows.group_commit(spark.createDataFrame(data, "repo_id string, tx long, arrival long"), 20, 5).collect()}
    assert got == want


def test_files_round_trip_and_bad_archives(spark):
    u = spark.createDataFrame([("r", i, "refs/heads/x", "0" * 40, "a" * 40) for i in range(1, 4)], "repo_id string, generation long, ref string, old_oid string, new_oid string")
    root = files.write_sample(u, spark)
    assert {(r.status, len(r.updates), len(r.paths)) for r in files.scan_entries(spark, root).collect()} == {("ok", 1, 1)}
    assert [(m.repository_id, m.generation, m.refs) for m in files.scan_manifests(spark, root).collect()] == [("r", 3, {})]
    assert files.scan_certificates(spark, root).first().generation == 3
    assert files.listing(spark, root, "*.wal").count() == 3
    assert files.read_archive(b"junk")["status"] == "corrupt"
    assert files.read_archive(files.archive("t", "", [], {"../x": b""}))["status"] == "unsafe-path"
    hadoop.create(spark, f"{root}/bad/manifest.json", b'{"version": 1}')
    with pytest.raises(Exception, match="unknown manifest version"):
        files.scan_manifests(spark, root).collect()
    hadoop.create(spark, f"{root}/certificates/r/x.cert", b"x")
    with pytest.raises(Exception, match="bad certificate"):
        files.scan_certificates(spark, root).collect()


def test_scan_log_files_takes_every_update(spark, duck):
    from logfold.plans.service import scan_log_files

    got = scan_log_files(spark, SF).groupBy("repo_id", "status").count().collect()
    want = duck.sql("SELECT event_type, count(*) FROM events GROUP BY 1").fetchall()
    assert {(r.repo_id, r.status): r["count"] for r in got} == {(t, "ok"): n for t, n in want}


@pytest.mark.parametrize(("query", "scan"), [("scan_log_files", "scan_entries"), ("scan_entry_metadata", "scan_entry_details")])
def test_scans_hold_a_bounded_number_of_archives(spark, duck, monkeypatch, query, scan):
    """At most SLICE archives, a block each, are on disk at a time, all updates are scanned with a manifest line each, and no log stays."""
    from logfold.plans import ORACLES, QUERIES
    from tests.conftest import same_rows

    real, held, listed = getattr(files, scan), [], []

    def counted(session, root):
        archives = files.listing(session, root, "*.wal").collect()
        held.append(len(archives))
        listed.extend(e.file for m in files.scan_manifests(session, root).collect() for e in m.entries)
        assert max(a.bytes for a in archives) <= 4096
        return real(session, root)

    before = set(hadoop.names(spark, shared_dir(spark)))
    monkeypatch.setattr(files, "SLICE", 300, raising=False)
    monkeypatch.setattr(files, scan, counted)
    got = QUERIES[query](spark, SF)
    same_rows(got, duck.sql(ORACLES[query]))
    n = got.count()
    assert max(held) <= 300 and sum(held) == n and sorted(listed) == sorted(r.file for r in got.collect())
    assert set(hadoop.names(spark, shared_dir(spark))) - before == {x for x in hadoop.names(spark, shared_dir(spark)) if x.startswith("slices-")} - before


def test_manifest_and_certificate_list_every_entry(spark):
    u = spark.createDataFrame([(r, i, "refs/heads/x", "0" * 40, "a" * 40) for r in "ab" for i in range(1, 13)], "repo_id string, generation long, ref string, old_oid string, new_oid string")
    root = files.write_sample(u, spark)
    entries = {(r.repo_id, r.file): r for r in files.scan_entries(spark, root).collect()}
    certs = {r.repo_id: json.loads(r.content) for r in files.scan_certificates(spark, root).collect()}
    for m in files.scan_manifests(spark, root).collect():
        assert [e.generation for e in m.entries] == list(range(1, 13)) and certs[m.repository_id] == {"generation": 12, "entries": [e.transaction_id for e in m.entries]}
        assert all(entries[m.repository_id, e.file].payload_bytes == e.payload_bytes for e in m.entries)


def test_checkpoints_and_metadata_by_stream(spark):
    refs = spark.createDataFrame([("r", 7, "refs/a", "1" * 40), ("r", 7, "refs/b", "2" * 40), ("s", 9, "refs/a", "3" * 40)], "repo_id string, generation long, ref string, oid string")
    root = files.write_checkpoints(refs, spark)
    meta = json.dumps({"generation": 3, "refs": {}}).encode()
    bad = {"t/00000000000000000004.checkpoint": {"checkpoint.json": meta}, "t/00000000000000000003.checkpoint": {"checkpoint.json": meta, "objects/../x": b""}, "t/00000000000000000002.checkpoint": {"objects/x": b""}, "t/latest.checkpoint": {"checkpoint.json": meta}}
    for name, members in bad.items():
        hadoop.create(spark, f"{root}/{name}", files.packed(members))
    hadoop.create(spark, f"{root}/t/00000000000000000001.checkpoint", b"junk" * 200)
    got = {(r.repo_id, r.file.split(".")[0][-1]): (r.generation, r.n_refs, r.n_objects, r.status) for r in files.scan_checkpoints(spark, root).collect()}
    assert got == {("r", "7"): (7, 2, 1, "ok"), ("s", "9"): (9, 1, 1, "ok"), ("t", "4"): (3, 0, 0, "generation-mismatch"), ("t", "3"): (None, None, None, "unsafe-path"), ("t", "2"): (None, None, None, "missing-metadata"), ("t", "t"): (3, 0, 0, "ok"), ("t", "1"): (None, None, None, "corrupt")}
    blobs = [{"path": "objects/x", "blob": {"bytes": 11}}, {"path": "objects/y", "blob": {"bytes": 4}}]
    hadoop.create(spark, f"{root}/u/a.wal", files.archive("tx", "", [], {"objects/x": b"x" * 100_000}, blobs, "d" * 64))
    hadoop.create(spark, f"{root}/u/b.wal", files.packed({"objects/x": b""}))
    got = {r.file: (r.transaction_id, r.payload_bytes, r.descriptor, r.status) for r in files.scan_entry_details(spark, root).collect()}
    assert got == {"a.wal": ("tx", 15, "d" * 64, "ok"), "b.wal": (None, None, None, "missing-metadata")}
