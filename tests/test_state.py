import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from logfold.functions import durations, ident
from logfold.operators import admission, chain, content, maintain, metrics, policy, scrub, state
from logfold.sources.text import parse_refs, parse_updates

Z = "0" * 40


def oid(c):
    return c * 40


def test_fold_last_writer_and_delete(spark):
    u = spark.createDataFrame([("r", "a", 1, oid("1")), ("r", "a", 2, oid("2")), ("r", "b", 1, oid("3")), ("r", "b", 3, Z)], "repo_id string, ref string, generation long, new_oid string")
    assert [tuple(x) for x in state.fold(u).collect()] == [("r", "a", oid("2"))]
    assert state.fold(u.limit(0)).count() == 0


def test_checkpoint_and_tail_equal_the_whole_fold(spark):
    g = random.Random(1)
    u = spark.createDataFrame([("r", f"x{g.randrange(9)}", i, Z if g.random() < 0.2 else oid(g.choice("abcdef"))) for i in range(200)], "repo_id string, ref string, generation long, new_oid string")
    want = {tuple(r) for r in state.fold(u.where("generation <= 150")).collect()}
    assert {tuple(r) for r in state.as_of(state.fold(u.where("generation <= 90")), 90, u, 150).collect()} == want


def test_numbers_are_gapless_across_buckets(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as v")
    rows = state.numbered(df, ["k"], ["v"], F.floor(F.col("v") / 70), "n").collect()
    for k in range(3):
        own = sorted((r.v, r.n) for r in rows if r.k == k)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


def test_diff_applied_gives_the_target(spark):
    a = spark.createDataFrame([("r", "x", oid("1")), ("r", "y", oid("2"))], "repo_id string, ref string, oid string")
    b = spark.createDataFrame([("r", "y", oid("3")), ("r", "z", oid("4"))], "repo_id string, ref string, oid string")
    got = {(r.ref, r.change, r.old_oid, r.new_oid) for r in state.diff(a, b).collect()}
    assert got == {("x", "delete", oid("1"), Z), ("y", "update", oid("2"), oid("3")), ("z", "create", Z, oid("4"))}
    assert state.verify(a, a).first().equal and not state.verify(a, b).first().equal


def test_missing_ref_is_zeros_as_long_as_the_old_id(spark):
    u = spark.createDataFrame([("r", "x", "0" * 64, "a" * 64), ("r", "y", Z, oid("b"))], "repo_id string, ref string, old_oid string, new_oid string")
    refs = spark.createDataFrame([], "repo_id string, ref string, oid string")
    assert [r.outcome for r in state.classify(u, refs).collect()] == ["pending", "pending"]


def test_transaction_id_escapes_as_the_log_does(spark):
    ups = [{"old": Z, "new": oid("a"), "ref": 'refs/heads/a&b<"\\>\u2028'}]
    body = json.dumps(ups, separators=(",", ":"), ensure_ascii=False).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e").replace("\u2028", "\\u2028")
    df = spark.createDataFrame([(ups,)], "u array<struct<old:string,new:string,ref:string>>")
    got = df.select(ident.transaction_id(F.col("u")), ident.identity_matches(F.concat(F.lit("rollback-"), ident.transaction_id(ident.inverted(F.col("u")))), F.col("u"))).first()
    assert got[0] == hashlib.sha256(body.encode()).hexdigest() and got[1]


def test_identifiers(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(ident.is_zero(F.lit(""))) and one(ident.is_zero(F.lit("000"))) and not one(ident.is_zero(F.lit("0a")))
    assert one(ident.parsed_certificate_name(F.lit("1-x.cert")))["ok"] is False
    assert one(ident.parsed_certificate_name(F.lit("9" * 20 + "-" + "a" * 64 + ".cert")))["ok"] is False
    name = one(ident.certificate_name(F.lit(7), F.lit("a" * 64)))
    assert one(ident.parsed_certificate_name(F.lit(name)))["generation"] == 7
    for path, ok in (("objects/a/../b", True), ("objects/../b", False), ("objects/", False), ("/objects/a", False), ("objects//a", False), ("objects/a/../..", False)):
        assert one(ident.safe_object_path(F.lit(path))) is ok, path
    assert one(ident.retention_days(F.lit(0), F.lit(2))) == 730 and one(ident.retention_days(F.lit(1), F.lit(2))) is None
    assert one(ident.request_token(F.lit("Basic dTpwOnE="))) == "p:q" and one(ident.request_token(F.lit("Digest x"))) == ""
    assert one(ident.valid_id(F.lit(".."))) is False and one(ident.valid_id(F.lit("a.b"))) is True


def test_durations():
    assert durations.parse_duration("1h30m") == 5400 * 10**9 and durations.parse_duration("", 5) == 5 and durations.parse_duration("1.5s") == 1_500_000_000
    for bad in ("-1s", "1", "x", "+"):
        with pytest.raises(ValueError):
            durations.parse_duration(bad)


def test_parsers(spark):
    lines = spark.createDataFrame([(f" {Z}  {oid('a')}\trefs/heads/x ",), (f"{Z} {oid('a')} HEAD",), (f"{Z} {oid('a')}",), (f"{Z} {'a' * 64} refs/x",), (f"{Z} {oid('a')} tags",)], "v string")
    assert [r.status for r in parse_updates(lines, "v").collect()] == ["ok", "head", "fields", "oid", "ref"]
    with pytest.raises(Exception, match="malformed"):
        parse_updates(lines, "v", strict=True).collect()
    assert [r.ok for r in parse_refs(spark.createDataFrame([("a b",), ("a",)], "v string"), "v").collect()] == [True, False]


def loop_admission(txs):
    refs, generation, out = {}, 0, {}
    for tx, moves in txs:
        if all((r not in refs) if n == Z else refs.get(r) == n for r, _, n in moves):
            out[tx] = (generation, "applied")
        elif any(refs.get(r, Z) != o for r, o, _ in moves):
            out[tx] = (generation, "conflict")
        else:
            generation += 1
            for r, _, n in moves:
                refs.pop(r, None) if n == Z else refs.__setitem__(r, n)
            out[tx] = (generation, "accepted")
    return out


def test_ordered_admission_equals_a_loop(spark):
    g = random.Random(5)
    rows, want = [], {}
    for repo in "abc":
        txs = []
        for tx in range(200):
            moves = [(f"x{g.randrange(4)}", g.choice([Z, oid("1"), oid("2")]), g.choice([Z, oid("1"), oid("2")])) for _ in range(g.randrange(1, 3))]
            txs.append((tx, moves))
            rows += [(repo, tx, i, r, o, n, tx) for i, (r, o, n) in enumerate(moves)]
        want |= {(repo, k): v for k, v in loop_admission(txs).items()}
    g.shuffle(rows)
    df = spark.createDataFrame(rows, "repo_id string, tx long, ordinal int, ref string, old_oid string, new_oid string, arrival long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {(r.repo_id, r.tx): (r.generation, r.status) for r in admission.ordered_admission(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert {s for _, s in want.values()} == {"applied", "conflict", "accepted"}


def loop_batches(requests):
    """requests of one repository in order: (batch, tx, moves). A conflict undoes its whole batch."""
    refs, generation, out = {}, 0, []
    for batch in sorted({b for b, _, _ in requests}):
        before, was, got = dict(refs), generation, []
        for _, tx, moves in (r for r in requests if r[0] == batch):
            if all(refs.get(r, Z) == n for r, _, n in moves):
                got.append((tx, generation, "applied"))
            elif any(refs.get(r, Z) != o for r, o, _ in moves):
                got = [(t, was, "rolled_back") for t, _, _ in got] + [(tx, was, "conflict")]
                got += [(t, was, "rolled_back") for b, t, _ in requests if b == batch and t not in {g[0] for g in got}]
                refs, generation = before, was
                break
            else:
                generation += 1
                for r, _, n in moves:
                    refs.pop(r, None) if n == Z else refs.__setitem__(r, n)
                got.append((tx, generation, "accepted"))
        out += [(batch, *g) for g in got]
    return out


def test_failed_batches_leave_nothing(spark):
    rows = [("a", 0, 1, 0, "x", Z, oid("1"), 1), ("a", 0, 2, 0, "x", Z, oid("9"), 2), ("a", 1, 3, 0, "x", Z, oid("2"), 3)]
    schema = "repo_id string, batch long, tx long, ordinal int, ref string, old_oid string, new_oid string, arrival long"
    got = {r.tx: r.status for r in admission.batch_outcomes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "rolled_back", 2: "conflict", 3: "accepted"}
    assert admission.batch_outcomes(spark.createDataFrame([], schema)).count() == 0
    g = random.Random(6)
    rows, want = [], set()
    for repo in "abc":
        requests = []
        for tx in range(300):
            moves = [(f"x{g.randrange(3)}", g.choice([Z, oid("1"), oid("2")]), g.choice([Z, oid("1"), oid("2")])) for _ in range(g.randrange(1, 3))]
            moves = list({m[0]: m for m in moves}.values())
            requests.append((tx // 2, tx, moves))
            rows += [(repo, tx // 2, tx, i, r, o, n, tx) for i, (r, o, n) in enumerate(moves)]
        want |= {(repo, *x) for x in loop_batches(requests)}
    g.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        df = admission.batch_outcomes(spark.createDataFrame(rows, schema))
        got = {tuple(r) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and {x[-1] for x in want} == {"applied", "conflict", "accepted", "rolled_back"}
    by = {(r.repo_id, r.batch): r for r in admission.batch_admission(df).collect()}
    assert all(by[repo, b].failed == any(w[:2] == (repo, b) and w[-1] == "conflict" for w in want) for repo, b, *_ in want)


def test_the_ordered_pass_reads_numbers_in_place_of_ids(spark, monkeypatch):
    """However long refs and ids are, a row of the pass takes a few bytes; the outcomes are those of the texts."""
    real = admission._admit

    def narrow(frames):
        def checked():
            for f in frames:
                if f.memory_usage(deep=True).sum() > 200 * len(f) + 1000:
                    raise ValueError("wide rows")
                yield f

        yield from real(checked())

    monkeypatch.setattr(admission, "_admit", narrow)
    g = random.Random(8)
    pick = lambda: g.choice(["0" * 300, "0" * 7, "a" * 300, "a" * 299 + "b", "c"])
    rows = [("a", tx // 3, tx, 0, g.choice("xyz") * 300, pick(), pick(), tx) for tx in range(400)]
    plain = lambda v: v if v.strip("0") else Z
    want = {("a", *x) for x in loop_batches([(b, tx, [(r, plain(o), plain(n))]) for _, b, tx, _, r, o, n, _ in rows])}
    df = spark.createDataFrame(rows, "repo_id string, batch long, tx long, ordinal int, ref string, old_oid string, new_oid string, arrival long")
    got = {tuple(r) for r in admission.batch_outcomes(df).collect()}
    assert got == want and {x[-1] for x in want} == {"applied", "conflict", "accepted", "rolled_back"}


def test_ordered_admission_deals_out_a_repository(spark, monkeypatch):
    """Refs without a common transaction are streams of their own: no task gets most rows of the only repository."""
    real = admission._alone

    def bounded(batches):
        n = 0
        for b in batches:
            n += b.num_rows
            if n > 450:
                raise ValueError("a task reads most rows")
            yield from real(iter([b]))

    monkeypatch.setattr(admission, "_alone", bounded)
    g, day = random.Random(9), 86_400_000_000
    txs = []
    for tx in range(600):
        refs = g.sample(["m0", "m1", "m2"], 2) if tx % 20 == 0 else [f"x{g.randrange(60)}"]
        txs.append((tx, [(r, g.choice([Z, oid("1"), oid("2")]), g.choice([Z, oid("1"), oid("2")])) for r in refs]))
    rows = [("a", tx, i, r, o, n, (tx // 7) * day // 3) for tx, moves in txs for i, (r, o, n) in enumerate(moves)]
    rows = [(*r[:6], None if r[1] < 5 else r[6]) for r in rows]
    g.shuffle(rows)
    df = spark.createDataFrame(rows, "repo_id string, tx long, ordinal int, ref string, old_oid string, new_oid string, arrival long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.tx: (r.generation, r.status) for r in admission.ordered_admission(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == loop_admission(txs) and {s for _, s in got.values()} == {"applied", "conflict", "accepted"}


def test_chains(spark):
    rows = [("p", "ok", g, f"d{g}", f"d{g - 1}" if g else None) for g in range(300)]
    rows += [("p", "lost", 0, "a", None), ("p", "lost", 2, "c", "b"), ("p", "cycle", 0, "r", None), ("p", "cycle", 1, "x", "y"), ("p", "cycle", 2, "y", "x")]
    rows += [("p", "fork", 0, "a", None), ("p", "fork", 1, "b", "a"), ("p", "fork", 1, "c", "a"), ("q", "ok", 0, "d0", None), ("q", "ok", 1, "d1", "d0")]
    df = spark.createDataFrame(rows, "authority string, repo_id string, generation long, digest string, previous string")
    v = {(r.authority, r.repo_id): r for r in chain.validity(df).collect()}
    assert v["p", "ok"].valid and v["p", "ok"].depth == 300 and not v["p", "lost"].valid and not v["p", "cycle"].valid and v["p", "fork"].valid
    n = {(r.authority, r.repo_id): r for r in chain.newest(df).collect()}
    assert n["p", "fork"].fork and n["p", "fork"]["head"] is None and n["p", "ok"]["head"] == "d299"
    r = {x.repo_id: x for x in chain.recovered(df).collect()}
    assert r["ok"].generation == 1 and not r["ok"].survivor_only and "lost" not in r


def test_recovery_from_a_fork_takes_the_largest_digest(spark):
    """Both links of a fork in the newest generation are common; which row comes first must not matter."""
    forks = [("p", f"r{k}", g, d, p) for k in range(40) for g, d, p in ([(0, "a", None)] + [(1, d, "a") for d in ("zcb", "bzc")[:: 1 if k % 2 else -1]])]
    df = spark.createDataFrame(forks, "authority string, repo_id string, generation long, digest string, previous string")
    got = {(r.generation, r.head, r.n_valid, r.survivor_only) for r in chain.recovered(df).collect()}
    assert got == {(1, "zcb", 1, True)}


def test_chunks_of_bytes_and_text(spark):
    data = bytes(range(256)) * 100
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray())], "id long, data binary")
    rows = content.chunked(df, size=1000).orderBy("ordinal").collect()
    assert len(rows) == 26 and b"".join(bytes(r.data) for r in rows) == data and all(r.id == 1 for r in rows)
    assert [r.bytes for r in rows][-1] == 600


def test_objects_come_back_whole(spark):
    data = [(1, bytes(range(256)) * 9), (2, b""), (3, None), (4, b"\0\xff")]
    df = spark.createDataFrame(data, "id long, data binary")
    got = {r.id: (r.digest, r.bytes, r.n_chunks) for r in content.reassembled(content.chunked(df, size=1000), ["id"], df).collect()}
    assert got == {i: (hashlib.sha256(x or b"").hexdigest(), len(x or b""), -(-len(x or b"") // 1000)) for i, x in data}


def test_entries_refs_and_errors(spark):
    """The first failing check of an entry, refs along a chain, and classes of errors, row by row."""
    moves = [{"old": Z, "new": oid("1"), "ref": "a\tb"}]
    tx = hashlib.sha256(json.dumps(moves, separators=(",", ":")).encode()).hexdigest()
    kind = "array<struct<old:string,new:string,ref:string>>"
    entries = spark.createDataFrame([("r", i, f"d{i}", tx, moves, 5) for i in range(6)], f"repo_id string, tx long, descriptor string, transaction_id string, updates {kind}, payload_bytes long")
    other = [{**moves[0], "ref": "x"}]
    found = [("d0", tx, moves, 5, None), ("d1", tx, moves, 6, None), ("d2", "no", moves, 5, None), ("d3", tx, moves, 5, "d0"), ("d4", hashlib.sha256(json.dumps(other, separators=(",", ":")).encode()).hexdigest(), other, 5, None)]
    descriptors = spark.createDataFrame(found, f"digest string, transaction_id string, updates {kind}, payload_bytes long, points_to string")
    got = {r.tx: r.status for r in scrub.verified_entries(entries, descriptors).collect()}
    assert got == {0: "ok", 1: "payload", 2: "identity", 3: "nested", 4: "identity", 5: "descriptor"}
    links = [("a", None, 1, {"x": "1"}, [("x", "1")]), ("b", "a", 2, {"y": "2"}, [("x", Z), ("y", "3"), ("y", "2")]), ("c", "b", 4, {"y": "2"}, []), ("d", "gone", 5, {}, []), ("e", "b", 3, {"y": "9"}, [])]
    certs = spark.createDataFrame([("r", *x) for x in links], "repo_id string, digest string, previous string, generation long, refs map<string,string>, updates array<struct<ref:string,new:string>>")
    assert {r.digest: r.status for r in chain.refs_along(certs, ["repo_id"]).collect()} == {"a": "ok", "b": "ok", "c": "generation", "d": "parent", "e": "refs"}
    errors = spark.createDataFrame([("NoSuchKey", None), (None, 412), ("Slow", 409), (None, None)], "code string, status int")
    assert [r[0] for r in errors.select(ident.error_class(F.col("code"), F.col("status"))).collect()] == ["not_found", "precondition", "conflict", "other"]


def test_nearest_rank(spark):
    s = metrics.latency_summary(spark.createDataFrame([(1, v * 1000) for v in (4, 1, 3, 2)], "k int, micros long"), ["k"]).first()
    assert (s.n, s.mean_ms, s.p50_ms, s.p90_ms, s.max_ms) == (4, 2.5, 3.0, 4.0, 4.0)
    assert metrics.latency_summary(spark.createDataFrame([], "k int, micros long"), ["k"]).count() == 0


def test_garbage_spares_staged_and_fresh(spark):
    f = spark.createDataFrame([("r", p, "entry", 1, t) for p, t in (("a", 1), ("b", 1), ("c", 1), ("d", 10))], "repo_id string, path string, kind string, bytes long, modified long")
    pick = lambda p: f.where(F.col("path") == p)
    assert [r.path for r in maintain.garbage(f, pick("a"), pick("b"), 10).collect()] == ["c"]


def test_retention_cascade(spark):
    rows = [("Suspended", "Enabled", "COMPLIANCE", 45, 0), ("Enabled", "Disabled", "COMPLIANCE", 45, 0), ("Enabled", "Enabled", "COMPLIANCE", 0, 0), ("Enabled", "Enabled", "GOVERNANCE", 45, 0), ("Enabled", "Enabled", "COMPLIANCE", 10, 0), ("Enabled", "Enabled", "COMPLIANCE", 0, 1)]
    df = spark.createDataFrame(rows, "versioning string, object_lock string, mode string, days int, years int")
    assert [r[0] for r in df.select(policy.retention_issue(45, "COMPLIANCE")).collect()] == ["versioning", "object-lock", "rule", "mode", "days", ""]
