"""Queries over requests: metrics, latencies, routing, authorization, admission, and the files on disk."""

from __future__ import annotations

from pyspark.sql import functions as F

from logfold.functions import ident
from logfold.operators import admission, metrics, policy, state
from logfold.sources import fixtures as fx
from logfold.streaming import windows

from .registry import query

R = "WITH " + fx.REQUESTS_SQL


@query(f"{R} SELECT service, operation, status, count(*) AS n FROM requests GROUP BY ALL")
def http_request_counts(spark, d):
    return metrics.request_counts(fx.requests(spark, d))


@query(f"{R} SELECT operation, count(*) AS n, count(*) FILTER (failed) AS n_failed, CAST(sum(micros) AS DOUBLE) / 1000000 AS seconds, max(at_us) AS last_run, max(at_us) FILTER (NOT failed) AS last_success FROM requests GROUP BY 1")
def op_counters(spark, d):
    return metrics.op_counters(fx.requests(spark, d), "operation")


@query(f"{R} SELECT service, operation, status, 'log_requests_total{{service=\"' || service || '\",operation=\"' || operation || '\",status=\"' || status || '\"}} ' || n AS line FROM (SELECT service, operation, status, count(*) AS n FROM requests GROUP BY ALL)")
def metrics_text(spark, d):
    return metrics.exposition(metrics.request_counts(fx.requests(spark, d)), "log_requests_total").orderBy("service", "operation", "status")


@query("""WITH r AS (SELECT c_custkey AS repo, c_custkey % 3 <> 0 AS configured, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal > 0 END AS healthy FROM customer)
    SELECT repo, configured, healthy, NOT configured OR coalesce(healthy, false) AS writes_allowed FROM r""")
def scrub_gate(spark, d):
    r = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("repo"), (F.col("c_custkey") % 3 != 0).alias("configured"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") > 0).alias("healthy"))
    return r.withColumn("writes_allowed", metrics.gate(F.col("configured"), F.col("healthy")))


@query("SELECT count(*) AS n_repos, count(*) FILTER (NOT (c_acctbal > 0)) AS n_unavailable, count(*) FILTER (NOT (c_acctbal > 0)) = 0 AS ready FROM customer")
def readiness_rollup(spark, d):
    return metrics.readiness(fx.table(spark, d, "customer").select((F.col("c_acctbal") > 0).alias("available")))


def latency_sql(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    pick = lambda p: f"max(CASE WHEN i = CAST(floor((n - 1) * CAST({p} AS DOUBLE) + 0.5) AS BIGINT) THEN CAST(micros AS DOUBLE) / 1000 END)"
    lead = f"{keys}, " if keys else ""
    return f"""{R}, o AS (SELECT *, row_number() OVER ({part} ORDER BY micros) - 1 AS i, count(*) OVER ({part}) AS n FROM requests)
    SELECT {lead}max(n) AS n, CAST(sum(micros) AS DOUBLE) / 1000 / max(n) AS mean_ms, {pick(0.5)} AS p50_ms, {pick(0.9)} AS p90_ms, {pick(0.99)} AS p99_ms, CAST(max(micros) AS DOUBLE) / 1000 AS max_ms FROM o GROUP BY ALL"""


@query(latency_sql("event_type"))
def latency_summary(spark, d):
    return metrics.latency_summary(fx.requests(spark, d), ["event_type"])


@query(latency_sql("node, operation"))
def latency_by_node(spark, d):
    return metrics.latency_summary(fx.requests(spark, d), ["node", "operation"])


@query(f"""WITH s AS ({latency_sql("operation")}) SELECT w.mean_ms AS write_ms, r.mean_ms AS read_ms, round((w.mean_ms / r.mean_ms - 1) * 100, 9) AS overhead_percent, round(1000 / w.mean_ms, 9) AS writes_per_second
    FROM s w, s r WHERE w.operation = 'write' AND r.operation = 'read'""")
def latency_overhead(spark, d):
    s = metrics.latency_summary(fx.requests(spark, d), ["operation"])
    mean = lambda op: F.max(F.when(F.col("operation") == op, F.col("mean_ms")))
    two = s.agg(mean("write").alias("write_ms"), mean("read").alias("read_ms"))
    return two.select("write_ms", "read_ms", F.round((F.col("write_ms") / F.col("read_ms") - 1) * 100, 9).alias("overhead_percent"), F.round(1000 / F.col("write_ms"), 9).alias("writes_per_second"))


@query(f"{R} SELECT node, at_us // 3600000000 AS hour, string_agg(m, '; ' ORDER BY m) AS failures FROM (SELECT node, at_us, service || ' ' || request_id AS m FROM requests WHERE failed) GROUP BY ALL")
def failure_messages(spark, d):
    """The failures of a node's requests, hour by hour."""
    r = fx.requests(spark, d).where("failed").withColumns({"m": F.concat_ws(" ", "service", "request_id"), "hour": F.expr("at_us div 3600000000")})
    return metrics.joined_failures(r, ["node", "hour"], "m")


@query("""WITH g AS (SELECT c_mktsegment AS repo_id, sha256(c_name) AS sha256, c_custkey % 4 IN (1, 3) AS can_read, c_custkey % 4 IN (2, 3) AS can_write FROM customer),
    q AS (SELECT c_custkey AS request, c_mktsegment AS repo_id, CASE WHEN c_custkey % 5 = 0 THEN 'wrong' ELSE c_name END AS token, w AS write FROM customer, (VALUES (true), (false)) t(w))
    SELECT request, q.repo_id, write, coalesce(CASE WHEN write THEN bool_or(can_write) ELSE bool_or(can_read) END, false) AS allowed FROM q LEFT JOIN g ON g.repo_id = q.repo_id AND g.sha256 = sha256(token) GROUP BY request, q.repo_id, write""")
def authz_matrix(spark, d):
    c = fx.table(spark, d, "customer")
    k = F.col("c_custkey") % 4
    grants = c.select(F.col("c_mktsegment").alias("repo_id"), ident.sha(F.col("c_name")).alias("sha256"), k.isin(1, 3).alias("can_read"), k.isin(2, 3).alias("can_write"))
    header = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Bearer "), F.col("name"))).otherwise(F.concat(F.lit("Basic "), F.base64(F.concat(F.lit("user:"), F.col("name")).cast("binary"))))
    q = c.withColumn("name", F.when(F.col("c_custkey") % 5 == 0, "wrong").otherwise(F.col("c_name")))
    q = q.select(F.col("c_custkey").alias("request"), F.col("c_mktsegment").alias("repo_id"), ident.request_token(header).alias("token"), F.explode(F.array(F.lit(True), F.lit(False))).alias("write"))
    return policy.authorized(q, grants).select("request", "repo_id", "write", "allowed")


@query("""WITH r AS (SELECT page_id, '/' || regexp_extract(url, '^https?://([^/]+)', 1) || CASE WHEN page_id % 7 = 0 THEN '/sub' ELSE '' END || '.git/' || ['info/refs', 'git-upload-pack', 'git-receive-pack', 'HEAD'][1 + page_id % 4] AS path,
        CASE WHEN page_id % 3 = 0 THEN 'service=git-receive-pack' ELSE 'service=git-upload-pack' END AS query, CASE WHEN page_id % 8 < 4 AND page_id % 4 = 0 THEN 'GET' ELSE 'POST' END AS method FROM pages),
    p AS (SELECT *, regexp_extract(path, '^/([^/]+)\\.git/', 1) AS repo, regexp_extract(path, '^/[^/]+\\.git/(.*)$', 1) AS rest FROM r),
    s AS (SELECT page_id, repo, CASE WHEN repo = '' THEN '' WHEN rest = 'info/refs' AND method = 'GET' THEN substr(query, 9) WHEN rest IN ('git-upload-pack', 'git-receive-pack') AND method = 'POST' THEN rest ELSE '' END AS service FROM p)
    SELECT page_id, repo, service, service = 'git-receive-pack' AS write FROM s""")
def route_requests(spark, d):
    p, i = fx.table(spark, d, "pages"), F.col("page_id")
    verbs = F.array(*map(F.lit, ("info/refs", "git-upload-pack", "git-receive-pack", "HEAD")))
    path = F.concat(F.lit("/"), F.regexp_extract("url", "^https?://([^/]+)", 1), F.when(i % 7 == 0, "/sub").otherwise(""), F.lit(".git/"), F.get(verbs, (i % 4).cast("int")))
    q = F.when(i % 3 == 0, "service=git-receive-pack").otherwise("service=git-upload-pack")
    method = F.when((i % 8 < 4) & (i % 4 == 0), "GET").otherwise("POST")
    return p.select("page_id", policy.route(path, q, method).alias("r")).select("page_id", "r.*")


PATHS = """WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'objects/' || source || '/../' || doc_id WHEN 1 THEN 'objects/../' || source WHEN 2 THEN '/objects/' || doc_id WHEN 3 THEN 'objects//abs/' || doc_id WHEN 4 THEN 'objects/' || source || '/' || doc_id || '.lock' ELSE 'objects/' || source || '/tmp_obj_' || doc_id END AS path FROM documents)"""


def paths(spark, d):
    i, s, k = F.col("doc_id"), F.col("source"), F.col("doc_id") % 6
    o = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    path = (
        F.when(k == 0, o("objects/", s, "/../", i)).when(k == 1, o("objects/../", s)).when(k == 2, o("/objects/", i)).when(k == 3, o("objects//abs/", i))
        .when(k == 4, o("objects/", s, "/", i, ".lock")).otherwise(o("objects/", s, "/tmp_obj_", i))
    )
    return fx.table(spark, d, "documents").select("doc_id", path.alias("path"))


@query(f"{PATHS} SELECT doc_id, path, doc_id % 6 IN (0, 4, 5) AS safe FROM p")
def path_safety(spark, d):
    return paths(spark, d).withColumn("safe", ident.safe_object_path(F.col("path")))


@query(f"{PATHS} SELECT doc_id, path FROM p WHERE NOT (regexp_matches(path, '(\\.keep|\\.lock|\\.tmp)$') OR regexp_matches(path, '(^|/)tmp_obj_[^/]*$')) ORDER BY path")
def transient_filter(spark, d):
    return paths(spark, d).where(~ident.transient(F.col("path"))).orderBy("path")


@query("""WITH l AS (SELECT s_suppkey, ['file://localhost/data/', 's3://b--x-s3/p/', 'file:///data', '/data//'][1 + s_suppkey % 4] AS location FROM supplier)
    SELECT s_suppkey, location, CASE s_suppkey % 4 WHEN 0 THEN '/data' WHEN 1 THEN 's3://b--x-s3/p' WHEN 2 THEN '/data' ELSE '/data' END AS normal, CASE WHEN s_suppkey % 2 = 0 THEN 'express' ELSE 'standard' END AS storage, s_suppkey % 3 <> 2 AS generated FROM l""")
def locations(spark, d):
    k = F.col("s_suppkey")
    pick = lambda *x: F.get(F.array(*map(F.lit, x)), (k % len(x)).cast("int"))
    s = fx.table(spark, d, "supplier").select("s_suppkey", pick("file://localhost/data/", "s3://b--x-s3/p/", "file:///data", "/data//").alias("location"), pick("b--x-s3", "b").alias("bucket"), pick("bench-20240229T120000Z-" + "0a" * 16, "bench-20240229T235959Z-" + "ff" * 16, "bench-20241399T120000Z-" + "0a" * 16).alias("segment"))
    return s.select("s_suppkey", "location", ident.normal_location(F.col("location")).alias("normal"), ident.storage_class(F.col("bucket")).alias("storage"), ident.benchmark_segment(F.col("segment")).alias("generated"))


@query("SELECT o_custkey AS repo, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"{PATHS} SELECT doc_id, path, len(string_split(path, '/')) AS depth FROM p ORDER BY depth DESC, path")
def directory_order(spark, d):
    return paths(spark, d).withColumn("depth", F.size(F.split("path", "/")).cast("long")).orderBy(F.desc("depth"), "path")


def arrivals(spark, d):
    return fx.transactions(spark, d).select("repo_id", "tx", "arrival")


@query()
def group_commit_windows(spark, d):
    """Processing-time windows depend on arrival one by one; a test holds them against a plain loop."""
    return windows.group_commit(arrivals(spark, d), window=3 * 86_400_000_000, most=64)


@query()
def batch_stats(spark, d):
    w = windows.group_commit(arrivals(spark, d), window=3 * 86_400_000_000, most=64)
    return metrics.batch_stats(w.groupBy("repo_id", "batch").agg(F.count("*").alias("n")))


def commit_requests(spark, d):
    """orders as update requests: each moves a ref from what its customer's last but one order left, which conflicts at times."""
    from pyspark.sql import Window

    t = fx.transactions(spark, d)
    new = F.when(F.col("tx") % 6 == 0, F.lit(ident.ZERO)).otherwise(F.substring(ident.sha(F.col("tx").cast("string")), 1, 40))
    t = t.withColumn("new_oid", new)
    by = Window.partitionBy("repo_id", "ref").orderBy("arrival", "tx")
    old = F.when(F.col("tx") % 4 == 0, F.lag("new_oid", 2).over(by)).otherwise(F.lag("new_oid").over(by))
    return t.select("repo_id", "tx", F.lit(0).alias("ordinal"), F.col("ref").cast("string").alias("ref"), F.coalesce(old, F.lit(ident.ZERO)).alias("old_oid"), "new_oid", "arrival")


@query()
def admit_batch(spark, d):
    return admission.ordered_admission(commit_requests(spark, d))


@query()
def admit_batches(spark, d):
    """Batches depend on what the batches before left; a test holds them against a plain loop with roll-back."""
    w = windows.group_commit(arrivals(spark, d), window=3 * 86_400_000_000, most=64)
    requests = commit_requests(spark, d).join(w.select("repo_id", "tx", "batch"), ["repo_id", "tx"])
    return admission.batch_admission(admission.batch_outcomes(requests))


@query(f"WITH {fx.UPDATES_SQL} SELECT repo_id, ref, arg_max(new_oid, generation) AS oid FROM updates GROUP BY ALL HAVING trim(arg_max(new_oid, generation), '0') <> ''")
def stream_commit(spark, d):
    """Commits events in micro-batches to a log table of its own and reads back its head state."""
    from logfold.streaming.commit import replayed

    u = fx.updates(spark, d).select("repo_id", "ref", "new_oid", "generation", "event_id")
    return state.fold(replayed(u, buckets=3))


@query(f"""WITH {fx.UPDATES_SQL}, t AS (SELECT repo_id, generation, sha256('[{{"old":"' || old_oid || '","new":"' || new_oid || '","ref":"' || ref || '"}}]') AS transaction_id FROM updates)
    SELECT repo_id, lpad(CAST(generation AS VARCHAR), 20, '0') || '-' || substr(transaction_id, 1, 16) || '.wal' AS file, transaction_id, CAST(1 AS INTEGER) AS n_updates, CAST(length('object ' || generation) AS BIGINT) AS payload_bytes, 'ok' AS status FROM t""")
def scan_log_files(spark, d):
    """Writes manifests, entries and certificates in the layout of a log on disk, and scans them back, one bounded log after another."""
    from logfold.sources import files

    entries = files.scan_sample(fx.updates(spark, d), spark, files.scan_entries)
    return entries.select("repo_id", "file", "transaction_id", F.size("updates").alias("n_updates"), "payload_bytes", "status")
