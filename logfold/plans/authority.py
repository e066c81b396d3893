"""Queries that join the log with certificates, consumers and replicas."""

from __future__ import annotations

from pyspark.sql import functions as F

from logfold.functions import ident
from logfold.operators import chain, content, maintain, reconcile, scrub, state
from logfold.sources import fixtures as fx

from .content import CHUNKS, COPIES, REP, REPORT, both, chunks, copies
from .log import G1, G2, TWO, U, refs
from .registry import query


@query(f"""WITH {fx.CERTIFICATES_SQL}, c AS (SELECT repo_id, max(generation) AS c_generation, arg_max(digest, generation) AS head FROM certificates WHERE repo_id % 9 <> 8 GROUP BY 1),
    m AS (SELECT repo_id, max(generation) + CASE repo_id % 6 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS m_generation, CASE WHEN repo_id % 6 = 2 THEN 'x' ELSE arg_max(digest, generation) END AS m_digest FROM certificates WHERE repo_id % 10 <> 9 GROUP BY 1)
    SELECT repo_id, greatest(m_generation, c_generation) AS generation, CASE WHEN c_generation IS NULL THEN 'manifest_only' WHEN m_generation IS NULL THEN 'recovered' WHEN m_generation > c_generation THEN 'manifest_ahead'
        WHEN m_generation < c_generation THEN 'chain_newer' WHEN m_digest = head THEN 'equal' ELSE 'digest_mismatch' END AS status FROM m FULL JOIN c USING (repo_id)""")
def authoritative_manifest(spark, d):
    heads = chain.newest(fx.certificates(spark, d), ["repo_id"])
    k = F.col("repo_id") % 6
    m = heads.where("repo_id % 10 <> 9").select("repo_id", (F.col("generation") + F.when(k == 0, 1).when(k == 1, -1).otherwise(0)).alias("generation"), F.when(k == 2, "x").otherwise(F.col("head")).alias("digest"))
    return reconcile.authoritative(m, heads.where("repo_id % 9 <> 8"))


@query(f"""{U}, {fx.OFFSETS_SQL}, h AS (SELECT repo_id, max(generation) AS head FROM updates GROUP BY 1), j AS (SELECT *, "offset" < {G1} AND head >= {G1} AND "offset" <> head AS from_checkpoint FROM offsets JOIN h USING (repo_id) WHERE "offset" <= head)
    SELECT repo_id, consumer, "offset", head, from_checkpoint, head - CASE WHEN from_checkpoint THEN {G1} ELSE "offset" END AS n_tail, head AS new_offset FROM j""")
def reconcile_plan(spark, d):
    return reconcile.catch_up(fx.updates(spark, d), fx.offsets(spark, d), G1)


@query(f"""{TWO}, {fx.OFFSETS_SQL}, wrong AS (SELECT DISTINCT coalesce(a.repo_id, b.repo_id) AS repo_id FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.ref = b.ref WHERE a.oid IS DISTINCT FROM b.oid AND coalesce(a.repo_id, b.repo_id) <> 'click')
    SELECT repo_id, consumer, CASE WHEN repo_id IN (SELECT repo_id FROM wrong) THEN "offset" ELSE {G2} END AS "offset" FROM offsets""")
def offset_advance(spark, d):
    u = fx.updates(spark, d)
    a, b = state.fold(u.where(F.col("generation") <= G1)), state.fold(u.where(F.col("generation") <= G2))
    have = a.where("repo_id <> 'click'").unionByName(b.where("repo_id = 'click'"))
    return reconcile.advanced(fx.offsets(spark, d), have, b, G2)


CANDIDATES = f"""{REP}, bodies AS (SELECT *, 'b' || digest AS body FROM replicas),
    have AS (SELECT repo_id, digest, count(DISTINCT authority) AS n, min(body) AS have_body FROM bodies GROUP BY ALL),
    cand AS (SELECT repo_id, sha256('next:' || max(digest)) AS digest, arg_max(digest, generation) AS previous, 'new' AS body FROM certificates GROUP BY 1
        UNION ALL SELECT repo_id, digest, previous, CASE WHEN repo_id % 2 = 0 THEN 'b' || digest ELSE 'other' END FROM certificates WHERE generation = 0)"""


@query(f"""{CANDIDATES} SELECT c.repo_id, c.digest, CASE WHEN o.have_body IS NOT NULL AND o.have_body <> c.body THEN 'collision' WHEN o.have_body IS NOT NULL THEN 'known'
        WHEN c.previous IS NOT NULL AND coalesce(p.n, 0) < 2 THEN 'parent_missing' ELSE 'new' END AS status
    FROM cand c LEFT JOIN have o ON o.repo_id = c.repo_id AND o.digest = c.digest LEFT JOIN have p ON p.repo_id = c.repo_id AND p.digest = c.previous""")
def certificate_publish(spark, d):
    one = fx.certificates(spark, d)
    certs = fx.replicas(one).withColumn("body", F.concat(F.lit("b"), F.col("digest")))
    new = one.groupBy("repo_id").agg(ident.sha(F.concat(F.lit("next:"), F.max("digest"))).alias("digest"), F.max_by("digest", "generation").alias("previous"), F.lit("new").alias("body"))
    again = one.where("generation = 0").select("repo_id", "digest", "previous", F.when(F.col("repo_id") % 2 == 0, F.concat(F.lit("b"), F.col("digest"))).otherwise("other").alias("body"))
    return reconcile.publishable(new.unionByName(again), certs, 2)


@query(f"""{REPORT} SELECT repo_id, CASE WHEN ok AND NOT same THEN 'refused_divergent' WHEN ok THEN 'nothing' WHEN coalesce(a_healthy, false) OR coalesce(b_healthy, false) THEN 'copy' ELSE 'refused_unverified' END AS status FROM pairs""")
def repair_status(spark, d):
    return reconcile.repair_status(scrub.report(both(spark, d)))


@query(f"""{COPIES}, p AS (SELECT * FROM copies WHERE authority = 'primary') SELECT o.digest, o.bytes, CASE WHEN p.digest IS NULL THEN 'missing' WHEN sha256(p.data) <> o.digest THEN 'digest' WHEN strlen(p.data) <> o.bytes THEN 'bytes' ELSE 'ok' END AS status FROM one o LEFT JOIN p USING (digest)""")
def restore_single_replica(spark, d):
    one, two = copies(spark, d)
    return reconcile.verified_replay(one.select("digest", "bytes"), two, "primary")


@query(f"""{COPIES}, t AS (SELECT digest, data, bytes FROM copies WHERE authority = 'secondary'), fix AS (SELECT digest, data, bytes FROM one WHERE digest NOT IN (SELECT digest FROM t))
    SELECT digest, bytes, sha256(data) = digest AS valid FROM (SELECT * FROM t UNION ALL SELECT * FROM fix)""")
def chunk_repair(spark, d):
    one, two = copies(spark, d)
    have = two.where("authority = 'secondary'").select("digest", "data", "bytes")
    fixed = reconcile.upserted(have, one.join(have.select("digest"), "digest", "left_anti").select("digest", "data", "bytes"), ["digest"])
    return fixed.select("digest", "bytes", content.verified(F.col("data"), F.col("digest"), F.col("bytes")).alias("valid"))


@query(f"{CHUNKS} SELECT digest, 'blobs/sha256/' || substr(digest, 1, 2) || '/' || digest AS key, max(bytes) BETWEEN 0 AND 67108864 AS allowed FROM chunks GROUP BY 1")
def chunk_keys(spark, d):
    s = content.store(chunks(spark, d))
    return s.select("digest", ident.blob_key(F.col("digest")).alias("key"), ident.valid_chunk(F.col("digest"), F.col("bytes")).alias("allowed"))


@query(f"""{U}, p AS (SELECT repo_id, count(*) FILTER (event_id % 100 = 0 AND at_us > 1706400000000000) AS n_prepared, max(generation) AS head FROM updates GROUP BY 1)
    SELECT repo_id, head, n_prepared, head % 2 = 0 AND n_prepared = 0 AS admitted FROM p""")
def checkpoint_admission(spark, d):
    u = fx.updates(spark, d)
    p = u.groupBy("repo_id").agg(F.count_if((F.col("event_id") % 100 == 0) & (F.col("at_us") > 1_706_400_000_000_000)).alias("n_prepared"), F.max("generation").alias("head"))
    return p.select("repo_id", "head", "n_prepared", maintain.admits_checkpoint(F.col("head"), F.floor(F.col("head") / 2) * 2, F.col("n_prepared")).alias("admitted"))


@query(f"{REP} SELECT repo_id, digest, count(*) AS n FROM replicas GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT previous) > 1")
def conflicting_copies(spark, d):
    c = both(spark, d).groupBy("repo_id", "digest").agg(F.count("*").alias("n"), F.count_distinct("previous").alias("_p"))
    return c.where("n > 1 and _p > 1").select("repo_id", "digest", "n")


@query(f"""{U}, r AS ({refs()}), l AS (SELECT repo_id, ref || ' ' || oid || CASE WHEN hash_bucket = 0 THEN ' x' ELSE '' END AS line FROM (SELECT *, length(ref) % 2 AS hash_bucket FROM r))
    SELECT repo_id, count(*) AS n_lines, count(*) FILTER (len(string_split(line, ' ')) = 2) AS n_parsed FROM l GROUP BY 1""")
def ref_listing(spark, d):
    from logfold.sources.text import parse_refs

    r = state.fold(fx.updates(spark, d))
    lines = r.select("repo_id", F.concat_ws(" ", "ref", "oid", F.when(F.length("ref") % 2 == 0, F.lit("x"))).alias("line"))
    return parse_refs(lines, "line").groupBy("repo_id").agg(F.count("*").alias("n_lines"), F.count_if("ok").alias("n_parsed"))


@query(f"""{U} SELECT repo_id, count(*) AS n_commits, CAST(max(at_us) - min(at_us) AS DOUBLE) / 1000 AS span_ms, round(count(*) / (CAST(max(at_us) - min(at_us) AS DOUBLE) / 1000000), 9) AS commits_per_second, max(generation) AS generation,
    count(DISTINCT ref) AS n_refs FROM updates GROUP BY 1""")
def restore_report(spark, d):
    u = fx.updates(spark, d)
    span = F.max("at_us") - F.min("at_us")
    return u.groupBy("repo_id").agg(F.count("*").alias("n_commits"), ident.milliseconds(span).alias("span_ms"), F.round(F.count("*") / (span.cast("double") / 1_000_000), 9).alias("commits_per_second"), F.max("generation").alias("generation"), F.count_distinct("ref").alias("n_refs"))




@query(f"""WITH RECURSIVE e AS (SELECT conv_id AS repo_id, turn AS generation, sha256(text) AS tx, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    l(repo_id, generation, tx, n, digest, previous) AS (SELECT repo_id, generation, tx, n, sha256('{{"previous":"","generation":' || generation || ',"transaction":"' || tx || '"}}'), CAST(NULL AS VARCHAR) FROM e WHERE n = 1
        UNION ALL SELECT e.repo_id, e.generation, e.tx, e.n, sha256('{{"previous":"' || l.digest || '","generation":' || e.generation || ',"transaction":"' || e.tx || '"}}'), l.digest FROM e JOIN l ON e.repo_id = l.repo_id AND e.n = l.n + 1)
    SELECT repo_id, generation, tx, digest, previous, n = 1 AS anchor FROM l""")
def certificate_link(spark, d):
    c = fx.table(spark, d, "conversations")
    return chain.linked(c.select(F.col("conv_id").alias("repo_id"), F.col("turn").alias("generation"), ident.sha(F.col("text")).alias("tx")))


@query(f"""{REPORT}, st AS (SELECT repo_id, CASE WHEN ok AND NOT same THEN 'refused_divergent' WHEN ok THEN 'nothing' WHEN coalesce(a_healthy, false) OR coalesce(b_healthy, false) THEN 'copy' ELSE 'refused_unverified' END AS status FROM pairs),
    jobs AS (SELECT repo_id, CASE WHEN a_healthy THEN 'primary' ELSE 'secondary' END AS source, CASE WHEN a_healthy THEN 'secondary' ELSE 'primary' END AS target FROM pairs WHERE NOT ok AND (a_healthy OR b_healthy)),
    cp AS (SELECT j.repo_id, count(*) AS n FROM jobs j JOIN replicas s ON s.authority = source AND s.repo_id = j.repo_id WHERE NOT EXISTS (SELECT 1 FROM replicas t WHERE t.authority = target AND t.repo_id = j.repo_id AND t.digest = s.digest AND t.previous IS NOT DISTINCT FROM s.previous) GROUP BY 1),
    b AS (SELECT repo_id, status, coalesce(n, 0) AS n_copied, '{{"repository":"' || repo_id || '","status":"' || status || '","copied":' || coalesce(n, 0) || '}}' AS body FROM st LEFT JOIN cp USING (repo_id))
    SELECT *, sha256(body) || '.json' AS name FROM b""")
def repair_audit(spark, d):
    certs = both(spark, d)
    reports = scrub.report(certs)
    return scrub.audit(reconcile.repair_status(reports), scrub.repair_plan(certs, reports))
