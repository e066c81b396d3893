"""Queries over chunks, replicas and hash chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from logfold.functions import ident
from logfold.operators import chain, content, policy, scrub
from logfold.sources import fixtures as fx

from .registry import query

CHUNKS = """WITH c AS (SELECT doc_id, source, i AS ordinal, substr(text, i * 8192 + 1, 8192) AS data FROM (SELECT doc_id, source, text, unnest(range(0, CAST(ceil(length(text) / 8192.0) AS BIGINT))) AS i FROM documents)),
    chunks AS (SELECT *, sha256(data) AS digest, CAST(strlen(data) AS BIGINT) AS bytes FROM c)"""


def chunks(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("data"))
    return content.chunked(docs)


@query(f"{CHUNKS} SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, digest, bytes FROM chunks")
def chunk_objects(spark, d):
    return chunks(spark, d).select("doc_id", "ordinal", "digest", "bytes")


@query(f"""{CHUNKS}, s AS (SELECT digest, max(bytes) AS bytes, count(*) AS n_refs, min(bytes) = max(bytes) AS consistent FROM chunks GROUP BY 1)
    SELECT n_refs, count(*) AS n_chunks, sum(bytes) AS stored_bytes, sum(bytes * n_refs) AS logical_bytes, bool_and(consistent) AS consistent FROM s GROUP BY 1""")
def chunk_dedup_stats(spark, d):
    s = content.store(chunks(spark, d))
    return s.groupBy("n_refs").agg(F.count("*").alias("n_chunks"), F.sum("bytes").alias("stored_bytes"), F.sum(F.col("bytes") * F.col("n_refs")).alias("logical_bytes"), F.every("consistent").alias("consistent"))


@query(f"{CHUNKS} SELECT digest, max(bytes) AS bytes FROM chunks GROUP BY 1 HAVING NOT bool_or(doc_id % 3 = 0)")
def chunk_put_plan(spark, d):
    c = chunks(spark, d)
    return content.missing(c.select("digest", "bytes"), c.where("doc_id % 3 = 0").select("digest").distinct()).select("digest", "bytes")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, CAST(ceil(length(coalesce(text, '')) / 8192.0) AS BIGINT) AS n_chunks, true AS matches FROM documents")
def object_reassemble_verify(spark, d):
    """Every document, also an empty one; a null text is empty."""
    docs = fx.table(spark, d, "documents").select("doc_id", ident.sha(F.coalesce("text", F.lit(""))).alias("want"))
    whole = content.reassembled(chunks(spark, d), ["doc_id"], docs)
    return whole.join(docs, "doc_id").select("doc_id", "digest", "bytes", "n_chunks", (F.col("digest") == F.col("want")).alias("matches"))


@query("SELECT source, sum(strlen(text)) AS bytes, CASE WHEN sum(strlen(text)) < 1048576 THEN 'inline' ELSE 'external' END AS placement FROM documents GROUP BY 1")
def externalize_decision(spark, d):
    s = fx.table(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"))
    return s.withColumn("placement", content.placement(F.col("bytes")))


COPIES = CHUNKS + """, one AS (SELECT digest, any_value(data) AS data, max(bytes) AS bytes FROM chunks GROUP BY 1),
    copies AS (SELECT 'primary' AS authority, digest, bytes, CASE WHEN substr(digest, 1, 2) = '02' THEN 'x' || data ELSE data END AS data FROM one
        UNION ALL SELECT 'secondary', digest, bytes, data FROM one WHERE substr(digest, 1, 2) NOT IN ('00', '01'))"""


def copies(spark, d):
    one = chunks(spark, d).groupBy("digest").agg(F.min("data").alias("data"), F.max("bytes").alias("bytes"))
    return one, fx.chunk_replicas(one)


@query(f"""{COPIES}, good AS (SELECT digest, min(authority) AS served_by FROM copies WHERE sha256(data) = digest AND strlen(data) = bytes GROUP BY 1) SELECT digest, bytes, served_by FROM one LEFT JOIN good USING (digest)""")
def replica_read_fallback(spark, d):
    one, both = copies(spark, d)
    return content.read_fallback(one.select("digest", "bytes"), both)


@query(f"""{COPIES} SELECT digest, count(DISTINCT authority) FILTER (sha256(data) = digest AND strlen(data) = bytes) AS n_acks, count(DISTINCT authority) FILTER (sha256(data) = digest AND strlen(data) = bytes) = 2 AS complete FROM copies GROUP BY 1""")
def replica_ack_complete(spark, d):
    return content.acknowledged(copies(spark, d)[1], 2)


@query("""WITH s AS (SELECT doc_id AS id, sha256(text) AS digest FROM documents), d AS (SELECT sha256(text) AS digest, max(CAST(strlen(text) AS BIGINT)) AS payload_bytes, CASE WHEN min(doc_id) % 6 = 0 THEN 'x' END AS points_to FROM documents WHERE length(text) % 5 <> 0 GROUP BY 1)
    SELECT id, digest, payload_bytes, CASE WHEN payload_bytes IS NULL THEN 'missing' WHEN points_to IS NOT NULL THEN 'nested' ELSE 'ok' END AS status FROM s LEFT JOIN d USING (digest)""")
def descriptor_resolve(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), ident.sha(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("bytes"), F.length("text").alias("n"))
    known = docs.where("n % 5 <> 0").groupBy("digest").agg(F.max("bytes").alias("payload_bytes"), F.when(F.min("id") % 6 == 0, "x").alias("points_to"))
    return content.resolved(docs.select("id", "digest"), known).select("id", "digest", "payload_bytes", "status")


REP = "WITH RECURSIVE " + fx.REPLICAS_SQL + """,
    walked(authority, repo_id, digest, depth) AS (SELECT authority, repo_id, digest, 1 FROM replicas WHERE previous IS NULL
        UNION ALL SELECT r.authority, r.repo_id, r.digest, depth + 1 FROM replicas r JOIN walked w ON r.authority = w.authority AND r.repo_id = w.repo_id AND r.previous = w.digest),
    v AS (SELECT r.authority, r.repo_id, count(*) AS n_links, count(DISTINCT r.digest) AS n_distinct, count(*) FILTER (depth IS NULL) AS n_unlinked, count(*) FILTER (previous IS NULL) AS n_roots, CAST(coalesce(max(depth), 0) AS INTEGER) AS depth
        FROM replicas r LEFT JOIN walked w USING (authority, repo_id, digest) GROUP BY ALL),
    validity AS (SELECT *, n_unlinked = 0 AND n_roots = 1 AND n_links = n_distinct AS valid FROM v),
    top AS (SELECT authority, repo_id, generation, count(DISTINCT digest) AS n, min(digest) AS digest FROM replicas GROUP BY ALL),
    newest AS (SELECT authority, repo_id, max(generation) AS generation, CASE WHEN arg_max(n, generation) = 1 THEN arg_max(digest, generation) END AS head, arg_max(n, generation) > 1 AS fork FROM top GROUP BY ALL)"""


def both(spark, d):
    return fx.replicas(fx.certificates(spark, d))


@query(f"{REP} SELECT r.authority, r.repo_id, r.digest, CAST(depth AS INTEGER) AS depth FROM replicas r LEFT JOIN walked w USING (authority, repo_id, digest)")
def cert_chain_depth(spark, d):
    return chain.walk(both(spark, d)).select("authority", "repo_id", "digest", "depth")


@query(f"{REP} SELECT * FROM validity")
def cert_chain_validate(spark, d):
    return chain.validity(both(spark, d))


@query(f"""{REP}, thinned AS (SELECT repo_id, generation, digest, lag(digest) OVER (PARTITION BY repo_id ORDER BY generation) AS previous FROM certificates WHERE NOT (repo_id % 4 = 0 AND generation = 2))
    SELECT c.repo_id, count(*) AS n_links, count(*) FILTER (p.generation IS NULL) AS n_roots, count(*) FILTER (c.generation - p.generation > 1) AS n_gaps, count(*) FILTER (c.generation - p.generation < 1) AS n_backward
    FROM thinned c LEFT JOIN thinned p ON c.repo_id = p.repo_id AND c.previous = p.digest GROUP BY 1""")
def cert_contiguity(spark, d):
    from pyspark.sql import Window

    c = fx.certificates(spark, d).where(~((F.col("repo_id") % 4 == 0) & (F.col("generation") == 2)))
    c = c.withColumn("previous", F.lag("digest").over(Window.partitionBy("repo_id").orderBy("generation")))
    return chain.contiguity(c, ["repo_id"])


@query(f"{REP} SELECT authority, repo_id, generation, head, fork FROM newest")
def cert_newest_or_fork(spark, d):
    return chain.newest(both(spark, d))


@query(f"""{REP}, ok AS (SELECT authority, repo_id FROM validity WHERE valid), n AS (SELECT repo_id, count(*) AS n_valid FROM ok GROUP BY 1),
    common AS (SELECT r.repo_id, digest, generation, n_valid FROM replicas r JOIN ok USING (authority, repo_id) JOIN n USING (repo_id) GROUP BY ALL HAVING count(DISTINCT authority) = n_valid)
    SELECT repo_id, max(generation) AS generation, arg_max(digest, generation) AS head, max(n_valid) AS n_valid, max(n_valid) = 1 AS survivor_only FROM (SELECT * FROM common WHERE (repo_id, generation) NOT IN (SELECT repo_id, generation FROM common GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT repo_id, max(digest), generation, max(n_valid) FROM common GROUP BY repo_id, generation HAVING count(*) > 1) GROUP BY 1""")
def cert_recover_common(spark, d):
    certs = both(spark, d)
    got = chain.recovered(certs)
    return got


@query(f"""WITH {fx.CERTIFICATES_SQL}, n AS (SELECT CASE WHEN generation % 4 = 3 THEN 'x' ELSE '' END || lpad(CAST(generation AS VARCHAR), 20, '0') || '-' || CASE WHEN repo_id % 9 = 0 THEN upper(digest) ELSE digest END || '.cert' AS name, repo_id FROM certificates),
    p AS (SELECT repo_id, name, regexp_full_match(name, '[0-9]{{20}}-[0-9a-f]{{64}}\\.cert') AS ok FROM n)
    SELECT repo_id, name, ok, CASE WHEN ok THEN CAST(substr(name, 1, 20) AS BIGINT) END AS generation, CASE WHEN ok THEN substr(name, 22, 64) END AS digest FROM p""")
def cert_name_parse(spark, d):
    c = fx.certificates(spark, d)
    name = ident.certificate_name(F.col("generation"), F.when(F.col("repo_id") % 9 == 0, F.upper("digest")).otherwise(F.col("digest")))
    c = c.select("repo_id", F.concat(F.when(F.col("generation") % 4 == 3, "x").otherwise(""), name).alias("name")).withColumn("p", ident.parsed_certificate_name(F.col("name")))
    return c.select("repo_id", "name", "p.ok", "p.generation", "p.digest")


REPORT = REP + """, found AS (SELECT authority, repo_id, CASE WHEN n_links <> n_distinct OR n_unlinked > 0 THEN 2 WHEN fork THEN 3 WHEN depth <> n_links THEN 4 END AS check_order FROM validity JOIN newest USING (authority, repo_id)),
    issues AS (SELECT *, CASE check_order WHEN 2 THEN 'certificate-chain' WHEN 3 THEN 'certificate-head' ELSE 'certificate-fork' END AS kind FROM found WHERE check_order IS NOT NULL),
    report AS (SELECT v.authority, v.repo_id, n_links, depth, generation, head, coalesce(kind, '') AS issue, kind IS NULL AS healthy FROM validity v JOIN newest USING (authority, repo_id) LEFT JOIN issues i ON v.authority = i.authority AND v.repo_id = i.repo_id),
    div AS (SELECT repo_id, a.healthy AS a_healthy, a.head AS a_head, a.generation AS a_generation, b.healthy AS b_healthy, b.head AS b_head, b.generation AS b_generation
        FROM (SELECT * FROM report WHERE authority = 'primary') a FULL JOIN (SELECT * FROM report WHERE authority = 'secondary') b USING (repo_id)),
    pairs AS (SELECT *, coalesce(a_healthy, false) AND coalesce(b_healthy, false) AS ok, a_head IS NOT DISTINCT FROM b_head AND a_generation IS NOT DISTINCT FROM b_generation AS same FROM div)"""


@query(f"{REPORT} SELECT authority, repo_id, check_order, kind FROM issues")
def scrub_issues(spark, d):
    return scrub.issues(both(spark, d))


@query(f"{REPORT} SELECT * FROM report")
def scrub_report(spark, d):
    return scrub.report(both(spark, d))


@query(f"{REPORT} SELECT repo_id, a_healthy, a_head, a_generation, b_healthy, b_head, b_generation, ok AND NOT same AS diverged, ok AND same AS healthy FROM pairs")
def authority_divergence(spark, d):
    return scrub.divergence(scrub.report(both(spark, d)))


@query(f"""{REPORT}, jobs AS (SELECT repo_id, CASE WHEN a_healthy THEN 'primary' ELSE 'secondary' END AS source, CASE WHEN a_healthy THEN 'secondary' ELSE 'primary' END AS target FROM pairs WHERE NOT ok AND (a_healthy OR b_healthy))
    SELECT j.repo_id, target, generation, digest FROM jobs j JOIN replicas s ON s.authority = source AND s.repo_id = j.repo_id
    WHERE NOT EXISTS (SELECT 1 FROM replicas t WHERE t.authority = target AND t.repo_id = j.repo_id AND t.digest = s.digest AND t.previous IS NOT DISTINCT FROM s.previous)""")
def repair_plan(spark, d):
    certs = both(spark, d)
    return scrub.repair_plan(certs, scrub.report(certs))


RETENTION = """WITH r AS (SELECT s_suppkey, a AS authority, CASE WHEN (s_suppkey + k) % 13 = 0 THEN 'Suspended' ELSE 'Enabled' END AS versioning, CASE WHEN (s_suppkey + k) % 11 = 0 THEN 'Disabled' ELSE 'Enabled' END AS object_lock,
        ['COMPLIANCE', 'GOVERNANCE', 'NONE', 'COMPLIANCE'][1 + (s_suppkey + k) % 4] AS mode, CAST(s_suppkey % 60 AS INTEGER) AS days, CAST(CASE WHEN (s_suppkey + k) % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS years
        FROM supplier, (VALUES ('primary', 0), ('secondary', 1)) t(a, k)),
    e AS (SELECT *, CASE WHEN days > 0 AND years = 0 THEN days WHEN years > 0 AND days = 0 THEN years * 365 END AS rule_days FROM r),
    i AS (SELECT *, CASE WHEN versioning <> 'Enabled' THEN 'versioning' WHEN object_lock <> 'Enabled' THEN 'object-lock' WHEN rule_days IS NULL THEN 'rule' WHEN mode NOT IN ('COMPLIANCE', 'GOVERNANCE') THEN 'mode'
        WHEN NOT (mode = 'GOVERNANCE' OR mode = 'COMPLIANCE') THEN 'mode' WHEN rule_days < 30 THEN 'days' ELSE '' END AS issue FROM e)"""


@query(f"{RETENTION} SELECT s_suppkey, authority, issue, rule_days, bool_and(issue = '') OVER (PARTITION BY s_suppkey) AS compliant FROM i")
def retention_check(spark, d):
    s = fx.table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(F.struct(F.lit("primary").alias("authority"), F.lit(0).alias("k")), F.struct(F.lit("secondary").alias("authority"), F.lit(1).alias("k")))).alias("t"))
    x = F.col("s_suppkey") + F.col("t.k")
    settings = s.select(
        "s_suppkey", "t.authority", F.when(x % 13 == 0, "Suspended").otherwise("Enabled").alias("versioning"), F.when(x % 11 == 0, "Disabled").otherwise("Enabled").alias("object_lock"),
        F.get(F.array(*map(F.lit, ("COMPLIANCE", "GOVERNANCE", "NONE", "COMPLIANCE"))), (x % 4).cast("int")).alias("mode"), (F.col("s_suppkey") % 60).cast("int").alias("days"), F.when(x % 7 == 0, 1).otherwise(0).alias("years"),
    )
    return policy.retention_report(settings, ["s_suppkey"], 30, "GOVERNANCE").select("s_suppkey", "authority", "issue", "rule_days", "compliant")
