"""The driver's tables as logs, replicas, chains and requests: the same rows on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logfold.functions.ident import ZERO, sha
from logfold.operators.state import numbered

REPO, REF = "repo_id", "ref"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts) -> F.Column:
    return F.unix_micros(ts.cast("timestamp"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ref updates: repo_id, generation, event_id, ref, old_oid, new_oid, bytes, at_us (microseconds)."""
    e = table(spark, sf_dir, "events")
    e = e.select(
        F.col("event_type").alias("repo_id"), "event_id", "user_id", F.concat(F.lit("refs/heads/u"), F.col("user_id")).alias("ref"), micros(F.col("ts")).alias("at_us"),
        F.when(F.col("event_id") % 7 == 0, F.lit(ZERO)).otherwise(F.substring(sha(F.col("event_id").cast("string")), 1, 40)).alias("new_oid"),
        F.floor(F.col("value") * 100).alias("bytes"), "value",
    )
    e = numbered(e, ["repo_id"], ["at_us", "event_id"], F.floor(F.col("at_us") / 86_400_000_000), "generation")
    before = F.lag("new_oid").over(Window.partitionBy("repo_id", "ref").orderBy("generation"))
    return e.withColumn("old_oid", F.coalesce(before, F.lit(ZERO)))


UPDATES_SQL = """log AS (SELECT event_type AS repo_id, event_id, user_id, 'refs/heads/u' || user_id AS ref, epoch_us(ts) AS at_us,
    CASE WHEN event_id % 7 = 0 THEN repeat('0', 40) ELSE substr(sha256(CAST(event_id AS VARCHAR)), 1, 40) END AS new_oid,
    CAST(floor(value * 100) AS BIGINT) AS bytes, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS generation FROM events),
updates AS (SELECT *, coalesce(lag(new_oid) OVER (PARTITION BY repo_id, ref ORDER BY generation), repeat('0', 40)) AS old_oid FROM log)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as requests: service, operation, status, micros, failed, at_us."""
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("request_id"), F.when(F.col("user_id") % 2 == 0, "git-upload-pack").otherwise("git-receive-pack").alias("service"),
        F.when(F.col("event_type").isin("purchase", "signup"), "write").otherwise("read").alias("operation"), F.when(failed, "500").otherwise("200").alias("status"),
        F.floor(F.col("value") * 1000).alias("micros"), failed.alias("failed"), (F.col("user_id") % 3).alias("node"), "event_type", micros(F.col("ts")).alias("at_us"),
    )


REQUESTS_SQL = """requests AS (SELECT event_id AS request_id, CASE WHEN user_id % 2 = 0 THEN 'git-upload-pack' ELSE 'git-receive-pack' END AS service,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS operation, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
    CAST(floor(value * 1000) AS BIGINT) AS micros, event_type = 'error' AS failed, user_id % 3 AS node, event_type, epoch_us(ts) AS at_us FROM events)"""


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten consumers of each repository at fixed strides of 150; the last may be ahead of the head."""
    repos = table(spark, sf_dir, "events").select(F.col("event_type").alias("repo_id")).distinct()
    return repos.withColumn("consumer", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("offset", (F.col("consumer") * 150).cast("long"))


OFFSETS_SQL = "offsets AS (SELECT repo_id, c AS consumer, CAST(c * 150 AS BIGINT) AS \"offset\" FROM (SELECT DISTINCT event_type AS repo_id FROM events), (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS c))"


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as transactions on one ref each: repo_id, tx, ref, arrival (microseconds)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("repo_id"), F.col("o_orderkey").alias("tx"), F.col("o_custkey").alias("ref"), micros(F.col("o_orderdate")).alias("arrival"), F.col("o_totalprice").alias("price"))


TRANSACTIONS_SQL = "tx AS (SELECT o_orderstatus AS repo_id, o_orderkey AS tx, o_custkey AS ref, epoch_us(o_orderdate) AS arrival, o_totalprice AS price FROM orders)"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as stored files: repo_id, path, kind, bytes, modified (microseconds)."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 10 == 0, "checkpoint").when(F.col("o_orderkey") % 10 == 1, "pending").otherwise("entry")
    return o.select(F.col("o_orderstatus").alias("repo_id"), "o_orderkey", kind.alias("kind"), F.format_string("%020d.wal", "o_orderkey").alias("path"), F.floor("o_totalprice").alias("bytes"), micros(F.col("o_orderdate")).alias("modified"))


LISTING_SQL = """listing AS (SELECT o_orderstatus AS repo_id, o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'checkpoint' WHEN o_orderkey % 10 = 1 THEN 'pending' ELSE 'entry' END AS kind,
    lpad(CAST(o_orderkey AS VARCHAR), 20, '0') || '.wal' AS path, CAST(floor(o_totalprice) AS BIGINT) AS bytes, epoch_us(o_orderdate) AS modified FROM orders)"""


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as hash chains: repo_id, generation, digest, previous."""
    c = table(spark, sf_dir, "conversations")
    digest = sha(F.concat_ws(":", "conv_id", "turn", "text"))
    c = c.select(F.col("conv_id").alias("repo_id"), F.col("turn").alias("generation"), digest.alias("digest"))
    return c.withColumn("previous", F.lag("digest").over(Window.partitionBy("repo_id").orderBy("generation")))


CERTIFICATES_SQL = """certificates AS (SELECT repo_id, generation, digest, lag(digest) OVER (PARTITION BY repo_id ORDER BY generation) AS previous
    FROM (SELECT conv_id AS repo_id, turn AS generation, sha256(concat_ws(':', conv_id, turn, text)) AS digest FROM conversations))"""


def replicas(certs: DataFrame) -> DataFrame:
    """Two copies of the chains with planted faults: the secondary lost the last link of every 5th chain and has a fork in every 7th; the primary has a broken link in every 11th."""
    last = F.max("generation").over(Window.partitionBy("repo_id"))
    base = certs.withColumn("last", last)
    primary = base.select(F.lit("primary").alias("authority"), "repo_id", "generation", "digest", F.when((F.col("repo_id") % 11 == 0) & (F.col("generation") == F.col("last")) & (F.col("generation") > 0), sha(F.lit("lost"))).otherwise(F.col("previous")).alias("previous"))
    secondary = base.where(~((F.col("repo_id") % 5 == 0) & (F.col("generation") == F.col("last")) & (F.col("generation") > 0))).select(F.lit("secondary").alias("authority"), "repo_id", "generation", "digest", "previous")
    fork = base.where((F.col("repo_id") % 7 == 0) & (F.col("generation") == 1)).select(F.lit("secondary").alias("authority"), "repo_id", "generation", sha(F.concat(F.lit("fork:"), F.col("digest"))).alias("digest"), "previous")
    return primary.unionByName(secondary).unionByName(fork)


REPLICAS_SQL = CERTIFICATES_SQL + """,
dated AS (SELECT *, max(generation) OVER (PARTITION BY repo_id) AS last FROM certificates),
replicas AS (SELECT 'primary' AS authority, repo_id, generation, digest, CASE WHEN repo_id % 11 = 0 AND generation = last AND generation > 0 THEN sha256('lost') ELSE previous END AS previous FROM dated
    UNION ALL SELECT 'secondary', repo_id, generation, digest, previous FROM dated WHERE NOT (repo_id % 5 = 0 AND generation = last AND generation > 0)
    UNION ALL SELECT 'secondary', repo_id, generation, sha256('fork:' || digest), previous FROM dated WHERE repo_id % 7 = 0 AND generation = 1)"""


def chunk_replicas(chunks: DataFrame) -> DataFrame:
    """Two copies of chunks (digest, data): the secondary misses digests that begin with 00 and 01, the primary's copies of those with 02 are altered."""
    head = F.substring("digest", 1, 2)
    primary = chunks.select(F.lit("primary").alias("authority"), "digest", "bytes", F.when(head == "02", F.concat(F.lit("x"), F.col("data"))).otherwise(F.col("data")).alias("data"))
    return primary.unionByName(chunks.where(~head.isin("00", "01")).select(F.lit("secondary").alias("authority"), "digest", "bytes", "data"))
