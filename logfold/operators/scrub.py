"""Verification of replicas: issues, reports, divergence, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfold.functions.ident import identity_matches
from logfold.operators.chain import KEYS, newest, validity


def _checked(certs: DataFrame) -> DataFrame:
    """One row a replica of a chain: links, depth, head and the first failing check; the chains are walked once."""
    found = validity(certs).join(newest(certs), KEYS).withColumn(
        "found", F.expr("""array(
            CASE WHEN n_links <> n_distinct OR n_unlinked > 0 THEN struct(2 AS check_order, 'certificate-chain' AS kind) END,
            CASE WHEN fork THEN struct(3 AS check_order, 'certificate-head' AS kind) END,
            CASE WHEN depth <> n_links THEN struct(4 AS check_order, 'certificate-fork' AS kind) END)"""),
    )
    return found.withColumn("first", F.get(F.filter("found", lambda x: x.isNotNull()), F.lit(0)))


def issues(certs: DataFrame) -> DataFrame:
    """The first failing check of each replica of each chain: an ordered cascade, without row where all pass."""
    return _checked(certs).where("first is not null").select(*KEYS, "first.check_order", "first.kind")


def report(certs: DataFrame) -> DataFrame:
    """One row a replica of a chain: links, depth, head, issue and health."""
    return _checked(certs).select(*KEYS, "n_links", "depth", "generation", "head", F.coalesce("first.kind", F.lit("")).alias("issue"), F.col("first").isNull().alias("healthy"))


def verified_entries(entries: DataFrame, descriptors: DataFrame) -> DataFrame:
    """entries (repo_id, tx, descriptor, transaction_id, updates, payload_bytes) with the first check that their descriptor fails.

    In turn: no descriptor or none with its digest, one that points to another, an id that isn't the entry's or isn't
    its updates' digest, updates that aren't the entry's in order, and other payload bytes. descriptors: digest,
    transaction_id, updates, payload_bytes, points_to."""
    names = {c: f"d_{c}" for c in ("transaction_id", "updates", "payload_bytes", "points_to")}
    d = descriptors.select(F.col("digest").alias("descriptor"), *(F.col(c).alias(n) for c, n in names.items()), F.lit(True).alias("found"))
    status = (
        F.when(F.col("found").isNull(), "descriptor").when(F.col("d_points_to").isNotNull(), "nested")
        .when((F.col("d_transaction_id") != F.col("transaction_id")) | ~identity_matches(F.col("d_transaction_id"), F.col("d_updates")), "identity")
        .when(~F.col("d_updates").eqNullSafe(F.col("updates")), "updates").when(F.col("d_payload_bytes") != F.col("payload_bytes"), "payload").otherwise("ok")
    )
    return entries.join(d, "descriptor", "left").withColumn("status", status).drop(*names.values(), "found")


def verified_counts(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a repository: entries, distinct descriptors, distinct chunks and their bytes, and whether a chunk has two lengths."""
    e = entries.groupBy("repo_id").agg(F.count("*").alias("n_entries"), F.count_distinct("descriptor").alias("n_descriptors"))
    once = chunks.groupBy("repo_id", "digest").agg(F.max("bytes").alias("bytes"), (F.min("bytes") != F.max("bytes")).alias("conflict"))
    c = once.groupBy("repo_id").agg(F.count("*").alias("n_chunks"), F.sum("bytes").alias("verified_bytes"), F.some("conflict").alias("conflict"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return e.join(c, "repo_id", "left").select("repo_id", "n_entries", "n_descriptors", zero("n_chunks"), zero("verified_bytes"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def divergence(reports: DataFrame, first: str = "primary", second: str = "secondary") -> DataFrame:
    """Both replicas side by side; two healthy ones diverge if head or generation differ."""
    side = lambda a, p: reports.where(F.col("authority") == a).select("repo_id", F.col("healthy").alias(f"{p}_healthy"), F.col("head").alias(f"{p}_head"), F.col("generation").alias(f"{p}_generation"))
    both = side(first, "a").join(side(second, "b"), "repo_id", "full_outer")
    ok = F.coalesce("a_healthy", F.lit(False)) & F.coalesce("b_healthy", F.lit(False))
    same = F.col("a_head").eqNullSafe(F.col("b_head")) & F.col("a_generation").eqNullSafe(F.col("b_generation"))
    return both.withColumn("diverged", ok & ~same).withColumn("healthy", ok & same)


def repair_plan(certs: DataFrame, reports: DataFrame) -> DataFrame:
    """Links to copy from the healthy replica to the other one, with each chain's status.

    Without a healthy replica the source is unverified, and two healthy ones that differ aren't repaired."""
    d = divergence(reports)
    status = F.when(F.col("diverged"), "divergent").when(F.col("healthy"), "nothing").when(F.coalesce("a_healthy", F.lit(False)), "copy_to_secondary").when(F.coalesce("b_healthy", F.lit(False)), "copy_to_primary").otherwise("unverified_source")
    plan = d.select("repo_id", status.alias("status"))
    source = F.when(F.col("status") == "copy_to_secondary", "primary").when(F.col("status") == "copy_to_primary", "secondary")
    target = F.when(F.col("status") == "copy_to_secondary", "secondary").when(F.col("status") == "copy_to_primary", "primary")
    jobs = plan.withColumn("source", source).withColumn("target", target).where("source is not null")
    have = certs.select(F.col("authority").alias("target"), "repo_id", "digest", "previous")
    wanted = certs.join(jobs, (certs["authority"] == jobs["source"]) & (certs["repo_id"] == jobs["repo_id"])).select(certs["repo_id"], "target", "digest", "previous", "generation")
    same = (wanted["repo_id"] == have["repo_id"]) & (wanted["target"] == have["target"]) & (wanted["digest"] == have["digest"]) & wanted["previous"].eqNullSafe(have["previous"])
    return wanted.join(have, same, "left_anti").select("repo_id", "target", "generation", "digest")


def first_of(found: DataFrame, keys: list[str]) -> DataFrame:
    """The first issue of each key by check order and kind."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("check_order", "kind"))
    return found.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def audit(status: DataFrame, plan: DataFrame) -> DataFrame:
    """One content-named record a chain, also where nothing was copied: what a repair writes to both replicas."""
    n = plan.groupBy("repo_id").agg(F.count("*").alias("n_copied"))
    out = status.join(n, "repo_id", "left").withColumn("n_copied", F.coalesce("n_copied", F.lit(0)))
    body = F.format_string('{"repository":"%s","status":"%s","copied":%d}', F.col("repo_id").cast("string"), "status", "n_copied")
    return out.withColumn("body", body).withColumn("name", F.concat(F.sha2("body", 256), F.lit(".json")))
