"""Reads that join a log with its certificates and consumers: authority, catch-up, publishing, restore, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.functions.ident import sha
from logfold.operators import state
from logfold.operators.scrub import divergence


def authoritative(manifests: DataFrame, chains: DataFrame) -> DataFrame:
    """Each repository's true generation: a newer chain wins; a manifest ahead of its chain, or with another digest, is an error.

    manifests: repo_id, generation, digest; chains: repo_id, generation, head."""
    m = manifests.select("repo_id", F.col("generation").alias("m_generation"), F.col("digest").alias("m_digest"))
    both = m.join(chains.select("repo_id", F.col("generation").alias("c_generation"), "head"), "repo_id", "full_outer")
    mg, cg = F.col("m_generation"), F.col("c_generation")
    status = F.when(cg.isNull(), "manifest_only").when(mg.isNull(), "recovered").when(mg > cg, "manifest_ahead").when(mg < cg, "chain_newer").when(F.col("m_digest").eqNullSafe(F.col("head")), "equal").otherwise("digest_mismatch")
    return both.select("repo_id", F.coalesce(F.greatest(mg, cg), mg, cg).alias("generation"), status.alias("status"))


def catch_up(updates: DataFrame, offsets: DataFrame, checkpoint: int) -> DataFrame:
    """What each consumer must do: nothing at the head, else the checkpoint if it is behind it, then the tail.

    One row a consumer: head, from_checkpoint, n_tail, and the offset after a verified replay."""
    heads = updates.groupBy("repo_id").agg(F.max("generation").alias("head"))
    out = offsets.join(heads, "repo_id").where(F.col("offset") <= F.col("head"))
    restores = (F.col("offset") < checkpoint) & (F.col("head") >= checkpoint) & (F.col("offset") != F.col("head"))
    out = out.withColumn("from_checkpoint", restores)
    start = F.when(F.col("from_checkpoint"), F.lit(checkpoint)).otherwise(F.col("offset"))
    return out.select("repo_id", "consumer", "offset", "head", "from_checkpoint", (F.col("head") - start).alias("n_tail"), F.col("head").alias("new_offset"))


def advanced(offsets: DataFrame, have: DataFrame, want: DataFrame, generation: int) -> DataFrame:
    """offsets moved to a generation where the refs verify; elsewhere they stay, silently."""
    ok = state.verify(have, want).select("repo_id", "equal")
    return offsets.join(ok, "repo_id", "left").withColumn("offset", F.when(F.coalesce("equal", F.lit(True)), F.lit(generation).cast("long")).otherwise(F.col("offset"))).drop("equal")


def publishable(candidates: DataFrame, certs: DataFrame, authorities: int) -> DataFrame:
    """candidates (repo_id, digest, previous, body) with status: new, known, collision, or parent_missing unless every authority has the parent."""
    have = certs.groupBy("repo_id", "digest").agg(F.count_distinct("authority").alias("n"), F.min("body").alias("have_body"))
    own = have.select("repo_id", "digest", "have_body")
    parent = have.select("repo_id", F.col("digest").alias("previous"), F.col("n").alias("n_parent"))
    joined = candidates.join(own, ["repo_id", "digest"], "left").join(parent, ["repo_id", "previous"], "left")
    status = (
        F.when(F.col("have_body").isNotNull() & (F.col("have_body") != F.col("body")), "collision").when(F.col("have_body").isNotNull(), "known")
        .when(F.col("previous").isNotNull() & (F.coalesce("n_parent", F.lit(0)) < authorities), "parent_missing").otherwise("new")
    )
    return joined.select("repo_id", "digest", status.alias("status"))


def verified_replay(entries: DataFrame, archives: DataFrame, source: str) -> DataFrame:
    """Entries of one replica with status: ok, missing, digest or bytes. The other replica isn't read."""
    a = archives.where(F.col("authority") == source).select("digest", F.col("data"), F.lit(True).alias("found"))
    out = entries.join(a, "digest", "left")
    status = F.when(F.col("found").isNull(), "missing").when(sha(F.col("data")) != F.col("digest"), "digest").when(F.octet_length("data") != F.col("bytes"), "bytes").otherwise("ok")
    return out.withColumn("status", status).drop("data", "found")


def repair_status(reports: DataFrame) -> DataFrame:
    """One row a chain: what a repair does, or why it refuses."""
    d = divergence(reports)
    a, b = F.coalesce("a_healthy", F.lit(False)), F.coalesce("b_healthy", F.lit(False))
    status = F.when(F.col("diverged"), "refused_divergent").when(F.col("healthy"), "nothing").when(a | b, "copy").otherwise("refused_unverified")
    return d.select("repo_id", status.alias("status"))


def upserted(have: DataFrame, copies: DataFrame, keys: list[str]) -> DataFrame:
    """have with copies in the place of rows with equal keys."""
    return have.join(copies.select(*keys), keys, "left_anti").unionByName(copies)
