"""Checkpoints, compaction, garbage collection and eviction, as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.operators.state import fold


def checkpoint(updates: DataFrame, generation: int) -> DataFrame:
    """Refs at a generation, with that generation."""
    return fold(updates.where(F.col("generation") <= generation)).withColumn("generation", F.lit(generation).cast("long"))


def newest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The checkpoint with the largest generation of each repository; one that is behind never replaces it."""
    return checkpoints.groupBy("repo_id").agg(F.max("generation").alias("generation"), F.max_by("file", "generation").alias("file"))


def retained(entries: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Entries after their repository's checkpoint."""
    c = checkpoints.select("repo_id", F.col("generation").alias("_at"))
    return entries.join(c, "repo_id", "left").where(F.col("generation") > F.coalesce("_at", F.lit(0))).drop("_at")


def log_size(entries: DataFrame) -> DataFrame:
    return entries.groupBy("repo_id").agg(F.count("*").alias("n_entries"), F.sum(F.col("bytes") + F.coalesce("payload_bytes", F.lit(0))).alias("log_bytes"))


def due(n: Column, size: Column, most_entries: int, most_bytes: int) -> Column:
    """Whether a log needs compaction; a bound of 0 is off."""
    return ((n >= most_entries) & F.lit(most_entries > 0)) | ((size >= most_bytes) & F.lit(most_bytes > 0))


def admits_checkpoint(generation: Column, expected: Column, n_prepared: Column) -> Column:
    return (generation == expected) & (n_prepared == 0)


def garbage(listing: DataFrame, referenced: DataFrame, staged: DataFrame, cutoff: int) -> DataFrame:
    """Files that nothing refers to, staged ids included, and that were modified before the cutoff (strictly)."""
    old = listing.where(F.col("modified") < cutoff)
    kept = referenced.select("repo_id", "path").unionByName(staged.select("repo_id", "path")).distinct()
    return old.join(kept, ["repo_id", "path"], "left_anti")


def garbage_counts(plan: DataFrame) -> DataFrame:
    of = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
    return plan.groupBy("repo_id").agg(of("entry"), of("checkpoint"), of("pending"), F.sum("bytes").alias("bytes"))


def maintenance(sizes: DataFrame, activity: DataFrame, healthy: Column, now: int, most_entries: int, most_bytes: int, idle: int) -> DataFrame:
    """One row a repository: whether to compact, collect and evict; the scrub gate comes before all of them."""
    out = sizes.join(activity, "repo_id", "left")
    evict = F.lit(idle > 0) & (F.lit(now) - F.col("last_activity") >= idle)
    return out.select("repo_id", "n_entries", "log_bytes", (healthy & due(F.col("n_entries"), F.col("log_bytes"), most_entries, most_bytes)).alias("compact"), healthy.alias("collect"), (healthy & F.coalesce(evict, F.lit(False))).alias("evict"))
