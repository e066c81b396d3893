"""Counters, nearest-rank percentiles, batch statistics, text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.functions.ident import milliseconds


def latency_summary(df: DataFrame, keys: list[str], value: str = "micros") -> DataFrame:
    """One row a key: n, mean, p50, p90, p99 and max in milliseconds; index trunc((n - 1) p + 0.5) of the ascending order.

    Equal values collapse to counts before the shuffle, so a key costs as many rows as it has distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = counts.withColumn("_upto", F.sum("_n").over(by.orderBy(value))).withColumn("_all", F.sum("_n").over(by))
    at = lambda p: F.floor((F.col("_all") - 1) * F.lit(p) + 0.5)
    pick = lambda p: F.min(F.when(F.col("_upto") > at(p), milliseconds(F.col(value))))
    mean = F.sum(F.col(value) * F.col("_n")).cast("double") / 1000 / F.sum("_n")
    return ranked.groupBy(*keys).agg(F.sum("_n").alias("n"), mean.alias("mean_ms"), pick(0.5).alias("p50_ms"), pick(0.9).alias("p90_ms"), pick(0.99).alias("p99_ms"), milliseconds(F.max(value)).alias("max_ms"))


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("service", "operation", "status").agg(F.count("*").alias("n"))


def op_counters(requests: DataFrame, key: str) -> DataFrame:
    """Calls, failures, seconds, last run and last success of each operation."""
    seconds = F.sum("micros").cast("double") / 1_000_000
    return requests.groupBy(key).agg(F.count("*").alias("n"), F.count_if("failed").alias("n_failed"), seconds.alias("seconds"), F.max("at_us").alias("last_run"), F.max(F.when(~F.col("failed"), F.col("at_us"))).alias("last_success"))


def gate(configured: Column, healthy: Column) -> Column:
    """Writes pass where scrubbing isn't configured or its last result was healthy."""
    return ~configured | F.coalesce(healthy, F.lit(False))


def readiness(repos: DataFrame) -> DataFrame:
    n = F.count_if(~F.col("available"))
    return repos.agg(F.count("*").alias("n_repos"), n.alias("n_unavailable"), (n == 0).alias("ready"))


def batch_stats(batches: DataFrame) -> DataFrame:
    """Over (repo_id, batch, n): requests, batches, largest and mean batch."""
    return batches.groupBy("repo_id").agg(F.sum("n").alias("n_requests"), F.count("*").alias("n_batches"), F.max("n").alias("max_batch"), (F.sum("n").cast("double") / F.count("*")).alias("mean_batch"))


def exposition(counts: DataFrame, name: str) -> DataFrame:
    """Text lines of a counter, with the sort keys: service, operation and status as text."""
    line = F.format_string(name + '{service="%s",operation="%s",status="%s"} %d', "service", "operation", "status", "n")
    return counts.select("service", "operation", "status", line.alias("line"))


#: The exposition's families in their order, with name, kind, help and the format of a value.
FAMILIES = [
    ("http_requests_total", "counter", "Git smart HTTP requests.", "%d"), ("http_active_requests", "gauge", "Active Git smart HTTP requests.", "%d"), ("http_auth_failures_total", "counter", "Rejected authentication attempts.", "%d"),
    ("reconcile_total", "counter", "Repository reconciliation attempts.", "%d"), ("reconcile_failures_total", "counter", "Failed repository reconciliations.", "%d"), ("reconcile_seconds_total", "counter", "Time spent reconciling repository caches.", "%.9f"),
    ("git_backend_total", "counter", "Git backend invocations.", "%d"), ("git_backend_failures_total", "counter", "Failed Git backend invocations.", "%d"), ("git_backend_seconds_total", "counter", "Time spent in Git backend processes.", "%.9f"),
    ("maintenance_runs_total", "counter", "Repository maintenance attempts.", "%d"), ("maintenance_failures_total", "counter", "Failed repository maintenance attempts.", "%d"),
    ("compactions_total", "counter", "Completed repository checkpoints.", "%d"), ("garbage_collections_total", "counter", "Completed garbage-collection passes.", "%d"), ("cache_evictions_total", "counter", "Completed local cache evictions.", "%d"),
    ("scrub_configured", "gauge", "Whether continuous dual-authority scrubbing is configured.", "%d"), ("scrub_healthy", "gauge", "Whether the latest configured durability scrub succeeded.", "%d"), ("scrub_runs_total", "counter", "Completed dual-authority scrub attempts.", "%d"),
    ("scrub_failures_total", "counter", "Failed dual-authority scrub attempts.", "%d"), ("scrub_seconds_total", "counter", "Time spent performing dual-authority scrubs.", "%.9f"), ("scrub_last_run_timestamp_seconds", "gauge", "Unix timestamp of the last dual-authority scrub attempt.", "%.3f"),
    ("scrub_last_success_timestamp_seconds", "gauge", "Unix timestamp of the last successful dual-authority scrub.", "%.3f"), ("scrub_generation", "gauge", "Generation verified by the last successful dual-authority scrub.", "%d"),
    ("last_activity_timestamp_seconds", "gauge", "Unix timestamp of the last authorized Git request.", "%.3f"),
]


def families(values: DataFrame, prefix: str) -> DataFrame:
    """Exposition lines (place, repository, line) of values (repository and a column for each family but the requests), HELP and TYPE lines first.

    place orders a repository's lines as the families stand; null values count as 0."""
    spark = values.sparkSession
    heads = [(2 * k + j, "", f"# {what} {prefix}{name} {text}") for k, (name, kind, help_, _) in enumerate(FAMILIES) for j, (what, text) in enumerate((("HELP", help_), ("TYPE", kind)))]
    lines = []
    for k, (name, _, _, form) in enumerate(FAMILIES[1:]):
        value = F.coalesce(F.col(name).cast("double" if "f" in form else "long"), F.lit(0).cast("double" if "f" in form else "long"))
        lines.append(F.struct(F.lit(2 * len(FAMILIES) + k).alias("place"), F.format_string(prefix + name + '{repository="%s"} ' + form, F.col("repository"), value).alias("line")))
    body = values.select("repository", F.explode(F.array(*lines)).alias("l")).select("l.place", "repository", "l.line")
    return spark.createDataFrame(heads, "place int, repository string, line string").unionByName(body)


def joined_failures(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    """All messages of a key, sorted, joined by '; '."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(message)), "; ").alias("failures"))
