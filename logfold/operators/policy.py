"""Retention, authorization and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.functions.ident import mode_satisfies, retention_days, sha


def retention_issue(want_days: int, want_mode: str) -> Column:
    """The first failing check of a replica's retention settings, or empty: a cascade over versioning, lock, rule, mode, days."""
    days = retention_days(F.col("days"), F.col("years"))
    return (
        F.when(F.col("versioning") != "Enabled", "versioning").when(F.col("object_lock") != "Enabled", "object-lock").when(days.isNull(), "rule")
        .when(~F.col("mode").isin("COMPLIANCE", "GOVERNANCE"), "mode").when(~mode_satisfies(F.col("mode"), F.lit(want_mode)), "mode").when(days < want_days, "days").otherwise("")
    )


def retention_report(settings: DataFrame, keys: list[str], want_days: int, want_mode: str) -> DataFrame:
    """One row a replica: issue and days; `compliant` holds for a key if all its replicas are without issue."""
    each = settings.withColumn("issue", retention_issue(want_days, want_mode)).withColumn("rule_days", retention_days(F.col("days"), F.col("years")))
    whole = each.groupBy(*keys).agg(F.every(F.col("issue") == "").alias("compliant"))
    return each.join(whole, keys)


def authorized(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """requests (repo_id, token, write) with `allowed`: a grant of the repository with the token's digest and the right kind. Write doesn't imply read."""
    g = grants.select("repo_id", F.col("sha256").alias("_digest"), "can_read", "can_write")
    held = g.groupBy("repo_id", "_digest").agg(F.some("can_read").alias("_r"), F.some("can_write").alias("_w"))
    joined = requests.withColumn("_digest", sha(F.col("token"))).join(held, ["repo_id", "_digest"], "left")
    return joined.withColumn("allowed", F.coalesce(F.when(F.col("write"), F.col("_w")).otherwise(F.col("_r")), F.lit(False))).drop("_digest", "_r", "_w")


def route(path: Column, query: Column, method: Column) -> Column:
    """(repo, service, write) of a request; service is empty where the path or the method is not served."""
    repo = F.regexp_extract(path, r"^/([^/]+)\.git/", 1)
    rest = F.regexp_extract(path, r"^/[^/]+\.git/(.*)$", 1)
    named = F.regexp_extract(query, r"(?:^|&)service=(git-upload-pack|git-receive-pack)(?:&|$)", 1)
    service = F.when(repo == "", "").when((rest == "info/refs") & (method == "GET"), named).when(rest.isin("git-upload-pack", "git-receive-pack") & (method == "POST"), rest).otherwise("")
    return F.struct(repo.alias("repo"), service.alias("service"), (service == "git-receive-pack").alias("write"))
