"""Whitespace text: ref updates and ref listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_updates(lines: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """lines with old_oid, new_oid, ref and status: ok, head (dropped by readers that allow it), fields, oid or ref.

    A line has three fields; ids have 40 or 64 characters, both the same number. strict raises on a malformed line."""
    part = F.split(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""), r"\s+")
    out = lines.withColumn("_part", part)
    old, new, ref = (F.get("_part", F.lit(i)) for i in range(3))
    status = (
        F.when(F.size("_part") != 3, "fields").when(~F.length(old).isin(40, 64) | (F.length(old) != F.length(new)), "oid")
        .when(ref == "HEAD", "head").when(~ref.startswith("refs/"), "ref").otherwise("ok")
    )
    out = out.withColumns({"status": status, "old_oid": old, "new_oid": new, "ref": ref}).drop("_part")
    if strict:
        bad = F.raise_error(F.concat(F.lit("malformed update: "), F.col(column)))
        out = out.withColumn("status", F.when(F.col("status").isin("fields", "oid", "ref"), bad.cast("string")).otherwise(F.col("status")))
    return out


def parse_refs(lines: DataFrame, column: str) -> DataFrame:
    """lines of `name oid` as ref and oid; ok is false unless there are two fields."""
    part = F.split(F.trim(F.col(column)), r"\s+")
    return lines.withColumns({"ref": F.get(part, F.lit(0)), "oid": F.get(part, F.lit(1)), "ok": F.size(part) == 2})
