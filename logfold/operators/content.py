"""Content-addressed chunks: cutting, dedup, reassembly, replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.functions.ident import sha

INLINE_BELOW = 1 << 20
CHUNK = 8192


def chunked(objects: DataFrame, payload: str = "data", size: int = CHUNK) -> DataFrame:
    """objects with a row for each chunk: ordinal, data, digest, bytes. An empty payload has none.

    Works on text by characters and on binary by bytes; explode and hash need no shuffle."""
    n = F.ceil(F.length(payload) / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cut = objects.withColumn("ordinal", F.explode(starts))
    cut = cut.withColumn(payload, F.substring(F.col(payload), F.col("ordinal") * size + 1, F.lit(size)))
    return cut.withColumn("digest", sha(F.col(payload))).withColumn("bytes", F.octet_length(payload).cast("long"))


def store(chunks: DataFrame) -> DataFrame:
    """Each distinct chunk once: digest, bytes, n_refs, and whether its length is the same everywhere."""
    return chunks.groupBy("digest").agg(F.max("bytes").alias("bytes"), F.count("*").alias("n_refs"), (F.min("bytes") == F.max("bytes")).alias("consistent"))


def missing(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks that a store lacks: what an idempotent put writes."""
    return chunks.dropDuplicates(["digest"]).join(existing.select("digest"), "digest", "left_anti")


def reassembled(chunks: DataFrame, keys: list[str], objects: DataFrame | None = None) -> DataFrame:
    """Digest and length of each object's chunks in order, of text or binary data.

    objects, if given, has all keys: one without chunks is empty, and has the digest of nothing. An object's chunks meet
    in one row, so it must fit into one value (2 GB)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "data"))), lambda p: p["data"])
    binary = dict(chunks.dtypes)["data"] == "binary"
    # Binary values are joined as hexadecimal text, which keeps every byte.
    whole = F.unhex(F.array_join(F.transform(parts, F.hex), "")) if binary else F.array_join(parts, "")
    made = chunks.groupBy(*keys).agg(sha(whole).alias("digest"), F.sum("bytes").alias("bytes"), F.count("*").alias("n_chunks"))
    if objects is None:
        return made
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return objects.select(*keys).join(made, keys, "left").select(*keys, F.coalesce("digest", sha(F.lit(""))).alias("digest"), zero("bytes"), zero("n_chunks"))


def placement(total: Column) -> Column:
    """Payloads under a mebibyte stay inline."""
    return F.when(total < INLINE_BELOW, "inline").otherwise("external")


def verified(data: Column, digest: Column, size: Column) -> Column:
    return (sha(data) == digest) & (F.octet_length(data) == size)


def read_fallback(wanted: DataFrame, copies: DataFrame, order: tuple = ("primary", "secondary")) -> DataFrame:
    """wanted (digest, bytes) with the first replica, in order, whose copy verifies; null if none does."""
    ok = verified(F.col("data"), F.col("digest"), F.col("_bytes"))
    good = copies.join(wanted.select("digest", F.col("bytes").alias("_bytes")), "digest").where(ok)
    place = F.array_position(F.array(*map(F.lit, order)), F.col("authority"))
    first = good.where(place > 0).groupBy("digest").agg(F.min_by("authority", place).alias("served_by"))
    return wanted.join(first, "digest", "left")


def acknowledged(copies: DataFrame, n_authorities: int) -> DataFrame:
    """One row a digest: how many replicas hold a copy that verifies, and whether all do."""
    n = F.count_distinct(F.when(verified(F.col("data"), F.col("digest"), F.col("bytes")), F.col("authority")))
    return copies.groupBy("digest").agg(n.alias("n_acks"), (n == n_authorities).alias("complete"))


def resolved(stubs: DataFrame, descriptors: DataFrame) -> DataFrame:
    """stubs (id, digest) with the descriptor they point to, one level deep: status ok, missing or nested."""
    d = descriptors.select(F.col("digest"), "payload_bytes", F.col("points_to"))
    status = F.when(F.col("payload_bytes").isNull(), "missing").when(F.col("points_to").isNotNull(), "nested").otherwise("ok")
    return stubs.join(d, "digest", "left").withColumn("status", status)
