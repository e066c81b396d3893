"""Scalar expressions over identifiers, paths and digests: Column in, Column out, all inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = "0" * 40
CHUNK_LIMIT = 64 << 20


def is_zero(oid: Column) -> Column:
    """All characters are 0; the empty string is zero too."""
    return F.regexp_replace(oid, "^0+$", "") == ""


def absent_as_zero(oid: Column, like: Column) -> Column:
    """A missing ref is zeros, as many as the expected id has characters."""
    return F.coalesce(oid, F.repeat(F.lit("0"), F.length(like)))


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def is_digest(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def valid_chunk(digest: Column, size: Column) -> Column:
    return is_digest(digest) & size.between(0, CHUNK_LIMIT)


def json_text(text: Column) -> Column:
    """A JSON string as the log writes it: the signs < > &, the two line separators and control characters are escaped."""
    pairs = [("\\", "\\\\"), ('"', '\\"'), ("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")]
    control = [(chr(c), {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(c, f"\\u{c:04x}")) for c in range(32)]
    replaced = lambda x, by: reduce(lambda y, p: F.replace(y, F.lit(p[0]), F.lit(p[1])), by, x)
    escaped = replaced(text, pairs)
    # Control characters are rare; only texts that have one go through their replacements.
    escaped = F.when(text.rlike("[\\x00-\\x1f]"), replaced(escaped, control)).otherwise(escaped)
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def error_class(code: Column, status: Column) -> Column:
    """What a store's error means, by its code or else its HTTP status: precondition, conflict, not_found or other."""
    by = lambda names, http: F.coalesce(code.isin(*names), F.lit(False)) | F.coalesce(status == http, F.lit(False))
    return F.when(by(["PreconditionFailed"], 412), "precondition").when(by(["ConditionalRequestConflict"], 409), "conflict").when(by(["NoSuchKey", "NotFound"], 404), "not_found").otherwise("other")


def update_json(old: Column, new: Column, ref: Column) -> Column:
    return F.concat(F.lit('{"old":'), json_text(old), F.lit(',"new":'), json_text(new), F.lit(',"ref":'), json_text(ref), F.lit("}"))


def transaction_id(updates: Column) -> Column:
    """Digest of the ordered updates' JSON; updates is an array of (old, new, ref)."""
    rows = F.array_join(F.transform(updates, lambda u: update_json(u["old"], u["new"], u["ref"])), ",")
    return sha(F.concat(F.lit("["), rows, F.lit("]")))


def inverted(updates: Column) -> Column:
    """Old and new change places; the order stays."""
    return F.transform(updates, lambda u: F.struct(u["new"].alias("old"), u["old"].alias("new"), u["ref"].alias("ref")))


def identity_matches(given: Column, updates: Column) -> Column:
    """The id is the updates' digest, or a rollback of their inverse."""
    return (given == transaction_id(updates)) | (given == F.concat(F.lit("rollback-"), transaction_id(inverted(updates))))


def valid_id(text: Column) -> Column:
    return ~text.isin("", ".", "..") & ~text.rlike(r"[/\\]")


def depth_after(path: Column) -> Column:
    """(depth, least) after walking the segments: .. goes up, . and empty ones stay."""
    step = lambda s: F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    walk = lambda a, s: F.struct((a["depth"] + step(s)).alias("depth"), F.least(a["least"], a["depth"] + step(s)).alias("least"))
    return F.aggregate(F.split(path, "/"), start, walk)


def safe_object_path(path: Column) -> Column:
    """Under objects/, relative, never above it, and more than the folder itself."""
    below = F.substring(path, len("objects/") + 1, 1 << 20)
    walked = depth_after(below)
    return path.startswith("objects/") & ~below.startswith("/") & (walked["least"] >= 0) & (walked["depth"] > 0)


def transient(path: Column, own: tuple[str, ...] = ()) -> Column:
    """Lock, keep and temporary files of an object folder (fixed values); own are further prefixes, those of the log that wrote it."""
    name = F.element_at(F.split(path, "/"), -1)
    found = name.rlike(r"(\.keep|\.lock|\.tmp)$|^tmp_obj_")
    for prefix in own:
        found = found | F.startswith(name, F.lit(prefix))
    return found


def certificate_name(generation: Column, digest: Column) -> Column:
    return F.format_string("%020d-%s.cert", generation, digest)


def parsed_certificate_name(name: Column) -> Column:
    """(generation, digest, ok) of a certificate's file name."""
    ok = name.rlike(r"^[0-9]{20}-[0-9a-f]{64}\.cert$")
    generation = F.when(ok, F.substring(name, 1, 20).try_cast("bigint"))
    return F.struct(generation.alias("generation"), F.when(ok, F.substring(name, 22, 64)).alias("digest"), (ok & generation.isNotNull()).alias("ok"))


def blob_key(digest: Column) -> Column:
    return F.concat_ws("/", F.lit("blobs/sha256"), F.substring(digest, 1, 2), digest)


def entry_file(generation: Column, tx: Column) -> Column:
    return F.format_string("%020d-%s.wal", generation, F.substring(tx, 1, 16))


def normal_location(text: Column) -> Column:
    """file:// is a path, and trailing slashes don't count."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), "^file://(localhost)?", ""), "(?<=.)/+$", "")


def storage_class(bucket: Column) -> Column:
    return F.when(bucket.endswith("--x-s3"), "express").otherwise("standard")


def benchmark_segment(text: Column) -> Column:
    """A generated prefix: marker, UTC time, 32 hexadecimal digits."""
    stamp = F.regexp_extract(text, r"^[a-z0-9-]*?([0-9]{8}T[0-9]{6}Z)-[0-9a-f]{32}$", 1)
    return (stamp != "") & F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss'Z'")).isNotNull()


def retention_days(days: Column, years: Column) -> Column:
    """Days of a default rule: exactly one of days and years, positive; a year is 365 days. Else null."""
    d, y = F.coalesce(days, F.lit(0)), F.coalesce(years, F.lit(0))
    return F.when((d > 0) & (y == 0), d).when((y > 0) & (d == 0), y * 365)


def minimum_days(hours: Column) -> Column:
    return F.ceil(hours / 24)


def mode_satisfies(have: Column, want: Column) -> Column:
    return (have == want) | ((have == "COMPLIANCE") & (want == "GOVERNANCE"))


def request_token(header: Column) -> Column:
    """The bearer token, else the password of basic credentials, else empty."""
    basic = F.unbase64(F.when(header.rlike(r"^Basic [A-Za-z0-9+/]+={0,2}$"), F.substring(header, 7, 1 << 20))).cast("string")
    return F.when(header.startswith("Bearer "), F.substring(header, 8, 1 << 20)).when(basic.contains(":"), F.regexp_replace(basic, "(?s)^[^:]*:", "")).otherwise("")


def milliseconds(micros: Column) -> Column:
    return micros.cast("double") / 1000
