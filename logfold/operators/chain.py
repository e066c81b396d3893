"""Hash-linked histories: walking, contiguity, validity, recovery across replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.functions.ident import is_zero
from logfold.operators.lineage import cut

KEYS = ["authority", "repo_id"]


def walk(certs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """certs with depth (1 at a root) and root, for those that a root reaches; others, in cycles or with a lost parent, have null.

    Pointers double: after k joins each link has jumped 2**k parents, so a chain of n links takes log2(n) joins."""
    links = certs.select(*keys, "digest", "previous").dropDuplicates([*keys, "digest"])
    known = links.select(*keys, F.col("digest").alias("up"), F.lit(True).alias("found"))
    joined = links.withColumn("up", F.col("previous")).join(known, [*keys, "up"], "left")
    start = F.when(F.col("previous").isNull(), "root").when(F.col("found").isNull(), "lost").otherwise("open")
    state = joined.select(*keys, "digest", start.alias("state"), F.col("previous").alias("to"), F.lit(1).alias("jump"))
    state = cut(state, "links")
    longest = certs.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    steps = max(1, int(longest).bit_length() + 1)
    for _ in range(steps):
        other = state.select(*keys, F.col("digest").alias("to"), F.col("state").alias("s2"), F.col("to").alias("t2"), F.col("jump").alias("j2"))
        joined = state.join(other, [*keys, "to"], "left")
        go = F.col("state") == "open"
        joined = joined.select(
            *keys, "digest", F.when(go, F.col("s2")).otherwise(F.col("state")).alias("state"), F.when(go, F.col("t2")).otherwise(F.col("to")).alias("to"), F.when(go, F.col("jump") + F.col("j2")).otherwise(F.col("jump")).alias("jump")
        )
        state = cut(joined, "links")
        if state.where("state = 'open'").isEmpty():
            break
    depth = F.when(F.col("state") == "root", F.col("jump"))
    return certs.join(state.select(*keys, "digest", depth.alias("depth"), F.col("state").alias("reach")), [*keys, "digest"])


def contiguity(certs: DataFrame, keys: list[str]) -> DataFrame:
    """One row a chain: links, gaps and repeats between a link's generation and its parent's."""
    parent = certs.select(*keys, F.col("digest").alias("previous"), F.col("generation").alias("_before"))
    step = F.col("generation") - F.col("_before")
    joined = certs.join(parent, [*keys, "previous"], "left")
    return joined.groupBy(*keys).agg(F.count("*").alias("n_links"), F.count_if(F.col("_before").isNull()).alias("n_roots"), F.count_if(step > 1).alias("n_gaps"), F.count_if(step < 1).alias("n_backward"))


def validity(certs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row a chain: valid if every link is reached from a root, no digest comes twice and there is one root."""
    walked = walk(certs, keys)
    n = F.count("*")
    unreached, roots = F.count_if(F.col("depth").isNull()), F.count_if(F.col("previous").isNull())
    out = walked.groupBy(*keys).agg(n.alias("n_links"), F.count_distinct("digest").alias("n_distinct"), unreached.alias("n_unlinked"), roots.alias("n_roots"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))
    return out.withColumn("valid", (F.col("n_unlinked") == 0) & (F.col("n_roots") == 1) & (F.col("n_links") == F.col("n_distinct")))


def newest(certs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The head of each chain; two digests at the largest generation are an ambiguous fork."""
    top = certs.groupBy(*keys, "generation").agg(F.count_distinct("digest").alias("n"), F.min("digest").alias("digest"))
    best = top.groupBy(*keys).agg(F.max("generation").alias("generation"), F.max_by(F.struct("n", "digest"), "generation").alias("t"))
    return best.select(*keys, "generation", F.when(F.col("t.n") == 1, F.col("t.digest")).alias("head"), (F.col("t.n") > 1).alias("fork"))


def refs_along(certs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """certs (digest, previous, generation, refs, updates) with the first check that a link fails against its parent: parent, generation, refs or ok.

    A link's refs must be its parent's with its updates applied, the last of a ref's updates winning and zeros deleting;
    an anchor, without parent, has its updates applied to nothing. Each link is compared with one other, so a chain's
    length costs no more than its links."""
    parent = certs.select(*keys, F.col("digest").alias("previous"), F.col("generation").alias("_before"), F.col("refs").alias("_refs"))
    joined = certs.join(parent, [*keys, "previous"], "left")
    moved = F.aggregate("updates", F.create_map().cast("map<string,string>"), lambda m, u: F.map_concat(F.map_filter(m, lambda k, _: k != u["ref"]), F.create_map(u["ref"], u["new"])))
    old = F.coalesce("_refs", F.create_map().cast("map<string,string>"))
    want = F.map_filter(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(F.col("_moved"), k)), F.col("_moved")), lambda _, v: ~is_zero(v))
    same = lambda a, b: F.array_sort(F.map_entries(a)).eqNullSafe(F.array_sort(F.map_entries(b)))
    status = (
        F.when(F.col("previous").isNotNull() & F.col("_before").isNull(), "parent").when(F.col("previous").isNotNull() & (F.col("generation") != F.col("_before") + 1), "generation")
        .when(~same(want, F.col("refs")), "refs").otherwise("ok")
    )
    return joined.withColumn("_moved", moved).withColumn("status", status).drop("_before", "_refs", "_moved")


def recovered(certs: DataFrame) -> DataFrame:
    """The newest link common to all valid replicas of each chain; invalid replicas are left out, and `survivor_only` says that one was left.

    Where several links of the newest generation are common (a fork that every valid replica holds), the largest digest is the head."""
    ok = validity(certs).where("valid").select(*KEYS)
    n = ok.groupBy("repo_id").agg(F.count("*").alias("n_valid"))
    common = certs.join(ok, KEYS, "left_semi").groupBy("repo_id", "digest", "generation").agg(F.count_distinct("authority").alias("n")).join(n, "repo_id").where(F.col("n") == F.col("n_valid"))
    return common.groupBy("repo_id").agg(F.max("generation").alias("generation"), F.max_by("digest", F.struct("generation", "digest")).alias("head"), F.max("n_valid").alias("n_valid"), (F.max("n_valid") == 1).alias("survivor_only"))


def linked(entries: DataFrame) -> DataFrame:
    """Certificates of entries (repo_id, generation, tx): each digest covers its parent's, generation and transaction; the first is an anchor.

    A digest needs the one before it, so a repository's entries stream in order through one task with one digest held."""
    import hashlib

    rows = entries.select("repo_id", "generation", "tx").repartition("repo_id").sortWithinPartitions("repo_id", "generation")
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")

    def run(frames):
        repo, digest = None, None
        for f in frames:
            made, before = [], []
            for r, g, tx in zip(f["repo_id"], f["generation"], f["tx"], strict=True):
                if r != repo:
                    repo, digest = r, None
                before.append(digest)
                digest = hashlib.sha256(f'{{"previous":"{digest or ""}","generation":{g},"transaction":"{tx}"}}'.encode()).hexdigest()
                made.append(digest)
            yield f.assign(digest=made, previous=before, anchor=[p is None for p in before])

    return rows.mapInPandas(run, f"{schema}, digest string, previous string, anchor boolean")
