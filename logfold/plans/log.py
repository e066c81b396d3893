"""Queries over the change log: state, offsets, validation, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from logfold.functions import ident
from logfold.operators import admission, maintain, state
from logfold.sources import fixtures as fx
from logfold.sources.text import parse_updates

from .registry import query

U = "WITH " + fx.UPDATES_SQL
FOLDED = "SELECT repo_id, ref, arg_max(new_oid, generation) AS oid FROM updates {where} GROUP BY ALL HAVING trim(arg_max(new_oid, generation), '0') <> ''"
ZERO = "repeat('0', 40)"
G1, G2 = 500, 1500
NOW, CUTOFF = 1_706_659_200_000_000, 800_000_000_000_000


def refs(where: str = "") -> str:
    return FOLDED.format(where=where)


@query(f"{U} {refs()}")
def refs_current(spark, d):
    return state.fold(fx.updates(spark, d))


@query(f"{U} {refs(f'WHERE generation <= {G2}')}")
def refs_as_of(spark, d):
    u = fx.updates(spark, d)
    return state.as_of(state.fold(u.where(F.col("generation") <= G1)), G1, u, G2)


@query(f"""{U}, {fx.OFFSETS_SQL} SELECT u.repo_id, consumer, count(*) AS n_updates, min(generation) AS first_generation, max(generation) AS last_generation, sum(bytes) AS bytes
    FROM updates u JOIN offsets o ON u.repo_id = o.repo_id AND generation > "offset" GROUP BY ALL""")
def log_tail_after_offset(spark, d):
    t = state.tail(fx.updates(spark, d), fx.offsets(spark, d))
    return t.groupBy("repo_id", "consumer").agg(F.count("*").alias("n_updates"), F.min("generation").alias("first_generation"), F.max("generation").alias("last_generation"), F.sum("bytes").cast("decimal(38,0)").cast("long").alias("bytes"))


@query(f"""{U}, {fx.OFFSETS_SQL}, h AS (SELECT repo_id, max(generation) AS head FROM updates GROUP BY 1)
    SELECT repo_id, consumer, "offset", head, CASE WHEN "offset" > head THEN 'ahead' WHEN "offset" < 100 THEN 'below_floor' WHEN "offset" = head THEN 'current' ELSE 'tail' END AS status FROM offsets JOIN h USING (repo_id)""")
def offset_status(spark, d):
    heads = fx.updates(spark, d).groupBy("repo_id").agg(F.max("generation").alias("head"))
    return state.offset_status(fx.offsets(spark, d), heads, 100)


def rendered(u):
    """The log as text lines, some of them malformed on purpose."""
    e = F.col("event_id")
    old, new = F.when(e % 11 == 0, F.substring("old_oid", 1, 39)).otherwise(F.col("old_oid")), F.when(e % 13 == 0, F.lit("")).otherwise(F.col("new_oid"))
    ref = F.when(e % 17 == 0, F.lit("HEAD")).when(e % 19 == 0, F.lit("tags/x")).otherwise(F.col("ref"))
    return u.select("repo_id", F.concat_ws(" ", old, new, ref).alias("value"))


@query(f"""{U}, t AS (SELECT repo_id, length(CASE WHEN event_id % 11 = 0 THEN substr(old_oid, 1, 39) ELSE old_oid END) AS ol, CASE WHEN event_id % 13 = 0 THEN 0 ELSE length(new_oid) END AS nl,
        CASE WHEN event_id % 17 = 0 THEN 'HEAD' WHEN event_id % 19 = 0 THEN 'tags/x' ELSE ref END AS ref FROM updates),
    s AS (SELECT repo_id, CASE WHEN nl = 0 THEN 'fields' WHEN ol NOT IN (40, 64) OR ol <> nl THEN 'oid' WHEN ref = 'HEAD' THEN 'head' WHEN NOT starts_with(ref, 'refs/') THEN 'ref' ELSE 'ok' END AS status FROM t)
    SELECT repo_id, status, count(*) AS n FROM s GROUP BY ALL""")
def parse_ref_updates(spark, d):
    return parse_updates(rendered(fx.updates(spark, d)), "value").groupBy("repo_id", "status").agg(F.count("*").alias("n"))


@query(f"""{U}, m AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN repeat('f', 40) ELSE old_oid END AS claimed FROM updates)
    SELECT repo_id, count(*) AS n_updates, count(*) FILTER (claimed <> old_oid) AS n_broken, min(generation) FILTER (claimed <> old_oid) AS first_broken FROM m GROUP BY 1""")
def ref_chain_check(spark, d):
    u = fx.updates(spark, d)
    u = u.withColumn("old_oid", F.when(F.col("event_id") % 13 == 0, F.lit("f" * 40)).otherwise(F.col("old_oid")))
    b = admission.chain_breaks(u)
    return b.groupBy("repo_id").agg(F.count("*").alias("n_updates"), F.count_if("broken").alias("n_broken"), F.min(F.when(F.col("broken"), F.col("generation"))).alias("first_broken"))


TX = f"""{U}, refs AS ({refs()}),
    j AS (SELECT u.*, (generation - 1) // 3 AS tx, r.oid FROM updates u LEFT JOIN refs r USING (repo_id, ref)),
    t AS (SELECT repo_id, tx, count(*) AS n_updates, bool_and(CASE WHEN trim(new_oid, '0') = '' THEN oid IS NULL ELSE coalesce(oid = new_oid, false) END) AS applied,
        bool_and(coalesce(oid, {ZERO}) = old_oid) AS before, bool_and(coalesce(oid, {ZERO}) = new_oid) AS after FROM j GROUP BY ALL)"""


def grouped_state(spark, d):
    u = fx.updates(spark, d)
    return admission.transaction_state(u.withColumn("tx", F.floor((F.col("generation") - 1) / 3)), state.fold(u), ["repo_id", "tx"])


@query(f"{TX} SELECT repo_id, tx, n_updates, applied FROM t")
def tx_already_applied(spark, d):
    return grouped_state(spark, d).select("repo_id", "tx", "n_updates", "applied")


@query(f"{TX} SELECT repo_id, before, after, count(*) AS n_tx FROM t GROUP BY ALL")
def tx_state_before_after(spark, d):
    return grouped_state(spark, d).groupBy("repo_id", "before", "after").agg(F.count("*").alias("n_tx"))


@query(f"{TX} SELECT repo_id, before, after, tx % 2 = 0 AS certified, CASE WHEN tx % 2 <> 0 THEN 'keep' WHEN after THEN 'append_inverse' WHEN before THEN 'none' ELSE 'error' END AS action, count(*) AS n FROM t GROUP BY ALL")
def abort_plan(spark, d):
    t = grouped_state(spark, d).withColumn("certified", F.col("tx") % 2 == 0)
    return t.withColumn("action", admission.abort_action(F.col("before"), F.col("after"), F.col("certified"))).groupBy("repo_id", "before", "after", "certified", "action").agg(F.count("*").alias("n"))


@query(f"""WITH {fx.TRANSACTIONS_SQL} SELECT repo_id, tx, ref FROM tx a WHERE EXISTS (SELECT 1 FROM tx b WHERE a.repo_id = b.repo_id AND a.ref = b.ref AND a.tx <> b.tx)""")
def prepared_lock_conflicts(spark, d):
    """All transactions are prepared; each is asked for against the others."""
    t = fx.transactions(spark, d)
    return admission.lock_conflicts(t, t).select("repo_id", "tx", "ref")


@query(f"""WITH {fx.TRANSACTIONS_SQL}, p AS (SELECT *, CASE WHEN tx % 9 = 0 THEN 0 ELSE arrival END AS created FROM tx), n AS (SELECT 820454400000000 AS now)
    SELECT repo_id, tx FROM p, n WHERE created <> 0 AND now - created >= 300000000""")
def prepared_stale(spark, d):
    p = fx.transactions(spark, d).withColumn("created", F.when(F.col("tx") % 9 == 0, F.lit(0)).otherwise(F.col("arrival")))
    return admission.stale(p, 820_454_400_000_000).select("repo_id", "tx")


def json_updates(spark, d):
    u = fx.updates(spark, d)
    one = F.struct(F.col("old_oid").alias("old"), F.col("new_oid").alias("new"), F.concat(F.col("ref"), F.when(F.col("event_id") % 5 == 0, F.lit("&<x>")).otherwise(F.lit(""))).alias("ref"))
    return u.withColumn("tx", F.floor((F.col("generation") - 1) / 3)).groupBy("repo_id", "tx").agg(F.transform(F.array_sort(F.collect_list(F.struct("generation", one.alias("u")))), lambda x: x["u"]).alias("updates"))


JSON = f"""{U}, j AS (SELECT repo_id, (generation - 1) // 3 AS tx, generation, old_oid, new_oid, ref || CASE WHEN event_id % 5 = 0 THEN '\\u0026\\u003cx\\u003e' ELSE '' END AS r FROM updates),
    t AS (SELECT repo_id, tx, '[' || string_agg('{{"old":"' || old_oid || '","new":"' || new_oid || '","ref":"' || r || '"}}', ',' ORDER BY generation) || ']' AS fwd,
        '[' || string_agg('{{"old":"' || new_oid || '","new":"' || old_oid || '","ref":"' || r || '"}}', ',' ORDER BY generation) || ']' AS inv FROM j GROUP BY ALL)"""


@query(f"{JSON} SELECT repo_id, tx, sha256(inv) AS inverse_id FROM t")
def inverse_updates(spark, d):
    return json_updates(spark, d).select("repo_id", "tx", ident.transaction_id(ident.inverted(F.col("updates"))).alias("inverse_id"))


@query(f"""{JSON}, g AS (SELECT *, CASE tx % 3 WHEN 0 THEN sha256(fwd) WHEN 1 THEN 'rollback-' || sha256(inv) ELSE sha256('other') END AS given FROM t)
    SELECT repo_id, tx, given, given = sha256(fwd) OR given = 'rollback-' || sha256(inv) AS matches FROM g""")
def tx_identity(spark, d):
    t = json_updates(spark, d)
    u, turn = F.col("updates"), F.col("tx") % 3
    given = F.when(turn == 0, ident.transaction_id(u)).when(turn == 1, F.concat(F.lit("rollback-"), ident.transaction_id(ident.inverted(u)))).otherwise(ident.sha(F.lit("other")))
    return t.withColumn("given", given).select("repo_id", "tx", "given", ident.identity_matches(F.col("given"), u).alias("matches"))


TWO = f"{U}, a AS ({refs(f'WHERE generation <= {G1}')}), b AS ({refs(f'WHERE generation <= {G2}')})"


def two_states(spark, d):
    u = fx.updates(spark, d)
    return state.fold(u.where(F.col("generation") <= G1)), state.fold(u.where(F.col("generation") <= G2)), u


@query(f"""{TWO} SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.ref, b.ref) AS ref, CASE WHEN a.oid IS NULL THEN 'create' WHEN b.oid IS NULL THEN 'delete' ELSE 'update' END AS change,
    coalesce(a.oid, {ZERO}) AS old_oid, coalesce(b.oid, {ZERO}) AS new_oid FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.ref = b.ref WHERE a.oid IS DISTINCT FROM b.oid""")
def refs_diff(spark, d):
    a, b, _ = two_states(spark, d)
    return state.diff(a, b)


@query(f"""{TWO} SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, count(*) AS n_refs, count(*) FILTER (a.oid IS DISTINCT FROM b.oid) AS n_wrong, count(*) FILTER (a.oid IS DISTINCT FROM b.oid) = 0 AS equal
    FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.ref = b.ref GROUP BY 1""")
def refs_verify(spark, d):
    a, b, _ = two_states(spark, d)
    return state.verify(a, b)


@query(f"""{TWO}, c AS (SELECT u.repo_id, CASE WHEN CASE WHEN trim(new_oid, '0') = '' THEN oid IS NULL ELSE coalesce(oid = new_oid, false) END THEN 'skip' WHEN coalesce(oid, {ZERO}) = old_oid THEN 'pending' ELSE 'conflict' END AS outcome
    FROM updates u LEFT JOIN a USING (repo_id, ref)) SELECT repo_id, outcome, count(*) AS n FROM c GROUP BY ALL""")
def apply_classify(spark, d):
    a, _, u = two_states(spark, d)
    return state.classify(u, a).groupBy("repo_id", "outcome").agg(F.count("*").alias("n"))


@query(f"{U} SELECT repo_id, ref, oid, CAST({G1} AS BIGINT) AS generation FROM ({refs(f'WHERE generation <= {G1}')})")
def checkpoint_at(spark, d):
    return maintain.checkpoint(fx.updates(spark, d), G1)


ENTRIES = f"{U}, cp AS (SELECT repo_id, max(generation) AS cut FROM updates WHERE generation IN (200, 350, {G1}) AND event_id % 2 = 0 GROUP BY 1)"


def entries(u):
    return u.select("repo_id", "generation", F.col("event_id").alias("tx"), "bytes", F.when(F.col("event_id") % 3 == 0, F.col("bytes") * 2).alias("payload_bytes"), ident.entry_file(F.col("generation"), F.col("new_oid")).alias("file"))


@query(f"""{ENTRIES} SELECT u.repo_id, count(*) AS n_entries, sum(bytes + CASE WHEN event_id % 3 = 0 THEN bytes * 2 ELSE 0 END) AS log_bytes
    FROM updates u LEFT JOIN cp USING (repo_id) WHERE generation > coalesce(cut, 0) GROUP BY 1""")
def compaction_retained(spark, d):
    u = fx.updates(spark, d)
    points = u.where(F.col("generation").isin(200, 350, G1) & (F.col("event_id") % 2 == 0)).withColumn("file", F.lit("c"))
    return maintain.log_size(maintain.retained(entries(u), maintain.newest_checkpoint(points)))


SIZES = f"{U}, s AS (SELECT repo_id, count(*) AS n_entries, sum(bytes + CASE WHEN event_id % 3 = 0 THEN bytes * 2 ELSE 0 END) AS log_bytes, max(at_us) AS last_activity FROM updates GROUP BY 1)"


@query(f"{SIZES} SELECT repo_id, n_entries, log_bytes, n_entries >= 2000 OR log_bytes >= 30000000 AS due FROM s")
def compaction_due(spark, d):
    s = maintain.log_size(entries(fx.updates(spark, d)))
    return s.withColumn("due", maintain.due(F.col("n_entries"), F.col("log_bytes"), 2000, 30_000_000))


@query(f"""{SIZES} SELECT repo_id, n_entries, log_bytes, repo_id <> 'error' AND (n_entries >= 2000) AS compact, repo_id <> 'error' AS collect, repo_id <> 'error' AND ({NOW} - last_activity >= 86400000000) AS evict FROM s""")
def maintenance_plan(spark, d):
    u = fx.updates(spark, d)
    activity = u.groupBy("repo_id").agg(F.max("at_us").alias("last_activity"))
    return maintain.maintenance(maintain.log_size(entries(u)), activity, F.col("repo_id") != "error", NOW, 2000, 0, 86_400_000_000)


PLAN = f"WITH {fx.LISTING_SQL}, plan AS (SELECT * FROM listing WHERE modified < {CUTOFF} AND NOT (o_orderkey % 3 = 0) AND NOT (kind = 'pending' AND o_orderkey % 4 = 1))"


def garbage(spark, d):
    files = fx.listing(spark, d)
    return maintain.garbage(files, files.where("o_orderkey % 3 = 0"), files.where("kind = 'pending' and o_orderkey % 4 = 1"), CUTOFF)


@query(f"{PLAN} SELECT repo_id, path, kind, bytes FROM plan")
def gc_plan(spark, d):
    return garbage(spark, d).select("repo_id", "path", "kind", "bytes")


@query(f"{PLAN} SELECT repo_id, count(*) FILTER (kind = 'entry') AS n_entry, count(*) FILTER (kind = 'checkpoint') AS n_checkpoint, count(*) FILTER (kind = 'pending') AS n_pending, sum(bytes) AS bytes FROM plan GROUP BY 1")
def gc_counts(spark, d):
    return maintain.garbage_counts(garbage(spark, d))


@query(f"""WITH {fx.TRANSACTIONS_SQL}, e AS (SELECT repo_id, ref, tx, arrival, row_number() OVER (PARTITION BY repo_id ORDER BY arrival, tx) AS generation FROM tx),
    l AS (SELECT repo_id, ref, max(generation) AS g, arg_max(tx, generation) AS last_tx FROM e GROUP BY ALL), h AS (SELECT repo_id, max(generation) AS head FROM e GROUP BY 1),
    w AS (SELECT DISTINCT repo_id, o_custkey AS ref FROM orders, (VALUES ('F'), ('O'), ('P')) t(repo_id))
    SELECT w.repo_id, w.ref AS tx, coalesce(g, head) AS generation, coalesce(CAST(last_tx AS VARCHAR), '') AS file FROM w LEFT JOIN l USING (repo_id, ref) JOIN h USING (repo_id)""")
def latest_entry_lookup(spark, d):
    """Every customer's newest order is asked for in each of the three repositories."""
    t = fx.transactions(spark, d)
    e = state.numbered(t, ["repo_id"], ["arrival", "tx"], F.floor(F.col("arrival") / (30 * 86_400_000_000)), "generation").select("repo_id", F.col("ref").alias("tx"), F.col("tx").cast("string").alias("file"), "generation")
    heads = e.groupBy("repo_id").agg(F.max("generation").alias("head"))
    wanted = t.select(F.col("ref").alias("tx")).distinct().select(F.explode(F.array(*map(F.lit, "FOP"))).alias("repo_id"), "tx")
    return admission.latest_entry(e, wanted, heads)


@query("""WITH s AS (SELECT ['prepared', 'aborted', 'committed', 'other'][1 + o_orderkey % 4] AS state FROM orders)
    SELECT state, CASE state WHEN 'prepared' THEN 'commit' WHEN 'aborted' THEN 'abort' WHEN 'committed' THEN 'finalize' ELSE 'error' END AS step, count(*) AS n FROM s GROUP BY ALL""")
def reference_steps(spark, d):
    names = F.array(*map(F.lit, ("prepared", "aborted", "committed", "other")))
    s = fx.table(spark, d, "orders").select(F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("state"))
    return s.groupBy("state", admission.reference_step(F.col("state")).alias("step")).agg(F.count("*").alias("n"))
