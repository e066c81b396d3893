"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

A benchmark item gives windows of `window` consecutive words (a shorter item is one window). A window's shingles are
ordered by how often they occur in all documents, and its rarest shingle is the prefix that any document holding the
window must share. Document positions join the prefixes by hash; the shingle's place in the window bounds where the
window can start, and the words there are compared one by one. Windows with a shingle that no document has are
dropped before the join.

Null texts have no words; empty items give no window; documents of any length are whole; repeated rows are documents
of their own; a null item id counts as empty text. Of other columns only the id is kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, SHINGLE = 13, 5
#: Rows of shingles or prefixes up to which a side is broadcast (a prefix takes some hundred bytes); larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case; null gives none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _key(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*(F.get(words, at + k) for k in range(length)))


def _positions(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """docs with a row for each place and shingle length: at, k, key. At the place n_words there is no key."""
    placed = docs.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words"))))
    keys = [F.when(F.col("at") + n <= F.size("words"), _key(F.col("words"), F.col("at"), n)) for n in lengths]
    if len(keys) == 1:
        return placed.withColumns({"k": F.lit(0), "key": keys[0]})
    return placed.select("*", F.posexplode(F.array(*keys)).alias("k", "key"))


def window_hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(hits, windows): hits has rid, id, n_words, start, len, wid, and for each document one row of len 0; windows has wid, items."""
    spark = docs.sparkSession
    bench = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1))))
    windows = bench.withColumn("first", first).select("item", F.slice("words", F.col("first"), window).alias("win"))
    windows = materialise(windows.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("wid", F.monotonically_increasing_id()), "windows")
    lengths = [r[0] for r in windows.select(F.least(F.size("win"), F.lit(SHINGLE)).alias("n")).distinct().sort("n").collect()] or [SHINGLE]
    parts = [windows.where(F.least(F.size("win"), F.lit(SHINGLE)) == n).withColumn("off", F.explode(F.sequence(F.lit(0), F.size("win") - n))).select("wid", "off", _key(F.col("win"), F.col("off"), n).alias("key")) for n in lengths]
    shingles = parts[0]
    for p in parts[1:]:
        shingles = shingles.unionByName(p)
    shingles = materialise(shingles, "shingles")

    plain = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    keys = shingles.select("key").distinct()
    positions = _positions(plain.select("words"), lengths).select("key")
    if shingles.count() <= BROADCAST_ROWS:
        counted = positions.join(F.broadcast(keys), "key").groupBy("key").agg(F.count("*").alias("n"))
    else:
        counted = positions.groupBy("key").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "off")).alias("p")
    prefix = shingles.join(counted, "key", "left").groupBy("wid").agg(rarest).where("p.n > 0").select("wid", "p.key", "p.off")
    prefix = materialise(prefix.join(windows.select("wid", "win"), "wid"), "prefixes")

    numbered = plain.withColumn("rid", F.monotonically_increasing_id())
    n, start = F.size("words"), F.col("at") - F.col("off")
    bounded = (start >= 0) & (start + F.size("win") <= n)
    exact = F.when(bounded, F.slice("words", start + 1, F.size("win")) == F.col("win"))
    found = [F.col("rid"), F.col("id"), n.alias("n_words"), F.coalesce(start, F.lit(0)).alias("start"), F.coalesce(F.size("win"), F.lit(0)).alias("len"), F.col("wid")]
    if prefix.count() <= BROADCAST_ROWS:
        # The place behind the last word stands for the document itself: one row of it stays, without a window.
        joined = _positions(numbered, lengths).join(F.broadcast(prefix), "key", "left")
        hits = joined.where(F.coalesce(exact, F.lit(False)) | ((F.col("at") == n) & (F.col("k") == 0) & F.col("wid").isNull())).select(found)
    else:
        # Places meet prefixes by a shuffle of keys alone; the words are joined to the few that do. Skewed keys are split as Spark splits skewed joins.
        numbered = materialise(numbered, "numbered")
        places = _positions(numbered, lengths).select("rid", "at", "key").join(prefix.select("key", "wid", "off"), "key").select("rid", "at", "wid", "off")
        near = places.join(numbered, "rid").join(prefix.select("wid", "win"), "wid").where(exact).select(found)
        hits = near.unionByName(numbered.select("rid", "id", n.alias("n_words"), F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("wid")))
    return materialise(hits, "hits"), windows.select("wid", "items")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, least_share: float = 0.05) -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, item_ids, contaminated."""
    hits, windows = window_hits(docs, items, id_col, text_col, item_col, item_text_col, window)
    before = Window.partitionBy("rid").orderBy("start", "len", "wid").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    per = hits.withColumn("fresh", fresh).groupBy("rid").agg(F.first("id").alias("id"), F.max("n_words").cast("long").alias("n_words"), F.sum("fresh").cast("long").alias("n_hit"))
    found = hits.where("len > 0").select("rid", "wid").distinct()
    side = windows if windows.count() > BROADCAST_ROWS else F.broadcast(windows)
    named = found.join(side, "wid").groupBy("rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    out = per.join(named, "rid", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    least = F.lit(round(1 / least_share))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), ((F.col("n_hit") > 0) & (least * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT DISTINCT rid, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
