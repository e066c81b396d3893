"""Bounded training samples of labelled rows, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: More labels than this are refused: their sizes come to the driver.
MOST_LABELS = 1000
#: Bounds of the whole sample: rows, and bytes of text of one label.
MOST_ROWS, MOST_BYTES = 20_000, 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(label, text) of at most `most` rows of each label, first in hash order; labels must hold (id, label).

    With over MOST_ROWS / most labels each has MOST_ROWS / labels rows. A label's rows end before its texts pass
    most_bytes together, but for a first row that does alone. Null ids and labels are left out, a document with several
    labels has the largest, and of several texts with one id the smallest is taken. A frequent label is cut by its hash to
    little over the bound before its rows are ranked, so they never meet in one task."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    sizes = known.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"{label_col} has over {MOST_LABELS} different values")
    most = min(most, max(1, MOST_ROWS // max(1, len(sizes))))
    part = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(1.0)
    for label, n in sizes:
        share = F.when(F.col("label") == F.lit(label), (1.2 * most + 500) / n).otherwise(share)
    near = known.where(part < share).withColumn("part", part)
    first = Window.partitionBy("label").orderBy("part", "id")
    few = near.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= most).select("id", "label", "part")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    texts = rows.join(F.broadcast(few), "id").groupBy("id").agg(F.first("label").alias("label"), F.first("part").alias("part"), F.min("text").alias("text"))
    size = F.sum(F.octet_length("text")).over(first.rowsBetween(Window.unboundedPreceding, 0))
    return texts.withColumn("size", size).withColumn("turn", F.row_number().over(first)).where((F.col("size") <= most_bytes) | (F.col("turn") == 1)).select("label", "text")
