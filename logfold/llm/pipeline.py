"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, then packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents
(the last one the packed pieces). A stage's rows are written to the shared folder and read again by the next.
Rows with a null text or id pass the filters: nothing in them can be toxic, copied or contaminated. Extra columns of
the input are dropped. An empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontaminate, neardup, packing, secrets, toxicity
from .common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The score from which a document is rejected as toxic.
TOXIC = 0.7


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier finds toxic. It learns from the training labels as op7 does."""
    docs = docs.select(COLUMNS)
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels"), 3, 1))
    return toxicity.score(docs, model, out_col="toxic_score").where(F.col("toxic_score") < TOXIC).select(COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of copies and near copies the text that stands for it, once, under its smallest id."""
    docs = docs.select(COLUMNS)
    groups = neardup.near_duplicates(docs).where("digest = class_digest and doc_id = class_id")
    stands = materialise(groups.groupBy("doc_id", "digest").agg(F.count("*").alias("times")), "stands")
    told = docs.withColumn("digest", F.upper(F.md5("text")))
    kept = told.where("doc_id is not null and text is not null").join(stands, ["doc_id", "digest"])
    first = Window.partitionBy("doc_id", "digest").orderBy("lang", "source", "n_chars")
    repeated = kept.where("times > 1").withColumn("turn", F.row_number().over(first)).where("turn = 1")
    rest = told.where("doc_id is null or text is null")
    return kept.where("times = 1").select(COLUMNS).unionByName(repeated.select(COLUMNS)).unionByName(rest.select(COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects every document that holds a window of the benchmark, however long the rest of it is."""
    docs = docs.select(*COLUMNS, F.concat_ws(":", "doc_id", F.md5("text")).alias("of"))
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), id_col="of")
    return docs.join(found.where("n_hit > 0").select("of").distinct(), "of", "left_anti").select(COLUMNS)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by its kind, and n_chars by the new length; no document goes."""
    clean = secrets.redact_secrets(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicate), ("decontamination", benchmark_passages), ("secrets", secret), ("packing", packed)]
#: SQL can't express the trained classifier, the compressor or the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
