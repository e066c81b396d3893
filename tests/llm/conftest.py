import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Columns with names that operators use inside themselves.
EXTRA = ["rid", "id", "words", "key", "n", "label", "score", "lang_pred", "findings", "class_id", "digest", "sequence_id", "offset", "v"]


@pytest.fixture(scope="session")
def make(spark):
    """docs(rows) with (doc_id, text) and extra columns whose names clash with internal ones."""
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *(StructField(c, StringType()) for c in EXTRA)])
    return lambda rows: spark.createDataFrame([(i, t, *(["x"] * len(EXTRA))) for i, t in rows], schema)


@pytest.fixture(scope="session")
def odd():
    """Null, empty and very long texts (over a megabyte, the size of a segment), repeated rows, ties and null ids."""
    return [(1, None), (2, ""), (3, "plain words here " * 70_000), (4, "same text of some words here"), (5, "same text of some words here"), (6, "a"), (6, "a"), (None, "no id but words"), (7, "\0\x1c é 日本 ñ" * 30)]
