import random
import re

from logfold.llm import pipeline as cp
from logfold.llm import secrets, toxicity
from tests.conftest import SF


def test_each_stage_against_its_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(cp.COLUMNS)
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, toxicity.training_labels(spark.read.parquet(f"{SF}/labels.parquet"), 3, 1))
    ids = sorted(rows)
    import pyarrow as pa

    z = model.logits(pa.array([rows[i] for i in ids]))
    keep = {i for i, s in zip(ids, z, strict=True) if 1 / (1 + 2.718281828459045 ** -s) < cp.TOXIC}
    one = cp.toxic(spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == keep and one.columns == cp.COLUMNS
    from tests.llm.test_decontaminate import brute as leaks
    from tests.llm.test_neardup import brute as groups

    groups_of = groups([(i, rows[i]) for i in keep])
    two = cp.near_duplicate(spark, one, SF)
    kept = {i for i, g in groups_of.items() if i == g}
    assert {r.doc_id for r in two.collect()} == kept and two.columns == cp.COLUMNS
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {x[0] for x in leaks([(i, rows[i]) for i in kept], bench) if not x[2]}
    three = cp.benchmark_passages(spark, two, SF)
    assert {r.doc_id for r in three.collect()} == clean and three.columns == cp.COLUMNS
    four = cp.secret(spark, three, SF)
    prior = secrets.dictionary(three)
    got = {r.doc_id: r for r in four.collect()}
    assert set(got) == clean and four.columns == cp.COLUMNS
    assert all(r.n_chars == len(r.text) and (r.text == rows[i]) == (not secrets.find(rows[i], prior)) for i, r in got.items())
    pieces = cp.packed(spark, four, SF).collect()
    assert {r.doc_id for r in pieces} == clean


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_a_short_leak_in_a_long_text_goes(spark):
    """13 words of the benchmark in a text of a thousand: far under a twentieth of it."""
    g = random.Random(4)
    item = next(t.text for t in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((t.text or "").split()) >= 13)
    words = [f"w{g.randrange(10**6)}" for _ in range(1000)]
    leak = words[:500] + re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", item.lower())[:13] + words[500:]
    kept = cp.benchmark_passages(spark, docs_of(spark, [(1, " ".join(words)), (2, " ".join(leak)), (3, None), (3, " ".join(leak))]), SF).collect()
    assert sorted((r.doc_id, r.text is None) for r in kept) == [(1, False), (3, True)]


def test_texts_under_one_id_stay_apart(spark):
    """Different texts with one id are different documents; of equal ones one stays."""
    g = random.Random(5)
    a, b, c = (" ".join(f"{x}{g.randrange(10**6)}" for _ in range(60)) for x in "abc")
    near = b.replace(b.split()[30], "changed")
    rows = [(1, a), (1, b), (2, near), (3, c), (3, c), (4, c)] + [(100 + i, f"other{i} text{i} of{i} its{i} own{i} words{i}") for i in range(80)]
    kept = sorted((r.doc_id, r.text) for r in cp.near_duplicate(spark, docs_of(spark, rows), SF).collect() if r.doc_id < 100)
    assert [x for x in kept if x[0] == 1] in ([(1, a), (1, b)], [(1, b), (1, a)]) and [x for x in kept if x[0] > 1] == [(3, c)]


def test_a_common_license_makes_no_copies_in_small_partitions(spark):
    """Own texts under a license that all share stay, also where each task has one of them."""
    line = " ".join(f"license{i}" for i in range(40))
    docs = docs_of(spark, [(k, f"{line} {' '.join(f'd{k}w{i}' for i in range(3))}") for k in range(60)])
    assert cp.near_duplicate(spark, docs.repartitionByRange(60, "doc_id"), SF).count() == 60


def test_empty_pipeline(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_survive(spark, make, odd):
    docs = make([*odd, (30, "x"), (30, "x")]).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars")
    kept = cp.near_duplicate(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2, 3, 4, 6, 7, 30]
    assert cp.benchmark_passages(spark, docs.limit(0), SF).count() == 0
    assert cp.secret(spark, docs, SF).count() == docs.count()
