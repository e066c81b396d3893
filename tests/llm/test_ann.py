import numpy as np

from logfold.llm import ann


def exact(ids, x, q, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u[np.flatnonzero(ids == q)[0]]
    s[ids == q] = -np.inf
    order = np.lexsort((ids, -s))[:k]
    return [(int(ids[i]), s[i]) for i in order if s[i] > -np.inf]


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, codes string")
    usable, d = ann.usable(df, "vec_id", "embedding")
    model, index = ann.build(usable, d)
    out = {}
    for r in ann.search(index, model, index.where("id % 50 = 0").select("id", "v"), k).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in out.items()}


def test_recall_and_exact_scores(spark):
    g = np.random.default_rng(2)
    x = g.standard_normal((4000, 32))
    ids = np.arange(4000)
    got = run(spark, list(zip(ids.tolist(), x.tolist(), strict=True)))
    hit = 0
    for q in range(0, 4000, 50):
        want = exact(ids, x, q)
        hit += len({i for i, _ in want} & {i for i, _ in got[q]})
        scores = dict(want)
        assert len(got[q]) == 5 and all(abs(s - scores[i]) < 1e-12 for i, s in got[q] if i in scores)
    assert hit / (5 * 80) >= 0.95


def test_ties_odd_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (9, [2.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (10, [0.0, 1.0])]
    assert [i for i, _ in run(spark, rows)[0]] == [3, 9, 10]


def test_empty(spark):
    assert ann.usable(spark.createDataFrame([], "vec_id long, embedding array<double>"), "vec_id", "embedding")[1] == 0


def test_many_copies_give_the_smallest_ids(spark):
    g = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1, 3000)] + [(50_000, [1.0, 2.0, 3.1])] + [(60_001 + i, g.standard_normal(3).tolist()) for i in range(300)]
    assert [i for i, _ in run(spark, rows)[50_000]] == [1, 2, 3, 4, 5]
