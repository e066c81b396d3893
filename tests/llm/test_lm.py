import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logfold.llm import lm
from tests.conftest import SF

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), None]


@pytest.mark.parametrize("head", [lm.HEAD, 5])
def test_base_equals_brute_force(make, odd, head):
    rows = [*odd, (20, "the Cat sat on the mat"), (21, "the dog\x0bsat\x1con"), (22, "unseen words only zzz the")]
    held = F.coalesce(F.col("doc_id") == 22, F.lit(False))
    docs = make(rows)
    model, counts = lm.fit(docs.where(~held), head=head)
    got = lm.score(docs, model, counts, held).collect()
    c = Counter(t for i, x in rows if i != 22 for t in tokens(x))
    total, distinct = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, i == 22, len(w := tokens(x)), sum(c[t] > 0 for t in w), total, round(sum(math.log10((c[t] + 1) / (total + distinct + 1)) for t in w), 4)) for i, x in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)


def tiny(n=400, seed=1):
    """A model of n made-up tokens with random weights."""
    g = np.random.default_rng(seed)
    h, counts = np.arange(1, n, dtype=np.uint64), np.arange(n, 1, -1)
    classes = g.integers(1, 40, n - 1)
    masses, distinct = np.bincount(classes, counts, lm.CLASSES), np.bincount(classes, minlength=lm.CLASSES)
    model = lm.Model(h, classes, counts, masses + (np.arange(lm.CLASSES) > 0) * 3, distinct + (np.arange(lm.CLASSES) > 0) * 2)
    model.weights = [g.standard_normal(x.shape).astype(np.float32) / 2 for x in model.weights]
    return model


def test_probabilities_add_up_to_one():
    model = tiny()
    events = np.arange(lm.CLASSES * lm.WIDTH)
    history = [np.full(len(events), x, np.uint64) for x in (5, 6, 7)]
    assert abs((10 ** model.log10(events, history)).sum() - 1) < 1e-3


def test_score_equals_the_definition():
    """Token by token, from the formulas: three softmax factors over sums of hashed rows."""
    model = tiny()
    g = np.random.default_rng(2)
    stream = g.integers(1, 400, 50).astype(np.uint64)
    cls = np.array([{int(t): int(e) // lm.WIDTH for t, e in zip(model.head, model.event, strict=True)}[int(t)] for t in stream])
    event = model.look_up(stream, cls)[0]
    got = model.log10(event, model.history(stream, np.array([0, 20, 50])))
    m64, mix = (1 << 64) - 1, int(lm._MIX)
    for i in range(50):
        start = 0 if i < 20 else 20
        back = [int(stream[i - k]) if i - k >= start else int(lm.PAD) for k in (1, 2)]
        features = [(((x ^ salt) * mix) & m64) ^ (x >> 33) for x, salt in ((back[0], 1), (back[1], 2), (((back[0] * 3) & m64) ^ back[1], 3))]
        c, want = int(event[i]) // lm.WIDTH, 0.0
        for k, (given, out) in enumerate(((0, c // lm.WIDTH), (c // lm.WIDTH, c % lm.WIDTH), (c, int(event[i]) % lm.WIDTH))):
            salt = ((given + 1 + lm.CLASSES * k) * 0x9E3779B97F4A7C15) & m64
            z = [float(x) for x in model.bias[k][given]]
            for j, f in enumerate(features):
                row = ((((f ^ salt) * mix) & m64) >> 24) % model.rows[k]
                z = [a + float(b) for a, b in zip(z, model.weights[k * lm.FEATURES + j][row], strict=True)]
            want += z[out] - math.log(sum(map(math.exp, z)))
        assert abs(got[i] - want / math.log(10)) < 1e-3


def test_row_sums():
    g = np.random.default_rng(3)
    x, row = g.random((500, 7)), np.minimum(g.zipf(1.3, 500), 60) + 65_500
    r, total, n = lm._row_sums(x, row)
    for k, t, c in zip(r, total, n, strict=True):
        assert c == (row == k).sum() and np.allclose(t, x[row == k].sum(0))
    assert len(r) == len(set(row.tolist()))


def test_context_is_learned():
    h, classes = np.array([11, 12, 13, 14], np.uint64), np.array([1, 2, 40, 41])
    n = np.bincount(classes, minlength=lm.CLASSES)
    model = lm.Model(h, classes, np.array([100, 100, 100, 100]), n * 100, n)
    stream, cls = np.tile(h, 100), np.tile(classes, 100)
    event = model.look_up(stream, cls)[0]
    features = model.history(stream, np.array([0, 400]))
    before = model.log10(event, features).sum()
    trainer = lm.Trainer(model)
    for _ in range(5):
        trainer.step(event, features)
    assert trainer.m.log10(event, features).sum() > before / 2 and not any(w.any() for w in model.weights)


def test_parts_are_averaged_over_those_that_touched(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 3)
    rows = []
    for part in range(10):
        row = lm._piece(part, 5, np.full((2, lm.WIDTH), part, np.float32), np.array([1, part % 2])).to_pylist()[0]
        rows.append(tuple(bytearray(x) if isinstance(x, bytes) else x for x in row.values()))
    got = lm._averaged(spark.createDataFrame(rows, lm.SUMS), 10)
    assert len(got) == 1 and got[0][0] == 5
    mean = lm._whole(got[0][1], got[0][2])
    assert abs(mean[0, 0] - 4.5) < 0.02 and abs(mean[1, 0] - 5) < 0.02


def test_held_out_gain(spark):
    """The model tells held-out texts better than the base does; README has the figures of larger tables."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    held = lm.fold("doc_id", 7) == 2
    model, counts = lm.fit(docs.where(~held))
    total = lm.score(docs, model, counts, held).where("held_out").selectExpr("sum(score - base_score) / sum(n_tokens)").first()[0]
    assert total > 0.15


def test_empty_training(make):
    docs = make([(1, "a b"), (2, None)])
    model, counts = lm.fit(docs.limit(0))
    got = {r.doc_id: r for r in lm.score(docs, model, counts, F.lit(True)).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].base_score == 0.0 and got[2].n_tokens == 1


def test_tokens_of_segments():
    h, cls, first = lm.tokens(pa.array(["a b", "", None, "a"]))
    assert (cls[h == lm.END] == 0).all() and (cls[h != lm.END] > 0).all() and cls[0] == cls[5]
    assert first.tolist() == [0, 3, 4, 5, 7] and h[0] == h[5] and (h[[2, 3, 4, 6]] == lm.END).all()
