import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logfold.llm import langid, lm, quality, toxicity
from logfold.llm.sampling import labelled_sample

SF01 = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    r = toxicity.op7_toxicity(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (r[r.toxic == 1].predicted == 1).mean() > 0.85 and (r[r.toxic == 0].predicted == 0).mean() > 0.98


def test_quality_held_out(spark):
    r = quality.op3_quality(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (r.predicted == r.quality).mean() > 0.97


def test_langid_held_out(spark):
    r = langid.op10_langid(spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (r.lang_pred == r.lang).mean() > 0.97 and r.score.between(0, 1).all()


@pytest.fixture(scope="module")
def labelled(make):
    g = random.Random(1)
    good = lambda: " ".join(g.choice(["river", "stone", "cloud", "meadow"]) for _ in range(30))
    rows = [(100 + i, good() + (" vile rotten" if i % 3 == 0 else "")) for i in range(120)]
    return rows, [(i, int((i - 100) % 3 == 0), int((i - 100) % 2)) for i, _ in rows]


def test_toxicity_odd_rows(spark, make, odd, labelled):
    rows, labels = labelled
    ls = spark.createDataFrame([(i, t, "x") for i, t, _ in labels] + [(None, 1, "x"), (100, None, "x")], "doc_id long, toxic int, text string")
    docs = make(rows + odd)
    model = toxicity.fit(docs, ls)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out) and out[0].rid == "x"
    y = dict((i, t) for i, t, _ in labels)
    assert all((r.score > 0.5) == bool(y[r.doc_id]) for r in out if r.doc_id in y)
    assert toxicity.score(make([]), model).count() == 0
    assert toxicity.fit(docs, ls.limit(0)).logits(pa.array(["x"]))[0] == -np.inf


def test_quality_odd_rows(spark, make, odd, labelled):
    rows, _ = labelled
    rows = rows + [(900 + i, "### !! ### " * 20) for i in range(60)]
    ls = spark.createDataFrame([(i, int(i < 900)) for i, _ in rows], "doc_id long, quality int")
    docs = make(rows + odd)
    model = quality.fit(docs, ls)
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    assert all((r.score >= 0.3) == (r.doc_id < 900) for r in out if r.doc_id and r.doc_id >= 100)
    assert {r.score for r in quality.score(docs, quality.fit(docs, ls.limit(0))).collect()} == {0.5}


TEXTS = ["Vile, rotten words AND vile rot\u00e9 things", "", None, "a bb ccc dddd eeeee ffffff", "x" * 3000, "same same same !!! *** 12,5\n" * 60, "\0\x1c \u65e5\u672c \u00f1" * 30]


def test_toxicity_scores_equal_a_plain_version():
    """Word by word: each word's features, counted over the text, at every level that they reach."""
    words = re.compile("[A-Za-z\x80-\U0010ffff]+")
    of = {}
    for t in TEXTS:
        for w in words.findall(t or ""):
            of[w] = np.concatenate([f for _, f in toxicity.feature_hashes(pa.array([w]))]).tolist()
    g = np.random.default_rng(4)
    chosen = np.array(sorted({f | (k << toxicity.BITS) for fs in of.values() for f in fs[:3] for k in range(3)}))
    w = g.standard_normal(len(chosen))
    model = toxicity.assembled(chosen, w, -0.3)
    weight = dict(zip(chosen.tolist(), w, strict=True))
    got = model.logits(pa.array(TEXTS))
    rows, places = toxicity._matches(pa.array(TEXTS), chosen)
    for i, t in enumerate(TEXTS):
        n = Counter(f for x in words.findall(t or "") for f in of[x])
        has = {f | (k << toxicity.BITS) for f, c in n.items() for k, least in enumerate(toxicity.LEVELS) if c >= least}
        assert abs(got[i] - (-0.3 + sum(weight.get(f, 0) for f in has))) < 1e-9
        assert set(chosen[places[rows == i]].tolist()) == has & set(weight)


def test_toxicity_learns_from_every_shard(spark, make, labelled, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 20)
    rows, labels = labelled
    docs = make(rows)
    model = toxicity.fit(docs, spark.createDataFrame([(i, t) for i, t, _ in labels], "doc_id long, toxic int"))
    y = dict((i, t) for i, t, _ in labels)
    assert all((r.score > 0.5) == bool(y[r.doc_id]) for r in toxicity.score(docs, model).collect())


def test_quality_scores_equal_a_plain_version():
    """Passage by passage, from the definition."""
    model = quality.train([np.random.default_rng(i).random((3, quality.WIDTH)).astype(np.float16) for i in range(20)], np.arange(20) % 2, 0.5)
    p = {k: v.astype(float) for k, v in model.p.items()}
    got = model.scores(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        data, total, value = (t or "").encode(), 0.0, 0.0
        words = [(m.start(), m[0].lower(), len(m[0])) for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
        for at in range(0, max(1, len(data)), quality.PASSAGE):
            part = data[at : at + quality.PASSAGE]
            pairs = Counter(int(quality._CLASS[a]) * 16 + int(quality._CLASS[b]) for a, b in zip(part, part[1:], strict=False))
            x = np.zeros(quality.WIDTH)
            for k, n in pairs.items():
                x[k] = (n / sum(pairs.values())) ** 0.5
            own = [w for w in words if at <= w[0] < at + quality.PASSAGE]
            for k in (1, 2):
                x[255 + k] = 4 * sum(a[1] == b[1] for a, b in zip(own, own[k:], strict=False)) / max(1, len(own))
            x[258] = min(3, sum(w[2] for w in own) / max(1, len(own)) / 8)
            h = np.tanh(x @ p["W"] + p["b"])
            a = math.exp(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
            total, value = total + a, value + a * h
        want = 1 / (1 + math.exp(-float(value / total @ p["o"] + p["d"][0])))
        assert abs(got[i] - want) < 1e-3, i


def test_langid_vectors_and_votes_equal_a_plain_version():
    texts = [t for t in TEXTS if t] + ["der die das", "the and of", "les et la"]
    got = langid.vectors(pa.array(texts))
    for i, t in enumerate(texts):
        data = t.encode()
        c = [b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in data]
        want = np.zeros(1 << langid.BITS)
        for n in (2, 3, 4):
            for at in range(len(c) - n + 1):
                if c[at] == c[at + 1] == 32:
                    continue
                h = c[at]
                for b in c[at + 1 : at + n]:
                    h = (h * 0x9E3779B1 + b) & 0xFFFFFFFF
                want[(((h ^ (h >> 15)) * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - langid.BITS)] += 1
        want = np.sqrt(want)
        assert np.allclose(got[i], want / max(1e-9, np.linalg.norm(want)), atol=1e-5)
    codes = np.array(["de", "en", "nl", "fr", "es", "fi"] * 10, object)
    x = np.random.default_rng(5).random((60, 1 << langid.BITS)).astype(np.float32)
    model = langid.Hierarchy(x, codes)
    z = got @ model.w[:-1] + model.w[-1]
    names, conf = model.predict(pa.array(texts))
    for i, t in enumerate(texts):
        best = int(z[i, : len(model.families)].argmax())
        at, votes = len(model.families), Counter({c: 0 for c in model.members[best]})
        for k, pairs in enumerate(model.pairs):
            for a, b in pairs:
                if k == best:
                    votes[a if z[i, at] > 0 else b] += 1
                at += 1
        if any(map(str.isalpha, t)):
            assert votes[names[i]] == max(votes.values()) and 0 <= conf[i] <= 1
        else:
            assert names[i] == "und"


@pytest.mark.parametrize("module", [toxicity, lm])
def test_segments_do_not_change_results(module, monkeypatch):
    """Texts of over a megabyte are handled in segments; small segments give what large ones do."""
    g = random.Random(6)
    text = " ".join("".join(g.choice("abcde") for _ in range(g.randrange(1, 9))) for _ in range(250_000))
    assert len(text) > 1 << 20
    texts = pa.array([text, "short", None])
    run = (lambda: toxicity._matches(texts, np.arange(0, 3 << 22, 37))) if module is toxicity else (lambda: lm.tokens(texts))
    whole = run()
    cut = module.segments
    monkeypatch.setattr(module, "segments", lambda d, o: cut(d, o, 5000))
    small = run()
    assert all(len(a) == len(b) and (a == b).all() for a, b in zip(whole, small, strict=True))


def test_a_text_over_a_megabyte_is_scored_whole(make, spark):
    """Its last words count: quality and language see the whole text."""
    long = "river stone cloud meadow " * 60_000
    assert len(long) > 1 << 20
    model = quality.train([np.random.default_rng(i).random((3, quality.WIDTH)).astype(np.float16) for i in range(20)], np.arange(20) % 2, 0.5)
    noisy = long + "### !! ### " * 60_000
    a, b = model.scores(pa.array([long, noisy]))
    assert abs(a - b) > 1e-4
    x = langid.vectors(pa.array([long, long + "zürich " * 100_000]))
    assert np.abs(x[0] - x[1]).max() > 0.05


def test_empty_tables(spark, make):
    none = make([])
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert quality.score(none, quality.fit(none, labels)).count() == 0
    assert langid.identify(none, langid.fit(none.withColumn("lang", F.lit("en")))).count() == 0


def test_outputs_replace_columns_of_their_name(make, labelled):
    df = make(labelled[0][:3]).withColumns({"score": F.lit("x"), "lang_pred": F.lit("x")})
    model = quality.Attention()
    model.share = 0.25
    assert [r.score for r in quality.score(df, model).collect()] == [0.25] * 3
    out = langid.identify(df, langid.Hierarchy(np.zeros((0, 1 << langid.BITS), np.float32), np.array([], object))).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)] * 3


def test_samples_are_bounded_and_the_same(spark):
    rows = [(i, "a" if i % 10 else "b", "t" * (1 + i % 7)) for i in range(5000)] + [(7, "a", "other text")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    take = lambda d, **k: sorted(tuple(r) for r in labelled_sample(d, d, 100, "doc_id", "text", "lang", **k).collect())
    one = take(df)
    assert one == take(df.orderBy(F.rand(1)).repartition(7)) and Counter(x for x, _ in one) == {"a": 100, "b": 100}
    assert sum(len(t) for x, t in take(df, most_bytes=50) if x == "a") <= 50
    with pytest.raises(ValueError, match="different values"):
        labelled_sample(spark.range(2000).selectExpr("id as doc_id", "id as lang", "'x' as text"), spark.range(2000).selectExpr("id as doc_id", "id as lang"), 5, "doc_id", "text", "lang")


def test_langid_odd_rows(spark, make, odd):
    g = random.Random(2)
    stems = {"de": ["der", "und", "nicht", "schon"], "en": ["the", "and", "with", "this"], "fr": ["les", "avec", "pour", "être"], "es": ["los", "para", "niño", "más"]}
    rows = [(1000 + i, " ".join(g.choice(stems[c]) for _ in range(25)), c) for i, c in enumerate(list(stems) * 30)]
    docs = make([(i, t) for i, t, _ in rows] + odd + [(8, "12 34 !?")])
    lang = F.create_map(*[F.lit(x) for i, _, c in rows for x in (i, c)])
    model = langid.fit(docs.withColumn("lang", lang[F.col("doc_id").cast("int")]))
    out = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(out[i].lang_pred == c for i, _, c in rows)
    assert [out[i].lang_pred for i in (1, 2, 8)] == ["und"] * 3 and out[6].lang_pred != "und"
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
