import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from logfold.llm import neardup as nd

W = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingle_set(text):
    w = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingle_set(t) for i, t in rows}
    texts = dict(rows)
    ids = sorted(parent)
    for a in ids:
        for b in ids:
            if a < b and root(a) != root(b):
                x, y = sets[a], sets[b]
                if texts[a] == texts[b] or (x and y and len(x & y) / len(x | y) >= 0.8):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def corpus(g):
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(25):
        base = [g.choice(vocab) for _ in range(g.choice([40, 120, 300]))]
        for c in range(g.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(g.choice([0, 0, 1])):
                w[g.randrange(len(w))] = "changed"
            rows.append((1000 * k + c, " ".join(w)))
    return rows


def others(g, n, start):
    """Documents that are nobody's copy: with them, no group has FREQUENT of the documents, and every shingle weighs fully."""
    return [(start + i, " ".join(f"o{g.randrange(10**6)}" for _ in range(6))) for i in range(n)]


def test_groups_equal_brute_force(make):
    rows = corpus(random.Random(8)) + others(random.Random(1), 500, 100_000)
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(make(rows)).collect()}
    assert got == brute(rows)


def test_large_buckets_lose_nothing(make, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3)
    rows = corpus(random.Random(9)) + others(random.Random(2), 500, 100_000)
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(make(rows)).collect()}
    assert got == brute(rows)


def weighted_brute(rows):
    """Groups by the weighted similarity, from the definition: exact document frequencies, all pairs."""
    bags = {}
    for i, t in rows:
        w = W.findall(t.lower())
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    df = Counter(s for b in bags.values() for s in b)
    idf = {s: min(1, math.log(1 + len(rows) / n) / math.log(1 + 1 / nd.FREQUENT)) ** 0.5 if n > nd.FREQUENT * len(rows) else 1 for s, n in df.items()}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(bags):
        for b in sorted(bags):
            if a < b:
                least = sum(min(n, bags[b][s]) * idf[s] for s, n in bags[a].items())
                most = sum(max(bags[a][s], bags[b][s]) * idf[s] for s in bags[a].keys() | bags[b].keys())
                if least >= 0.8 * most:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in parent}


def test_weighted_groups_equal_brute_force(make):
    """Frequent lines weigh less: texts that differ by little else are apart, by the plain similarity they aren't."""
    g = random.Random(12)
    line = " ".join(f"license{i}" for i in range(40))
    rows = []
    for k in range(80):
        own = [f"d{k}w{i}" for i in range(12)]
        rows += [(10 * k, f"{line} {' '.join(own)}"), (10 * k + 1, f"{line} {' '.join(own)} tail{k}")]
        if k % 4 == 0:
            own[g.randrange(12)] = "x"
            rows.append((10 * k + 2, f"{line} {' '.join(own)}"))
    rows += [(5000 + k, " ".join([f"p{k}a{i}" for i in range(30)] * (1 + k % 3))) for k in range(6)]
    rows += [(6000 + k, " ".join([f"p{k}a{i}" for i in range(30)])) for k in range(6)]
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(make(rows)).collect()}
    assert got == weighted_brute(rows) and got != brute(rows)


def test_frequencies_of_frequent_shingles(make):
    rows = [(i, "a b c d e" if i % 3 else f"x{i} y z u v") for i in range(3000)]
    weights = nd.frequencies(make(rows).select("text"))
    doc, h, n = nd.shingles(pa.array(["a b c d e", "x0 y z u v"]))
    want = (math.log(1 + 3000 / 2000) / math.log(21)) ** 0.5
    assert abs(weights(h, n)[0] - want) < 1e-3 and weights(h, n)[1] == 1 and len(weights.h) == 1


def test_frequencies_are_exact_whatever_the_partitions(make, monkeypatch):
    """Of 2,000 documents 110, 101, 100 and 99 have a text's shingle, mostly late ones, and three in four have one that every small task sees."""
    share = {5: 110, 6: 101, 7: 100, 8: 99}
    rows = [(i, f"all{i % 4 > 0} of them have this {'own' if i % 4 else i}") for i in range(2000 - sum(share.values()))]
    rows += [(len(rows) + k, " ".join(f"s{c}w{i}" for i in range(5))) for c, n in share.items() for k in range(n)]
    rows.insert(0, rows.pop())
    df = Counter(s for _, t in rows for s in shingle_set(t))
    _, h, _ = nd.shingles(pa.array(texts := sorted(" ".join(s) for s in df)))
    want = [min(1, math.log1p(2000 / df[tuple(t.split())]) / math.log1p(1 / nd.FREQUENT)) ** 0.5 for t in texts]
    for n in (1, 200):
        for held in (nd.HELD, 50):
            monkeypatch.setattr(nd, "HELD", held)
            weights = nd.frequencies(make(rows).select("text").repartition(n))
            assert len(weights.h) == sum(x > 100 for x in df.values()) == 5
            assert np.array_equal(np.sort(weights.h), np.sort(h[[df[tuple(t.split())] > 100 for t in texts]]))
            assert np.allclose(weights(h, np.ones(len(h), np.int64)), want, rtol=0, atol=1e-12)


def test_only_shingles_that_may_be_frequent_are_shuffled(make, monkeypatch):
    """Frequent in the whole is frequent in some chunk, so counts are exact with few of the shingles, and as with all of them."""
    g = random.Random(16)
    rows = [(i, f"own{i} words{i} of{i} this{i} one{i}" if i % 9 else "a line that nine have") for i in range(1800)]
    rows += [(1800 + i, "just over a twentieth has" if i < 101 else f"more{i} own{i} words{i} of{i} it{i}") for i in range(200)]
    g.shuffle(rows)
    _, h, _ = nd.shingles(pa.array(["a line that nine have", "just over a twentieth has"]))
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"])
    found = np.concatenate([b.column(0).to_numpy().view(np.uint64) for b in nd._candidates(nd.HELD, nd.FREQUENT)(iter([batch]))])
    assert sorted(found) == sorted(h)
    for bound in (nd.CANDIDATES, 0):
        monkeypatch.setattr(nd, "CANDIDATES", bound)
        for n, held in ((1, nd.HELD), (7, 50)):
            monkeypatch.setattr(nd, "HELD", held)
            weights = nd.frequencies(make(rows).select("text").repartition(n))
            want = [(math.log1p(2000 / k) / math.log1p(1 / nd.FREQUENT)) ** 0.5 for k in (200, 101)]
            assert sorted(weights.h) == sorted(h) and np.allclose(weights(h, np.ones(2, np.int64)), want, rtol=0, atol=1e-12)


def test_groups_do_not_hang_on_the_partitions(make):
    """A license that every text has weighs less also where a task has one text."""
    line = " ".join(f"license{i}" for i in range(40))
    rows = [(k, f"{line} {' '.join(f'd{k}w{i}' for i in range(3))}") for k in range(60)]
    for n in (1, 60):
        got = {r.doc_id: r.class_id for r in nd.near_duplicates(make(rows).repartitionByRange(n, "doc_id")).collect()}
        assert got == weighted_brute(rows)
    assert got != brute(rows)


def test_two_texts_under_one_id_are_two_documents(make):
    g = random.Random(13)
    a, b = ([f"{c}{i}" for i in range(120)] for c in "ab")
    near = list(b)
    near[g.randrange(10, 100)] = "changed"
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(near)), *others(g, 60, 100)]
    got = [r for r in nd.near_duplicates(make(rows)).collect() if r.doc_id < 3]
    by_text = {r.digest: r for r in got}
    assert len(got) == 3 and len({r.class_digest for r in got}) == 2
    near_row = next(r for r in got if r.doc_id == 2)
    assert near_row.class_id == 1 and by_text[near_row.class_digest].doc_id == 1


def test_a_long_text_and_its_near_copy(make):
    g = random.Random(14)
    words = [f"v{g.randrange(50_000)}" for _ in range(200_000)]
    copy = list(words)
    for _ in range(2000):
        copy[g.randrange(len(copy))] = "changed"
    assert sum(map(len, words)) > 1 << 20
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(make([(1, " ".join(words)), (2, " ".join(copy)), *others(g, 60, 100)])).collect()}
    assert got[1] == got[2] == 1 and got[100] == 100


def test_large_stars_meet_their_template(make):
    g = random.Random(10)
    rows = others(g, 7000, 10_000)
    for size, start in ((300, 0), (60, 1000)):
        base = [f"s{start}w{i}" for i in range(104)]
        for c in range(size):
            w, i = list(base), g.randrange(5, 90)
            w[i], w[g.randrange(i + 5, 99)] = f"x{c}", f"y{c}"
            rows.append((start + c, " ".join(w)))
        rows.append((start + size, " ".join(base)))
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(make(rows)).collect()}
    assert {i: c for i, c in got.items() if i < 10_000} == {i: 0 if i < 1000 else 1000 for i, _ in rows if i < 10_000}


def test_odd_rows(make, odd):
    got = nd.near_duplicates(make(odd)).collect()
    assert len(got) == len(odd)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.class_id)
    assert by[4] == by[5] == {4} and by[1] == {1} and by[2] == {2} and by[6] == {6} and by[None] == {None}
    assert nd.near_duplicates(make([])).count() == 0


def test_samples_agree_as_weighted_jaccard():
    g = np.random.default_rng(1)
    h = g.integers(0, 1 << 63, 400).astype(np.uint64)
    w = g.random(400).astype(np.float32) + 0.2
    a, b = np.sort(np.arange(0, 320)), np.sort(np.arange(60, 400))
    doc = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
    _, sig = nd.samples(doc, np.concatenate([h[a], h[b]]), np.concatenate([w[a], w[b]]))
    both = np.intersect1d(a, b)
    want = w[both].sum() / (w[a].sum() + w[b].sum() - w[both].sum())
    assert abs((sig[0] == sig[1]).mean() - want) < 0.16


def test_shingles():
    doc, h, n = nd.shingles(pa.array(["a b c d e a b c d e a b c d e", "x y", "", None, "A-B.c d e"]))
    assert doc.tolist().count(0) == 5 and n[doc == 0].tolist().count(3) == 1 and doc.tolist().count(1) == 1 and doc.tolist().count(4) == 1
    assert h[doc == 4][0] in h[doc == 0]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)]
    got = {r.v: r.group for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)}
