import hashlib
import random
from collections import Counter

import numpy as np

from logfold.llm import substrings as ss


def brute(rows, length=200):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, x in data:
        for k in range(len(x) - length + 1):
            seen[x[k : k + length]] += 1
    out = []
    for i, x in data:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        out.append((i, len(x), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in ss.remove_repeats(df).collect()), key=str)


def corpus(g):
    word = lambda: "".join(g.choice("abcdeé") for _ in range(g.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(4)]
    rows = [(i, text(g.randrange(120)) + g.choice(["", g.choice(shared), g.choice(shared)[30:]]) + text(g.randrange(90))) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(6)] + [(200, "tick " * 200), (201, "ab" * 99 + "c"), (202, "x" * 199), (203, shared[0][:250] + "|" + shared[0][51:251])]
    return rows


def test_equals_brute_force(make, odd, monkeypatch):
    rows = corpus(random.Random(4)) + [r for r in odd if r[0] != 3]
    assert got(make(rows)) == brute(rows)
    monkeypatch.setattr(ss, "HOT", 1)
    assert got(make(rows)) == brute(rows)


def test_long_text_and_empty_table(make):
    g = random.Random(6)
    unique = " ".join(str(g.random()) for _ in range(40_000))
    ((_, n, removed, spans, _),) = got(make([(1, unique + unique[:1000])]))
    assert (n, spans) == (len(unique) + 1000, 2) and removed == 2000
    assert got(make([])) == []


def test_index_equals_counting():
    g = random.Random(1)
    base = "".join(g.choice("abc") for _ in range(400))
    for _ in range(25):
        texts = []
        for _ in range(g.randrange(1, 7)):
            i = g.randrange(300)
            texts.append((base[i : i + g.randrange(100)] + "".join(g.choice("ab\0") for _ in range(g.randrange(5, 60))) + base[: g.randrange(60)]).encode())
        index = ss.RunLengthIndex(texts)
        flags = index.repeated(12)
        seen = Counter(x[i : i + 12] for x in texts for i in range(len(x) - 11))
        at = 0
        for x in texts:
            assert flags[at : at + max(0, len(x) - 11)].tolist() == [seen[x[i : i + 12]] > 1 for i in range(len(x) - 11)]
            at += len(x) + 1
        assert len(index.up[0]) == len(index.down[0]) == index.runs <= len(index.text)


def test_matching_statistics_equal_brute_force():
    g = random.Random(7)
    for _ in range(8):
        base = "".join(g.choice("ab\0") for _ in range(60))
        texts = [(base[g.randrange(40) :] + "".join(g.choice("abc") for _ in range(g.randrange(40)))).encode() for _ in range(4)]
        index = ss.RunLengthIndex(texts)
        got_, at = index.matching_statistics(), 0
        every = [x[i:] for x in texts for i in range(len(x))]
        for x in texts:
            for i in range(len(x)):
                own = x[i:]
                best, skipped = 0, False
                for y in every:
                    if y is own or (not skipped and y == own):
                        skipped = True
                        continue
                    n = next((k for k, (a, b) in enumerate(zip(own, y, strict=False)) if a != b), min(len(own), len(y)))
                    best = max(best, n)
                assert got_[at + i] == best
            at += len(x) + 1


def test_numbers_survive_shuffled_inputs(make, spark):
    """A table that no scan gives is written out with its numbers."""
    rows = corpus(random.Random(8))
    df = make(rows).repartition(5).orderBy("text")
    assert got(df) == brute(rows)
