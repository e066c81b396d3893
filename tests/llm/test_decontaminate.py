import hashlib
import random
import re

from logfold.llm import decontaminate as dc
from tests.conftest import SF, same_rows

W = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(item, w[i : i + 13]) for i in range(max(1, len(w) - 12))] if w else []
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(str(item))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(docs, items, **k):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated) for r in dc.decontaminate(docs, items, **k).collect()), key=str)


def test_equals_brute_force(spark, make, odd, monkeypatch):
    g = random.Random(3)
    vocab = ["Aé", "b", "c", "ÉÉ", "the", "x9", "日本"]
    docs = [(100 + i, " ".join(g.choice(vocab) for _ in range(g.randrange(60)))) for i in range(60)] + [r for r in odd if r[0] != 3]
    items = [(i, " , ".join(g.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 8, 12, 13, 14, 20, 40, 0])]
    items += [(50, " ".join(words(docs[4][1])[:30])), (51, None), (52, docs[5][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    assert got(make(docs), bench) == brute(docs, items)
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 7)
    assert got(make(docs).coalesce(2), bench) == brute(docs, items)


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert got(make([(1, "a b")]), none) == brute([(1, "a b")], [])
    assert got(make([]), none) == []


def test_query_equals_its_sql(spark, duck):
    same_rows(dc.op4_decontamination(spark, SF), duck.sql(dc.OP4_SQL))
