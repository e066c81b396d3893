import random
import zlib

import numpy as np
import pyarrow as pa

from logfold.llm import packing

ODD = ["", "don't 's's can't've ''s \"'s 's'sand we're 'REx THEY'LL o'd", "Ünïcode ÉÀ × ÷ ß", "<|endoftext|> a <|x", "日本語 test é", "a\x1cb \x00 c", "x'r", "1234 5a6 a_b __ -- %%% ***e", "é́ combining", " nbsp x", "A" * 3000 + " b", None]


def ids_of(text):
    return np.array(packing.tokens(packing.tokenizer_path()).whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_tokens_equal_the_tokenizer():
    g = random.Random(4)
    texts = ODD + ["".join(g.choice("ab'sStdrelv ém É1.,\n<|*") for _ in range(60)) for _ in range(500)]
    for t, got in zip(texts, packing.Tokens(packing.tokenizer_path()).texts(pa.array(texts)), strict=True):
        assert got.tolist() == ids_of(t)[:-1].tolist(), t


def check(docs, rows, size=2048, repeated=()):
    """docs: (key, text) in any order; keys in repeated may come several times and are only checked in their sequences."""
    by_doc, by_seq, padding = {}, {}, 0
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {k for k, _ in docs}
    for key, text in docs:
        if key in repeated:
            continue
        ids, at = ids_of(text), 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_round_trip_and_little_padding(make):
    g = random.Random(1)
    docs = [(i, " ".join(g.choice(["alpha", "beta", "x1", "é"]) for _ in range(g.choice([0, 3, 50, 700, 6000])))) for i in range(150)]
    rows = packing.pack(make(docs).repartition(5, "doc_id"), packing.tokenizer_path()).collect()
    assert check(docs, rows) == 0


def test_odd_rows(make, odd):
    rows = packing.pack(make(odd), packing.tokenizer_path()).collect()
    check(odd, rows, repeated={6})
    assert sum(r.length for r in rows if r.doc_id == 6) == 2 * len(ids_of("a"))
    assert packing.pack(make([]), packing.tokenizer_path()).count() == 0


def test_best_fit_and_fullest_first():
    p = packing.Packer(0, 10, 2)
    cut = packing._cut
    piece = lambda k, n: (k, 0, n, 0, n, b"\0\0\0\0" * n)
    p.put(piece(1, 4), cut)
    p.put(piece(2, 7), cut)
    p.put(piece(3, 3), cut)
    assert [r[0] for r in p.rows] == [2, 3]
    p.put(piece(4, 9), cut)
    p.put(piece(5, 8), cut)
    assert [(r[0], r[2]) for r in p.rows[2:]] == [(4, 9), (5, 1)] and sorted(w[0] for w in p.open) == [3, 6]
