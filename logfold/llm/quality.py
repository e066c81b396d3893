"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of PASSAGE bytes. A passage is encoded by the frequencies of byte-class pairs and of
repeated words through a small tanh layer; gated attention (tanh(V h) * sigmoid(U h)) weighs the passages, and the
weighted mean of their codes is scored by a logistic unit. Only document labels are learned from, in numpy, on a
bounded sample of MOST rows of each label. Every passage of every text is scored.

Null and empty texts are one empty passage. Repeated rows get equal scores; a document with several labels has the
largest; null labels are ignored. Where a label has no rows, every score is the share of label 1 (0.5 without rows).
Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, table
from .sampling import labelled_sample
from .textbuf import LOWER, SPACE, raw, run_hashes, runs, segments

PASSAGE = 512
#: Bound of the training sample: rows of each label, with their whole texts.
MOST = 3000
CODE, GATE = 24, 12
_CLASS = np.full(256, 15, np.int64)
for _i, _chars in enumerate([b" \t", b"\n\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",;:", b"!?", b"*%&$#@^~", b"|", b"\"'`", b"()[]{}", b"-_/\\", bytes(range(128, 256)), b"<>=+"]):
    _CLASS[list(_chars)] = _i
_WORD = ~SPACE
WIDTH = 256 + 3


def passages(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document of each passage, its features), segment by segment; documents in order, each with one passage at least."""
    data, off = raw(texts)
    for buf, docs, at in segments(data, off):
        size = np.diff(at)
        n = np.maximum(1, -(-size // PASSAGE))
        first = np.concatenate([[0], np.cumsum(n)])
        owner = np.repeat(docs, n)
        x = np.zeros((first[-1], WIDTH), np.float32)
        if len(buf):
            piece = np.repeat(np.arange(len(docs)), size)
            of = first[piece] + (np.arange(len(buf)) - at[piece]) // PASSAGE
            c = _CLASS[buf]
            pair = of[1:] * 256 + c[:-1] * 16 + c[1:]
            x[:, :256] = np.bincount(pair[of[1:] == of[:-1]], minlength=first[-1] * 256).reshape(-1, 256)
            s, e = runs(_WORD[buf], at)
            h, where = run_hashes(LOWER[buf], s, e), of[s]
            words = np.maximum(1, np.bincount(where, minlength=first[-1]))
            for k in (1, 2):
                same = (h[k:] == h[:-k]) & (where[k:] == where[:-k])
                x[:, 255 + k] = 4 * np.bincount(where[k:][same], minlength=first[-1]) / words
            x[:, 258] = np.minimum(3, np.bincount(where, (e - s).astype(float), minlength=first[-1]) / words / 8)
            x[:, :256] = np.sqrt(x[:, :256] / np.maximum(1, x[:, :256].sum(1, keepdims=True)))
        yield owner, x


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
        for owner, x in passages(b.column(1)):
            cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            for d, part in zip(owner[cut].tolist(), np.split(x, cut[1:]), strict=True):
                got[d].append(part.astype(np.float16))
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array([np.concatenate(g).tobytes() for g in got], pa.binary())], names=["label", "bag"])


class Attention:
    """The network's parameters, its forward pass over bags, and its gradient."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        init = lambda a, b: (g.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": init(WIDTH, CODE) * 2, "b": np.zeros(CODE, np.float32), "V": init(CODE, GATE), "U": init(CODE, GATE), "w": init(GATE, 1)[:, 0], "o": init(CODE, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.share = None

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        h = np.tanh(x @ self.p["W"] + self.p["b"])
        t, s = np.tanh(h @ self.p["V"]), 1 / (1 + np.exp(-(h @ self.p["U"])))
        return h, t, s, (t * s) @ self.p["w"]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, size: int = 64, rate: float = 0.004, decay: float = 1e-4) -> Attention:
        g = np.random.default_rng(1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        t_ = 0
        for _ in range(epochs):
            order = g.permutation(len(bags))
            for at in range(0, len(order), size):
                pick = order[at : at + size]
                x = np.concatenate([bags[i] for i in pick]).astype(np.float32)
                n = np.array([len(bags[i]) for i in pick])
                start = np.concatenate([[0], np.cumsum(n)[:-1]])
                bag = np.repeat(np.arange(len(pick)), n)
                h, t, s, a = self.encode(x)
                a = np.exp(a - np.maximum.reduceat(a, start)[bag])
                a /= np.add.reduceat(a, start)[bag]
                z = np.add.reduceat(h * a[:, None], start)
                f = z @ self.p["o"] + self.p["d"]
                df = (1 / (1 + np.exp(-f)) - y[pick]) / len(pick)
                dz = df[:, None] * self.p["o"]
                dh = a[:, None] * dz[bag]
                da = (h * dz[bag]).sum(1)
                de = a * (da - np.add.reduceat(a * da, start)[bag])
                dt, ds = de[:, None] * self.p["w"] * s * (1 - t * t), de[:, None] * self.p["w"] * t * s * (1 - s)
                dh = (dh + dt @ self.p["V"].T + ds @ self.p["U"].T) * (1 - h * h)
                grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "o": z.T @ df, "d": np.array([df.sum()])}
                t_ += 1
                for k, q in self.p.items():
                    d = grad[k] + decay * q
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v2[k] = 0.999 * v2[k] + 0.001 * d * d
                    self.p[k] = (q - rate * (m[k] / (1 - 0.9**t_)) / (np.sqrt(v2[k] / (1 - 0.999**t_)) + 1e-8)).astype(np.float32)
        return self

    def scores(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        if self.share is not None:
            return np.full(n, self.share)
        top, total, value = np.full(n, -np.inf), np.zeros(n), np.zeros((n, CODE))
        for owner, x in passages(texts):
            h, _, _, a = self.encode(x)
            docs = np.unique(owner)
            new = top.copy()
            np.maximum.at(new, owner, a)
            scale = np.exp(top[docs] - new[docs])
            total[docs] *= scale
            value[docs] *= scale[:, None]
            top = new
            e = np.exp(a - top[owner])
            np.add.at(total, owner, e)
            np.add.at(value, owner, h * e[:, None])
        f = value / np.maximum(total, 1e-30)[:, None] @ self.p["o"] + self.p["d"]
        return 1 / (1 + np.exp(-np.clip(f.astype(float), -700, 700)))


def train(bags: list[np.ndarray], y: np.ndarray, share: float) -> Attention:
    """Learns from balanced bags; the bias is then set back to the share of label 1."""
    model = Attention()
    if len(set(y.tolist())) < 2:
        model.share = share
        return model
    model.fit(bags, y.astype(np.float32))
    drawn = y.mean()
    model.p["d"] = model.p["d"] + np.float32(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))) if 0 < share < 1 else model.p["d"]
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST) -> Attention:
    """Learns from at most `most` rows of each label; the share of label 1 counts all labels."""
    known = labels.where(F.col(label_col).isin(0, 1))
    n, ones = known.agg(F.count("*"), F.sum(F.col(label_col).cast("long"))).first()
    sample = labelled_sample(docs, known, most, id_col, text_col, label_col)
    got = sample.mapInArrow(_bags, "label int, bag binary").collect()
    bags = [np.frombuffer(r[1], np.float16).reshape(-1, WIDTH) for r in got]
    return train(bags, np.array([r[0] for r in got]), ones / n if n else 0.5)


def _score(model, at: int, out_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.scores(part.column(at)), pa.float64())], names=[*b.schema.names, out_col])

    return run


def score(df: DataFrame, model: Attention, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """df with the probability that each text has label 1; a column named as out_col is replaced."""
    df = df.drop(out_col)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*df.schema.fields, StructField(out_col, DoubleType())])
    return df.mapInArrow(_score(shared, df.columns.index(text_col), out_col), schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    got = score(docs, model).drop("text")
    return got.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
