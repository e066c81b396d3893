"""Toxicity: non-negative positive-unlabelled learning of a linear classifier over hashed words.

Confirmed toxic rows are the positives, at most MOST_POSITIVE of them; all documents are the unlabelled side. With the
class prior p of the labelled rows, the risk is p R+(f, 1) + max(0, R(f, 0 | unlabelled) - p R+(f, 0)); where the second
term would be negative, its gradient is turned, so that the model can't fit the unlabelled side as negative. All
documents are dealt into shards of about SHARD; each shard trains a classifier in numpy, and these are averaged.
Features are words, their beginnings and endings, each at three levels of how often a text has it. Shares of features
are counted over all documents; the MOST_WORDS words most unlike between the two sides are kept with all their levels.

Null and empty texts have no features and score as the model's bias does. Whole texts of any length are scored.
Repeated rows get equal scores; repeated labels of a document count as toxic if one does, and of several texts with one
id the smallest is learned from; null labels and ids are ignored. Without any confirmed row every score is 0. Other
columns pass through, and one named as the output is replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, materialise, remove, table
from .textbuf import LOWER, raw, run_hashes, runs, segments, slices

BITS = 22
MOST_POSITIVE, MOST_WORDS = 3000, 128
#: Documents that one classifier learns from.
SHARD = 8192
#: A feature counts once more where a text has it so often.
LEVELS = (1, 2, 4)
#: Features kept: in this share of the positives, and so many standard errors above their share of the unlabelled.
LEAST_SHARE, LEAST_Z = 0.01, 6.0
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
#: Bytes of the beginnings and endings that count besides whole words.
AFFIXES = (4, 5, 6)


def feature_hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document of each feature, feature below 2**BITS), segment by segment."""
    data, off = raw(texts)
    shift = np.uint64(64 - BITS)
    for buf, docs, at in segments(data, off):
        low = LOWER[buf]
        s, e = runs(_LETTERS[buf], at)
        word_doc = docs[np.searchsorted(at, s, "right") - 1]
        owner, parts = [word_doc], [run_hashes(low, s, e) >> shift]
        for n in AFFIXES:
            long = e - s >= n
            for a, b, salt in ((s[long], s[long] + n, 0x9E3779B9), (e[long] - n, e[long], 0x7F4A7C15)):
                parts.append(((run_hashes(low, a, b) ^ np.uint64(salt * n)) * np.uint64(0x2545F4914F6CDD1D)) >> shift)
                owner.append(word_doc[long])
        yield np.concatenate(owner), np.concatenate(parts).astype(np.int64)


def _levels(texts: pa.Array) -> list[np.ndarray]:
    """The features of each text, at every level that it reaches."""
    got: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for owner, f in feature_hashes(texts):
        order = np.argsort(owner, kind="stable")
        owner, f = owner[order], f[order]
        cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))[: len(owner)]
        for d, part in zip(owner[cut].tolist(), np.split(f, cut[1:]), strict=False):
            got[d].append(part)
    rows = []
    for parts in got:
        u, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
        rows.append(np.concatenate([u[n >= least] | (k << BITS) for k, least in enumerate(LEVELS)]))
    return rows


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b, 0, 256):
            yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.uint32).tobytes() for r in _levels(part.column(0))], pa.binary())], names=["features"])


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32).astype(np.int64))], names=["f"])


def _among(often):
    """Keeps the features that enough positives have; only these come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = often.value
        for b in batches:
            rows = [np.frombuffer(x, np.uint32) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[np.isin(x, known)].tobytes() for x in rows], pa.binary())], names=["features"])

    return run


def _matches(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in known) of each of the sorted features in known that a text has."""
    k, seen = len(known), []
    base = np.unique(known & ((1 << BITS) - 1))
    own = np.zeros(1 << BITS, bool)
    own[base] = True
    for owner, f in feature_hashes(texts):
        hit = own[f]
        seen.append((owner[hit] << BITS) | f[hit])
    pairs, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.int64), return_counts=True)
    rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for j, least in enumerate(LEVELS if k else ()):
        at = pairs[n >= least]
        f = (at & ((1 << BITS) - 1)) | (j << BITS)
        place = np.minimum(np.searchsorted(known, f), k - 1)
        there = known[place] == f
        rows.append(at[there] >> BITS)
        places.append(place[there])
    return np.concatenate(rows), np.concatenate(places)


def _count_among(often):
    """(place of the feature, documents of this task that have it); -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs = often.value, 0
        total = np.zeros(len(known), np.int64)
        for b in batches:
            for part in slices(b, 0, 1024):
                docs += part.num_rows
                total += np.bincount(_matches(part.column(0), known)[1], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], docs))], names=["f", "n"])

    return run


def _bits(chosen):
    """Which of the chosen features each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chosen.value
        for b in batches:
            for part in slices(b, 0, 1024):
                x = np.zeros((part.num_rows, len(known)), bool)
                x[_matches(part.column(0), known)] = True
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], names=["bits"])

    return run


def _train_shards(shared):
    """The sums of the weights (and the bias, last) over this task's documents, each standing for its shard's classifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positive, prior = shared.value
        k = positive.shape[1]
        held: list[bytes] = []
        total, docs = np.zeros(k + 1), 0

        def learn(rows):
            nonlocal total, docs
            x = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1, count=k).astype(np.float32)
            w, bias = nnpu_fit(positive, x, prior)
            total, docs = total + np.append(w, bias) * len(rows), docs + len(rows)

        for b in batches:
            held += b.column(0).to_pylist()
            while len(held) >= 2 * SHARD:
                learn(held[:SHARD])
                held = held[SHARD:]
        if held:
            learn(held)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 2)), pa.array(np.append(total, docs))], names=["j", "w"])

    return run


class Model:
    """ids: sorted hashed features; weights: of each at each level; bias."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        self.ids, self.weights, self.bias, self.known = ids, weights, bias, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def logits(self, texts: pa.Array) -> np.ndarray:
        out, k = np.full(len(texts), self.bias), len(self.ids)
        if not k:
            return out
        if self.known is None:
            self.known = np.zeros(1 << BITS, bool)
            self.known[self.ids] = True
        seen = []
        for owner, f in feature_hashes(texts):
            own = self.known[f]
            seen.append(owner[own] * k + np.searchsorted(self.ids, f[own]))
        pairs, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.int64), return_counts=True)
        value = sum(np.where(n >= least, self.weights[pairs % k, j], 0.0) for j, least in enumerate(LEVELS))
        return out + np.bincount(pairs // k, value, len(texts))


def nnpu_fit(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, rate: float = 0.02, decay: float = 2e-3, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic model by the non-negative risk; rows of p are positive, of u unlabelled. Adam, full batches."""
    w, m, v = np.zeros((3, p.shape[1] + 1), np.float32)
    w[-1] = -2.0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        sp, su = sig(zp).astype(np.float32), sig(zu).astype(np.float32)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gu, gp = su / len(zu), sp * np.float32(-prior / len(zp))
        if negative < -beta:  # the corrected part is over-fitted: only its turned gradient
            cp, cu = -gp, -gu
        else:
            cp, cu = (sp - 1) * np.float32(prior / len(zp)) + gp, gu
        g = np.concatenate([cp @ p + cu @ u, [cp.sum() + cu.sum()]])
        g[:-1] += decay * w[:-1] / len(w) + 3e-5 * np.sign(w[:-1])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def choose(some: np.ndarray, cp: np.ndarray, positives: int, cu: np.ndarray, unlabelled: int) -> np.ndarray:
    """Sorted features of the MOST_WORDS hashed words with the largest gain; cp and cu count the rows of each side that have each feature."""
    a, b = (cp + 0.5) / (positives + 1), (cu + 0.5) / (unlabelled + 1)
    sure = (a - b) / np.sqrt(b * (1 - b) / positives) >= LEAST_Z
    gain = np.where(sure, a * np.log(a / b), 0)
    word = some & ((1 << BITS) - 1)
    words, which = np.unique(word, return_inverse=True)
    best = np.zeros(len(words))
    np.maximum.at(best, which, gain)
    kept = np.argsort(-best, kind="stable")[:MOST_WORDS]
    kept = kept[best[kept] > 1e-4]
    return np.sort(some[np.isin(word, words[kept]) & (gain > 1e-4)])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positive: int = MOST_POSITIVE) -> Model:
    """Learns from the labelled ids given and from docs, all of which are the unlabelled side.

    Of confirmed rows at most most_positive, first by hash, are read; the prior counts all labels."""
    spark = docs.sparkSession
    empty = Model(np.zeros(0, np.int64), np.zeros((0, len(LEVELS))), -np.inf)
    by_id = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    n, ones = by_id.agg(F.count("*"), F.sum((F.col("y") == 1).cast("long"))).first()
    if not n or not ones:
        return empty
    known = by_id.where("y = 1").select("id").orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(most_positive)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = plain.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text")).select("text")
    positives = materialise(rows.mapInArrow(_features_of, "features binary"), "features")
    p = positives.count()
    if not p:
        remove(positives)
        return empty
    often = positives.mapInArrow(_flat, "f long").groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= max(4, LEAST_SHARE * p)).toArrow()
    order = np.argsort(often.column(0).to_numpy())
    some, cp = often.column(0).to_numpy()[order], often.column(1).to_numpy()[order]
    shared = spark.sparkContext.broadcast(some)
    got = positives.mapInArrow(_among(shared), "features binary").toArrow().column(0).to_pylist()
    remove(positives)
    counted = plain.select("text").mapInArrow(_count_among(shared), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    cu, unlabelled = np.zeros(len(some), np.int64), 0
    for f, m in counted:
        if f < 0:
            unlabelled = m
        else:
            cu[f] = m
    chosen = choose(some, cp, p, cu, unlabelled)
    x = np.zeros((p, len(chosen)), np.float32)
    for i, r in enumerate(got):
        x[i, np.searchsorted(chosen, (f := np.frombuffer(r, np.uint32).astype(np.int64))[np.isin(f, chosen)])] = 1
    shards = max(1, round(unlabelled / SHARD))
    bits = plain.select("text").mapInArrow(_bits(spark.sparkContext.broadcast(chosen)), "bits binary").repartition(shards)
    trained = bits.mapInArrow(_train_shards(spark.sparkContext.broadcast((x, ones / n))), "j long, w double").groupBy("j").agg(F.sum("w").alias("w")).orderBy("j").collect()
    w = np.array([r.w for r in trained])
    return assembled(chosen, w[:-2] / w[-1], w[-2] / w[-1])


def assembled(chosen: np.ndarray, w: np.ndarray, bias: float) -> Model:
    ids = np.unique(chosen & ((1 << BITS) - 1))
    weights = np.zeros((len(ids), len(LEVELS)))
    weights[np.searchsorted(ids, chosen & ((1 << BITS) - 1)), chosen >> BITS] = w
    return Model(ids, weights, float(bias))


def _score(model, at: int, out_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for part in slices(b, at, 1024):
                z = m.logits(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))), pa.float64())], names=[*b.schema.names, out_col])

    return run


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """df with the probability that each text is toxic; a column named as out_col is replaced."""
    df = df.drop(out_col)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*df.schema.fields, StructField(out_col, DoubleType())])
    return df.mapInArrow(_score(shared, df.columns.index(text_col), out_col), schema)


def training_labels(labels: DataFrame, modulus: int, held: int) -> DataFrame:
    return labels.where(fold("doc_id", modulus) != held)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels"), 3, 1))
    got = score(docs, model).drop("text")
    return got.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
