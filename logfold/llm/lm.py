"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

A token's class is a hash of its last three bytes, so every token has one, seen or not; the end has class 0 to itself.
Classes stand in WIDTH groups of WIDTH. The most frequent tokens of a class are its members, and one more event stands
for all its rarer tokens: P(event | history) = P(group | history) P(class | group, history) P(event | class, history).
All factors are log-linear in the same hashed features, the last word, the last two as a bigram, and the word before the
last (a skip feature), and start from the counts' own frequencies. A rare token w has in addition its share
(c(w) + 1) / (sum of those + 1) among the rare tokens of its class and one unseen type, so the probabilities of all
tokens add up to 1.

Weight rows grow as the sixth root of the training tokens, counts with the distinct tokens. Training passes once over all
training texts in ROUNDS. In each round every task takes gradient steps from the same parameters on its share of the
texts; the changes of each row of weights are averaged over the tasks that touched it, piece by piece in steps of at
most FAN through a shuffle, and added. Counts of the HEAD most frequent tokens go to every task; all others are joined
by a shuffle on the token's hash. Tokens with equal counts are ranked by their hash.

Null texts are empty: their only token is the end. Texts of any length are scored whole. Repeated rows are documents
of their own. Without training texts every token is unseen. Ids must be integers. Of other columns only the id is kept.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise, table
from .textbuf import LOWER, SPACE, raw, run_hashes, runs, segments, slices

#: Outputs of each factor; every factor's part of the weight rows.
WIDTH, SHARE, FEATURES = 32, (2, 2, 2), 3
CLASSES, RARE = WIDTH * WIDTH, WIDTH - 1
#: Most frequent tokens, at most, whose counts are sent to every task.
HEAD = 200_000
#: Of 8 parts of the training texts, by hash, those that each round takes.
ROUNDS = ((0, 1), (2, 3, 4, 5, 6, 7))
STEP, BLOCK = 1.0, 16384
#: Parts that one task adds up, and rows of weights in a piece.
FAN, PIECE = 64, 512
END, PAD = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_TOKEN = ~SPACE


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all tokens with each document's end, their classes, first token of each document and the end)."""
    data, off = raw(texts)
    n = np.zeros(len(off) - 1, np.int64)
    hashes, classes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int16)]
    for buf, docs, at in segments(data, off):
        low = LOWER[buf]
        s, e = runs(_TOKEN[buf], at)
        hashes.append(run_hashes(low, s, e))
        last = np.zeros(len(s), np.uint32)
        for k in range(1, 4):
            last = last * np.uint32(257) + np.where(e - s >= k, low[np.maximum(e - k, 0)], 0).astype(np.uint32)
        last = (last ^ (last >> np.uint32(13))) * np.uint32(0x9E3779B1)
        classes.append((1 + (last >> np.uint32(16)) % np.uint32(CLASSES - 1)).astype(np.int16))
        n[docs] += np.diff(np.searchsorted(s, at))
    first = np.concatenate([[0], np.cumsum(n)])
    h, cls = np.insert(np.concatenate(hashes), first[1:], END), np.insert(np.concatenate(classes), first[1:], np.int16(0))
    return h, cls, first + np.arange(len(first))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, class, count) of this task's tokens, in a few parts."""

    def merged(parts):
        h, k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, at, where = np.unique(h, return_index=True, return_inverse=True)
        return u, k[at], np.bincount(where, n, len(u)).astype(np.int64)

    def out(parts):
        u, k, n = merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(n)], names=["h", "k", "c"])

    parts, held = [], 0
    for b in batches:
        for part in slices(b, 0, 1024):
            h, cls, _ = tokens(part.column(0))
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            parts.append((u, cls[at], n))
            held += len(u)
            if held > 2_000_000:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > 1_000_000:
                    yield out(parts)
                    parts, held = [], 0
    if parts:
        yield out(parts)


def _row_sums(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, the sum of g's rows that have each, how many)."""
    order = np.argsort(row.astype(np.uint16) if row.max() < 1 << 16 else row, kind="stable")
    r = row[order]
    at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    size = np.diff(np.append(at, len(r)))
    few = np.minimum(size, 17).astype(np.uint8)
    by = np.argsort(17 - few, kind="stable")
    at, size = at[by], size[by]
    more = len(size) - np.cumsum(np.bincount(few, minlength=18))  # rows with more than k
    total = g.take(order[at], axis=0)
    for k in range(1, 16):
        if not more[k]:
            break
        total[: more[k]] += g.take(order[at[: more[k]] + k], axis=0)
    for s in range(more[16]):
        total[s] += g.take(order[at[s] + 16 : at[s] + size[s]], axis=0).sum(0)
    return r[at], total, size


class Model:
    """Event of each head token, and the biases and weights of the three factors."""

    def __init__(self, head: np.ndarray, classes: np.ndarray, counts: np.ndarray, masses: np.ndarray, distinct: np.ndarray):
        """head: tokens by falling count, with their classes; masses, distinct: of all training tokens and types in each class."""
        self.total, self.distinct = int(masses.sum()), int(distinct.sum())
        rank = np.empty(len(head), np.int64)
        by = np.argsort(classes, kind="stable")
        start = np.searchsorted(classes[by], np.arange(CLASSES))
        rank[by] = np.arange(len(head)) - start[classes[by]]
        event = classes * WIDTH + np.minimum(rank, RARE)
        own = rank < RARE
        mass = np.zeros(CLASSES * WIDTH)
        mass[event[own]] = counts[own]
        mass = mass.reshape(CLASSES, WIDTH)
        members = np.bincount(classes[own], minlength=CLASSES)
        self.rare = np.maximum(masses - mass.sum(1) + distinct - members + 1, 1).astype(float)
        mass[1:, RARE] = self.rare[1:]
        levels = [mass.sum(1).reshape(WIDTH, WIDTH).sum(1)[None], mass.sum(1).reshape(WIDTH, WIDTH), mass]
        with np.errstate(divide="ignore"):
            self.bias = [np.maximum(-40, np.log(x / np.maximum(x.sum(1, keepdims=True), 1e-30))).astype(np.float32) for x in levels]
        order = np.argsort(head, kind="stable")
        self.head, self.counts, self.event = head[order], counts[order], event[order].astype(np.int32)
        rows = 1 << max(6, round(np.log2(368 * max(1, self.total) ** (1 / 6))))
        self.rows = [rows * x for x in SHARE]
        self.weights = [np.zeros((n, WIDTH), np.float32) for n in self.rows for _ in range(FEATURES)]

    def __getstate__(self) -> dict:
        """Weights travel in half precision."""
        return self.__dict__ | {"weights": [w.astype(np.float16) for w in self.weights]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.weights = [w.astype(np.float32) for w in self.weights]

    def look_up(self, h: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(event, count, whether the count is known here) of tokens."""
        other = cls.astype(np.int64) * WIDTH + RARE
        if not len(self.head):
            return other, np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        own = self.head[at] == h
        return np.where(own, self.event[at], other), np.where(own, self.counts[at], 0), own

    @staticmethod
    def history(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        back = []
        for k in (1, 2):
            x = np.full(len(h), PAD)
            x[k:] = h[:-k] if k < len(h) else x[k:]
            back.append(np.where(place >= k, x, PAD))
        mix = lambda x, salt: ((x ^ np.uint64(salt)) * _MIX) ^ (x >> np.uint64(33))
        return [mix(back[0], 1), mix(back[1], 2), mix(back[0] * np.uint64(3) ^ back[1], 3)]

    def factors(self, event: np.ndarray, features: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
        """(factor, the row of weights of each feature, the output wanted, exponentials of all outputs, one over their sum)."""
        cls = event // WIDTH
        for k, (given, want) in enumerate(((np.zeros_like(cls), cls // WIDTH), (cls // WIDTH, cls % WIDTH), (cls, event % WIDTH))):
            salt = (given.astype(np.uint64) + np.uint64(1 + CLASSES * k)) * np.uint64(0x9E3779B97F4A7C15)
            rows = [((((f ^ salt) * _MIX) >> np.uint64(24)) & np.uint64(self.rows[k] - 1)).astype(np.int64) for f in features]
            z = self.bias[k].take(given, axis=0)
            for j, r in enumerate(rows):
                z += self.weights[k * FEATURES + j].take(r, axis=0)
            np.clip(z, -60, 60, out=z)
            np.exp(z, out=z)
            yield k, rows, want, z, 1 / (z @ np.ones(WIDTH, np.float32))

    def log10(self, event: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(event))
        for at in range(0, len(event), BLOCK):
            e = event[at : at + BLOCK]
            for _, _, want, z, over in self.factors(e, [f[at : at + BLOCK] for f in features]):
                out[at : at + BLOCK] += np.log10(z[np.arange(len(e)), want].astype(float) * over)
        return out


class Trainer:
    """Gradient steps from a model's weights; a row's step shrinks with what it has seen."""

    def __init__(self, model: Model):
        self.m, self.start = copy.copy(model), model.weights
        self.m.weights = [w.copy() for w in model.weights]
        self.seen = [np.zeros(len(w), np.float32) for w in model.weights]

    def step(self, event: np.ndarray, features: list[np.ndarray]) -> None:
        for k, rows, want, g, over in self.m.factors(event, features):
            g *= over[:, None]
            g[np.arange(len(event)), want] -= 1
            for j, row in enumerate(rows):
                r, total, n = _row_sums(g, row)
                seen, weight = self.seen[k * FEATURES + j], self.m.weights[k * FEATURES + j]
                times = seen.take(r) + n
                seen[r] = times
                total *= (-STEP / np.sqrt(times * n)).astype(np.float32)[:, None]
                total += weight.take(r, axis=0)
                weight[r] = total

    def change(self) -> tuple[np.ndarray, np.ndarray]:
        """(what was added to each row of weights, factor after factor; which rows were touched)."""
        return np.concatenate([w - v for w, v in zip(self.m.weights, self.start, strict=True)]), np.concatenate(self.seen) > 0


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trainer, some = Trainer(shared.value), False
        for b in batches:
            for part in slices(b, 0, 256, 1 << 20):
                h, cls, first = tokens(part.column(0))
                event = trainer.m.look_up(h, cls)[0]
                features = trainer.m.history(h, first)
                for lo in range(0, len(h), BLOCK):
                    trainer.step(event[lo : lo + BLOCK], [f[lo : lo + BLOCK] for f in features])
                    some = True
        if some:
            change, touched = trainer.change()
            own = TaskContext.get().partitionId()
            for k, at in enumerate(range(0, len(touched), PIECE)):
                if touched[at : at + PIECE].any():
                    yield _piece(own, k, change[at : at + PIECE], touched[at : at + PIECE])

    return run


SUMS = "part long, piece long, change binary, scale binary, touched binary"


def _piece(part: int, piece: int, mean: np.ndarray, touched: np.ndarray) -> pa.RecordBatch:
    """A piece of a part's changes, a byte for each weight and a scale for each row."""
    scale = np.maximum(np.abs(mean).max(1), 1e-12).astype(np.float32) / 127
    small = np.rint(mean / scale[:, None]).astype(np.int8)
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([piece]), *(pa.array([x.tobytes()], pa.binary()) for x in (small, scale, touched.astype(np.int32)))], names=["part", "piece", "change", "scale", "touched"])


def _whole(change: bytes, scale: bytes) -> np.ndarray:
    s = np.frombuffer(scale, np.float32)
    return np.frombuffer(change, np.int8).reshape(len(s), WIDTH) * s[:, None]


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (part, piece), which come sorted: the mean change of each row over all tasks that touched it, and how many."""
    last, change, touched = None, 0.0, 0
    for b in batches:
        for part, piece, *data, t in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if (part, piece) != last and last:
                yield _piece(*last, change / np.maximum(1, touched)[:, None], touched)
                change, touched = 0.0, 0
            last, n = (part, piece), np.frombuffer(t, np.int32)
            change, touched = change + _whole(*data) * n[:, None], touched + n
    if last:
        yield _piece(*last, change / np.maximum(1, touched)[:, None], touched)


def _averaged(changes: DataFrame, parts: int) -> list:
    """The pieces averaged over all parts; each step joins at most FAN parts of a piece in one task."""
    while True:
        changes = changes.withColumn("part", F.floor(F.col("part") / FAN)).repartition("part", "piece").sortWithinPartitions("part", "piece").mapInArrow(_add, SUMS)
        parts = -(-parts // FAN)
        if parts <= 1:
            return changes.select("piece", "change", "scale").collect()


def fit(train: DataFrame, text_col: str = "text", head: int = HEAD) -> tuple[Model, DataFrame]:
    """(model, counts): learns from all texts; counts has h, k (the class), c of every token."""
    spark = train.sparkSession
    texts = train.select(F.col(text_col).alias("text"))
    counts = materialise(texts.mapInArrow(_count, "h long, k int, c long").groupBy("h").agg(F.min("k").alias("k"), F.sum("c").alias("c")), "counts")
    by_class = counts.groupBy("k").agg(F.sum("c"), F.count("*")).collect()
    masses, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, c, n in by_class:
        masses[k], distinct[k] = c, n
    # The most frequent tokens by steps of an eighth of a power of two of their counts, as many whole steps as HEAD holds.
    step = F.floor(F.log2("c") * 8)
    sizes, least, held = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect(), 1 << 20, 0
    for k, n in sizes:
        held += n
        if held > head:
            break
        least = k
    top = counts.where(step >= least).toArrow()
    top = top.take(np.lexsort((top.column("h").to_numpy(), -top.column("c").to_numpy())))
    model = Model(top.column("h").to_numpy().view(np.uint64), top.column("k").to_numpy().astype(np.int64), top.column("c").to_numpy(), masses, distinct)
    # Rows of weights grow with the input, so tasks grow slower than it: what they send grows in proportion.
    tasks = max(1, round(texts.rdd.getNumPartitions() ** (5 / 6)))
    for parts in ROUNDS if by_class else ():
        share = texts.where(F.pmod(F.xxhash64("text"), F.lit(8)).isin(*parts)).coalesce(tasks)
        shared = spark.sparkContext.broadcast(model)
        starts = np.concatenate([[0], np.cumsum([len(w) for w in model.weights])])
        whole = np.concatenate(model.weights)
        for piece, *data in _averaged(share.mapInArrow(_train(shared), SUMS), tasks):
            rows = _whole(*data)
            whole[piece * PIECE : piece * PIECE + len(rows)] += rows
        model.weights = [whole[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        shared.destroy()
    return model, counts


SCORED = "rid long, id long, held boolean, n_tokens long, n_known long, base double, score double, h array<long>, n array<int>"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, rid = shared.value, TaskContext.get().partitionId() << 40
        whole = np.log10(float(m.total + m.distinct + 1))
        for b in batches:
            for part in slices(b, 2, 256, 1 << 20):
                h, cls, first = tokens(part.column(2))
                event, c, known = m.look_up(h, cls)
                p = m.log10(event, m.history(h, first))
                # A rare token's share; where the count isn't known here, + log10(c + 1) follows.
                rare = event % WIDTH == RARE
                p += np.where(rare & (cls > 0), np.where(known, np.log10(c + 1), 0) - np.log10(m.rare[cls]), 0)
                base = np.where(known, np.log10(c + 1) - whole, 0)
                add = lambda x, first=first: np.add.reduceat(x, first[:-1])
                doc = np.repeat(np.arange(part.num_rows), np.diff(first))
                out_doc, out_h = doc[~known], h[~known]
                order = np.lexsort((out_h, out_doc))
                out_doc, out_h = out_doc[order], out_h[order]
                new = np.flatnonzero(np.append(True, (out_h[1:] != out_h[:-1]) | (out_doc[1:] != out_doc[:-1]))) if len(out_h) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(out_h))).astype(np.int32)
                cut = pa.array(np.searchsorted(out_doc[new], np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid + np.arange(part.num_rows)), part.column(0), part.column(1), pa.array(np.diff(first)), pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(add(p)), pa.ListArray.from_arrays(cut, pa.array(out_h[new].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(n))],
                    names=["rid", "id", "held", "n_tokens", "n_known", "base", "score", "h", "n"],
                )
                rid += part.num_rows

    return run


def score(df: DataFrame, model: Model, counts: DataFrame, held, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    local = materialise(rows.mapInArrow(_score(shared), SCORED), "scored")
    rest = local.where(F.size("h") > 0).select("rid", F.explode(F.arrays_zip("h", "n")).alias("t")).select("rid", "t.h", "t.n")
    c = F.coalesce("c", F.lit(0))
    whole = F.lit(float(model.total + model.distinct + 1))
    met = rest.join(counts.select("h", "c"), "h", "left").groupBy("rid").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10((c + 1) / whole)).alias("more_base"), F.sum(F.col("n") * F.log10(c + 1)).alias("more_score")
    )
    out = local.drop("h", "n").join(met, "rid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", plus("n_known", "more").cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score"))


def op8_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold("doc_id", 7) == 2
    model, counts = fit(docs.where(~held))
    return score(docs, model, counts, held)
