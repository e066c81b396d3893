"""Approximate nearest neighbours by additive quantisation.

BOOKS codebooks of WORDS full-dimensional codewords are fitted on a bounded sample of unit vectors: residual k-means,
then rounds of beam-search encoding and a joint least-squares update of all codewords. Every row is encoded by beam
search and stored with its codes and the norm of what they add up to. A search scores codes from a table of query and
codeword products, divides by the stored norm, and reranks the best RERANK of each query in a CHUNK of rows, whatever
their order, by the exact cosine.

Queries are taken in blocks of about QUERY_BLOCK, one job after another; a block is sent to all tasks, whose scan of the
index never shuffles, and each task returns a few rows for each query. Every block is compared with every row's codes.

Null or zero vectors, those that hold null or non-finite components and those of another length than most take no
part, nor do rows with a null id. Equal scores rank by id; repeated rows of one id count once. An empty index gives no
rows. Of other columns only id and vector are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table

BOOKS, WORDS, BEAM = 16, 64, 4
#: Bound of the fitting sample, first in hash order.
SAMPLE = 16_384
QUERY_BLOCK, RERANK, CHUNK = 2048, 512, 65_536


def _sq(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


def _kmeans(x: np.ndarray, k: int, g: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[g.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ c.T - _sq(c) / 2).argmax(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        c[n == 0] = x[g.integers(0, len(x), (n == 0).sum())]
    return c


class Quantiser:
    """books: BOOKS x WORDS x dimensions."""

    def __init__(self, books: np.ndarray):
        self.books = books

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 3) -> Quantiser:
        g, rest, made = np.random.default_rng(seed), x.copy(), []
        for _ in range(books):
            c = _kmeans(rest, words, g)
            rest = rest - c[(rest @ c.T - _sq(c) / 2).argmax(1)]
            made.append(c)
        self = cls(np.array(made, np.float32))
        for _ in range(rounds):
            codes, _ = self.encode(x)
            flat = codes.astype(np.int64) + np.arange(books) * words
            gram, right = np.zeros((books * words, books * words)), np.zeros((books * words, x.shape[1]))
            for m in range(books):
                np.add.at(right, flat[:, m], x)
                for k in range(books):
                    np.add.at(gram, (flat[:, m], flat[:, k]), 1)
            gram += np.eye(len(gram)) * 1e-2
            solved = np.linalg.solve(gram, right + 1e-2 * self.books.reshape(-1, x.shape[1]))
            self.books = solved.reshape(self.books.shape).astype(np.float32)
        return self

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared norms of the sums) by beam search."""
        n, (books, words, d) = len(x), self.books.shape
        codes, norms = np.zeros((n, books), np.uint8), np.zeros(n, np.float32)
        for at in range(0, n, 2048):
            part = x[at : at + 2048].astype(np.float32)
            rest, path = part[:, None, :], np.zeros((len(part), 1, 0), np.uint8)
            rows = np.arange(len(part))[:, None]
            for c in self.books:
                cost = _sq(rest.reshape(-1, d)).reshape(len(part), -1, 1) - 2 * (rest @ c.T) + _sq(c)
                flat = cost.reshape(len(part), -1)
                best = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
                kept, word = best // words, best % words
                rest = rest[rows, kept] - c[word]
                path = np.concatenate([path[rows, kept], word[:, :, None].astype(np.uint8)], axis=2)
            end = np.einsum("ijk,ijk->ij", rest, rest).argmin(1)
            codes[at : at + 2048] = path[np.arange(len(part)), end]
            norms[at : at + 2048] = _sq(part - rest[np.arange(len(part)), end])
        return codes, norms


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    top = np.abs(v).max(1, keepdims=True)
    v = v / top
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _encode(model, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                codes, norms = q.encode(unit(x))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=[*b.schema.names, "codes", "norm"])

    return run


def _better(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by score and then id; an id counts once. Empty places have score -inf."""
    order = np.lexsort((ids, -scores), axis=1)
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    for j in range(1, ids.shape[1]):
        again = (ids[:, :j] == ids[:, j : j + 1]).any(1)
        scores[again, j] = -np.inf
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches joined until they have `rows` rows; an id comes once in each."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _search(shared, k: int, rerank: int, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, q_ids, q = shared.value
        books = model.books.shape[0]
        table_ = np.ascontiguousarray(np.einsum("qd,mwd->mqw", q.astype(np.float32), model.books))
        ids = np.full((len(q_ids), k), np.iinfo(np.int64).max)
        scores = np.full((len(q_ids), k), -np.inf)
        for chunk in _chunks(batches, CHUNK):
            own, first = np.unique(chunk.column(0).to_numpy(), return_index=True)
            chunk = chunk.take(pa.array(first)).combine_chunks()
            x = unit(chunk.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            codes = np.frombuffer(b"".join(chunk.column(2).to_pylist()), np.uint8).reshape(-1, books)
            scale = 1 / np.sqrt(np.maximum(chunk.column(3).to_numpy(), 1e-12))
            for lo in range(0, len(q_ids), 256):
                hi = min(lo + 256, len(q_ids))
                best, where = np.full((hi - lo, 0), 0, np.float32), np.zeros((hi - lo, 0), np.int64)
                for at in range(0, len(own), 4096):
                    part = slice(at, at + 4096)
                    near = table_[0, lo:hi].take(codes[part, 0], axis=1)
                    for m in range(1, books):
                        near += table_[m, lo:hi].take(codes[part, m], axis=1)
                    near *= scale[part]
                    near[q_ids[lo:hi, None] == own[None, part]] = -np.inf
                    both = np.concatenate([best, near], axis=1)
                    place = np.concatenate([where, np.broadcast_to(np.arange(at, at + near.shape[1]), near.shape)], axis=1)
                    if both.shape[1] > rerank:
                        # Of equal scores the smaller ids are kept; places stand in their order.
                        cut = -np.partition(-both, rerank - 1, axis=1)[:, rerank - 1 : rerank]
                        above, equal = both > cut, both == cut
                        pick = above | (equal & (np.cumsum(equal, axis=1) <= rerank - above.sum(1, keepdims=True)))
                        both, place = both[pick].reshape(hi - lo, rerank), place[pick].reshape(hi - lo, rerank)
                    best, where = both, place
                for at in range(0, hi - lo, 32):
                    own_rows = slice(lo + at, min(lo + at + 32, hi))
                    pick = where[at : at + 32]
                    exact = np.einsum("qrd,qd->qr", x[pick], q[own_rows])
                    exact = np.where(np.isneginf(best[at : at + 32]), -np.inf, exact)
                    keep = np.lexsort((own[pick], -exact), axis=1)[:, :k]
                    both_i = np.concatenate([ids[own_rows], np.take_along_axis(own[pick], keep, 1)], axis=1)
                    both_s = np.concatenate([scores[own_rows], np.take_along_axis(exact, keep, 1)], axis=1)
                    ids[own_rows], scores[own_rows] = _better(both_i, both_s, k)
        row, col = np.nonzero(~np.isneginf(scores))
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids[row, col]), pa.array(scores[row, col])], names=["query_id", "vec_id", "score"])

    return run


def usable(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(rows that take part as (id, v), their dimension)."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0").where(~bad & F.exists("v", lambda e: e != 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = most[0] if most else 0
    return rows.where(F.size("v") == d), d


def build(rows: DataFrame, d: int, sample: int = SAMPLE) -> tuple[Quantiser, DataFrame]:
    """(quantiser, index): the index has id, v, codes and norm for every row."""
    few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column(0).combine_chunks()
    model = Quantiser.fit(unit(few.flatten().to_numpy().reshape(-1, d)).astype(np.float32))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return model, materialise(rows.mapInArrow(_encode(shared, d), "id long, v array<double>, codes binary, norm float"), "index")


def search(index: DataFrame, model: Quantiser, queries: DataFrame, k: int = 5, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the index nearest to each query (id, v), itself left out."""
    spark, d = index.sparkSession, model.books.shape[2]
    blocks = max(1, ceil(queries.count() / QUERY_BLOCK))
    folder, schema = f"{shared_dir(spark)}/found-{uuid.uuid4().hex}", "query_id long, vec_id long, score double"
    spark.createDataFrame([], schema).write.parquet(folder)
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).dropDuplicates(["id"]).orderBy("id").toArrow()
        if not got.num_rows:
            continue
        x = got.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
        shared = spark.sparkContext.broadcast((model, got.column("id").to_numpy(), unit(x)))
        index.mapInArrow(_search(shared, k, rerank, d), schema).write.mode("append").parquet(folder)
        shared.destroy()
    best = spark.read.schema(schema).parquet(folder).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark, sf_dir: str) -> DataFrame:
    rows, d = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model, index = build(rows, d)
    return search(index, model, index.where("id % 50 = 0").select("id", "v"))
