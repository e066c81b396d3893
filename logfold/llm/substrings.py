"""Suffix-array dedup: bytes covered by LENGTH-byte strings that start at two places or more, found by run-length indexes.

Equal strings must meet to be found. Each LENGTH-byte window has an anchor, its least-hashed SEED bytes; equal windows
have equal anchors, so it suffices to compare windows of one anchor. Consecutive windows with one anchor form a block
(about 85 windows). Blocks that are equal as a whole repeat all their windows; only where an anchor has different
blocks are the bytes of one copy of each gathered, in shards by anchor, and indexed.

A shard's index is the run-compressed Burrows-Wheeler transform of its blocks with the suffix array and the common
prefixes sampled at the ends of runs. From the samples alone follow, position after position of the text, its neighbours
in suffix order and how long it agrees with them: its matching statistics. It repeats if that is LENGTH or more.

An anchor with more than HOT different blocks goes by the hashes of its windows instead, counted in a shuffle on the
hash, so that no shard grows with it; the windows found are the same.

Rows are numbered in the order of the scan; a table that isn't read from files directly is written out with its
numbers first, so that they are the same wherever a task runs again.

Strings never cross documents. Null texts are empty and, like texts under LENGTH bytes, lose nothing. Ids must be
integers. Ties: all places of a repeated string lose it. Texts of any length are handled whole, repeated rows are copies. Of other columns only the id is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove, table
from .textbuf import raw, run_hashes

LENGTH, SEED = 200, 32
SEEDS = LENGTH - SEED + 1
#: Bytes of a shard's text, and different blocks of an anchor up to which they share a shard.
SHARD, HOT = 2 << 20, 4000
PIECE = 1 << 19
_BITS = np.uint64(21)

ROWS = "rid long, kmer long, block long, lo long, n int"


def _blocks_of(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, anchor) of each block of the pieces at:at+1 of buf. A window's piece holds it whole."""
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    i = np.arange(len(buf) - SEED + 1)
    h = run_hashes(buf, i, i + SEED)
    packed = ((h >> _BITS) << _BITS) | i.astype(np.uint64)
    pad = -len(packed) % SEEDS
    grid = np.concatenate([packed, np.full(pad, ~np.uint64(0))]).reshape(-1, SEEDS)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[SEEDS - 1 : SEEDS - 1 + n])
    anchor = (least & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
    w = np.arange(n)
    piece = np.searchsorted(at, w, "right") - 1
    valid = w + LENGTH <= at[piece + 1]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (piece[1:] != piece[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    ok = valid[start]
    return start[ok], size[ok], anchor[start[ok]]


def _pieces(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, document of each piece, its place there); long documents come in pieces that share LENGTH - 1 bytes."""
    docs, lo, hi, held = [], [], [], 0

    def out():
        size = np.array(hi) - np.array(lo)
        return np.concatenate([data[a:b] for a, b in zip(lo, hi, strict=True)]), np.concatenate([[0], np.cumsum(size)]), np.array(docs), np.array(lo) - off[docs]

    for d in np.flatnonzero(np.diff(off) >= LENGTH).tolist():
        for a in range(int(off[d]), int(off[d + 1]) - LENGTH + 1, PIECE):
            docs.append(d)
            lo.append(a)
            hi.append(min(a + PIECE + LENGTH - 1, int(off[d + 1])))
            held += hi[-1] - a
            if held >= PIECE:
                yield out()
                docs, lo, hi, held = [], [], [], 0
    if docs:
        yield out()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rid = b.column(0).to_numpy()
        for buf, at, docs, place in _pieces(*raw(b.column(1))):
            start, size, anchor = _blocks_of(buf, at)
            if not len(start):
                continue
            kmer, block = run_hashes(buf, anchor, anchor + SEED), run_hashes(buf, start, start + size + LENGTH - 1)
            piece = np.searchsorted(at, start, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(rid[docs[piece]]), pa.array(kmer.view(np.int64)), pa.array(block.view(np.int64)), pa.array(place[piece] + start - at[piece]), pa.array(size.astype(np.int32))], names=["rid", "kmer", "block", "lo", "n"])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kmer", "block", "n", "hot", "context"]
    for b in batches:
        data, off = raw(b.column(0))
        lists = b.column(1)
        wanted, owner = lists.flatten(), np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        lo, n = wanted.field("lo").to_numpy() + off[owner], wanted.field("n").to_numpy()
        for i in range(0, len(owner), 5000):
            own = slice(i, i + 5000)
            context = pa.array([data[a : a + k + LENGTH - 1].tobytes() for a, k in zip(lo[own].tolist(), n[own].tolist(), strict=True)], pa.binary())
            part = wanted.slice(i, 5000)
            yield pa.RecordBatch.from_arrays([*(part.field(f) for f in names[:4]), context], names=names)


class RunLengthIndex:
    """Run-compressed transform of texts, which may hold any bytes but never match across one another."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts])
        self.text = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
        ends = np.cumsum(size + 1) - 1
        self.order = self._suffixes(ends)
        before = self.text[self.order - 1].astype(np.int16)
        separator = np.zeros(len(self.text), bool)
        separator[ends] = True
        before[separator[self.order - 1]] = -1
        head = np.append(True, (before[1:] != before[:-1]) | (before[1:] < 0))
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(before)) - 1
        self.runs = len(first)
        rank = np.empty(len(self.text), np.int64)
        rank[self.order] = np.arange(len(self.text))
        up, down = self.order[first] - 1, self.order[last] - 1
        up, down = np.where(up < 0, len(rank) - 1, up), np.where(down < 0, len(rank) - 1, down)
        self.left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(len(self.text))
        self.up = self._sampled(up, self.order[np.maximum(rank[up] - 1, 0)])
        self.down = self._sampled(down, self.order[np.minimum(rank[down] + 1, len(rank) - 1)])
        self.order = None

    def _sampled(self, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Samples by text position: the position, its neighbour in suffix order, and the bytes they share, counted up to LENGTH."""
        by = np.argsort(at)
        at, to = at[by], to[by]
        padded = np.concatenate([self.text, np.zeros(LENGTH + 16, np.uint8)])
        words = np.ndarray((len(self.text) + LENGTH + 8,), "<u8", padded, strides=(1,))
        shared, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
        for k in range(0, LENGTH, 8):
            differs = words[at[open_] + k] ^ words[to[open_] + k]
            stop = differs != 0
            low = differs[stop] & (~differs[stop] + np.uint64(1))  # its lowest set bit
            shared[open_[stop]] = k + np.log2(low.astype(np.float64)).astype(np.int64) // 8
            open_ = open_[~stop]
            if not len(open_):
                break
        shared[open_] = LENGTH
        return at, to, shared

    def _suffixes(self, ends: np.ndarray) -> np.ndarray:
        """The suffix array by prefix doubling from seven symbols on; separators are below all bytes."""
        n = len(self.text)
        symbol = self.text.astype(np.int64) + 1
        symbol[ends] = 0
        key, width = symbol << 54, 7
        for k in range(1, min(width, n)):
            key[:-k] |= symbol[k:] << (54 - 9 * k)
        while True:
            order = np.argsort(key)
            by = key[order]
            new = np.append(0, np.cumsum(by[1:] != by[:-1]))
            if new[-1] == n - 1:
                return order
            rank = np.empty(n, np.int64)
            rank[order] = new
            key = rank * (n + 1)
            key[:-width] += rank[width:] + 1
            width *= 2

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For the suffix before and the suffix after each text position: where it starts, and the bytes both share, counted up to LENGTH at least.

        Within a run, the neighbour of the position to the left is the one to the left of the neighbour, and they share
        one byte more; so the nearest sample at or after a position leads back to its own neighbour."""
        n = len(self.text)
        for at, to, shared in (self.up, self.down):
            k = np.repeat(np.arange(len(at)), np.diff(np.concatenate([[-1], at])))
            back = np.full(n, -1)
            back[: len(k)] = at[k] - np.arange(len(k))
            k = np.concatenate([k, np.full(n - len(k), len(at) - 1)])
            q = to[k] - back
            yield q, np.where((back >= 0) & (q >= 0), shared[k] + back, 0)

    def matching_statistics(self) -> np.ndarray:
        """The longest match of each text position with another one, not across texts; counted up to LENGTH at least."""
        n = len(self.text)
        longest = np.zeros(n, np.int64)
        for q, shared in self.neighbours():
            ok = np.flatnonzero((shared > 0) & (q < n) & (q != np.arange(n)))
            own = np.minimum(shared[ok], np.minimum(self.left[ok], self.left[q[ok]]))
            longest[ok] = np.maximum(longest[ok], own)
        return longest

    def repeated(self, length: int) -> np.ndarray:
        """Whether the `length` bytes at each position of the text also start elsewhere in it."""
        return self.matching_statistics() >= length


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


FOUND = "kmer long, block long, a int, z int"


def _index_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size, last = 0, None

    def out():
        index = RunLengthIndex([x[2] for x in held])
        flags, at, rows = index.repeated(LENGTH), 0, []
        for kmer, block, context in held:
            rows += [(kmer, block, a, z) for a, z in _ranges(flags[at : at + len(context) - LENGTH + 1])]
            at += len(context) + 1
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["kmer", "block", "a", "z"])

    for b in batches:
        for kmer, block, context in zip(*(b.column(c).to_pylist() for c in ("kmer", "block", "context")), strict=True):
            if size >= SHARD and kmer != last:
                yield out()
                held, size = [], 0
            held.append((kmer, block, context))
            size, last = size + len(context), kmer
    if held:
        yield out()


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for kmer, block, context in zip(*(b.column(c).to_pylist() for c in ("kmer", "block", "context")), strict=True):
            i = np.arange(len(context) - LENGTH + 1)
            h = run_hashes(np.frombuffer(context, np.uint8), i, i + LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array([kmer] * len(i), pa.int64()), pa.array([block] * len(i), pa.int64()), pa.array(i.astype(np.int32)), pa.array(h.view(np.int64))], names=["kmer", "block", "a", "h"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = raw(b.column(1))
        spans, rows = b.column(2), []
        for i in range(b.num_rows):
            own, text = spans[i].as_py() or [], data[off[i] : off[i + 1]]
            if not own:
                rows.append((0, 0, hashlib.sha256(text).hexdigest()))
                continue
            mark = np.zeros(len(text) + 1, np.int32)
            np.add.at(mark, [s["s"] for s in own], 1)
            np.add.at(mark, [s["e"] for s in own], -1)
            gone = np.cumsum(mark[:-1]) > 0
            rows.append((int(gone.sum()), len(_ranges(gone)), hashlib.sha256(text[~gone].tobytes()).hexdigest()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows])], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(rid, spans): byte spans (s, e) of docs (rid, text) that LENGTH-byte strings cover that start elsewhere too; they may overlap."""
    rows = materialise(docs.select("rid", "text").mapInArrow(_scan, ROWS), "anchors")
    blocks = rows.groupBy("kmer", "block").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "lo", "n")).alias("one"))
    blocks = materialise(blocks.select("kmer", "block", "copies", "one.rid", "one.lo", "one.n"), "blocks")
    several = blocks.groupBy("kmer").agg(F.count("*").alias("m")).where("m > 1")
    wanted = blocks.join(several, "kmer").select("rid", F.struct("kmer", "block", "lo", "n", (F.col("m") > HOT).alias("hot")).alias("w"))
    wanted = wanted.groupBy("rid").agg(F.collect_list("w").alias("wanted"))
    contexts = docs.select("rid", "text").join(wanted, "rid").select("text", "wanted").mapInArrow(_cut_contexts, "kmer long, block long, n int, hot boolean, context binary")
    contexts = materialise(contexts, "contexts")
    found = contexts.where(~F.col("hot")).select("kmer", "block", "context").repartition("kmer").sortWithinPartitions("kmer", "block").mapInArrow(_index_shards, FOUND)
    hashed = contexts.where("hot").select("kmer", "block", "context").mapInArrow(_window_hashes, "kmer long, block long, a int, h long")
    twice = hashed.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    found = found.unionByName(hashed.join(twice, "h").select("kmer", "block", "a", F.col("a").alias("z")))
    found = found.unionByName(blocks.where("copies > 1").select("kmer", "block", F.lit(0).alias("a"), (F.col("n") - 1).alias("z")))
    found = materialise(found, "found")
    remove(contexts, blocks)
    spans = rows.join(found, ["kmer", "block"]).select("rid", (F.col("lo") + F.col("a")).alias("s"), (F.col("lo") + F.col("z") + LENGTH).alias("e"))
    spans = materialise(spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    remove(rows, found)
    return spans


def _numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, text): rows with numbers that stay the same in every job."""
    docs = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    try:
        df.select("_metadata.row_index")  # only a scan of files has it, and its partitions are planned alike each time
    except AnalysisException:
        return materialise(docs, "numbered")
    return docs


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes)."""
    docs = _numbered(df, id_col, text_col)
    spans = repeated_spans(docs.select("rid", "text"))
    return docs.join(spans, "rid", "left").select("id", "text", "spans").mapInArrow(_remove, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
