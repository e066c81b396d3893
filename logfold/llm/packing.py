"""Packing: bounded-space online packing of token streams into fixed windows.

Each partition keeps a fixed number of open windows. Whole windows of a long document are emitted at once; its
rest goes to the open window that it fills best. Where none has room, the fullest one is topped up with the head
of the piece and emitted. At the end of a partition its open windows merge, which leaves one partial window; those
of many partitions merge the same way, and what is left at last is cut at powers of two, which need no padding.

Null texts are empty: such a document still has its end token. Texts of any length are cut, never shortened.
Repeated rows and ties are documents of their own. Of other columns only the id is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table
from .textbuf import LOWER, SPACE, raw, run_hashes, segments

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
WINDOW = 2048
OPEN_WINDOWS = 32
#: Words that a worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Partitions whose last windows merge in one task.
MERGED = 256

PIECES = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long"

_CLASS = np.full(256, 3, np.uint8)
_CLASS[SPACE] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[0xC3] = 1
_CLASS[0x80:0xC0] = 1
_PLAIN = np.zeros(256, bool)
_PLAIN[[9, 10, 13]] = _PLAIN[32:127] = _PLAIN[0xC3] = _PLAIN[0x80:0xC0] = True


class Tokens:
    """Token ids of whole texts, equal to those of the tokenizer file.

    Texts of ASCII and Latin-1 letters are split into words by vectorised passes, and each distinct word is given
    to the tokenizer's model once; texts with other bytes, special tokens or the signs between the letters of
    Latin-1 go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.reset()

    def reset(self) -> None:
        self.seen: dict[int, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.at, self.size, self.n = np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64), 0

    def learn(self, word: bytes) -> int:
        ids = [t.id for t in self.model.tokenize(word.decode() if word.isascii() else "".join(map(self.shown.__getitem__, word)))]
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + len(ids)))
        if self.n == len(self.at):
            self.at, self.size = np.resize(self.at, 2 * self.n), np.resize(self.size, 2 * self.n)
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[self.n], self.size[self.n] = self.used, len(ids)
        self.used += len(ids)
        self.n += 1
        return self.n - 1

    def slow(self, text: bytes) -> np.ndarray:
        return np.array(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def fast(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each piece and the end) of pieces without odd bytes."""
        low = LOWER[buf]
        kind = _CLASS[buf]
        if (buf >= 128).any():
            second = np.flatnonzero(buf == 0xC3) + 1
            low[second] += np.where((buf[second] <= 0x9E), 32, 0).astype(np.uint8)
        edge = np.empty(len(buf) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[at] = True
        edge[:-1] |= kind == 2
        quote = np.flatnonzero((buf == 39) & edge[:-1])
        if len(quote):
            padded = np.concatenate([low, np.zeros(2, np.uint8)])
            a, b = padded[quote + 1], padded[quote + 2]
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            inside = ~edge[np.minimum(quote + 2, len(buf))]
            last = np.isin(quote + 1, at)
            one &= ~last
            two &= ~last & inside
            edge[quote[one | two] + 1] = False
            edge[quote[one] + 2] = True
            edge[quote[two] + 3] = True
        cut = np.flatnonzero(edge)
        word = kind[cut[:-1]] != 0
        s, e = cut[:-1][word], cut[1:][word]
        h, first, inverse = np.unique(run_hashes(low, s, e), return_index=True, return_inverse=True)
        get, text = self.seen.get, low.tobytes()
        keys = h.tolist()
        index = [get(x) for x in keys]
        for i, x in enumerate(index):
            if x is None:
                index[i] = self.seen[keys[i]] = self.learn(text[s[first[i]] : e[first[i]]])
        which = np.array(index, np.int64)[inverse] if len(index) else np.zeros(0, np.int64)
        size = self.size[which]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.at[which] - total[:-1], size) + np.arange(total[-1])]
        if self.n > REMEMBERED:
            self.reset()
        return ids, total[np.searchsorted(s, at)]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        data, off = raw(column)
        held: list[np.ndarray] = []
        doc = -1
        fine = np.ones(len(off), bool)
        if len(data):
            odd = ~_PLAIN[data]
            one, two = data[:-1], data[1:]
            odd[:-1] |= ((one == 60) & (two == 124)) | ((one == 0xC3) & ((two == 0x97) | (two == 0xB7)))
            fine[np.searchsorted(off, np.flatnonzero(odd), "right") - 1] = False
        for buf, docs, at in segments(data, off):
            ok = fine[docs]
            if ok.all():
                ids, first = self.fast(buf, at)
                each = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            else:
                good = np.repeat(ok, np.diff(at))
                sizes = np.where(ok, np.diff(at), 0)
                ids, first = self.fast(buf[good], np.concatenate([[0], np.cumsum(sizes)]))
                each = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                for k in np.flatnonzero(~ok).tolist():
                    each[k] = self.slow(buf[at[k] : at[k + 1]].tobytes())
            for d, x in zip(docs.tolist(), each, strict=True):
                if d != doc and doc >= 0:
                    yield np.concatenate(held) if len(held) > 1 else held[0]
                    held = []
                doc = d
                held.append(x)
        if doc >= 0:
            yield np.concatenate(held) if len(held) > 1 else held[0]


@cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


class Packer:
    """Open windows of (piece, ...) with emit() for finished ones. A piece: (key, start, length, crc, doc_tokens)."""

    def __init__(self, first_id: int, size: int, most: int):
        self.size, self.most, self.next = size, most, first_id
        self.open: list[list] = []  # [room, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.rows.append((*p, self.next, at))
            at += p[2]
        self.next += 1

    def put(self, piece: tuple, cut) -> None:
        """Places a piece of 1 to size tokens; cut(piece, n) gives its first n tokens and the rest."""
        while True:
            n = piece[2]
            best = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if best is not None:
                best[0] -= n
                best[1].append(piece)
                if not best[0]:
                    self.open.remove(best)
                    self.emit(best[1])
                return
            if len(self.open) < self.most:
                if n == self.size:
                    self.emit([piece])
                else:
                    self.open.append([self.size - n, [piece]])
                return
            full = min(self.open, key=lambda w: w[0])
            self.open.remove(full)
            head, piece = cut(piece, full[0])
            self.emit([*full[1], head])

    def merge(self, cut) -> list[tuple]:
        """Merges the open windows, fullest first; returns the pieces of the one that stays partial."""
        room, left = self.size, []
        for _, pieces in sorted(self.open, key=lambda w: w[0]):
            for p in pieces:
                if p[2] >= room:
                    head, p = cut(p, room) if p[2] > room else (p, None)
                    self.emit([*left, head])
                    room, left = self.size, []
                if p is not None:
                    left.append(p)
                    room -= p[2]
        self.open = []
        return left


def _cut(p: tuple, n: int) -> tuple[tuple, tuple]:
    """The first n tokens of a piece and the rest, each with its own checksum."""
    key, start, length, _, whole, data = p
    a, b = data[: 4 * n], data[4 * n :]
    return (key, start, n, zlib.crc32(a), whole, a), (key, start + n, length - n, zlib.crc32(b), whole, b)


def _pack_partition(path: str, size: int, most: int, end_id: int):
    schema = pa.schema([(n, pa.int64()) for n in ("key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part")] + [("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer = Packer(part << 32, size, most)
        out = lambda rows: pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1, 2, 3, 4, 6, 7)), pa.array([part] * len(rows), pa.int64()), pa.nulls(len(rows), pa.binary())], schema=schema)
        model, end = tokens(path), np.array([end_id], np.uint32)
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), model.texts(batch.column(1)), strict=True):
                data = np.concatenate([ids, end]).astype("<u4").tobytes()
                n = len(data) // 4
                for at in range(0, n, size):
                    part_ids = data[4 * at : 4 * (at + size)]
                    piece = (key, at, len(part_ids) // 4, zlib.crc32(part_ids), n, part_ids)
                    packer.emit([piece]) if piece[2] == size else packer.put(piece, _cut)
            if len(packer.rows) >= 2000:
                yield out(packer.rows)
                packer.rows = []
        left = packer.merge(_cut)
        if packer.rows:
            yield out(packer.rows)
        if left:
            yield pa.RecordBatch.from_arrays([*(pa.array([p[i] for p in left], pa.int64()) for i in range(5)), pa.array([-1] * len(left), pa.int64()), pa.array(range(len(left)), pa.int64()), pa.array([part] * len(left), pa.int64()), pa.array([p[5] for p in left], pa.binary())], schema=schema)

    return run


def _merge_leftovers(size: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "offset"])
        packer = Packer((1 << 62) | (int(key[0]) << 32), size, 1)
        null = rows["key"].isna()
        packer.open = [[0, [(None if z else int(k), int(s), int(n), int(c), int(w), d) for k, z, s, n, c, w, d in zip(rows["key"], null, rows["start"], rows["length"], rows["ids_crc32"], rows["doc_tokens"], rows["ids"], strict=True)]]]
        left = packer.merge(_cut)
        rest = sum(p[2] for p in left)
        while left:
            room, taken = 1 << (rest.bit_length() - 1), []
            rest -= room
            while room:
                p = left.pop(0)
                if p[2] > room:
                    p, more = _cut(p, room)
                    left.insert(0, more)
                taken.append(p)
                room -= p[2]
            packer.emit(taken)
        names = ["key", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]
        made = pd.DataFrame(packer.rows, columns=names).drop(columns="ids")
        made["key"] = made["key"].astype("Int64")
        return made.assign(part=-1)[["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"]]

    return run


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """One row a piece: id, start and length in its document, crc32 of its ids, sequence and offset there."""
    slim = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    pieces = materialise(slim.mapInArrow(_pack_partition(path, size, open_windows, end_id), PIECES + ", ids binary"), "pieces")
    left = pieces.where("sequence_id = -1").groupBy(F.floor(F.col("part") / MERGED).alias("block"))
    merged = left.applyInPandas(_merge_leftovers(size), PIECES)
    return pieces.where("sequence_id >= 0").drop("ids").unionByName(merged).drop("part").withColumnRenamed("key", id_col)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
