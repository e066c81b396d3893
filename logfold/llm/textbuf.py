"""Vectorised passes over the UTF-8 buffers of Arrow string columns.

A batch is walked in segments of about a megabyte, cut between documents or at white space, so that
temporary arrays stay small whatever a document's length. Runs of bytes (words) get 64-bit polynomial
hashes from one prefix sum each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_M = 0x9E3779B97F4A7C15 | 1
_MINV = pow(_M, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of [0-9a-z] and of non-ASCII characters, after lower-casing A-Z.
WORDS = np.zeros(256, bool)
WORDS[48:58] = WORDS[65:91] = WORDS[97:123] = WORDS[128:] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def slices(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows and about `size` bytes of the text column; a longer text is a part of its own."""
    off = raw(batch.column(column))[1]
    at, n = 0, batch.num_rows
    while at < n:
        to = min(n, at + rows, max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def segments(data: np.ndarray, off: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, document of each piece, start of each piece and the end) of about limit bytes; long documents are cut after white space."""
    i, n = 0, len(off) - 1
    while i < n:
        if off[i + 1] - off[i] > limit:
            at, end = int(off[i]), int(off[i + 1])
            while at < end:
                stop = min(at + limit, end)
                while stop < end:
                    gaps = np.flatnonzero(SPACE[data[at:stop]])
                    if len(gaps):
                        stop = at + int(gaps[-1]) + 1
                        break
                    stop = min(stop + limit, end)
                yield data[at:stop], np.array([i]), np.array([0, stop - at])
                at = stop
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield data[off[i] : off[j]], np.arange(i, j), off[i : j + 1] - off[i]
        i = j


def runs(member: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross bounds."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(member) + 1, bool)
    edge[0], edge[-1] = member[0], member[-1]
    np.not_equal(member[1:], member[:-1], out=edge[1:-1])
    inner = np.unique(bounds[(bounds > 0) & (bounds < len(member))])
    both = inner[member[inner] & member[inner - 1]]
    at = np.flatnonzero(edge)
    if len(both):
        at = np.sort(np.concatenate([at, both, both]))
    return at[0::2], at[1::2]


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[starts:ends]."""
    n = len(buf)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[buf] * powers(_M, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(_MINV, n + 1)[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def word_hashes(texts: pa.Array, member: np.ndarray = WORDS, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word of a string column, and each document's first word (and the end)."""
    data, off = raw(texts)
    n = len(off) - 1
    counts, out = np.zeros(n, np.int64), []
    for buf, docs, at in segments(data, off):
        low = LOWER[buf] if lower else buf
        s, e = runs(member[buf], at)
        out.append(run_hashes(low, s, e))
        counts[docs] += np.diff(np.searchsorted(s, at))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])
