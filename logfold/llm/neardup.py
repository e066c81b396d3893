"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF word shingles.

Equal texts form a class, named by their MD5 digest. A text's elements are its shingles of five words (a text of one
to four words is one shingle), weighted by their count times an inverse document frequency. SAMPLES consistent weighted
samples are cut into bands; classes that share a band are candidates, and a pair is linked where its weighted Jaccard
similarity, computed from the whole texts, is at least 0.8. Groups are the links' components.

The inverse document frequency is 1 up to the share FREQUENT of all documents and falls from there to about a half for a
shingle that every document has: text that many documents share weighs less, but a large group of near copies doesn't
lose its links for its own size. Counts are exact, whatever the partitions. What over FREQUENT of all documents have, over
FREQUENT have in some chunk of a task: a first pass names these shingles, a second one adds up their documents everywhere.
If they are more than CANDIDATES, all shingles are added up instead. Sums meet by the first bits of a shingle's hash.

Not all pairs of a bucket are compared. First each class meets its bucket's smallest one. Then classes of buckets that
aren't connected yet get SKETCH further samples. A spanning forest of each bucket's most alike groups is verified, and
at last every pair of a bucket that is still apart, unless its sketches agree in less than LEAST_AGREEMENT: of pairs at
0.8, one in a million does. Pairs are weighed inside a bucket, in blocks of BLOCK classes, and only such pairs leave it,
from one of the buckets they share. A bucket of m classes that stay apart costs m * m / 2 comparisons of sketches.

Null texts and null ids are never duplicates. Empty texts are equal to one another, and texts without words have no
other links. Texts of any length are sampled and compared whole. Repeated rows are copies; different texts with one id
are different documents. Ids must be integers. Of other columns only the id is kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove, table
from .textbuf import slices, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 5, 20
SAMPLES, SKETCH = ROWS * BANDS, 400
LEAST_AGREEMENT = 0.72
BLOCK = 512
#: Share of the documents up to which a shingle weighs fully.
FREQUENT = 0.05
#: Shingles that a task holds before it adds them up and hands them on.
HELD = 1 << 22
#: Shingles up to which only those that may be frequent are counted; from there on all are.
CANDIDATES = 1 << 20
#: Pairs of one centre that are compared in one place.
CHUNK = 256
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _words(salt: int, n: int) -> list[np.uint32]:
    return [np.uint32(x | 1) for x in np.random.Generator(np.random.PCG64(salt)).integers(0, 1 << 32, n, dtype=np.uint32)]


_SALTS = [_words(k, 4) for k in range(SAMPLES + SKETCH)]


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 64-bit shingle, count) of each distinct shingle, by document and shingle."""
    words, first = word_hashes(texts)
    n = np.diff(first)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    h = np.zeros(len(words), np.uint64)
    left = np.repeat(first[1:], n) - np.arange(len(words))
    for k in range(SHINGLE):
        h = np.where(left > k, (h ^ padded[k : k + len(words)]) * _MIX + np.uint64(k + 1), h)
        h ^= h >> np.uint64(31)
    doc = np.repeat(np.arange(len(n)), n)
    whole = (left >= SHINGLE) | ((n[doc] < SHINGLE) & (left == n[doc]))
    doc, h = doc[whole], h[whole]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.empty(len(h), bool)
    new[:1] = True
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


class Weights:
    """Weight of a shingle: its count times the inverse document frequency."""

    def __init__(self, docs: int, h: np.ndarray, df: np.ndarray):
        order = np.argsort(h)
        self.h = h[order]
        self.idf = np.minimum(1, np.log1p(docs / np.maximum(df[order], 1)) / np.log1p(1 / FREQUENT)) ** 0.5

    def __call__(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = count.astype(np.float64)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            own = self.h[at] == h
            w[own] *= self.idf[at[own]]
        return w


def _pieces(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of values between the ends, as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _added_up(batches: Iterator[pa.RecordBatch], size: int, only: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(documents, h, n) of about size shingles at a time, of those in the sorted `only` if given: n of the documents have h."""
    held, docs, have = [], 0, 0

    def summed():
        h = np.concatenate(held)
        h.sort()
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))[: len(h)]
        return docs, h[at], np.diff(np.append(at, len(h)))

    for b in batches:
        for part in slices(b, 0):
            h = shingles(part.column(0))[1]
            if only is not None:
                h = h[only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h]
            held.append(h)
            docs, have = docs + part.num_rows, have + len(h)
            if have >= size:
                yield summed()
                held, docs, have = [], 0, 0
    if held:
        yield summed()


def _candidates(size: int, share: float):
    """The shingles that more than the share of the documents have in any chunk of about size shingles: all that have it in the whole are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, h, n in _added_up(batches, size):
            h = h[n > share * docs * (1 - 1e-9)].view(np.int64)  # rounding loses none
            for lo in range(0, len(h), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + (1 << 17)])], names=["h"])

    return run


def _count_shingles(size: int, only=None):
    """(part, h, n) of all shingles, or of the broadcast ones, added up over about size at a time: n documents have them. part is their first 16 bits, h holds the other 48."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, u, count in _added_up(batches, size, only.value if only else None):
            for lo in range(0, len(u), 1 << 20):
                h, n = u[lo : lo + (1 << 20)], count[lo : lo + (1 << 20)].astype(np.uint32)
                part = (h >> np.uint64(48)).astype(np.int32)
                at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                ends = np.append(at, len(h))
                yield pa.RecordBatch.from_arrays([pa.array(part[at]), _pieces(h.view(np.uint8).reshape(-1, 8)[:, :6], ends * 6), _pieces(n, ends * 4)], names=["part", "h", "n"])

    return run


def _frequent(least: float):
    """(h, n) of the shingles that more than `least` documents have; the rows (part, h, n) come by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches, ["part"]):
            n = np.frombuffer(b"".join(block.column("n").to_pylist()), np.uint32).astype(np.int64)
            h = np.zeros((len(n), 8), np.uint8)
            h[:, :6] = np.frombuffer(b"".join(block.column("h").to_pylist()), np.uint8).reshape(-1, 6)
            h = h.view(np.uint64)[:, 0]
            order = np.argsort(h)
            h, n = h[order], n[order]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n = np.add.reduceat(n, at)
            h = h[at[n > least]] | np.uint64(block.column("part")[0].as_py() << 48)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n[n > least])], names=["h", "n"])

    return run


def frequencies(texts: DataFrame) -> Weights:
    """Weights from the exact document frequencies over all rows of the one text column.

    What comes to the driver are shingles of over FREQUENT of the documents: at most 1 / FREQUENT times the mean number of shingles a document."""
    docs = texts.count()
    found = materialise(texts.mapInArrow(_candidates(HELD, FREQUENT), "h long").distinct(), "candidates")
    only = None
    if found.count() <= CANDIDATES:
        only = np.sort(found.toArrow().column("h").to_numpy().view(np.uint64))
    remove(found)
    if only is not None and not len(only):
        return Weights(docs, only, np.zeros(0, np.int64))
    only = None if only is None else texts.sparkSession.sparkContext.broadcast(only)
    counts = texts.mapInArrow(_count_shingles(HELD, only), "part int, h binary, n binary").repartition("part").sortWithinPartitions("part")
    often = counts.mapInArrow(_frequent(FREQUENT * docs), "h long, n long").toArrow()
    return Weights(docs, often.column("h").to_numpy().view(np.uint64), often.column("n").to_numpy())


def _hash(h: np.ndarray, more: np.ndarray, salt: list[np.uint32], out: np.ndarray, y: np.ndarray) -> None:
    """A 32-bit hash of two words for a salt."""
    np.multiply(h, salt[0], out=out)
    np.add(out, more, out=out)
    for shift, factor in ((16, salt[1]), (13, salt[2])):
        np.right_shift(out, np.uint32(shift), out=y)
        np.bitwise_xor(out, y, out=out)
        np.multiply(out, factor, out=out)
    np.right_shift(out, np.uint32(16), out=y)
    np.bitwise_xor(out, y, out=out)


def _log_product(x: np.ndarray, y: np.ndarray, f: np.ndarray, out: np.ndarray) -> None:
    """out = -ln(u v) for the two uniform numbers of 16 bits, odd ones only, in x: a Gamma(2, 1) variable."""
    np.bitwise_or(x, np.uint32(0x00010001), out=y)
    np.right_shift(y, np.uint32(16), out=x)
    np.bitwise_and(y, np.uint32(0xFFFF), out=y)
    np.copyto(out, x, casting="unsafe")
    np.copyto(f, y, casting="unsafe")
    out *= f
    np.log(out, out=out)
    np.subtract(np.float32(32 * np.log(2)), out, out=out)


def samples(doc: np.ndarray, h: np.ndarray, w: np.ndarray, salts: list = _SALTS[:SAMPLES], step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have elements, a consistent weighted sample for each salt). doc is sorted.

    With r and c from Gamma(2, 1) and b uniform, all hashed from the element, t = floor(ln w / r + b), and the sample is
    the (element, t) of least ln c - r (t - b + 1). Elements of weight 1, nearly all, have t = 0."""
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))[: len(doc)]
    out = np.empty((len(at), len(salts)), np.uint64)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + step, "right")) - 1)
        hi = len(at) if hi >= len(at) or (len(doc) - at[lo]) <= step else hi
        a, b = at[lo], at[hi] if hi < len(at) else len(doc)
        hs, start, n = h[a:b], at[lo:hi] - a, b - a
        size = np.diff(np.append(start, n))
        low, high = (hs & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hs >> np.uint64(32)).astype(np.uint32)
        heavy = np.flatnonzero(w[a:b] != 1)
        lw, t_of = np.log(w[a:b][heavy]).astype(np.float32), np.zeros(n, np.int64)
        x, y, z = (np.empty(n, np.uint32) for _ in range(3))
        f, r, c, beta = (np.empty(n, np.float32) for _ in range(4))
        for k, salt in enumerate(salts):
            _hash(low, high, salt, x, y)
            np.multiply(x, salt[1], out=y)
            np.right_shift(y, np.uint32(8), out=y)
            np.copyto(beta, y, casting="unsafe")
            beta *= np.float32(2**-24)
            np.multiply(x, salt[3], out=y)
            np.right_shift(y, np.uint32(15), out=z)
            np.bitwise_xor(y, z, out=z)
            _log_product(x, y, f, r)
            _log_product(z, y, f, c)
            np.log(c, out=c)
            if len(heavy):
                t = np.floor(lw / r[heavy] + beta[heavy])
                t_of[heavy] = t
                beta[heavy] -= t
            beta -= np.float32(1)
            beta *= r
            c += beta
            hit = np.flatnonzero(c == np.repeat(np.minimum.reduceat(c, start), size))
            if len(hit) > hi - lo:
                owner = np.searchsorted(start, hit, "right")
                hit = hit[np.append(True, owner[1:] != owner[:-1])]
            out[lo:hi, k] = (hs[hit] ^ (t_of[hit].view(np.uint64) * _MIX)) * _MIX
        lo = hi
    return doc[at], out


def _sample_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for b in batches:
            for part in slices(b, 2):
                doc, h, count = shingles(part.column(2))
                which, sig = samples(doc, h, weights(h, count))
                keys = np.zeros((part.num_rows, BANDS), np.uint64)
                for r in range(ROWS):
                    keys[which] = (keys[which] ^ sig[:, r::ROWS]) * _MIX
                    keys[which] ^= keys[which] >> np.uint64(30)
                worded = np.zeros(part.num_rows, bool)
                worded[which] = True
                size = np.concatenate([[0], np.cumsum(worded * BANDS)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(size), pa.array(keys[worded].view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), bands], names=["id", "digest", "bands"])

    return run


def _sketches(model):
    """400 further samples of each text, reduced to a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for b in batches:
            for part in slices(b, 1):
                doc, h, count = shingles(part.column(1))
                which, sig = samples(doc, h, weights(h, count), _SALTS[SAMPLES:])
                small = (sig >> np.uint64(40)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), pa.array([r.tobytes() for r in small], pa.binary())], names=["v", "sketch"])

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two (sorted elements, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least)) if len(a[0]) and len(b[0]) else 0.0


def _verify(model, threshold: float):
    """Of rows (c, salt, v, text) by c and salt, the centre's own (v null) first: the linked (a, b)."""

    def linked(c, v, texts, weights) -> pa.RecordBatch:
        doc, h, count = shingles(texts)
        w = weights(h, count)
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        total = np.bincount(doc, w, len(texts))
        similar = np.zeros(len(texts), bool)
        centres = np.flatnonzero(v.is_null().to_numpy(zero_copy_only=False))
        for own, end in zip(centres.tolist(), [*centres[1:].tolist(), len(texts)], strict=True):
            hc, wc = h[cut[own] : cut[own + 1]], w[cut[own] : cut[own + 1]]
            lo, hi = cut[own + 1], cut[end]
            if not len(hc) or lo == hi:
                continue
            at = np.minimum(np.searchsorted(hc, h[lo:hi]), len(hc) - 1)
            common = np.where(hc[at] == h[lo:hi], np.minimum(w[lo:hi], wc[at]), 0.0)
            least = np.bincount(doc[lo:hi] - own, common, end - own)
            similar[own:end] = least >= threshold * (total[own] + total[own:end] - least)
            similar[own] = False
        keep = pa.array(similar)
        return pa.RecordBatch.from_arrays([c.filter(keep), v.filter(keep)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, centre = model.value, None
        for b in batches:
            for part in slices(b, 3, 2048):
                if centre is not None:
                    part = pa.concat_batches([centre, part])
                yield linked(part.column(0), part.column(2), part.column(3), weights)
                # The group of the last row may go on: its centre leads the next part.
                last = np.flatnonzero(part.column(2).is_null().to_numpy(zero_copy_only=False))[-1:]
                centre = part.slice(int(last[0]), 1) if len(last) else None

    return run


def verified(pairs: DataFrame, texts: DataFrame, model, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar. Each text goes to the centres it meets; a centre's pairs are dealt out in chunks of about CHUNK."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(sizes, "a").select(F.col("a").alias("c"), F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).alias("salt"), F.col("b").alias("v"))
    dealt = materialise(dealt, "dealt")
    wanted = dealt.select("c", "salt", "v", F.col("v").alias("of")).unionByName(dealt.select("c", "salt", F.lit(None).cast("binary").alias("v"), F.col("c").alias("of")).distinct())
    rows = wanted.join(texts.withColumnRenamed("v", "of"), "of").select("c", "salt", "v", "text")
    rows = rows.repartition("c", "salt").sortWithinPartitions("c", "salt", F.col("v").isNotNull())
    out = materialise(rows.mapInArrow(_verify(model, threshold), "a binary, b binary"), "links")
    remove(dealt)
    return out


def _blocks_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one value of the named columns after another; they come sorted."""
    held, last = [], None
    for b in batches:
        keys = np.stack([b.column(n).to_numpy() for n in names])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            if lo == hi:
                continue
            key = tuple(keys[:, lo].tolist())
            if key != last and held:
                yield pa.concat_batches(held)
                held = []
            last = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.concat_batches(held)


def _forest(share: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all groups that a share of LEAST_AGREEMENT or more can connect: in turns, each group's most alike pair. share is symmetric."""
    group, ends = group.copy(), []
    while True:
        apart = np.where(group[:, None] != group[None, :], share, -1)
        to = apart.argmax(1)
        best = apart[np.arange(len(to)), to]
        order = np.lexsort((-best, group))
        first = order[np.append(True, group[order][1:] != group[order][:-1])]
        first = first[best[first] >= LEAST_AGREEMENT]
        if not len(first):
            return tuple(np.concatenate(e) if e else np.zeros(0, np.int64) for e in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int64),) * 2
        ends.append((first, to[first]))
        for x, y in zip(first.tolist(), to[first].tolist(), strict=True):
            group[group == group[y]] = group[x]


def _near_in_blocks(forest: bool):
    """Pairs (a, b) of different groups whose sketches agree enough: a spanning forest of the groups, or all pairs that meet in this bucket first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches, ["key", "i", "j"]):
            n = block.num_rows
            group = np.unique(block.column("group").to_numpy(zero_copy_only=False), return_inverse=True)[1]
            if n < 2 or not group.any():
                continue
            side = block.column("side").to_numpy()
            sketch = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(n, SKETCH)
            bands = block.column("bands").flatten().to_numpy().reshape(n, BANDS)
            mine = (bands == block.column("key")[0].as_py()).argmax(1)  # keys hold their band's number, so they are equal in one place only
            share = np.empty((n, n), np.float32)
            for x in range(n):
                share[x] = (sketch == sketch[x]).mean(1)
            share = (share - 1 / 256) * (256 / 255)
            # Side 0 meets itself, side 1 meets side 2.
            share[(group[:, None] == group[None, :]) | ((side[:, None] > 0) & (side[:, None] == side[None, :]))] = -1
            if forest:
                x, y = _forest(share, group)
            else:
                x, y = np.nonzero(np.triu(share >= LEAST_AGREEMENT))
                fresh = np.empty(len(x), bool)
                for lo in range(0, len(x), 20_000):
                    i, j = x[lo : lo + 20_000], y[lo : lo + 20_000]
                    fresh[lo : lo + 20_000] = ~((bands[i] == bands[j]) & (np.arange(BANDS) < mine[i][:, None])).any(1)
                x, y = x[fresh], y[fresh]
            if len(x):
                v = block.column("v").to_pylist()
                ends = [sorted((v[i], v[j])) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


def _apart(members: DataFrame, group: DataFrame) -> DataFrame:
    """(key, v, group) of the buckets that hold more than one group."""
    named = members.join(group, "v", "left").select("key", "v", F.coalesce("group", "v").alias("group"))
    open_ = named.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("key")
    return named.join(open_, "key")


def _meeting(open_: DataFrame, marks: DataFrame, forest: bool) -> DataFrame:
    """Candidate pairs of open buckets (key, v, group). A bucket of over BLOCK classes is cut into blocks that meet two by two."""
    sizes = open_.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = open_.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "v", "group")
    rows = dealt.join(marks, "v").select("key", "i", "j", "side", "v", "group", "bands", "sketch")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "v")
    return rows.mapInArrow(_near_in_blocks(forest), "a binary, b binary").distinct()


def groups_of(docs: DataFrame, sampled: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """(v, group) of the digests that have a similar text. docs has (id, digest, text), sampled (id, digest, bands)."""
    worded = sampled.where(F.col("digest").isNotNull() & (F.size("bands") > 0))
    classes = materialise(worded.groupBy(F.col("digest").alias("v")).agg(F.min("id").alias("id"), F.min("bands").alias("bands")), "classes")
    members = classes.select("v", F.posexplode("bands").alias("band", "key")).select("v", F.xxhash64("band", "key").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least")).where("n > 1").select("key", "least")
    members = materialise(members.join(sizes, "key"), "members")
    # One text of each class that has a candidate, by its class and smallest id: copies don't meet in one task.
    one = classes.join(members.select("v").distinct(), "v", "left_semi").select(F.col("v").alias("digest"), "id")
    texts = docs.join(one, ["digest", "id"], "left_semi").dropDuplicates(["digest", "id"])
    texts = materialise(texts.select(F.col("digest").alias("v"), "text"), "texts")
    pairs = members.where("v <> least").select(F.col("least").alias("a"), F.col("v").alias("b")).distinct()
    group = components(verified(pairs, texts, model, threshold))
    open_ = materialise(_apart(members.select("key", "v"), group), "open")
    remove(members)
    if not open_.isEmpty():
        apart = open_.select("v").distinct()
        sketches = texts.join(apart, "v", "left_semi").select("v", "text").mapInArrow(_sketches(model), "v binary, sketch binary")
        marks = materialise(sketches.join(classes.select("v", F.transform("bands", lambda k, i: F.xxhash64(i, k)).alias("bands")), "v"), "marks")
        group = joined(group, verified(_meeting(open_, marks, True), texts, model, threshold))
        left = materialise(_apart(open_.select("key", "v"), group), "left")
        group = joined(group, verified(_meeting(left, marks, False), texts, model, threshold))
        remove(left, marks)
    remove(open_, texts, classes)
    return group


def components(edges: DataFrame) -> DataFrame:
    """(v, group) of every vertex of the edges (a, b); group is the component's smallest vertex.

    Each round every vertex points to its neighbour of most neighbours (ties by hash), unless it comes first itself,
    and edges are rewritten to what their ends point to, so a star goes in one round; the pointers are composed."""
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    pointers, tables, turn = [], [edges], 0
    whole = edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().select("v", F.col("v").alias("at"))
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("to")).union(edges.select("b", "a"))
        rank = both.groupBy(F.col("v").alias("to")).agg((-F.count("*")).alias("n")).select("to", F.struct("n", F.xxhash64(F.lit(turn), "to").alias("h"), F.col("to").alias("p")).alias("rank"))
        point = both.join(rank, "to").groupBy("v").agg(F.min("rank").alias("m")).join(rank.select(F.col("to").alias("v"), "rank"), "v")
        point = materialise(point.select("v", F.least("m", "rank")["p"].alias("p")), "pointers")
        moved = edges.join(point.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(point.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        edges = materialise(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        pointers.append(point)
        tables.append(edges)
        turn += 1
    for point in pointers:
        whole = whole.join(point.select(F.col("v").alias("at"), "p"), "at", "left").select("v", F.coalesce("p", "at").alias("at"))
    whole = materialise(whole, "points")
    least = whole.groupBy("at").agg(F.min("v").alias("group"))
    out = materialise(whole.join(least, "at").select("v", "group"), "components")
    remove(whole, *tables, *pointers)
    return out


def joined(group: DataFrame, links: DataFrame) -> DataFrame:
    """The components (v, group) when further links (a, b) are added; only the groups' own graph is walked."""
    of = lambda k: group.select(F.col("v").alias(k), F.col("group").alias(f"g{k}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b"))
    more = components(ends.where("a <> b")).select(F.col("v").alias("group"), F.col("group").alias("to"))
    known = group.join(more, "group", "left").select("v", F.coalesce("to", "group").alias("group"))
    return materialise(known.unionByName(more.select(F.col("group").alias("v"), F.col("to").alias("group")).join(group.select("v"), "v", "left_anti")), "components")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id, copy_id (smallest id with an equal text), class_id (smallest id of the group), digest and class_digest.

    The digests are the MD5 of the text and of the text that stands for the group: that of class_id, the smaller digest if it has several."""
    digest = F.when(F.col("id").isNotNull() & F.col("text").isNotNull(), F.unhex(F.md5("text")))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select("id", digest.alias("digest"), "text")
    weights = frequencies(docs.select("text"))
    model = df.sparkSession.sparkContext.broadcast(weights)
    sampled = materialise(docs.mapInArrow(_sample_batches(model), "id long, digest binary, bands array<long>"), "sampled")
    group = groups_of(docs.where("digest is not null"), sampled, model, threshold)
    classes = sampled.where("digest is not null").groupBy("digest").agg(F.min("id").alias("copy_id"))
    named = classes.join(group.withColumnRenamed("v", "digest"), "digest", "left").select("digest", "copy_id", F.coalesce("group", "digest").alias("group"))
    stands = named.groupBy("group").agg(F.min(F.struct("copy_id", "digest")).alias("first"))
    named = named.join(stands, "group").select("digest", "copy_id", F.col("first.copy_id").alias("class_id"), F.col("first.digest").alias("class_digest"))
    out = sampled.select("id", "digest").join(named, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("copy_id", "id").alias("copy_id"), F.coalesce("class_id", "id").alias("class_id"), F.hex("digest").alias("digest"), F.hex("class_digest").alias("class_digest"))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "copy_id", "class_id")
