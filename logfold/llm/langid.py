"""Language identification by hierarchical discrimination.

A text's features are hashed byte n-grams (2 to 4) of its lower-cased letters. One linear support vector machine for
each family, one against the rest, chooses the family; within it, one machine for each pair of its languages votes,
and ties go to the larger sum of margins and then to the smaller code. Machines are fitted by squared hinge loss in
numpy on a bounded sample of MOST rows of each language; all texts are read whole when scored.

Null texts and texts without a letter are `und` with score 0. Rows with a null language are not learned from. Repeated
rows get equal results. Without training rows every result is `und`. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fold, table
from .sampling import labelled_sample
from .textbuf import raw, segments

#: Bound of the training sample: rows of each language, with their whole texts.
MOST = 1000
BITS = 12
#: Language families by ISO 639-1 code; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af fy lb yi fo",
    "romance": "es fr it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "semitic": "ar he mt am",
    "celtic": "ga gd cy br",
    "iranian": "fa ps ku tg",
    "austronesian": "id ms tl jv mi",
    "dravidian": "ta te kn ml",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def family(code: str) -> str:
    return _FAMILY.get(code.lower().split("-")[0].split("_")[0], code)


def vectors(texts: pa.Array) -> np.ndarray:
    """Root frequencies of hashed n-grams, of length 1 for each text that has some."""
    data, off = raw(texts)
    n = len(off) - 1
    out = np.zeros((n, 1 << BITS), np.float32)
    for buf, docs, at in segments(data, off):
        c = _FOLD[buf]
        piece = np.repeat(np.arange(len(docs)), np.diff(at))
        left = at[1:][piece] - np.arange(len(buf))
        counts = np.zeros(len(docs) << BITS, np.int64)
        h = c.copy()
        for k in (1, 2, 3):
            h = h[:-1] * np.uint32(0x9E3779B1) + c[k:]
            whole = (left[: len(h)] > k) & ~((c[: len(h)] == 32) & (c[1 : len(h) + 1] == 32))
            x = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
            counts += np.bincount((piece[: len(h)][whole] << BITS) + x[whole], minlength=len(counts))
        np.add.at(out, docs, counts.reshape(len(docs), -1).astype(np.float32))
    out = np.sqrt(out)
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    data, off = raw(texts)
    total = np.concatenate([[0], np.cumsum(_ASCII[data])])
    out = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(map(str.isalpha, data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def svm(x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear machine by squared hinge loss, the classes weighing alike; y is 1 or -1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, m, v = np.zeros((3, x.shape[1] + 1), np.float32)
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])).astype(np.float32)
        g = -2 * share * slack * y
        d = np.append(g @ x, g.sum()).astype(np.float32) + decay * w
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        w = w - np.float32(rate) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + np.float32(1e-8))
    return w


class Hierarchy:
    def __init__(self, x: np.ndarray, codes: np.ndarray):
        self.codes = sorted(set(codes.tolist()))
        self.families = sorted({family(c) for c in self.codes})
        of = np.array([family(c) for c in codes.tolist()])
        self.members = [[c for c in self.codes if family(c) == f] for f in self.families]
        self.pairs = [list(combinations(m, 2)) for m in self.members]
        columns = [svm(x, np.where(of == f, 1, -1).astype(np.float32)) if len(self.families) > 1 else np.append(np.zeros(x.shape[1]), 1.0) for f in self.families]
        for pairs in self.pairs:
            for a, b in pairs:
                own = (codes == a) | (codes == b)
                columns.append(svm(x[own], np.where(codes[own] == a, 1, -1).astype(np.float32)))
        self.w = np.array(columns, np.float32).T if columns else np.zeros(((1 << BITS) + 1, 0), np.float32)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        names, conf = np.full(n, "und", object), np.zeros(n)
        if not self.codes:
            return names, conf
        z = vectors(texts) @ self.w[:-1] + self.w[-1]
        sig = lambda m: 1 / (1 + np.exp(-3 * np.clip(m, -50, 50)))
        best = z[:, : len(self.families)].argmax(1)
        at = len(self.families)
        for f, (members, pairs) in enumerate(zip(self.members, self.pairs, strict=True)):
            rows = np.flatnonzero(best == f)
            margins = z[rows, at : at + len(pairs)]
            at += len(pairs)
            votes, sums = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for k, (a, b) in enumerate(pairs):
                for c, m in ((a, margins[:, k]), (b, -margins[:, k])):
                    votes[:, members.index(c)] += m > 0
                    sums[:, members.index(c)] += m
            pick = np.lexsort((np.broadcast_to(-np.arange(len(members)), votes.shape), sums, votes), axis=1)[:, -1] if len(rows) else np.zeros(0, int)
            names[rows] = np.array(members, object)[pick]
            least = np.full(len(rows), 50.0)
            for k, (a, b) in enumerate(pairs):
                for c, m in ((a, margins[:, k]), (b, -margins[:, k])):
                    own = pick == members.index(c)
                    least[own] = np.minimum(least[own], m[own])
            conf[rows] = sig(z[rows, f]) * sig(least)
        ok = lettered(texts)
        return np.where(ok, names, "und"), np.where(ok, conf, 0.0)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            x = vectors(part.column(1)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST) -> Hierarchy:
    """Learns from at most `most` of the rows given for each language."""
    sample = labelled_sample(docs, docs.select(id_col, lang_col), most, id_col, text_col, lang_col)
    got = sample.mapInArrow(_vectors, "label string, x binary").collect()
    x = np.array([np.frombuffer(r[1], np.float16) for r in got], np.float32).reshape(len(got), 1 << BITS)
    return Hierarchy(x, np.array([r[0] for r in got], object))


def _predict(model, at: int, out: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                names, conf = m.predict(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names.tolist(), pa.string()), pa.array(conf, pa.float64())], names=[*b.schema.names, *out])

    return run


def identify(df: DataFrame, model: Hierarchy, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with the language of each text and a score; columns of these names are replaced."""
    df = df.drop(lang_out, score_out)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*df.schema.fields, StructField(lang_out, StringType()), StructField(score_out, DoubleType())])
    return df.mapInArrow(_predict(shared, df.columns.index(text_col), (lang_out, score_out)), schema)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 5) != 0))
    got = identify(docs.select("doc_id", "text"), model).drop("text")
    return got.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
