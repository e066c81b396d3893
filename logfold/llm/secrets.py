"""Secret scans: fixed patterns plus strings that a dictionary-primed compressor can't predict.

Method: every long token near a sensitive word, before or after it, is a candidate. Its cost is the growth of the
zstandard frame when it is appended to the text on both sides of it. The frame is primed with a dictionary trained on
identifiers of code and on the table's own: one pass counts the words of 4 to 16 letters within AROUND characters of
sensitive words, by documents, and the MOST_WORDS most frequent are taken (ties by the word). Texts are compressed in a
plain form, words in lower case and parted where letters' case or kind changes, so names made of words cost little, and
random characters cost what they are. Full UUIDs name things and are no candidates.

Candidates have any length: a long one is weighed in pieces of PIECE characters and reported from the first costly
piece to the last. A candidate that only a few separators part from one near a sensitive word counts as near it too,
as the parts of a token and the lines of a key block do. A candidate that the text before it holds already costs little;
repeats of it in the text behind it are left out.

Null and empty texts have no findings; texts of any length are scanned whole; rows are independent but for the
dictionary, so repeated rows and ties give equal results; other columns pass through, and one named as the output is
replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

HINTS = re.compile(r"(?:key|secret|token|passw|passphrase|credential|bearer|authorization|signature|private|session|cookie|salt)", re.I | re.A)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
#: What may part two candidates of one secret, and the short last line of a key block.
PARTED, LAST_LINE = re.compile(r"[^A-Za-z0-9]{0,8}"), re.compile(r"\s{1,8}[A-Za-z0-9+/=]{1,19}(?=\s{1,8}-----END)")
PIECE, LEAST = 200, 20
#: Characters between a candidate and a sensitive word, and of the text around that is weighed; bytes a character from which a candidate is reported.
REACH, AROUND, LEAST_COST = 64, 256, 0.72
#: Words of the table in the dictionary, and the dictionary's bytes.
MOST_WORDS, DICTIONARY = 4000, 32_768
#: Prior content for the compressor: frequent identifiers of code and configuration.
IDENTIFIERS = """
abstract access account action address alias allow api append application args array assert async attribute auth
authorization await backend base64 batch begin boolean branch buffer build bucket bytes cache callback certificate
channel char class client cluster column command commit config connection const constructor container content
context cookie count create credential cursor data database date debug decode default define delete deploy digest
disable domain double driver element else enable encode endpoint enum environment error event example except
export extends false field file filter final float format function generate global group handler hash header host
http https identifier image import include index init input instance int integer interface internal invalid
issuer iterator java json key lambda language length library license list load local lock logger login long map
master match message metadata method model module name namespace network null number object offset option order
output package page parameter parse password path pattern payload permission policy port prefix private process
profile project property protected protocol provider proxy public python query queue random range read record
region register release remote request reset resource response result return role root route runtime schema
""".split()

SPAN = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("cost", DoubleType())]))


_CUT = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|[_/+=.-]+")
_WORD = re.compile(r"[a-z]{4,16}")


def plain(text: str) -> bytes:
    """The form that is compressed: lower case, words parted by spaces."""
    return _CUT.sub(" ", text).lower().encode("utf-8", "replace")


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents) of the words near sensitive words."""
    counts: Counter = Counter()
    out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
    for b in batches:
        for text in b.column(0):
            text, words, at = text.as_py(), set(), 0
            for h in HINTS.finditer(text or ""):
                lo, hi = max(at, h.start() - AROUND), h.end() + AROUND
                if hi > at:
                    words.update(_WORD.findall(plain(text[lo:hi]).decode()))
                    at = hi
            counts.update(words)
        if len(counts) > 200_000:
            yield out()
            counts.clear()
    if counts:
        yield out()


def dictionary(df: DataFrame, text_col: str = "text") -> bytes:
    """The compressor's dictionary, trained on IDENTIFIERS and the MOST_WORDS words that most documents have near sensitive words."""
    counts = df.select(F.col(text_col).alias("text")).mapInArrow(_near_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return trained([r.word for r in counts.orderBy(F.desc("n"), "word").limit(MOST_WORDS).collect()])


@cache
def _fixed() -> bytes:
    return trained([])


def trained(words: list[str]) -> bytes:
    known = [*IDENTIFIERS, *sorted(set(words) - set(IDENTIFIERS))]
    samples = [" ".join(known[i : i + 8]).encode() for i in range(0, len(known), 4)] * 2
    return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()


@cache
def _compressor(prior: bytes):
    return zstandard.ZstdCompressor(level=12, dict_data=zstandard.ZstdCompressionDict(prior), write_content_size=False, write_checksum=False, write_dict_id=False)


def marginal_cost(context: str, candidate: str, prior: bytes | None = None) -> float:
    """Compressed bytes that candidate adds to context, for each of its characters."""
    c, around = _compressor(prior or _fixed()), plain(context)
    return (len(c.compress(around + b" " + plain(candidate))) - len(c.compress(around))) / max(1, len(candidate))


def _costly(context: str, text: str, start: int, end: int, least_cost: float, prior: bytes | None) -> list[tuple[int, int, float]]:
    """(start, end, cost) of the costly pieces of a candidate; a rest of under LEAST characters belongs to the piece before."""
    cuts = [*range(start, max(start + 1, end - LEAST + 1), PIECE), end]
    costs = [(a, b, marginal_cost(context, text[a:b], prior)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [c for c in costs if c[2] >= least_cost]


def _mixed(token: str) -> bool:
    """Whether a token can be a key by its characters: two kinds of lower case, upper case and digits, or 24 letters; no UUID."""
    kinds = [any(map(k, token)) for k in (str.islower, str.isupper, str.isdigit)]
    letters = sum(map(str.isalpha, token))
    return letters + sum(map(str.isdigit, token)) >= 16 and (sum(kinds) > 1 or letters >= 24) and not UUID.fullmatch(token)


def find(text: str | None, prior: bytes | None = None, reach: int = REACH, around: int = AROUND, least_cost: float = LEAST_COST) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, cost) in code points, by start and then kind; base kinds have cost 1. prior is a dictionary, by default of IDENTIFIERS only."""
    if not text:
        return []
    low, found = text.lower(), []
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [("assign", m.start(), m.end(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end(), 1.0) for m in HEX.finditer(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    starts, reached = [s for s, _ in taken], []  # the furthest end of the spans up to each
    for _, e in taken:
        reached.append(max(e, reached[-1] if reached else 0))
    hints = [h.span() for h in HINTS.finditer(text)]
    first, last = [s for s, _ in hints], [e for _, e in hints]
    near, chain = -1, 0  # end of the candidate before, if it was near a hint; start of the secret's first part
    for m in CANDIDATE.finditer(text) if hints else ():
        start, end = m.span()
        before, after = bisect_right(last, start), bisect_left(first, end)
        by_hint = before > 0 and start - last[before - 1] <= reach or after < len(first) and first[after] - end <= reach
        adjoins = 0 <= near and start - near <= 8 and PARTED.fullmatch(text, near, start)
        if not (by_hint or adjoins) or not _mixed(m[0]):
            continue
        # Parts of one secret are weighed after the text before it: its other parts say what characters it has.
        near, chain = end, chain if adjoins else start
        k = bisect_left(starts, end)
        if k and reached[k - 1] > start:
            near = max(end, reached[k - 1])
            continue
        context = f"{text[max(0, chain - around) : chain]} {text[end : end + around].replace(m[0], ' ')}"
        costs = _costly(context, text, start, end, least_cost, prior)
        if costs:
            tail = LAST_LINE.match(text, costs[-1][1])
            found.append(("novel", costs[0][0], tail.end() if tail else costs[-1][1], max(c for _, _, c in costs)))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def _spans(prior: bytes):
    @F.pandas_udf(SPAN)
    def secret_spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "cost"), f, strict=True)) for f in find(t, prior)] for t in texts])

    return secret_spans


def redact(text: str | None, prior: bytes | None = None) -> str | None:
    """The text with each finding replaced by its kind in brackets; overlapping findings are replaced as one."""
    parts, at = [], 0
    for kind, start, end, _ in find(text, prior):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


def scan_secrets(df: DataFrame, text_col: str = "text", out_col: str = "findings", prior: bytes | None = None) -> DataFrame:
    """df with its findings: an array of (kind, start, end, cost), by start and kind, in code points. The dictionary is df's own unless one is given."""
    return df.withColumn(out_col, _spans(prior or dictionary(df, text_col))(F.col(text_col)))


def redact_secrets(df: DataFrame, text_col: str = "text", prior: bytes | None = None) -> DataFrame:
    """df with each secret in text_col replaced by its kind; rows without secrets stay as they are."""
    prior = prior or dictionary(df, text_col)

    @F.pandas_udf(StringType())
    def redacted(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, prior) for t in texts], dtype=object)

    return df.withColumn(text_col, redacted(F.col(text_col)))


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(F.filter("findings", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"), of("novel").alias("n_novel"),
    )
