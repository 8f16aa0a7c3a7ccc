"""Secret scan: rule matches plus sliding-window Shannon entropy.

Three rules give the base spans (an assignment to a secret-like name, an
access-key id, a long lower-case hex run). The entropy method adds spans of
kind ``entropy``: in every candidate string the Shannon entropy of each window
is kept by incremental character counts, and the candidate is reported when
its highest window reaches the threshold of its character class, unless the
allow-list suppresses it. A placeholder word takes out only its own part
between separators; what is left on either side is a candidate of its own.
Letters alone are allowed when they look like words. Base spans always stay.

Defined cases: a null text is empty and has no span; spans are code-point
ranges, end exclusive; repeated rows each keep their own result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base rules, in the order in which their kinds are listed.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

MIN_ASSIGNED, MIN_ACCESS = 6, 20
WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits per character that a window must reach, by character class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
_HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
_ALNUM = re.compile(r"[A-Za-z0-9]+")
#: Strings that are random-looking but no secrets, or not random at all.
ALLOW = (
    re.compile(r"[0-9]+"),                                        # plain numbers
    re.compile(r"[0-9]+(?:[-_/+=]+[0-9]+)*[-_/+=]*"),             # dates, phone numbers
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUIDs
)
#: Letters alone, also joined: allowed when they look like words, compound words or paths.
LETTERS = re.compile(r"[A-Za-z]+(?:[-_/+=]+[A-Za-z]+)*[-_/+=]*")
PLACEHOLDER = re.compile(r"example|placeholder|changeme|xxxxx|00000|12345", re.I)
_PART = re.compile(r"[A-Za-z0-9]+")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")  # the words of a mixed-case string
_CONSONANTS = re.compile(r"(?:sch|ch|ck|ph|sh|st|th|tz|ng|[b-df-hj-np-tv-xz])+")
_SOUND = re.compile(r"sch|ch|ck|ph|sh|st|th|tz|ng|[a-z]")
#: What words have: letters between changes of case, share of vowels, consonants in a row.
MIN_PIECE, MIN_VOWELS, MAX_VOWELS, MAX_CONSONANTS = 3, 0.25, 0.75, 5

_SPANS = "array<struct<kind:int,start:int,end:int>>"
_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, 1024)]


def window_entropy(text: str, window: int = WINDOW) -> float:
    """The highest Shannon entropy (bits per character) of any window."""
    size = min(window, len(text))
    if size == 0:
        return 0.0
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c); the entropy is log2(size) - total / size
    for c in text[:size]:
        k = counts.get(c, 0)
        total += _C_LOG_C[k + 1] - _C_LOG_C[k]
        counts[c] = k + 1
    least = total
    for old, new in zip(text, text[size:]):
        if old != new:
            k = counts[old]
            total += _C_LOG_C[k - 1] - _C_LOG_C[k]
            counts[old] = k - 1
            k = counts.get(new, 0)
            total += _C_LOG_C[k + 1] - _C_LOG_C[k]
            counts[new] = k + 1
            least = min(least, total)
    return math.log2(size) - least / size


def char_class(text: str) -> str:
    if _HEX_ONLY.fullmatch(text):
        return "hex"
    return "alnum" if _ALNUM.fullmatch(text) else "base64"


def looks_like_words(text: str) -> bool:
    """Whether letters have the case pattern and the vowels of words."""
    letters = "".join(_PART.findall(text)).lower()
    if len(letters) < MIN_PIECE * len(_PIECE.findall(text)):
        return False
    if not MIN_VOWELS <= sum(c in "aeiouy" for c in letters) / max(len(letters), 1) <= MAX_VOWELS:
        return False
    return all(len(_SOUND.findall(m[0])) <= MAX_CONSONANTS for m in _CONSONANTS.finditer(text.lower()))


def _is_random(text: str) -> bool:
    if any(rule.fullmatch(text) for rule in ALLOW):
        return False
    if LETTERS.fullmatch(text):
        parts = [text, *(part for part in _PART.findall(text) if WINDOW <= len(part) < len(text))]
        return any(not looks_like_words(part) and window_entropy(part) >= THRESHOLDS[char_class(part)] for part in parts)
    return window_entropy(text) >= THRESHOLDS[char_class(text)]


def random_spans(text: str) -> list[tuple[int, int]]:
    """What the entropy method reports of a candidate string."""
    if not PLACEHOLDER.search(text):
        return [(0, len(text))] if _is_random(text) else []
    runs, start, end = [], None, 0
    for m in _PART.finditer(text):
        if not PLACEHOLDER.search(m[0]):
            start, end = m.start() if start is None else start, m.end()
        elif start is not None:
            runs.append((start, end))
            start = None
    if start is not None:
        runs.append((start, len(text)))  # with its padding
    return [(a, b) for a, b in runs if b - a >= WINDOW and _is_random(text[a:b])]


def is_random(text: str) -> bool:
    """Whether the entropy method reports a candidate string or a part of it."""
    return bool(random_spans(text))


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """All ``(kind number, start, end)`` by start, then kind."""
    spans = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    spans += [(3, m.start() + a, m.start() + b) for m in CANDIDATE.finditer(text) for a, b in random_spans(m[0])]
    spans.sort(key=lambda s: (s[1], s[0]))
    return spans


def _find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = ["kind", "start", "end"]
    for column in columns:
        counts, rows = [0], []
        for text in column.to_pylist():
            rows += find_spans(text or "")
            counts.append(len(rows))
        parts = list(zip(*rows)) if rows else [(), (), ()]
        spans = pa.StructArray.from_arrays([pa.array(p, pa.int32()) for p in parts], names=names)
        yield pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans)


def secret_spans(text: Column) -> Column:
    """Array of ``struct(kind, start, end)``, ``kind`` an index of ``KINDS``."""
    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _find(columns)
    return F.arrow_udf(scan, _SPANS).asNondeterministic()(text.cast("string"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts by kind, the hash of its base spans, all spans."""
    found = docs.select("doc_id", secret_spans(F.col("text")).alias("found"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"),
                        count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", length_column: str | None = None) -> DataFrame:
    """``docs`` with every found span (overlaps merged) replaced by ``mask``.

    ``length_column`` names a column to hold the new text's code points.
    """
    text, cuts = F.col("text"), F.col("__cuts")
    # Overlapping spans become one: a span that starts inside an earlier one extends it.
    merged = F.aggregate(
        F.col("__found"), F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"),
                F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    edges = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda s: s["end"]))
    stops = F.concat(F.transform(cuts, lambda s: s["start"]), F.array(F.length(text)))
    kept = F.array_join(F.zip_with(edges, stops, lambda a, b: text.substr(a + 1, b - a)), mask)
    out = docs.withColumn("__found", secret_spans(text)).withColumn("__cuts", merged)
    out = out.withColumn("text", F.when(F.size(cuts) > 0, kept).otherwise(text))
    if length_column:
        out = out.withColumn(length_column, F.when(
            F.size(cuts) > 0, F.length("text").cast("bigint")).otherwise(F.col(length_column)))
    return out.select(*docs.columns)
