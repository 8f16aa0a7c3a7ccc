"""Benchmark decontamination: hash set of benchmark word windows, verified.

Words are the maximal runs of ASCII letters, digits and non-ASCII characters
after lower-casing A-Z. Every ``width`` consecutive words of a benchmark item
form a window; an item with fewer words (but not none) is one window. Training
texts are scanned once: a rolling hash of every word window is looked up in
the broadcast hash set, each hit is verified against the window's words, and
all words inside a verified occurrence are hit.

Defined cases: a null or word-less text has no words and no hits; a null or
word-less item has no window; repeated documents each keep their own row;
items with the same id count once; an item without an id still marks words
but is not listed; an empty benchmark marks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

WIDTH = 13
#: Text of one broadcast block of the benchmark; a larger benchmark is
#: scanned in blocks of this size, one after the other, without a shuffle.
MAX_BLOCK_CHARS = 16_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_LUT_BITS = 18

_RESULT = ("n_words bigint, hits array<struct<first:int,last:int,start:int,end:int>>,"
           " items array<string>")


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, and the text of each word."""
    low = raw.tobytes().translate(_LOWER)
    flag = _IS_WORD[np.frombuffer(low, np.uint8)]
    edge = np.zeros(len(flag) + 1, bool)
    edge[offsets] = True
    begins, stops = flag.copy(), np.zeros(len(flag) + 1, bool)
    begins[1:] &= ~flag[:-1] | edge[1:-1]
    stops[1:] = flag
    stops[1:-1] &= ~flag[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return low, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _word_hashes(low: bytes, starts: np.ndarray, ends: np.ndarray, powers: blocks.Powers) -> np.ndarray:
    data = np.frombuffer(low, np.uint8)
    return blocks.mix(blocks.PrefixHash(data, powers).span(starts, ends))


class WindowIndex:
    """The windows of some benchmark items: hashes to find, words to verify."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        self.width = width
        exact: dict[int, dict[bytes, list[int]]] = {}
        self.names: list[str | None] = [name for name, _ in items]
        powers = blocks.Powers()
        hashes: dict[int, list[np.ndarray]] = {}
        for k, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            low, starts, ends, _ = _words(raw, np.array([0, len(raw)]))
            n = len(starts)
            if n == 0:
                continue
            length = min(n, width)
            words = [low[s:e] for s, e in zip(starts, ends)]
            table = exact.setdefault(length, {})
            for i in range(n - length + 1):
                known = table.setdefault(b" ".join(words[i:i + length]), [])
                if k not in known[-1:]:
                    known.append(k)
            found = blocks.PrefixHash(_word_hashes(low, starts, ends, powers), powers).windows(length)
            hashes.setdefault(length, []).append(blocks.mix(found))
        self.exact = exact
        self.hashes = {n: np.unique(np.concatenate(h)) for n, h in hashes.items()}

    def tables(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        out = []
        for length, known in sorted(self.hashes.items()):
            lut = np.zeros(1 << _LUT_BITS, bool)
            lut[known >> np.uint64(64 - _LUT_BITS)] = True
            out.append((length, known, lut))
        return out


def _scan_column(column: pa.Array, index: WindowIndex, tables: list, powers: blocks.Powers) -> pa.Array:
    n_words: list[np.ndarray] = []
    hit_counts: list[np.ndarray] = []
    hits: list[np.ndarray] = []
    item_counts: list[np.ndarray] = []
    items: list[str] = []
    for lo, hi, raw, offsets in blocks.byte_slices(column):
        low, starts, ends, doc = _words(raw, offsets)
        n_docs, n = hi - lo, len(starts)
        n_words.append(np.bincount(doc, minlength=n_docs))
        marks = np.zeros(n + 1, np.int64)
        found: dict[int, set[int]] = {}
        if n and tables:
            rolling = blocks.PrefixHash(_word_hashes(low, starts, ends, powers), powers)
            for length, known, lut in tables:
                h = blocks.mix(rolling.windows(length))
                at = np.flatnonzero(lut[h >> np.uint64(64 - _LUT_BITS)])
                at = at[doc[at] == doc[at + length - 1]]
                if len(at):
                    k = np.searchsorted(known, h[at])
                    at = at[known[np.minimum(k, len(known) - 1)] == h[at]]
                for i in at.tolist():
                    key = b" ".join([low[s:e] for s, e in zip(starts[i:i + length], ends[i:i + length])])
                    for item in index.exact[length].get(key, ()):
                        found.setdefault(int(doc[i]), set()).add(item)
                    if key in index.exact[length]:
                        marks[i] += 1
                        marks[i + length] -= 1
        covered = np.cumsum(marks[:-1]) > 0
        spot = np.flatnonzero(covered)
        per_doc = np.zeros(n_docs, np.int64)
        if len(spot):
            fresh = np.ones(len(spot), bool)
            fresh[1:] = (np.diff(spot) > 1) | (np.diff(doc[spot]) > 0)
            first = spot[fresh]
            last = spot[np.append(np.flatnonzero(fresh)[1:] - 1, len(spot) - 1)]
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            d = doc[first]
            base = np.searchsorted(doc, d, "left")
            origin = points[offsets[d]]
            hits.append(np.stack([first - base, last - base,
                                  points[starts[first]] - origin, points[ends[last]] - origin], 1))
            per_doc = np.bincount(d, minlength=n_docs)
        hit_counts.append(per_doc)
        named = np.zeros(n_docs, np.int64)
        for d in sorted(found):
            names = sorted({index.names[k] for k in found[d]} - {None})
            named[d] = len(names)
            items.extend(names)
        item_counts.append(named)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    table = np.concatenate(hits) if hits else np.zeros((0, 4), np.int64)
    spans = pa.StructArray.from_arrays([pa.array(table[:, j], pa.int32()) for j in range(4)],
                                       names=["first", "last", "start", "end"])
    starts_of = lambda counts: np.concatenate([[0], np.cumsum(join(counts))])
    return pa.StructArray.from_arrays(
        [pa.array(join(n_words), pa.int64()), blocks.list_array(starts_of(hit_counts), spans),
         blocks.list_array(starts_of(item_counts), pa.array(items, pa.string()))],
        names=["n_words", "hits", "items"])


def _scanner(shared):
    @F.arrow_udf(_RESULT)
    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        tables, powers = index.tables(), blocks.Powers()
        for column in columns:
            yield _scan_column(column, index, tables, powers)
    return scan.asNondeterministic()


def _blocks_of(benchmark: DataFrame, max_chars: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark in lists of at most ``max_chars`` (or one longer item)."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        n = len(row["text"] or "")
        if block and size + n > max_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += n
    if block:
        yield block


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
         max_block_chars: int = MAX_BLOCK_CHARS, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_hit, spans, items and contaminated appended.

    ``spans`` are the hit word runs as code-point ranges, ``items`` the sorted
    ids of the items found. ``contaminated``: at least a twentieth of the
    words are hit. A document column of the same name as a new one is replaced
    (give ``prefix`` to keep both).
    """
    spark = docs.sparkSession
    source = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                              F.col("text").cast("string").alias("text"))
    out, hits, items, words = docs, [], [], F.lit(0).cast("bigint")
    names = []
    for k, block in enumerate(_blocks_of(source, max_block_chars)):
        shared = spark.sparkContext.broadcast(WindowIndex(block, width))
        name = f"__scan_{k}"
        names.append(name)
        out = out.withColumn(name, _scanner(shared)(F.col("text").cast("string")))
        hits.append(F.col(f"{name}.hits"))
        items.append(F.col(f"{name}.items"))
        words = F.col(f"{name}.n_words")
    if not names:
        name = "__scan_0"
        names.append(name)
        empty = spark.sparkContext.broadcast(WindowIndex([], width))
        out = out.withColumn(name, _scanner(empty)(F.col("text").cast("string")))
        hits, items, words = [F.col(f"{name}.hits")], [F.col(f"{name}.items")], F.col(f"{name}.n_words")
    runs = F.concat(*hits) if len(hits) > 1 else hits[0]
    out = out.withColumns({
        f"{prefix}n_words": words,
        f"{prefix}n_hit": _hit_words(runs, len(hits)),
        f"{prefix}spans": F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))),
        f"{prefix}items": F.array_sort(F.array_distinct(F.concat(*items) if len(items) > 1 else items[0])),
    }).drop(*names)
    hit = F.col(f"{prefix}n_hit")
    return out.withColumn(f"{prefix}contaminated", (hit > 0) & (20 * hit >= F.col(f"{prefix}n_words")))


def _hit_words(runs: Column, n_blocks: int) -> Column:
    """Words in any run; runs of different blocks may overlap."""
    if n_blocks == 1:
        return F.aggregate(runs, F.lit(0).cast("bigint"),
                           lambda a, r: a + r["last"] - r["first"] + 1)
    words = F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["last"])))
    return F.size(F.array_distinct(words)).cast("bigint")


def digest(scanned: DataFrame) -> DataFrame:
    """The per-document summary row of a scan."""
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones, other columns untouched."""
    mark = "__contamination_"
    scanned = scan(docs, benchmark, prefix=mark, **options)
    return scanned.where(~F.col(f"{mark}contaminated")).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with every hit span cut out of the text."""
    mark = "__contamination_"
    scanned = scan(docs, benchmark, prefix=mark, **options)
    cuts = F.array_sort(F.col(f"{mark}spans"))
    text = F.col("text")
    edges = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda s: s["end"]))
    stops = F.concat(F.transform(cuts, lambda s: s["start"]), F.array(F.length(text)))
    kept = F.concat_ws("", F.zip_with(edges, stops, lambda a, b: text.substr(a + 1, F.greatest(b - a, F.lit(0)))))
    cleaned = F.when(F.size(cuts) > 0, kept).otherwise(text)
    return scanned.withColumn("text", cleaned).select(*docs.columns)
