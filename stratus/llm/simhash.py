"""SimHash near-duplicates: word-shingle fingerprints and a binary-trie self-join.

Fingerprints that differ in at most ``max_bits`` bits are linked; components
of links are duplicate groups. Candidates are found among the *distinct*
fingerprints only (copies share one). By the pigeonhole principle a linked
pair agrees on at least one of ``max_bits + 1`` bit blocks, so every
fingerprint is dealt to one bucket per block, and inside the buckets a binary
trie is joined with itself: node pairs descend together, the differing bits
on their paths add up, and a pair is dropped when they exceed ``max_bits``.
Buckets above ``max_bucket`` fingerprints are dealt again by blocks of their
remaining bits (exact, for the same reason). A bucket gives only spanning
links of its components, never all its pairs.

Defined cases: a null, empty or blank text has fingerprint zero and links like
any other; fewer words than the shingle length give one shingle of them all;
repeated rows keep one row each; a row without doc_id takes part in linking,
but gives no component id (an all-null component has a null id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .stage import drop, staged

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Distinct fingerprints that one bucket's trie may hold before it is dealt on.
MAX_BUCKET = 200_000
#: Node pairs that the trie join expands at once.
FRONTIER = 1 << 20


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit k is set when it is set in more than half of the shingle hashes."""
    words = text.lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED)
                       for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())], np.uint64)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a signed 64-bit number."""
    def compute(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            prints = [fingerprint_of(t or b"", shingle) for t in column.cast(pa.binary()).to_pylist()]
            yield pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())
    return F.arrow_udf(compute, "bigint").asNondeterministic()(text.cast("string"))


def block_bounds(n_blocks: int, bits: int = 64) -> list[tuple[int, int]]:
    edges = [bits * k // n_blocks for k in range(n_blocks + 1)]
    return list(zip(edges, edges[1:]))


def _block_value(fp: Column, lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def trie_links(keys: np.ndarray, prints: np.ndarray, max_bits: int, frontier: int = FRONTIER) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links ``(fingerprint, least fingerprint of its group)``.

    ``keys`` names each fingerprint's bucket; only fingerprints of one bucket
    are compared. The tries are implicit: in sorted order a node is a range,
    its children are split by the next bit.
    """
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    n = len(prints)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(keys) != 0) + 1, [n]])
    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    parent = np.arange(n)
    stack = [(0, lo[many], hi[many], lo[many], hi[many], np.zeros(int(many.sum()), np.int8))]
    while stack:
        depth, a, b, c, d, err = stack.pop()
        if len(a) > frontier:  # depth first, so that open pairs stay few
            half = len(a) // 2
            stack.append((depth, a[half:], b[half:], c[half:], d[half:], err[half:]))
            a, b, c, d, err = a[:half], b[:half], c[:half], d[:half], err[:half]
        if depth == 64:
            _unite(parent, a[a != c], c[a != c])
            continue
        m1, m2 = _split(prints, a, b, depth), _split(prints, c, d, depth)
        same = a == c
        out = [  # (left, right child) of the first with those of the second node
            (a, m1, c, m2, err), (m1, b, m2, d, err),
            (a, m1, m2, d, err + 1),
            (m1[~same], b[~same], c[~same], m2[~same], err[~same] + 1)]
        parts = []
        for w, x, y, z, e in out:
            ok = (x > w) & (z > y) & (e <= max_bits) & ~((w == y) & (x - w == 1))
            parts.append((w[ok], x[ok], y[ok], z[ok], e[ok]))
        joined = [np.concatenate(p) for p in zip(*parts)]
        if len(joined[0]):
            stack.append((depth + 1, *joined))
    root = _roots(parent)
    linked = root != np.arange(n)
    return prints[linked], prints[root[linked]]


def _split(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the bit at ``depth`` (from the top) turns one in each sorted range."""
    shift = np.uint64(63 - depth)
    left, right = lo.copy(), hi.copy()
    while True:
        open_ = left < right
        if not open_.any():
            return left
        mid = (left + right) >> 1
        one = ((prints[np.minimum(mid, len(prints) - 1)] >> shift) & np.uint64(1)).astype(bool)
        right = np.where(open_ & one, mid, right)
        left = np.where(open_ & ~one, mid + 1, left)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Link the groups of x and y, each under its least member."""
    while len(x):
        parent[:] = _roots(parent)
        px, py = parent[x], parent[y]
        differ = px != py
        x, y, px, py = x[differ], y[differ], px[differ], py[differ]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))


def _bucket_links(dealt: DataFrame, max_bits: int) -> DataFrame:
    """Links inside the buckets; all rows of a bucket are in one partition."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("bucket").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if not parts:
            return
        keys = np.concatenate([k for k, _ in parts])
        prints = np.concatenate([p for _, p in parts]).view(np.uint64)
        u, v = trie_links(keys, prints, max_bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
    return dealt.repartition("bucket").mapInArrow(join, "u bigint, v bigint")


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Spanning links ``(u, v)`` of the distinct fingerprints ``prints(fp)``."""
    spans = block_bounds(max_bits + 1)
    dealt = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("block"), _block_value(F.col("fp"), lo, hi).alias("value"))
        for k, (lo, hi) in enumerate(spans)])).alias("b"))
    dealt = dealt.select("fp", "b.block", F.xxhash64("b.block", "b.value").alias("bucket"))
    sizes = dealt.groupBy("bucket").count().where(F.col("count") > max_bucket).select("bucket")
    hot = staged(sizes.withColumn("hot", F.lit(True)), "simhash-hot")
    if hot.isEmpty():
        return _bucket_links(dealt.select("bucket", "fp"), max_bits)
    # A hot bucket is dealt again: its members agree on one block, so a linked
    # pair also agrees on one of max_bits + 1 parts of the other bits.
    marked = dealt.join(hot, "bucket", "left")
    again = []
    for k, (lo, hi) in enumerate(spans):
        rest = [p for p in range(64) if not lo <= p < hi]
        for j, (x, y) in enumerate(block_bounds(max_bits + 1, len(rest))):
            mask = sum(1 << rest[p] for p in range(x, y))
            mask -= (1 << 64) * (mask >> 63)
            again.append(F.when(F.col("block") == k, F.xxhash64(
                F.col("bucket"), F.lit(j), F.col("fp").bitwiseAND(F.lit(mask)))))
    finer = F.when(F.col("hot"), F.array_compact(F.array(*again))).otherwise(F.array("bucket"))
    return _bucket_links(marked.select("fp", F.explode(finer).alias("bucket")), max_bits)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per document: doc_id, fp (long), fingerprint (hex), component_id."""
    prints = staged(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")), "simhash")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    links = near_links(distinct.select("fp"), max_bits, max_bucket)
    groups = staged(connected_components(links, "simhash-links"), "simhash-groups")
    rooted = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group.

    The document with the smallest id stays; of repeated rows of that id one
    stays. Rows without an id stay: nothing tells them apart.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    first = near_duplicates(named, **options).where("doc_id = component_id").select("doc_id").distinct()
    kept = named.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
