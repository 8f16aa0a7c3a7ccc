"""Exact top-k inner products by ball-tree branch and bound per shard.

Candidates are dealt to shards and queries to blocks, both of bounded size by
hash; every (block, shard) cell builds a ball tree over the shard and searches
it for the whole block: nodes are taken by their highest inner-product upper
bound ``q.c + |q| r``, a node is kept only for the queries whose bound reaches
their current kth score. Each block first searches one shard; the kth scores
found there are shared with its other cells as starting bounds.

Components are compared as ``floor(scale * x)``; scores are exact integers.

Defined cases: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; vectors meet only vectors of their own
dimension; repeated rows of an id and vector count once, and of several
vectors of one id the best score counts; equal scores go to the smaller id;
scores beyond 64 bits are held at its ends.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import staged

K = 20
SCALE = 64
SHARD_ROWS, BLOCK_ROWS = 16_384, 4_096
LEAF_ROWS = 64


class BallTree:
    """Balls around halves of the vectors, split at the widest dimension."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(vectors))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int]] = []
        centers, radii = [], []
        floats = vectors.astype(np.float64)
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            node = len(self.spans)
            if parent >= 0:
                pair = self.children[parent]
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            part = floats[self.order[lo:hi]]
            center = part.mean(0)
            centers.append(center)
            radii.append(np.sqrt(((part - center) ** 2).sum(1)).max())
            self.spans.append((lo, hi))
            self.children.append((-1, -1))
            if hi - lo > leaf_rows and radii[-1] > 0:
                axis = int((part.max(0) - part.min(0)).argmax())
                middle = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(part[:, axis], middle)]
                todo += [(lo, lo + middle, node, 0), (lo + middle, hi, node, 1)]
        self.centers, self.radii = np.array(centers), np.array(radii)


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products, held within 64 bits."""
    most = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (queries, vectors)]
    bound = most[0] * most[1] * max(vectors.shape[1], 1)
    if bound < 2.0 ** 53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    if bound < 2.0 ** 62:
        return queries @ vectors.T
    wide = queries.astype(object) @ vectors.astype(object).T
    return np.clip(wide, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


class _Best:
    """The k best ids of every query with their best scores, and the score to beat."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor
        self.rows = np.zeros((3, 0), np.int64)  # query, id, score
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.waiting.append(np.stack([query, ids, score]))
        self.n_waiting += len(query)
        if self.n_waiting > 4 * self.k * len(self.floor):
            self.settle()

    def settle(self) -> None:
        rows = np.concatenate([self.rows, *self.waiting], axis=1)
        rows = rows[:, np.lexsort((~rows[2], rows[1], rows[0]))]  # ~score: falling, without overflow
        again = np.zeros(rows.shape[1], bool)
        again[1:] = (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])
        rows = rows[:, ~again]  # the best row of every query and id
        rows = rows[:, np.lexsort((rows[1], ~rows[2], rows[0]))]
        rank = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0], "left")
        self.rows = rows[:, rank < self.k]
        last = rows[:, rank == self.k - 1]
        self.floor[last[0]] = np.maximum(self.floor[last[0]], last[2])
        self.waiting, self.n_waiting = [], 0


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray,
           floor: np.ndarray, k: int = K, leaf_rows: int = LEAF_ROWS) -> np.ndarray:
    """Rows ``(query position, id, score)`` that may be among the k best.

    ``floor``: a score per query that its k best are known to reach.
    """
    tree = BallTree(vectors, leaf_rows)
    q = queries.astype(np.float64)
    length = np.sqrt((q ** 2).sum(1))
    best = _Best(floor.copy(), k)

    def bounds(node: int, which: np.ndarray) -> np.ndarray:
        exact = q[which] @ tree.centers[node] + length[which] * tree.radii[node]
        # Room for rounding in the bound; a bound that is too high only costs time.
        return exact + 1e-9 * (np.abs(exact) + length[which] * (tree.radii[node] + np.abs(tree.centers[node]).sum())) + 1e-6

    everyone = np.arange(len(q))
    heap = [(-float(bounds(0, everyone).max()), 0, everyone)]
    while heap:
        _, node, which = heapq.heappop(heap)
        which = which[bounds(node, which) >= best.floor[which]]
        if not len(which):
            continue
        left, right = tree.children[node]
        if left < 0:
            lo, hi = tree.spans[node]
            rows = tree.order[lo:hi]
            score = exact_scores(queries[which], vectors[rows])
            keep = (score >= best.floor[which][:, None]) & (ids[rows][None, :] != query_ids[which][:, None])
            a, b = np.nonzero(keep)
            best.add(which[a], ids[rows][b], score[a, b])
        else:
            for child in (left, right):
                heapq.heappush(heap, (-float(bounds(child, which).max()), child, which))
    best.settle()
    return best.rows


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if rows else pa.array([], pa.int64())
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.int64).reshape(rows, -1)


def _search_cells(cells: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = np.zeros((3, 0), np.int64)
        asked = right.column("query_id").to_numpy()
        if left.num_rows and right.num_rows:
            out = search(_matrix(left.column("v"), left.num_rows), left.column("vec_id").to_numpy(),
                         _matrix(right.column("q"), right.num_rows), asked, right.column("floor").to_numpy().copy(), k)
        return pa.table([pa.array(asked[out[0]], pa.int64()), pa.array(out[1]), pa.array(out[2])],
                        names=["query_id", "vec_id", "score"])
    by = ["dim", "block", "shard"]
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # columns of its own: both sides have one origin
    return cells.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(
        cell, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE,
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors of every query.

    ``vectors`` has vec_id and embedding; ``is_query`` marks the query rows.
    """
    ints = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    base = (vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", is_query.alias("is_query"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
            .select("vec_id", ints.alias("v"), F.coalesce("is_query", F.lit(False)).alias("is_query")))
    base = staged(base.distinct().withColumn("dim", F.size("v")), "vectors")
    n, n_queries = base.agg(F.count("*"), F.count_if("is_query")).first()
    n_shards, n_blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // block_rows))
    slot = lambda tag, count: F.pmod(F.xxhash64("vec_id", F.lit(tag)), F.lit(count)).cast("int")
    sharded = base.withColumn("shard", slot("shard", n_shards))
    blocked = (base.where("is_query").withColumn("block", slot("block", n_blocks))
               .select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim", "block"))
    home = F.pmod(F.col("block"), F.lit(n_shards)).cast("int")  # the shard that a block searches first
    lowest = F.lit(-2 ** 63).cast("bigint")
    cells = sharded.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    first = staged(_search_cells(cells.where(F.col("shard") == home),
                                 blocked.withColumn("shard", home).withColumn("floor", lowest), k), "top-k-first")
    found = first
    if n_shards > 1:
        ids = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a query id can have several vectors
        kth = (ids.withColumn("n", F.row_number().over(_best_first())).where(F.col("n") == k)
               .select("query_id", F.col("score").alias("kth")))
        again = blocked.join(kth, "query_id", "left").withColumn("floor", F.coalesce("kth", lowest)).drop("kth")
        again = again.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).where(F.col("shard") != home)
        found = first.union(_search_cells(cells.where(F.col("shard") != home), again, k))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (best.withColumn("rank", F.row_number().over(_best_first())).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _best_first():
    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
