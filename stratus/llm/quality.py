"""Quality classifier by positive-unlabelled learning.

Only trusted positives (quality 1, training folds) and unlabelled web text
are used for the fit: a linear model over style statistics minimises the
non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with logistic loss. The class prior is estimated from the label counts of the
training folds. The positives are a bounded sample (``max_positives``). The
unlabelled part is the risk over all documents: every ``EVERY`` steps Spark
sums its loss and gradient over the staged features of all of them, and a
sample (``max_unlabelled``) only tells how both change until the next sum.
Every whole text is scored.

Defined cases: a null or empty text has all-zero statistics and a score like
any other; labels other than 0 and 1 are no labels; without any positive or
unlabelled row the score is the class prior (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .sampling import held_out, labelled_sample
from .stage import drop, staged

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Positives that the model is fitted on, and documents that steer it between sums over all, at most.
MAX_POSITIVES = MAX_UNLABELLED = 6_000
#: Steps of the fit from one sum over all documents to the next.
EVERY = 25

_BASE = np.array([ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"])
_CLASSES = [list(range(65, 91)), list(range(97, 123)), list(range(48, 58)), [32, 9, 11, 12, 13], [10], list(range(128, 256))]
_GROUP = np.full(256, len(_BASE) + len(_CLASSES), np.int64)
_GROUP[_BASE] = np.arange(len(_BASE))
for _k, _members in enumerate(_CLASSES):
    _GROUP[_members] = len(_BASE) + _k
_N_GROUPS = len(_BASE) + len(_CLASSES) + 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
N_FEATURES = _N_GROUPS + 7


def _runs(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the runs of non-break bytes inside each text."""
    flag = ~breaks[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = flag.copy()
    begins[1:] &= ~flag[:-1] | edge[1:-1]
    stops = np.zeros(len(raw) + 1, bool)
    stops[1:] = flag
    stops[1:-1] &= ~flag[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _share_distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the runs, and the share of runs that are distinct."""
    total = np.bincount(rows, minlength=n).astype(float)
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (np.diff(r) != 0) | (h[1:] != h[:-1])
    distinct = np.bincount(r[fresh], minlength=n)
    return total, distinct / np.maximum(total, 1)


def style_features(raw: np.ndarray, offsets: np.ndarray, powers: blocks.Powers) -> np.ndarray:
    """One row of style statistics for each text of a slice."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    row = np.repeat(np.arange(n), length)
    counts = np.bincount(row * _N_GROUPS + _GROUP[raw], minlength=n * _N_GROUPS).reshape(n, _N_GROUPS)
    out = np.zeros((n, N_FEATURES))
    out[:, :_N_GROUPS] = np.sqrt(counts / np.maximum(length, 1)[:, None])
    if len(raw):
        prefix = blocks.PrefixHash(raw, powers)
        starts, ends, doc = _runs(raw, offsets, _SPACE)
        h = prefix.span(starts, ends)
        words, distinct = _share_distinct(doc, h, n)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        once = np.zeros(len(h), bool)  # the word before last: pairs repeated in turn
        once[2:] = (h[2:] == h[:-2]) & (doc[2:] == doc[:-2])
        per = np.maximum(words, 1)
        out[:, _N_GROUPS] = np.sqrt(np.bincount(doc, again, n) / per)
        out[:, _N_GROUPS + 1] = np.sqrt(np.bincount(doc, once, n) / per)
        # Distinct words thin out as a text grows; compare with what its length allows.
        out[:, _N_GROUPS + 2] = distinct * np.log1p(words) / 8
        out[:, _N_GROUPS + 3] = np.bincount(doc, ends - starts, n) / per / 10
        lines = np.zeros(256, bool)
        lines[10] = True
        starts, ends, doc = _runs(raw, offsets, lines)
        n_lines, distinct = _share_distinct(doc, prefix.span(starts, ends), n)
        out[:, _N_GROUPS + 4] = np.where(n_lines > 0, 1 - distinct, 0)
        out[:, _N_GROUPS + 5] = np.log1p(np.bincount(doc, ends - starts, n) / np.maximum(n_lines, 1)) / 8
        out[:, _N_GROUPS + 6] = np.log1p(words) / 8
    return out


def _features(column: pa.Array, powers: blocks.Powers) -> np.ndarray:
    parts = [style_features(raw, offs, powers) for _, _, raw, offs in blocks.byte_slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


def _feature_column(text: Column) -> Column:
    def compute(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        powers = blocks.Powers()
        for column in columns:
            x = _features(column, powers)
            yield blocks.list_array(np.arange(len(x) + 1) * N_FEATURES, pa.array(x.ravel(), pa.float32()))
    return F.arrow_udf(compute, "array<float>").asNondeterministic()(text)


class Unlabelled:
    """Sums over the staged features ``x`` of all documents, one pass each."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def _sum(self, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                    total = total + part(x.astype(np.float64).reshape(-1, N_FEATURES))
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])
        return np.sum([r["s"] for r in self.rows.select("x").mapInArrow(compute, "s array<double>").collect()], axis=0)

    def moments(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Number, sums and sums of squares."""
        s = self._sum(lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
        return s[0], s[1:1 + N_FEATURES], s[1 + N_FEATURES:]

    def risk(self, mean: np.ndarray, spread: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss as negatives, and its gradient."""
        def part(x: np.ndarray) -> np.ndarray:
            u = np.c_[np.clip((x - mean) / spread, -8, 8), np.ones(len(x))]
            z = u @ w
            return np.concatenate([[len(x), np.logaddexp(0, z).sum()], u.T @ (0.5 * (1 + np.tanh(z / 2)))])
        s = self._sum(part)
        return s[1] / s[0], s[2:] / s[0]


def fit_pu(positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600,
           rate: float = 0.05, decay: float = 1e-4, whole: Unlabelled | None = None) -> dict[str, np.ndarray]:
    """Linear scorer by non-negative PU risk, full-batch Adam.

    ``whole``: all documents, when ``unlabelled`` is a sample of them.
    """
    if whole is None:
        both = np.concatenate([positives, unlabelled])
        mean, spread = both.mean(0), both.std(0) + 1e-3
    else:
        n, sums, squares = whole.moments()
        n += len(positives)
        mean = (sums + positives.sum(0)) / n
        spread = np.sqrt(np.maximum((squares + (positives ** 2).sum(0)) / n - mean ** 2, 0)) + 1e-3
    p = np.clip((positives - mean) / spread, -8, 8)
    u = np.clip((unlabelled - mean) / spread, -8, 8)
    w = np.zeros(p.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    p, u = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    m = v = np.zeros_like(w)
    sigmoid = lambda z: 0.5 * (1 + np.tanh(z / 2))
    base, loss_shift, grad_shift = w, 0.0, np.zeros_like(w)  # from the sample to all documents
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        loss_u, loss_p = np.logaddexp(0, zu).mean(), np.logaddexp(0, zp).mean()
        grad_u = u.T @ sigmoid(zu) / len(u)
        if whole is not None:
            if step % EVERY == 1:
                loss, grad = whole.risk(mean, spread, w)
                base, loss_shift, grad_shift = w, loss - loss_u, grad - grad_u
            loss_u, grad_u = loss_u + loss_shift + grad_shift @ (w - base), grad_u + grad_shift
        negative = loss_u - prior * loss_p
        grad_plus = -prior * (p.T @ sigmoid(-zp)) / len(p)
        grad_minus = grad_u - prior * (p.T @ sigmoid(zp)) / len(p)
        # Below zero the negative part is over-fitted: step back on it alone.
        grad = grad_plus + grad_minus if negative >= 0 else -grad_minus
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return {"mean": mean, "spread": spread, "weights": w}


def scores(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["spread"], -8, 8) @ model["weights"][:-1] + model["weights"][-1]
    return 0.5 * (1 + np.tanh(z / 2))


def train(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES,
          max_unlabelled: int = MAX_UNLABELLED) -> dict:
    """The fitted model: a few dozen numbers."""
    sample, counts = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, max_positives, "quality")
    positives = sample.where("label = 1").select(_feature_column(F.col("text")).alias("x"))
    # Unlabelled text: all documents, their labels not looked at; those of the sample are chosen by hash.
    everything = staged(docs.where("doc_id IS NOT NULL")
                        .select("doc_id", _feature_column(F.col("text").cast("string")).alias("x")), "quality-features")
    ids = staged(everything.select("doc_id").distinct()
                 .orderBy(F.xxhash64("doc_id", F.lit("unlabelled")), "doc_id").limit(max_unlabelled), "quality-web")
    # One row of each id, so that the sample is bounded by the number of ids.
    web = everything.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x")).select("x")
    stack = lambda df: np.array([r["x"] for r in df.collect()], float).reshape(-1, N_FEATURES)
    p, u = stack(positives), stack(web)
    total = sum(counts.values())
    prior = (counts.get(1, 0.0) + 1) / (total + 2)
    if not len(p) or not len(u):
        drop(sample, ids, everything)
        flat = np.zeros(N_FEATURES + 1)
        flat[-1] = np.log(prior / (1 - prior))
        return {"mean": np.zeros(N_FEATURES), "spread": np.ones(N_FEATURES), "weights": flat}
    model = fit_pu(p, u, prior, whole=Unlabelled(everything) if everything.count() > len(u) else None)
    drop(sample, ids, everything)
    return model


def score_column(text: Column, model: dict) -> Column:
    """Probability (0 to 1) that a text is of good quality."""
    def compute(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        powers = blocks.Powers()
        for column in columns:
            yield pa.array(scores(_features(column, powers), model), pa.float64())
    return F.arrow_udf(compute, "double").asNondeterministic()(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = train(docs, labels, **bounds)
    out = docs.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
                      score_column(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """``docs`` without those scored below the threshold."""
    model = train(docs, labels, **bounds)
    scored = docs.withColumn("__quality", score_column(F.col("text"), model))
    return scored.where(F.col("__quality") >= threshold).select(*docs.columns)
