"""Toxicity classifier with a counterfactual penalty on identity terms.

A logistic model over the distinct words and word beginnings of a text. From
labelled sentences that mention an identity term, counterfactual pairs are
made by swapping the term for others of its kind and for a neutral word; the
training loss adds ``penalty`` times the mean squared change of the sentence's
score, so a mere group mention moves the score as little as the labels allow.

The word features are screened by their association with the label (counted on
the executors), the fit runs on a bounded labelled sample
(``max_per_class``), and every whole text is scored.

Defined cases: a null or empty text has no features and scores the base rate;
labels other than 0 and 1 are no labels; without labels every score is 0.5.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .sampling import held_out, labelled_sample
from .stage import drop

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Documents of each class that the model is fitted on, at most.
MAX_PER_CLASS = 6_000
MAX_FEATURES = 20_000
BUCKET_BITS = 20
PREFIXES = (4, 5, 6)

# Identity terms by kind, unless the caller has a list of their own.
IDENTITY_TERMS = {
    "en": ("people women men girls boys muslims christians jews hindus buddhists atheists blacks whites asians "
           "latinos africans europeans arabs gays lesbians immigrants refugees foreigners disabled elderly").split(),
    "en_adj": ("human female male muslim christian jewish hindu buddhist black white asian african european arab "
               "gay lesbian straight transgender immigrant foreign blind deaf old young").split(),
    "de": "menschen frauen männer muslime christen juden ausländer flüchtlinge schwarze weiße türken araber".split(),
    "fr": "gens femmes hommes musulmans chrétiens juifs étrangers réfugiés noirs blancs arabes africains".split(),
    "es": "gente mujeres hombres musulmanes cristianos judíos extranjeros refugiados negros blancos árabes".split(),
}
_SENTENCE = re.compile(r"[^.!?\n]+")

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def word_features(raw: np.ndarray, offsets: np.ndarray, powers: blocks.Powers) -> tuple[np.ndarray, np.ndarray]:
    """``(row, feature)`` of every word and word beginning, repeats included."""
    low = np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)
    flag = _LETTER[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    begins, stops = flag.copy(), np.zeros(len(low) + 1, bool)
    begins[1:] &= ~flag[:-1] | edge[1:-1]
    stops[1:] = flag
    stops[1:-1] &= ~flag[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    doc = np.searchsorted(offsets, starts, "right") - 1
    prefix = blocks.PrefixHash(low, powers)
    rows, feats = [doc], [blocks.mix(prefix.span(starts, ends))]
    for k in PREFIXES:
        longer = np.flatnonzero(ends - starts > k)
        s = starts[longer]
        rows.append(doc[longer])
        feats.append(blocks.mix(prefix.span(s, s + k) + np.uint64(k)))
    return np.concatenate(rows), (np.concatenate(feats) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _distinct(rows: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((rows << BUCKET_BITS) | feats)
    return both >> BUCKET_BITS, both & ((1 << BUCKET_BITS) - 1)


def _of_text(text: str, powers: blocks.Powers) -> set[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return set(word_features(raw, np.array([0, len(raw)]), powers)[1].tolist()) if len(raw) else set()


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a feature, summed in the task."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    powers = blocks.Powers()
    for batch in batches:
        label = batch.column("label").to_numpy()
        for lo, _, raw, offs in blocks.byte_slices(batch.column("text")):
            if len(raw):
                rows, feats = _distinct(*word_features(raw, offs, powers))
                for value in (0, 1):
                    counts[value] += np.bincount(feats[label[lo + rows] == value], minlength=1 << BUCKET_BITS)
    seen = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen), pa.array(counts[1][seen]), pa.array(counts[0][seen])], names=["feature", "n1", "n0"])


def select_features(sample: DataFrame, max_features: int) -> np.ndarray:
    """The features most clearly associated with the label (z of the log odds)."""
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, np.int64)
    counts = sample.select("text", "label").mapInArrow(_count_features, "feature bigint, n1 bigint, n0 bigint")
    summed = counts.groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    odds = (F.log((F.col("n1") + 0.5) / (n1 - F.col("n1") + 0.5))
            - F.log((F.col("n0") + 0.5) / (n0 - F.col("n0") + 0.5)))
    spread = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5)
                    + 1 / (n1 - F.col("n1") + 0.5) + 1 / (n0 - F.col("n0") + 0.5))
    best = (summed.withColumn("z", odds / spread).where("z > 2.5 AND n1 >= 2 AND n1 * {0} > 3 * n0 * {1}".format(n0, n1))
            .orderBy(F.desc("z"), "feature").limit(max_features))
    return np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64))


def _slot_column(text: Column, selected) -> Column:
    """Distinct selected features of a text, as positions in ``selected``."""
    def compute(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slot = np.full(1 << BUCKET_BITS, -1, np.int32)
        slot[selected.value] = np.arange(len(selected.value))
        powers = blocks.Powers()
        for column in columns:
            sizes, slots = [np.zeros(1, np.int64)], []
            for lo, hi, raw, offs in blocks.byte_slices(column):
                rows, feats = word_features(raw, offs, powers) if len(raw) else (np.zeros(0, np.int64),) * 2
                keep = slot[feats] >= 0
                rows, feats = _distinct(rows[keep], feats[keep])
                sizes.append(np.bincount(rows, minlength=hi - lo))
                slots.append(slot[feats])
            values = np.concatenate(slots) if slots else np.zeros(0, np.int32)
            yield blocks.list_array(np.cumsum(np.concatenate(sizes)), pa.array(values, pa.int32()))
    return F.arrow_udf(compute, "array<int>").asNondeterministic()(text)


def counterfactual_pairs(text: str, terms: dict[str, list[str]] = IDENTITY_TERMS) -> Iterator[tuple[str, str]]:
    """``(sentence, sentence with one identity term swapped)``, for every other term of its kind."""
    kind = {term: group for group in terms.values() for term in group}
    if not kind:
        return
    mention = re.compile(r"\b(" + "|".join(sorted(map(re.escape, kind), key=len, reverse=True)) + r")\b")
    for sentence in _SENTENCE.findall(text.lower()):
        for m in mention.finditer(sentence):
            for other in kind[m[1]]:
                if other != m[1]:
                    yield sentence, sentence[:m.start()] + other + sentence[m.end():]


def _pair_column(text: Column, selected, terms: dict[str, list[str]]) -> Column:
    """The selected features that counterfactual pairs gain and lose, and the number of such pairs."""
    kind = "array<struct<gained:array<int>,lost:array<int>,n:int>>"

    def compute(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slot = {f: k for k, f in enumerate(selected.value.tolist())}
        powers = blocks.Powers()
        schema = pa.list_(pa.struct([("gained", pa.list_(pa.int32())), ("lost", pa.list_(pa.int32())), ("n", pa.int32())]))
        for column in columns:
            out = []
            for value in column.to_pylist():
                pairs: Counter = Counter()
                for a, b in counterfactual_pairs(value or "", terms):
                    fa, fb = _of_text(a, powers), _of_text(b, powers)
                    gained = tuple(sorted(slot[f] for f in fb - fa if f in slot))
                    lost = tuple(sorted(slot[f] for f in fa - fb if f in slot))
                    if gained or lost:
                        pairs[gained, lost] += 1
                out.append([{"gained": g, "lost": d, "n": n} for (g, d), n in pairs.items()])
            yield pa.array(out, schema)
    return F.arrow_udf(compute, kind).asNondeterministic()(text)


def fit(slots: list[list[int]], labels: np.ndarray, weights: np.ndarray, pairs: list[tuple[list[int], list[int]]],
        n_features: int, penalty: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3,
        times: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the base) by full-batch Adam on the penalised loss; a pair counts ``times``."""
    times = np.ones(len(pairs)) if times is None else times
    sizes = np.array([len(s) for s in slots])
    row = np.repeat(np.arange(len(slots)), sizes)
    col = np.concatenate([np.array(s, np.int64) for s in slots]) if sizes.sum() else np.zeros(0, np.int64)
    total = weights.sum()
    pair_row = np.concatenate([np.full(len(g) + len(d), k) for k, (g, d) in enumerate(pairs)]).astype(int) if pairs else np.zeros(0, int)
    pair_col = np.array([c for g, d in pairs for c in (*g, *d)], int)
    sign = np.array([s for g, d in pairs for s in (*[1.0] * len(g), *[-1.0] * len(d))])
    rate1 = float((weights * labels).sum() / total)
    w = np.zeros(n_features + 1)
    w[-1] = np.log(max(rate1, 1e-6) / max(1 - rate1, 1e-6))
    m = v = np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], len(slots)) + w[-1]
        g = weights * (0.5 * (1 + np.tanh(z / 2)) - labels) / total
        grad = np.append(np.bincount(col, g[row], n_features) + decay / max(len(slots), 1) * w[:-1], g.sum())
        if len(pairs):
            change = times * np.bincount(pair_row, sign * w[pair_col], len(pairs))
            grad[:-1] += 2 * penalty / times.sum() * np.bincount(pair_col, sign * change[pair_row], n_features)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return w


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS,
          max_features: int = MAX_FEATURES, penalty: float = 1.0,
          terms: dict[str, list[str]] = IDENTITY_TERMS) -> dict:
    """``{"features", "weights", "base", "pairs"}``; its size is bounded by max_features.

    ``terms``: lower-case identity terms by kind; ``pairs``: how many the fit had.
    """
    sample, _ = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, max_per_class, "toxicity")
    features = select_features(sample, max_features)
    shared = docs.sparkSession.sparkContext.broadcast(features)
    rows = sample.select("label", "weight", _slot_column(F.col("text"), shared).alias("slots"),
                         _pair_column(F.col("text"), shared, terms).alias("pairs")).collect()
    drop(sample)
    if not rows:
        return {"features": features, "weights": np.zeros(len(features)), "base": 0.0, "pairs": 0}
    pairs: Counter = Counter()
    for r in rows:
        for p in r["pairs"]:
            pairs[tuple(p["gained"]), tuple(p["lost"])] += p["n"]
    w = fit([r["slots"] for r in rows], np.array([r["label"] for r in rows], float),
            np.array([r["weight"] for r in rows]), list(pairs), len(features), penalty,
            times=np.array(list(pairs.values()), float))
    return {"features": features, "weights": w[:-1], "base": float(w[-1]), "pairs": sum(pairs.values())}


def score_column(text: Column, shared) -> Column:
    """Probability (0 to 1) that a text is toxic; ``shared`` holds a model."""
    def compute(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        weight = np.zeros(1 << BUCKET_BITS)
        weight[model["features"]] = model["weights"]
        used = weight != 0
        powers = blocks.Powers()
        for column in columns:
            parts = [np.zeros(0)]
            for lo, hi, raw, offs in blocks.byte_slices(column):
                z = np.full(hi - lo, model["base"])
                if len(raw):
                    rows, feats = word_features(raw, offs, powers)
                    keep = used[feats]
                    rows, feats = _distinct(rows[keep], feats[keep])
                    z += np.bincount(rows, weight[feats], hi - lo)
                parts.append(0.5 * (1 + np.tanh(z / 2)))
            yield pa.array(np.concatenate(parts), pa.float64())
    return F.arrow_udf(compute, "double").asNondeterministic()(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **bounds))
    out = docs.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
                      score_column(F.col("text"), shared).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
