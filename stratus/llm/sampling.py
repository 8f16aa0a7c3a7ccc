"""Folds and bounded training samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import staged


def fold(doc_id: Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, fold_no: int) -> Column:
    """Whether a row's labels are kept from training (a null id: it is)."""
    return F.coalesce(fold(doc_id, folds) == fold_no, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold_no: int,
                    max_per_class: int, tag: str) -> tuple[DataFrame, dict[int, float]]:
    """Staged ``(text, label, weight)`` rows of the training folds.

    At most ``max_per_class`` documents of each class, chosen by the hash of
    their ids, so the choice does not depend on partitioning; ``weight``
    restores the class shares of all training labels, which are counted over
    the whole table. The sample's ids are bounded by the two limits, so they
    are broadcast; the documents are only filtered, never shuffled. A document
    id with contradicting labels or several rows is one training row: the larger
    label, and the least text.
    """
    known = (labels.where(~held_out(F.col("doc_id"), folds, fold_no))
             .select("doc_id", F.col(label).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    known = staged(known, f"{tag}-labels")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id", F.lit(tag))
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(order, "doc_id").limit(max_per_class)
        part = part.withColumn("weight", F.lit(counts.get(value, 0) / max(min(counts.get(value, 0), max_per_class), 1)))
        picked = part if picked is None else picked.union(part)
    picked = staged(picked, f"{tag}-picked")
    sample = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
              .join(F.broadcast(picked), "doc_id")
              .groupBy("doc_id").agg(F.min(F.struct("text", "label", "weight")).alias("row")).select("row.*"))
    return staged(sample, f"{tag}-sample"), {k: float(v) for k, v in counts.items()}
