"""Which of many keys are contained in which texts, as an equi-join.

Every substring of a text brings all its q-grams with it, so a key can only be
in texts that hold the key's rarest gram. Grams are counted over the texts,
each key is filed under its rarest one, the join is on that gram, and
``contains`` verifies the pairs that meet. No text is compared with every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import sized_broadcast

GRAM = 8


def _grams(text: str, lengths: Column) -> Column:
    """The distinct substrings of ``text`` that have one of ``lengths``."""
    n = F.length(text)
    of_length = lambda k: F.when(k <= n, F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col(text), i, k)))
    return F.array_distinct(F.flatten(F.filter(F.transform(lengths, of_length), lambda g: g.isNotNull())))


def contained_keys(texts: DataFrame, keys: DataFrame, gram: int = GRAM) -> DataFrame:
    """``(TEXT, KEY)`` for every key that its text contains, each pair once.

    ``texts`` has a column ``TEXT`` and ``keys`` a column ``KEY``; both are
    compared as they are. Null and empty keys are in no text. A key shorter
    than ``gram`` is filed under its whole self.
    """
    keys = materialize(keys.select("KEY").where("KEY <> ''").distinct(), "keys")
    # At most ``gram`` different lengths.
    lengths = keys.select(F.sort_array(F.collect_set(F.least(F.length("KEY"), F.lit(gram))))).scalar()
    key_grams = keys.withColumn("GRAM", F.explode(_grams("KEY", F.array(F.least(F.length("KEY"), F.lit(gram))))))
    wanted = sized_broadcast(key_grams.select("GRAM").distinct())
    text_grams = materialize(
        texts.select("TEXT").where(F.col("TEXT").isNotNull()).distinct().withColumn("LENGTHS", lengths)
        .select("TEXT", F.explode(_grams("TEXT", F.col("LENGTHS"))).alias("GRAM")).join(wanted, "GRAM", "left_semi"),
        "text-grams")
    counts = text_grams.groupBy("GRAM").agg(F.count(F.lit(1)).alias("N"))
    # A gram that no text has: the key is nowhere, and its least count is zero.
    filed = (key_grams.join(counts, "GRAM", "left").groupBy("KEY")
             .agg(F.min(F.struct(F.coalesce("N", F.lit(0)).alias("N"), "GRAM")).alias("rarest"))
             .where("rarest.N > 0").select("KEY", F.col("rarest.GRAM").alias("GRAM")))
    return text_grams.join(filed, "GRAM").where(F.contains("TEXT", "KEY")).select("TEXT", "KEY")
