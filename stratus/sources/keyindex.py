"""Bloom filters of the keys stored in each year of a table.

A year's filter is a row per bucket of 32,768 bits; a key sets a few bits of one
bucket. The filters lie in a hidden folder beside the year folders, with the
names of the data files they cover: files that are not covered yet are read
once, whichever writer made them, and files that are gone leave bits that only
cost a look-up. So a filter never misses a stored key, and what it reports is
verified against the stored rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import files as FS

BUCKET_BITS = 32_768
#: Bits per key when a year's filter is first built, with room to grow.
BITS_PER_KEY = 32
PROBES = 4
_FILES = "file string, buckets bigint, {} int"
_BITS = "bucket bigint, bits binary, {} int"


def _folder(path: str, keys: list[str]) -> str:
    return f"{path.rstrip('/')}/_keys-{'-'.join(keys)}"


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.col("buckets"))


def _places(keys: list[str]) -> list[Column]:
    return [F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(BUCKET_BITS)) for i in range(PROBES)]


def _read(spark: SparkSession, path: str, schema: str, partition: str, years: list[int]) -> DataFrame:
    schema = schema.format(partition)
    if not FS.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).filter(F.col(partition).isin(years))


def refresh(spark: SparkSession, path: str, table_schema, partition: str, keys: list[str], years: list[int]) -> None:
    """Cover every data file of ``years``. The driver lists the files of these years and reads none."""
    folder, root = _folder(path, keys), path.rstrip("/")
    covered = {(r[partition], r["file"]): r["buckets"] for r in
               _read(spark, f"{folder}/files", _FILES, partition, years).collect()}
    listed = [(y, f) for y in years for f in FS.list_files(spark, f"{root}/{partition}={y}", ".parquet")]
    fresh = [(y, f) for y, f in listed if (y, f.name) not in covered]
    if not fresh:
        return
    rows = spark.read.schema(table_schema).option("basePath", root).parquet(*[f.path for _, f in fresh])
    buckets = {y: n for (y, _), n in covered.items()}
    for r in rows.groupBy(partition).count().collect():
        buckets.setdefault(r[partition], -(-r["count"] * BITS_PER_KEY // BUCKET_BITS))
    sizes = spark.createDataFrame([(y, max(n, 1)) for y, n in buckets.items()], f"{partition} int, buckets bigint")
    bits = (rows.select(partition, *keys).join(F.broadcast(sizes), partition)
            .select(partition, _bucket(keys).alias("bucket"), F.explode(F.array(*_places(keys))).alias("place"))
            .groupBy(partition, "bucket").agg(F.bitmap_construct_agg("place").alias("bits")))
    bits.select("bucket", "bits", partition).write.mode("append").partitionBy(partition).parquet(f"{folder}/bits")
    done = spark.createDataFrame([(f.name, max(buckets.get(y, 1), 1), y) for y, f in fresh], _FILES.format(partition))
    done.coalesce(1).write.mode("append").partitionBy(partition).parquet(f"{folder}/files")  # one small row a file


def with_maybe_stored(rows: DataFrame, path: str, partition: str, keys: list[str], years: list[int]) -> DataFrame:
    """Staged ``rows`` with ``_maybe``: false only if the key is certainly not stored in its year."""
    spark, folder = rows.sparkSession, _folder(path, keys)
    sizes = _read(spark, f"{folder}/files", _FILES, partition, years).groupBy(partition).agg(F.max("buckets").alias("buckets"))
    bits = _read(spark, f"{folder}/bits", _BITS, partition, years).groupBy(partition, "bucket").agg(
        F.bitmap_or_agg("bits").alias("bits"))
    # One row per year of the batch.
    probed = rows.join(F.broadcast(sizes), partition, "left").withColumn("bucket", _bucket(keys)).join(
        bits, [partition, "bucket"], "left")

    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0
    hit = reduce(Column.__and__, [is_set(p) for p in _places(keys)])
    return materialize(probed.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("_maybe")), "maybe-stored")
