"""Distinct stations over any years of the stored table, from stored sketches.

Each data file has one mergeable HyperLogLog sketch of its station names, kept
in a hidden folder beside the year folders. A question over a range of years
merges the sketches of the files that are there now; only files without a
sketch are read, whichever writer made them. A purge writes new files, so the
sketches of the old ones no longer count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files as FS

#: 2**12 registers: a relative standard error of about 1.6 %.
LG_REGISTERS = 12
_SCHEMA = "file string, sketch binary, n_rows bigint, {} int"


def _folder(path: str, column: str) -> str:
    return f"{path.rstrip('/')}/_sketch-{column}"


def _stored(spark: SparkSession, folder: str, partition: str, years: list[int]) -> DataFrame:
    schema = _SCHEMA.format(partition)
    if not FS.exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).filter(F.col(partition).isin(years))


def file_sketches(spark: SparkSession, path: str, table_schema, partition: str, years: list[int],
                  column: str = "NAME", lg_registers: int = LG_REGISTERS) -> DataFrame:
    """One row per data file of ``years`` (file, sketch, n_rows, year), the missing ones made first."""
    folder, root = _folder(path, column), path.rstrip("/")
    listed = [(f.name, f.path, y) for y in years for f in FS.list_files(spark, f"{root}/{partition}={y}", ".parquet")]
    # The years of one write hold files of one name.
    covered = {(r["file"], r[partition]) for r in _stored(spark, folder, partition, years).select("file", partition).collect()}
    fresh = [p for name, p, y in listed if (name, y) not in covered]
    if fresh:
        rows = spark.read.schema(table_schema).option("basePath", root).parquet(*fresh)
        made = rows.groupBy(F.col("_metadata.file_name").alias("file"), partition).agg(
            F.hll_sketch_agg(column, lg_registers).alias("sketch"), F.count(F.lit(1)).alias("n_rows"))
        made.select("file", "sketch", "n_rows", partition).write.mode("append").partitionBy(partition).parquet(folder)
    live = spark.createDataFrame([(name, y) for name, _, y in listed], f"file string, {partition} int")
    # A writer that was started twice may have left two equal rows of a file.
    return (_stored(spark, folder, partition, years).join(F.broadcast(live), ["file", partition], "left_semi")
            .dropDuplicates(["file", partition]))


def merged_count(sketches: DataFrame) -> DataFrame:
    """``(n_stations, n_rows)`` over all given sketches; no sketch: zero."""
    merged = sketches.agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n_rows").alias("n_rows"))
    return merged.select(F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("bigint").alias("n_stations"),
                         F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
