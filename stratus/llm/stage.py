"""Staged tables in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the cluster's shared folder and read it back.

    A lost executor re-reads files instead of repeating the work, and later
    plans start from real sizes.
    """
    path = staged_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_path(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, label)


def drop(*frames: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
