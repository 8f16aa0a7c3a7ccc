"""Raw and clean station CSV files.

Spark maps CSV columns to a schema by position, so files whose headers list
the columns in different orders need a mapping. The files' first lines are read
in tasks; they make a small table of layouts, one row a file: where each column
stands in it. All files are then one scan with columns by position, joined with
the layouts, and each cell is taken from the place that its file's layout names.
"""

from __future__ import annotations

import csv as _csv
import io
import re
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.joins import sized_broadcast
from . import files as FS

# Reader/writer options that keep cells as written: no whitespace trimming,
# only an unquoted empty cell is missing (blank handling is the cleaner's).
READ_OPTIONS = {"header": "true", "mode": "PERMISSIVE", "multiLine": "false",
                "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
WRITE_OPTIONS = {"header": "true", "ignoreLeadingWhiteSpace": "false",
                 "ignoreTrailingWhiteSpace": "false"}
#: Names of CSV files, plain or compressed.
SUFFIXES = (".csv", ".csv.gz")
#: A compressed file cannot be split by its readers, so it holds so many rows at most.
COMPRESSED_OPTIONS = {"compression": "gzip", "maxRecordsPerFile": "500000"}


def parse_header(line: str | None) -> list[str]:
    if not line:
        return []
    return [c.strip() for c in next(_csv.reader(io.StringIO(line)))]


def raw_schema_for(columns: list[str]):
    """All-text schema for a header (no type inference)."""
    return S.raw_schema(columns)


def read_raw(spark: SparkSession, paths: list[str] | str,
             columns: list[str] | None = None) -> DataFrame:
    """Read CSV files that share one header as all-text columns.

    ``columns`` is the header in file order; read from the first file when
    not given. No type inference: every column is text.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if columns is None:
        columns = parse_header(FS.read_first_line(spark, paths[0]))
    return spark.read.options(**READ_OPTIONS).schema(S.raw_schema(columns)).csv(paths)


#: Files whose first lines one job reads.
HEADER_BATCH = 10_000


def first_lines(spark: SparkSession, paths: list[str]) -> list[str]:
    """The first line of each (non-empty) file, read by one task a file.

    A task stops after its line. Whole files are one split each, so the
    partitions follow the order of the paths.
    """
    text = "org.apache.hadoop.mapreduce.lib.input.TextInputFormat"
    lines: dict[int, str] = {}
    for start in range(0, len(paths), HEADER_BATCH):
        # The characters of file patterns and of Hadoop's lists are escaped.
        names = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths[start:start + HEADER_BATCH]]
        names = [p.replace("\\", "\\\\").replace(",", "\\,") for p in names]
        conf = {"mapreduce.input.fileinputformat.split.minsize": str(1 << 62),
                "mapreduce.input.fileinputformat.inputdir": ",".join(names)}
        rows = spark.sparkContext.newAPIHadoopRDD(text, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text",
                                                  conf=conf)
        found = rows.mapPartitionsWithIndex(lambda i, it: [(i, line) for _, line in islice(it, 1)]).collect()
        lines.update((start + i, line) for i, line in found)
    return [lines.get(i, "").removeprefix("\ufeff") for i in range(len(paths))]


_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):/+"


def read_raw_files(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """CSV files as one all-text frame (S3, U1): columns by name in the order
    in which they are first met, missing ones NULL. None when no file has a header.

    One scan, whatever the number of layouts; the join has one row per file.
    """
    headers = {p: parse_header(line) for p, line in zip(paths, first_lines(spark, paths))}
    headers = {p: h for p, h in headers.items() if h}
    if not headers:
        return None
    columns = list(dict.fromkeys(c for h in headers.values() for c in h))
    if all(h == columns for h in headers.values()):
        return read_raw(spark, list(headers), columns)
    layouts = spark.createDataFrame(
        [(FS.uri(spark, p), [h.index(c) if c in h else -1 for c in columns]) for p, h in headers.items()],
        "__file string, __places array<int>").withColumn("__file", F.regexp_replace("__file", _SCHEME, "$1:/"))
    cells = [f"__c{i}" for i in range(max(len(h) for h in headers.values()))]
    scan = read_raw(spark, list(headers), cells).select(
        F.array(*cells).alias("__cells"), F.regexp_replace("_metadata.file_path", _SCHEME, "$1:/").alias("__file"))
    joined = scan.join(sized_broadcast(layouts), "__file")
    # A place of -1 is outside the array: NULL.
    return joined.select(*[F.get("__cells", F.get("__places", F.lit(i))).alias(c) for i, c in enumerate(columns)])


def read_raw_dir(spark: SparkSession, pattern: str) -> DataFrame | None:
    """All CSV files of a directory (or glob) as one all-text frame (S3)."""
    return read_raw_files(spark, [f.path for f in FS.list_files(spark, pattern, SUFFIXES) if f.size > 0])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compressed: bool = False) -> None:
    """Write a frame as CSV files with a header (S6), plain or ``.csv.gz``."""
    options = {**WRITE_OPTIONS, **(COMPRESSED_OPTIONS if compressed else {})}
    df.write.mode(mode).options(**options).csv(path)


def read_clean_dir(spark: SparkSession, pattern: str,
                   fallback: str | None = None) -> DataFrame | None:
    """Cleaned CSV files typed to the observation schema (S4 over S3); when
    ``pattern`` holds no file, the ``fallback`` location is read instead."""
    raw = read_raw_dir(spark, pattern)
    if raw is None and fallback:
        raw = read_raw_dir(spark, fallback)
    if raw is None:
        return None
    typed = []
    for f in S.OBSERVATION_SCHEMA.fields:
        if f.name in raw.columns:
            typed.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
        else:
            typed.append(F.lit(None).cast(f.dataType).alias(f.name))
    return raw.select(*typed)


def latest_csv(spark: SparkSession, pattern: str) -> str | None:
    """Path of the most recently modified CSV file (S11); ties broken by path.

    Spark lists the files; their contents are not read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option(
        "pathGlobFilter", "*.{csv,csv.gz}").load(pattern).select("path", "modificationTime")
    return listed.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def latest_import(spark: SparkSession, pattern: str) -> list[str]:
    """The files of the newest import (S11): the newest file, with all part
    files of its folder when a Spark job wrote it (its success marker is there)."""
    newest = latest_csv(spark, pattern)
    if newest is None:
        return []
    folder = newest.rsplit("/", 1)[0]
    if not FS.exists(spark, f"{folder}/_SUCCESS"):
        return [newest]
    return [f.path for f in FS.list_files(spark, folder, SUFFIXES) if f.size > 0]


def file_manifest(df: DataFrame) -> DataFrame:
    """Distinct base names of the files a frame was read from."""
    return df.select(F.col("_metadata.file_name").alias("file_name")).distinct()


def write_manifest(df: DataFrame, path: str) -> None:
    """Write the file manifest as text, one name per line."""
    file_manifest(df).write.mode("overwrite").text(path)
