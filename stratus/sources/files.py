"""File-system helpers through the Hadoop FileSystem API (works the same on
local disk, HDFS or object stores). Only metadata and one header line per
file pass through the driver; file contents are read by Spark tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class FileInfo:
    path: str
    name: str
    modified_ms: int
    size: int


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hpath.getFileSystem(conf), hpath, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath, _ = _fs_and_path(spark, path)
    return bool(fs.exists(hpath))


def delete(spark: SparkSession, path: str) -> bool:
    fs, hpath, _ = _fs_and_path(spark, path)
    return bool(fs.delete(hpath, True))


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False when it exists already (atomic)."""
    fs, hpath, _ = _fs_and_path(spark, path)
    return bool(fs.createNewFile(hpath))


def make_dirs(spark: SparkSession, path: str) -> None:
    fs, hpath, _ = _fs_and_path(spark, path)
    fs.mkdirs(hpath)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a file or folder; raises when the file system refuses."""
    fs, hpath, jvm = _fs_and_path(spark, source)
    if not fs.rename(hpath, jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot move {source} to {target}")


def list_files(spark: SparkSession, pattern: str, suffix: str | tuple[str, ...] = ".csv") -> list[FileInfo]:
    """Files matching a directory or glob pattern, ending with ``suffix`` (or one of them).

    A directory lists its direct children; a pattern such as ``dir/*/*.csv``
    is expanded by the file system.
    """
    fs, hpath, _ = _fs_and_path(spark, pattern)
    if fs.exists(hpath) and fs.getFileStatus(hpath).isDirectory():
        statuses = fs.listStatus(hpath)
    else:
        statuses = fs.globStatus(hpath) or []
    out = []
    for st in statuses:
        if st.isFile() and st.getPath().getName().endswith(suffix):
            p = st.getPath()
            out.append(FileInfo(p.toString(), p.getName(), int(st.getModificationTime()),
                                int(st.getLen())))
    return sorted(out, key=lambda f: f.path)


def uri(spark: SparkSession, path: str) -> str:
    """The path as Spark's file metadata writes it (escaped)."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()


def list_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the folders matching a glob pattern, in order."""
    fs, hpath, _ = _fs_and_path(spark, pattern)
    return sorted(st.getPath().toString() for st in fs.globStatus(hpath) or [] if st.isDirectory())


def read_first_line(spark: SparkSession, path: str) -> str | None:
    """First text line of a file (a CSV header), plain or compressed, read by the driver."""
    fs, hpath, jvm = _fs_and_path(spark, path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
        spark.sparkContext._jsc.hadoopConfiguration()).getCodec(hpath)
    stream = fs.open(hpath)
    try:
        if codec is not None:
            stream = codec.createInputStream(stream)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
        reader.close()
    finally:
        stream.close()
    if line is not None and line.startswith("\ufeff"):
        line = line[1:]
    return line


def latest_file(spark: SparkSession, pattern: str, suffix: str = ".csv") -> FileInfo | None:
    """The most recently modified file (S11); ties broken by path."""
    files = list_files(spark, pattern, suffix)
    return max(files, key=lambda f: (f.modified_ms, f.path)) if files else None


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a partition column present under ``path`` (``column=value``
    sub-folders), from the listing alone."""
    fs, hpath, _ = _fs_and_path(spark, path)
    if not fs.exists(hpath):
        return []
    prefix = column + "="
    return [st.getPath().getName()[len(prefix):] for st in fs.listStatus(hpath)
            if st.isDirectory() and st.getPath().getName().startswith(prefix)]
