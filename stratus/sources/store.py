"""The observation table: a Parquet dataset partitioned by ``YEAR``.

Every writer (append, streaming ingest, purge, rebuild) goes through this
module, holds the table's lock file while it changes the table, and keeps
the same rules: no row without a date is stored, the rows of a year are
brought together before they are written (a hot year is split into several
files by adaptive execution), and a result that counts rows counts the rows
that were really written or removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators.filters import _as_date, suspect_temperature_condition
from ..session import materialize
from . import files as FS
from . import keyindex
from . import sketches as SK

PARTITION_COL = "YEAR"
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
TABLE_SCHEMA = T.StructType(list(S.OBSERVATION_SCHEMA.fields)
                            + [T.StructField(PARTITION_COL, T.IntegerType())])


@dataclass
class WriteResult:
    ok: bool
    rows: int
    message: str


@contextmanager
def table_lock(spark: SparkSession, path: str) -> Iterator[None]:
    """One writer at a time: an atomically created file beside the table.

    A writer that was killed leaves the file; remove it by hand after making
    sure that no writer runs. The next writer first settles what the killed
    one left (``_settle``); every operation here can then be run again.
    """
    lock = f"{path.rstrip('/')}.lock"
    if not FS.create_new(spark, lock):
        raise RuntimeError(f"the table is being written by another job ({lock} exists)")
    try:
        _settle(spark, path)
        yield
    finally:
        FS.delete(spark, lock)


def _settle(spark: SparkSession, path: str) -> None:
    """Undo or finish what a stopped writer left, with the lock held.

    A rebuild stopped between its two moves gets the old table back. A purge
    keeps each year's old folder until the new one is in its place: a year
    without a folder gets the old one back. A batch that did not reach the
    ledger is taken out, so that its replay lands it whole.
    """
    root = path.rstrip("/")
    for old in FS.list_folders(spark, f"{root}.old-*"):
        if FS.exists(spark, root):
            FS.delete(spark, old)
        else:
            FS.rename(spark, old, root)
    for old in FS.list_folders(spark, f"{root}/_old-*"):
        for folder in FS.list_folders(spark, f"{old}/{PARTITION_COL}=*"):
            place = f"{root}/{folder.rsplit('/', 1)[1]}"
            if not FS.exists(spark, place):
                FS.rename(spark, folder, place)
        FS.delete(spark, old)
    for staged in FS.list_folders(spark, f"{root}/_purge-*"):
        FS.delete(spark, staged)
    for staged in FS.list_folders(spark, f"{root}/_batch-*"):
        tag = staged.rsplit("/_batch-", 1)[1]
        if _landed(spark, path, tag) is None:
            for f in FS.list_files(spark, f"{root}/{PARTITION_COL}=*/{tag}-*", ".parquet"):
                FS.delete(spark, f.path)
        FS.delete(spark, staged)


def _ledger(path: str) -> str:
    return f"{path.rstrip('/')}/_ledger"


def _landed(spark: SparkSession, path: str, tag: str) -> int | None:
    """How many rows a batch landed; None when it is not in the ledger."""
    found = FS.list_files(spark, f"{_ledger(path)}/{tag}.rows-*", "")
    return int(found[0].name.rsplit("-", 1)[1]) if found else None


def ensure_table(spark: SparkSession, path: str) -> None:
    """Create an empty table with the fixed schema if the path is absent."""
    if FS.exists(spark, path):
        return
    empty = spark.createDataFrame([], S.OBSERVATION_SCHEMA).withColumn(
        PARTITION_COL, F.lit(None).cast("int"))
    empty.write.mode("append").partitionBy(PARTITION_COL).parquet(path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """The stored table (S5); ``YEAR`` filters prune partitions."""
    return spark.read.schema(TABLE_SCHEMA).parquet(path)


def stored_profile(spark: SparkSession, path: str, columns: list[str] | None = None,
                   by_year: bool = False) -> DataFrame:
    """Rows, first and last date and non-null counts of the stored table (A5, A7, A8),
    answered from the Parquet footers: the aggregates are pushed into the scan.

    ``by_year`` gives a row per stored year. An empty table has zero rows and
    NULL dates (by year: no row).
    """
    # The push-down belongs to the DataSource V2 reader, so it gets a session of its own.
    own = spark.newSession()
    if FS.partition_values(spark, path, PARTITION_COL):  # without a file there is no footer to count by
        own.conf.set("spark.sql.sources.useV1SourceList", "")
        own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        own.conf.set("spark.sql.caseSensitive", "true")  # groups by an upper-case partition column are pushed only so
    table = read_observations(own, path)
    grouped = table.groupBy(*([PARTITION_COL] if by_year else []))
    return grouped.agg(F.count(F.lit(1)).alias("n_rows"), F.min("DATE").alias("min_date"),
                       F.max("DATE").alias("max_date"), *[F.count(c).alias(f"n_{c}") for c in columns or []])


def stored_station_count(spark: SparkSession, path: str, first_year: int, last_year: int) -> DataFrame:
    """About how many stations, and how many rows, the table holds in a range of
    years (A10, D1), merged from the sketches of its data files."""
    years = [int(y) for y in FS.partition_values(spark, path, PARTITION_COL) if y.isdigit()]
    years = [y for y in years if first_year <= y <= last_year]
    return SK.merged_count(SK.file_sketches(spark, path, TABLE_SCHEMA, PARTITION_COL, years))


def to_stored(df: DataFrame, floor=None) -> DataFrame:
    """Rows as stored: dated rows from the floor on, missing columns as NULL,
    fixed column set."""
    floor = _as_date(floor)
    out = df.filter(F.col("DATE").isNotNull() if floor is None else F.col("DATE") >= F.lit(floor))
    cols = []
    for f in S.OBSERVATION_SCHEMA.fields:
        cols.append(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in out.columns
                    else F.lit(None).cast(f.dataType).alias(f.name))
    return out.select(*cols, F.year("DATE").alias(PARTITION_COL))


def _write(rows: DataFrame, path: str, mode: str) -> int:
    """Write stored rows by year; the number of rows written."""
    obs = Observation("written")
    # Rebalance: a year's rows come together (few files), a hot year is split.
    out = rows.hint("rebalance", PARTITION_COL).observe(obs, F.count(F.lit(1)).alias("rows"))
    # A station's rows lie together, so its series reads few row groups of a year.
    out = out.sortWithinPartitions(PARTITION_COL, "NAME", "DATE")
    writer = out.write.mode(mode).partitionBy(PARTITION_COL)
    for column in ("NAME", "STATION"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)
    return int(obs.get.get("rows", 0))


def without_repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key (NULL keys compare equal): the least under the order of
    all other columns, so the choice does not depend on the partitioning."""
    others = [c for c in rows.columns if c not in keys]
    # Dealt by key before the rows are sorted: whole rows are then sorted once, in partitions of a shuffle's size.
    return (rows.repartition(*keys).groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row"))
            .select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns]))


def append_observations(df: DataFrame, path: str, floor=None,
                        dedupe_keys: tuple[str, ...] | None = None) -> WriteResult:
    """Append cleaned rows to the table.

    ``dedupe_keys`` (e.g. ``("STATION", "DATE")``) drops rows whose key is
    already stored or repeated in the batch. With ``DATE`` among the keys only
    the batch's years are looked at: their Bloom filters (``keyindex``) tell
    which keys are certainly new, and only the years of the others are read.
    Keys alone are compared; whole rows move when their key is new, so ``df`` is
    read twice and must give the same rows each time.
    The row count comes from an observation on the written rows (no second
    pass over the data). An empty batch is reported as not ok and creates
    nothing.
    """
    spark = df.sparkSession
    with table_lock(spark, path):
        new_table = not FS.exists(spark, path)
        rows = to_stored(df, floor)
        if dedupe_keys:
            if not new_table:
                rows = _not_stored(rows, path, list(dedupe_keys))
            rows = without_repeats(rows, list(dedupe_keys))
        n = _write(rows, path, "append")
        if n == 0 and new_table:
            FS.delete(spark, path)
    return _imported(n)


def stored_keys(spark: SparkSession, path: str, keys: list[str], years: list[int] | None = None) -> DataFrame:
    """The distinct stored keys; ``years`` prunes the partitions that are read."""
    table = read_observations(spark, path)
    if years is not None:
        table = table.filter(F.col(PARTITION_COL).isin(years))
    return table.select(*keys, PARTITION_COL).distinct()


def _not_stored(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The rows whose key is not stored yet."""
    spark = rows.sparkSession
    if "DATE" not in keys:
        stored = stored_keys(spark, path, keys).drop(PARTITION_COL)
        return _without(rows, stored, keys)
    batch = materialize(rows.select(*keys, PARTITION_COL).distinct(), "append-keys")
    years = _years(batch)
    keyindex.refresh(spark, path, TABLE_SCHEMA, PARTITION_COL, keys, years)
    batch = keyindex.with_maybe_stored(batch, path, PARTITION_COL, keys, years)
    maybe = batch.filter("_maybe").drop("_maybe")
    fresh = batch.filter("not _maybe").drop("_maybe")
    years = _years(maybe)
    if years:
        known = _without(maybe, stored_keys(spark, path, keys, years), [*keys, PARTITION_COL])
        fresh = materialize(fresh.unionByName(known), "new-keys")
    if fresh.isEmpty():
        return rows.limit(0)
    return _with_keys(rows, fresh, keys)


def _years(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.select(PARTITION_COL).distinct().collect())


def _without(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return _with_keys(rows, stored, keys, "left_anti")


def _with_keys(rows: DataFrame, keyed: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose key (NULL keys compare equal) is in ``keyed``; with ``left_anti`` those whose key is not."""
    keyed = keyed.select(*[F.col(k).alias(f"_key_{k}") for k in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return rows.join(keyed, same, how)


def _imported(n: int) -> WriteResult:
    return WriteResult(n > 0, n, f"Successfully imported {n} rows." if n else "No rows to import.")


def append_batch(df: DataFrame, path: str, tag: str, floor=None) -> WriteResult:
    """Append one batch so that a replay lands once (ST1).

    The batch is written to a hidden folder of the table, its files are moved
    into the year folders under names that begin with ``tag``, and its entry
    is made in the table's ledger, all under the table's lock. A replay of a
    batch in the ledger changes nothing, whatever has happened to its rows
    since (a purge rewrites files); it reports the rows that the batch landed.
    The driver moves a few files per year of the batch and reads none.
    """
    spark = df.sparkSession
    root = path.rstrip("/")
    staging = f"{root}/_batch-{tag}"
    with table_lock(spark, path):
        before = _landed(spark, path, tag)
        if before is not None:
            return _imported(before)
        n = _write(to_stored(df, floor), staging, "overwrite")
        for year in FS.partition_values(spark, staging, PARTITION_COL):
            folder = f"{PARTITION_COL}={year}"
            FS.make_dirs(spark, f"{root}/{folder}")
            for f in FS.list_files(spark, f"{staging}/{folder}", ".parquet"):
                FS.rename(spark, f.path, f"{root}/{folder}/{tag}-{f.name}")
        FS.make_dirs(spark, _ledger(path))
        FS.create_new(spark, f"{_ledger(path)}/{tag}.rows-{n}")
        FS.delete(spark, staging)
    return _imported(n)


def _replace_years(rows: DataFrame, path: str) -> None:
    """Put ``rows`` in place of their years; the old folders stay until the new ones are in place."""
    spark, root, mark = rows.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    staged, old = f"{root}/_purge-{mark}", f"{root}/_old-{mark}"
    _write(rows, staged, "overwrite")
    FS.make_dirs(spark, old)
    for year in FS.partition_values(spark, staged, PARTITION_COL):
        folder = f"{PARTITION_COL}={year}"
        FS.rename(spark, f"{root}/{folder}", f"{old}/{folder}")
        FS.rename(spark, f"{staged}/{folder}", f"{root}/{folder}")
    FS.delete(spark, old)
    FS.delete(spark, staged)


def _drop_year(spark: SparkSession, path: str, year: int | None) -> None:
    value = NULL_PARTITION if year is None else year
    FS.delete(spark, f"{path.rstrip('/')}/{PARTITION_COL}={value}")


def purge(spark: SparkSession, path: str, condition: Column,
          scope: Column | None = None) -> WriteResult:
    """Delete rows matching ``condition`` (NULL counts as no match).

    ``scope`` is an optional predicate on ``YEAR`` that bounds the
    partitions examined (partition pruning). One grouped count tells, per
    year, how many rows go and whether any stay (one row per year reaches the
    driver). Years that lose all rows are dropped; the others are written to a
    hidden folder first, and a year's old folder is kept until the new one is
    in its place. After an interruption the next writer puts back a year that
    was moved away; run the purge again and it finishes what is left.
    """
    with table_lock(spark, path):
        table = read_observations(spark, path)
        cond = F.coalesce(condition, F.lit(False))
        examined = table.filter(scope) if scope is not None else table
        per_year = (examined.groupBy(PARTITION_COL)
                    .agg(F.count_if(cond).alias("gone"), F.count(F.lit(1)).alias("rows"))
                    .filter("gone > 0").collect())
        rewritten = [r[PARTITION_COL] for r in per_year if r["gone"] < r["rows"]]
        if rewritten:
            year = F.col(PARTITION_COL)
            chosen = year.isin([y for y in rewritten if y is not None])
            if None in rewritten:
                chosen = F.coalesce(chosen, F.lit(False)) | year.isNull()
            _replace_years(table.filter(chosen).filter(~cond), path)
        for r in per_year:
            if r["gone"] == r["rows"]:
                _drop_year(spark, path, r[PARTITION_COL])
    removed = sum(r["gone"] for r in per_year)
    return WriteResult(True, removed, f"Deleted {removed} rows." if removed else "No rows matched.")


def purge_suspect_temperatures(spark: SparkSession, path: str) -> WriteResult:
    """Delete rows with implausible temperatures."""
    return purge(spark, path, suspect_temperature_condition())


def purge_before(spark: SparkSession, path: str, floor) -> WriteResult:
    """Delete rows dated before ``floor``.

    Years wholly before the floor are counted from the file footers and
    dropped; only the floor's own year is examined and rewritten.
    """
    floor = _as_date(floor)
    with table_lock(spark, path):
        early = (read_observations(spark, path).filter(F.col(PARTITION_COL) < floor.year)
                 .groupBy(PARTITION_COL).count().collect())
        for r in early:
            _drop_year(spark, path, r[PARTITION_COL])
    dropped = sum(r["count"] for r in early)
    rest = purge(spark, path, F.col("DATE") < F.lit(floor), scope=F.col(PARTITION_COL) == floor.year)
    removed = dropped + rest.rows
    return WriteResult(True, removed, f"Deleted {removed} rows." if removed else "No rows matched.")


def count_before(spark: SparkSession, path: str, floor) -> DataFrame:
    """Rows dated before ``floor`` as a one-row frame (P8 count), pruned to
    the early partitions."""
    floor = _as_date(floor)
    return (read_observations(spark, path).filter(F.col(PARTITION_COL) <= floor.year)
            .filter(F.col("DATE") < F.lit(floor)).agg(F.count(F.lit(1)).alias("n_rows")))


def rebuild_from_clean_files(spark: SparkSession, clean_pattern: str, path: str,
                             floor=None, fallback: str | None = None) -> WriteResult:
    """Rebuild the table from every cleaned CSV file (S9); ``fallback`` is
    read when the main location holds no file.

    The new table is written beside the old one and takes its place only when
    it holds rows; an empty result leaves the old table as it was.
    """
    clean = _csv().read_clean_dir(spark, clean_pattern, fallback)
    if clean is None:
        return WriteResult(False, 0, "No CSV files found.")
    root = path.rstrip("/")
    fresh, old = (f"{root}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    result = append_observations(clean, fresh, floor)
    if not result.ok:
        return WriteResult(False, 0, "No rows in the CSV files: the table is unchanged.")
    with table_lock(spark, path):
        if FS.exists(spark, path):
            FS.rename(spark, root, old)
        FS.rename(spark, fresh, root)
        if FS.exists(spark, _ledger(old)):  # landed batches stay landed
            FS.rename(spark, _ledger(old), _ledger(root))
        FS.delete(spark, old)
    return result


def import_latest(spark: SparkSession, raw_pattern: str, path: str, floor=None,
                  clean_out: str | None = None) -> WriteResult:
    """Clean the newest raw import, one file or a folder of part files, and
    append it (S10); optionally keep the cleaned copy as CSV (S6), compressed
    when the import is. Writes nothing when cleaning yields no rows."""
    from ..operators.clean import clean_observations, missing_required
    csvmod = _csv()
    latest = csvmod.latest_import(spark, raw_pattern)
    if not latest:
        return WriteResult(False, 0, "No CSV files found.")
    raw = csvmod.read_raw(spark, latest)
    if missing_required(raw):
        return WriteResult(False, 0, f"Missing required columns: {sorted(missing_required(raw))}")
    clean = clean_observations(raw, floor)
    if clean_out:
        # One pass cleans, counts and writes; the copy takes its place only when it holds rows.
        kept, fresh = Observation("cleaned"), f"{clean_out.rstrip('/')}.new-{uuid.uuid4().hex}"
        csvmod.write_csv(clean.observe(kept, F.count(F.lit(1)).alias("rows")), fresh, compressed=latest[0].endswith(".gz"))
        if not kept.get.get("rows", 0):
            FS.delete(spark, fresh)
            return _imported(0)
        FS.delete(spark, clean_out)
        FS.rename(spark, fresh, clean_out)
        clean = csvmod.read_clean_dir(spark, clean_out)
    return append_observations(_stations_together(clean), path, floor)


def _stations_together(rows: DataFrame) -> DataFrame:
    """The rows of each partition by station: rows that are alike lie together in
    the shuffle's files, which compress the better. The non-deterministic column
    is an optimizer barrier: a sort below a rebalance would be taken out."""
    return (rows.sortWithinPartitions("NAME", "DATE").withColumn("_barrier", F.spark_partition_id())
            .filter("_barrier >= 0").drop("_barrier"))


def _csv():
    from . import csv as csvmod
    return csvmod
