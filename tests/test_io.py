import datetime as dt
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from stratus.operators import clean as C
from stratus.sources import csv as CSV
from stratus.sources import store as ST
from stratus.streaming import ingest as IN


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_header_order_is_respected(spark, tmp_path):
    _write(str(tmp_path / "raw" / "a.csv"), "STATION,DATE,TMAX\nA,2020-01-01,5\n")
    _write(str(tmp_path / "raw" / "b.csv"), "DATE,STATION,TMIN,TMAX\n2020-01-02,B,1,6\n")
    df = CSV.read_raw_dir(spark, str(tmp_path / "raw"))
    got = sorted((r.STATION, r.DATE, r.TMAX, r.TMIN) for r in df.collect())
    assert got == [("A", "2020-01-01", "5", None), ("B", "2020-01-02", "6", "1")]


def test_latest_file_and_manifest(spark, tmp_path):
    _write(str(tmp_path / "old.csv"), "STATION\nA\n")
    time.sleep(0.05)
    _write(str(tmp_path / "new.csv"), "STATION\nB\n")
    os.utime(str(tmp_path / "old.csv"), (1, 1))
    assert CSV.latest_csv(spark, str(tmp_path)).endswith("new.csv")
    df = CSV.read_raw(spark, [str(tmp_path / "old.csv"), str(tmp_path / "new.csv")])
    assert sorted(r.file_name for r in CSV.file_manifest(df).collect()) == ["new.csv", "old.csv"]


def _obs(spark):
    rows = [("S1", dt.date(1999, 5, 1), "N1", 100.0, 50.0, 600.0),
            ("S1", dt.date(2000, 5, 1), "N1", 100.0, -600.0, 90.0),
            ("S2", dt.date(2000, 6, 1), "N2", None, 10.0, 20.0),
            ("S2", dt.date(2001, 6, 1), "N2", 10.0, None, None)]
    return spark.createDataFrame(rows, "STATION string, DATE date, NAME string, TAVG double, "
                                       "TMIN double, TMAX double")


def test_append_purge_roundtrip(spark, tmp_path):
    path = str(tmp_path / "table")
    ST.ensure_table(spark, path)
    assert ST.read_observations(spark, path).count() == 0
    res = ST.append_observations(_obs(spark), path)
    assert res.rows == 4
    t = ST.read_observations(spark, path)
    assert t.count() == 4 and t.filter(F.col("CITY_NAME").isNotNull()).count() == 0
    removed = ST.purge_suspect_temperatures(spark, path)
    assert removed.rows == 2   # TMAX 600 (1999) and TMIN -600 (2000)
    left = ST.read_observations(spark, path)
    assert sorted(r.DATE.year for r in left.collect()) == [2000, 2001]
    assert not os.path.exists(os.path.join(path, "YEAR=1999"))   # emptied partition removed
    assert ST.purge_before(spark, path, "2001-01-01").rows == 1
    assert [r.DATE.year for r in ST.read_observations(spark, path).collect()] == [2001]
    assert ST.count_before(spark, path, "2002-01-01").first().n_rows == 1


def test_append_dedupe(spark, tmp_path):
    path = str(tmp_path / "table")
    ST.append_observations(_obs(spark), path)
    again = ST.append_observations(_obs(spark), path, dedupe_keys=("STATION", "DATE"))
    assert again.rows == 0
    assert ST.read_observations(spark, path).count() == 4


def test_import_latest_and_rebuild(spark, tmp_path):
    raw = str(tmp_path / "raw")
    _write(os.path.join(raw, "x.csv"),
           "STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,NAME,TMAX,TMIN\n"
           "A, 2020-01-01,1,2,3,N,10,\nA,2020-01-02,1,2,3,N,,\n")
    path = str(tmp_path / "table")
    res = ST.import_latest(spark, raw, path, floor="2000-01-01",
                           clean_out=str(tmp_path / "clean"))
    assert res.ok and res.rows == 1
    r = ST.read_observations(spark, path).first()
    assert (r.STATION, r.TAVG, r.TMAX) == ("A", 10.0, 10.0)
    res = ST.rebuild_from_clean_files(spark, str(tmp_path / "clean" / "*.csv"), path)
    assert res.rows == 1 and ST.read_observations(spark, path).count() == 1


def test_stream_ingest_once(spark, tmp_path):
    raw = str(tmp_path / "in")
    header = "STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,NAME,TMAX,TMIN\n"
    _write(os.path.join(raw, "f1.csv"), header + "A,2020-01-01,1,2,3,N,10,4\n")
    table, ckpt = str(tmp_path / "t"), str(tmp_path / "ck")
    assert IN.ingest(spark, raw, table, ckpt) == IN.IngestResult(1, 1, 1)
    _write(os.path.join(raw, "f2.csv"), header + "B,2020-01-02,1,2,3,M,bad,\nB,x,1,2,3,M,1,\n")
    assert IN.ingest(spark, raw, table, ckpt) == IN.IngestResult(1, 1, 1)
    assert IN.ingest(spark, raw, table, ckpt).files == 0
    got = ST.read_observations(spark, table).select("STATION", "TAVG").collect()
    # 'bad' is text in a data column: the row survives the no-data check and
    # the value becomes NULL; the row with date 'x' is dropped.
    assert sorted((r.STATION, str(r.TAVG)) for r in got) == [("A", "7.0"), ("B", "None")]
    # the streamed table equals the batch cleaning of the same files
    batch = C.clean_observations(CSV.read_raw_dir(spark, raw))
    assert sorted(batch.select("STATION", "DATE").collect()) == sorted(
        ST.read_observations(spark, table).select("STATION", "DATE").collect())


def test_stream_reads_columns_by_name(spark, tmp_path):
    raw = str(tmp_path / "in")
    _write(os.path.join(raw, "a.csv"), "STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,NAME,TMAX,TMIN\nA,2020-01-01,1,2,3,N,100,10\n")
    _write(os.path.join(raw, "b.csv"), "STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,NAME,TMIN,TMAX\nB,2020-01-01,1,2,3,N,10,100\n")
    IN.ingest(spark, raw, str(tmp_path / "t"), str(tmp_path / "ck"))
    rows = ST.read_observations(spark, str(tmp_path / "t")).collect()
    assert [(r.TMIN, r.TMAX) for r in rows] == [(10.0, 100.0)] * 2


def test_stream_then_append_then_purge_share_one_table(spark, tmp_path):
    raw, table = str(tmp_path / "in"), str(tmp_path / "t")
    header = "STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,NAME,TMAX,TMIN\n"
    _write(os.path.join(raw, "f.csv"), header + "A,1999-01-01,1,2,3,N,10,4\n")
    IN.ingest(spark, raw, table, str(tmp_path / "ck"))
    assert ST.append_observations(_obs(spark), table).rows == 4
    assert ST.read_observations(spark, table).count() == 5
    assert ST.purge_suspect_temperatures(spark, table).rows == 2
    _write(os.path.join(raw, "g.csv"), header + "B,1999-02-01,1,2,3,N,10,4\n")
    IN.ingest(spark, raw, table, str(tmp_path / "ck"))
    assert sorted(r.STATION for r in ST.read_observations(spark, table).filter("YEAR = 1999").collect()) == ["A", "B"]


def test_replayed_batch_lands_once(spark, tmp_path):
    table = str(tmp_path / "t")
    for _ in range(3):
        assert ST.append_batch(_obs(spark), table, "src-0").rows == 4
    ST.append_batch(_obs(spark), table, "src-1")
    assert ST.read_observations(spark, table).count() == 8
    assert not [f for f in os.listdir(table) if f.startswith("_batch")]


def test_ingest_timeout_raises(spark, tmp_path):
    raw = str(tmp_path / "in")
    _write(os.path.join(raw, "f.csv"), "STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,NAME,TMAX\nA,2020-01-01,1,2,3,N,5\n")
    with pytest.raises(TimeoutError):
        IN.ingest(spark, raw, str(tmp_path / "t"), str(tmp_path / "ck"), timeout_s=0.001)


def test_rows_without_date_are_never_stored(spark, tmp_path):
    path = str(tmp_path / "t")
    undated = _obs(spark).withColumn("DATE", F.when(F.col("NAME") == "N1", F.col("DATE")))
    assert ST.append_observations(undated, path).rows == 2
    assert ST.purge_suspect_temperatures(spark, path).rows == 2
    assert ST.purge_suspect_temperatures(spark, path).rows == 0


def test_purge_of_an_undated_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    old = ST.to_stored(_obs(spark)).withColumn("DATE", F.lit(None).cast("date")).withColumn("YEAR", F.lit(None).cast("int"))
    old.write.partitionBy("YEAR").parquet(path)
    assert ST.purge_suspect_temperatures(spark, path).rows == 2
    assert ST.read_observations(spark, path).count() == 2
    assert ST.purge(spark, path, F.lit(True)).rows == 2 and ST.read_observations(spark, path).count() == 0


def test_one_writer_at_a_time(spark, tmp_path):
    path = str(tmp_path / "t")
    with ST.table_lock(spark, path):
        with pytest.raises(RuntimeError, match="another job"):
            ST.append_observations(_obs(spark), path)
    assert ST.append_observations(_obs(spark), path).ok


def test_a_year_is_few_files_and_a_hot_year_is_split(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 8).select(
        F.col("id").cast("string").alias("STATION"), F.date_add(F.lit("1990-01-01"), (F.col("id") % 3650).cast("int")).alias("DATE"),
        F.lit("N").alias("NAME"), F.col("id").cast("double").alias("TMAX"))
    ST.append_observations(rows, str(tmp_path / "t"))
    files = [f for _, _, names in os.walk(str(tmp_path / "t")) for f in names if f.endswith(".parquet")]
    assert len(files) <= 20  # ten years, written by eight tasks
    hot = spark.range(0, 200_000, 1, 8).select(F.uuid().alias("STATION"), F.lit(dt.date(2000, 1, 1)).alias("DATE"), F.uuid().alias("NAME"))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        ST.append_observations(hot, str(tmp_path / "h"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert len([f for f in os.listdir(str(tmp_path / "h" / "YEAR=2000")) if f.endswith(".parquet")]) > 1


def test_empty_rebuild_keeps_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    ST.append_observations(_obs(spark), path)
    CSV.write_csv(_obs(spark), str(tmp_path / "clean"))
    res = ST.rebuild_from_clean_files(spark, str(tmp_path / "clean"), path, floor="2100-01-01")
    assert not res.ok and ST.read_observations(spark, path).count() == 4
    assert sorted(os.listdir(str(tmp_path))) == ["clean", "t"]


def test_dedupe_picks_the_same_row_and_compares_null_keys(spark, tmp_path):
    rows = [("A", dt.date(2000, 1, 1), None, v) for v in (3.0, 1.0, 2.0)] + [(None, dt.date(2000, 1, 1), None, 5.0)] * 2
    df = spark.createDataFrame(rows, "STATION string, DATE date, NAME string, TMAX double")
    path = str(tmp_path / "t")
    keys = ("STATION", "DATE", "NAME")
    assert ST.append_observations(df.repartition(3), path, dedupe_keys=keys).rows == 2
    assert not ST.append_observations(df, path, dedupe_keys=keys).ok
    assert sorted((str(r.STATION), r.TMAX) for r in ST.read_observations(spark, path).collect()) == [("A", 1.0), ("None", 5.0)]


def test_empty_import_is_not_ok_and_writes_nothing(spark, tmp_path):
    raw = str(tmp_path / "raw")
    _write(os.path.join(raw, "x.csv"), "STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,NAME,TMAX\nA,bad,1,2,3,N,10\n")
    for clean_out in (None, str(tmp_path / "clean")):
        res = ST.import_latest(spark, raw, str(tmp_path / "t"), clean_out=clean_out)
        assert not res.ok and res.rows == 0
    assert os.listdir(str(tmp_path)) == ["raw"]


def test_rebuild_fallback_and_required_check(spark, tmp_path):
    fb = str(tmp_path / "fallback")
    _write(os.path.join(fb, "c.csv"), "STATION,DATE,NAME,TMAX\nA,2020-01-01,N,5\n")
    os.makedirs(str(tmp_path / "empty"), exist_ok=True)
    res = ST.rebuild_from_clean_files(spark, str(tmp_path / "empty"), str(tmp_path / "t"),
                                      fallback=fb)
    assert res.ok and res.rows == 1
    ok, why = C.check_required(spark.createDataFrame([("A",)], "STATION string"))
    assert not ok and "DATE" in why


def test_stream_backlog_in_bounded_batches(spark, tmp_path):
    raw = str(tmp_path / "in")
    header = "STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,NAME,TMAX\n"
    for i in range(3):
        _write(os.path.join(raw, f"f{i}.csv"), header + f"S{i},2020-01-0{i + 1},1,2,3,N,5\n")
    done = IN.ingest(spark, raw, str(tmp_path / "t"), str(tmp_path / "ck"), max_files_per_trigger=1)
    assert done == IN.IngestResult(3, 3, 3)


def test_purge_edge_cases(spark, tmp_path):
    path = str(tmp_path / "table")
    ST.append_observations(_obs(spark).filter(F.col("DATE") >= dt.date(2001, 1, 1)), path)
    assert ST.purge_suspect_temperatures(spark, path).rows == 0      # nothing matches
    assert ST.read_observations(spark, path).count() == 1
    assert ST.purge(spark, path, F.lit(True)).rows == 1              # everything matches
    assert ST.read_observations(spark, path).count() == 0
    assert not os.path.exists(os.path.join(path, "YEAR=2001"))


def test_append_empty_frame(spark, tmp_path):
    empty = C.clean_observations(spark.createDataFrame([("A",)], "STATION string"))
    res = ST.append_observations(empty, str(tmp_path / "t"))
    assert not res.ok and res.rows == 0
    floor_all = ST.append_observations(_obs(spark), str(tmp_path / "t2"), floor="2100-01-01")
    assert not floor_all.ok and os.listdir(str(tmp_path)) == []


def test_batch_replay_after_a_purge_lands_once(spark, tmp_path):
    table = str(tmp_path / "t")
    assert ST.append_batch(_obs(spark), table, "src-0").rows == 4
    assert ST.append_batch(_obs(spark), table, "src-0").rows == 4
    assert ST.purge_suspect_temperatures(spark, table).rows == 2
    assert ST.append_batch(_obs(spark), table, "src-0").rows == 4
    assert ST.read_observations(spark, table).count() == 2


def test_an_unfinished_batch_is_taken_out_before_the_next_change(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    ST.append_batch(_obs(spark), table, "src-0")
    real = ST.FS.create_new

    def stopped(sp, path):
        if "_ledger" in path:
            raise RuntimeError("stopped")
        return real(sp, path)
    monkeypatch.setattr(ST.FS, "create_new", stopped)
    with pytest.raises(RuntimeError, match="stopped"):
        ST.append_batch(_obs(spark), table, "src-1")
    monkeypatch.undo()
    assert ST.purge_suspect_temperatures(spark, table).rows == 2
    assert ST.append_batch(_obs(spark), table, "src-1").rows == 4
    assert ST.read_observations(spark, table).count() == 6
    assert not [f for f in os.listdir(table) if f.startswith(("_batch", "_purge", "_old"))]


@pytest.mark.parametrize("at", [1, 2])
def test_a_purge_stopped_between_its_moves_loses_nothing(spark, tmp_path, monkeypatch, at):
    table = str(tmp_path / "t")
    ST.append_observations(_obs(spark), table)
    real, calls = ST.FS.rename, []

    def stopped(sp, source, target):
        calls.append(source)
        if len(calls) == at + 1:
            raise OSError("stopped")
        real(sp, source, target)
    monkeypatch.setattr(ST.FS, "rename", stopped)
    some = F.col("TMAX") > 500
    affected = ST.read_observations(spark, table).filter(some).count()
    assert affected
    if ST.read_observations(spark, table).select("YEAR").distinct().count() >= at:
        try:
            ST.purge(spark, table, some)
        except OSError:
            pass
    monkeypatch.undo()
    ST.purge(spark, table, some)
    kept = ST.read_observations(spark, table)
    assert kept.count() == 4 - affected and kept.filter(some).count() == 0


def test_dedupe_reads_only_the_years_that_may_hold_a_key(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    day = F.date_add(F.lit("1999-01-01"), (F.col("id") % 900).cast("int"))
    rows = spark.range(3000).select(F.concat(F.lit("S"), (F.col("id") % 7).cast("string")).alias("STATION"), day.alias("DATE"),
                                    F.lit("N").alias("NAME"), F.col("id").cast("double").alias("TMAX"))
    ST.append_observations(rows, path, dedupe_keys=("STATION", "DATE"))
    n = ST.read_observations(spark, path).count()
    assert n == rows.select("STATION", "DATE").distinct().count()
    batch = rows.filter("DATE >= '2000-03-01' and DATE < '2000-04-01'")
    extra = batch.limit(9).withColumn("STATION", F.concat("STATION", F.lit("-new")))
    asked = []
    real = ST.stored_keys
    monkeypatch.setattr(ST, "stored_keys", lambda *a: asked.append(a[3]) or real(*a))
    assert ST.append_observations(extra, path, dedupe_keys=("STATION", "DATE")).rows == 9
    assert ST.append_observations(batch.union(extra), path, dedupe_keys=("STATION", "DATE")).rows == 0
    assert asked[-1] == [2000] and all(a == [2000] for a in asked)
    plan = real(spark, path, ["STATION", "DATE"], [2000])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(YEAR#\d+\), \(YEAR#\d+ = 2000\)\]", plan)
    # Files of another writer are covered too, and a purge leaves only harmless bits.
    plain = spark.sql("select 'P' as STATION, date'2000-05-05' as DATE, 'N' as NAME, 1d as TMAX")
    ST.append_observations(plain, path)
    assert ST.append_observations(plain, path, dedupe_keys=("STATION", "DATE")).rows == 0
    ST.purge(spark, path, F.col("STATION") == "P")
    assert ST.append_observations(plain, path, dedupe_keys=("STATION", "DATE")).rows == 1


def test_keys_without_a_date_look_at_the_whole_table(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda s, d: spark.sql(f"select {s} as STATION, date'{d}' as DATE, 'N' as NAME, 1d as TMAX")
    ST.append_observations(row("'A'", "1999-01-01"), path)
    assert ST.append_observations(row("'A'", "2001-01-01").union(row("null", "2001-01-02")), path, dedupe_keys=("STATION",)).rows == 1
    assert ST.append_observations(row("null", "2002-01-02"), path, dedupe_keys=("STATION",)).rows == 0
    assert ST.append_observations(row("null", "2001-01-02"), path, dedupe_keys=("STATION", "DATE")).rows == 0


def test_the_newest_import_may_be_a_folder(spark, tmp_path):
    raw = str(tmp_path / "in")
    rows = spark.range(40).selectExpr("cast(id as string) as STATION", "'2020-01-01' as DATE").repartition(4)
    _write(os.path.join(raw, "old", "x.csv"), "STATION,DATE\nA,2020-01-01\n")
    os.utime(os.path.join(raw, "old", "x.csv"), (1, 1))
    CSV.write_csv(rows, os.path.join(raw, "new"))
    found = CSV.latest_import(spark, os.path.join(raw, "*", "*.csv"))
    assert len(found) == 4 and CSV.read_raw(spark, found).count() == 40
    assert CSV.latest_import(spark, os.path.join(raw, "old"))[0].endswith("x.csv")
    os.makedirs(os.path.join(raw, "none"))
    assert CSV.latest_import(spark, os.path.join(raw, "none")) == []


def test_a_station_reads_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq
    path = str(tmp_path / "t")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "60000")
    try:
        rows = spark.range(0, 60_000, 1, 4).select(
            F.format_string("S%03d", F.col("id") % 300).alias("STATION"), F.format_string("N%03d", F.col("id") % 300).alias("NAME"),
            F.date_add(F.lit("2001-01-01"), (F.col("id") % 360).cast("int")).alias("DATE"), F.rand(1).alias("TMAX"))
        ST.append_observations(rows, path)
    finally:
        conf.unset("parquet.block.size")
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    groups, holding = 0, 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        name = meta.schema.names.index("NAME")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(name).statistics
            groups += 1
            holding += stats.min <= "N150" <= stats.max
    assert groups >= 8 and holding <= 2
    one = ST.read_observations(spark, path).filter("YEAR = 2001 and NAME = 'N150'")
    assert one.count() == 200
    assert "PushedFilters: [IsNotNull(NAME), EqualTo(NAME,N150)]" in one._jdf.queryExecution().executedPlan().toString()


def test_many_layouts_are_one_scan(spark, tmp_path, monkeypatch):
    import random
    rng = random.Random(4)
    names = ["STATION", "DATE", "NAME", "TMAX", "TMIN", "PRCP", "X Y"]
    want = []
    for i in range(120):
        header = rng.sample(names, rng.randint(2, 7))
        rows = [{c: rng.choice(["", " a ", "1,5", 'q"t', f"{c}{i}"]) for c in header} for _ in range(rng.randint(0, 3))]
        quote = lambda v: '"' + v.replace('"', '""') + '"' if "," in v else v.replace('"', "")
        lines = [",".join(header)] + [",".join(quote(r[c]) for c in header) for r in rows]
        _write(str(tmp_path / "in" / f"d {i % 3}" / f"f,{i}.csv"), ("\ufeff" if i % 9 == 0 else "") + "\n".join(lines) + "\n")
        want += [tuple((r.get(c) or "").replace('"', "") if "," not in (r.get(c) or "") else r[c] for c in names) for r in rows]
    _write(str(tmp_path / "in" / "d 0" / "empty.csv"), "")
    monkeypatch.setattr(CSV.FS, "read_first_line", lambda *a: pytest.fail("the driver opened a file"))
    df = CSV.read_raw_dir(spark, str(tmp_path / "in" / "*" / "*.csv"))
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r[c] or "" for c in names) for r in df.collect()]
    assert sorted(got) == sorted(want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan


def _stations(spark, year, names):
    return spark.createDataFrame([(n, dt.date(year, 1, 1 + i % 28), float(i)) for i, n in enumerate(names)],
                                 "NAME string, DATE date, TMAX double")


def test_profile_of_the_stored_table_comes_from_the_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    ST.ensure_table(spark, path)
    assert tuple(ST.stored_profile(spark, path, ["TMAX"]).first()) == (0, None, None, 0)
    ST.append_observations(_stations(spark, 2001, ["A", None, "B"]).withColumn("TMAX", F.nullif("TMAX", F.lit(1.0))), path)
    ST.append_observations(_stations(spark, 2003, ["C"]), path)
    whole = ST.stored_profile(spark, path, ["TMAX", "NAME"])
    assert tuple(whole.first()) == (4, dt.date(2001, 1, 1), dt.date(2003, 1, 1), 3, 3)
    years = ST.stored_profile(spark, path, by_year=True)
    assert sorted(map(tuple, years.collect())) == [(2001, 3, dt.date(2001, 1, 1), dt.date(2001, 1, 3)),
                                                   (2003, 1, dt.date(2003, 1, 1), dt.date(2003, 1, 1))]
    for frame in (whole, years):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PushedAggregation: \[[^\]]*COUNT\(\*\)[^\]]*MIN\(DATE\)", plan), plan


def test_station_sketches_follow_the_data_files(spark, tmp_path):
    path = str(tmp_path / "t")
    ST.ensure_table(spark, path)
    count = lambda a, b: tuple(ST.stored_station_count(spark, path, a, b).first())
    assert count(2000, 2010) == (0, 0)
    ST.append_observations(_stations(spark, 2001, [f"S{i % 40}" for i in range(100)]), path)
    ST.append_observations(_stations(spark, 2002, [f"S{i}" for i in range(20, 60)]), path)
    assert count(2001, 2001) == (40, 100) and count(2000, 2010) == (60, 140) and count(2003, 2010) == (0, 0)
    ST.append_observations(_stations(spark, 2002, [f"T{i}" for i in range(10)]), path)
    assert count(2002, 2002) == (50, 50)
    ST.purge(spark, path, F.col("NAME").startswith("T"))
    assert count(2002, 2002) == (40, 40) and count(2001, 2002) == (60, 140)
    ST.purge_before(spark, path, "2002-01-01")
    assert count(2000, 2010) == (40, 40)
    assert ST.read_observations(spark, path).count() == 40


def test_an_append_without_repeats_stages_keys_only(spark, tmp_path, monkeypatch):
    path, keys = str(tmp_path / "t"), ("STATION", "DATE")
    made = "STATION string, DATE string, NAME string, TMAX double"
    frame = lambda rows: spark.createDataFrame(rows, made).withColumn("DATE", F.col("DATE").cast("date"))
    ST.append_observations(frame([("s1", "2000-01-01", "a", 1.0), (None, "2000-01-01", "n", 2.0)]), path, dedupe_keys=keys)
    staged = []
    for module in (ST, ST.keyindex):
        real = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, label, real=real: staged.append(df.columns) or real(df, label))
    batch = [("s1", "2000-01-01", "b", 0.0), (None, "2000-01-01", "m", 0.0), ("s2", "2000-01-01", "d", 5.0),
             ("s2", "2000-01-01", "c", 6.0), (None, "2001-01-01", None, 3.0), ("s1", "1999-05-05", "a", None)]
    assert ST.append_observations(frame(batch), path, dedupe_keys=keys).rows == 3
    assert ST.append_observations(frame(batch), path, dedupe_keys=keys).rows == 0
    assert staged and all(set(c) <= {*keys, "YEAR", "_maybe"} for c in staged)
    out = ST.read_observations(spark, path).selectExpr("STATION", "cast(DATE as string)", "NAME", "TMAX").collect()
    assert sorted(map(tuple, out), key=repr) == sorted([
        ("s1", "2000-01-01", "a", 1.0), (None, "2000-01-01", "n", 2.0), ("s2", "2000-01-01", "c", 6.0),
        (None, "2001-01-01", None, 3.0), ("s1", "1999-05-05", "a", None)], key=repr)


def test_an_import_cleans_once_and_keeps_the_old_copy_when_no_row_counts(spark, tmp_path, monkeypatch):
    raw, clean, table = (str(tmp_path / x) for x in ("raw", "clean", "t"))
    cells = "'S' as STATION, '{}' as DATE, '1' as LATITUDE, '2' as LONGITUDE, '3' as ELEVATION, ' N\u00a0' as NAME, '5' as TMAX"
    # Rows are not asked for ahead of the write, which would read a file without good rows part by part.
    monkeypatch.setattr(type(spark.range(1)), "isEmpty", None)
    CSV.write_csv(spark.sql("select " + cells.format("2000-01-02")), raw)
    assert ST.import_latest(spark, raw, table, "1990-01-01", clean).rows == 1
    assert [r.NAME for r in ST.read_observations(spark, table).collect()] == ["N"]
    before = sorted(os.listdir(clean))
    CSV.write_csv(spark.sql("select " + cells.format("no date")), raw)
    done = ST.import_latest(spark, raw, table, "1990-01-01", clean)
    assert (done.ok, done.rows) == (False, 0)
    assert sorted(os.listdir(clean)) == before and sorted(os.listdir(tmp_path)) == ["clean", "raw", "t"]


def test_import_of_compressed_files(spark, tmp_path):
    """Raw ``.csv.gz`` files are imported whole; the clean copy is compressed too and can be rebuilt from."""
    raw, clean, table = (str(tmp_path / x) for x in ("raw", "clean", "t"))
    rows = spark.range(40).selectExpr(
        "concat('S', id % 7) as STATION", "date_add(date'2020-01-01', cast(id * 20 as int)) as DATE", "'1' as LATITUDE",
        "'2' as LONGITUDE", "'3' as ELEVATION", "if(id % 5 = 0, '', 'N') as NAME", "cast(id as string) as TMAX")
    CSV.write_csv(rows.repartition(3), raw, compressed=True)
    files = [f for f in os.listdir(raw) if not f.startswith((".", "_"))]
    assert len(files) == 3 and all(f.endswith(".csv.gz") for f in files)
    assert ST.import_latest(spark, raw, table, clean_out=clean).rows == 40
    assert all(f.endswith(".csv.gz") for f in os.listdir(clean) if f.startswith("part-"))
    got = ST.read_observations(spark, table).select("STATION", "DATE", "NAME", "TMAX").collect()
    want = [(f"S{i % 7}", dt.date(2020, 1, 1) + dt.timedelta(20 * i), None if i % 5 == 0 else "N", float(i)) for i in range(40)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert ST.rebuild_from_clean_files(spark, clean, table).rows == 40
    assert ST.read_observations(spark, table).count() == 40


def test_compressed_files_hold_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(CSV.COMPRESSED_OPTIONS, "maxRecordsPerFile", "10")
    CSV.write_csv(spark.range(0, 35, 1, 1), str(tmp_path / "x"), compressed=True)
    assert len(CSV.latest_import(spark, str(tmp_path / "x"))) == 4
    assert CSV.read_raw_dir(spark, str(tmp_path / "x")).count() == 35


def test_import_stages_less_than_its_text(spark, sf_small, monkeypatch):
    """The raw files are gone when the second ones are made, and none is plain text."""
    import __spark_entry__
    from stratus.plans import queries_io
    seen = []
    write = CSV.write_csv

    def spy(df, path, *args, **options):
        write(df, path, *args, **options)
        root = os.path.dirname(path.replace("file:", ""))
        seen.append({d: [f for f in os.listdir(os.path.join(root, d)) if f.startswith("part-")]
                     for d in os.listdir(root) if d in ("raw", "bad")})
    monkeypatch.setattr(queries_io.CSV, "write_csv", spy)
    out = {r.STEP: (r.OK, r.ROWS) for r in __spark_entry__.queries()["import_latest_result"](spark, sf_small).collect()}
    assert out["import"] == out["stored"] and out["import"][1] > 0 and out["empty"] == (False, 0)
    assert {"raw"} in [set(x) for x in seen] and {"bad"} in [set(x) for x in seen]
    assert not any({"raw", "bad"} <= set(x) for x in seen)
    assert all(f.endswith(".csv.gz") for x in seen for files in x.values() for f in files)


def test_raw_rows_of_many_stations_are_not_shuffled(spark, sf_small, tmp_path):
    from stratus.sources.adapter import raw_observations
    for name in ("nation", "region", "lineitem"):
        spark.read.parquet(f"{sf_small}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.range(400_000).selectExpr("id as s_suppkey", "concat('Supplier#', lpad(id, 9, '0')) as s_name",
                                    "cast(id % 25 as int) as s_nationkey", "1.0d as s_acctbal").write.parquet(
        str(tmp_path / "supplier.parquet"))
    raw = raw_observations(spark, str(tmp_path))
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert raw.count() == spark.read.parquet(str(tmp_path / "lineitem.parquet")).count()
