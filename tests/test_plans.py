"""Plan-shape checks: the physical choices the design depends on."""

from pyspark.sql import functions as F

from stratus.operators import clean as C
from stratus.operators.joins import estimated_bytes, sized_broadcast
from stratus.sources import adapter as AD


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_size_estimate_and_bounded_broadcast(spark, sf_small):
    region = AD.read_table(spark, sf_small, "region")
    assert estimated_bytes(region) > 0
    small = region.join(sized_broadcast(region.select("r_regionkey")), "r_regionkey")
    assert "BroadcastHashJoin" in _plan(small)
    hint = sized_broadcast(spark.range(10), max_bytes=1)
    assert "broadcast" not in hint._jdf.queryExecution().logical().toString().lower()


def test_station_side_is_the_broadcast_side(spark, sf_small):
    plan = _plan(AD.observations(spark, sf_small))
    line = [ln for ln in plan.splitlines() if "l_suppkey" in ln and "BroadcastHashJoin" in ln][0]
    assert "BuildRight" in line


def test_cleaning_filter_is_not_pushed_into_the_scan(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([("A", "2020-01-01", "1", "2", "3", "N", "5")],
                          "STATION string, DATE string, LATITUDE string, LONGITUDE string, "
                          "ELEVATION string, NAME string, TMAX string").write.parquet(path)
    out = C.clean_observations(spark.read.parquet(path), "2000-01-01")
    optimized = out._jdf.queryExecution().optimizedPlan().toString()
    filters = [ln for ln in optimized.splitlines() if ln.lstrip(" +-:").startswith("Filter")]
    # one row filter, over the typed flags, not over inlined parse expressions
    assert len(filters) == 1 and "RLIKE" not in filters[0].upper()
    assert out.count() == 1


def test_exact_quantiles_never_sort_a_whole_group(spark, monkeypatch):
    """Ranks are narrowed until their ranges hold few values; only those are sorted."""
    import numpy as np

    from stratus.operators import stats as ST
    values = np.concatenate([np.arange(3000) / 1000, [1e100, 1e300, -1e300]])
    df = spark.createDataFrame([("hot", float(v)) for v in values], "g string, v double")
    sizes = []
    inside = ST._inside

    def spy(counts, spans, g):
        out = inside(counts, spans, g)
        sizes.append(max(r["count"] for r in out.groupBy("_lo", "_hi").count().collect()))
        return out
    monkeypatch.setattr(ST, "_inside", spy)
    counts = ST.value_counts(df, ["g"], "v")
    q = ST.quantiles_from_counts(counts, ["g"], (0.25, 0.5), ["a", "b"], bins=16, max_bin_values=40).first()
    assert [q.a, q.b] == [float(x) for x in np.quantile(values, (0.25, 0.5))]
    assert sizes[0] == len(values) and sizes[-1] <= 40  # the last ones are those that are sorted


def _scans(df) -> list[str]:
    return [ln for ln in _plan(df).splitlines() if "FileScan parquet" in ln]


def test_queries_read_only_the_columns_they_use(spark, sf_small):
    import __spark_entry__ as E
    for name, columns in (("filtered_summary", {"l_suppkey", "l_shipdate"}),
                          ("rain_days", {"l_suppkey", "l_shipdate", "l_linestatus"})):
        facts = [s for s in _scans(E.queries()[name](spark, sf_small)) if "l_suppkey" in s]
        assert len(facts) == 1
        read = facts[0].split("ReadSchema: struct<")[1].split(">")[0]
        assert {c.split(":")[0] for c in read.split(",")} == columns


def test_station_series_scan_the_facts_once_by_key(spark, sf_small):
    import __spark_entry__ as E
    for name in ("rain_days", "snow_days", "temp_lines_long", "sunny_days", "station_temperature_metrics"):
        facts = [s for s in _scans(E.queries()[name](spark, sf_small)) if "l_suppkey" in s]
        assert len(facts) == 1 and "EqualTo(l_suppkey" in facts[0]


def test_snow_charts_push_the_year(spark, sf_small):
    from stratus.operators import aggregates as A
    facts = [s for s in _scans(A.station_year_snow(AD.observations(spark, sf_small), 2000)) if "l_suppkey" in s]
    assert len(facts) == 1 and "l_shipdate" in facts[0].split("PushedFilters: ")[1].split("ReadSchema")[0]
    assert "l_extendedprice" not in facts[0]


def test_scratch_needs_a_shared_folder_off_local(spark, monkeypatch):
    import pytest

    from stratus import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Fake())


def test_a_finished_query_leaves_nothing(spark, sf_small):
    import os

    import __spark_entry__ as E
    from stratus import session
    for name in ("snow_share", "append_roundtrip"):
        E.queries()[name](spark, sf_small).collect()
    assert os.listdir(session.scratch_root(spark))
    session.clean_scratch(spark)
    assert not os.path.exists(session.scratch_root(spark))
