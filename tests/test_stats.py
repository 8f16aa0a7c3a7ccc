import numpy as np
import pytest
from pyspark.sql import functions as F

from stratus.operators import stats as ST


def _frame(spark, groups):
    rows = [(g, float(v)) for g, vals in groups.items() for v in vals]
    return spark.createDataFrame(rows, "g string, v double")


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    groups = {
        "hot": rng.normal(0, 10, 3000).round(1),          # one group holds most rows
        "ties": np.array([5.0] * 50 + [7.0] * 3),
        "one": np.array([42.0]),
        "two": np.array([1.0, 2.0]),
        "skew": np.concatenate([np.zeros(500), rng.exponential(100, 30)]),
    }
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    out = ST.exact_quantiles(_frame(spark, groups), ["g"], "v", probs,
                             [f"p{i}" for i in range(len(probs))], bins=16)
    got = {r.g: r for r in out.collect()}
    for g, vals in groups.items():
        expect = np.quantile(vals, probs)
        for i, e in enumerate(expect):
            assert got[g][f"p{i}"] == pytest.approx(e, rel=1e-9, abs=1e-9), (g, probs[i])


def test_box_statistics_whiskers(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    out = ST.box_statistics(_frame(spark, {"a": vals}), ["g"], "v").first()
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    iqr = q3 - q1
    assert (out.q1, out.median, out.q3) == (q1, 5.0, q3)
    assert out.lower_whisker == min(v for v in vals if v >= q1 - 1.5 * iqr)
    assert out.upper_whisker == max(v for v in vals if v <= q3 + 1.5 * iqr)
    assert out.n_outliers == 1 and out.n == 9


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    cells = {(r.COL_A, r.COL_B): r.CORR
             for r in ST.correlation_matrix(df, ["a", "b"], impute=False).collect()}
    assert cells[("a", "b")] is None and cells[("b", "a")] is None
    assert cells[("a", "a")] == 1.0 and cells[("b", "b")] is None


def test_correlation_symmetric_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = 0.5 * x + rng.normal(size=200)
    z = rng.normal(size=200)
    rows = [(float(a), float(b), float(c) if i % 5 else None) for i, (a, b, c) in
            enumerate(zip(x, y, z))]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    cells = {(r.COL_A, r.COL_B): r.CORR for r in ST.correlation_matrix(df, ["x", "y", "z"]).collect()}
    assert len(cells) == 9
    assert cells[("x", "y")] == cells[("y", "x")]
    assert cells[("x", "y")] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)
    zf = np.array([r[2] for r in rows], dtype=float)
    zf[np.isnan(zf)] = np.nanmean(zf)
    assert cells[("x", "z")] == pytest.approx(np.corrcoef(x, zf)[0, 1], abs=1e-6)


def test_impute_means(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "a double")
    assert sorted(r.a for r in ST.impute_means(df, ["a"]).collect()) == [1.0, 2.0, 3.0]


def test_box_statistics_approximate_close(spark):
    rng = np.random.default_rng(11)
    vals = rng.normal(100, 15, 5000).round(2)
    df = _frame(spark, {"a": vals})
    exact = ST.box_statistics(df, ["g"], "v").first()
    approx = ST.box_statistics(df, ["g"], "v", approximate=True).first()
    assert exact.n == approx.n == 5000
    for k in ("q1", "median", "q3"):
        assert abs(getattr(exact, k) - getattr(approx, k)) < 1.0


@pytest.mark.parametrize("bins", [1, 2, 3, 7, 1024])
def test_exact_quantiles_any_bin_count(spark, bins):
    rng = np.random.default_rng(bins)
    groups = {f"g{i}": rng.integers(-50, 50, rng.integers(1, 60)).astype(float) for i in range(12)}
    probs = (0.0, 0.25, 0.33, 0.5, 0.75, 0.99, 1.0)
    names = [f"p{i}" for i in range(len(probs))]
    got = {r.g: r for r in ST.exact_quantiles(_frame(spark, groups), ["g"], "v", probs, names,
                                              bins=bins).collect()}
    for g, vals in groups.items():
        for i, e in enumerate(np.quantile(vals, probs)):
            assert got[g][names[i]] == pytest.approx(e, abs=1e-9), (g, probs[i], bins)


def test_exact_quantiles_split_crowded_bins(spark):
    rng = np.random.default_rng(21)
    # one far outlier crowds every other value into the first bin
    groups = {"a": np.concatenate([rng.normal(50, 5, 400).round(3), [1e9]]),
              "b": rng.integers(0, 30, 80).astype(float)}
    probs = (0.1, 0.5, 0.9)
    names = ["p10", "p50", "p90"]
    counts = ST.value_counts(_frame(spark, groups), ["g"], "v")
    got = {r.g: r for r in ST.quantiles_from_counts(counts, ["g"], probs, names, bins=8,
                                                    max_bin_values=20).collect()}
    for g, vals in groups.items():
        for name, e in zip(names, np.quantile(vals, probs)):
            assert got[g][name] == pytest.approx(e, abs=1e-9), (g, name)


def test_all_distinct_values_keep_few_rows(spark, monkeypatch):
    """No per-value table: the second pass keeps only values near the wanted ranks."""
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(0, 1e6, 60_000), "b": rng.exponential(3, 900), "c": [1.5]}
    kept = {}
    real = ST.materialize

    def counted(df, label="stage"):
        out = real(df, label)
        kept.setdefault(label, []).append(out.count())
        return out
    monkeypatch.setattr(ST, "materialize", counted)
    df = spark.createDataFrame([(g, float(v)) for g, vals in groups.items() for v in vals], "g string, v double")
    got = {r.g: r for r in ST.box_statistics(df, ["g"], "v").collect()}
    for g, vals in groups.items():
        q1, q2, q3 = np.quantile(vals, [0.25, 0.5, 0.75])
        assert (got[g].q1, got[g].median, got[g].q3) == pytest.approx((q1, q2, q3), rel=1e-12)
        fence = [v for v in vals if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
        assert (got[g].lower_whisker, got[g].upper_whisker) == (min(fence), max(fence))
        assert got[g].n == len(vals) and got[g].n_outliers == len(vals) - len(fence)
    assert max(kept["quantile-values"]) < 0.12 * 61_000


def test_ranks_that_a_sketch_misses_are_found(spark):
    """With bounds that hold no rank the whole range is searched; the result stays exact."""
    rng = np.random.default_rng(6)
    vals = rng.normal(0, 5, 4000)
    df = _frame(spark, {"a": vals, "n": [float("nan"), 1.0, 2.0]})
    sketches = ST.materialize(ST.value_sketches(df, ["g"], "v", 8))
    out = ST._from_sketches(df, sketches, ["g"], "v", (0.1, 0.5), ["a", "b"], bins=16, max_bin_values=50, slack=-0.4)
    got = {r.g: r for r in out.collect()}
    assert (got["a"].a, got["a"].b) == pytest.approx(tuple(np.quantile(vals, [0.1, 0.5])), rel=1e-12)
    assert got["n"].b == 2.0
