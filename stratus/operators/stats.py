"""Distribution statistics: exact quantiles, box statistics, imputation and
the all-pairs correlation matrix.

Exact quantiles are computed without ever gathering a group's rows in one
task. A first pass makes a mergeable quantile sketch of each group; it bounds
the value at every wanted rank. A second pass counts the rows below those bounds
and keeps, per distinct value, only the rows inside them, a few per cent of the
input however its values are spread. These are binned by value range, again and
again, until the ranges that hold the ranks are narrow, and only those are
ordered. Work per task is bounded by the distinct values of one range, not by
the rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import materialize
from .joins import sized_broadcast

QUARTILES = (0.25, 0.5, 0.75)
QUANTILE_BINS = 1024
MAX_BIN_VALUES = 1_000_000
#: Size of the quantile sketches, and how far from a rank their answers are taken
#: to lie: about three times the sketch's own rank error (2.296 / k ** 0.9723). A
#: rank that a sketch misses all the same is found in its group's whole range.
SKETCH_K = 800
SKETCH_SLACK = 0.01


def _qname(p: float) -> str:
    return "q" + f"{p:.6f}".rstrip("0").rstrip(".").replace("0.", "", 1).replace(".", "_")


def value_counts(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """Rows per (group, distinct non-NULL value): ``(*group_cols, _v, _c)``.

    The one pass over the input; map-side partial aggregation keeps a hot
    group from reaching the shuffle as rows.
    """
    v = F.col(value_col)
    return (df.filter(v.isNotNull()).groupBy(*group_cols, v.alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")))


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str,
                    probs=QUARTILES, names: list[str] | None = None,
                    bins: int = QUANTILE_BINS) -> DataFrame:
    """Exact linear-interpolation quantiles of ``value_col`` per group.

    Same definition as ``percentile`` / SQL ``quantile_cont``: for fraction
    p over n sorted values, position r = p·(n−1), result
    v[floor r] + (v[ceil r] − v[floor r])·(r − floor r). Groups with only
    NULL values yield no row. Group keys must be non-NULL.

    Eager: reads ``df`` twice; the sketches (one per group) and the counts of
    the values near the wanted ranks are written under
    ``spark.checkpoint.dir`` before the returned plan is built.
    """
    g = list(group_cols)
    return _from_sketches(df, materialize(value_sketches(df, g, value_col), "quantile-sketches"), g, value_col,
                          probs, names or [_qname(p) for p in probs], bins)


def value_sketches(df: DataFrame, group_cols: list[str], value_col: str, k: int = SKETCH_K) -> DataFrame:
    """Per group the sketch of its non-NULL values, their number and range."""
    v = F.col(value_col).cast("double")
    return df.filter(v.isNotNull()).groupBy(*group_cols).agg(
        F.kll_sketch_agg_double(v, F.lit(k)).alias("_s"), F.count(F.lit(1)).alias("_n"),
        F.min(v).alias("_min"), F.max(v).alias("_max"))


def sketched_quantiles(sketches: DataFrame, group_cols: list[str], probs, names: list[str]) -> DataFrame:
    """Approximate quantiles: the sketches' own answers."""
    return sketches.select(*group_cols, *[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(n)
                                          for p, n in zip(probs, names)])


def _from_sketches(df: DataFrame, sketches: DataFrame, g: list[str], value_col: str, probs, names: list[str],
                   bins: int = QUANTILE_BINS, max_bin_values: int = MAX_BIN_VALUES, slack: float = SKETCH_SLACK) -> DataFrame:
    # In a small group a rank is more than a little off its fraction: it is searched whole.
    small = F.col("_n") < 4 / abs(slack)

    def bound(p: float, edge: str) -> Column:
        return F.when(small, F.col(edge)).otherwise(
            F.kll_sketch_get_quantile_double("_s", F.lit(float(p))) if 0 < p < 1 else F.col(edge))
    wanted = []
    for p in probs:
        pos = F.lit(p) * (F.col("_n") - 1)
        wanted.append(F.struct(bound(p - slack, "_min").alias("_lo"), bound(p + slack, "_max").alias("_hi"),
                               F.array_distinct(F.array(F.floor(pos).cast("long"), F.ceil(pos).cast("long"))).alias("_ks")))
    spans = materialize(sketches.select(*g, "_n", "_min", "_max", F.explode(F.array(*wanted)).alias("_w"))
                        .select(*g, "_n", "_min", "_max", "_w.*"), "quantile-spans")
    need, counts = _near(df, spans, g, value_col)
    missed = need.filter(~_holds_rank())
    if not missed.isEmpty():
        whole = missed.select(*g, "_n", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), "_min", "_max",
                              F.array("_k").alias("_ks"))
        again, more = _near(df, materialize(whole.distinct(), "quantile-spans"), g, value_col)
        need, counts = need.filter(_holds_rank()).unionByName(again), counts.unionByName(more).distinct()
    need = materialize(need.select(*g, "_n", "_k", "_lo", "_hi", "_before", "_d").distinct(), "quantile-ranks")
    return _ranked(counts, need, g, probs, names, bins, max_bin_values)


def _holds_rank() -> Column:
    return (F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_inside"))


def _near(df: DataFrame, spans: DataFrame, g: list[str], value_col: str) -> tuple[DataFrame, DataFrame]:
    """One pass over ``df``: per wanted rank the rows below its span and in it,
    and the counts of the distinct values inside any span."""
    v, per_group = F.col(value_col).cast("double"), spans.groupBy(*g).agg(
        F.collect_set(F.struct("_lo", "_hi")).alias("_spans"))  # one entry per wanted quantile
    rows = (df.filter(v.isNotNull()).select(*g, v.alias("_x"))
            .join(sized_broadcast(per_group, rows_of=spans), on=g)
            .select(*g, "_x", F.explode("_spans").alias("_w")).filter(F.col("_x") <= F.col("_w._hi")))
    # Rows below a span meet in one group of the partial aggregation.
    picked = materialize(rows.groupBy(*g, "_w", F.when(F.col("_x") >= F.col("_w._lo"), F.col("_x")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")).select(*g, "_w.*", "_v", "_c"), "quantile-values")
    inside = F.col("_v").isNotNull()
    sums = picked.groupBy(*g, "_lo", "_hi").agg(
        F.coalesce(F.sum(F.when(~inside, F.col("_c"))), F.lit(0)).alias("_before"),
        F.coalesce(F.sum(F.when(inside, F.col("_c"))), F.lit(0)).alias("_inside"), F.count("_v").alias("_d"))
    need = spans.select(*g, "_n", "_min", "_max", "_lo", "_hi", F.explode("_ks").alias("_k")).join(
        sums, on=[*g, "_lo", "_hi"], how="left").fillna(0, ["_before", "_inside", "_d"])
    return materialize(need, "quantile-need"), picked.filter(inside).select(*g, "_v", "_c").distinct()


def _bin_of(bins: int) -> Column:
    """Bin of ``_v`` in the range [_lo, _hi], in halves so that the width of
    the widest range is finite."""
    width = F.col("_hi") / 2 - F.col("_lo") / 2
    place = (F.col("_v") / 2 - F.col("_lo") / 2) / width
    return F.when(width > 0, F.least(F.floor(place * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")


def quantiles_from_counts(counts: DataFrame, group_cols: list[str], probs=QUARTILES,
                          names: list[str] | None = None, bins: int = QUANTILE_BINS,
                          max_bin_values: int = MAX_BIN_VALUES) -> DataFrame:
    """Exact quantiles from per-value counts (see ``value_counts``).

    Every wanted rank starts with its group's whole value range. As long as
    some rank's range holds more than ``max_bin_values`` distinct values, the
    ranges are cut into bins and each rank goes on in the bin that holds it,
    narrowed to the bin's own least and greatest value; so outliers on any
    number of scales only cost further rounds (a range shrinks to a
    ``bins``-th of its width, or to fewer values, in each). Then only those
    ranges are ordered: the ordered work per task stays bounded.
    """
    g = list(group_cols)
    names = names or [_qname(p) for p in probs]
    ranges = counts.groupBy(*g).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                    F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"))
    pos = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[F.floor(r).cast("long") for r in pos],
                                     *[F.ceil(r).cast("long") for r in pos]))
    # (group, rank) with the value range that holds the rank, the rows before
    # that range and its distinct values; a few rows per group.
    need = materialize(ranges.select(*g, "_n", F.explode(ranks).alias("_k"), "_lo", "_hi",
                                     F.lit(0).cast("long").alias("_before"), "_d"), "quantile-ranks")
    return _ranked(counts, need, g, probs, names, bins, max_bin_values)


def _ranked(counts: DataFrame, need: DataFrame, g: list[str], probs, names: list[str], bins: int,
            max_bin_values: int) -> DataFrame:
    """The quantiles from the ranks' value ranges and the counted values inside them."""
    while not need.filter((F.col("_d") > max_bin_values) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        need = materialize(_narrowed(counts, need, g, bins), "quantile-ranks")
    spans = need.select(*g, "_lo", "_hi").distinct()
    inside = _inside(counts, spans, g)
    w = Window.partitionBy(*g, "_lo", "_hi").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = inside.withColumn("_end", F.sum("_c").over(w))
    hits = (ordered.join(sized_broadcast(need), on=g + ["_lo", "_hi"])
            .filter((F.col("_k") < F.col("_before") + F.col("_end"))
                    & (F.col("_k") >= F.col("_before") + F.col("_end") - F.col("_c")))
            .groupBy(*g).agg(F.first("_n").alias("_n"),
                             F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_m")))
    cols = []
    for p, name in zip(probs, names):
        r = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.floor(r).cast("long"), F.ceil(r).cast("long")
        vlo, vhi = F.col("_m")[lo], F.col("_m")[hi]
        cols.append((vlo + (vhi - vlo) * (r - lo)).alias(name))
    return hits.select(*g, *cols)


def _inside(counts: DataFrame, spans: DataFrame, g: list[str]) -> DataFrame:
    """The counted values of each group that lie in one of its spans."""
    return counts.join(sized_broadcast(spans), on=g).filter(
        (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def _narrowed(counts: DataFrame, need: DataFrame, g: list[str], bins: int) -> DataFrame:
    """Each rank's range replaced by the bin of it that holds the rank."""
    key = g + ["_lo", "_hi"]
    spans = need.select(*key).distinct()
    per_bin = (_inside(counts, spans, g).groupBy(*key, _bin_of(bins).alias("_b"))
               .agg(F.sum("_c").alias("_bc"), F.count(F.lit(1)).alias("_bd"),
                    F.min("_v").alias("_blo"), F.max("_v").alias("_bhi")))
    w = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ended = per_bin.withColumn("_end", F.sum("_bc").over(w))
    start = F.col("_before") + F.col("_end") - F.col("_bc")
    return (ended.join(sized_broadcast(need), on=key)
            .filter((F.col("_k") >= start) & (F.col("_k") < F.col("_before") + F.col("_end")))
            .select(*g, "_n", "_k", F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"),
                    start.alias("_before"), F.col("_bd").alias("_d")))


def box_statistics(df: DataFrame, group_cols: list[str], value_col: str,
                   whisker: float = 1.5, approximate: bool = False) -> DataFrame:
    """Quartiles, whiskers and outlier counts per group.

    ``approximate=True`` takes the quartiles from the sketches (one pass less).

    Lower whisker: smallest value >= q1 − whisker·IQR; upper whisker: largest
    value <= q3 + whisker·IQR. The last pass counts and compares every value
    against its group's fences (one row per group, size-checked broadcast).
    """
    g, names = list(group_cols), ["q1", "median", "q3"]
    sketches = materialize(value_sketches(df, g, value_col), "quantile-sketches")
    q = materialize(sketched_quantiles(sketches, g, QUARTILES, names) if approximate
                    else _from_sketches(df, sketches, g, value_col, QUARTILES, names), "quartiles")
    iqr = F.col("q3") - F.col("q1")
    fences = q.select(*g, (F.col("q1") - whisker * iqr).alias("_lf"),
                      (F.col("q3") + whisker * iqr).alias("_uf"))
    v = F.col("_v")
    outside = (v < F.col("_lf")) | (v > F.col("_uf"))
    values = df.filter(F.col(value_col).isNotNull()).select(*g, F.col(value_col).cast("double").alias("_v"))
    stats = (values.join(sized_broadcast(fences, rows_of=q), on=g)
             .groupBy(*g)
             .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
                  F.min(F.when(v >= F.col("_lf"), v)).alias("lower_whisker"),
                  F.max(F.when(v <= F.col("_uf"), v)).alias("upper_whisker"),
                  F.count_if(outside).alias("n_outliers")))
    return stats.join(sized_broadcast(q, rows_of=q), on=g).select(
        *g, "n", "min", "q1", "median", "q3", "max", "lower_whisker", "upper_whisker", "n_outliers")


def yearly_box_of_station_means(df_grouped: DataFrame, temp_col: str = "TAVG") -> DataFrame:
    """Box statistics by year of station-year means (A14 over A1/A3 output)."""
    # The passes of the statistics read the means (a row per station and year), not their input.
    keyed = materialize(df_grouped.select(F.year("PERIOD_START").cast("bigint").alias("YEAR"), temp_col), "station-means")
    return box_statistics(keyed, ["YEAR"], temp_col)


def yearly_distributions(df: DataFrame, columns: list[str] | None = None,
                         approximate: bool = False) -> DataFrame:
    """Box statistics of daily values by measure and year."""
    cols = [c for c in (columns or S.DISTRIBUTION_COLS) if c in df.columns]
    long = (df.filter(F.col("DATE").isNotNull())
              .select(F.year("DATE").cast("bigint").alias("YEAR"), *cols)
              .unpivot(["YEAR"], cols, "MEASURE", "VALUE"))
    return box_statistics(long, ["MEASURE", "YEAR"], "VALUE", approximate=approximate)


def impute_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values of each column replaced by the column mean.

    The means are one aggregate; its single row (one value per column) is
    the only thing that reaches the driver, and enters the plan as literals.
    Pass a materialized frame when the input is expensive, since it is read
    once for the means and once more by the consumer.
    """
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return df
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(means[c]).cast("double"))
                           for c in cols})


def pearson(a: str, b: str) -> Column:
    """Pearson correlation that is NULL (not an error) for constant columns."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation_matrix(df: DataFrame, columns: list[str], impute: bool = True) -> DataFrame:
    """All-pairs Pearson correlations as long cells (COL_A, COL_B, CORR).

    One aggregate computes every pair (distributed, partial aggregation);
    the single result row is unpivoted into matrix cells.
    """
    cols = [c for c in columns if c in df.columns]
    data = impute_means(df, cols) if impute else df
    index = {c: i for i, c in enumerate(cols)}

    def key(a, b):
        return f"{a}|{b}" if index[a] <= index[b] else f"{b}|{a}"

    upper = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = data.agg(*[pearson(a, b).alias(key(a, b)) for a, b in upper])
    # Both halves of the symmetric matrix read the same aggregated value.
    cells = [(a, b) for a in cols for b in cols]
    full = wide.select(*[F.col(f"`{key(a, b)}`").alias(f"{a}|{b}#") for a, b in cells])
    long = full.unpivot([], [f"{a}|{b}#" for a, b in cells], "PAIR", "CORR")
    parts = F.split(F.regexp_replace("PAIR", "#$", ""), r"\|")
    return long.select(parts[0].alias("COL_A"), parts[1].alias("COL_B"), "CORR")
