"""Percentiles, medians, Gini coefficients and cumulative distributions.

Groups of unknown size are collapsed to distinct values with counts and ranked by ``ordered_running``; ``bounded=True``
declares that a group fits one task (sweep iterations, histogram buckets) and uses a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplenet.operators.ordering import ordered_running


def _running(
    df: DataFrame, group: Sequence[str], order: str, amounts: dict[str, str], bounded: bool, totals: dict[str, str] | None = None
) -> DataFrame:
    """Running ``amounts`` and group ``totals``, in slices or, for bounded groups, in one window."""
    totals = totals or {}
    if not bounded:
        return ordered_running(df, group, [order], sums=amounts, totals=totals)
    whole = Window.partitionBy(*group)
    running = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        *df.columns,
        *[F.sum(c).over(running).alias(n) for n, c in amounts.items()],
        *[F.sum(c).over(whole).alias(n) for n, c in totals.items()],
    )


def percentile_of_array(values: Column, p: float) -> Column:
    """Interpolated percentile of a sorted array at position (n + 1) p, clipped to the ends."""
    n = F.size(values)
    at = (n + 1) * F.lit(p)
    i = F.floor(at).cast("int")
    low = F.try_element_at(values, F.greatest(i, F.lit(1)))
    high = F.try_element_at(values, F.least(i + 1, n))
    return F.when(i == 0, F.try_element_at(values, F.lit(1))).when(i >= n, F.try_element_at(values, n)).otherwise(
        low + (at - i) * (high - low)
    )


def _values_at(counts: DataFrame, group: Sequence[str], value: str, count: str, bounded: bool) -> DataFrame:
    """Add the rank range ``(_from, _to]`` each distinct value covers and the group's size ``_n``."""
    ranked = _running(counts, group, value, {"_to": count}, bounded, {"_n": count})
    return ranked.withColumn("_from", F.col("_to") - F.col(count))


def percentile_n1(
    df: DataFrame, group: Sequence[str], value: str, points: dict[str, float], bounded: bool = False
) -> DataFrame:
    """Percentiles at position (n + 1) p per group, one column per entry of ``points``; groups of any size."""
    group = list(group)
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = _values_at(counts, group, value, "_c", bounded)

    def at_rank(rank: Column) -> Column:
        clipped = F.least(F.greatest(rank, F.lit(1)), F.col("_n"))
        return F.max(F.when((F.col("_from") < clipped) & (clipped <= F.col("_to")), F.col(value)))

    picks = []
    for name, p in points.items():
        low = F.floor((F.col("_n") + 1) * F.lit(p))
        picks += [at_rank(low).alias(f"_low_{name}"), at_rank(low + 1).alias(f"_high_{name}")]
    picked = ranked.groupBy(*group, "_n").agg(*picks)
    return picked.select(
        *group,
        *[
            (
                F.col(f"_low_{name}")
                + ((F.col("_n") + 1) * F.lit(p) - F.floor((F.col("_n") + 1) * F.lit(p)))
                * (F.col(f"_high_{name}") - F.col(f"_low_{name}"))
            ).alias(name)
            for name, p in points.items()
        ],
    )


def median_by_counts(
    counts: DataFrame, group: Sequence[str], value: str, count: str, bounded: bool = True
) -> DataFrame:
    """True median per group of a table of distinct values and their counts."""
    group = list(group)
    both = _values_at(counts, group, value, count, bounded)
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") < rank) & (rank <= F.col("_to")), F.col(value)))

    return both.groupBy(*group).agg(((at_rank(low) + at_rank(high)) / F.lit(2.0)).alias("median"))


def gini(df: DataFrame, group: Sequence[str], measures: dict[str, Column], bounded: bool = False) -> DataFrame:
    """Gini coefficient per group of every measure (name -> expression): one row per group, one column per measure.

    With x sorted, G = 2 sum(i x_i) / (n sum x) - (n + 1) / n. Equal values are collapsed: c copies of x behind r smaller
    ones add x (c r + c (c + 1) / 2) to the ranked sum. A group whose values sum to zero has no coefficient: null.
    """
    group = list(group)
    pairs = F.array(*[F.struct(F.lit(n).alias("_measure"), e.cast("double").alias("_x")) for n, e in measures.items()])
    long = df.select(*group, F.explode(pairs).alias("_p")).select(*group, "_p._measure", "_p._x")
    by = [*group, "_measure"]
    counts = long.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    ranked = _running(counts, by, "_x", {"_upto": "_c"}, bounded)
    x, c, before = F.col("_x"), F.col("_c"), F.col("_upto") - F.col("_c")
    sums = ranked.groupBy(*by).agg(
        F.sum(c).alias("_n"),
        F.sum(x * c).alias("_total"),
        F.sum(x * (c * before + c * (c + 1) / 2)).alias("_ranked"),
    )
    value = F.try_divide(2 * F.col("_ranked"), F.col("_n") * F.col("_total")) - (F.col("_n") + 1) / F.col("_n")
    wide = [F.max(F.when(F.col("_measure") == n, F.col("_gini"))).alias(n) for n in measures]
    return sums.withColumn("_gini", value).groupBy(*group).agg(*wide)


def cumulative_fraction(
    histogram: DataFrame, group: Sequence[str], value: str, fraction: str, digits: int, name: str = "cdf"
) -> DataFrame:
    """Running sum of ``fraction`` in the order of ``value``, rounded; histograms are collapsed, hence bounded."""
    return _running(histogram, list(group), value, {"_run": fraction}, True).select(
        *histogram.columns, F.round("_run", digits).alias(name)
    ).drop("_run")


def rounded_histogram(df: DataFrame, group: Sequence[str], value: str, digits: int = 1) -> DataFrame:
    """Counts of values rounded to ``digits``: ``(group, bucket, n)``."""
    return df.groupBy(*group, F.round(value, digits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
