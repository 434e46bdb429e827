"""Annotator agreement and the check of predictions against annotators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = (0, 1, 2, 3)


def label_counts(votes: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(item, predicted, n0, n1, n2, n3)`` for every predicted item with at least one vote ``(item, label)``."""
    tallies = votes.groupBy("item").agg(
        *[F.sum(F.when(F.col("label") == c, 1).otherwise(0)).alias(f"n{c}") for c in CATEGORIES]
    )
    return predictions.select("item", "predicted").join(tallies, "item")


def _over_categories(term) -> Column:
    return reduce(Column.__add__, [term(F.col(f"n{c}")) for c in CATEGORIES])


def fleiss_kappa(counts: DataFrame) -> DataFrame:
    """One row ``(items, raters, observed, expected, kappa)``.

    Every item must carry the same number of votes; the job stops otherwise. Kappa is null where it is undefined: with
    one rater, or if all votes fall into one category and chance alone would agree.
    """
    votes = _over_categories(lambda n: n)
    squares = _over_categories(lambda n: n * n)
    rated = counts.withColumn("_votes", votes).withColumn("_agree", F.try_divide(squares - votes, votes * (votes - 1)))
    sums = rated.agg(
        F.count(F.lit(1)).alias("items"),
        F.min("_votes").alias("_least"),
        F.max("_votes").alias("raters"),
        F.avg("_agree").alias("observed"),
        *[F.sum(f"n{c}").alias(f"_s{c}") for c in CATEGORIES],
    )
    total = F.col("items") * F.col("raters")
    expected = reduce(Column.__add__, [F.pow(F.col(f"_s{c}") / total, F.lit(2.0)) for c in CATEGORIES])
    raters = F.when(F.col("_least") == F.col("raters"), F.col("raters")).otherwise(
        F.raise_error(F.lit("items differ in their number of votes")).cast("bigint")
    )
    return sums.select("items", raters.alias("raters"), "observed", expected.alias("expected")).withColumn(
        "kappa", F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected"))
    )


def confusion(counts: DataFrame) -> DataFrame:
    """One row ``(tp, fp, tn, fn)``: prediction against the majority of 0 and 1 votes, ties left out."""
    yes, no = F.col("n1") > F.col("n0"), F.col("n0") > F.col("n1")
    hit, miss = F.col("predicted") == 1, F.col("predicted") == 0
    cells = {"tp": hit & yes, "fp": hit & no, "tn": miss & no, "fn": miss & yes}
    return counts.agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
