import random

import pytest
from pyspark.sql import functions as F

from ripplenet.operators import agreement, statistics


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(1)
    rows = [("big", round(rng.expovariate(1), 1)) for _ in range(201)] + [("one", 4.0)] + [("two", 1.0), ("two", 2.0)]
    return spark.createDataFrame(rows, "g string, x double"), rows


def grouped(rows):
    out = {}
    for g, x in rows:
        out.setdefault(g, []).append(x)
    return {g: sorted(xs) for g, xs in out.items()}


def reference_percentile(xs, p):
    at = (len(xs) + 1) * p
    i = int(at)
    if i == 0:
        return xs[0]
    if i >= len(xs):
        return xs[-1]
    return xs[i - 1] + (at - i) * (xs[i] - xs[i - 1])


@pytest.mark.parametrize("bounded", [True, False])
def test_percentiles(sample, bounded):
    df, rows = sample
    found = statistics.percentile_n1(df, ["g"], "x", {"a": 0.05, "b": 0.5, "c": 0.95}, bounded).collect()
    for r in found:
        for name, p in (("a", 0.05), ("b", 0.5), ("c", 0.95)):
            assert r[name] == pytest.approx(reference_percentile(grouped(rows)[r.g], p))


@pytest.mark.parametrize("bounded", [True, False])
def test_gini(sample, bounded):
    df, rows = sample
    found = statistics.gini(df, ["g"], {"v": F.col("x"), "w": F.col("x") + 1}, bounded).collect()
    for r in found:
        for name, shift in (("v", 0), ("w", 1)):
            xs = [x + shift for x in grouped(rows)[r.g]]
            n = len(xs)
            wanted = 2 * sum(i * x for i, x in enumerate(xs, 1)) / (n * sum(xs)) - (n + 1) / n
            assert r[name] == pytest.approx(wanted)


def test_median(spark):
    counts = spark.createDataFrame([("a", 1, 2), ("a", 5, 2), ("b", 3, 3)], "g string, x int, c bigint")
    found = {r.g: r.median for r in statistics.median_by_counts(counts, ["g"], "x", "c").collect()}
    assert found == {"a": 3.0, "b": 3.0}


def test_kappa_by_hand(spark):
    rows = [(1, 1, 4, 0, 0, 0), (2, 0, 0, 4, 0, 0), (3, 1, 2, 2, 0, 0)]
    counts = spark.createDataFrame(rows, "item int, predicted int, n0 bigint, n1 bigint, n2 bigint, n3 bigint")
    row = agreement.fleiss_kappa(counts).first()
    assert row.raters == 4 and row.observed == pytest.approx((1 + 1 + 4 / 12) / 3)
    assert row.kappa == pytest.approx((row.observed - 0.5) / 0.5)
    assert tuple(agreement.confusion(counts).first()) == (0, 1, 0, 1)


def test_kappa_needs_equal_raters(spark):
    rows = [(1, 1, 4, 0, 0, 0), (2, 0, 0, 3, 0, 0)]
    counts = spark.createDataFrame(rows, "item int, predicted int, n0 bigint, n1 bigint, n2 bigint, n3 bigint")
    with pytest.raises(Exception, match="number of votes"):
        agreement.fleiss_kappa(counts).collect()


def test_undefined_coefficients_are_null(spark):
    zeros = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 1.0), ("b", 3.0)], "g string, x double")
    got = {r["g"]: r["G"] for r in statistics.gini(zeros, ["g"], {"G": F.col("x")}).collect()}
    assert got["a"] is None and abs(got["b"] - 0.25) < 1e-9
    one = spark.createDataFrame([("i", 1, 0, 3, 0, 0), ("j", 1, 0, 3, 0, 0)], "item string, predicted int, n0 int, n1 int, n2 int, n3 int")
    row = agreement.fleiss_kappa(one).first()
    assert row["observed"] == 1.0 and row["kappa"] is None
