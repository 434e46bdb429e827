import bisect
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ripplenet.operators import bootstrap, lookup, sampling


def cumulative_of(spark, rows):
    """Running weights of (v, k) rows in vertex order."""
    df = spark.createDataFrame([(0, 0, v, k, 1) for v, k in rows], "run_id bigint, wave int, v bigint, k bigint, m bigint")
    return bootstrap.inverse_weights(df)


FLAT = [(1, 1), (2, 1), (3, 1), (4, 1)]
HUB = [(1, 1), (2, 1), (3, 1000), (4, 1)]


@pytest.mark.parametrize("rows,expected", [(FLAT, [1000, 2000, 3000, 4000]), (HUB, [1000, 2000, 2001, 3001])])
def test_cumulative_weights(spark, rows, expected):
    assert [r.hi for r in cumulative_of(spark, rows).orderBy("v").collect()] == expected


def test_a_value_below_one_is_refused(spark):
    with pytest.raises(Exception, match="at least 1"):
        cumulative_of(spark, [(1, 0)]).collect()


@pytest.mark.parametrize("rows,expected", [(HUB, [1, 1, 2, 2, 3, 4]), (HUB[1:], [2, 2, 3, 4, 4, -1])])
@pytest.mark.parametrize("buckets", [1, 3, 1024])
def test_lookup_boundaries(spark, rows, expected, buckets):
    weights = [(0, v, 1000 // k) for v, k in rows]
    table = lookup.cumulative(spark.createDataFrame(weights, "g int, v bigint, w bigint"), ["g"], ["v"], "w")
    targets = [100, 1000, 1001, 1002, 2001, 2500]
    asked = spark.createDataFrame([(0, i, t) for i, t in enumerate(targets)], "g int, i int, t bigint")
    found = lookup.cumulative_lookup(asked, table, ["g"], "t", "v", buckets=buckets)
    assert [r.v for r in found.orderBy("i").collect()] == expected


def test_random_targets_are_not_shuffled_to_their_bounds(spark):
    """Whatever the planner thinks of the sizes; bounds that are too many for a broadcast give the same rows."""
    rng = random.Random(11)
    weights = [(g, v, rng.randint(1, 50)) for g in range(20) for v in range(80)]
    table = lookup.cumulative(spark.createDataFrame(weights, "g int, v bigint, w bigint"), ["g"], ["v"], "w")
    asked = spark.createDataFrame([(g, i, rng.randint(1, 2100)) for g in range(20) for i in range(50)], "g int, i int, t bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = lookup.cumulative_lookup(asked, table, ["g"], "t", "v")
        joined = lookup.cumulative_lookup(asked, table, ["g"], "t", "v", broadcast_rows=0)
        got = sorted(map(tuple, sent.collect()))
        assert got == sorted(map(tuple, joined.collect())) and len(got) == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    last_join = lambda df: re.search(r"(\w+) .*LeftOuter", df._jdf.queryExecution().executedPlan().toString())[1]
    assert (last_join(sent), last_join(joined)) == ("BroadcastHashJoin", "SortMergeJoin")


@pytest.mark.parametrize("rows,expected", [(HUB, [1, 1, 2, 2, 3, 4]), (HUB[1:], [2, 2, 3, 4, 4, -1])])
@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_ordered_lookup_boundaries(spark, rows, expected, partitions):
    weights = [(0, v, 1000 // k) for v, k in rows]
    table = lookup.cumulative(spark.createDataFrame(weights, "g int, v bigint, w bigint"), ["g"], ["v"], "w")
    targets = [100, 1000, 1001, 1002, 2001, 2500]
    asked = spark.createDataFrame([(0, i, t) for i, t in enumerate(targets)], "g int, i int, t bigint")
    found = lookup.ordered_lookup(asked, table, ["g"], "t", "v", partitions)
    assert [r.v for r in found.orderBy("i").collect()] == expected


def test_ordered_lookup_where_all_targets_crowd(spark):
    """Thousands of bounds and targets in the width of one slot, weights of 0, repeated targets and targets below 1."""
    rng = random.Random(3)
    weights = [(g, v, rng.choice([0, 1, 1, 2])) for g in (1, 2) for v in range(3000)] + [(g, 3000, 10**9) for g in (1, 2)]
    table = lookup.cumulative(spark.createDataFrame(weights, "g int, v bigint, w bigint"), ["g"], ["v"], "w")
    asked = [(g, i, rng.randint(-2, 3200)) for g in (1, 2, 3) for i in range(2000)]
    frame = spark.createDataFrame(asked, "g int, i int, t bigint")
    got = {(r.g, r.i): r.v for r in lookup.ordered_lookup(frame, table, ["g"], "t", "v", 7).collect()}
    his = {}
    for g in (1, 2):
        upto, bounds = 0, []
        for gg, v, w in weights:
            if gg == g and w:
                upto += w
                bounds.append((upto, v))
        his[g] = bounds
    want = {}
    for g, i, t in asked:
        bounds = his.get(g, [])
        at = bisect.bisect_left(bounds, (max(t, 1), -1))
        want[g, i] = bounds[at][1] if at < len(bounds) else -1
    assert got == want


def test_proxy_means_count_repeats_once(spark):
    seeds = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (0, 3), (0, 4)], "run_id bigint, v bigint")
    for ks, mean in (([4, 5, 3, 4], 4.0), ([0, 5, 3, 4], 3.0)):
        values = spark.createDataFrame(list(zip([1, 2, 3, 4], ks)), "v bigint, k bigint")
        assert sampling.proxy_mean(seeds, values, ["run_id"]).first()["mu_proxy"] == mean


@pytest.mark.parametrize("n", [0, 1, 7, 15, 16, 29, 30, 99])
def test_positions_are_distinct_and_complete(spark, n):
    asked = spark.createDataFrame([(r, n, 30) for r in range(3)], "run_id bigint, n int, total bigint")
    found = sampling.distinct_positions(asked, ["run_id"], "t").collect()
    for run in range(3):
        mine = [r for r in found if r.run_id == run]
        assert len({r.pos for r in mine}) == len(mine) == min(n, 30)
        assert all(0 <= r.pos < 30 for r in mine)
        assert sorted(r.ord for r in mine) == list(range(1, len(mine) + 1))
    large = sampling.large_distinct_positions(asked, ["run_id"], "t").collect()
    assert sorted(found) == sorted(large)


def test_large_requests_are_drawn_apart(spark):
    asked = spark.createDataFrame([(0, 3, 50), (1, 20, 50)], "run_id bigint, n int, total bigint")
    apart = sampling.sample_positions(asked, ["run_id"], "t", row_draws=10).collect()
    assert sorted(apart) == sorted(sampling.distinct_positions(asked, ["run_id"], "t").collect())


def test_positions_are_uniform(spark):
    asked = spark.range(4000).select(F.col("id").alias("run_id"), F.lit(3).alias("n"), F.lit(10).cast("bigint").alias("total"))
    counts = sampling.distinct_positions(asked, ["run_id"], "t").groupBy("pos").count().collect()
    assert len(counts) == 10 and all(1050 < r["count"] < 1350 for r in counts)


def test_exact_sample_is_the_same_by_limit_and_by_rank(spark, monkeypatch):
    df = spark.range(500).withColumnRenamed("id", "v")
    small = sorted(r.v for r in sampling.sample_exact(df, "v", 40, "x").collect())
    monkeypatch.setattr(sampling, "TOP_N", 10)
    assert small == sorted(r.v for r in sampling.sample_exact(df, "v", 40, "x").collect())
    assert len(small) == 40


@pytest.mark.parametrize("n, digits, top", [(1, 1, 1), (250, 1, 5), (499, 2, 5), (500, 1, 1), (501, 1, 5), (800, 1, 1), (40, 4, 100)])
def test_threshold_of_the_smallest_hashes(spark, n, digits, top):
    """Prefix counts lead to the n-th row in the order of hash and key, also where hashes repeat."""
    keys = [(hashlib.md5(str(k % 470).encode()).hexdigest(), k) for k in range(500)]
    rows = spark.createDataFrame(keys, "hash string, key bigint")
    got = sampling.hash_threshold(rows, n, digits, top)
    assert got == (sorted(keys)[n - 1] if n <= len(keys) else None)


def test_large_samples_are_one_filter(spark, monkeypatch):
    monkeypatch.setattr(sampling, "TOP_N", 10)
    df = spark.range(500).withColumnRenamed("id", "v")
    sample = sampling.sample_exact(df, "v", 200, "x")
    plan = spark._jvm.PythonSQLUtils.explainString(sample._jdf.queryExecution(), "extended").split("Physical Plan")[1]
    assert "Exchange" not in plan and "Sort" not in plan
    order = sorted(range(500), key=lambda v: (hashlib.md5(f"x|{v}".encode()).hexdigest(), v))
    assert {r["v"] for r in sample.collect()} == set(order[:200])
    assert sampling.sample_exact(df, "v", 600, "x").count() == 500
    assert sampling.sample_exact(df, "v", 0, "x").count() == 0


@pytest.fixture(scope="module")
def one_wave(spark):
    """Groups, seeds and values of a made-up wave: values 1..6, two seeds of value 2."""
    values = spark.createDataFrame([(v, 1 + v % 6) for v in range(60)], "v bigint, k bigint")
    seeds = spark.createDataFrame([(0, 1, 1), (0, 2, 7)], "run_id bigint, ord bigint, v bigint")
    found = values.select(F.lit(0).cast("bigint").alias("run_id"), F.lit(0).alias("wave"), "v", (1 + F.col("v") % 3).alias("m"), F.lit(True).alias("fresh"))
    return bootstrap.candidate_groups(found, values, [0]).cache(), seeds, values


def expectation(groups, seeds, values):
    rows = groups.collect()
    n = sum(r.n for r in rows)
    weight = {r.k: max(1000 // r.k, 1) * r.n for r in rows}
    mean = sum(k * w for k, w in weight.items()) / sum(weight.values())
    known = {r.v: r.k for r in values.collect()}
    ks = [known[r.v] for r in seeds.collect()]
    return (sum(ks) + n * mean) / (len(ks) + n)


@pytest.mark.parametrize("cell_values", [1024, 2])
def test_both_bootstraps_meet_the_expectation(spark, one_wave, cell_values):
    groups, seeds, values = one_wave
    wanted = expectation(groups, seeds, values)
    hashed = bootstrap.bootstrap_hashed(groups, seeds, values, 300)
    counted = bootstrap.bootstrap_multinomial(groups, seeds, values, 300, cell_values=cell_values)
    stats = {}
    for name, boot in (("hashed", hashed), ("counted", counted)):
        row = boot.agg(F.avg("stat").alias("m"), F.stddev("stat").alias("s"), F.count("stat").alias("n")).first()
        assert row.n == 300 and abs(row.m - wanted) < 5 * row.s / 300**0.5
        stats[name] = row.s
    assert 0.75 < stats["hashed"] / stats["counted"] < 1.33
    again = bootstrap.bootstrap_multinomial(groups, seeds, values, 300, cell_values=cell_values)
    assert sorted(counted.collect()) == sorted(again.collect())


def test_weights_favour_small_values(spark):
    """A value-1000 vertex between two of value 1 is drawn less often than either."""
    rows = [(0, 0, k, 1) for k in (1, 1000)]
    table = lookup.cumulative(
        bootstrap.with_group_weights(spark.createDataFrame(rows, "run_id int, wave int, k bigint, n bigint")),
        ["run_id", "wave"], ["k"], "weight",
    )
    asked = spark.range(1, 1002).select(F.lit(0).alias("run_id"), F.lit(0).alias("wave"), F.col("id").alias("t"))
    drawn = {r.k: r["count"] for r in lookup.cumulative_lookup(asked, table, ["run_id", "wave"], "t", "k").groupBy("k").count().collect()}
    assert drawn == {1: 1000, 1000: 1}


def test_uniform_scheme_and_zero_share(spark):
    groups = spark.createDataFrame(
        [(0, 0, True, 0, 4), (0, 0, False, 3, 96)], "run_id bigint, wave int, is_seed boolean, k bigint, n bigint"
    )
    for p0, low, high in (("integer", 0.0, 0.5), ("fraction", 0.0, 0.5)):
        stats = [r.stat for r in bootstrap.bootstrap_uniform(groups, 50, 100, p0).collect()]
        # All seeds drawn are zero, so the other draws cancel unless no seed was drawn at all.
        assert sum(low <= s <= high for s in stats) >= 45


def test_summary_percentiles(spark):
    boot = spark.createDataFrame([(0, 0, i, float(i)) for i in range(1, 10)], "run_id bigint, wave int, rep int, stat double")
    row = bootstrap.replicate_summary(boot).first()
    assert (row["l1"], row["l2"], row["lmin"], row["lmax"], row["mean"]) == (1.0, 9.0, 1.0, 9.0, 5.0)
    boot = spark.createDataFrame([(0, 0, i, float(i)) for i in range(1, 40)], "run_id bigint, wave int, rep int, stat double")
    row = bootstrap.replicate_summary(boot).first()
    assert (row["l1"], row["l2"]) == (pytest.approx(2.0), pytest.approx(38.0))


def test_large_seed_requests_are_drawn_over_many_tasks(spark):
    frame = spark.range(300).select(F.lit(0).alias("graph_id"), F.col("id").alias("v"), F.col("id").alias("pos"))
    runs = spark.createDataFrame([(0, 0, 100), (1, 0, 250)], "run_id bigint, graph_id int, n int")
    inside = {tuple(r) for r in sampling.choose_seeds(frame, runs).collect()}
    assert {tuple(r) for r in sampling.choose_seeds(frame, runs, row_draws=10).collect()} == inside and len(inside) == 350
