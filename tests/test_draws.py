"""Draws that are hashed side by side are those that Spark hashes one by one."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ripplenet.functions.hashing import draw_below, numbered_heads
from ripplenet.operators import sampling


@pytest.mark.parametrize("prefix", ["3|2|1|cand|", "-5|é|", "x" * 55 + "|", ""])
def test_heads_are_those_of_md5(prefix):
    for first, last in ((1, 120), (99_998, 100_003), (10**12, 10**12 + 2), (5, 4)):
        want = [int(hashlib.md5(f"{prefix}{j}".encode()).hexdigest()[:15], 16) for j in range(first, last + 1)]
        assert numbered_heads(prefix, first, last).tolist() == want


def test_hashed_draws_equal_single_ones(spark):
    rows = [(7, 0, 1, 25, 1000), (7, 1, 2, 9, 3), (None, 1, 1, 4, 10**15), (8, 0, 1, 0, 5)]
    plan = spark.createDataFrame(rows, "run_id bigint, wave int, rep int, n bigint, total bigint")
    drawn = sampling.hashed_draws(plan, "n", "total", ["run_id", "wave", "rep"], "cand", "t", chunk=10)
    single = sampling.explode_count(plan, "n", "j").withColumn("t", draw_below(F.col("total"), *map(F.col, ("run_id", "wave", "rep")), "cand", F.col("j")) + 1)
    want = sorted(map(str, single.select(*drawn.columns).collect()))
    assert len(want) == 38 and sorted(map(str, drawn.collect())) == want
