"""Hot ends by a sketch, and the five edge joins with a hub that holds a third of the edges."""

import random
from collections import Counter

import pytest
from graph_helpers import pairs
from pyspark.sql import functions as F

from ripplenet.operators import cleaning, ordering, skew

ROWS_PER_SALT = 50


@pytest.fixture(scope="module")
def hub_edges(spark):
    rng = random.Random(4)
    edges = {(0, v) for v in range(1, 301)} | {(v, 1) for v in range(2, 200)}
    edges |= {tuple(rng.sample(range(400), 2)) for _ in range(500)}
    return sorted(edges)


@pytest.fixture(scope="module")
def hub_frame(spark, hub_edges):
    return spark.createDataFrame(hub_edges, "src bigint, dst bigint").repartition(6)


def test_sketch_finds_hot_ends_of_both_columns(hub_edges, hub_frame):
    hot = skew.hot_ends(hub_frame, rows_per_salt=ROWS_PER_SALT)
    for column, ends in (("src", [a for a, _ in hub_edges]), ("dst", [b for _, b in hub_edges])):
        want = {v: -(-n // ROWS_PER_SALT) for v, n in Counter(ends).items() if n > ROWS_PER_SALT}
        assert want and {tuple(r) for r in hot[column].collect()} == set(want.items())
    assert skew.hot_ends(hub_frame, rows_per_salt=10**6) == {"src": None, "dst": None}


def test_sketch_of_few_counters_still_finds_the_hub(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("src"))
    hot = skew.hot_ends(rows.repartition(4), ["src"], 1000, counters=200)["src"]
    assert [r["src"] for r in hot.collect()] == [7]


def test_sketch_of_nothing_and_of_nulls(spark):
    empty = spark.createDataFrame([], "src bigint, dst bigint")
    assert skew.hot_ends(empty, rows_per_salt=1) == {"src": None, "dst": None}
    nulls = spark.createDataFrame([(None, "a")] * 9 + [(1, "b")] * 3, "src bigint, dst string")
    hot = skew.hot_ends(nulls, rows_per_salt=2)
    assert [tuple(r) for r in hot["src"].collect()] == [(1, 2)]
    assert sorted(tuple(r) for r in hot["dst"].collect()) == [("a", 5), ("b", 2)]


def test_hub_spreads_over_its_salts(hub_frame):
    hot = skew.hot_ends(hub_frame, rows_per_salt=ROWS_PER_SALT)["src"]
    salted = skew.add_salt(hub_frame, "src", hot, "dst").where("src = 0").groupBy("salt").count().collect()
    assert len(salted) >= 6 and max(r["count"] for r in salted) < 3 * ROWS_PER_SALT


@pytest.mark.parametrize("rows_per_salt", [ROWS_PER_SALT, 10**6])
def test_edge_joins_with_a_hub(spark, hub_edges, hub_frame, rows_per_salt):
    kept = {v for v in range(400) if v % 3 != 1} | {1}
    members = spark.createDataFrame([(v, "x") for v in kept] + [(0, "again")], "v bigint, a string")
    inside = sorted((a, b) for a, b in hub_edges if a in kept and b in kept)
    assert pairs(cleaning.induced_edges(hub_frame, members, rows_per_salt)) == inside
    assert pairs(cleaning.vertex_subgraph(hub_frame, members, F.col("a") == "x", rows_per_salt)[1]) == inside
    few = members.where("v < 60")
    friends = cleaning.friends_of(hub_frame, few, rows_per_salt).collect()
    assert sorted(r["v"] for r in friends) == sorted({b for a, b in hub_edges if a in kept and a < 60})
    named = spark.createDataFrame([(v, v * 2) for v in range(400) if v != 5], "v bigint, a bigint")
    got = cleaning.triplets(hub_frame, named, rows_per_salt).collect()
    assert sorted(tuple(r) for r in got) == [(a, 2 * a, b, 2 * b) for a, b in hub_edges if 5 not in (a, b)]
    words = hub_frame.select(*[F.concat(F.lit("u"), F.col(c)).alias(c) for c in ("src", "dst")])
    ids = spark.createDataFrame([(f"u{v}", v) for v in range(400) if v != 5], "name string, id bigint")
    assert pairs(ordering.rekey_edges(words, ids, "name", rows_per_salt=rows_per_salt)) == [e for e in hub_edges if 5 not in e]
