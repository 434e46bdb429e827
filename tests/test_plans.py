"""Shape of the physical plans that decide how the operators behave on large tables."""

import re

import pytest
from pyspark.sql import functions as F

from ripplenet.operators import cleaning, skew, structure, traversal


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("rows_per_salt", [1_000_000, 3])
def test_rounds_do_not_shuffle_the_edges(spark, tiny_edges, no_broadcast, rows_per_salt):
    """Only the vertices reached last move; the bucketed adjacency is joined where it lies, with and without hubs."""
    adj = traversal.build_adjacency(cleaning.clean_edges(tiny_edges), rows_per_salt=rows_per_salt)
    assert (adj.salts is None) == (rows_per_salt > 3)
    seeds = spark.createDataFrame([(0, 1)], "run_id bigint, v bigint")
    plan = plan_of(traversal.neighbours_of(adj, seeds))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "Bucketed: true" in plan


def test_cleaning_reads_two_columns(spark, tmp_path):
    wide = spark.range(10).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("x").alias("note"))
    wide.write.parquet(str(tmp_path / "wide"))
    plan = plan_of(cleaning.clean_edges(spark.read.parquet(str(tmp_path / "wide"))))
    assert re.search(r"ReadSchema: struct<src:bigint,dst:bigint>", plan)
    assert plan.count("Exchange hashpartitioning") == 1


def test_mutual_edges_need_one_shuffle(spark, dup_edges):
    assert plan_of(cleaning.mutual_edges(dup_edges)).count("Exchange hashpartitioning") == 1


def test_degrees_are_combined_before_the_shuffle(spark, dup_edges):
    assert "partial_count" in plan_of(structure.degrees(dup_edges))


def test_hot_keys_are_few_and_split(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    salts = skew.hot_keys(df, "k", 1000, rows_per_salt=50)
    assert [tuple(r) for r in salts.collect()] == [(7, 8)]
    sizes = skew.add_salt(df, "k", salts, "id").where("k = 7").groupBy("salt").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 90
    few = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    joined = skew.join_split(df, few, "k", salts, "id")
    assert joined.count() == 1000 and joined.where("x <> 2 * k").count() == 0
    assert skew.hot_keys(df, "k", 1000) is None
