"""Memory and passes of the triangle search."""

import os
import tracemalloc

import numpy as np

from ripplenet import storage
from ripplenet.operators import structure
from ripplenet.plans import report
from workload import structure as workload


def test_triangle_search_holds_few_bytes_an_edge():
    """Places of 32 bit: 600,000 edges took 295 bytes each before, whatever the task's share of them."""
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 40_000, (600_000, 2)), axis=0)
    a, b = (x.copy() for x in pairs[pairs[:, 0] < pairs[:, 1]].T)
    tracemalloc.start()
    counts = structure.triangles_per_edge(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.sum() % 3 == 0 and counts.sum() > 0 and structure.HELD_EDGES * 2 <= structure.TASK_EDGES

    assert peak < 150 * len(a)


def test_centre_searches_triangles_once(spark):
    """The median counts, samples and writes its input; rows are made once all the same."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(40).repartition(2).mapInArrow(count, "id bigint").selectExpr("'x' AS dataset", "id / 40D AS e")
    found = report.embeddedness_centre(rows).first()
    assert (round(found["mean"], 6), round(found["median"], 6)) == (0.4875, 0.4875) and made.value == 40


def test_triples_read_blocks_and_shuffle_no_copies(spark):
    """Ten colours: each edge lies on the disk once and only counts are shuffled, ten copies of the edges were before."""
    edges = spark.range(40).selectExpr("id AS src", "explode(sequence(id + 1, 40)) AS dst").where("(src * 7 + dst) % 3 > 0")
    edges = storage.materialize(edges)
    n_edges = edges.count()
    with storage.scratch(spark):
        found = structure.common_neighbours(edges, structure.degrees(edges), n_edges, task_edges=-(-6 * n_edges // 100))
        folder = storage._scopes[-1][0]
        (blocks,) = [n for n in os.listdir(folder) if n.startswith("blocks")]
        assert spark.read.parquet(f"{folder}/{blocks}").count() == n_edges
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        rows = {(r.src, r.dst): r.common for r in found.collect()}
    near = {}
    for a, b in ((r.src, r.dst) for r in edges.collect()):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert rows == {(a, b): len(near[a] & near[b]) for a in near for b in near[a] if a < b and near[a] & near[b]}


def test_embedded_graphs_leave_their_results_only(spark, tmp_path):
    """Edges, blocks and pairs of a graph go before the next graph is made."""
    spark.range(60).selectExpr("id DIV 6 AS l_orderkey", "CAST(id % 6 AS int) AS l_linenumber", "id * 5 % 13 AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).selectExpr("id AS event_id", "id * id % 11 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    with storage.scratch(spark):
        found = workload.both_embedded(spark, str(tmp_path))
        left = [f for f in os.listdir(storage._scopes[-1][0]) if not f.startswith(".")]
        assert len(left) == 2 and all(f.startswith("embedded-") for f in left)
        assert {r.dataset for r in found.collect()} == {"part", "event"}
