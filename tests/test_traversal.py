import random
from collections import Counter

import pytest
from graph_helpers import multiset, pairs
from pyspark.sql import functions as F

from ripplenet.operators import cleaning, traversal
from ripplenet.storage import materialize_by


def seeds_of(spark, *vs):
    return spark.createDataFrame([(0, v) for v in vs], "run_id bigint, v bigint")


@pytest.fixture(scope="module")
def tiny(tiny_edges):
    return traversal.build_adjacency(cleaning.clean_edges(tiny_edges))


@pytest.mark.parametrize(
    "wave,method,expected",
    [
        (0, "pooled", [1, 2]),
        (1, "pooled", [1, 2, 3, 3, 4, 6]),
        (2, "pooled", [1, 2, 3, 3, 3, 4, 4, 6, 6, 6, 7]),
        (2, "per_seed", [1, 1, 2, 2, 3, 3, 3, 4, 4, 6, 6, 6, 6, 7, 7]),
    ],
)
def test_known_multisets(spark, tiny, wave, method, expected):
    found = traversal.lmsi_increments(tiny, seeds_of(spark, 1, 2), wave, method)
    assert multiset(traversal.inclusions(found, [wave])) == expected


def test_smaller_waves_come_from_one_expansion(spark, tiny):
    found = traversal.lmsi_increments(tiny, seeds_of(spark, 1, 2), 3)
    by_wave = traversal.inclusions(found, [0, 1, 2]).cache()
    assert multiset(by_wave.where("wave = 1")) == [1, 2, 3, 3, 4, 6]
    assert multiset(by_wave.where("wave = 2")) == [1, 2, 3, 3, 3, 4, 4, 6, 6, 6, 7]


def test_hop_cost_two(spark, tiny):
    seeds = seeds_of(spark, 1, 2)
    dist = traversal.wave_distance(tiny, seeds, 2, hop_cost=2)
    found = traversal.increments_from_distance(tiny, dist, seeds, 2)
    assert multiset(traversal.inclusions(found, [2])) == [1, 2, 3, 3, 4, 6]


def test_unknown_method_and_wave(spark, tiny):
    with pytest.raises(ValueError):
        traversal.lmsi_increments(tiny, seeds_of(spark, 1), 1, "other")
    with pytest.raises(ValueError):
        traversal.wave_increments(tiny, seeds_of(spark, 1), 150)


def brute_distance(edges, seeds, limit):
    """Weighted distances by repeated relaxation."""
    dist = {s: 0 for s in seeds}
    for _ in range(limit + 1):
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if x in dist and dist[x] + w <= limit and dist[x] + w < dist.get(y, limit + 1):
                    dist[y] = dist[x] + w
    return dist


def brute_inclusions(edges, seeds, wave):
    """Each kept edge with 1 + min(d) <= wave emits its farther end, both ends when equal; then the seeds."""
    dist = brute_distance([(a, b, 1) for a, b in edges], seeds, wave)
    out = list(seeds)
    for a, b in edges:
        if a in dist and b in dist and 1 + min(dist[a], dist[b]) <= wave:
            if dist[a] == dist[b]:
                out += [a, b]
            else:
                out.append(a if dist[a] > dist[b] else b)
    return sorted(out)


@pytest.mark.parametrize("rows_per_salt", [1_000_000, 5])
def test_random_graphs_against_brute_force(spark, rows_per_salt):
    """The second case splits every vertex of degree above five, so salted hubs take part."""
    rng = random.Random(4)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)} | {(0, v) for v in range(1, 40)})
    adj = traversal.build_adjacency(
        spark.createDataFrame(edges, "src bigint, dst bigint"), rows_per_salt=rows_per_salt
    )
    if rows_per_salt == 5:
        assert adj.salts.where("src = 0").first()["n_salt"] > 5
    runs = {r: rng.sample(range(60), 3) for r in range(4)}
    seeds = spark.createDataFrame([(r, v) for r, vs in runs.items() for v in vs], "run_id bigint, v bigint")
    found = traversal.inclusions(traversal.wave_increments(adj, seeds, 4), range(5)).collect()
    dist = traversal.wave_distance(adj, seeds, 4)
    general = traversal.inclusions(traversal.increments_from_distance(adj, dist, seeds, 4), range(5)).collect()
    assert sorted(found) == sorted(general)
    for run, vs in runs.items():
        for wave in range(5):
            got = sorted(r.v for r in found if r.run_id == run and r.wave == wave for _ in range(r.m))
            assert got == brute_inclusions(edges, vs, wave)


def test_weighted_distance_against_brute_force(spark):
    rng = random.Random(9)
    edges = {tuple(sorted(rng.sample(range(40), 2))): rng.randint(1, 4) for _ in range(70)}
    rows = [(a, b, w) for (a, b), w in edges.items()]
    adj = traversal.build_adjacency(spark.createDataFrame(rows, "src bigint, dst bigint, w int"))
    found = traversal.wave_distance(adj, seeds_of(spark, 0, 7), 7)
    assert {r.v: r.d for r in found.collect()} == brute_distance(rows, [0, 7], 7)


def test_per_seed_equals_pooled_for_one_seed(spark, tiny):
    one = seeds_of(spark, 3)
    pooled = traversal.inclusions(traversal.lmsi_increments(tiny, one, 2), [0, 1, 2])
    single = traversal.inclusions(traversal.lmsi_increments(tiny, one, 2, "per_seed"), [0, 1, 2])
    assert sorted(pooled.collect()) == sorted(single.collect())


def test_wave_edges(spark, tiny, tiny_edges):
    start = seeds_of(spark, 7)
    assert pairs(traversal.wave_edges(tiny, start, 0)) == pairs(traversal.wave_edges(tiny, start, 1)) == [(3, 7), (7, 8)]
    assert pairs(traversal.wave_edges(tiny, start, 2)) == [(1, 3), (2, 3), (3, 6), (3, 7), (7, 8)]


def test_snowball_and_frontiers(spark):
    links = spark.createDataFrame(
        [("s", "a"), ("s", "b"), ("a", "c"), ("a", "b"), ("a", "s"), ("b", "d"), ("c", "e")], "src string, dst string"
    )
    seeds = spark.createDataFrame([("s",)], "v string")
    labelled = spark.createDataFrame([("a",), ("x",)], "v string")
    kept, wave_two = traversal.snowball(links, seeds, labelled)
    assert [r.v for r in kept.collect()] == ["a"]
    assert [r.v for r in wave_two.collect()] == ["c"]
    fetched = spark.createDataFrame([("b",)], "v string")
    frontier = traversal.crawl_frontier(links, seeds, fetched)
    assert Counter(r.v for r in frontier.collect()) == Counter(["c", "s", "d"])
    both = spark.createDataFrame([("s",), ("a",)], "v string")
    assert sorted(r.v for r in traversal.unexpanded_friends(links, both).collect()) == ["b", "c"]


def test_edge_weights_count_in_inclusions(spark, tiny_edges):
    seeds = spark.createDataFrame([(0, 1), (0, 2)], "run_id bigint, v bigint")
    dear = traversal.build_adjacency(tiny_edges.withColumn("w", F.lit(5)))
    for method in ("pooled", "per_seed"):
        assert multiset(traversal.inclusions(traversal.lmsi_increments(dear, seeds, 2, method), [2])) == [1, 2]
    two = traversal.build_adjacency(tiny_edges.withColumn("w", F.lit(2)))
    assert multiset(traversal.inclusions(traversal.lmsi_increments(two, seeds, 2), [2])) == [1, 2, 3, 3, 4, 6]
    plain = traversal.build_adjacency(tiny_edges)
    assert multiset(traversal.inclusions(traversal.lmsi_increments(plain, seeds, 2, hop_cost=2), [2])) == [1, 2, 3, 3, 4, 6]


def test_buckets_follow_the_rows(spark, tiny_edges, monkeypatch):
    monkeypatch.setattr(traversal, "ROWS_PER_BUCKET", 1)
    edges = traversal.build_adjacency(tiny_edges).edges
    assert "SelectedBucketsCount: 16 out of 16" in edges.groupBy("src").count()._jdf.queryExecution().toString()


@pytest.mark.parametrize("n_runs", [1, 3, 64, 130])
def test_packed_runs_are_the_runs_one_by_one(spark, n_runs):
    """Bitmaps of one and of several blocks of runs, with lanes of one and of two runs."""
    rng = random.Random(n_runs)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seeds = [(run, v) for run in range(n_runs) for v in rng.sample(sorted(near), 1 + run % 3)]
    want = {}
    for run in range(n_runs):
        level = {v for r, v in seeds if r == run}
        seen = set(level)
        want.update({(run, 0, v): (1, True) for v in level})
        for wave in range(3):
            hits = Counter(u for v in level for u in near[v])
            fresh = set(hits) - seen
            want.update({(run, wave + 1, u): (n, u in fresh) for u, n in hits.items() if u in fresh or u in level})
            seen, level = seen | fresh, fresh
    adj = traversal.build_adjacency(spark.createDataFrame(edges, "src bigint, dst bigint"))
    frame = spark.createDataFrame(seeds, "run_id bigint, v bigint")
    packed = traversal.packed_increments(adj, frame, 3)
    got = {(r["run_id"], r["wave"], r["v"]): (r["m"], r["fresh"]) for r in packed.unpack().collect()}
    assert got == want
    hit = len({(w, v) for _, w, v in want})
    assert packed.rows.count() <= hit * -(-n_runs // 64)


def test_many_runs_shuffle_bitmaps_and_few_runs_counts(spark):
    """No number for each lane goes through the shuffle of a step; with hubs, hits are counted before it."""
    rng = random.Random(8)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(120)})
    frame = spark.createDataFrame([(run, v) for run in range(50) for v in rng.sample(range(40), 2)], "run_id bigint, v bigint")
    table = spark.createDataFrame(edges, "src bigint, dst bigint")
    found = {}
    for name, seeds, rows_per_salt in (("many", frame, 1000), ("few", frame.where("run_id < 3"), 1000), ("hubs", frame, 3)):
        packed = traversal.packed_increments(traversal.build_adjacency(table, rows_per_salt=rows_per_salt), seeds, 2)
        plan = packed.rows._jdf.queryExecution().executedPlan().toString()
        found[name] = "REPARTITION_BY_COL" in plan, sorted(map(tuple, packed.unpack().collect()))
    assert [found[name][0] for name in ("many", "few", "hubs")] == [True, False, False]
    assert found["many"][1] == found["hubs"][1] and found["few"][1] == [r for r in found["many"][1] if r[0] < 3]


def test_offers_are_read_by_their_distance(spark):
    """Costs up to 9: a round reads the folders that are due, and the result is that of a shortest-path search."""
    rng = random.Random(9)
    edges = {tuple(sorted(rng.sample(range(40), 2))): rng.randint(1, 9) for _ in range(90)}
    want, todo = {}, [(0, 0)]
    near = {}
    for (a, b), w in edges.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    start = min(near)
    todo = [(0, start)]
    while todo:
        todo.sort()
        d, v = todo.pop(0)
        if v not in want and d <= 14:
            want[v] = d
            todo += [(d + w, u) for u, w in near[v]]
    adj = traversal.build_adjacency(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src bigint, dst bigint, w int"))
    got = traversal.wave_distance(adj, seeds_of(spark, start), 14).collect()
    assert {r["v"]: r["d"] for r in got} == want and len(got) == len(want)


def test_a_table_by_folders_reads_what_is_asked_for(spark):
    table = materialize_by(spark.range(100).select("id", (F.col("id") % 7).cast("int").alias("d")), "d")
    due = table.where("d = 3")
    plan = spark._jvm.PythonSQLUtils.explainString(due._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(d" in plan
    assert sorted(r["id"] for r in due.collect()) == list(range(3, 100, 7))
    assert materialize_by(spark.range(0).withColumn("d", F.lit(1)), "d").count() == 0
