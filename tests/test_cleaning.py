import random

import pytest
from graph_helpers import pairs

from ripplenet.operators import cleaning, ordering, structure
from ripplenet.operators.structure import degrees


def test_clean_and_mutual(dup_edges):
    expected = [(1, 2), (1, 3), (2, 4), (2, 5), (4, 5), (4, 7), (5, 6)]
    assert pairs(cleaning.clean_edges(dup_edges)) == expected
    mutual = cleaning.mutual_edges(dup_edges, attr=2)
    assert sorted(tuple(r) for r in mutual.collect()) == [(1, 2, 2), (2, 4, 2)]


def test_multi_edges_and_valued(spark, dup_edges):
    merged = {(r.src, r.dst): r.w for r in cleaning.merge_multi_edges(dup_edges).collect()}
    assert merged[(1, 2)] == 2 and merged[(2, 1)] == 1 and len(merged) == 9
    values = spark.createDataFrame([(1, 5), (2, 5), (4, 5)], "v bigint, k bigint")
    assert pairs(cleaning.clean_edges(dup_edges, values)) == [(1, 2), (2, 4)]
    assert pairs(cleaning.induced_edges(dup_edges, values)) == [(1, 2), (2, 1), (2, 4), (4, 2)]


def test_identity_of_users(spark):
    users = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3)], "screen_name string, created string, n int")
    assert cleaning.distinct_users(users).count() == 2


def test_degrees_and_cardinality(spark, tiny_edges):
    found = {r.v: r.k for r in degrees(tiny_edges).collect()}
    assert found == {1: 2, 2: 2, 3: 4, 4: 2, 6: 3, 7: 2, 8: 1}
    assert tuple(structure.cardinality(tiny_edges).first()) == (7, 8)
    everyone = structure.degrees_of_all(tiny_edges, spark.range(10).withColumnRenamed("id", "v"))
    assert {r.v: r.k for r in everyone.collect()}[5] == 0


@pytest.mark.parametrize("rows_per_salt", [1_000_000, 3])
def test_embeddedness_against_brute_force(spark, rows_per_salt):
    """The second case splits hubs in every join."""
    rng = random.Random(2)
    edges = sorted({tuple(sorted(rng.sample(range(25), 2))) for _ in range(70)} | {(0, v) for v in range(1, 25)})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected = {}
    for v, friends in near.items():
        terms = []
        for u in friends:
            union = len(near[u] | friends) - 2
            terms.append(len(near[u] & friends) / union if union else 0.0)
        expected[v] = sum(terms) / len(terms)
    found = structure.embeddedness(spark.createDataFrame(edges, "src bigint, dst bigint"), rows_per_salt)
    assert {r.v: pytest.approx(r.e) for r in found.collect()} == expected


def plain_triangles(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return {(a, b): len(near[a] & near[b]) for a, b in edges if near[a] & near[b]}


@pytest.mark.parametrize("task_edges, rows_per_salt", [(10**6, 10**6), (40, 10**6), (12, 10)])
def test_triangles_by_colours(spark, task_edges, rows_per_salt):
    """The second and third case have more colours, and several hubs that are neighbours of each other."""
    rng = random.Random(task_edges)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(300)} | {tuple(sorted((h, v))) for h in (0, 7, 30) for v in range(60) if v != h}
    edges = sorted(edges)
    frame = spark.createDataFrame(edges, "src bigint, dst bigint")
    found = structure.common_neighbours(frame, degrees(frame), len(edges), rows_per_salt, task_edges)
    rows = [tuple(r) for r in found.collect()]
    assert {(a, b): n for a, b, n in rows} == plain_triangles(edges) and len(rows) == len({r[:2] for r in rows})


def test_triangles_shuffle_edges_and_counts_only(spark):
    frame = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src bigint, dst bigint")
    found = structure.common_neighbours(frame, degrees(frame), 3)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "extended")
    assert "collect_list" not in plan and "collect_set" not in plan and "Join" not in plan.split("Physical Plan")[1]


@pytest.mark.parametrize("n_edges, colours", [(0, 3), (6_000_000, 3), (10**10, 123), (10**12, 1225)])
def test_colours_follow_the_root_of_the_edges(n_edges, colours):
    assert structure.colours_for(n_edges) == colours


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_successors_cross_slices(spark, partitions):
    """Groups of one row, of several and of a third of the table, with null values, over few and many slices."""
    rng = random.Random(5)
    rows = [(g, i, None if rng.random() < 0.1 else rng.randrange(100)) for g, n in ((1, 1), (2, 100), (3, 7), (4, 1)) for i in range(n)]
    rows += [(g, i, g * i) for g in range(10, 60) for i in range(3)]
    want = sorted((str(a[2]), str(b[2])) for a, b in zip(rows, rows[1:]) if a[0] == b[0])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g bigint, i int, x bigint")
    got = ordering.successors(df, ["g"], ["i"], "x", partitions).collect()
    assert sorted((str(r.src), str(r.dst)) for r in got) == want
    whole = ordering.successors(df, [], ["g", "i"], "x", partitions).collect()
    assert len(whole) == len(rows) - 1
    assert ordering.successors(df.limit(0), ["g"], ["i"], "x", partitions).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_running_ranks_cross_slices(spark, partitions):
    rows = [(g, i, (i * 7) % 11) for g in ("a", "b") for i in range(40 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, i int, x bigint")
    found = ordering.ordered_running(df, ["g"], ["i"], rank="rank", sums={"upto": "x"}, partitions=partitions)
    for g in ("a", "b"):
        mine = sorted((r.i, r.rank, r.upto) for r in found.collect() if r.g == g)
        total = 0
        for position, (i, rank, upto) in enumerate(mine, 1):
            total += (i * 7) % 11
            assert (rank, upto) == (position, total)


def test_ids_are_dense_and_ordered(spark):
    names = spark.createDataFrame([(w,) for w in "pear fig apple fig kiwi plum".split()], "name string")
    found = sorted((r.name, r.id) for r in ordering.assign_ids(names, "name", base=100, partitions=3).collect())
    assert found == [("apple", 100), ("fig", 101), ("kiwi", 102), ("pear", 103), ("plum", 104)]
