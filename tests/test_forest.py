"""The sparse forest: wide vectors, exact splits, draws, agreement with known labels."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ripplenet.operators import classify, forest
from ripplenet.storage import materialize


def test_forest_over_a_vocabulary_too_wide_for_dense_rows(spark):
    """Half a billion features: a dense row would be 2 GB."""
    size = 500_000_000
    ids = lambda i: [7 + i % 2, 1000 + i, size - 1]
    rows = [(i, float(i % 2), [0, *ids(i)], [1, 3, 1, 2]) for i in range(40)]
    df = classify.as_features(spark.createDataFrame(rows, "v int, label double, ids array<int>, counts array<int>"), size)
    read = df.where("v = 0").select(*forest.sparse_parts(F.col("features"))).first()
    assert read[0] == size and read[1] == [0, 7, 1000, size - 1] and read[2] == [1.0, 3.0, 1.0, 2.0]
    index = materialize(classify.feature_index(df.select("ids", "counts")), "index")
    nodes = spark.createDataFrame([(0, 1, 0, 20.0, 20.0)], "tree int, node int, top int, t0 double, t1 double")
    entries = df.select("label", F.explode(F.arrays_zip("ids", "counts")).alias("e")).select(F.lit(0).alias("tree"), F.lit(1).alias("node"), "e.ids", F.col("e.counts").cast("double").alias("value"), "label")
    hist = entries.groupBy("tree", "node", F.col("ids").alias("id"), "value").agg(*[F.sum(F.when(F.col("label") == c, 1.0).otherwise(0.0)).alias(f"c{c}") for c in (0, 1)])
    best = forest.best_splits(hist, nodes, index, 2).first().best
    assert best.feature == 7 and best.gain == pytest.approx(0.5) and sorted([best.left, best.right]) == [[0.0, 20.0], [20.0, 0.0]]


def _gain(left, right):
    gini = lambda c: 1 - sum((x / sum(c)) ** 2 for x in c)
    both = [a + b for a, b in zip(left, right, strict=True)]
    return gini(both) - (sum(left) * gini(left) + sum(right) * gini(right)) / sum(both)


def test_best_split_agrees_with_all_cuts(spark):
    """Categories by every way of parting them, other values by every threshold, zeros of absent words among both."""
    rng = random.Random(3)
    rows = [(i, rng.randrange(2), {f: rng.randrange(0, 4 if f < 4 else 9) for f in range(8)}) for i in range(60)]
    sparse = [(i, y, [f for f in x if x[f]], [float(x[f]) for f in x if x[f]]) for i, y, x in rows]
    table = spark.createDataFrame(sparse, "v int, y int, ids array<int>, counts array<double>")
    index = materialize(classify.feature_index(table), "index")
    totals = [float(sum(y == c for _, y, _ in rows)) for c in (0, 1)]
    nodes = spark.createDataFrame([(0, 1, totals.index(max(totals)), *totals)], "tree int, node int, top int, t0 double, t1 double")
    entries = table.select("y", F.explode(F.arrays_zip("ids", "counts")).alias("e")).select("y", F.col("e.ids").alias("id"), F.col("e.counts").alias("value"))
    hist = entries.groupBy(F.lit(0).alias("tree"), F.lit(1).alias("node"), "id", "value").agg(*[F.sum(F.when(F.col("y") == c, 1.0).otherwise(0.0)).alias(f"c{c}") for c in (0, 1)])
    best = forest.best_splits(hist, nodes, index, 2).first().best
    gains = []
    for f in range(8):
        seen = sorted({x[f] for _, _, x in rows})
        ways = [set(c) for n in range(1, len(seen)) for c in combinations(seen, n)] if len(seen) <= 4 else [set(seen[:n]) for n in range(1, len(seen))]
        for way in ways:
            sides = [[sum(y == c and (x[f] in way) == inside for _, y, x in rows) for c in (0, 1)] for inside in (True, False)]
            gains.append(_gain(*sides))
    assert best.gain == pytest.approx(max(gains))


def test_forest_learns_a_few_words_among_many_and_repeats_itself(spark):
    rng = random.Random(5)
    def user(v, y):
        words = set(rng.sample(range(40, 60), 8)) | set(rng.sample(range(0, 40, 2) if y else range(1, 40, 2), 12))
        return v, float(y), sorted(words), [rng.randrange(1, 8) for _ in words]
    rows = [user(i, i % 2) for i in range(200)]
    df = classify.as_features(spark.createDataFrame(rows, "v int, label double, ids array<int>, counts array<int>"), 60)
    taught, asked = df.where("v < 140"), df.where("v >= 140")
    one, two = classify.fit_labels(taught), classify.fit_labels(taught.repartition(3))
    assert (one.splits, one.counts) == (two.splits, two.counts) and len({s["feature"] for s in one.splits.values()}) > 5
    scored = one.transform(asked).collect()
    assert sum(float(r.predictedLabel) == r.label for r in scored) >= 57
    assert all(sum(r.probability) == pytest.approx(1) and r.prediction == max(range(2), key=r.probability.__getitem__) for r in scored)
    # Children share out what their node holds, and drawn rows differ between trees.
    for (t, n) in one.splits:
        assert [a + b for a, b in zip(one.counts[t, 2 * n], one.counts[t, 2 * n + 1], strict=True)] == one.counts[t, n]
    assert len({tuple(one.counts[t, 1]) for t in range(10)}) > 5


def test_trees_search_only_the_features_that_splits_ask_for(spark):
    """Nodes as a walk in plain Python finds them; a vector without any asked feature has value 0 everywhere."""
    grown = forest.Forest(2, ["a", "b"])
    grown.splits = {
        (0, 1): {"feature": 5, "threshold": 1.5, "listed": None, "listed_left": True},
        (0, 3): {"feature": 9, "threshold": None, "listed": [0.0, 2.0], "listed_left": False},
        (1, 1): {"feature": 7, "threshold": None, "listed": [3.0], "listed_left": True},
    }
    rng = random.Random(7)
    rows = [(i, *map(list, zip(*sorted({f: float(rng.randint(1, 3)) for f in rng.sample(range(12), 5)}.items()), strict=True))) for i in range(60)]
    rows += [(60, [], []), (61, [0], [1.0])]

    def walk(tree, x, depth):
        node = 1
        for _ in range(depth):
            split = grown.splits.get((tree, node))
            if split is None:
                break
            v = x.get(split["feature"], 0.0)
            left = v <= split["threshold"] if split["threshold"] is not None else (v in split["listed"]) == split["listed_left"]
            node = 2 * node + (not left)
        return node

    frame = spark.createDataFrame(rows, "v int, ids array<int>, counts array<double>")
    for depth in (0, 1, 2):
        placed = grown.placed(frame, F.col("ids"), F.col("counts"), depth)
        assert placed.columns == ["v", "ids", "counts", "_nodes"]
        for v, ids, counts, nodes in placed.collect():
            assert nodes == [walk(t, dict(zip(ids, counts, strict=True)), depth) for t in range(2)], (v, depth)
