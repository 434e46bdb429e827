"""A random forest over sparse vectors, grown level by level with joins and aggregates.

A dense row for each user would be as long as the vocabulary. Here only the counts that a user has are read: those of the
features that the open nodes have drawn are counted by node, feature, value and class, and what is missing to a node's total
has value 0. A level is one pass over the vectors, whatever the number of trees.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplenet.functions.hashing import uniform
from ripplenet.operators.sampling import distinct_positions
from ripplenet.storage import materialize, small_table

DEPTH = 5
# Cumulative probabilities of a Poisson count with mean 1: how often a tree draws a row.
POISSON_ONE = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
               0.9994058151824183, 0.9999167588507120, 0.9999897508033253, 0.9999988747974020, 0.9999998885745217]
SPLIT = "array<struct<feature:int,threshold:double,listed:array<double>,listed_left:boolean>>"


def sparse_parts(features: Column) -> tuple[Column, Column, Column]:
    """Size, indices and values of a vector column; zeros that are written out are left out."""
    parts = F.unwrap_udt(features)
    values = parts["values"]
    ids = F.coalesce(parts["indices"], F.transform(values, lambda x, i: i))
    kept = F.filter(F.arrays_zip(ids.alias("id"), values.alias("value")), lambda e: e["value"] != 0)
    return F.coalesce(parts["size"], F.size(values)), kept["id"], kept["value"]


def _constant(rows: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), kind)


def _at(place: int, values: Column) -> Column:
    return F.get(values, F.lit(place))


@dataclass
class Forest:
    """Splits and class counts of every node; the root of a tree is 1, the children of n are 2n and 2n + 1."""

    trees: int
    labels: list[str]
    splits: dict[tuple[int, int], dict] = field(default_factory=dict)
    counts: dict[tuple[int, int], list[float]] = field(default_factory=dict)

    def nodes(self, ids: Column, values: Column, depth: int) -> Column:
        """The node of each tree that a vector has come to after ``depth`` splits."""

        def step_of(width: int, splits: Column) -> Callable[[Column, Column], Column]:
            def step(node: Column, tree: Column) -> Column:
                split = F.get(splits, tree * width + node - width)
                place = F.array_position(ids, split["feature"])
                x = F.when(place > 0, F.get(values, place.cast("int") - 1)).otherwise(F.lit(0.0))
                left = F.when(split["threshold"].isNotNull(), x <= split["threshold"]).otherwise(
                    F.array_contains(split["listed"], x) == split["listed_left"]
                )
                return F.when((node >= width) & split["feature"].isNotNull(), 2 * node + F.when(left, 0).otherwise(1)).otherwise(node)

            return step

        at = F.array_repeat(F.lit(1), self.trees)
        for level in range(depth):
            width = 2**level
            splits = _constant([self.splits.get((t, width + i)) for t in range(self.trees) for i in range(width)], SPLIT)
            at = F.transform(at, step_of(width, splits))
        return at

    def placed(self, rows: DataFrame, ids: Column, values: Column, depth: int) -> DataFrame:
        """``rows`` with ``_nodes``, the ``nodes`` of their vectors.

        A vector is read once for the features that any split asks for; the trees then search these few entries.
        """
        asked = sorted({split["feature"] for (_, node), split in self.splits.items() if node < 2**depth})
        entries = F.arrays_zip(ids.alias("id"), values.alias("value"))
        read = rows.withColumn("_asked", F.filter(entries, lambda e: e["id"].isin(asked)))
        return read.withColumn("_nodes", self.nodes(F.col("_asked.id"), F.col("_asked.value"), depth)).drop("_asked")

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``probability``, the trees' mean class shares, ``prediction`` and ``predictedLabel``."""
        _, ids, values = sparse_parts(F.col("features"))
        width = 2 ** (DEPTH + 1)
        shares = [[c / (sum(n) or 1) for c in n] if (n := self.counts.get((t, i))) else None for t in range(self.trees) for i in range(width)]
        found = _constant(shares, "array<array<double>>")
        placed = self.placed(rows, ids, values, DEPTH).withColumn(
            "_shares", F.transform("_nodes", lambda node, t: F.get(found, t * width + node))
        )
        of_class = [F.transform("_shares", partial(_at, c)) for c in range(len(self.labels))]
        votes = [F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / self.trees for s in of_class]
        voted = placed.withColumn("probability", F.array(*votes)).drop("_nodes", "_shares")
        first = F.array_position("probability", F.array_max("probability")).cast("int") - 1
        named = F.get(F.array(*[F.lit(name) for name in self.labels]), first)
        return voted.withColumn("prediction", first.cast("double")).withColumn("predictedLabel", named)


def _gini(counts: Sequence[Column], n: Column) -> Column:
    return F.lit(1.0) - sum((c / n * (c / n) for c in counts[1:]), counts[0] / n * (counts[0] / n))


def best_splits(hist: DataFrame, nodes: DataFrame, index: DataFrame, classes: int) -> DataFrame:
    """``(tree, node, best)``: the split of each node with the greatest gain of purity, smaller features first.

    ``hist (tree, node, id, value, c0, ...)`` has the values that occur, ``nodes (tree, node, t0, ..., top)`` the totals
    and the commonest class, ``index`` each feature's values and whether these are categories. Categories are put in the order
    of their share of the commonest class, other values in their own; both are cut between neighbours.
    """
    names, totals = [f"c{c}" for c in range(classes)], [f"t{c}" for c in range(classes)]
    key = ["tree", "node", "id"]
    held = hist.groupBy(*key).agg(*[F.sum(c).alias(f"_{c}") for c in names]).join(F.broadcast(nodes), ["tree", "node"])
    rest = held.select(*key, F.lit(0.0).alias("value"), *[(F.col(t) - F.col(f"_{c}")).alias(c) for c, t in zip(names, totals, strict=True)])
    rows = hist.select(*key, "value", *names).unionByName(rest.where(sum((F.col(c) for c in names[1:]), F.col(names[0])) > 0))
    rows = rows.join(F.broadcast(nodes), ["tree", "node"]).join(index, "id")
    n = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    place = F.when(F.col("categorical"), F.get(F.array(*names), F.col("top")) / n).otherwise(F.col("value"))
    order = Window.partitionBy(*key).orderBy("_place", "value")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left, right = [F.col(f"_left_{c}") for c in names], [F.col(t) - F.col(f"_left_{c}") for c, t in zip(names, totals, strict=True)]
    n_left, n_right, whole = (sum(x[1:], x[0]) for x in (left, right, [F.col(t) for t in totals]))
    cut = rows.withColumn("_place", place).select(
        *key, "value", "values", "categorical", *totals,
        F.lead("value").over(order).alias("_next"), F.collect_list(F.when(F.col("categorical"), F.col("value"))).over(upto).alias("_listed"),
        *[F.sum(c).over(upto).alias(f"_left_{c}") for c in names],
    ).where(F.col("_next").isNotNull())
    gain = _gini([F.col(t) for t in totals], whole) - n_left / whole * _gini(left, n_left) - n_right / whole * _gini(right, n_right)
    # The shorter side is listed; a category that training did not see goes to the other one.
    short = F.size("_listed") <= F.floor(F.size("values") / 2)
    split = F.struct(
        gain.alias("gain"), (-F.col("id")).alias("before"), (-n_left).alias("_first"), F.col("id").cast("int").alias("feature"),
        F.when(~F.col("categorical"), (F.col("value") + F.col("_next")) / 2).alias("threshold"),
        F.when(F.col("categorical"), F.when(short, F.col("_listed")).otherwise(F.array_except("values", "_listed"))).alias("listed"),
        short.alias("listed_left"), F.array(*left).alias("left"), F.array(*right).alias("right"),
    )
    return cut.groupBy("tree", "node").agg(F.max(split).alias("best"))


def grow(rows: DataFrame, index: DataFrame, labels: Sequence[str], size: int, trees: int, seed: int, depth: int = DEPTH) -> Forest:
    """A forest of ``rows (key, y, ids, values)``, written before, over ``size`` features with ``index (id, values, categorical)``.

    Each tree draws every row a Poisson number of times and each node the root of ``size`` features, both by hashes of the
    row's ``key``, the tree and the node. Only the splits, at most 2**``depth`` for each tree, come to the driver.
    """
    classes = len(labels)
    forest = Forest(trees, list(labels))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: uniform(F.lit(f"forest-{seed}"), t, F.col("key")))
    times = F.transform(drawn, lambda u: F.size(F.filter(F.lit(POISSON_ONE), lambda p: p <= u)))
    rows = materialize(rows.select("y", "ids", "values", times.alias("times")), "forest-rows")
    root = rows.agg(*[F.sum(F.when(F.col("y") == c, F.get("times", F.lit(t)))).alias(f"n_{t}_{c}") for t in range(trees) for c in range(classes)]).first()
    for t in range(trees):
        forest.counts[t, 1] = [float(root[f"n_{t}_{c}"] or 0) for c in range(classes)]
    for level in range(depth):
        open_ = [(t, n) for (t, n), c in forest.counts.items() if n >= 2**level and sum(x > 0 for x in c) > 1]
        if not open_:
            break
        spark = rows.sparkSession
        nodes = small_table(
            spark, ["tree", "node", "top", *[f"t{c}" for c in range(classes)]],
            [(t, n, max(range(classes), key=forest.counts[t, n].__getitem__), *forest.counts[t, n]) for t, n in open_],
        ).withColumn("top", F.col("top").cast("int"))
        asked = nodes.select("tree", "node", F.lit(ceil(sqrt(size))).alias("n"), F.lit(size).cast("bigint").alias("total"))
        wanted = materialize(
            distinct_positions(asked, ["tree", "node"], f"forest-{seed}").select(F.col("pos").cast("int").alias("id"), "tree", "node"), "forest-draws"
        )
        at = forest.placed(rows, F.col("ids"), F.col("values"), level).withColumnRenamed("_nodes", "nodes")
        entries = at.select("y", "times", "nodes", F.explode(F.arrays_zip("ids", "values")).alias("_e")).select("y", "times", "nodes", F.col("_e.ids").alias("id"), F.col("_e.values").alias("value"))
        met = entries.join(F.broadcast(wanted), "id").where(F.get("nodes", F.col("tree").cast("int")) == F.col("node"))
        met = met.withColumn("_n", F.get("times", F.col("tree").cast("int")).cast("double")).where(F.col("_n") > 0)
        hist = met.groupBy("tree", "node", "id", "value").agg(*[F.sum(F.when(F.col("y") == c, F.col("_n")).otherwise(0.0)).alias(f"c{c}") for c in range(classes)])
        for tree, node, best in best_splits(materialize(hist, "forest-counts"), nodes, index, classes).collect():
            if best.gain > 0:
                forest.splits[tree, node] = {k: best[k] for k in ("feature", "threshold", "listed", "listed_left")}
                forest.counts[tree, 2 * node], forest.counts[tree, 2 * node + 1] = best.left, best.right
    return forest
