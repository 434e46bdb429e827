"""First cumulative weight at or above a target.

``ordered_lookup`` takes any targets: bounds and targets lie in one distributed order and a bound is carried to the targets
below it. ``cumulative_lookup`` is for targets drawn at random over the whole weight, where an equi-join on equal slots sees
about two candidates a target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplenet.operators.ordering import carried_forward

# Slots of a key group, at least.
BUCKETS = 1024
# Bounds listed by slot go to all executors up to this number of rows, some 100 MB; more are joined where they lie.
BROADCAST_BOUNDS = 1_000_000


def cumulative(weights: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str) -> DataFrame:
    """Add ``lo`` (exclusive) and ``hi`` (inclusive) running bounds of ``weight`` inside each key group.

    Meant for tables collapsed to distinct values, whose groups are small next to the graph.
    """
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return weights.withColumn("hi", F.sum(weight).over(running)).withColumn("lo", F.col("hi") - F.col(weight))


def ordered_lookup(
    targets: DataFrame, table: DataFrame, keys: Sequence[str], target: str, result: str, partitions: int | None = None
) -> DataFrame:
    """Find for each ``target`` the row of ``table(keys, lo, hi, result)`` with ``lo < target <= hi``.

    Targets at or below zero take the first row and targets beyond the last ``hi`` get -1. The cost is that of sorting both
    tables, wherever the targets and bounds crowd and whatever the size of a key group.
    """
    keys = list(keys)
    bounds = table.where("lo < hi").select(*keys, (-F.col("hi")).alias("_at"), F.lit(0).alias("_kind"), F.col(result).alias("_bound"))
    asked = targets.select(
        *keys, (-F.greatest(F.col(target).cast("bigint"), F.lit(1).cast("bigint"))).alias("_at"), F.lit(1).alias("_kind"),
        F.struct(*targets.columns).alias("_row"),
    )
    both = bounds.unionByName(asked, allowMissingColumns=True)
    found = carried_forward(both, keys, ["_at", "_kind"], "_bound", partitions).where("_kind = 1")
    return found.select(*[F.col(f"_row.{c}").alias(c) for c in targets.columns], F.coalesce("_bound", F.lit(-1)).alias(result))


def cumulative_lookup(
    targets: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    target: str,
    result: str,
    total: str | None = None,
    buckets: int = BUCKETS,
    bounds: str | None = None,
    broadcast_rows: int = BROADCAST_BOUNDS,
) -> DataFrame:
    """``ordered_lookup`` for targets that are drawn at random between 0 and the group's last ``hi``.

    Each key group's weight range is cut into equal slots, ``buckets`` or as many as the group has rows, and rows are listed
    in the slots they touch. A random target then meets at most (rows + slots) / slots candidates on average, about two,
    whatever the weights: slots with many rows are as rarely asked for as their rows are light. Targets that carry the
    group's last ``hi`` and its number of rows in the columns ``total`` and ``bounds`` need no join to learn the slot width.

    Targets outnumber the bounds of a collapsed table by far, so up to ``broadcast_rows`` listed bounds go to the targets, which
    then are never shuffled. The planner alone would not do that: it takes the product of two sizes for that of a join.
    """
    keys = list(keys)

    def width(whole: str, rows: str) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col(whole) / F.greatest(F.lit(buckets), F.col(rows)))).cast("bigint")

    sized = table.groupBy(*keys).agg(F.max("hi").alias("_total"), F.count(F.lit(1)).alias("_rows"))
    sized = sized.select(*keys, width("_total", "_rows").alias("_width"))
    left = targets.join(sized, keys) if total is None or bounds is None else targets.withColumn("_width", width(total, bounds))
    left = left.withColumn("_t", F.greatest(F.col(target).cast("bigint"), F.lit(1).cast("bigint")))
    left = left.withColumn("_slot", F.floor((F.col("_t") - 1) / F.col("_width")))
    right = table.select(*keys, "lo", "hi", result).join(sized, keys)
    right = right.withColumn(
        "_slot",
        F.explode(F.sequence(F.floor(F.col("lo") / F.col("_width")), F.floor((F.col("hi") - 1) / F.col("_width")))),
    ).drop("_width")
    if right.count() <= broadcast_rows:
        right = F.broadcast(right)
    on = [*keys, "_slot"]
    # The range test belongs to the join condition, so that a target without a match is kept by the left join.
    a, b = left.alias("a"), right.alias("b")
    condition = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on]
    condition += [F.col("a._t") > F.col("b.lo"), F.col("a._t") <= F.col("b.hi")]
    joined = a.join(b, condition, "left")
    return joined.select(
        *[F.col(f"a.{c}") for c in targets.columns], F.coalesce(F.col(f"b.{result}"), F.lit(-1)).alias(result)
    )
