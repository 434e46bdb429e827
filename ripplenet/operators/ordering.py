"""Ranks and running sums over groups of any size.

A plain window puts a whole group into one task. Here the rows are range-partitioned on (group, order), so a group
that holds a third of the table still spreads over a third of the tasks; each partition is ranked on its own and
shifted by the totals of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplenet.operators.skew import ROWS_PER_SALT, hot_ends, join_split
from ripplenet.storage import materialize, shuffle_width

ROWS_PER_SLICE = 2_000_000


def ordered_running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    rank: str | None = None,
    sums: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add the 1-based ``rank``, inclusive running ``sums`` and whole-group ``totals`` (new name -> column) in each group.

    ``order`` must be total within a group and no key column may be null. Totals come with the slice offsets, so that
    no join on the group alone is needed.
    """
    group, order, sums, totals = list(group), list(order), dict(sums or {}), dict(totals or {})
    width = partitions or max(shuffle_width(df.sparkSession), -(-df.count() // ROWS_PER_SLICE))
    slices = materialize(
        df.repartitionByRange(width, *group, *order).withColumn("_slice", F.spark_partition_id()), "slices"
    )

    # At most one row per (group, slice), so the window below sees at most `width` rows per group.
    per_slice = slices.groupBy(*group, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{n}") for n, c in {**sums, **totals}.items()]
    )
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *group,
        "_slice",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.sum(f"_sum_{n}").over(whole).alias(n) for n in totals],
    )

    within = Window.partitionBy(*group, "_slice").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = slices
    if rank:
        out = out.withColumn("_row", F.row_number().over(within))
    for name, column in sums.items():
        out = out.withColumn(f"_run_{name}", F.sum(column).over(running))
    out = out.join(offsets, [*group, "_slice"])
    added = [(F.col("_row") + F.col("_rows_before")).cast("bigint").alias(rank)] if rank else []
    added += [(F.col(f"_run_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums]
    return out.select(*df.columns, *added, *totals)


def successors(
    df: DataFrame, group: Sequence[str], order: Sequence[str], column: str, partitions: int | None = None
) -> DataFrame:
    """``(src, dst)``: ``column`` of each row and of the row after it in ``order``, in groups of any size.

    Rows are range-partitioned like those of ``ordered_running`` and paired where they are sorted, in the task that receives
    their slice, so they are shuffled and sorted once; slices are stitched by their first and last rows. ``order`` must be
    total within a group and no key column may be null.
    """
    group, order = list(group), list(order)
    width = partitions or max(shuffle_width(df.sparkSession), -(-df.count() // ROWS_PER_SLICE))
    held = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    rows = df.select(*held, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(column).alias("src"))
    keys, at = [f"_g{i}" for i in range(len(group))], [f"_o{i}" for i in range(len(order))]
    slices = rows.repartitionByRange(width, *keys, *at).sortWithinPartitions(*keys, *at)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["_slice int", "_end int", *[f"{k} {kinds[k]}" for k in keys], f"src {kinds['src']}", f"dst {kinds['src']}"])
    paired = slices.select(F.spark_partition_id().alias("_slice"), *keys, "src").mapInArrow(_slice_pairs(keys), schema)
    paired = materialize(paired, "pairs")
    inside = paired.where("_end is null").select("src", "dst")
    # Two rows for each slice: its last row and the first one of the next slice follow each other.
    row = F.struct(*keys, "src")
    ends = paired.where("_end is not null").groupBy("_slice").agg(
        *[F.first(F.when(F.col("_end") == i, row), ignorenulls=True).alias(n) for i, n in enumerate(("_first", "_last"))]
    )
    later = Window.partitionBy(F.lit(0)).orderBy("_slice")
    across = ends.select("_last", F.lead("_first").over(later).alias("_next")).where("_next is not null")
    for k in keys:
        across = across.where(F.col(f"_last.{k}") == F.col(f"_next.{k}"))
    return inside.unionByName(across.select(F.col("_last.src").alias("src"), F.col("_next.src").alias("dst")))


def _slice_pairs(keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of neighbouring rows of a sorted slice that have the same ``keys``; its first and last row as ``_end`` 0 and 1."""

    def end(row: pa.RecordBatch, place: int) -> pa.RecordBatch:
        columns = [row["_slice"], pa.array([place], pa.int32()), *[row[k] for k in keys], row["src"], pa.nulls(1, row["src"].type)]
        return pa.RecordBatch.from_arrays(columns, names=["_slice", "_end", *keys, "src", "dst"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield end(batch.slice(0, 1), 0)
                rows = batch
            else:
                rows = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            last = batch.slice(batch.num_rows - 1)
            above, below = rows.slice(0, rows.num_rows - 1), rows.slice(1)
            same = pa.array(np.ones(above.num_rows, dtype=bool))
            for k in keys:
                neither = pc.and_(pc.is_null(above[k]), pc.is_null(below[k]))
                same = pc.and_(same, pc.or_(neither, pc.fill_null(pc.equal(above[k], below[k]), False)))
            src, dst = pc.filter(above["src"], same), pc.filter(below["src"], same)
            if len(src):
                none = [pa.nulls(len(src), t) for t in (pa.int32(), *[batch[k].type for k in keys])]
                columns = [pc.filter(above["_slice"], same), *none, src, dst]
                yield pa.RecordBatch.from_arrays(columns, names=["_slice", "_end", *keys, "src", "dst"])
        if last is not None:
            yield end(last, 1)

    return pair


def carried_forward(
    df: DataFrame, group: Sequence[str], order: Sequence[str], column: str, partitions: int | None = None
) -> DataFrame:
    """``df`` with ``column`` filled by its last value that is not null, in ``order`` within each group of any size.

    Rows are range-partitioned like those of ``ordered_running``; a slice starts with the last value of the slices before it.
    """
    group, order = list(group), list(order)
    width = partitions or shuffle_width(df.sparkSession)
    slices = df.repartitionByRange(width, *group, *order).withColumn("_slice", F.spark_partition_id())
    slices = materialize(slices, "slices")
    known = slices.where(F.col(column).isNotNull()).groupBy(*group, "_slice").agg(
        F.max(F.struct(*order, F.col(column).alias("_last"))).alias("_end")
    )
    every = slices.select(*group, "_slice").distinct().join(known, [*group, "_slice"], "left")
    # At most one row per (group, slice), so the window sees at most `width` rows per group.
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = every.select(*group, "_slice", F.last("_end._last", ignorenulls=True).over(before).alias("_start"))
    within = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = slices.withColumn("_filled", F.last(column, ignorenulls=True).over(within)).join(starts, [*group, "_slice"])
    return filled.select(*[c for c in df.columns if c != column], F.coalesce("_filled", "_start").alias(column))


def assign_ids(keys: DataFrame, column: str, base: int = 0, name: str = "id", partitions: int | None = None) -> DataFrame:
    """Dense ids ``base, base+1, ...`` over the distinct values of ``column`` in their sort order."""
    # Written once: ranks count, sample and order their input, and what makes the keys would run each time.
    distinct = materialize(keys.select(column).where(F.col(column).isNotNull()).distinct(), "keys")
    ranked = ordered_running(distinct, [], [column], rank="_position", partitions=partitions)
    return ranked.select(column, (F.col("_position") + F.lit(base - 1)).cast("bigint").alias(name))


def rekey_edges(
    edges: DataFrame, ids: DataFrame, column: str, name: str = "id", rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Replace both ends of ``edges(src, dst)`` by their ids; edges with an unknown end drop out, hot ends are split."""
    hot = hot_ends(edges, rows_per_salt=rows_per_salt)
    for end, other in (("src", "dst"), ("dst", "src")):
        side = ids.select(F.col(column).alias(end), F.col(name).alias(f"_{end}_id"))
        edges = join_split(edges, side, end, hot[end], other)
    return edges.select(F.col("_src_id").alias("src"), F.col("_dst_id").alias("dst"))
