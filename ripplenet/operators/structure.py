"""Degrees, their distribution, and embeddedness."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplenet.operators.skew import ROWS_PER_SALT, hot_counts, join_split
from ripplenet.storage import materialize, materialized_at, read_columns, shuffle_width

# Edges that one task of the triangle search may hold, about, and the least number of colours.
TASK_EDGES = 4_000_000
MIN_COLOURS = 3
# Edges that it holds here: an executor's tasks hold them at once, each with some 100 bytes an edge beside its worker.
HELD_EDGES = TASK_EDGES // 2
# Pairs of arrows a task looks up at once.
STEP_PAIRS = 500_000
# Rows of a batch that a triple gives back.
OUTPUT_ROWS = 100_000


def degrees(edges: DataFrame) -> DataFrame:
    """``(v, k)``: number of edge ends at each vertex, combined map-side so that hubs are harmless."""
    return (
        edges.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    )


def neighbours(edges: DataFrame) -> DataFrame:
    """``(v, neighbour)`` in either direction, repeats kept: the un-nested neighbour lists."""
    ends = F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u")),
                   F.struct(F.col("dst").alias("v"), F.col("src").alias("u")))
    return edges.select(F.explode(ends).alias("e")).select("e.v", F.col("e.u").alias("neighbour"))


def degrees_of_all(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Degrees including isolated vertices, which get 0."""
    return vertices.select("v").join(degrees(edges), "v", "left").select("v", F.coalesce("k", F.lit(0)).alias("k"))


def cardinality(edges: DataFrame) -> DataFrame:
    """One row ``(n_vertices, n_edges)``; vertices are those with an edge."""
    per_vertex = degrees(edges)
    return per_vertex.agg(
        F.count(F.lit(1)).alias("n_vertices"), F.floor(F.coalesce(F.sum("k"), F.lit(0)) / 2).alias("n_edges")
    )


def degree_distribution(values: DataFrame) -> DataFrame:
    """``(k, n, fraction)``; the total comes from the collapsed counts, not from a second pass over the vertices."""
    counts = values.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("k", "n", (F.col("n") / total).alias("fraction"))


def colours_for(n_edges: int, task_edges: int = TASK_EDGES) -> int:
    """Colours so that a triple of them holds some ``task_edges`` of the edges: three pairs of colours, 6 / q**2 of all."""
    return max(MIN_COLOURS, -int(-((6 * n_edges / task_edges) ** 0.5) // 1))


def colour_blocks(edges: DataFrame, colours: int) -> DataFrame:
    """``(block, src, dst)``: each edge once, in the block of its ends' colours, ``smaller * colours + greater``."""
    one, two = (F.pmod(F.xxhash64(c), F.lit(colours)) for c in ("src", "dst"))
    block = (F.least(one, two) * colours + F.greatest(one, two)).cast("int").alias("block")
    return edges.select(block, F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))


def triangles_per_edge(a: np.ndarray, b: np.ndarray, valid=None) -> np.ndarray:
    """The number of triangles on each edge ``(a[i], b[i])`` of a simple graph, of those that ``valid`` accepts.

    Arrows point to the end with more edges. Each arrow's head is looked up beside the other heads of its tail: a head's own
    arrows are at most sqrt(2E), and pairs of arrows are made a block at a time. ``valid`` takes three arrays of edge numbers.
    """
    counts = np.zeros(len(a), np.int64)
    if not len(a):
        return counts
    # Places are 32 bit and what is done with goes, as several tasks of an executor hold their edges at once.
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n_names, ends = len(names), ends.astype(np.int32)
    del names
    rank = np.empty(n_names, np.int32)
    rank[np.argsort(np.bincount(ends, minlength=n_names), kind="stable")] = np.arange(n_names, dtype=np.int32)
    ends = rank[ends]
    x, y = ends[: len(a)], ends[len(a) :]
    key = np.minimum(x, y).astype(np.int64) * n_names + np.maximum(x, y)
    del ends, x, y, rank
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    tail, head = (key // n_names).astype(np.int32), (key % n_names).astype(np.int32)
    first = np.searchsorted(tail, np.arange(n_names + 1, dtype=np.int32)).astype(np.int32)
    fan = first[head + 1] - first[head]
    upto = np.cumsum(fan, dtype=np.int64)
    start = 0
    while start < len(tail):
        done = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, done + STEP_PAIRS, "right")))
        n = fan[start:stop]
        one = np.repeat(np.arange(start, stop), n)
        two = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[head[one]]
        wanted = tail[one].astype(np.int64) * n_names + head[two]
        three = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        found = key[three] == wanted
        one, two, three = order[one[found]], order[two[found]], order[three[found]]
        if valid is not None:
            good = valid(one, two, three)
            one, two, three = one[good], two[good], three[good]
        for edge in (one, two, three):
            counts += np.bincount(edge, minlength=len(counts))
        start = stop
    return counts


def _triple_counts(q: int, path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges ``(src, dst, common)`` of the numbered triples of ``q`` colours with the triangles that have exactly these colours."""

    def counted(i: int, j: int, k: int) -> pa.Table:
        pairs = sorted({(i, j), (i, k), (j, k)})
        blocks = [read_columns(f"{path}/block={x * q + y}", ["src", "dst"]) for x, y in pairs]
        colour_sum = np.repeat([np.int32(x + y) for x, y in pairs], [b.num_rows for b in blocks])
        src, dst = (np.concatenate([b.column(c).to_numpy() for b in blocks]) for c in ("src", "dst"))
        del blocks
        # The blocks of a triple (i, i, k) also hold triangles of three i, which are counted in (i, i, i): the colours' sum tells.

        def valid(one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
            return colour_sum[one] + colour_sum[two] + colour_sum[three] == 2 * (i + j + k)

        common = triangles_per_edge(src, dst, valid)
        some = common > 0
        return pa.table({"src": src[some], "dst": dst[some], "common": common[some]})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch["id"].to_pylist():
                triple = next(islice(combinations_with_replacement(range(q), 3), number, None))
                yield from counted(*triple).to_batches(max_chunksize=OUTPUT_ROWS)

    return each


def hub_triangles(edges: DataFrame, hubs: DataFrame, salts: DataFrame | None) -> DataFrame:
    """``(src, dst, common)``: triangles with a vertex of ``hubs (v)``, a short list, each by the greatest of its hubs."""
    listed = F.broadcast(hubs.select(F.col("v").alias("hub")))
    spokes = neighbours(edges).withColumnRenamed("neighbour", "hub").join(listed, "hub")
    mine = F.broadcast(hubs.select("v", F.lit(True).alias("_hub")))
    spokes = materialize(spokes.join(mine, "v", "left").where("_hub IS NULL OR v < hub").select("v", "hub"), "spokes")
    one = join_split(edges, spokes.withColumnRenamed("v", "src"), "src", salts and salts.withColumnRenamed("v", "src"), "dst")
    closed = one.join(spokes.withColumnRenamed("v", "dst"), ["dst", "hub"])
    sides = F.array(*[F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")) for x, y in (("src", "dst"), ("src", "hub"), ("dst", "hub"))])
    return closed.select(F.explode(sides).alias("s")).groupBy("s.src", "s.dst").agg(F.count(F.lit(1)).alias("common"))


def common_neighbours(
    edges: DataFrame, values: DataFrame, n_edges: int, rows_per_salt: int = ROWS_PER_SALT, task_edges: int = HELD_EDGES
) -> DataFrame:
    """Triangles on each edge that has any: ``(src, dst, common)``, for a simple undirected graph with ``src < dst``.

    Vertices are hashed into q colours and an edge lies in the block of its ends' colours, so every triangle lies whole in the
    blocks of one triple of colours. The blocks are written once and each triple reads its own, q of them an edge with q
    growing as the root of their number: the disk holds the edges once, and no copies, lists or pairs of neighbours are
    shuffled. Vertices with over ``task_edges`` edges, at most 2E / ``task_edges`` of them, would fill
    their colour; their triangles come from joins with their spokes instead.
    """
    hubs = values.where(F.col("k") > task_edges).select("v")
    hubs = None if hubs.isEmpty() else materialize(hubs, "hubs")
    light = edges.select("src", "dst")
    if hubs is not None:
        for end in ("src", "dst"):
            light = light.join(F.broadcast(hubs.withColumnRenamed("v", end)), end, "left_anti")
    spark = edges.sparkSession
    q = colours_for(n_edges, task_edges)
    # The width is explicit: adaptive execution would merge these short rows into few tasks.
    n_blocks, n_triples = q * (q + 1) // 2, q * (q + 1) * (q + 2) // 6
    width = min(n_blocks, max(shuffle_width(spark), -(-n_edges // task_edges)))
    _, path = materialized_at(colour_blocks(light, q).repartition(width, "block"), "blocks", "block")
    triples = spark.range(0, n_triples, 1, n_triples)
    counts = triples.mapInArrow(_triple_counts(q, path), "src bigint, dst bigint, common bigint")
    if hubs is not None:
        salts = hot_counts(values.select("v", "k"), "v", "k", 2 * n_edges, rows_per_salt)
        counts = counts.unionByName(hub_triangles(edges.select("src", "dst"), hubs, salts))
    return counts.groupBy("src", "dst").agg(F.sum("common").alias("common"))


def embeddedness(edges: DataFrame, rows_per_salt: int = ROWS_PER_SALT, task_edges: int = HELD_EDGES) -> DataFrame:
    """Mean over a vertex's neighbours of |common| / (|union| - 2), a term with an empty divisor being 0: ``(v, e)``.

    Only edges on a triangle have a nonzero term, so only they are joined back to the degrees.
    """
    simple = materialize(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")), "simple")
    n_edges = simple.count()
    values = materialize(degrees(simple), "degrees")
    shared = common_neighbours(simple, values, n_edges, rows_per_salt, task_edges)
    hubs = hot_counts(values, "v", "k", 2 * n_edges, rows_per_salt)
    sized = shared
    for end, other in (("src", "dst"), ("dst", "src")):
        salts = hubs and hubs.withColumnRenamed("v", end)
        sized = join_split(sized, values.select(F.col("v").alias(end), F.col("k").alias(f"k_{end}")), end, salts, other)
    rest = F.col("k_src") + F.col("k_dst") - F.col("common") - 2
    term = F.when(rest != 0, F.col("common") / rest).otherwise(F.lit(0.0))
    sums = (
        sized.select(F.explode(F.array("src", "dst")).alias("v"), term.alias("t"))
        .groupBy("v")
        .agg(F.sum("t").alias("total"))
    )
    return values.join(sums, "v", "left").select("v", (F.coalesce("total", F.lit(0.0)) / F.col("k")).alias("e"))
