"""Edge cleaning, subgraphs and set operations on edge tables ``(src, dst)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplenet.operators.skew import ROWS_PER_SALT, hot_ends, join_split, semi_split


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Undirected form: the smaller end first; other columns stay."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest)


def clean_edges(edges: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Simple undirected graph: no self loops, no repeats. With ``values(v, ...)`` both ends must have a value.

    The value filter runs before the de-duplication, so that the shuffle carries only edges that stay.
    """
    pairs = canonical_edges(drop_self_loops(edges.select("src", "dst")))
    if values is not None:
        pairs = keep_vertices(pairs, values)
    return pairs.distinct()


def mutual_edges(edges: DataFrame, attr: int | None = None) -> DataFrame:
    """Undirected edges present in both directions. ``attr=2`` adds the edge attribute ``w`` such graphs carry.

    One aggregation replaces de-duplicate-then-count: a pair is mutual when both orientations occur.
    """
    pairs = canonical_edges(
        drop_self_loops(edges.select("src", "dst")).withColumn("_up", F.col("src") < F.col("dst"))
    )
    both = pairs.groupBy("src", "dst").agg(F.bool_or("_up").alias("_any_up"), F.bool_and("_up").alias("_all_up"))
    kept = both.where(F.col("_any_up") & ~F.col("_all_up")).select("src", "dst")
    return kept if attr is None else kept.withColumn("w", F.lit(attr))


def merge_multi_edges(edges: DataFrame) -> DataFrame:
    """One row per directed edge with the summed attribute ``w`` (1 where the table has none)."""
    weighted = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1))
    return weighted.groupBy("src", "dst").agg(F.sum("w").cast("bigint").alias("w"))


def keep_vertices(edges: DataFrame, members: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Edges whose both ends occur in ``members(v, ...)``; ends with many edges are split over tasks."""
    ids = members.select("v").distinct()
    hot = hot_ends(edges, rows_per_salt=rows_per_salt)
    for end, other in (("src", "dst"), ("dst", "src")):
        edges = semi_split(edges, ids.withColumnRenamed("v", end), end, hot[end], other).select(*edges.columns)
    return edges


def induced_edges(edges: DataFrame, members: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Distinct edges of the subgraph on a vertex set, directions kept."""
    return keep_vertices(edges.select("src", "dst"), members, rows_per_salt).distinct()


def vertex_subgraph(
    edges: DataFrame, vertices: DataFrame, predicate: Column, rows_per_salt: int = ROWS_PER_SALT
) -> tuple[DataFrame, DataFrame]:
    """Vertices passing ``predicate`` and the edges between them."""
    kept = vertices.where(predicate)
    return kept, keep_vertices(edges, kept, rows_per_salt)


def edge_subgraph(edges: DataFrame, predicate: Column) -> DataFrame:
    return edges.where(predicate)


def with_constant(df: DataFrame, name: str, value: int | float | str) -> DataFrame:
    """Constant attribute on every vertex or edge."""
    return df.withColumn(name, F.lit(value))


def vertices_of(edges: DataFrame) -> DataFrame:
    """Distinct end points, as ``v``."""
    return edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def distinct_users(users: DataFrame) -> DataFrame:
    """A user is identified by screen name and creation time."""
    return users.dropDuplicates(["screen_name", "created"])


def friends_of(links: DataFrame, members: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Distinct ``dst`` of the links that start in ``members(v)``; members with many links are split over tasks."""
    hot = hot_ends(links, ["src"], rows_per_salt)
    ids = members.select(F.col("v").alias("src")).distinct()
    return semi_split(links.select("src", "dst"), ids, "src", hot["src"], "dst").select(F.col("dst").alias("v")).distinct()


def without(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Members ``v`` of ``left`` found in none of ``others``."""
    for other in others:
        left = left.join(other.select("v"), "v", "left_anti")
    return left


def lookup_or(df: DataFrame, table: DataFrame, on: str, column: str, default: int | float | str) -> DataFrame:
    """Left join of one column with a default for the missing."""
    found = df.join(table.select(on, column), on, "left")
    return found.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def triplets(edges: DataFrame, attributes: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``(src, src_attr, dst, dst_attr)``: every edge with the attribute ``a`` of both ends, hot ends split over tasks."""
    hot = hot_ends(edges, rows_per_salt=rows_per_salt)
    for end, other in (("src", "dst"), ("dst", "src")):
        side = attributes.select(F.col("v").alias(end), F.col("a").alias(f"{end}_attr"))
        edges = join_split(edges, side, end, hot[end], other)
    return edges.select("src", "src_attr", "dst", "dst_attr")


def update_min(vertices: DataFrame, updates: DataFrame) -> DataFrame:
    """Attribute ``a`` lowered to the update where there is one, kept where there is none."""
    new = updates.groupBy("v").agg(F.min("a").alias("_new"))
    return vertices.join(new, "v", "left").select("v", F.least("a", "_new").alias("a"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(v, m)`` of ``left`` with the multiplicities of ``right`` taken away."""
    taken = right.select("v", F.col("m").alias("_taken"))
    rest = left.join(taken, "v", "left").withColumn("m", F.col("m") - F.coalesce("_taken", F.lit(0)))
    return rest.where(F.col("m") > 0).select("v", "m")
