"""Merkle manifest of a dataset: a hash tree over its rows, and a proof for each row.

Rows are the leaves of one binary tree for each language; the trees' roots are the leaves of one more. In a level every
two consecutive nodes become the hash of their digests, a last single one becomes the hash of its own, and one node alone
is the root.

The tree is not kept. Only the leaves and every ``stride``-th level above them are written, so a tree of n leaves costs
n / 2**stride more digests. A proof needs the siblings on all levels: each stored node is the top of an aligned subtree of
at most 2**stride stored descendants, from which a task regenerates the missing interior, hands every descendant its
siblings and forgets them. Proofs grow downwards: the path of a subtree's top continues the path of all below it, so a
leaf is never joined with anything but its own subtree. Positions come from a range partition of digests, never of texts,
and a language of any size is many subtrees.

Nulls and edge cases: a null value is hashed as ``-``. A null language is a group of its own and comes first, as does a
null ``doc_id`` inside its language. Rows that repeat an id are ordered by their digest; equal rows are equal leaves with a
place each. A lone leaf is its own root and has the hash of nothing as its proof. An empty table gives an empty result.
Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplenet.operators.ordering import ordered_running
from ripplenet.storage import materialize

STRIDE = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(values: Sequence[Column]) -> Column:
    """SHA-256 in hex of the values, each with its length before it, a null as ``-``."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_above(nodes: list[str], height: int) -> list[list[str]]:
    """The level of ``nodes`` and the ``height`` levels above it."""
    levels = [nodes]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings(levels: list[list[str]], place: int) -> list[str]:
    """The path of the node at ``place`` to the top: ``L`` or ``R`` and the sibling on that side, empty for none."""
    path = []
    for level in levels[:-1]:
        other = place ^ 1
        path.append(("L" if place & 1 else "R") + level[other] if other < len(level) else "")
        place >>= 1
    return path


def fold(leaf: str, path: Sequence[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for step in path:
        leaf = digest(leaf) if not step else digest(step[1:], leaf) if step[0] == "L" else digest(leaf, step[1:])
    return leaf


def height_of(size: int, stride: int) -> int:
    """Levels from a stored level of ``size`` nodes to the next stored one, or to the root."""
    return min(stride, (size - 1).bit_length())


@dataclass(frozen=True)
class Forest:
    """Trees ``group`` by their stored levels ``(group, pos, digest, size)``, leaves first; the last level holds the roots."""

    stored: list[DataFrame]
    stride: int

    @property
    def roots(self) -> DataFrame:
        return self.stored[-1].select("group", "digest")


def _subtrees(nodes: DataFrame, stride: int, *carried: str) -> DataFrame:
    """One row for each aligned subtree: at most 2**stride nodes in order."""
    node = F.struct("pos", "digest", *carried)
    top = F.shiftright("pos", stride).alias("top")
    return nodes.groupBy("group", top).agg(F.sort_array(F.collect_list(node)).alias("nodes"), F.max("size").alias("size"))


def build(leaves: DataFrame, stride: int = STRIDE) -> Forest:
    """The trees over written ``leaves (group, pos, digest, size)``: places from 0 and the number of leaves of the tree."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                levels_above(nodes.values.field("digest").to_pylist(), height_of(size.as_py(), stride))[-1][0]
                for nodes, size in zip(batch.column("nodes"), batch.column("size"), strict=True)
            ]
            size = [(n + (1 << stride) - 1) >> stride for n in batch.column("size").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("group"), batch.column("top"), pa.array(made, pa.string()), pa.array(size, pa.int64())],
                ["group", "pos", "digest", "size"],
            )

    stored = [leaves]
    largest = leaves.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        above = _subtrees(stored[-1], stride).mapInArrow(tops, "group string, pos bigint, digest string, size bigint")
        stored.append(materialize(above, "merkle-level"))
        largest = (largest + (1 << stride) - 1) >> stride
    return Forest(stored, stride)


def paths(forest: Forest, above: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """``(group, pos, digest, carried, path, root)`` of every leaf.

    ``above (group, path, root)`` continues the path of each tree's own root, with the digest that it ends at.
    """
    lower = above.select("group", F.lit(0).cast("bigint").alias("pos"), "path", "root")
    for level in reversed(range(max(len(forest.stored) - 1, 1))):
        nodes, more = forest.stored[level], list(carried) if level == 0 else []
        held = _subtrees(nodes, forest.stride, *more).join(lower.withColumnRenamed("pos", "top"), ["group", "top"])
        kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
        names = ["group", "pos", "digest", *more, "path", "root"]
        schema = ", ".join(f"{n} {kinds[n]}" for n in ["group", "pos", "digest", *more]) + ", path array<string>, root string"
        lower = held.mapInArrow(_spread(names, more, forest.stride), schema)
        if level:
            lower = materialize(lower.select("group", "pos", "path", "root"), "merkle-paths")
    return lower


def _spread(names: list[str], more: list[str], stride: int):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                nodes = batch.column("nodes")[row].values
                own = nodes.field("digest").to_pylist()
                levels = levels_above(own, height_of(batch.column("size")[row].as_py(), stride))
                rest = batch.column("path")[row].as_py()
                held = {
                    "group": pa.array([batch.column("group")[row].as_py()] * len(own), pa.string()),
                    "pos": nodes.field("pos"), "digest": nodes.field("digest"),
                    "path": pa.array([siblings(levels, i) + rest for i in range(len(own))], pa.list_(pa.string())),
                    "root": pa.array([batch.column("root")[row].as_py()] * len(own), pa.string()),
                    **{name: nodes.field(name) for name in more},
                }
                yield pa.RecordBatch.from_arrays([held[n] for n in names], names)

    return spread


def _placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds the place ``pos`` from 0 in its group and the group's ``size``."""
    counted = ordered_running(rows.withColumn("_one", F.lit(1)), group, order, rank="_rank", totals={"size": "_one"})
    return counted.withColumn("pos", F.col("_rank") - 1).drop("_one", "_rank")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, stride: int = STRIDE, changed: Column | None = None) -> DataFrame:
    """``(doc_id, leaf, subroot, root, path, changed)`` for each row of ``docs``.

    ``path`` leads from the leaf to ``root``, see ``siblings``. ``changed`` carries another digest along, or null.
    """
    slim = docs.select(
        F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang"))).alias("group"),
        F.col("doc_id").cast("bigint").alias("doc_id"), row_digest([F.col(c) for c in fields]).alias("digest"),
        (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
    )
    slim = slim.withColumn("_known", F.col("doc_id").isNotNull()).withColumn("_order", F.coalesce("doc_id", F.lit(0)))
    placed = _placed(materialize(slim, "merkle-digests"), ["group"], ["_known", "_order", "digest"])
    leaves = materialize(placed.select("group", "pos", "digest", "size", "doc_id", "changed"), "merkle-leaves")
    trees = build(leaves, stride)
    # The trees' roots are placed by language and are the leaves of one more tree.
    subroots = _placed(trees.roots.withColumnRenamed("group", "lang"), [], ["lang"])
    subroots = materialize(subroots.select(F.lit("").alias("group"), "pos", "digest", "size", "lang"), "merkle-subroots")
    whole = build(subroots, stride)
    none = F.array().cast("array<string>")
    upper = paths(whole, whole.roots.select("group", none.alias("path"), F.col("digest").alias("root")), ["lang"])
    upper = materialize(upper.select(F.col("lang").alias("group"), "path", F.concat("digest", "root").alias("root")), "merkle-upper")
    out = paths(trees, upper, ["doc_id", "changed"])
    return out.select(
        "doc_id", F.col("digest").alias("leaf"), F.substring("root", 1, 64).alias("subroot"),
        F.substring("root", 65, 64).alias("root"), "path", "changed",
    )


def checked(rows: DataFrame) -> DataFrame:
    """Rows of ``manifest`` with ``proof_sha256``, the hash of all siblings, and the ``folded_root`` of the changed leaf."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_paths = batch.column("path").to_pylist()
            proofs = [digest(*[step[1:] for step in path]) for path in all_paths]
            seen = zip(batch.column("changed").to_pylist(), batch.column("leaf").to_pylist(), all_paths, strict=True)
            roots = [fold(changed or leaf, path) for changed, leaf, path in seen]
            kept = ["doc_id", "leaf", "subroot", "root"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(proofs, pa.string()), pa.array(roots, pa.string())],
                [*kept, "proof_sha256", "folded_root"],
            )

    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return rows.mapInArrow(folded, schema).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampering(docs: DataFrame, every: int = 7) -> DataFrame:
    """The contract's check: rows whose id's CRC-32 is a multiple of ``every`` come with one more in ``n_chars``."""
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return checked(manifest(docs, changed=F.when(chosen, row_digest(changed))))
