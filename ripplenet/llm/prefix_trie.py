"""Trie of conversation prefixes by fixed-length block digests.

A conversation is cut into blocks of ``BLOCK`` turns. Every turn has a mark, a hash of its depth, role and text; a block's
digest is the sum of its marks and a prefix's digest the sum of those of its turns. Conversations are grouped by the prefix
before a block and by the block's digest: such a class is one row, whatever its number of members. Where a prefix is
followed by one class only, the turn boundaries inside the block are nodes already. Only where several classes follow, the
siblings diverge, and the boundaries inside their blocks are refined turn by turn to find how far they go together.

Nothing is computed over subtrees level by level. A conversation owns the nodes of which it is the smallest member, and as
members only leave on the way down these are the end of its path; so the leaves and the distinct words below a node are
sums, over its members, of what each owns. Words saved are the words of all members less the distinct ones.

Sizes: prefix digests come from running sums over range-partitioned blocks, so a conversation of any length is many
tasks; joins on a conversation or a parent with many rows are salted. The digest of a node's ending members streams through
one task in order, a batch at a time, as its definition asks.

Nulls and edge cases: a null role or text is empty. Rows with a null ``conv_id`` are no conversation and are left out. A null
``turn`` comes first; turns with equal numbers are ordered by the hash of role and text, equal rows count each. A
conversation without turns is a member of the root. An empty table has no nodes. Other columns are not looked at. Digests are
94 bits wide and additive: equal ones of different prefixes do not occur by chance, though they could be contrived.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplenet.llm.common import WORD
from ripplenet.operators.ordering import ordered_running
from ripplenet.operators.skew import ROWS_PER_SALT, hot_keys, join_split
from ripplenet.storage import materialize

BLOCK = 4
HEAD_SPAN, HEAD_TURNS = 20, 4
_CLASS = ["block", "before", "digest", "n"]
_NODE = ["depth", "prefix"]


def mark(depth: Column, turn: Column) -> Column:
    """A number of 94 bits for a turn at a depth."""
    high = F.shiftrightunsigned(F.xxhash64(depth, turn), 2).cast("decimal(38,0)")
    low = F.shiftrightunsigned(F.xxhash64(F.lit(1), depth, turn), 32).cast("decimal(38,0)")
    return (high * F.lit(2**32).cast("decimal(11,0)") + low).cast("decimal(29,0)")


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn, words)``: turns in order from 1, as digests with the number of words of their text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").isNotNull().alias("_known"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("_at"), F.unhex(F.sha2(told, 256)).alias("turn"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    ranked = ordered_running(materialize(slim, "turns"), ["conv_id"], ["_known", "_at", "turn"], rank="pos")
    return ranked.select("conv_id", "pos", "turn", "words")


def rebuilt(turns: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> tuple[DataFrame, DataFrame]:
    """Conversations with the head of the first one of their span of ids: ``(conv_id)`` and ``(conv_id, depth, turn, words)``.

    ``turns`` is a written table. The head has CRC-32 of the id modulo ``HEAD_TURNS`` turns, at most those there are.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_turns")).withColumn("_head", head)
    convs = convs.withColumn("_first", F.col("conv_id") - F.col("conv_id") % HEAD_SPAN)
    sizes = convs.select(F.col("conv_id").alias("_first"), F.least("_turns", F.lit(HEAD_TURNS)).alias("_there"))
    convs = convs.join(sizes, "_first", "left").withColumn("_missing", F.col("_head") - F.least("_head", F.coalesce("_there", F.lit(0))))
    convs = materialize(convs.select("conv_id", "_first", "_head", "_missing"), "conversations")
    heads = turns.where((F.col("conv_id") % HEAD_SPAN == 0) & (F.col("pos") < HEAD_TURNS)).withColumnRenamed("conv_id", "_first")
    taken = convs.join(heads, "_first").where("pos <= _head").select("conv_id", F.col("pos").alias("depth"), "turn", "words")
    own = turns.where(F.col("pos") > head)
    salts = hot_keys(turns, "conv_id", turns.count(), rows_per_salt)
    kept = join_split(own, convs.select("conv_id", "_missing"), "conv_id", salts, "pos")
    kept = kept.select("conv_id", (F.col("pos") - F.col("_missing")).alias("depth"), "turn", "words")
    return convs.select("conv_id"), taken.unionByName(kept)


def blocks_of(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, block, before, digest, n, turns, words_before, n_turns, n_words)`` of ``turns (conv_id, depth, turn, words)``.

    ``before`` is the digest of the prefix before the block; the last two are the whole conversation's.
    """
    marked = turns.select("conv_id", "depth", mark(F.col("depth"), F.col("turn")).alias("mark"), "words")
    number = F.floor((F.col("depth") - 1) / block).cast("bigint").alias("block")
    held = marked.groupBy("conv_id", number).agg(
        F.sum("mark").cast("decimal(33,0)").alias("digest"), F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"),
        F.sort_array(F.collect_list(F.struct("depth", "mark", "words"))).alias("turns"),
    )
    whole = ordered_running(
        materialize(held, "blocks"), ["conv_id"], ["block"], sums={"upto": "digest", "words_upto": "words"},
        totals={"n_turns": "n", "n_words": "words"},
    )
    return whole.select(
        "conv_id", "block", _whole(F.col("upto") - F.col("digest")).alias("before"), _whole(F.col("digest")).alias("digest"), "n",
        "turns", (F.col("words_upto") - F.col("words")).alias("words_before"), "n_turns", "n_words",
    )


def _whole(digest: Column) -> Column:
    return digest.cast("decimal(38,0)")


def class_turns(blocks: DataFrame) -> DataFrame:
    """``(conv_id, block, depth, prefix, parent, words, words_before, alone)``: the turns of one member of each class.

    The member is the smallest; ``alone`` marks classes that no other class follows the same prefix beside.
    """
    classes = blocks.groupBy(_CLASS).agg(F.min("conv_id").alias("conv_id"))
    siblings = classes.groupBy("block", "before").agg(F.count(F.lit(1)).alias("_classes"))
    classes = classes.join(siblings, ["block", "before"]).select("conv_id", "block", (F.col("_classes") == 1).alias("alone"))
    each = blocks.join(classes, ["conv_id", "block"])

    def upto(i: Column, field: str, start: Column) -> Column:
        return F.aggregate(F.slice("turns", 1, i), start, lambda total, t: (total + t[field]).cast(kind[field]))

    kind = {"mark": "decimal(38,0)", "words": "bigint"}
    steps = F.transform(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: F.struct(
            F.get("turns", i)["depth"].alias("depth"), upto(i + 1, "mark", F.col("before")).alias("prefix"),
            upto(i, "mark", F.col("before")).alias("parent"), F.get("turns", i)["words"].alias("words"),
            upto(i, "words", F.col("words_before")).alias("words_before"),
        ),
    )
    return each.select("conv_id", "block", "alone", F.inline(steps))


def end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, prefix, ends_sha256)`` from ``(depth, prefix, conv_id)``: SHA-256 of the ids in order, joined by commas.

    Rows pass in order of node and id, so a task holds a batch and one running hash.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            done = []
            for *key, conv_id in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "conv_id")), strict=True):
                if key == node:
                    running.update(b",%d" % conv_id)
                    continue
                if node is not None:
                    done.append((*node, running.hexdigest()))
                node, running = key, hashlib.sha256(b"%d" % conv_id)
            yield _digest_rows(done)
        if node is not None:
            yield _digest_rows([(*node, running.hexdigest())])

    ordered = ends.repartition(*_NODE).sortWithinPartitions(*_NODE, "conv_id")
    return ordered.select(*_NODE, "conv_id").mapInArrow(hashed, "depth bigint, prefix decimal(38,0), ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    kinds = [pa.int64(), pa.decimal128(38, 0), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*_NODE, "ends_sha256"])


def trie(convs: DataFrame, turns: DataFrame, block: int = BLOCK, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """One row for each node of the trie over ``convs (conv_id)`` and their ``turns (conv_id, depth, turn, words)``.

    Columns: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``.
    """
    blocks = materialize(blocks_of(turns, block), "trie-blocks")
    salts = hot_keys(blocks, "conv_id", blocks.count(), rows_per_salt)
    steps = materialize(class_turns(blocks), "trie-steps")
    # Nodes with their smallest member; those of a class without siblings need no grouping.
    node = ["depth", "prefix", "parent", "conv_id", "words", "words_before"]
    merged = steps.where("not alone").groupBy(*_NODE).agg(*[F.min(c).alias(c) for c in node[2:]])
    nodes = steps.where("alone").select(node).unionByName(merged.select(node))
    below = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(below, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    # What a conversation owns: the words of its nodes, and a leaf if its path ends in one of them.
    owned = nodes.groupBy("conv_id").agg(
        F.sum("words").alias("own"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"), F.min("depth").alias("since")
    )
    last = blocks.where(F.col("block") * block + F.col("n") == F.col("n_turns"))
    last = last.select("conv_id", "n_turns", "n_words", (F.col("before") + F.col("digest")).cast("decimal(38,0)").alias("prefix"))
    each = convs.join(owned, "conv_id", "left").join(last, "conv_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    each = materialize(each.select(
        "conv_id", zero("own"), zero("leaf"), "since", zero("n_turns"), zero("n_words"),
        F.coalesce("prefix", F.lit(0)).cast("decimal(38,0)").alias("prefix"),
    ), "trie-owners")
    sums = lambda n: [F.sum(n).alias("n_convs")] + [F.sum(c).alias(f"all_{c}") for c in ("own", "leaf", "n_words")]
    members = join_split(blocks.select("conv_id", *_CLASS), each.select("conv_id", "own", "leaf", F.col("n_words")), "conv_id", salts, "block")
    weighed = members.groupBy(_CLASS).agg(*sums(F.lit(1)), F.min("conv_id").alias("conv_id"))
    totals = ["n_convs", "all_own", "all_leaf", "all_n_words"]
    parts = steps.select("conv_id", "block", "alone", *_NODE).join(weighed.select("conv_id", "block", *totals), ["conv_id", "block"])
    merged = parts.where("not alone").groupBy(*_NODE).agg(*[F.sum(c).alias(c) for c in totals])
    counted = parts.where("alone").select(*_NODE, *totals).unionByName(merged)
    full = nodes.join(counted, _NODE).select(*node, "n_children", *totals)
    few = each.select("conv_id", "own", "since", F.col("n_words").alias("w"))
    full = join_split(full, few, "conv_id", salts, "depth")
    distinct = F.col("all_own") - F.col("own") + F.col("w") - F.col("words_before")
    saved = F.col("all_n_words") - F.col("n_convs") * F.col("words_before") - distinct
    full = full.select(
        *node[:4], "since", "n_convs", "n_children", F.col("all_leaf").alias("n_leaves"), saved.alias("saved_tokens")
    )
    root = each.agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("leaf").alias("_leaves"),
        (F.sum("n_words") - F.sum("own")).alias("saved_tokens"),
    ).where("n_convs > 0")
    first = nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"))
    root = root.select(
        F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("decimal(38,0)").alias("prefix"), F.lit(None).cast("decimal(38,0)").alias("parent"),
        "conv_id", F.lit(None).cast("bigint").alias("since"), "n_convs", F.lit(first.first()[0]).alias("n_children"),
        F.greatest("_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens",
    )
    both = materialize(full.unionByName(root), "trie-full")
    ends = end_digests(each.select(F.col("n_turns").alias("depth"), "prefix", "conv_id"))
    smallest = root.select("conv_id").first()
    # Below its first own node a conversation's parents are its own too; the others are looked up, the root's children known.
    strange = both.where("depth = since AND depth > 1").withColumn("_key", _key("depth", "parent", -1))
    hubs = hot_keys(strange, "_key", strange.count(), rows_per_salt)
    upper = both.where("n_children > 0").select(_key("depth", "prefix").alias("_key"), F.col("conv_id").alias("parent_conv_id"))
    looked_up = join_split(strange, upper, "_key", hubs, "conv_id").drop("_key")
    known = both.where("since IS NULL OR depth <> since OR depth = 1")
    parent = F.when(F.col("depth") == 1, F.lit(smallest and smallest[0])).when(F.col("depth") > 1, F.col("conv_id"))
    out = looked_up.unionByName(known.withColumn("parent_conv_id", parent.cast("bigint"))).join(ends, _NODE, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def _key(depth: str, prefix: str, shift: int = 0) -> Column:
    return F.concat_ws(":", F.col(depth) + shift, F.col(prefix).cast("string"))


def rebuilt_trie(conversations: DataFrame, block: int = BLOCK, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """The contract's trie: over conversations rebuilt with shared heads."""
    turns = materialize(turns_of(conversations), "ordered-turns")
    convs, again = rebuilt(turns, rows_per_salt)
    return trie(convs, again, block, rows_per_salt)
