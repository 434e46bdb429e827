"""Bounded waves around seeds and the inclusions they produce.

All runs advance together: a vertex is visited once per run key, and one expansion up to the largest wave yields the
inclusions of every smaller one. With ``d`` the hop distance to the nearest seed, a vertex ``v`` is included

    [v is a seed] + #{ edges (u, v) : d(u) <= d(v) <= wave and d(u) < wave }

times. An expansion of the vertices at distance ``w`` therefore adds, from wave ``w + 1`` on, one inclusion per edge to
vertices at distance ``w`` or ``w + 1`` -- and only those rows, counted before any shuffle, ever leave the join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplenet.operators.cleaning import friends_of, without
from ripplenet.operators.ordering import ordered_running
from ripplenet.operators.skew import ROWS_PER_SALT, add_salt, hot_counts, repeat_per_salt
from ripplenet.operators.structure import degrees
from ripplenet.storage import materialize, materialize_bucketed, materialize_by, shuffle_width

MAX_WAVE = 149
ROWS_PER_BUCKET = 1_000_000
# Runs are the caller's; up to this number, some 20 MB, their table goes to all executors.
BROADCAST_RUNS = 1_000_000
# A hit counted before the shuffle has a number for each lane; with more lanes than this its bitmap is shuffled uncounted.
COUNTED_LANES = 4
_LOW = 0xFFFFFFFF


@dataclass(frozen=True)
class Adjacency:
    """Both directions of an undirected edge table, split at hubs and laid out for repeated joins on ``src``."""

    pairs: DataFrame  # src, dst[, w]: each edge once
    edges: DataFrame  # src, dst[, salt][, w]: both directions
    salts: DataFrame | None  # src, n_salt: hubs only
    degrees: DataFrame  # v, k


def build_adjacency(
    edges: DataFrame, buckets: int | None = None, rows_per_salt: int = ROWS_PER_SALT, rounds: int | None = None
) -> Adjacency:
    """Write the adjacency table of a de-duplicated undirected edge table ``(src, dst[, w])``.

    Bucketed on ``src``, or on (src, salt) if there are hubs: every later round joins it where it lies, and a hub spreads
    over many buckets. A small graph gets no more buckets than there are cores. ``rounds`` is the number of joins to come, if
    known: for a single one the edges are not laid out, as that shuffles them at least as often as the join itself.
    """
    weight = [c for c in edges.columns if c == "w"]
    pairs = materialize(edges.select("src", "dst", *weight), "edges")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *weight))
    rows = 2 * pairs.count()
    counts = degrees(pairs)
    if rows > rows_per_salt:  # asked for hubs here and again by most callers
        counts = materialize(counts, "degrees")
    salts = hot_counts(counts.withColumnRenamed("v", "src"), "src", "k", rows, rows_per_salt)
    on = ["src"] if salts is None else ["src", "salt"]
    ends = both if salts is None else add_salt(both, "src", salts, spread_by="dst")
    if rounds is not None and rounds <= 1:
        return Adjacency(pairs, ends, salts, counts)
    spark = edges.sparkSession
    few = min(shuffle_width(spark), spark.sparkContext.defaultParallelism)
    width = buckets or max(few, -(-rows // ROWS_PER_BUCKET))
    return Adjacency(pairs, materialize_bucketed(ends, on, width, "adjacency"), salts, counts)


def neighbours_of(adj: Adjacency, vertices: DataFrame) -> DataFrame:
    """Join ``vertices(v, ...)`` to their edges; adds ``dst`` (and ``w``). The vertex column becomes ``src``."""
    ends = vertices.withColumnRenamed("v", "src")
    if adj.salts is None:
        return ends.join(adj.edges, "src")
    return repeat_per_salt(ends, "src", adj.salts).join(adj.edges, ["src", "salt"]).drop("salt")


def _check_wave(max_wave: int) -> None:
    if not 0 <= max_wave <= MAX_WAVE:
        raise ValueError(f"wave must lie in 0..{MAX_WAVE}, got {max_wave}")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass(frozen=True)
class PackedIncrements:
    """Inclusions of up to 64 runs in a row: ``rows (block, wave, v, counted, fresh, lanes)`` and ``runs (block, bit, keys)``.

    ``counted`` and ``fresh`` are bitmaps of the block's runs; two runs' inclusions share one of the lanes.
    """

    rows: DataFrame
    runs: DataFrame
    n_runs: int
    lanes: int
    keys: list[str]

    def unpack(self, *carried: str) -> DataFrame:
        """``(keys, wave, v, m, fresh)`` and the ``carried`` columns of ``rows``: a row for each run that includes ``v``."""
        lanes, width = self.lanes, min(64, 2 * self.lanes)
        held = F.array(*[F.col(f"_l{i}") for i in range(lanes)])
        here = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("getbit", F.col("counted"), i) == 1)
        each = self.rows.select(
            "block", "wave", "v", "fresh", held.alias("_held"), *carried, F.explode(here).alias("bit")
        )
        pair = F.get("_held", F.col("bit") % lanes)
        m = F.when(F.col("bit") < lanes, pair.bitwiseAND(F.lit(_LOW))).otherwise(F.shiftrightunsigned(pair, 32))
        fresh = F.call_function("getbit", F.col("fresh"), F.col("bit")) == 1
        each = each.select("block", "bit", "wave", "v", m.alias("m"), fresh.alias("fresh"), *carried)
        runs = F.broadcast(self.runs) if self.n_runs <= BROADCAST_RUNS else self.runs
        return each.join(runs, ["block", "bit"]).select(*self.keys, "wave", "v", "m", "fresh", *carried)


def _lane_counts(bits: Column, lanes: int) -> list[Column]:
    """The runs of a bitmap as ones: run ``i`` in the lower half of lane ``i``, run ``i + lanes`` in the upper half."""
    one = lambda i: F.shiftrightunsigned(bits, i).bitwiseAND(F.lit(1).cast("bigint"))
    return [one(i) + (F.shiftleft(one(i + lanes), 32) if i + lanes < 64 else F.lit(0)) for i in range(lanes)]


def pack_runs(seeds: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """Seeds as ``(block, v, bits)``, the runs ``(block, bit, keys)`` and their number."""
    keys = list(keys)
    numbered = materialize(ordered_running(seeds.select(*keys).distinct(), [], keys, rank="_at"), "runs")
    n_runs = numbered.count()
    block = F.floor((F.col("_at") - 1) / 64).cast("bigint").alias("block")
    runs = numbered.select(block, ((F.col("_at") - 1) % 64).cast("int").alias("bit"), *keys)
    marked = seeds.select(*keys, "v").distinct().join(runs, keys)
    packed = marked.groupBy("block", "v").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits"))
    return packed, runs, n_runs


def packed_increments(
    adj: Adjacency, seeds: DataFrame, max_wave: int, keys: Sequence[str] = ("run_id",)
) -> PackedIncrements:
    """``wave_increments`` with the runs of a vertex side by side in bitmaps.

    An edge is followed once for all runs of a block whose frontier holds its end. With few runs its hits are counted before
    the shuffle. With many a counted row is ten times as long as the bitmap of a hit, and on a large graph a task seldom hits a
    vertex twice: there the bitmaps are shuffled, so their bytes follow the edges. With hubs, hits are always counted first.
    """
    _check_wave(max_wave)
    level, runs, n_runs = pack_runs(seeds, keys)
    level = materialize(level, "wave0")
    lanes = max(1, (min(n_runs, 64) + 1) // 2)
    names = [f"_l{i}" for i in range(lanes)]
    at = ["block", "v"]
    steps = [
        level.select(
            "block", F.lit(0).alias("wave"), "v", F.col("bits").alias("counted"), F.col("bits").alias("fresh"),
            *[c.alias(n) for n, c in zip(names, _lane_counts(F.col("bits"), lanes), strict=True)],
        )
    ]
    previous = None
    for wave in range(max_wave):
        followed = neighbours_of(adj, level).select("block", F.col("dst").alias("v"), "bits")
        if lanes > COUNTED_LANES and adj.salts is None:
            followed = followed.repartition(*at)
        hits = followed.groupBy(*at).agg(
            F.bit_or("bits").alias("_any"), *[F.sum(c).alias(n) for n, c in zip(names, _lane_counts(F.col("bits"), lanes), strict=True)]
        )
        # A neighbour of distance-w vertices sits at w-1, w or w+1: only the last two levels need to be looked up.
        none = F.lit(0).cast("bigint")
        recent = level.select(*at, F.col("bits").alias("_same"), none.alias("_before"))
        if previous is not None:
            recent = recent.unionByName(previous.select(*at, none.alias("_same"), F.col("bits").alias("_before")))
            recent = recent.groupBy(*at).agg(F.bit_or("_same").alias("_same"), F.bit_or("_before").alias("_before"))
        found = hits.join(recent, at, "left")
        counted = F.col("_any").bitwiseAND(F.bitwise_not(F.coalesce("_before", none)))
        fresh = F.col("counted").bitwiseAND(F.bitwise_not(F.coalesce("_same", none)))
        step = found.withColumn("counted", counted).where("counted <> 0").select(
            "block", F.lit(wave + 1).alias("wave"), "v", "counted", fresh.alias("fresh"), *names
        )
        if wave + 1 < max_wave:
            step = materialize(step, f"wave{wave + 1}")
        steps.append(step)
        previous, level = level, step.where("fresh <> 0").select(*at, F.col("fresh").alias("bits"))
        if 1 < wave + 1 < max_wave and level.isEmpty():
            break
    return PackedIncrements(_union(steps), runs, n_runs, lanes, list(keys))


def wave_increments(
    adj: Adjacency, seeds: DataFrame, max_wave: int, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Inclusions by the wave at which they appear: ``(keys, wave, v, m, fresh)``.

    ``m`` inclusions of ``v`` count for this wave and every later one; ``fresh`` marks the wave that first reached
    ``v``. Edges must be de-duplicated and cost one hop each; see ``wave_distance`` for other costs.
    """
    return packed_increments(adj, seeds, max_wave, keys).unpack()


def wave_distance(
    adj: Adjacency,
    seeds: DataFrame,
    max_wave: int,
    keys: Sequence[str] = ("run_id",),
    hop_cost: int = 1,
) -> DataFrame:
    """Distance to the nearest seed, up to ``max_wave``: ``(keys, v, d)``. Unreached vertices are absent.

    Edge costs are the integer column ``w`` of the adjacency where it has one, else ``hop_cost``. Vertices are settled
    in the order of their distance, so each is expanded once and nothing beyond ``max_wave`` is ever touched. Offers are
    written in folders by their distance and a round reads those that are due. An offer of an edge of cost ``w`` that is due
    at ``d`` meets a vertex that is at ``d - 2w`` or later, so only the levels within twice the greatest cost are looked up:
    what all rounds read together is in proportion to what they wrote.
    """
    _check_wave(max_wave)
    keys = list(keys)
    at = [*keys, "v"]
    weighted = "w" in adj.edges.columns
    cost = F.col("w") if weighted else F.lit(hop_cost)
    dearest = max(1, (adj.edges.agg(F.max("w")).first()[0] or 1) if weighted else hop_cost)
    settled = [seeds.select(*at).distinct().withColumn("d", F.lit(0))]
    offers: list[DataFrame] = []
    for d in range(max_wave):
        offer = (
            neighbours_of(adj, settled[d])
            .select(*keys, F.col("dst").alias("v"), (F.col("d") + cost).cast("int").alias("d"))
            .where(F.col("d") <= max_wave)
            .distinct()
        )
        offers.append(materialize_by(offer, "d", f"offers{d}"))
        # An offer made in round r is due by r + dearest at the latest.
        due = _union(offers[max(0, d + 1 - dearest) :]).where(F.col("d") == d + 1).select(*at).distinct()
        known = _union(settled[max(0, d + 1 - 2 * dearest) :]).select(*at)
        level = due.join(known, at, "left_anti").withColumn("d", F.lit(d + 1))
        settled.append(materialize(level, f"settled{d + 1}") if d + 1 < max_wave else level)
    return _union(settled)


def increments_from_distance(
    adj: Adjacency, distance: DataFrame, seeds: DataFrame, max_wave: int, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Inclusions ``(keys, wave, v, m, fresh)`` of any distance table; the general form of ``wave_increments``.

    Neighbour distances are counted per (v, distance) before the second join, so hubs collapse map-side.
    """
    keys = list(keys)
    near = (
        neighbours_of(adj, distance.withColumnRenamed("d", "near"))
        .groupBy(*keys, F.col("dst").alias("v"), "near")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    from_edges = (
        near.join(distance, [*keys, "v"])
        .where(F.col("near") <= F.col("d"))
        .select(*keys, F.greatest("d", F.col("near") + 1).alias("wave"), "v", "m", F.lit(False).alias("fresh"))
        .where(F.col("wave") <= max_wave)
    )
    reached = distance.join(seeds.select(*keys, "v").withColumn("_seed", F.lit(1)), [*keys, "v"], "left").select(
        *keys, F.col("d").alias("wave"), "v", F.coalesce("_seed", F.lit(0)).cast("bigint").alias("m"),
        F.lit(True).alias("fresh"),
    )
    return (
        from_edges.unionByName(reached)
        .groupBy(*keys, "wave", "v")
        .agg(F.sum("m").alias("m"), F.bool_or("fresh").alias("fresh"))
    )


def per_seed(seeds: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Seeds as runs of their own: adds ``seed``. Traverse with ``keys=(..., "seed")``, then ``pool_seeds``."""
    return seeds.select(*keys, F.col("v").alias("seed"), "v")


def pool_seeds(increments: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Concatenate the single-seed runs: overlaps count once per seed."""
    first = increments.groupBy(*keys, "v").agg(F.min(F.when(F.col("fresh"), F.col("wave"))).alias("first"))
    summed = increments.groupBy(*keys, "wave", "v").agg(F.sum("m").alias("m"))
    return summed.join(first, [*keys, "v"]).select(
        *keys, "wave", "v", "m", (F.col("wave") == F.col("first")).alias("fresh")
    )


def _increments(adj: Adjacency, seeds: DataFrame, max_wave: int, keys: Sequence[str], hop_cost: int) -> DataFrame:
    """Unit-cost edges advance by levels; other costs settle distances first."""
    if "w" not in adj.edges.columns and hop_cost == 1:
        return wave_increments(adj, seeds, max_wave, keys)
    distance = materialize(wave_distance(adj, seeds, max_wave, keys, hop_cost), "distance")
    return increments_from_distance(adj, distance, seeds, max_wave, keys)


def lmsi_increments(
    adj: Adjacency,
    seeds: DataFrame,
    max_wave: int,
    method: str = "pooled",
    keys: Sequence[str] = ("run_id",),
    hop_cost: int = 1,
    packed: bool = False,
) -> DataFrame | PackedIncrements:
    """Labelled snowball with multiple inclusions: all seeds of a run together, or each seed on its own.

    An edge costs its column ``w`` where the adjacency has one, else ``hop_cost``. ``packed`` asks for pooled runs of unit
    cost as ``PackedIncrements``, which callers that collapse vertices unpack late.
    """
    if packed and method == "pooled" and "w" not in adj.edges.columns and hop_cost == 1:
        return packed_increments(adj, seeds, max_wave, keys)
    if method == "pooled":
        return _increments(adj, seeds, max_wave, keys, hop_cost)
    if method == "per_seed":
        return pool_seeds(_increments(adj, per_seed(seeds, keys), max_wave, (*keys, "seed"), hop_cost), keys)
    raise ValueError(f"method must be 'pooled' or 'per_seed', got {method!r}")


def inclusions(increments: DataFrame, waves: Sequence[int], keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """The multiset of each wave, as multiplicities: ``(keys, wave, v, m)``."""
    listed = F.array(*[F.lit(w) for w in sorted(waves)])
    spread = increments.withColumn("_to", F.explode(F.filter(listed, lambda w: w >= F.col("wave"))))
    return spread.groupBy(*keys, F.col("_to").alias("wave"), "v").agg(F.sum("m").alias("m"))


def wave_edges(adj: Adjacency, seeds: DataFrame, wave: int, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Undirected edges touching the ball of radius ``wave - 1``; waves 0 and 1 both give the incident edges."""
    ball = wave_distance(adj, seeds, max(wave - 1, 0), keys).select(*keys, "v")
    touched = neighbours_of(adj, ball)
    return touched.select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def snowball(links: DataFrame, seeds: DataFrame, labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two-wave frontier: (kept wave one, new wave two).

    Wave one are the friends of the seeds; the ``labelled`` ones are kept and lead to wave two.
    """
    wave_one = materialize(without(friends_of(links, seeds), seeds), "wave_one")
    kept = wave_one.join(labelled.select("v"), "v", "left_semi")
    wave_two = without(friends_of(links, kept), wave_one, seeds)
    return kept, wave_two


def crawl_frontier(links: DataFrame, seeds: DataFrame, fetched: DataFrame) -> DataFrame:
    """Friends of friends of the seeds that have not been fetched yet."""
    return without(friends_of(links, friends_of(links, seeds)), fetched)


def unexpanded_friends(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Friends of the seeds that are not seeds with links of their own."""
    own = links.join(seeds.select(F.col("v").alias("src")), "src", "left_semi").select(F.col("src").alias("v"))
    return without(friends_of(links, seeds), own.distinct())
