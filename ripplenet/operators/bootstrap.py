"""Inverse-value bootstrap of wave samples and its summary.

The statistic of a replicate sees candidates only through their value ``k``. Inclusions are therefore collapsed to
``(run, wave, k, n, weight)`` first: with degrees as values there are at most sqrt(4E) distinct ones for E edges, however
many vertices a wave reaches. Replicates then work on that table, either with hashed draws that any SQL engine can
repeat, or with multinomial counts whose cost does not depend on the sample size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplenet.functions.hashing import draw_below
from ripplenet.functions.weights import WEIGHT_SCALE, inverse_weight
from ripplenet.operators.lookup import cumulative, cumulative_lookup
from ripplenet.operators.ordering import ordered_running
from ripplenet.operators.sampling import explode_count, hashed_draws
from ripplenet.operators.statistics import median_by_counts, percentile_of_array
from ripplenet.operators.traversal import PackedIncrements
from ripplenet.storage import materialize, shuffle_width

RUN_WAVE = ["run_id", "wave"]
CELL_VALUES = 1024
REPS_PER_ROW = 250
# Replicates that split their draws side by side: a task holds a few numbers for each.
SPLIT_REPS_PER_ROW = 1000
# See _stirling_tail: of 0 to 9.
TAILS = [math.lgamma(x + 1.0) - 0.5 * math.log(2 * math.pi) - (x + 0.5) * math.log(x + 1.0) + (x + 1.0) for x in range(10)]


def attach_values(df: DataFrame, values: DataFrame, default: int | None = None) -> DataFrame:
    """Join ``values(v, k)``; a vertex without a value takes ``default``, or stops the job if there is none."""
    found = df.join(values.select("v", F.col("k").cast("bigint").alias("k")), "v", "left")
    missing = (
        F.raise_error(F.concat(F.lit("no value for vertex "), F.col("v").cast("string"))).cast("bigint")
        if default is None
        else F.lit(default).cast("bigint")
    )
    return found.withColumn("k", F.coalesce("k", missing))


def candidate_groups(
    increments: DataFrame | PackedIncrements,
    values: DataFrame,
    waves: Sequence[int],
    default: int | None = None,
    split: DataFrame | None = None,
) -> DataFrame:
    """Inclusions collapsed by value: ``(run_id, wave, [is_seed,] k, n, reached)``.

    ``n`` sums multiplicities and ``reached`` counts distinct vertices. Increments are collapsed before they are
    repeated for the later waves, and packed ones take their vertices' values before they are unpacked. ``split`` (seeds)
    keeps seeds and other vertices apart.
    """
    late = isinstance(increments, PackedIncrements) and split is None
    rows = increments.unpack() if isinstance(increments, PackedIncrements) and not late else increments
    by = ["k"]
    if split is not None:
        marks = split.select("run_id", "v").distinct().withColumn("is_seed", F.lit(True))
        rows = rows.join(marks, ["run_id", "v"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
        by = ["is_seed", "k"]
    if late:
        valued = replace(increments, rows=attach_values(increments.rows, values, default)).unpack("k")
    else:
        valued = attach_values(rows, values, default)
    collapsed = valued.groupBy("run_id", "wave", *by).agg(
        F.sum("m").alias("n"), F.sum(F.col("fresh").cast("bigint")).alias("reached")
    )
    listed = F.array(*[F.lit(w) for w in sorted(waves)])
    spread = collapsed.withColumn("_to", F.explode(F.filter(listed, lambda w: w >= F.col("wave"))))
    return spread.groupBy("run_id", F.col("_to").alias("wave"), *by).agg(
        F.sum("n").alias("n"), F.sum("reached").alias("reached")
    )


def inverse_weights(candidates: DataFrame, scale: int = WEIGHT_SCALE) -> DataFrame:
    """Running inverse-value weights ``hi`` of single candidates ``(run_id, wave, v, k, m)`` in vertex order.

    This is the uncollapsed list, as long as the sample, so it is summed up in slices.
    """
    weighted = candidates.withColumn("weight", inverse_weight(F.col("k"), scale) * F.col("m"))
    return ordered_running(weighted, RUN_WAVE, ["v"], sums={"hi": "weight"})


def with_group_weights(groups: DataFrame, scale: int = WEIGHT_SCALE) -> DataFrame:
    return groups.withColumn("weight", inverse_weight(F.col("k"), scale) * F.col("n"))


def _zero_share(zeros: Column, drawn: Column, p0: str) -> Column:
    """Share of zero-valued seed draws; the integer form is 1 only when every drawn seed has value 0."""
    if p0 == "integer":
        return F.when((drawn > 0) & (zeros == drawn), F.lit(1.0)).otherwise(F.lit(0.0))
    if p0 == "fraction":
        return F.when(drawn > 0, zeros / drawn).otherwise(F.lit(0.0))
    raise ValueError(f"p0 must be 'integer' or 'fraction', got {p0!r}")


def _statistic(p0: str) -> Column:
    """``sum k (s_k + |1 - p0| c_k) / (|S| + n)`` of a replicate."""
    keep = F.abs(F.lit(1.0) - _zero_share(F.col("seed_zeros"), F.col("n_seeds"), p0))
    return (F.col("seed_sum") + keep * F.col("cand_sum")) / (F.col("n_seeds") + F.col("n"))


def _replicates(plan: DataFrame, reps: int) -> DataFrame:
    return plan.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))


def _seed_draws(seeds: DataFrame, values: DataFrame, plan: DataFrame, default: int | None) -> DataFrame:
    """Per replicate: sum of values and number of zeros over |S| uniform draws from the seeds."""
    known = attach_values(seeds, values, default).select("run_id", "ord", "k")
    draws = explode_count(plan.select(*RUN_WAVE, "rep", "n_seeds"), "n_seeds", "j")
    ord_ = draw_below(F.col("n_seeds"), *[F.col(c) for c in (*RUN_WAVE, "rep")], "seed", F.col("j")) + 1
    picked = draws.withColumn("ord", ord_).join(known, ["run_id", "ord"])
    return picked.groupBy(*RUN_WAVE, "rep").agg(
        F.sum("k").alias("seed_sum"), F.sum((F.col("k") == 0).cast("bigint")).alias("seed_zeros")
    )


def bootstrap_hashed(
    groups: DataFrame,
    seeds: DataFrame,
    values: DataFrame,
    reps: int,
    default: int | None = None,
    p0: str = "integer",
    scale: int = WEIGHT_SCALE,
) -> DataFrame:
    """Replicate statistics ``(run_id, wave, rep, stat)`` by explicit hashed draws.

    A replicate draws |S| seeds uniformly and n candidates by inverse value, both with replacement; its statistic is
    ``sum k (s_k + |1 - p0| c_k) / (|S| + n)``. Cost follows reps x n: the checkable form, for moderate samples.
    """
    weighted = with_group_weights(groups, scale)
    table = cumulative(weighted, RUN_WAVE, ["k"], "weight")
    sizes = weighted.groupBy(*RUN_WAVE).agg(
        F.sum("n").alias("n"), F.sum("weight").alias("total"), F.count(F.lit(1)).alias("bounds")
    )
    counts = seeds.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_seeds"))
    plan = _replicates(sizes.join(counts, "run_id"), reps)

    asked = plan.select(*RUN_WAVE, "rep", "n", "total", "bounds")
    targets = hashed_draws(asked, "n", "total", [*RUN_WAVE, "rep"], "cand", "t").drop("n")
    found = cumulative_lookup(targets, table, RUN_WAVE, "t", "k", total="total", bounds="bounds")
    cand = found.groupBy(*RUN_WAVE, "rep").agg(F.sum("k").alias("cand_sum"))

    drawn = _seed_draws(seeds, values, plan, default)
    parts = plan.join(cand, [*RUN_WAVE, "rep"]).join(drawn, [*RUN_WAVE, "rep"])
    return parts.select(*RUN_WAVE, "rep", _statistic(p0).alias("stat"))


def _stirling_tail(x: np.ndarray) -> np.ndarray:
    """What ln x! has beyond ``ln sqrt(2 pi) + (x + 1/2) ln(x + 1) - (x + 1)``."""
    y = x + 1.0
    return np.where(x < len(TAILS), np.take(TAILS, np.clip(x, 0, len(TAILS) - 1).astype(np.int64)), (1 / 12 - (1 / 360 - 1 / 1260 / (y * y)) / (y * y)) / y)


def _uniform_pairs(prefix: str, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniforms for each number: of the first and of the last 52 bits of md5 over ``prefix`` and the number."""
    text = prefix.encode()
    digests = b"".join(hashlib.md5(text + b"%d" % i).digest() for i in numbers.tolist())
    words = np.frombuffer(digests, dtype=">u8").reshape(-1, 2).astype(np.uint64)
    halves = words[:, 0] >> np.uint64(12), words[:, 1] & np.uint64(2**52 - 1)
    one, two = ((h.astype(np.float64) + 0.5) / 2.0**52 for h in halves)
    return one, two


def _inverted(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """Binomials of a mean below 10 by inversion: terms are taken from ``u`` until it is used up, which takes few steps."""
    upto = np.minimum(n, np.floor(20 + 4 * (n * p)).astype(np.int64))
    x, rest, term, odds = np.zeros(len(n), np.int64), u, np.exp(n * np.log(1 - p)), p / (1 - p)
    for j in range(int(upto.max(initial=0))):
        go = (rest > term) & (j < upto) & (x == j)
        if not go.any():
            break
        rest = np.where(go, rest - term, rest)
        term = np.where(go, term * (n - j) / (j + 1) * odds, term)
        x += go
    return x


def _rejected_or(n: np.ndarray, p: float, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Binomials of ``p`` up to 1/2 and a mean of 10 or more by transformed rejection (Hoermann 1993, BTRS); -1 where rejected."""
    s = np.sqrt(n * p * (1 - p))
    b = 1.15 + 2.53 * s
    a = -0.0873 + 0.0248 * b + 0.01 * p
    u = one - 0.5
    us = 0.5 - np.abs(u)
    k = np.floor((2 * a / us + b) * u + (n * p + 0.5))
    inside = (k >= 0) & (k <= n)
    at, m, odds = np.where(inside, k, 0), np.floor((n + 1) * p), p / (1 - p)
    ratio = (
        (m + 0.5) * np.log((m + 1) / (odds * (n - m + 1))) + (n + 1) * np.log((n - m + 1) / (n - at + 1))
        + (at + 0.5) * np.log(odds * (n - at + 1) / (at + 1))
        + _stirling_tail(m) + _stirling_tail(n - m) - _stirling_tail(at) - _stirling_tail(n - at)
    )
    bound = np.log(two * ((2.83 + 5.1 / b) * s) / (a / (us * us) + b))
    good = inside & (((us >= 0.07) & (two <= 0.92 - 4.2 / b)) | (bound <= ratio))
    return np.where(good, k, -1).astype(np.int64)


def hashed_binomials(n: np.ndarray, p: float, label: str, numbers: np.ndarray) -> np.ndarray:
    """An exact binomial of ``n[i]`` draws at chance ``p`` for each ``numbers[i]``, from hashes of ``label|attempt|number``."""
    less = p if p <= 0.5 else 1 - p
    found = np.full(len(n), -1, np.int64)
    found[n == 0] = 0
    attempt = 0
    while len(left := np.flatnonzero(found < 0)):
        one, two = _uniform_pairs(f"{label}|{attempt}|", numbers[left])
        few = n[left] * less < 10
        drawn = np.empty(len(left), np.int64)
        drawn[few] = _inverted(n[left][few], less, one[few])
        drawn[~few] = _rejected_or(n[left][~few], less, one[~few], two[~few])
        found[left] = drawn
        attempt += 1
    return found if p <= 0.5 else n - found


def split_sums(n: int, ks: np.ndarray, weights: np.ndarray, label: str, reps: np.ndarray) -> np.ndarray:
    """Per replicate: the sum of ``n`` values ``ks`` drawn by ``weights``, with replacement.

    The draws of a range of values are split between its halves by a binomial, down to single values.
    """
    below = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
    sums = np.zeros(len(reps), np.int64)
    ranges = [(0, len(ks), np.full(len(reps), n, np.int64))]
    while ranges:
        lo, hi, drawn = ranges.pop()
        if hi - lo == 1:
            sums += drawn * int(ks[lo])
        elif drawn.any():
            mid = (lo + hi) // 2
            p = float(below[mid] - below[lo]) / float(below[hi] - below[lo])
            first = hashed_binomials(drawn, p, f"{label}|{lo}|{hi}", reps)
            ranges += [(lo, mid, first), (mid, hi, drawn - first)]
    return sums


def _draw_split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            reps = np.arange(row.first_rep, row.last_rep + 1)
            sums = split_sums(row.n, np.asarray(row.ks), np.asarray(row.weights), f"{row.run_id}|{row.wave}|cand", reps)
            yield pd.DataFrame({"run_id": row.run_id, "wave": row.wave, "rep": reps, "cand_sum": sums})


def bootstrap_split(
    groups: DataFrame,
    seeds: DataFrame,
    values: DataFrame,
    reps: int,
    default: int | None = None,
    p0: str = "integer",
    scale: int = WEIGHT_SCALE,
) -> DataFrame:
    """``bootstrap_hashed`` for samples of any size: the same replicates in law, which SQL can repeat as well.

    The n candidates of a replicate are counted by value, in a tree of hashed binomials over the values of a run and wave in
    their order, so the cost follows replicates x values and not the sample size. A row is as long as a run's distinct values.
    """
    weighted = with_group_weights(groups, scale)
    gathered = weighted.groupBy(*RUN_WAVE).agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "weight"))).alias("_entries")
    )
    sized = materialize(gathered, "entries")
    counts = seeds.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_seeds"))
    plan = _replicates(sized.select(*RUN_WAVE, "n").join(counts, "run_id"), reps)
    chunks = F.sequence(F.lit(1), F.lit(reps), F.lit(SPLIT_REPS_PER_ROW))
    rows = sized.withColumn("first_rep", F.explode(chunks)).select(
        F.col("run_id").cast("bigint"), F.col("wave").cast("int"), F.col("n").cast("bigint"), "first_rep",
        F.least(F.col("first_rep") + SPLIT_REPS_PER_ROW - 1, F.lit(reps)).alias("last_rep"),
        F.transform("_entries", lambda e: e["k"]).alias("ks"), F.transform("_entries", lambda e: e["weight"]).alias("weights"),
    )
    dealt = rows.repartition(shuffle_width(groups.sparkSession), *RUN_WAVE, "first_rep")
    cand = dealt.mapInPandas(_draw_split, "run_id bigint, wave int, rep int, cand_sum bigint")
    drawn = _seed_draws(seeds, values, plan, default)
    parts = plan.join(cand, [*RUN_WAVE, "rep"]).join(drawn, [*RUN_WAVE, "rep"])
    return parts.select(*RUN_WAVE, "rep", _statistic(p0).alias("stat"))


def bootstrap_uniform(groups: DataFrame, reps: int, px: int, p0: str = "integer") -> DataFrame:
    """Proxy-percentage scheme on ``(run_id, wave, is_seed, k, n)``: ``px`` percent of the inclusions, drawn uniformly.

    Draws are split into seeds and others by membership; the statistic is the one of ``bootstrap_hashed``.
    """
    if not 0 < px <= 100:
        raise ValueError("px must lie in 1..100")
    coded = groups.withColumn("code", F.col("k") * 2 + F.col("is_seed").cast("int"))
    table = cumulative(coded, RUN_WAVE, ["is_seed", "k"], "n")
    sizes = groups.groupBy(*RUN_WAVE).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("bounds"))
    plan = _replicates(sizes.withColumn("draws", F.floor(F.col("total") * px / 100.0)), reps)
    targets = hashed_draws(plan, "draws", "total", [*RUN_WAVE, "rep"], "proxy", "t").drop("draws")
    found = cumulative_lookup(targets, table, RUN_WAVE, "t", "code", total="total", bounds="bounds")
    k = F.floor(F.col("code") / 2)
    seed = F.col("code") % 2 == 1
    sums = found.groupBy(*RUN_WAVE, "rep").agg(
        F.sum(F.when(seed, k).otherwise(0)).alias("seed_sum"),
        F.sum(F.when(seed, 0).otherwise(k)).alias("cand_sum"),
        F.sum(F.when(seed, 1).otherwise(0)).alias("n_seeds"),
        F.sum(F.when(seed & (k == 0), 1).otherwise(0)).alias("seed_zeros"),
        F.count(F.lit(1)).alias("drawn"),
    )
    keep = F.abs(F.lit(1.0) - _zero_share(F.col("seed_zeros"), F.col("n_seeds"), p0))
    stat = (F.col("seed_sum") + keep * F.col("cand_sum")) / F.col("drawn")
    return sums.select(*RUN_WAVE, "rep", stat.alias("stat"))


def _row_seed(*parts: int) -> np.random.Generator:
    return np.random.default_rng([int(p) & 0xFFFFFFFF for p in parts])


def _key(row) -> tuple[int, ...]:
    return row.run_id, row.run_id >> 32, row.wave, row.first_rep


def _draw_splits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How the draws of each replicate split over the cells, and its seed draws: once for each (run, wave, chunk)."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            reps = int(row.last_rep - row.first_rep + 1)
            weights = np.asarray(row.cell_weights, dtype=np.float64)
            split = _row_seed(*_key(row), 1).multinomial(row.n, weights / weights.sum(), size=reps)
            seed_n, seed_k = np.asarray(row.seed_n, dtype=np.float64), np.asarray(row.seed_k, dtype=np.float64)
            seeds = _row_seed(*_key(row), 2).multinomial(int(seed_n.sum()), seed_n / seed_n.sum(), size=reps)
            others = [None] * (len(weights) - 1)  # the seeds' sums travel with the first cell
            yield pd.DataFrame(
                {
                    "run_id": row.run_id,
                    "wave": row.wave,
                    "first_rep": row.first_rep,
                    "_cell": list(row.cells),
                    "place": np.arange(len(weights)),
                    "n": row.n,
                    "n_seeds": int(seed_n.sum()),
                    "counts": list(split.T),
                    "seed_sum": [seeds @ seed_k, *others],
                    "seed_zeros": [seeds[:, seed_k == 0].sum(axis=1), *others],
                }
            )


def _draw_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Multinomial replicates of one value cell; all randomness is keyed by (run, wave, chunk, cell)."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            weights = np.asarray(row.weights, dtype=np.float64)
            own = _row_seed(*_key(row), 3, row.place).multinomial(np.asarray(row.counts), weights / weights.sum())
            reps = len(row.counts)
            yield pd.DataFrame(
                {
                    "run_id": row.run_id,
                    "wave": row.wave,
                    "rep": np.arange(row.first_rep, row.first_rep + reps),
                    "cand_sum": own @ np.asarray(row.ks, dtype=np.float64),
                    "seed_sum": np.zeros(reps) if row.seed_sum is None else row.seed_sum,
                    "seed_zeros": np.zeros(reps, np.int64) if row.seed_zeros is None else row.seed_zeros,
                    "n_seeds": row.n_seeds,
                    "n": row.n,
                }
            )


def bootstrap_multinomial(
    groups: DataFrame,
    seeds: DataFrame,
    values: DataFrame,
    reps: int,
    default: int | None = None,
    p0: str = "integer",
    scale: int = WEIGHT_SCALE,
    cell_values: int = CELL_VALUES,
) -> DataFrame:
    """Replicate statistics ``(run_id, wave, rep, stat)`` from multinomial counts: the form for large samples.

    The n draws of a replicate are a multinomial over distinct values. Values are hashed into cells of about
    ``cell_values``; the split over cells and the counts inside a cell are drawn separately, which is the same
    multinomial. The split is drawn once for each chunk of replicates and dealt out to the cells, so the work follows
    cells times replicates.
    """
    weighted = with_group_weights(groups, scale)
    sizes = weighted.groupBy(*RUN_WAVE).agg(
        F.sum("n").alias("n"), F.ceil(F.count(F.lit(1)) / F.lit(cell_values)).cast("int").alias("n_cells")
    )
    placed = weighted.drop("n").join(sizes, RUN_WAVE)
    placed = placed.withColumn("_cell", F.pmod(F.xxhash64("k"), F.col("n_cells").cast("bigint")))
    cells = placed.groupBy(*RUN_WAVE, "_cell", "n").agg(
        F.sort_array(F.collect_list(F.struct("k", "weight"))).alias("_entries"), F.sum("weight").alias("_weight")
    )
    cells = materialize(cells, "cells")
    totals = cells.groupBy(*RUN_WAVE, "n").agg(F.sort_array(F.collect_list(F.struct("_cell", "_weight"))).alias("_cells"))
    known = attach_values(seeds, values, default).groupBy("run_id", "k").agg(F.count(F.lit(1)).alias("n"))
    seed_lists = known.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("_seeds"))
    chunks = F.sequence(F.lit(1), F.lit(reps), F.lit(REPS_PER_ROW))
    rows = totals.join(seed_lists, "run_id").withColumn("first_rep", F.explode(chunks)).select(
        F.col("run_id").cast("bigint"),
        F.col("wave").cast("int"),
        F.col("n").cast("bigint"),
        "first_rep",
        F.least(F.col("first_rep") + REPS_PER_ROW - 1, F.lit(reps)).alias("last_rep"),
        F.transform("_cells", lambda c: c["_cell"]).alias("cells"),
        F.transform("_cells", lambda c: c["_weight"]).alias("cell_weights"),
        F.transform("_seeds", lambda s: s["k"]).alias("seed_k"),
        F.transform("_seeds", lambda s: s["n"]).alias("seed_n"),
    )
    width = shuffle_width(groups.sparkSession)
    splits = rows.repartition(width, *RUN_WAVE, "first_rep").mapInPandas(
        _draw_splits,
        "run_id bigint, wave int, first_rep int, _cell bigint, place int, n bigint, n_seeds bigint, "
        "counts array<bigint>, seed_sum array<double>, seed_zeros array<bigint>",
    )
    entries = cells.select(
        F.col("run_id").cast("bigint"), F.col("wave").cast("int"), F.col("_cell").cast("bigint"),
        F.transform("_entries", lambda e: e["k"]).alias("ks"), F.transform("_entries", lambda e: e["weight"]).alias("weights"),
    )
    inside = splits.join(entries, [*RUN_WAVE, "_cell"]).repartition(width, *RUN_WAVE, "_cell", "first_rep")
    schema = (
        "run_id bigint, wave int, rep int, cand_sum double, seed_sum double, seed_zeros bigint, n_seeds bigint, n bigint"
    )
    drawn = inside.mapInPandas(_draw_cells, schema).groupBy(*RUN_WAVE, "rep").agg(
        *[F.sum(c).alias(c) for c in ("cand_sum", "seed_sum", "seed_zeros")],
        *[F.first(c).alias(c) for c in ("n_seeds", "n")],
    )
    return drawn.select(*RUN_WAVE, "rep", _statistic(p0).alias("stat"))


def replicate_summary(boot: DataFrame, keys: Sequence[str] = tuple(RUN_WAVE)) -> DataFrame:
    """Mean, sample variance, 5% and 95% points and range of the replicates of each run and wave.

    A group holds as many values as there are replicates, a parameter of the caller, so sorting it in place is bounded.
    """
    sorted_stats = F.sort_array(F.collect_list("stat"))
    gathered = boot.groupBy(*keys).agg(
        F.avg("stat").alias("mean"),
        F.var_samp("stat").alias("variance"),
        F.min("stat").alias("lmin"),
        F.max("stat").alias("lmax"),
        sorted_stats.alias("_stats"),
    )
    return gathered.select(
        *keys,
        "mean",
        F.col("variance").alias("varianceOfBootStrapDegrees"),
        percentile_of_array(F.col("_stats"), 0.05).alias("l1"),
        percentile_of_array(F.col("_stats"), 0.95).alias("l2"),
        "lmin",
        "lmax",
    )


def coverage(groups: DataFrame) -> DataFrame:
    """Inclusions and distinct vertices per run and wave, as counts."""
    return groups.groupBy(*RUN_WAVE).agg(F.sum("n").alias("included"), F.sum("reached").alias("reached"))


def value_summary(values: DataFrame) -> DataFrame:
    """``(graph_id, medGraphDeg, avgGraphDeg)`` of ``values(graph_id, v, k)``: true median and mean.

    Values are counted first, so only the distinct ones are ever put in order.
    """
    counts = values.groupBy("graph_id", "k").agg(F.count(F.lit(1)).alias("c"))
    median = median_by_counts(counts, ["graph_id"], "k", "c").withColumnRenamed("median", "medGraphDeg")
    mean = counts.groupBy("graph_id").agg((F.sum(F.col("k") * F.col("c")) / F.sum("c")).alias("avgGraphDeg"))
    return median.join(mean, "graph_id")


def graph_summary(degrees: DataFrame, values: DataFrame) -> DataFrame:
    """``(graph_id, n_vertices, edges, medGraphDeg, avgGraphDeg)``: what the samples of a graph are measured against."""
    sizes = degrees.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_vertices"), F.floor(F.sum("k") / 2).cast("bigint").alias("edges")
    )
    return sizes.join(value_summary(values), "graph_id")


def summarise_runs(boot: DataFrame, groups: DataFrame, runs: DataFrame, truth: DataFrame) -> DataFrame:
    """Result rows per ``runs(run_id, graph_id)`` and wave; ``lmsiAll`` and ``lmsiDistinct`` are shares of the vertices."""
    rows = replicate_summary(boot).join(coverage(groups), RUN_WAVE)
    measured = rows.join(runs.select("run_id", "graph_id"), "run_id").join(truth, "graph_id")
    return measured.select(
        *RUN_WAVE,
        (F.col("included") / F.col("n_vertices")).alias("lmsiAll"),
        (F.col("reached") / F.col("n_vertices")).alias("lmsiDistinct"),
        "edges",
        "mean",
        "medGraphDeg",
        "avgGraphDeg",
        "varianceOfBootStrapDegrees",
        "l1",
        "l2",
        "lmin",
        "lmax",
    )
