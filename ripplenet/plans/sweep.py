"""Estimation sweeps: every run of a parameter grid in one traversal and one bootstrap."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplenet.operators.bootstrap import (
    bootstrap_hashed,
    bootstrap_multinomial,
    bootstrap_split,
    candidate_groups,
    graph_summary,
    summarise_runs,
)
from ripplenet.operators.sampling import choose_seeds, positions_of, proxy_mean, sample_with_replacement
from ripplenet.operators.traversal import build_adjacency, lmsi_increments
from ripplenet.storage import materialize, small_table

BOOT_COUNT = 1000
MAX_SEEDS = 100


def parameter_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """All combinations of the given axes, numbered by ``run_id``. The grid is the caller's, a few hundred rows."""
    names = list(axes)
    rows = [(i, *combo) for i, combo in enumerate(product(*axes.values()))]
    return small_table(spark, ["run_id", *names], rows)


def sweep(
    edges: DataFrame,
    runs: DataFrame,
    waves: Sequence[int],
    reps: int = BOOT_COUNT,
    values: DataFrame | None = None,
    seed_pool: DataFrame | None = None,
    max_seeds: int = MAX_SEEDS,
    method: str = "pooled",
    draws: str = "multinomial",
    default: int | None = None,
    hop_cost: int = 1,
) -> DataFrame:
    """Estimate the mean vertex value for every run and wave.

    ``edges`` is a clean undirected table, optionally with ``graph_id`` and ids that no two graphs share. ``runs`` has
    ``run_id``, ``iteration``, ``seed_count`` and, with several graphs, ``graph_id``; other columns are carried along. Seeds of an
    iteration are drawn once from ``seed_pool(v)`` (default: the vertices) and each seed count takes a prefix, as does
    every wave. ``values(v, k)`` default to degrees. Edges may carry their cost ``w``; others cost ``hop_cost``.
    """
    grouped = "graph_id" in edges.columns
    unit = hop_cost == 1 and "w" not in edges.columns
    adj = build_adjacency(
        edges.select("src", "dst", *[c for c in edges.columns if c == "w"]), rounds=max(waves) if unit else None
    )
    owner = (
        materialize(edges.select("graph_id", F.explode(F.array("src", "dst")).alias("v")).distinct(), "owner")
        if grouped
        else None
    )

    def with_graph(df: DataFrame) -> DataFrame:
        return df.join(owner, "v") if grouped else df.withColumn("graph_id", F.lit(0).cast("bigint"))

    counted = materialize(with_graph(adj.degrees), "degrees")
    valued = counted if values is None else materialize(with_graph(values), "values")
    pool = counted if seed_pool is None else with_graph(seed_pool.select("v").distinct())
    runs = runs if grouped else runs.withColumn("graph_id", F.lit(0).cast("bigint"))

    # One draw per iteration and graph; its label holds both, so no two of them meet.
    labelled = runs.withColumn("draw_id", F.concat_ws(":", "iteration", "graph_id"))
    drawn = labelled.select(F.col("draw_id").alias("run_id"), "graph_id", F.lit(max_seeds).alias("n")).distinct()
    frame = materialize(positions_of(pool), "frame")
    all_seeds = choose_seeds(frame, drawn).withColumnRenamed("run_id", "draw_id")
    run_pool = materialize(labelled.join(all_seeds, "draw_id").select("run_id", "seed_count", "ord", "v"), "seeds")
    seeds = run_pool.where(F.col("ord") <= F.col("seed_count")).select("run_id", "ord", "v")

    increments = lmsi_increments(adj, seeds.select("run_id", "v"), max(waves), method, hop_cost=hop_cost, packed=True)
    vertex_values = valued.select("v", "k")
    groups = materialize(candidate_groups(increments, vertex_values, waves, default), "groups")
    if draws == "multinomial":
        boot = bootstrap_multinomial(groups, seeds, vertex_values, reps, default)
    elif draws == "hashed":
        boot = bootstrap_hashed(groups, seeds, vertex_values, reps, default)
    elif draws == "split":
        boot = bootstrap_split(groups, seeds, vertex_values, reps, default)
    else:
        raise ValueError(f"draws must be 'multinomial', 'hashed' or 'split', got {draws!r}")

    sizes = run_pool.groupBy("run_id", "seed_count").agg(F.count(F.lit(1)).alias("size"))
    requests = sizes.select(
        "run_id", F.col("seed_count").alias("n"), "size", F.explode(F.array(*[F.lit(w) for w in waves])).alias("wave")
    )
    proxies = sample_with_replacement(run_pool.select("run_id", "ord", "v"), requests, ["wave"], "proxy")
    mu = proxy_mean(proxies, vertex_values, ["run_id", "wave"]).withColumnRenamed("mu_proxy", "muProxy")
    rows = summarise_runs(boot, groups, runs, graph_summary(counted, valued)).join(mu, ["run_id", "wave"])
    return runs.join(rows, "run_id")


def real_network_runs(spark: SparkSession, iterations: int = 50, seed_count: int = 20) -> DataFrame:
    """Waves vary, seeds do not."""
    return parameter_grid(spark, iteration=range(1, iterations + 1), seed_count=[seed_count])


def valued_network_runs(
    spark: SparkSession, iterations: int = 50, seed_counts: Sequence[int] = (1, 5, 10, 20, 50, 100)
) -> DataFrame:
    """Seed counts vary; their seeds are nested."""
    return parameter_grid(spark, iteration=range(1, iterations + 1), seed_count=list(seed_counts))


def cohort_sweep(
    edges: DataFrame, values: DataFrame, seeds: DataFrame, iterations: int = 50, seed_count: int = 5,
    waves: Sequence[int] = (0, 1, 2), **kw,
) -> DataFrame:
    """Sweep of a user-valued feature over the induced graph of a labelled cohort, seeds drawn from its known seeds."""
    runs = parameter_grid(edges.sparkSession, iteration=range(1, iterations + 1), seed_count=[seed_count])
    kw.setdefault("default", 1)
    return sweep(edges, runs, waves, values=values, seed_pool=seeds, max_seeds=seed_count, **kw)
