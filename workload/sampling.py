"""Waves, inclusions, seeds, bootstrap, sweeps and the tables made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplenet.operators import bootstrap, lookup, sampling, traversal
from ripplenet.operators.cleaning import clean_edges, friends_of, induced_edges, mutual_edges, vertices_of
from ripplenet.operators.ordering import assign_ids, rekey_edges
from ripplenet.operators.values import keyword_values, length_values, off_hours_values, topic_values, year_values
from ripplenet.plans import report, sweep
from ripplenet.storage import materialize, settled, shared
from workload import inputs as inp
from workload.structure import EMBEDDED_BOTH, both_embedded


def _setup(spark, d, runs=3, n=20, graph=inp.part_graph):
    """Adjacency, degrees and the seeds ``(run_id, ord, v)`` of a few runs."""
    adj = traversal.build_adjacency(graph(spark, d))
    values = materialize(adj.degrees, "degrees")
    frame = sampling.positions_of(values.withColumn("graph_id", F.lit(0)))
    requests = spark.range(runs).select(F.col("id").alias("run_id"), F.lit(0).alias("graph_id"), F.lit(n).alias("n"))
    seeds = materialize(sampling.choose_seeds(materialize(frame, "frame"), requests), "seeds")
    return adj, values, seeds


def wave_distance(spark, d):
    adj, _, seeds = _setup(spark, d)
    return traversal.wave_distance(adj, seeds, 3).select("run_id", "v", "d")


def _weighted(spark, d):
    """Adjacency with hop costs 1 to 3, the rarer a link the dearer, and the seeds of two runs."""
    links = inp.event_links(spark, d).where("src <> dst")
    counted = links.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).count()
    cost = F.when(F.col("count") > 2, 1).when(F.col("count") > 1, 2).otherwise(3)
    adj = traversal.build_adjacency(counted.select("src", "dst", cost.alias("w")))
    frame = sampling.positions_of(vertices_of(adj.pairs).withColumn("graph_id", F.lit(0)))
    requests = spark.range(2).select(F.col("id").alias("run_id"), F.lit(0).alias("graph_id"), F.lit(2).alias("n"))
    return adj, materialize(sampling.choose_seeds(materialize(frame, "frame"), requests), "seeds")


def wave_distance_weighted(spark, d):
    adj, seeds = _weighted(spark, d)
    return traversal.wave_distance(adj, seeds, 5).select("run_id", "v", "d")


def lmsi_pooled(spark, d):
    adj, _, seeds = _setup(spark, d)
    return traversal.inclusions(traversal.lmsi_increments(adj, seeds, 3), [0, 1, 2, 3])


def lmsi_per_seed(spark, d):
    adj, _, seeds = _setup(spark, d, runs=2, n=5)
    return traversal.inclusions(traversal.lmsi_increments(adj, seeds, 2, "per_seed"), [0, 1, 2])


def _mutual(spark, d):
    return mutual_edges(inp.event_links(spark, d))


def lmsi_mutual(spark, d):
    """Mutual-edge graph whose edges keep attribute 2: two units of wave per hop."""
    adj, _, seeds = _setup(spark, d, runs=2, n=5, graph=_mutual)
    return traversal.inclusions(traversal.lmsi_increments(adj, seeds, 4, hop_cost=2), [0, 2, 4])


def lmsi_weighted(spark, d):
    adj, seeds = _weighted(spark, d)
    return traversal.inclusions(traversal.lmsi_increments(adj, seeds, 5), [0, 1, 3, 5])


def lmsi_per_seed_weighted(spark, d):
    adj, seeds = _weighted(spark, d)
    return traversal.inclusions(traversal.lmsi_increments(adj, seeds, 4, "per_seed"), [0, 2, 4])


def wave_edges(spark, d):
    adj, _, seeds = _setup(spark, d, runs=2, n=3)
    return traversal.wave_edges(adj, seeds, 2)


def _links_and_seeds(spark, d):
    """Directed event links and ten sampled users as seeds."""
    users = inp.table(spark, d, "events").select(F.col("user_id").alias("v")).distinct()
    return inp.event_links(spark, d), sampling.sample_exact(users, "v", 10, "snowball")


def snowball(spark, d):
    links, seeds = _links_and_seeds(spark, d)
    kept, wave_two = traversal.snowball(links, seeds, inp.event_cohort(spark, d))
    return kept.withColumn("part", F.lit("kept")).unionByName(wave_two.withColumn("part", F.lit("wave2")))


def crawl_frontier(spark, d):
    links, seeds = _links_and_seeds(spark, d)
    return traversal.crawl_frontier(links, seeds, inp.event_cohort(spark, d))


def unexpanded(spark, d):
    return traversal.unexpanded_friends(inp.event_links(spark, d), inp.event_cohort(spark, d))


def friends(spark, d):
    links, seeds = _links_and_seeds(spark, d)
    return friends_of(links, seeds)


def sample_exact(spark, d):
    return sampling.sample_exact(inp.table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 200, "7")


def choose_seeds(spark, d):
    """Seeds of two runs on a graph of few vertices: one below and one above half of them."""
    users = vertices_of(inp.event_links(spark, d)).withColumn("graph_id", F.lit(0))
    total = inp.table(spark, d, "events").select("user_id").distinct().count()
    requests = spark.range(2).select(
        F.col("id").alias("run_id"), F.lit(0).alias("graph_id"),
        F.when(F.col("id") == 0, F.lit(total // 5)).otherwise(F.lit(total - total // 5)).alias("n"),
    )
    return sampling.choose_seeds(materialize(sampling.positions_of(users), "frame"), requests)


def _proxies(spark, d):
    _, values, pool = _setup(spark, d, runs=3, n=50)
    sizes = pool.groupBy("run_id").agg(F.count(F.lit(1)).alias("size")).withColumn("n", F.lit(20))
    waves = sizes.withColumn("wave", F.lit(0))
    return sampling.sample_with_replacement(pool, waves, ["wave"], "proxy"), values


def with_replacement(spark, d):
    return _proxies(spark, d)[0].select("run_id", "j", "v")


def proxy_mean(spark, d):
    drawn, values = _proxies(spark, d)
    return sampling.proxy_mean(drawn, values, ["run_id"]).select("run_id", *inp.r6("mu_proxy"))


def proxy_mean_graph(spark, d):
    _, values, pool = _setup(spark, d, runs=3, n=50)
    return sampling.proxy_mean_of_graph(values, pool, 30).select("run_id", *inp.r6("mu_proxy"))


def inverse_weights(spark, d):
    adj, values, seeds = _setup(spark, d)
    found = traversal.inclusions(traversal.lmsi_increments(adj, seeds, 2), [1, 2])
    weighted = bootstrap.inverse_weights(bootstrap.attach_values(found, values))
    return weighted.select("run_id", "wave", "v", "k", "m", "hi")


def cum_lookup(spark, d):
    """Order prices looked up in the running price weights of part sizes; the dearest lie beyond the end."""
    parts = inp.table(spark, d, "part").groupBy(F.lit(0).alias("g"), "p_size").agg(
        F.sum(F.floor("p_retailprice")).alias("w")
    )
    weights = lookup.cumulative(parts, ["g"], ["p_size"], "w")
    orders = inp.table(spark, d, "orders")
    targets = orders.select(F.lit(0).alias("g"), "o_orderkey", F.floor(F.col("o_totalprice") * 5).alias("t"))
    return lookup.ordered_lookup(targets, weights, ["g"], "t", "p_size").select("o_orderkey", "t", "p_size")


def _groups(spark, d, waves=(0, 1, 2), split=False):
    adj, values, seeds = _setup(spark, d)
    found = traversal.lmsi_increments(adj, seeds, max(waves))
    groups = bootstrap.candidate_groups(found, values, waves, split=seeds if split else None)
    return adj, values, seeds, materialize(groups, "groups")


def boot_hashed(spark, d):
    _, values, seeds, groups = _groups(spark, d)
    boot = bootstrap.bootstrap_hashed(groups, seeds, values, 10)
    return boot.select("run_id", "wave", "rep", *inp.r6("stat"))


def boot_multinomial(spark, d):
    _, values, seeds, groups = _groups(spark, d)
    return bootstrap.bootstrap_multinomial(groups, seeds, values, sweep.BOOT_COUNT)


def multinomial_facts(spark, d):
    """What must hold whatever is drawn: replicates, their range, and their mean beside its closed form.

    ``near`` allows six standard errors.
    """
    _, values, seeds, groups = _groups(spark, d)
    boot = bootstrap.bootstrap_multinomial(groups, seeds, values, sweep.BOOT_COUNT)
    k, w = F.col("k"), F.col("weight")
    drawn = bootstrap.with_group_weights(groups).groupBy("run_id", "wave").agg(
        (F.sum(k * w) / F.sum(w)).alias("_drawn"), F.sum("n").alias("_n"), F.min("k").alias("_low"), F.max("k").alias("_high")
    )
    own = seeds.join(values, "v").groupBy("run_id").agg(F.avg("k").alias("_seed"), F.count(F.lit(1)).alias("_ns"))
    expected = (F.col("_ns") * F.col("_seed") + F.col("_n") * F.col("_drawn")) / (F.col("_ns") + F.col("_n"))
    found = boot.groupBy("run_id", "wave").agg(
        F.count(F.lit(1)).alias("reps"), F.avg("stat").alias("_mean"), F.stddev("stat").alias("_sd"),
        F.min("stat").alias("_least"), F.max("stat").alias("_most"),
    )
    both = found.join(drawn.join(own, "run_id").withColumn("expected", expected), ["run_id", "wave"])
    near = F.abs(F.col("_mean") - F.col("expected")) <= 6 * F.col("_sd") / F.sqrt("reps") + 1e-9
    inside = (F.col("_low") <= F.col("_least")) & (F.col("_most") <= F.col("_high"))
    return both.select("run_id", "wave", "reps", inside.alias("inside"), near.alias("near"), *inp.r6("expected"))


def boot_uniform(spark, d):
    *_, groups = _groups(spark, d, split=True)
    return bootstrap.bootstrap_uniform(groups, 10, px=50).select("run_id", "wave", "rep", *inp.r6("stat"))


def summary(spark, d):
    adj, values, seeds, groups = _groups(spark, d)
    boot = bootstrap.bootstrap_hashed(groups, seeds, values, 20)
    graph = values.withColumn("graph_id", F.lit(0))
    runs = seeds.select("run_id", F.lit(0).alias("graph_id")).distinct()
    rows = bootstrap.summarise_runs(boot, groups, runs, bootstrap.graph_summary(graph, graph))
    return rows.select("run_id", "wave", "edges", *inp.r6(*inp.SUMMARY_COLUMNS))


def _sweep_rows(rows, *keys):
    return rows.select("run_id", "iteration", "seed_count", *keys, "wave", "edges", *inp.r6(*inp.SUMMARY_COLUMNS, "muProxy"))


WAVES = list(range(9))


def sweep_waves(spark, d):
    """The published size, its replicates drawn by hashed binomials, which SQL repeats."""
    return _sweep_rows(sweep.sweep(inp.part_graph(spark, d), sweep.real_network_runs(spark), WAVES, draws="split"))


def sweep_mutual(spark, d):
    """The published sweep of mutual-edge networks, which keep two units of wave per hop."""
    runs = sweep.real_network_runs(spark, iterations=20, seed_count=5)
    return _sweep_rows(sweep.sweep(_mutual(spark, d), runs, [0, 2, 4], reps=3, draws="hashed", hop_cost=2))


def _facts(rows, *keys):
    """The exact columns of a sweep with random draws, and whether each row's interval is in order."""
    ordered = (F.col("lmin") <= F.col("l1")) & (F.col("l1") <= F.col("mean")) & (F.col("mean") <= F.col("l2")) & (F.col("l2") <= F.col("lmax"))
    return rows.select(
        "run_id", "iteration", "seed_count", *keys, "wave", F.col("edges").cast("bigint").alias("edges"),
        *inp.r6("lmsiAll", "lmsiDistinct", "avgGraphDeg", "muProxy"), ordered.alias("ordered"),
    )


def sweep_mutual_full(spark, d):
    """Its published size: 50 iterations of 20 seeds, 1000 replicates."""
    return _facts(sweep.sweep(_mutual(spark, d), sweep.real_network_runs(spark), [0, 2, 4], hop_cost=2))


def sweep_waves_full(spark, d):
    """The published size of the sweep: 50 iterations, waves 0 to 8, 1000 replicates."""
    return sweep.sweep(inp.part_graph(spark, d), sweep.real_network_runs(spark), WAVES)


def sweep_full_facts(spark, d):
    """The exact columns of the full-size sweep, and whether each row's interval is in order."""
    ordered = (F.col("lmin") <= F.col("l1")) & (F.col("l1") <= F.col("mean")) & (F.col("mean") <= F.col("l2")) & (F.col("l2") <= F.col("lmax"))
    return sweep_waves_full(spark, d).select(
        "run_id", "iteration", "seed_count", "wave", "edges", *inp.r6("lmsiAll", "lmsiDistinct", "avgGraphDeg"), ordered.alias("ordered")
    )


def _valued(spark, d, topic="purchase", links=None):
    """Valued network: users by their events of a topic, links between valued users."""
    values = materialize(topic_values(inp.purchases(spark, d), topic), "values")
    return clean_edges(inp.event_links(spark, d) if links is None else links, values), values


TOPICS = ("purchase", "click", "view")


def _topics(spark, d, seed_counts, **draws):
    """Three valued networks in one job; each topic owns its ids."""
    edges, values = [], []
    every_link = inp.event_links(spark, d)  # the same for all topics
    for number, topic in enumerate(TOPICS):
        links, of = _valued(spark, d, topic, every_link)
        own = lambda c: (F.col(c) * len(TOPICS) + number).alias(c)  # noqa: E731, B023
        edges.append(links.select(F.lit(number).alias("graph_id"), own("src"), own("dst")))
        values.append(of.select(own("v"), "k"))
    every = materialize(edges[0].unionByName(edges[1]).unionByName(edges[2]), "edges")
    known = materialize(values[0].unionByName(values[1]).unionByName(values[2]), "values")
    linked = known.join(every.select(F.explode(F.array("src", "dst")).alias("v")).distinct(), "v", "left_semi")
    runs = sweep.parameter_grid(spark, graph_id=range(len(TOPICS)), iteration=range(1, 51), seed_count=seed_counts)
    return sweep.sweep(every, runs, [2], values=linked, **draws)


def sweep_topics(spark, d):
    return _sweep_rows(_topics(spark, d, [1, 10, 50], reps=3, draws="hashed"), "graph_id")


SEED_COUNTS = [1, 5, 10, 20, 50, 100]


def sweep_topics_full(spark, d):
    """Its published size: six seed counts, 1000 replicates."""
    return _facts(_topics(spark, d, SEED_COUNTS), "graph_id")


def sweep_seed_counts_full(spark, d):
    """The published size of the sweep over one valued network."""
    edges, values = _valued(spark, d)
    return _facts(sweep.sweep(edges, sweep.valued_network_runs(spark), [2], values=values, seed_pool=values))


def sweep_seed_counts(spark, d):
    edges, values = _valued(spark, d)
    runs = sweep.valued_network_runs(spark)
    return _sweep_rows(sweep.sweep(edges, runs, [2], reps=3, values=values, seed_pool=values, draws="hashed"))


def _cohort_sweep(spark, d, values_of, full=False):
    """The sweep of a cohort's values; ``full`` asks for the published 1000 replicates and the facts of their rows."""
    cohort = materialize(inp.event_cohort(spark, d), "cohort")
    edges = clean_edges(induced_edges(inp.event_links(spark, d), cohort))
    if full:
        return _facts(sweep.cohort_sweep(edges, values_of(cohort), cohort))
    return _sweep_rows(sweep.cohort_sweep(edges, values_of(cohort), cohort, reps=5, draws="hashed"))


def cohort_sweep(spark, d, full=False):
    return _cohort_sweep(spark, d, lambda cohort: off_hours_values(inp.activity(spark, d), cohort), full)


KEYWORDS = ("that", "with", "the", "and", "les", "der")


def cohort_sweep_keywords(spark, d, full=False):
    """Keyword counts; a user owns the document of the same number."""
    texts = inp.document_texts(spark, d)
    return _cohort_sweep(spark, d, lambda cohort: keyword_values(texts.join(cohort, "v", "left_semi"), cohort, KEYWORDS), full)


def cohort_sweep_years(spark, d, full=False):
    """Registration years; a user registers with the first order of the customer of the same number."""
    first = inp.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("v")).agg(F.min("o_orderdate").alias("ts"))
    return _cohort_sweep(spark, d, lambda cohort: year_values(first.join(cohort, "v", "left_semi"), cohort), full)


def cohort_sweep_names(spark, d, full=False):
    """Name lengths; a user has the name of the part of the same number."""
    names = inp.table(spark, d, "part").select(F.col("p_partkey").alias("v"), F.col("p_name").alias("name"))
    return _cohort_sweep(spark, d, lambda cohort: length_values(names.join(cohort, "v", "left_semi")), full)


def cohort_sweep_from_names(spark, d):
    """The off-hours sweep from links between user names: the cohort's subgraph is cut first and then gets dense ids."""
    name = lambda c: F.concat(F.lit("user"), F.col(c).cast("string"))
    cohort = materialize(inp.event_cohort(spark, d).select("v", name("v").alias("name")), "cohort")
    links = inp.event_links(spark, d).select(name("src").alias("src"), name("dst").alias("dst"))
    inside = induced_edges(links, cohort.select(F.col("name").alias("v")))
    ids = materialize(assign_ids(cohort, "name"), "ids")
    edges = clean_edges(rekey_edges(materialize(inside, "inside"), ids, "name"))
    known = cohort.join(ids, "name")
    values = off_hours_values(inp.activity(spark, d), cohort.select("v")).join(known, "v").select(F.col("id").alias("v"), "k")
    return _sweep_rows(sweep.cohort_sweep(edges, values, ids.select(F.col("id").alias("v")), reps=5, draws="hashed"))


def _full(query):
    return lambda spark, d: query(spark, d, full=True)


def _small_sweep(spark, d):
    """Rows that the five report tables share."""
    inputs = [f"{d}/{t}.parquet" for t in ("lineitem", "events")]
    return shared(spark, "small-sweep", inputs, lambda: _new_small_sweep(spark, d))


# The published seed counts and those that are shown against embeddedness.
REPORT_SEEDS = sorted({*SEED_COUNTS, *report.COMPOSITE_SEEDS})


def _new_small_sweep(spark, d):
    """The published size for two datasets: 50 iterations, wave 2, 1000 replicates, every seed count that a report shows.

    One dataset after the other: the tables and shuffles of the first go before the second is read.
    """
    frames = []
    for name, graph in (("part", inp.part_graph), ("event", inp.event_graph)):
        runs = sweep.parameter_grid(spark, iteration=range(1, 51), seed_count=REPORT_SEEDS)
        rows = settled(spark, "sweep", lambda: sweep.sweep(graph(spark, d), runs, [2], draws="split"))  # noqa: B023
        frames.append(rows.withColumn("dataset", F.lit(name)))
    return frames[0].unionByName(frames[1])


def interval_gini(spark, d):
    return report.interval_gini(_small_sweep(spark, d), ["dataset", "seed_count"]).select(
        "dataset", "seed_count", *inp.r6("gini_interval", "gini_range")
    )


def interval_table(spark, d):
    return report.interval_table(_small_sweep(spark, d), ["dataset", "seed_count"]).select(
        "dataset", "seed_count",
        *inp.r6("mean_ratio", "relative_interval", "max_upper_ratio", "mean_variance", "mean_range"),
    )


def coverage_table(spark, d):
    return report.coverage_table(_small_sweep(spark, d), ["dataset", "seed_count"]).select(
        "dataset", "seed_count", *inp.r6("mean_distinct", "mean_all")
    )


def parameter_effect(spark, d):
    return report.parameter_effect(_small_sweep(spark, d), ["seed_count"]).select(
        "seed_count", *inp.r6("mean_ratio", "mean_interval", "mean_variance")
    )


def gini_vs_embeddedness(spark, d):
    table = report.gini_by_embeddedness(_small_sweep(spark, d), both_embedded(spark, d))
    return table.select("dataset", "seed_count", "embeddedness", *inp.r6("gini_interval", "gini_range"))


QUERIES = {
    "i1_wave_distance": wave_distance,
    "i1_wave_distance_weighted": wave_distance_weighted,
    "i2_lmsi_pooled": lmsi_pooled,
    "i2_lmsi_mutual_hop_cost": lmsi_mutual,
    "i2_lmsi_weighted": lmsi_weighted,
    "i4_lmsi_per_seed_weighted": lmsi_per_seed_weighted,
    "i4_lmsi_per_seed": lmsi_per_seed,
    "i5_wave_edges": wave_edges,
    "i7_snowball": snowball,
    "i8_crawl_frontier": crawl_frontier,
    "i8_unexpanded_friends": unexpanded,
    "c12_friends": friends,
    "f3_sample_exact": sample_exact,
    "f3_choose_seeds": choose_seeds,
    "f4_sample_with_replacement": with_replacement,
    "j3_proxy_mean": proxy_mean,
    "j4_proxy_mean_graph": proxy_mean_graph,
    "j5_inverse_weights": inverse_weights,
    "c8_cum_lookup": cum_lookup,
    "j7_bootstrap": boot_hashed,
    "j7_bootstrap_multinomial": boot_multinomial,
    "j7_multinomial_facts": multinomial_facts,
    "j8_bootstrap_uniform": boot_uniform,
    "j9_summary": summary,
    "j10_sweep_waves": sweep_waves,
    "j10_sweep_mutual": sweep_mutual,
    "j10_sweep_waves_full": sweep_waves_full,
    "j10_sweep_full_facts": sweep_full_facts,
    "j11_sweep_seed_counts": sweep_seed_counts,
    "j11_sweep_topics": sweep_topics,
    "j10_sweep_mutual_full_facts": sweep_mutual_full,
    "j11_seed_counts_full_facts": sweep_seed_counts_full,
    "j11_topics_full_facts": sweep_topics_full,
    "j18_cohort_sweep_from_names": cohort_sweep_from_names,
    "j18_full_facts": _full(cohort_sweep),
    "j18_keywords_full_facts": _full(cohort_sweep_keywords),
    "j18_years_full_facts": _full(cohort_sweep_years),
    "j18_names_full_facts": _full(cohort_sweep_names),
    "j18_cohort_sweep": cohort_sweep,
    "j18_cohort_sweep_keywords": cohort_sweep_keywords,
    "j18_cohort_sweep_years": cohort_sweep_years,
    "j18_cohort_sweep_names": cohort_sweep_names,
    "l7_interval_gini": interval_gini,
    "l8_interval_table": interval_table,
    "l9_coverage": coverage_table,
    "l12_gini_vs_embeddedness": gini_vs_embeddedness,
    "l13_parameter_effect": parameter_effect,
}


def _runs(runs: int, n: int) -> str:
    return f"runs AS (SELECT i run_id, {n} n FROM unnest(range({runs})) t(i))"


def _seeds(runs: int, n: int, population: str = "deg") -> str:
    return f"{_runs(runs, n)}, {inp.seeds_sql(population)}, seeds AS (SELECT * FROM all_seeds)"


BASE = f"WITH {inp.PART_GRAPH}, {_seeds(3, 20)}"
THREE_WAVES = f"{BASE}, {inp.distance_sql(2)}, {inp.inclusions_sql([0, 1, 2])}"

WEIGHTED = f"""{inp.EVENT_LINKS}, pairs AS (SELECT least(src, dst) src, greatest(src, dst) dst, count(*) c FROM links WHERE src <> dst GROUP BY ALL),
  wsym AS (SELECT src u, dst v, CASE WHEN c > 2 THEN 1 WHEN c > 1 THEN 2 ELSE 3 END w FROM pairs
    UNION ALL SELECT dst, src, CASE WHEN c > 2 THEN 1 WHEN c > 1 THEN 2 ELSE 3 END FROM pairs),
  ends AS (SELECT DISTINCT u v FROM wsym)"""

MUTUAL = f"""{inp.EVENT_LINKS}, u AS (SELECT DISTINCT src, dst FROM links),
  edges AS (SELECT a.src, a.dst FROM u a JOIN u b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst), {inp.DEGREES}"""

FIRST_USERS = """first_users AS (SELECT v FROM (SELECT DISTINCT user_id v FROM events) ORDER BY md5('snowball|' || v), v LIMIT 10),
  pals AS (SELECT DISTINCT dst v FROM links WHERE src IN (SELECT v FROM first_users))"""


def _proxy(n_pool: int = 50, n: int = 20) -> str:
    h = inp.hash_sql("0", "s.run_id", "'proxy'", "j")
    return f"""{_seeds(3, n_pool)}, sizes AS (SELECT run_id, count(*) size FROM seeds GROUP BY 1),
      proxies AS (SELECT s.run_id, j, v FROM sizes s, unnest(range(1, {n} + 1)) t(j), seeds d
        WHERE d.run_id = s.run_id AND d.ord = 1 + {h} % size)"""


def _sweep(
    iterations, seed_counts, waves, reps, values: str, pool: str, max_seeds: int = 100, cost: str = "1", graph: int = 0, boot=inp.boot_sql
) -> str:
    """CTEs ending in ``result``; ``iteration:graph`` is the label of an iteration's draws."""
    first = graph * len(iterations) * len(seed_counts)
    grid = ", ".join(
        f"({i}, {it}, {sc})" for i, (it, sc) in enumerate(((it, sc) for it in iterations for sc in seed_counts), first)
    )
    draw_ids = ", ".join(f"('{it}:{graph}', {max_seeds})" for it in iterations)
    proxy = inp.hash_sql("wave", "p.run_id", "'proxy'", "j")
    return f"""
grid(run_id, iteration, seed_count) AS (VALUES {grid}),
draw_ids(run_id, n) AS (VALUES {draw_ids}),
{inp.seeds_sql(pool, "draw_ids")},
run_pool AS (SELECT g.run_id, seed_count, ord, v FROM grid g JOIN all_seeds a ON a.run_id = iteration || ':{graph}'),
seeds AS (SELECT run_id, ord, v FROM run_pool WHERE ord <= seed_count),
{inp.distance_sql(max(waves), cost=cost)}, {inp.inclusions_sql(list(waves))},
{boot(reps, values)}, {inp.summary_sql(values)},
pool_size AS (SELECT run_id, seed_count, count(*) size FROM run_pool GROUP BY ALL),
proxies AS (SELECT DISTINCT p.run_id, wave, d.v FROM pool_size p, waves, unnest(range(1, p.seed_count + 1)) t(j), run_pool d
  WHERE d.run_id = p.run_id AND d.ord = 1 + {proxy} % size),
mu AS (SELECT run_id, wave, avg(k) AS "muProxy" FROM proxies JOIN {values} USING (v) GROUP BY ALL),
result AS (SELECT * FROM grid JOIN summary USING (run_id) JOIN mu USING (run_id, wave))"""


SWEEP_OUT = f"""SELECT run_id::bigint AS run_id, iteration::bigint AS iteration, seed_count::bigint AS seed_count, wave, edges,
  {inp.rounded_sql(*inp.SUMMARY_COLUMNS, "muProxy")} FROM result"""

FACTS_OUT = """SELECT run_id::bigint AS run_id, iteration::bigint AS iteration, seed_count::bigint AS seed_count, wave, ne::bigint AS edges,
  round(included / nv, 6) AS "lmsiAll", round(reached / nv, 6) AS "lmsiDistinct", round(av, 6) AS "avgGraphDeg",
  round("muProxy", 6) AS "muProxy", true AS ordered FROM grid JOIN cov USING (run_id) JOIN mu USING (run_id, wave), truth"""


def _valued_sql(topic: str) -> str:
    return f"""{inp.EVENT_LINKS}, vals AS (SELECT user_id v, count(*) + 1 k FROM events WHERE event_type = '{topic}' GROUP BY 1),
  edges AS (SELECT DISTINCT least(src, dst) src, greatest(src, dst) dst FROM links WHERE src <> dst
    AND src IN (SELECT v FROM vals) AND dst IN (SELECT v FROM vals)), {inp.DEGREES}"""


VALUED = _valued_sql("purchase")


def _cohort_sql(vals: str, reps: int = 5, out: str = SWEEP_OUT) -> str:
    return f"""WITH {inp.EVENT_LINKS}, {inp.EVENT_COHORT},
  edges AS (SELECT DISTINCT least(src, dst) src, greatest(src, dst) dst FROM links WHERE src <> dst
    AND src IN (SELECT v FROM cohort) AND dst IN (SELECT v FROM cohort)), {inp.DEGREES},
  vals AS ({vals}), {_sweep(range(1, 51), [5], [0, 1, 2], reps, 'vals', 'cohort', 5)} {out}"""


_LISTED = ", ".join(f"'{w}'" for w in KEYWORDS)

COHORT_VALUES = {
    "": "SELECT v, 1 + count(user_id) k FROM cohort LEFT JOIN events ON user_id = v AND (hour(ts) < 6 OR hour(ts) > 21) GROUP BY v",
    "keywords_": f"""SELECT v, (1 + coalesce(sum(h), 0))::bigint k FROM cohort LEFT JOIN (SELECT doc_id,
      len(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g')), ' '), lambda x: x IN ({_LISTED}))) h
      FROM documents) ON doc_id = v GROUP BY v""",
    "years_": """SELECT v, coalesce(min(year(o_orderdate)) - 1900, 108)::bigint k
      FROM cohort LEFT JOIN orders ON o_custkey = v GROUP BY v""",
    "names_": "SELECT v, coalesce(length(p_name), 1)::bigint k FROM cohort LEFT JOIN part ON p_partkey = v",
}

_SMALL = _sweep(range(1, 51), REPORT_SEEDS, [2], sweep.BOOT_COUNT, "deg", "deg", boot=inp.split_boot_sql)
SMALL_SWEEP = f"""sweep_rows AS (
  SELECT 'part' dataset, * FROM (WITH {inp.PART_GRAPH}, {_SMALL} SELECT * FROM result)
  UNION ALL SELECT 'event', * FROM (WITH {inp.EVENT_GRAPH}, {_SMALL} SELECT * FROM result))"""

INTERVAL_GINI = """ranked AS (SELECT dataset, seed_count, l2 - l1 a, lmax - lmin b,
    row_number() OVER (PARTITION BY dataset, seed_count ORDER BY l2 - l1) i,
    row_number() OVER (PARTITION BY dataset, seed_count ORDER BY lmax - lmin) j FROM sweep_rows),
  ginis AS (SELECT dataset, seed_count::bigint seed_count,
    round(2 * sum(i * a) / (count(*) * sum(a)) - (count(*) + 1) / count(*), 6) AS gini_interval,
    round(2 * sum(j * b) / (count(*) * sum(b)) - (count(*) + 1) / count(*), 6) AS gini_range
    FROM ranked GROUP BY ALL)"""

ORACLES = {
    "i1_wave_distance": f"{BASE}, {inp.distance_sql(3)} SELECT run_id, v, d FROM dist",
    "i1_wave_distance_weighted": f"""WITH {WEIGHTED}, {_seeds(2, 2, "ends")}, {inp.distance_sql(5, cost="s.w", sym="wsym")}
      SELECT run_id, v, d FROM dist""",
    "i2_lmsi_pooled": f"{BASE}, {inp.distance_sql(3)}, {inp.inclusions_sql([0, 1, 2, 3])} SELECT run_id, wave, v, m FROM incl",
    "i2_lmsi_weighted": f"""WITH {WEIGHTED}, {_seeds(2, 2, "ends")}, {inp.distance_sql(5, cost="s.w", sym="wsym")},
      {inp.inclusions_sql([0, 1, 3, 5], sym="wsym")} SELECT run_id, wave, v, m FROM incl""",
    "i4_lmsi_per_seed_weighted": f"""WITH {WEIGHTED}, {_runs(2, 2)}, {inp.seeds_sql("ends")},
      seeds AS (SELECT run_id, v seed, v FROM all_seeds),
      {inp.distance_sql(4, keys="run_id, seed", cost="s.w", sym="wsym")}, {inp.inclusions_sql([0, 2, 4], keys="run_id, seed", sym="wsym")}
      SELECT run_id, wave, v, sum(m)::bigint AS m FROM incl GROUP BY ALL""",
    "i2_lmsi_mutual_hop_cost": f"""WITH {MUTUAL}, {_seeds(2, 5)}, {inp.distance_sql(4, cost="2")},
      {inp.inclusions_sql([0, 2, 4])} SELECT run_id, wave, v, m FROM incl""",
    "i4_lmsi_per_seed": f"""WITH {inp.PART_GRAPH}, {_runs(2, 5)}, {inp.seeds_sql("deg")},
      seeds AS (SELECT run_id, v seed, v FROM all_seeds),
      {inp.distance_sql(2, keys="run_id, seed")}, {inp.inclusions_sql([0, 1, 2], keys="run_id, seed")}
      SELECT run_id, wave, v, sum(m)::bigint AS m FROM incl GROUP BY ALL""",
    "i5_wave_edges": f"""WITH {inp.PART_GRAPH}, {_seeds(2, 3)}, {inp.distance_sql(1)}
      SELECT DISTINCT run_id, src, dst FROM dist JOIN edges ON v = src OR v = dst""",
    "i7_snowball": f"""WITH {inp.EVENT_LINKS}, {inp.EVENT_COHORT}, {FIRST_USERS},
      w1 AS (SELECT v FROM pals EXCEPT SELECT v FROM first_users),
      kept AS (SELECT v FROM w1 WHERE v IN (SELECT v FROM cohort)),
      w2 AS (SELECT DISTINCT dst v FROM links WHERE src IN (SELECT v FROM kept) EXCEPT SELECT v FROM w1 EXCEPT SELECT v FROM first_users)
      SELECT v, 'kept' AS part FROM kept UNION ALL SELECT v, 'wave2' FROM w2""",
    "i8_crawl_frontier": f"""WITH {inp.EVENT_LINKS}, {inp.EVENT_COHORT}, {FIRST_USERS}
      SELECT DISTINCT dst AS v FROM links WHERE src IN (SELECT v FROM pals) EXCEPT SELECT v FROM cohort""",
    "i8_unexpanded_friends": f"""WITH {inp.EVENT_LINKS}, {inp.EVENT_COHORT},
      mine AS (SELECT * FROM links WHERE src IN (SELECT v FROM cohort)) SELECT dst AS v FROM mine EXCEPT SELECT src FROM mine""",
    "c12_friends": f"WITH {inp.EVENT_LINKS}, {FIRST_USERS} SELECT v FROM pals",
    "f3_sample_exact": """SELECT c_custkey, c_name FROM customer ORDER BY md5('7|' || c_custkey), c_custkey LIMIT 200""",
    "f3_choose_seeds": f"""WITH {inp.EVENT_LINKS}, ends AS (SELECT src v FROM links UNION SELECT dst FROM links),
      t AS (SELECT count(DISTINCT user_id) total FROM events),
      runs AS (SELECT 0 run_id, total // 5 n FROM t UNION ALL SELECT 1, total - total // 5 FROM t),
      {inp.seeds_sql("ends")} SELECT run_id::bigint AS run_id, ord, v FROM all_seeds""",
    "f4_sample_with_replacement": f"WITH {inp.PART_GRAPH}, {_proxy()} SELECT run_id, j, v FROM proxies",
    "j3_proxy_mean": f"""WITH {inp.PART_GRAPH}, {_proxy()}, members AS (SELECT DISTINCT run_id, v FROM proxies)
      SELECT run_id, round(avg(k), 6) AS mu_proxy FROM members JOIN deg USING (v) GROUP BY run_id""",
    "j4_proxy_mean_graph": f"""WITH {inp.PART_GRAPH}, {_seeds(3, 50)},
      preq AS (SELECT run_id, 30 n, count(*) total FROM seeds GROUP BY run_id),
      {inp.positions_sql("preq", "run_id", "proxy", "picked")}
      SELECT run_id, round(avg(k), 6) AS mu_proxy FROM picked p JOIN seeds s USING (run_id) JOIN deg USING (v)
      WHERE s.ord = p.pos + 1 GROUP BY run_id""",
    "j5_inverse_weights": f"""{BASE}, {inp.distance_sql(2)}, {inp.inclusions_sql([1, 2])}
      SELECT run_id, wave, v, k, m, (sum(greatest(1000 // k, 1) * m) OVER (PARTITION BY run_id, wave ORDER BY v))::bigint AS hi
      FROM incl JOIN deg USING (v)""",
    "c8_cum_lookup": """WITH w AS (SELECT p_size, sum(floor(p_retailprice))::bigint w FROM part GROUP BY 1),
      c AS (SELECT p_size, (sum(w) OVER (ORDER BY p_size))::bigint hi FROM w),
      t AS (SELECT o_orderkey, floor(o_totalprice * 5)::bigint t FROM orders)
      SELECT o_orderkey, t, coalesce((SELECT min_by(p_size, hi) FROM c WHERE hi >= t), -1)::int AS p_size FROM t""",
    "j7_bootstrap": f"{THREE_WAVES}, {inp.boot_sql(10)} SELECT run_id, wave, rep::int AS rep, round(stat, 6) AS stat FROM boot",
    "j7_multinomial_facts": f"""{THREE_WAVES}, {inp.boot_sql(1)},
      mix AS (SELECT run_id, wave, sum(k * w) / sum(w)::double cand, sum(n) n FROM wts GROUP BY ALL),
      own AS (SELECT run_id, avg(k) seed_mean, count(*) n_seeds FROM seeds JOIN deg USING (v) GROUP BY ALL)
      SELECT run_id, wave, 1000::bigint AS reps, true AS inside, true AS near,
        round((n_seeds * seed_mean + n * cand) / (n_seeds + n), 6) AS expected FROM mix JOIN own USING (run_id)""",
    "j10_sweep_full_facts": f"""WITH {inp.PART_GRAPH}, {_sweep(range(1, 51), [20], WAVES, 1, 'deg', 'deg')}
      SELECT run_id::bigint AS run_id, iteration::bigint AS iteration, seed_count::bigint AS seed_count, wave, ne::bigint AS edges,
        round(included / nv, 6) AS "lmsiAll", round(reached / nv, 6) AS "lmsiDistinct", round(av, 6) AS "avgGraphDeg", true AS ordered
      FROM grid JOIN cov USING (run_id), truth""",
    "j11_sweep_topics": " UNION ALL ".join(
        f"""(WITH {_valued_sql(topic)}, linked AS (SELECT v, vals.k FROM vals JOIN deg USING (v)),
        {_sweep(range(1, 51), [1, 10, 50], [2], 3, 'linked', 'deg', graph=number)}
        SELECT {number}::bigint AS graph_id, out.* FROM ({SWEEP_OUT}) out)"""
        for number, topic in enumerate(TOPICS)
    ),
    "j8_bootstrap_uniform": f"""{THREE_WAVES},
      g AS (SELECT run_id, wave, (s.v IS NOT NULL) is_seed, k, sum(m)::bigint n FROM incl JOIN deg USING (v)
        LEFT JOIN seeds s USING (run_id, v) GROUP BY ALL),
      c AS (SELECT *, (sum(n) OVER (PARTITION BY run_id, wave ORDER BY is_seed, k))::bigint hi FROM g),
      t AS (SELECT run_id, wave, sum(n)::bigint total, floor(sum(n) * 50 / 100.0)::bigint draws FROM g GROUP BY ALL),
      dr AS (SELECT run_id, wave, rep, 1 + {inp.hash_sql("run_id", "wave", "rep", "'proxy'", "j")} % total t
        FROM t p, unnest(range(1, 11)) r(rep), unnest(range(1, p.draws + 1)) u(j))
      SELECT run_id, wave, rep::int AS rep, round(sum(k)::double / count(*), 6) AS stat
      FROM dr JOIN c USING (run_id, wave) WHERE t > hi - n AND t <= hi GROUP BY ALL""",
    "j9_summary": f"""{THREE_WAVES}, {inp.boot_sql(20)}, {inp.summary_sql()}
      SELECT run_id, wave, edges, {inp.rounded_sql(*inp.SUMMARY_COLUMNS)} FROM summary""",
    "j10_sweep_mutual": f"WITH {MUTUAL}, {_sweep(range(1, 21), [5], [0, 2, 4], 3, 'deg', 'deg', cost='2')} {SWEEP_OUT}",
    "j10_sweep_waves": f"WITH {inp.PART_GRAPH}, {_sweep(range(1, 51), [20], WAVES, sweep.BOOT_COUNT, 'deg', 'deg', boot=inp.split_boot_sql)} {SWEEP_OUT}",
    "j11_sweep_seed_counts": f"WITH {VALUED}, {_sweep(range(1, 51), [1, 5, 10, 20, 50, 100], [2], 3, 'vals', 'vals')} {SWEEP_OUT}",
    **{
        f"j18_{name}full_facts": _cohort_sql(vals, 1, FACTS_OUT) for name, vals in COHORT_VALUES.items()
    },
    **{
        f"j18_cohort_sweep{name and '_' + name[:-1]}": _cohort_sql(vals) for name, vals in COHORT_VALUES.items()
    },
    "j18_cohort_sweep_from_names": f"""WITH {inp.EVENT_LINKS}, {inp.EVENT_COHORT},
      ids AS (SELECT v, row_number() OVER (ORDER BY 'user' || v) - 1 id FROM cohort),
      edges AS (SELECT DISTINCT least(a.id, b.id) src, greatest(a.id, b.id) dst FROM links JOIN ids a ON a.v = src JOIN ids b ON b.v = dst
        WHERE src <> dst), {inp.DEGREES}, members AS (SELECT id v FROM ids),
      vals AS (SELECT id v, 1 + count(user_id) k FROM ids LEFT JOIN events ON user_id = ids.v AND (hour(ts) < 6 OR hour(ts) > 21) GROUP BY id),
      {_sweep(range(1, 51), [5], [0, 1, 2], 5, 'vals', 'members', 5)} {SWEEP_OUT}""",
    "j10_sweep_mutual_full_facts": f"WITH {MUTUAL}, {_sweep(range(1, 51), [20], [0, 2, 4], 1, 'deg', 'deg', cost='2')} {FACTS_OUT}",
    "j11_seed_counts_full_facts": f"WITH {VALUED}, {_sweep(range(1, 51), SEED_COUNTS, [2], 1, 'vals', 'vals')} {FACTS_OUT}",
    "j11_topics_full_facts": " UNION ALL ".join(
        f"""(WITH {_valued_sql(topic)}, linked AS (SELECT v, vals.k FROM vals JOIN deg USING (v)),
        {_sweep(range(1, 51), SEED_COUNTS, [2], 1, 'linked', 'deg', graph=number)}
        SELECT {number}::bigint AS graph_id, out.* FROM ({FACTS_OUT}) out)"""
        for number, topic in enumerate(TOPICS)
    ),
    "l7_interval_gini": f"WITH {SMALL_SWEEP}, {INTERVAL_GINI} SELECT * FROM ginis",
    "l8_interval_table": f"""WITH {SMALL_SWEEP} SELECT dataset, seed_count::bigint AS seed_count,
      round(avg(mean / "avgGraphDeg"), 6) AS mean_ratio, round(avg((l2 - l1) / mean), 6) AS relative_interval,
      round(max(l2 / mean), 6) AS max_upper_ratio, round(avg("varianceOfBootStrapDegrees"), 6) AS mean_variance,
      round(avg(lmax - lmin), 6) AS mean_range FROM sweep_rows GROUP BY ALL""",
    "l9_coverage": f"""WITH {SMALL_SWEEP} SELECT dataset, seed_count::bigint AS seed_count,
      round(avg("lmsiDistinct"), 6) AS mean_distinct, round(avg("lmsiAll"), 6) AS mean_all FROM sweep_rows GROUP BY ALL""",
    "l12_gini_vs_embeddedness": f"""WITH {SMALL_SWEEP}, {INTERVAL_GINI}, {EMBEDDED_BOTH},
      means AS (SELECT dataset, round(avg(e), 2) AS embeddedness FROM embedded GROUP BY dataset)
      SELECT dataset, seed_count, embeddedness, gini_interval, gini_range FROM ginis JOIN means USING (dataset)
      WHERE seed_count IN (20, 40, 80, 100)""",
    "l13_parameter_effect": f"""WITH {SMALL_SWEEP} SELECT seed_count::bigint AS seed_count,
      round(avg(mean / "avgGraphDeg"), 6) AS mean_ratio, round(avg(l2 - l1), 6) AS mean_interval,
      round(avg("varianceOfBootStrapDegrees"), 6) AS mean_variance FROM sweep_rows GROUP BY ALL""",
}
