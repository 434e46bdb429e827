"""Cleaning, degrees, distributions and embeddedness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplenet.operators import cleaning, ordering, statistics, structure
from ripplenet.operators.bootstrap import value_summary
from ripplenet.operators.values import topic_values
from ripplenet.plans import report
from ripplenet.storage import materialize, settled
from workload import inputs as inp


def _purchase_values(spark, d):
    return topic_values(inp.purchases(spark, d), "purchase")


def _string_links(spark, d):
    links = inp.event_links(spark, d)
    return links.select(*[F.concat(F.lit("user"), F.col(c).cast("string")).alias(c) for c in ("src", "dst")])


def _string_members(spark, d):
    return _string_links(spark, d).select(F.explode(F.array("src", "dst")).alias("name")).distinct()


def _rekeyed(spark, d):
    links = materialize(_string_links(spark, d), "links")
    ids = ordering.assign_ids(links.select(F.explode(F.array("src", "dst")).alias("name")), "name")
    return ordering.rekey_edges(links, materialize(ids, "ids"), "name").distinct()


def _both_distributions(spark, d):
    frames = []
    for name, graph in (("part", inp.part_graph), ("event", inp.event_graph)):
        dist = structure.degree_distribution(structure.degrees(graph(spark, d)))
        frames.append(dist.withColumn("dataset", F.lit(name)))
    return frames[0].unionByName(frames[1])


def both_embedded(spark, d):
    """Embeddedness in both graphs, one after the other: the edges, blocks and shuffles of the first go before the second."""
    frames = []
    for name, graph in (("part", inp.part_graph), ("event", inp.event_graph)):
        found = settled(spark, "embedded", lambda: structure.embeddedness(graph(spark, d)))  # noqa: B023
        frames.append(found.withColumn("dataset", F.lit(name)))
    return frames[0].unionByName(frames[1])


def _subgraph(spark, d):
    edges = inp.part_graph(spark, d)
    vertices = inp.table(spark, d, "part").select(F.col("p_partkey").alias("v"), "p_size")
    return cleaning.vertex_subgraph(edges, vertices, F.col("p_size") > 25)[1]


def _updated(spark, d):
    parts = inp.table(spark, d, "part")
    vertices = cleaning.with_constant(cleaning.vertices_of(inp.part_graph(spark, d)), "a", 1500)
    small = parts.where(F.col("p_size") < 10).select(F.col("p_partkey").alias("v"), F.col("p_size").alias("a"))
    return cleaning.update_min(vertices, small)


def _triplets(spark, d):
    counts = structure.degrees(inp.event_links(spark, d)).withColumnRenamed("k", "a")
    return cleaning.triplets(inp.event_graph(spark, d), counts)


def _multiset_rest(spark, d):
    events = inp.table(spark, d, "events")
    every = events.groupBy(F.col("user_id").alias("v")).agg(F.count(F.lit(1)).alias("m"))
    seen = events.where(F.col("event_type").isin("view", "click")).groupBy(F.col("user_id").alias("v"))
    return cleaning.multiset_difference(every, seen.agg(F.count(F.lit(1)).alias("m")))


def _distinct_users(spark, d):
    events = inp.table(spark, d, "events")
    users = events.select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("screen_name"),
        F.date_format("ts", "yyyy-MM-dd").alias("created"), "value",
    )
    return cleaning.distinct_users(users).select("screen_name", "created")


def _edges_per_vertex(spark, d):
    frames = []
    for name, graph in (("part", inp.part_graph), ("event", inp.event_graph)):
        frames.append(structure.cardinality(graph(spark, d)).withColumn("dataset", F.lit(name)))
    table = report.edges_per_vertex(frames[0].unionByName(frames[1]), ["dataset"])
    return table.select("dataset", *inp.r6("edges_per_vertex"))


QUERIES = {
    "c1_update_min": _updated,
    "c2_triplets": _triplets,
    "g6_multiset_difference": _multiset_rest,
    "g7_distinct_users": _distinct_users,
    "l13_edges_per_vertex": _edges_per_vertex,
    "b1_drop_self_loops": lambda s, d: cleaning.drop_self_loops(inp.event_links(s, d)).select("src", "dst"),
    "b4_clean_edges": inp.part_graph,
    "b5_clean_edges_valued": lambda s, d: cleaning.clean_edges(inp.event_links(s, d), _purchase_values(s, d)),
    "b6_mutual_edges": lambda s, d: cleaning.mutual_edges(inp.event_links(s, d), attr=2),
    "b7_edge_multiplicity": lambda s, d: cleaning.merge_multi_edges(inp.event_links(s, d)),
    "b8_induced_edges": lambda s, d: cleaning.induced_edges(inp.event_links(s, d), inp.event_cohort(s, d)),
    "b9_assign_ids": lambda s, d: ordering.assign_ids(_string_members(s, d), "name"),
    "b9_rekeyed_edges": _rekeyed,
    "b10_vertex_subgraph": _subgraph,
    "b11_edge_subgraph": lambda s, d: cleaning.edge_subgraph(
        cleaning.merge_multi_edges(inp.event_links(s, d)), F.col("w") > 1
    ),
    "d1_degrees": lambda s, d: structure.degrees(inp.part_graph(s, d)),
    "d2_neighbours": lambda s, d: structure.neighbours(inp.part_graph(s, d)),
    "d2_degrees_of_all": lambda s, d: structure.degrees_of_all(
        inp.part_graph(s, d), inp.table(s, d, "part").select(F.col("p_partkey").alias("v"))
    ),
    "d3_degree_distribution": lambda s, d: structure.degree_distribution(
        structure.degrees(inp.part_graph(s, d))
    ).select("k", "n", *inp.r6("fraction")),
    "d4_cardinality": lambda s, d: structure.cardinality(inp.part_graph(s, d)),
    "d6_value_summary": lambda s, d: value_summary(
        structure.degrees(inp.part_graph(s, d)).withColumn("graph_id", F.lit(0))
    ).select(*inp.r6("medGraphDeg", "avgGraphDeg")),
    "e2_degree_cdf": lambda s, d: report.degree_cdf(_both_distributions(s, d)).select("dataset", "k", "cdf"),
    "i9_embeddedness": lambda s, d: structure.embeddedness(inp.part_graph(s, d)).select("v", *inp.r6("e")),
    "d16_embeddedness_cdf": lambda s, d: report.embeddedness_cdf(both_embedded(s, d)).select(
        "dataset", "bucket", "n", "share", "cdf"
    ),
    "l11_embeddedness_centre": lambda s, d: report.embeddedness_centre(both_embedded(s, d)).select(
        "dataset", *inp.r6("mean", "median")
    ),
    "d8_percentile_n1": lambda s, d: statistics.percentile_n1(
        inp.table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p05": 0.05, "p95": 0.95}
    ).select("l_returnflag", *inp.r6("p05", "p95")),
    "d13_gini": lambda s, d: statistics.gini(
        inp.table(s, d, "lineitem"), ["l_returnflag"],
        {"gini_price": F.col("l_extendedprice"), "gini_quantity": F.col("l_quantity")},
    ).select("l_returnflag", *inp.r6("gini_price", "gini_quantity")),
    "d15_interval_variance": lambda s, d: report.interval_variance(
        inp.table(s, d, "lineitem").select(
            "l_returnflag", F.col("l_discount").alias("l1"), F.col("l_tax").alias("l2")
        ),
        ["l_returnflag"],
    ).select("l_returnflag", *inp.r6("interval_variance")),
}


def _dist(name: str, graph: str) -> str:
    return f"""SELECT '{name}' dataset, k, n, n / sum(n) OVER () fraction FROM
      (WITH {graph} SELECT k, count(*) n FROM deg GROUP BY k)"""


EMBEDDED = """
common AS (SELECT e.src, e.dst, count(*) c FROM edges e JOIN sym a ON a.u = e.src JOIN sym b ON b.u = e.dst AND b.v = a.v GROUP BY ALL),
terms AS (SELECT src, dst, CASE WHEN x.k + y.k - coalesce(c, 0) - 2 = 0 THEN 0.0
    ELSE coalesce(c, 0)::double / (x.k + y.k - coalesce(c, 0) - 2) END t
  FROM edges LEFT JOIN common USING (src, dst) JOIN deg x ON x.v = src JOIN deg y ON y.v = dst),
emb AS (SELECT v, avg(t) e FROM (SELECT src v, t FROM terms UNION ALL SELECT dst, t FROM terms) GROUP BY v)"""

EMBEDDED_BOTH = f"""
embedded AS (SELECT 'part' dataset, v, e FROM (WITH {inp.PART_GRAPH}, {EMBEDDED} SELECT * FROM emb)
  UNION ALL SELECT 'event', v, e FROM (WITH {inp.EVENT_GRAPH}, {EMBEDDED} SELECT * FROM emb))"""

ORACLES = {
    "c1_update_min": f"""WITH {inp.PART_GRAPH} SELECT v, (CASE WHEN p_size < 10 THEN p_size ELSE 1500 END)::int AS a
      FROM deg JOIN part ON p_partkey = v""",
    "c2_triplets": f"""WITH {inp.EVENT_LINKS}, {inp.CLEAN}, ends AS (SELECT src v FROM links UNION ALL SELECT dst FROM links),
      c AS (SELECT v, count(*) a FROM ends GROUP BY v)
      SELECT src, x.a AS src_attr, dst, y.a AS dst_attr FROM edges JOIN c x ON x.v = src JOIN c y ON y.v = dst""",
    "g6_multiset_difference": """SELECT user_id AS v, count(*) AS m FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1""",
    "g7_distinct_users": """SELECT DISTINCT 'user' || user_id AS screen_name, strftime(ts, '%Y-%m-%d') AS created FROM events""",
    "l13_edges_per_vertex": f"""SELECT 'part' AS dataset, (SELECT round(e / v, 6) FROM
        (WITH {inp.PART_GRAPH} SELECT (SELECT count(*) FROM edges) e, (SELECT count(*) FROM deg) v)) AS edges_per_vertex
      UNION ALL SELECT 'event', (SELECT round(e / v, 6) FROM
        (WITH {inp.EVENT_GRAPH} SELECT (SELECT count(*) FROM edges) e, (SELECT count(*) FROM deg) v))""",
    "b1_drop_self_loops": f"WITH {inp.EVENT_LINKS} SELECT src, dst FROM links WHERE src <> dst",
    "b4_clean_edges": f"WITH {inp.PART_GRAPH} SELECT src, dst FROM edges",
    "b5_clean_edges_valued": f"""WITH {inp.EVENT_LINKS}, {inp.CLEAN},
      vals AS (SELECT DISTINCT user_id v FROM events WHERE event_type = 'purchase')
      SELECT src, dst FROM edges WHERE src IN (SELECT v FROM vals) AND dst IN (SELECT v FROM vals)""",
    "b6_mutual_edges": f"""WITH {inp.EVENT_LINKS}, u AS (SELECT DISTINCT src, dst FROM links)
      SELECT a.src, a.dst, 2::int AS w FROM u a JOIN u b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst""",
    "b7_edge_multiplicity": f"WITH {inp.EVENT_LINKS} SELECT src, dst, count(*) AS w FROM links GROUP BY ALL",
    "b8_induced_edges": f"""WITH {inp.EVENT_LINKS}, {inp.EVENT_COHORT} SELECT DISTINCT src, dst FROM links
      WHERE src IN (SELECT v FROM cohort) AND dst IN (SELECT v FROM cohort)""",
    "b9_assign_ids": f"""WITH {inp.EVENT_LINKS}, names AS (SELECT 'user' || src AS name FROM links UNION SELECT 'user' || dst FROM links)
      SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM names""",
    "b9_rekeyed_edges": f"""WITH {inp.EVENT_LINKS}, names AS (SELECT src AS v FROM links UNION SELECT dst FROM links),
      ids AS (SELECT v, row_number() OVER (ORDER BY 'user' || v) - 1 AS id FROM names)
      SELECT DISTINCT a.id AS src, b.id AS dst FROM links JOIN ids a ON a.v = src JOIN ids b ON b.v = dst""",
    "b10_vertex_subgraph": f"""WITH {inp.PART_GRAPH} SELECT src, dst FROM edges
      JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_size > 25 AND b.p_size > 25""",
    "b11_edge_subgraph": f"""WITH {inp.EVENT_LINKS} SELECT src, dst, count(*) AS w FROM links GROUP BY ALL HAVING count(*) > 1""",
    "d1_degrees": f"WITH {inp.PART_GRAPH} SELECT v, k FROM deg",
    "d2_neighbours": f"WITH {inp.PART_GRAPH} SELECT u AS v, v AS neighbour FROM sym",
    "d2_degrees_of_all": f"""WITH {inp.PART_GRAPH} SELECT p_partkey AS v, coalesce(k, 0)::bigint AS k
      FROM part LEFT JOIN deg ON v = p_partkey""",
    "d3_degree_distribution": f"""WITH {inp.PART_GRAPH}, c AS (SELECT k, count(*) n FROM deg GROUP BY k)
      SELECT k, n, round(n / (SELECT sum(n) FROM c), 6) AS fraction FROM c""",
    "d4_cardinality": f"""WITH {inp.PART_GRAPH} SELECT (SELECT count(*) FROM deg) AS n_vertices, (SELECT count(*) FROM edges) AS n_edges""",
    "d6_value_summary": f"""WITH {inp.PART_GRAPH} SELECT round(median(k)::double, 6) AS "medGraphDeg", round(avg(k), 6) AS "avgGraphDeg" FROM deg""",
    "e2_degree_cdf": f"""WITH both_sets AS ({_dist("part", inp.PART_GRAPH)} UNION ALL {_dist("event", inp.EVENT_GRAPH)})
      SELECT dataset, k, round(sum(fraction) OVER (PARTITION BY dataset ORDER BY k), 2) AS cdf FROM both_sets""",
    "i9_embeddedness": f"WITH {inp.PART_GRAPH}, {EMBEDDED} SELECT v, round(e, 6) AS e FROM emb",
    "d16_embeddedness_cdf": f"""WITH {EMBEDDED_BOTH},
      c AS (SELECT dataset, round(e, 1) bucket, count(*) n FROM embedded GROUP BY ALL),
      sh AS (SELECT *, round(n / sum(n) OVER (PARTITION BY dataset), 3) share FROM c)
      SELECT dataset, bucket, n, share, round(sum(share) OVER (PARTITION BY dataset ORDER BY bucket), 3) AS cdf FROM sh""",
    "l11_embeddedness_centre": f"""WITH {EMBEDDED_BOTH}
      SELECT dataset, round(avg(e), 6) AS mean, round(median(e), 6) AS median FROM embedded GROUP BY dataset""",
    "d8_percentile_n1": f"""WITH g AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) s FROM lineitem GROUP BY 1)
      SELECT l_returnflag, round({inp.percentile_sql("s", 0.05)}, 6) AS p05, round({inp.percentile_sql("s", 0.95)}, 6) AS p95 FROM g""",
    "d13_gini": """WITH x AS (SELECT l_returnflag, l_extendedprice p, l_quantity q,
        row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) i,
        row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) j FROM lineitem)
      SELECT l_returnflag, round(2 * sum(i * p) / (count(*) * sum(p)) - (count(*) + 1) / count(*), 6) AS gini_price,
        round(2 * sum(j * q) / (count(*) * sum(q)) - (count(*) + 1) / count(*), 6) AS gini_quantity
      FROM x GROUP BY l_returnflag""",
    "d15_interval_variance": """SELECT l_returnflag, round(var_samp(l_tax - l_discount), 6) AS interval_variance
      FROM lineitem GROUP BY l_returnflag""",
}
