"""Graphs, users and labels derived from the given tables, in Spark and as SQL fragments of the same names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplenet.operators.bootstrap import TAILS
from ripplenet.operators.cleaning import clean_edges
from ripplenet.operators.ordering import successors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the part on each line of an order to the part on its next line, over all lines.

    Lines are ranked within their order, lines of one number by part, so gaps and repeated numbers cut no chain; links
    grow with the lines and never with the square of an order.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return successors(lines, ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey")


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_edges(part_links(spark, sf_dir))


def event_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the user of each event to the user of the next one, in the order of event ids."""
    return successors(table(spark, sf_dir, "events").select("event_id", "user_id"), [], ["event_id"], "user_id")


def event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_edges(event_links(spark, sf_dir))


def event_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose mean event value is above 48."""
    means = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))
    return means.where(F.col("mean") > 48).select(F.col("user_id").alias("v"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("v"), "ts")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("topic"))


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a table that lies in fewer files than there are cores, for work that is heavy per row.

    A large table has more parts than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("v"), "text"))


# Fixed value: a short stop-word list that occurs in the given texts.
STOP_WORDS = ["that", "with", "this", "from", "they", "have"]


# SQL fragments. Each is one CTE (or several), to be joined by commas after WITH.

PART_LINKS = """
chain AS (SELECT l_partkey src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) dst FROM lineitem),
links AS (SELECT src, dst FROM chain WHERE dst IS NOT NULL)"""

EVENT_LINKS = """
chain AS (SELECT user_id src, lead(user_id) OVER (ORDER BY event_id) dst FROM events),
links AS (SELECT src, dst FROM chain WHERE dst IS NOT NULL)"""

CLEAN = """
edges AS (SELECT DISTINCT least(src, dst) src, greatest(src, dst) dst FROM links WHERE src <> dst)"""

DEGREES = """
sym AS (SELECT src u, dst v FROM edges UNION ALL SELECT dst, src FROM edges),
deg AS (SELECT u v, count(*) k FROM sym GROUP BY u)"""

PART_GRAPH = f"{PART_LINKS}, {CLEAN}, {DEGREES}"
EVENT_GRAPH = f"{EVENT_LINKS}, {CLEAN}, {DEGREES}"

EVENT_COHORT = """
cohort AS (SELECT user_id v FROM events GROUP BY user_id HAVING round(avg(value), 6) > 48)"""


def hash_sql(*parts: str) -> str:
    return f"cast(concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15)) AS bigint)"


def uniform_sql(*parts: str) -> str:
    return f"((cast(concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS bigint) + 0.5::double) / 4294967296.0::double)"


def positions_sql(requests: str, keys: str, kind: str, name: str = "drawn") -> str:
    """CTEs ending in ``name(keys, ord, pos)``: n distinct positions below total for each row of ``requests(keys, n, total)``."""
    h = hash_sql(*keys.split(", "), f"'{kind}'", "j")
    order = hash_sql(*keys.split(", "), f"'{kind}'", "'order'", "pos")
    return f"""
{name}_sized AS (SELECT *, want + 16 + 2 * (want * want // greatest(total, 1)) hashed FROM
  (SELECT {keys}, total, n * 2 <= total few, CASE WHEN n * 2 <= total THEN n ELSE total - n END want
    FROM (SELECT {keys}, least(n, total) n, total FROM {requests}))),
{name}_draws AS (SELECT {keys}, want, few, CASE WHEN j <= hashed THEN {h} % total ELSE j - hashed - 1 END pos, j
  FROM {name}_sized s, unnest(range(1, s.hashed + s.want + 1)) t(j) WHERE want > 0),
{name}_first AS (SELECT {keys}, pos, min(j) j, any_value(want) want, any_value(few) few FROM {name}_draws GROUP BY {keys}, pos),
{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY j) ord FROM {name}_first),
{name}_chosen AS (SELECT * FROM {name}_ranked WHERE ord <= want),
{name}_rest AS (SELECT {keys}, i - 1 pos FROM {name}_sized s, unnest(range(1, s.total + 1)) t(i) WHERE NOT few
  EXCEPT SELECT {keys}, pos FROM {name}_chosen WHERE NOT few),
{name} AS (SELECT {keys}, ord, pos FROM {name}_chosen WHERE few
  UNION ALL SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}, pos), pos FROM {name}_rest)"""


def seeds_sql(population: str, runs: str = "runs") -> str:
    """CTEs ending in ``all_seeds(run_id, ord, v)`` for ``runs(run_id, n)`` over a population with column ``v``."""
    return f"""
frame AS (SELECT v, row_number() OVER (ORDER BY v) - 1 pos FROM (SELECT DISTINCT v FROM {population})),
requests AS (SELECT run_id, n, (SELECT count(*) FROM frame) total FROM {runs}),
{positions_sql("requests", "run_id", "seed")},
all_seeds AS (SELECT run_id, ord, v FROM drawn JOIN frame USING (pos))"""


def distance_sql(max_wave: int, keys: str = "run_id", cost: str = "1", sym: str = "sym", seeds: str = "seeds") -> str:
    """CTEs ending in ``dist(keys, v, d)``: relaxation repeated ``max_wave`` times over unit-or-more edge costs."""
    steps = [f"d0 AS (SELECT DISTINCT {keys}, v, 0 d FROM {seeds})"]
    ks = ", ".join(f"a.{k}" for k in keys.split(", "))
    for w in range(max_wave):
        steps.append(
            f"d{w + 1} AS (SELECT {keys}, v, min(d) d FROM (SELECT {keys}, v, d FROM d{w} UNION ALL "
            f"SELECT {ks}, s.v, a.d + {cost} FROM d{w} a JOIN {sym} s ON s.u = a.v WHERE a.d + {cost} <= {max_wave}) GROUP BY ALL)"
        )
    steps.append(f"dist AS (SELECT {keys}, v, d FROM d{max_wave})")
    return ",\n".join(steps)


def inclusions_sql(waves: list[int], keys: str = "run_id", sym: str = "sym") -> str:
    """CTE ``incl(keys, wave, v, m)`` from ``dist``, ``sym`` and ``seeds`` by the edge rule itself."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    bs = ", ".join(f"b.{k}" for k in keys.split(", "))
    listed = ", ".join(f"({w})" for w in waves)
    return f"""
waves(wave) AS (VALUES {listed}),
hits AS (SELECT {bs}, b.v, greatest(b.d, a.d + 1) since, count(*) m FROM dist a JOIN {sym} s ON s.u = a.v
  JOIN dist b ON {on} AND b.v = s.v WHERE a.d <= b.d GROUP BY ALL
  UNION ALL SELECT {keys}, v, 0, 1 FROM seeds),
incl AS (SELECT {keys}, wave, v, sum(m)::bigint m FROM hits JOIN waves ON since <= wave GROUP BY ALL)"""


def boot_sql(reps: int, values: str = "deg") -> str:
    """CTEs ending in ``boot(run_id, wave, rep, stat)`` from ``incl``, ``seeds(run_id, ord, v)`` and ``values(v, k)``."""
    cand = hash_sql("run_id", "wave", "rep", "'cand'", "j")
    seed = hash_sql("run_id", "wave", "rep", "'seed'", "j")
    return f"""
grp AS (SELECT run_id, wave, k, sum(m)::bigint n, count(*) reached FROM incl JOIN {values} USING (v) GROUP BY ALL),
wts AS (SELECT run_id, wave, k, n, greatest(1000 // k, 1)::bigint * n w FROM grp),
cum AS (SELECT *, (sum(w) OVER (PARTITION BY run_id, wave ORDER BY k))::bigint hi FROM wts),
tot AS (SELECT run_id, wave, sum(n)::bigint n, sum(w)::bigint total FROM wts GROUP BY ALL),
ns AS (SELECT run_id, count(*) ns FROM seeds GROUP BY run_id),
plan AS (SELECT * FROM tot JOIN ns USING (run_id), unnest(range(1, {reps} + 1)) r(rep)),
cd AS (SELECT run_id, wave, rep, 1 + {cand} % total t FROM plan p, unnest(range(1, p.n + 1)) u(j)),
cs AS (SELECT run_id, wave, rep, sum(k)::bigint cand_sum FROM cd JOIN cum USING (run_id, wave) WHERE t > hi - w AND t <= hi GROUP BY ALL),
sd AS (SELECT run_id, wave, rep, 1 + {seed} % ns ord FROM plan p, unnest(range(1, p.ns + 1)) u(j)),
ss AS (SELECT run_id, wave, rep, sum(k)::bigint seed_sum, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) zeros
  FROM sd JOIN seeds USING (run_id, ord) JOIN {values} USING (v) GROUP BY ALL),
boot AS (SELECT run_id, wave, rep,
    (seed_sum + CASE WHEN zeros = ns THEN 0.0 ELSE 1.0 END * cand_sum)::double / (ns + n) stat
  FROM plan JOIN cs USING (run_id, wave, rep) JOIN ss USING (run_id, wave, rep))"""


def split_boot_sql(reps: int, values: str = "deg") -> str:
    """``boot_sql`` with the candidates of a replicate counted by a tree of hashed binomials, as in ``bootstrap_split``.

    ``node`` holds the draws ``n`` among the values ``lo`` to ``hi - 1`` of a run and wave; each is split in halves by a binomial,
    by inversion where the mean is below 10 and else by transformed rejection, tried again under the next ``attempt``.
    """
    tails = "[" + ", ".join(repr(t) for t in TAILS) + "]"

    def tail(x: str) -> str:
        far = f"(1 / 12::double - (1 / 360::double - 1 / 1260::double / (({x} + 1) * ({x} + 1))) / (({x} + 1) * ({x} + 1))) / ({x} + 1)"
        return f"CASE WHEN {x} < {len(TAILS)} THEN ({tails})[{x}::bigint + 1] ELSE {far} END"

    bits = lambda part: f"((cast(concat('0x', {part}) AS bigint) + 0.5::double) / 4503599627370496::double)"
    candidates = f"""
at_value AS (SELECT run_id, wave, k, hi - w below, (row_number() OVER (PARTITION BY run_id, wave ORDER BY k) - 1)::int place FROM cum),
widths AS (SELECT run_id, wave, count(*)::int width FROM cum GROUP BY ALL),
cs AS (WITH RECURSIVE node AS (
  SELECT run_id, wave, rep, 0 lo, width hi, 0::bigint wlo, total whi, n, 0 attempt FROM plan JOIN widths USING (run_id, wave)
  UNION ALL
  SELECT run_id, wave, rep, CASE WHEN side = 0 THEN lo ELSE mid END, CASE WHEN x IS NULL OR side = 1 THEN hi ELSE mid END,
    CASE WHEN side = 0 THEN wlo ELSE below END, CASE WHEN x IS NULL OR side = 1 THEN whi ELSE below END,
    CASE WHEN x IS NULL THEN n WHEN side = 0 THEN x ELSE n - x END, CASE WHEN x IS NULL THEN attempt + 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN y IS NULL THEN NULL WHEN p <= 0.5 THEN y ELSE n - y END x FROM (
    SELECT *, (CASE WHEN n * less < 10 THEN
        list_reduce(list_transform(range(least(n, floor(20 + 4 * (n * less))::bigint)), lambda j: {{'x': j, 'rest': 0::double, 'term': 0::double}}),
          lambda done, next: CASE WHEN done.rest > done.term AND done.x = next.x
            THEN {{'x': done.x + 1, 'rest': done.rest - done.term, 'term': done.term * (n - next.x) / (next.x + 1) * odds}} ELSE done END,
          {{'x': 0::bigint, 'rest': one, 'term': exp(n * ln(1 - less))}}).x
      WHEN k0 < 0 OR k0 > n THEN NULL
      WHEN us >= 0.07 AND two <= 0.92 - 4.2 / b THEN k0::bigint
      WHEN ln(two * ((2.83 + 5.1 / b) * s) / (a / (us * us) + b)) <= (m + 0.5) * ln((m + 1) / (odds * (n - m + 1)))
        + (n + 1) * ln((n - m + 1) / (n - k0 + 1)) + (k0 + 0.5) * ln(odds * (n - k0 + 1) / (k0 + 1))
        + {tail("m")} + {tail("(n - m)")} - {tail("k0")} - {tail("(n - k0)")} THEN k0::bigint END) y
    FROM (SELECT *, floor((2 * a / us + b) * (one - 0.5) + (n * less + 0.5)) k0 FROM (
      SELECT *, -0.0873::double + 0.0248::double * b + 0.01::double * less a FROM (
      SELECT *, 1.15::double + 2.53::double * s b, 0.5 - abs(one - 0.5) us FROM (
      SELECT *, sqrt(n * less * (1 - less)) s, floor((n + 1) * less) m, less / (1 - less) odds,
        {bits("substr(h, 1, 13)")} one, {bits("substr(h, 20, 13)")} two FROM (
      SELECT *, CASE WHEN p <= 0.5 THEN p ELSE 1 - p END less FROM (
      SELECT node.*, (lo + hi) // 2 mid, below, (below - wlo)::double / (whi - wlo)::double p,
        md5(concat_ws('|', node.run_id, node.wave, 'cand', lo, hi, attempt, rep)) h
      FROM node JOIN at_value v ON v.run_id = node.run_id AND v.wave = node.wave AND v.place = (lo + hi) // 2 WHERE hi - lo > 1))))))
    )), (VALUES (0), (1)) sides(side)
  WHERE (x IS NULL AND side = 0) OR (side = 0 AND x > 0) OR (side = 1 AND n - x > 0))
  SELECT node.run_id, node.wave, rep, sum(n * k)::bigint cand_sum FROM node
  JOIN at_value v ON v.run_id = node.run_id AND v.wave = node.wave AND v.place = lo WHERE hi - lo = 1 GROUP BY ALL),"""
    whole = boot_sql(reps, values)
    before, rest = whole.split("cd AS (", 1)
    return f"{before}{candidates.lstrip()}\nsd AS ({rest.split('sd AS (', 1)[1]}"


def percentile_sql(values: str, p: float) -> str:
    at = f"((len({values}) + 1) * {p}::double)"
    i = f"floor({at})::int"
    return (
        f"CASE WHEN {i} = 0 THEN {values}[1] WHEN {i} >= len({values}) THEN {values}[-1] "
        f"ELSE {values}[{i}] + ({at} - {i}) * ({values}[{i} + 1] - {values}[{i}]) END"
    )


def summary_sql(values: str = "deg", name: str = "summary") -> str:
    """CTEs ending in ``summary(run_id, wave, lmsiAll, ...)``."""
    return f"""
gathered AS (SELECT run_id, wave, avg(stat) AS mean, var_samp(stat) AS variance, min(stat) lmin, max(stat) lmax,
  list_sort(list(stat)) s FROM boot GROUP BY ALL),
cov AS (SELECT run_id, wave, sum(n)::bigint included, sum(reached)::bigint reached FROM grp GROUP BY ALL),
truth AS (SELECT (SELECT count(*) FROM deg) nv, (SELECT count(*) FROM edges) ne, median(k)::double med, avg(k)::double av FROM {values}),
{name} AS (SELECT run_id, wave, included / nv AS "lmsiAll", reached / nv AS "lmsiDistinct", ne::bigint AS edges, mean,
  med AS "medGraphDeg", av AS "avgGraphDeg", variance AS "varianceOfBootStrapDegrees",
  {percentile_sql("s", 0.05)} AS l1, {percentile_sql("s", 0.95)} AS l2, lmin, lmax
  FROM gathered JOIN cov USING (run_id, wave), truth)"""


SUMMARY_COLUMNS = (
    "lmsiAll", "lmsiDistinct", "mean", "medGraphDeg", "avgGraphDeg", "varianceOfBootStrapDegrees", "l1", "l2", "lmin", "lmax"
)


def rounded_sql(*names: str) -> str:
    return ", ".join(f'round("{n}", 6) AS "{n}"' for n in names)
