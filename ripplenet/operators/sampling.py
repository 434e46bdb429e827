"""Exact random samples with reproducible draws.

Many runs draw from one table through dense positions, at a cost that follows the size of the samples instead of
runs x table; nothing is ranked per run over the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplenet.functions.hashing import draw_below, hash_int, numbered_heads
from ripplenet.operators.ordering import ordered_running
from ripplenet.storage import materialize, shuffle_width

# Draws beyond n that make a shortage of distinct positions unlikely; see _sized for the part that grows with n.
EXTRA_DRAWS = 16
DRAWS_PER_TASK = 16_384
CHUNKS_PER_TASK = 64
ROW_DRAWS = 100_000
TOP_N = 10_000
# Hexadecimal digits by which a pass narrows a hash threshold: 65,536 counts come to the driver.
PREFIX_DIGITS = 4


def hash_threshold(hashed: DataFrame, n: int, digits: int = PREFIX_DIGITS, top: int = TOP_N) -> tuple | None:
    """``(hash, key)`` of the ``n``-th of the rows ``hashed (hash, key)`` in this order, or None if there are fewer.

    Hashes are 32 hexadecimal digits. Counts of their prefixes narrow it down: a pass counts the rows of each prefix that
    continues the one found so far, at most 16**``digits`` numbers, until what is left before the n-th row is a top-n. No
    row is ranked, moved or written.
    """
    found, before = "", 0
    while n - before > top and len(found) < 32:
        prefix = F.substring("hash", 1, len(found) + digits).alias("_prefix")
        counts = hashed.where(F.col("hash").startswith(found)).groupBy(prefix).agg(F.count(F.lit(1)).alias("_n"))
        for prefix, rows in sorted(tuple(r) for r in counts.collect()):  # at most 16**digits
            if before + rows >= n:
                found = prefix
                break
            before += rows
        else:
            return None
    rest = hashed.where(F.col("hash").startswith(found)).select("hash", "key").orderBy("hash", "key").limit(n - before)
    last = rest.agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("hash", "key")).alias("_last")).first()
    return tuple(last["_last"]) if last["_n"] == n - before else None


def sample_exact(df: DataFrame, key: str, n: int, label: str = "0") -> DataFrame:
    """``n`` rows without replacement: those with the ``n`` smallest hashes of the unique ``key``.

    A small sample is a top-n per partition without a sort of the table; a large one, which a limit would draw through
    one task, is one filter by the hash of its last row. Both take the same rows.
    """
    if n <= 0:
        return df.limit(0)
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(label), F.col(key))))
    if n <= TOP_N:
        return hashed.orderBy("_h", key).limit(n).drop("_h")
    last = hash_threshold(hashed.select(F.col("_h").alias("hash"), F.col(key).alias("key")), n)
    if last is None:
        return df
    return hashed.where((F.col("_h") < last[0]) | ((F.col("_h") == last[0]) & (F.col(key) <= last[1]))).drop("_h")


def explode_count(df: DataFrame, count: str, name: str, chunk: int = DRAWS_PER_TASK) -> DataFrame:
    """Repeat every row ``count`` times with ``name`` = 1..count, long repeats dealt out over all tasks.

    The partition number is explicit and follows the number of chunks: the rows are few and small before they are
    repeated, and adaptive execution would otherwise merge them into one task.
    """
    return _dealt_out(df, count, chunk).withColumn(name, F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def _dealt_out(df: DataFrame, count: str, chunk: int) -> DataFrame:
    """Every row once for each ``chunk`` of its repeats ``_first`` to ``_last``."""
    chunks = df.where(F.col(count) > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / F.lit(chunk))))
    )
    repeats = df.agg(F.sum(F.ceil(F.greatest(F.col(count), F.lit(0)) / F.lit(chunk)))).first()[0] or 0
    width = max(shuffle_width(df.sparkSession), -(-int(repeats) // CHUNKS_PER_TASK))
    spread = chunks.repartition(width, *df.columns, "_chunk")
    first = F.col("_chunk") * chunk + 1
    last = F.least(F.col(count).cast("bigint"), (F.col("_chunk") + 1) * chunk)
    return spread.withColumn("_first", first).withColumn("_last", last).drop("_chunk")


def hashed_draws(
    df: DataFrame, count: str, bound: str, labels: Sequence[str], kind: str, name: str, chunk: int = DRAWS_PER_TASK
) -> DataFrame:
    """Repeat every row ``count`` times with ``name`` = 1 + ``draw_below(bound, labels, kind, j)`` for j = 1, 2, ...

    For draws in their millions: those of a chunk differ in ``j`` only and are hashed side by side.
    """
    prefix = F.concat_ws("|", *labels, F.lit(kind), F.lit(""))
    dealt = _dealt_out(df, count, chunk).select(*df.columns, prefix.alias("_prefix"), "_first", "_last")
    kept = list(df.columns)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = zip(*(batch[c].to_pylist() for c in ("_prefix", "_first", "_last", bound)), strict=True)
            for i, (text, first, last, below) in enumerate(asked):
                drawn = pa.array(numbered_heads(text, first, last) % below + 1)
                row = batch.take(pa.array(np.full(len(drawn), i)))
                yield pa.RecordBatch.from_arrays([*[row[c] for c in kept], drawn], names=[*kept, name])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], f"{name} bigint"])
    return dealt.mapInArrow(draw, schema)


def _sized(requests: DataFrame) -> DataFrame:
    """Cap ``n``, and decide whether to draw the sample or its complement, and how many hashed draws that takes."""
    capped = requests.withColumn("n", F.least("n", "total").cast("bigint")).withColumn(
        "_few", F.col("n") * 2 <= F.col("total")
    )
    sized = capped.withColumn("_want", F.when(F.col("_few"), F.col("n")).otherwise(F.col("total") - F.col("n")))
    want = F.col("_want")
    return sized.withColumn("_hashed", want + EXTRA_DRAWS + 2 * F.floor(want * want / F.greatest("total", F.lit(1))))


def distinct_positions(requests: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """``n`` distinct positions below ``total`` per request ``(keys, n, total)``: ``(keys, ord, pos)``.

    Draws are taken in order and repeats dropped, which is simple random sampling without replacement. Above half of
    the table the drawn positions are the ones left out, so the work stays proportional to the sample. Should the
    hashed draws not suffice, the smallest unused positions complete the sample.

    A request is one row and its sample is drawn inside it, without any shuffle; ``large_distinct_positions`` takes the
    requests of more than ``ROW_DRAWS`` positions.
    """
    keys = list(keys)
    labels = [F.col(k) for k in keys]
    sized = _sized(requests)
    want = F.col("_want").cast("int")
    hashed = F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.col("_hashed")), lambda j: draw_below(F.col("total"), *labels, kind, j)
    )
    unique = F.array_distinct(hashed)
    enough = F.when(F.size(unique) >= want, unique).otherwise(
        F.array_distinct(F.concat(unique, F.sequence(F.lit(0).cast("bigint"), F.col("_want") - 1)))
    )
    drawn = sized.withColumn("_chosen", F.when(want > 0, F.slice(enough, F.lit(1), want)).otherwise(F.array().cast("array<bigint>")))
    others = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1), F.col("_chosen"))
    keyed = F.transform(others, lambda p: F.struct(hash_int(*labels, kind, F.lit("order"), p).alias("h"), p.alias("p")))
    rest = F.transform(F.array_sort(keyed), lambda e: e["p"])
    positions = F.when(F.col("_few"), F.col("_chosen")).otherwise(rest)
    placed = drawn.select(*keys, F.posexplode(positions).alias("_at", "pos"))
    return placed.select(*keys, (F.col("_at") + 1).cast("bigint").alias("ord"), "pos")


def large_distinct_positions(requests: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """``distinct_positions`` for requests of any size: the same positions from exploded draws and distributed ranks."""
    keys = list(keys)
    labels = [F.col(k) for k in keys]
    sized = _sized(requests).withColumn(
        "_draws", F.when(F.col("_want") > 0, F.col("_hashed") + F.col("_want")).otherwise(F.lit(0))
    )
    draws = explode_count(sized, "_draws", "j")
    hashed = draw_below(F.col("total"), *labels, kind, F.col("j"))
    pos = F.when(F.col("j") <= F.col("_hashed"), hashed).otherwise(F.col("j") - F.col("_hashed") - 1)
    first = draws.withColumn("pos", pos).groupBy(*keys, "pos", "_want", "_few").agg(F.min("j").alias("j"))
    ranked = ordered_running(first, keys, ["j"], rank="ord")
    chosen = ranked.where(F.col("ord") <= F.col("_want"))
    taken = chosen.where("_few").select(*keys, "ord", "pos")

    everything = explode_count(sized.where(~F.col("_few")), "total", "_at")
    rest = everything.select(*keys, (F.col("_at") - 1).alias("pos")).join(
        chosen.where(~F.col("_few")).select(*keys, "pos"), [*keys, "pos"], "left_anti"
    )
    shuffled = rest.withColumn("_h", hash_int(*labels, kind, F.lit("order"), F.col("pos")))
    ordered = ordered_running(shuffled, keys, ["_h", "pos"], rank="ord")
    return taken.unionByName(ordered.select(*keys, "ord", "pos"))


def sample_positions(requests: DataFrame, keys: Sequence[str], kind: str, row_draws: int = ROW_DRAWS) -> DataFrame:
    """``distinct_positions`` where sizes come from the data: requests too large for a row are drawn apart.

    Requests are short rows that grow into many, so they are dealt out by number, not by size.
    """
    sized = materialize(requests, "requests").repartition(shuffle_width(requests.sparkSession), *keys)
    drawn = distinct_positions(sized.where(F.col("n") <= row_draws), keys, kind)
    large = sized.where(F.col("n") > row_draws)
    return drawn if large.isEmpty() else drawn.unionByName(large_distinct_positions(large, keys, kind))


def positions_of(population: DataFrame) -> DataFrame:
    """``(graph_id, v, pos)``: dense positions ``0..`` of the vertices of each graph, the frame every draw refers to."""
    ranked = ordered_running(population.select("graph_id", "v"), ["graph_id"], ["v"], rank="_rank")
    return ranked.select("graph_id", "v", (F.col("_rank") - 1).alias("pos"))


def choose_seeds(frame: DataFrame, runs: DataFrame, row_draws: int = ROW_DRAWS) -> DataFrame:
    """Random seeds of ``runs(run_id, graph_id, n)`` over ``frame(graph_id, v, pos)``: ``(run_id, ord, v)``.

    ``ord`` is the draw order, so the seeds of a smaller count are the prefix ``ord <= count``. A run of more than
    ``row_draws`` seeds is drawn over many tasks.
    """
    sizes = frame.groupBy("graph_id").agg(F.count(F.lit(1)).alias("total"))
    requests = runs.select("run_id", "graph_id", "n").join(sizes, "graph_id")
    drawn = sample_positions(requests.select("run_id", "n", "total"), ["run_id"], "seed", row_draws)
    placed = drawn.join(runs.select("run_id", "graph_id"), "run_id")
    return placed.join(frame, ["graph_id", "pos"]).select("run_id", "ord", "v")


def sample_with_replacement(pool: DataFrame, requests: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """``n`` draws per request ``(keys, run_id, n, size)`` from the first ``size`` seeds of its run, repeats kept.

    ``pool`` is ``(run_id, ord, v)``; the result is ``(keys, run_id, j, v)``.
    """
    labels = [*keys, "run_id"]
    draws = explode_count(requests.select(*labels, "n", "size"), "n", "j")
    ord_ = draw_below(F.col("size"), *[F.col(k) for k in labels], kind, F.col("j")) + 1
    return draws.withColumn("ord", ord_).join(pool, ["run_id", "ord"]).select(*labels, "j", "v")


def proxy_mean(seeds: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean value of a seed list: ``(keys, mu_proxy)``. The list is a membership filter, repeats count once."""
    members = seeds.select(*keys, "v").distinct()
    return members.join(values.select("v", "k"), "v").groupBy(*keys).agg(F.avg("k").alias("mu_proxy"))


def proxy_mean_of_graph(degrees: DataFrame, seeds: DataFrame, h: int) -> DataFrame:
    """Mean degree of ``h`` seeds per run drawn without replacement, ``h`` capped at the number of seeds."""
    sizes = seeds.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    drawn = distinct_positions(sizes.select("run_id", F.lit(h).alias("n"), "total"), ["run_id"], "proxy")
    picked = drawn.select("run_id", (F.col("pos") + 1).alias("ord")).join(seeds, ["run_id", "ord"])
    return proxy_mean(picked, degrees, ["run_id"])
