"""Splitting hot keys of a large join side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplenet.storage import small_table

# A key is hot when it holds more than 1/HOT_KEY_LIMIT of the rows and more than a salt takes, so there are fewer than
# HOT_KEY_LIMIT hot keys whatever the data looks like: that is the proven size (some MB) of the list broadcast below.
# How many salts a hot key gets depends on its own rows alone.
HOT_KEY_LIMIT = 262_144
ROWS_PER_SALT = 1_000_000
# Counters of a sketch: a key with more than some 1/75,000 of the rows is never missed, and a sketch is at most some MB.
COUNTERS = 100_000
# Sketches that the last task merges.
SKETCH_GROUPS = 512


def hot_keys(df: DataFrame, key: str, rows: int, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame | None:
    """``(key, n_salt)`` for the keys of ``df`` that need splitting, or None; ``rows`` is the row count of ``df``.

    The counts are combined map-side before the shuffle. No key can be hot in a table of ``rows_per_salt`` rows.
    """
    return hot_counts(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, "_n", rows, rows_per_salt)


def hot_counts(
    counts: DataFrame, key: str, count: str, rows: int, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame | None:
    """``hot_keys`` of a table whose keys are counted already; ``rows`` is the sum of the counts."""
    floor = max(rows_per_salt, rows // HOT_KEY_LIMIT)
    if rows <= floor:
        return None
    n_salt = F.ceil(F.col(count) / F.lit(rows_per_salt)).cast("int")
    found = counts.where(F.col(count) > floor).select(key, n_salt.alias("n_salt"))
    listed = found.collect()  # fewer than HOT_KEY_LIMIT rows
    if not listed:
        return None
    table = small_table(counts.sparkSession, [key, "n_salt"], listed)
    return table.select(F.col(key).cast(found.schema[key].dataType), F.col("n_salt").cast("int"))


def hot_ends(
    df: DataFrame, columns: Sequence[str] = ("src", "dst"), rows_per_salt: int = ROWS_PER_SALT, counters: int = COUNTERS
) -> dict[str, DataFrame | None]:
    """``(column, n_salt)`` for the values of each column that need splitting, or None, in one pass over ``df``.

    Every task counts into a sketch of fixed size; sketches merge in groups and then into one, so no distinct value is
    shuffled. Counts are estimates, which is enough: how many salts a key has changes no result. ``df`` is read once for
    this, so a table that is costly to make is best written first.
    """
    sketch = lambda do, c: F.expr(f"{do}(`{c}`, {counters})").alias(c)
    groups = df.groupBy((F.spark_partition_id() % SKETCH_GROUPS).alias("_group")).agg(
        F.count(F.lit(1)).alias("_rows"), *[sketch("approx_top_k_accumulate", c) for c in columns]
    )
    # Grouped, as sketches of an empty table cannot be combined.
    whole = groups.groupBy(F.lit(0).alias("_all")).agg(F.sum("_rows").alias("_rows"), *[sketch("approx_top_k_combine", c) for c in columns])
    top = lambda c: F.expr(f"approx_top_k_estimate(`{c}`, {counters})").alias(c)
    found = whole.where(F.col("_rows") > rows_per_salt).select(*[top(c) for c in columns])
    hot = lambda c: F.filter(c, lambda e: e["item"].isNotNull() & (e["count"] > rows_per_salt)).alias(c)
    row = found.select(*[hot(c) for c in columns]).first()
    salts: dict[str, DataFrame | None] = {}
    for c in columns:
        listed = [(e["item"], -(-e["count"] // rows_per_salt)) for e in row[c]] if row else []
        table = small_table(df.sparkSession, [c, "n_salt"], listed) if listed else None
        salts[c] = table and table.select(F.col(c).cast(df.schema[c].dataType), F.col("n_salt").cast("int"))
    return salts


def add_salt(df: DataFrame, key: str, salts: DataFrame, spread_by: str) -> DataFrame:
    """Side with the many rows: a hot key's rows get a salt from ``spread_by``, all others 0."""
    salted = df.join(F.broadcast(salts), key, "left")
    salt = F.pmod(F.xxhash64(spread_by), F.coalesce(F.col("n_salt"), F.lit(1)).cast("bigint")).cast("int")
    return salted.withColumn("salt", salt).drop("n_salt")


def repeat_per_salt(df: DataFrame, key: str, salts: DataFrame) -> DataFrame:
    """Side with the few rows: one copy per salt of a hot key."""
    n_salt = F.coalesce(F.col("n_salt"), F.lit(1))
    return (
        df.join(F.broadcast(salts), key, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), n_salt - 1)))
        .drop("n_salt")
    )


def join_split(many: DataFrame, few: DataFrame, key: str, salts: DataFrame | None, spread_by: str) -> DataFrame:
    """Inner join of a large table to one row per key, the hot keys of the large side split over their salts."""
    if salts is None:
        return many.join(few, key)
    return (
        add_salt(many, key, salts, spread_by)
        .join(repeat_per_salt(few, key, salts), [key, "salt"])
        .drop("salt")
    )


def semi_split(many: DataFrame, few: DataFrame, key: str, salts: DataFrame | None, spread_by: str) -> DataFrame:
    """Rows of a large table whose key occurs in ``few (key)``, the hot keys of the large side split over their salts."""
    if salts is None:
        return many.join(few, key, "left_semi")
    salted = add_salt(many, key, salts, spread_by)
    return salted.join(repeat_per_salt(few, key, salts), [key, "salt"], "left_semi").select(*many.columns)
