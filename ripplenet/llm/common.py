"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six characters \x20 and \x09 to \x0D: the only ones that separate words and are stripped from lines.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
# Stands for a null document id wherever ids are compared, so such rows come last; see ``with_identity`` where they
# must not count as one document.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def named(column: str) -> Column:
    """The column of exactly that name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(docs: DataFrame, *needed: str, without: tuple[str, ...] = ()) -> DataFrame:
    """All columns of ``docs`` in the struct ``_doc``, so that names of their own stand free, and the ``needed`` ones beside."""
    kept = [named(c).alias(c) for c in docs.columns if c not in without]
    return docs.select(F.struct(*kept).alias("_doc"), *[named(c).alias(c) for c in needed])


def unpacked(rows: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """``columns`` out of ``_doc``, those in ``replaced`` by their new values."""
    return rows.select(*[(replaced[c] if c in replaced else F.col("_doc").getField(c)).alias(c) for c in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(n: Column) -> Column:
    """0 .. n-1, or an empty array."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def whole_text(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def order_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(LAST_ID))


def greatest_id(docs: DataFrame) -> int:
    """The greatest ``doc_id``, at least 0."""
    return max(docs.agg(F.max(F.col("doc_id").cast("bigint"))).first()[0] or 0, 0)


def with_identity(docs: DataFrame, greatest: int | None = None) -> DataFrame:
    """``docs`` with ``_id``: the id, or for a null one a hash of the text into the numbers above the ``greatest`` id.

    Rows with a null id are one document only if their texts are equal. Different texts get different numbers except by
    a collision of hashes, which becomes likely only where ids come close to the end of the 64-bit range.
    """
    greatest = greatest_id(docs) if greatest is None else greatest
    own = F.lit(LAST_ID) - F.pmod(F.xxhash64(whole_text()), F.lit(max(LAST_ID - greatest, 1)).cast("bigint"))
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("bigint"), own))
