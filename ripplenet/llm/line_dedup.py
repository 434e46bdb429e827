"""Exact line de-duplication over a whole corpus.

Every line becomes a 128-bit hash of its key. Keys with a large share of the rows are counted first (combined before the
shuffle) and settled where they stand, against a broadcast list of proven size. All other hashes are range-partitioned
with a secondary sort by document and position; a streaming window keeps the first document of each run of equal
hashes. What returns to the documents is a run-length compressed bitmap of dropped lines, never text.

Nulls and edge cases: a null or empty text is one empty line. A null ``doc_id`` sorts after every other id, and all such
rows count as one document. Rows that repeat an id belong to the same document, so they never drop each other's lines.
An empty table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplenet.llm.common import SPACES, let, order_id, positions, whole_text
from ripplenet.storage import materialize

MIN_KEY_CHARS = 10
# A key is settled by broadcast if it has over max(HOT_ROWS, rows / HOT_KEYS) rows: at most HOT_KEYS keys, some 8 MB.
HOT_ROWS = 1000
HOT_KEYS = 262_144
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["_h1", "_h2"]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _LOWER)


def line_hashes(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``(_id, _row, pos, _h1, _h2)`` for each line whose key has at least ``min_chars`` code points."""
    rows = docs.select(order_id().alias("_id"), whole_text().alias("_text"))
    lines = rows.select("_id", F.xxhash64("_text").alias("_row"), F.posexplode(lines_of(F.col("_text"))))
    keys = lines.select("_id", "_row", "pos", line_key(F.col("col")).alias("_key"))
    keys = keys.where(F.char_length("_key") >= min_chars)
    return keys.select(
        "_id", "_row", "pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")
    )


def repeated_lines(hashes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(_id, _row, pos)`` of the lines whose key stands in an earlier document. ``hashes`` is a written table."""
    floor = max(hot_rows, hashes.count() // HOT_KEYS)
    counts = hashes.groupBy(_KEY).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    hot = materialize(counts.where(F.col("_n") > floor).select(*_KEY, "_first"), "hot-lines")
    by_broadcast = hashes.join(F.broadcast(hot), _KEY)
    rest = hashes.join(F.broadcast(hot), _KEY, "left_anti").repartitionByRange(*_KEY)
    stream = Window.partitionBy(_KEY).orderBy("_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_range = rest.withColumn("_first", F.first("_id").over(stream))
    columns = ["_id", "_row", "pos", "_first"]
    both = by_broadcast.select(columns).unionByName(by_range.select(columns))
    return both.where(F.col("_id") > F.col("_first")).drop("_first")


def _runs(ordered: Column) -> Column:
    """Ascending distinct ints as runs of consecutive values."""

    def runs(p: Column) -> Column:
        starts = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1) != x - 1, F.lit(True)))
        ends = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n")))

    return let(ordered, runs)


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(_id, _row, dropped, n_dropped)`` for each document that loses lines; ``dropped`` holds runs of positions."""
    repeated = repeated_lines(materialize(line_hashes(docs, min_chars), "line-hashes"), hot_rows)
    marked = repeated.groupBy("_id", "_row").agg(F.sort_array(F.collect_set("pos")).alias("_at"))
    return marked.select("_id", "_row", _runs(F.col("_at")).alias("dropped"), F.size("_at").alias("n_dropped"))


def kept_text(text: Column, dropped: Column) -> Column:
    """The text without the lines in the runs of ``dropped``; null runs drop nothing."""

    def keep(lines: Column) -> Column:
        gone = F.flatten(F.transform(dropped, lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1)))
        stay = F.array_except(positions(F.size(lines)), gone)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return F.when(dropped.isNull(), text).otherwise(let(lines_of(text), keep))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``docs`` with its text cut to the kept lines, and ``n_lines`` and ``n_dropped`` beside it.

    Columns of ``docs`` with these two names are replaced; null texts come back empty.
    """
    marks = drop_bitmaps(docs, min_chars, hot_rows)
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    named = docs.select(
        F.struct(*kept).alias("_doc"), order_id().alias("_id"), whole_text().alias("_text"),
        F.xxhash64(whole_text()).alias("_row"),
    )
    joined = named.join(marks.hint("shuffle_hash"), ["_id", "_row"], "left")
    out = joined.select(
        *[F.col("_doc")[c].alias(c) for c in kept],
        kept_text(F.col("_text"), F.col("dropped")).alias("text"),
        F.size(lines_of(F.col("_text"))).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
    )
    return out.select(*[c for c in docs.columns if c in out.columns], *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])


def line_digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of each document after de-duplication."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
