"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Documents scored as toxic go; repeated lines go; one document of each near-duplicate group stays; documents that hold
benchmark items go; and the rest is drawn to target weights. All stages but the last keep the columns of ``documents``.

Nulls and edge cases: columns beyond id and text pass through each stage whatever they are called; only ``n_chars`` is counted
anew where texts are cut, and the last stage replaces ``n_tokens`` and ``n_epochs``. Null and empty texts are neither toxic nor
copies nor contaminated and go along to the end. Equal rows are one document for the near-duplicate stage. An empty table stays
empty. Near-duplicates are sought after repeated lines are gone, so a copy is found by the lines that it alone has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplenet.llm import decontamination, line_dedup, mixing, near_dedup, toxicity
from ripplenet.llm.common import WORD, packed, table, unpacked, whole_text, with_identity
from ripplenet.llm.queries import MIX_SHARE, MIX_WEIGHTS
from ripplenet.storage import materialize


def _free(docs: DataFrame) -> DataFrame:
    """Id and text beside a struct of all other columns, whose names then clash with nothing."""
    return packed(docs, "doc_id", "text", without=("text",))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half, with their columns as they were. Rows with equal ids are scored one by one."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    kept = toxicity.scored(_free(docs), model).where("_score < 0.5")
    return unpacked(kept, docs.columns, text=F.col("text"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents cut to lines that no earlier document has, and ``n_chars`` counted anew.

    A document that loses lines and has no word left goes: all it said stands in earlier ones. One that had no word before
    stays. A null text becomes empty.
    """
    cut = line_dedup.dedup_lines(_free(docs))
    kept = cut.where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    return unpacked(kept, docs.columns, text=F.col("text"), n_chars=F.char_length("text").cast("bigint"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; of rows that repeat an id, the first by text.

    Documents without a word are in no group. Rows with a null id are documents of their own and sort last.
    """
    rows = with_identity(_free(docs))
    later = materialize(near_dedup.copies(rows.select("_id", "text")).select("_id"), "later-copies")
    rest = rows.join(later, "_id", "left_anti")
    # One group is the rows of one id. Rows with a null id are one group only if their texts are equal.
    first = Window.partitionBy("_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy(whole_text())
    kept = rest.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return unpacked(kept, docs.columns, text=F.col("text"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; if rows repeat an id, one that holds an item takes all of them along."""
    rows = with_identity(_free(docs))
    found = rows.select(F.col("_id").alias("doc_id"), "text")
    links = decontamination.contaminated(found, table(spark, sf_dir, "benchmark"))
    gone = materialize(links.select(F.col("doc_id").alias("_id")).distinct(), "contaminated")
    return unpacked(rows.join(gone, "_id", "left_anti"), docs.columns, text=F.col("text"))


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the mixture, with their token counts and the number of times each is drawn."""
    return mixing.mix(docs, MIX_SHARE, MIX_WEIGHTS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", draw_mixture),
]
# A learnt classifier, similarity search and alignment are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
