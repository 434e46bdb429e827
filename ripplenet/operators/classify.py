"""Random-forest labelling of users from word-count vectors."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ripplenet.operators import forest
from ripplenet.operators.forest import Forest
from ripplenet.storage import materialize, materialized_at, small_table

# Fixed values of the published classifier.
TREES = 10
MAX_CATEGORIES = 4


def as_features(vectors: DataFrame, size: int) -> DataFrame:
    """Add the sparse ML vector ``features`` of the arrays ``ids`` (ascending) and ``counts``.

    A sparse vector is stored as a struct, so the rows are written with that struct and read back as vectors: no Python
    runs, and the fit, which goes over its input many times, reads a table.
    """
    sparse = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.col("ids").cast("array<int>").alias("indices"), F.col("counts").cast("array<double>").alias("values"),
    )
    written, path = materialized_at(vectors.withColumn("features", sparse), "features")
    fields = [StructField("features", VectorUDT()) if f.name == "features" else f for f in written.schema]
    return written.sparkSession.read.schema(StructType(fields)).parquet(path)


def label_index(training: DataFrame) -> DataFrame:
    """``(label, index)``: the labels of ``training`` in the order that the classifier numbers them."""
    model = StringIndexer(inputCol="label", outputCol="index", stringOrderType="alphabetAsc").fit(training)
    return small_table(training.sparkSession, ["label", "index"], [(name, i) for i, name in enumerate(model.labels)])


def feature_index(vectors: DataFrame, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """``(id, values, categorical)`` of the features in ``vectors (ids, counts)``: its smallest values, and if these are all.

    A feature with up to ``max_categories`` different values is categorical; rows without it hold its value 0. At most
    ``max_categories`` + 1 values of a feature are kept, counted before the shuffle and limited before the last one, so
    nothing grows with the rows, and nothing at all comes to the driver.
    """
    rows = vectors.count()
    each = vectors.select(F.explode(F.arrays_zip("ids", "counts")).alias("e")).select(F.col("e.ids").alias("id"), F.col("e.counts").cast("double").alias("value"))
    counts = each.groupBy("id", "value").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") < rows).select("id", F.lit(0.0).alias("value"))
    order = Window.partitionBy("id").orderBy("value")
    few = counts.select("id", "value").unionByName(held).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= max_categories + 1)
    return few.groupBy("id").agg(F.sort_array(F.collect_list("value")).alias("values")).withColumn("categorical", F.size("values") <= max_categories)


def fit_labels(training: DataFrame, trees: int = TREES, seed: int = 1) -> Forest:
    """Label and feature index and forest, fitted on ``training(label, features)`` alone; ``transform`` adds ``predictedLabel``.

    Features of up to ``MAX_CATEGORIES`` values are categorical. Draws hash the whole row, so they follow its key if it has one.
    """
    indexed = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc").fit(training)
    if not indexed.labels:
        raise ValueError("no labelled rows to learn from")
    size, ids, values = forest.sparse_parts(F.col("features"))
    rows = indexed.transform(training).select(
        F.xxhash64(*training.columns).alias("key"), F.col("_y").cast("int").alias("y"), ids.alias("ids"), values.alias("values"), size.alias("size")
    )
    rows = materialize(rows, "forest-vectors")
    index = materialize(feature_index(rows.select("ids", F.col("values").alias("counts"))), "feature-index")
    return forest.grow(rows, index, indexed.labels, rows.agg(F.max("size")).first()[0], trees, seed)


def train_and_score(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows labelled 0 or 1 train; all others are to be scored and lose their label, which the indexer would reject."""
    known = F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    return rows.where(known), rows.where(~known).drop("label")


def prediction_table(scored: DataFrame, kept: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(v, label)``: predictions, then the kept wave-one users and the seeds as ``1.0``."""
    fixed = kept.select("v").unionByName(seeds.select("v")).withColumn("label", F.lit("1.0"))
    return scored.select("v", F.col("predictedLabel").alias("label")).unionByName(fixed)
