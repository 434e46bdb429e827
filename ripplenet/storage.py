"""Cutting lineage with tables written to the folder shared by all executors.

Iterative operators write each round as a small Parquet table. A lost executor then costs a re-read instead of a
re-run of every earlier round, and the planner sees true file sizes, so its broadcast threshold is a real check.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

# Spark's own setting for shuffle files that are removed at the end of the query that made them.
FREED_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_roots: dict[str, str] = {}
# Open scopes of scratch tables, innermost last: the folder of each and the names of its bucketed tables.
_scopes: list[tuple[str, list[str]]] = []
# Tables that several results share, by application, label and versions of their inputs.
_shared: dict[tuple, tuple[DataFrame, str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's ``spark.checkpoint.dir``, shared by the driver and all executors.

    A temporary folder stands in only for a session of one process that names none, as in tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\[]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="ripplenet-")
    return _local_roots[app]


def _fresh_path(spark: SparkSession, label: str) -> str:
    folder = _scopes[-1][0] if _scopes else f"{scratch_root(spark)}/ripplenet-tables"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at its end: ``with scratch(spark): sweep(...).write.parquet(path)``.

    A result that is to outlive the scope must be written or collected inside it. Scopes may be nested.
    """
    folder, tables = f"{scratch_root(spark)}/ripplenet-tables/scope-{uuid.uuid4().hex}", []
    _scopes.append((folder, tables))
    try:
        yield
    finally:
        _scopes.remove((folder, tables))
        for key in [k for k, (_, path) in _shared.items() if path.startswith(folder)]:
            del _shared[key]
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        files, path = _file_system(spark, folder)
        files.delete(path, True)


def input_version(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """What tells a later state of a table's files from an earlier one: their latest change and their size."""
    files, folder = _file_system(spark, path)
    status = files.getFileStatus(folder)
    parts = files.listStatus(folder) if status.isDirectory() else [status]
    return path, max([status.getModificationTime(), *(p.getModificationTime() for p in parts)]), sum(p.getLen() for p in parts)


def shared(spark: SparkSession, label: str, inputs: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` as a written table that later calls of the same label and unchanged input files find again.

    It lasts as long as the ``scratch`` scope that it was first asked for in, or as the application.
    """
    key = (spark.sparkContext.applicationId, label, *(input_version(spark, p) for p in inputs))
    if key not in _shared:
        _shared[key] = _settled_at(spark, label, build)
    return _shared[key][0]


def settled(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` as a written table; whatever else it wrote on the way is removed once the table is there."""
    return _settled_at(spark, label, build)[0]


def _settled_at(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    path = _fresh_path(spark, label)
    with scratch(spark):
        df = build()
        schema = df.schema
        with freed_shuffles(spark):
            df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each write inside go at its end, not when the driver's garbage collector finds them."""
    before = spark.conf.get(FREED_SHUFFLES, None)
    spark.conf.set(FREED_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED_SHUFFLES)
        else:
            spark.conf.set(FREED_SHUFFLES, before)


def materialized_at(df: DataFrame, label: str = "table", folder: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` once, if asked in one ``folder`` for each value of a column; a scan of the written table, and its path."""
    spark = df.sparkSession
    path = _fresh_path(spark, label)
    with freed_shuffles(spark):
        (df.write.partitionBy(folder) if folder else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    return materialized_at(df, label)[0]


def materialize_bucketed(df: DataFrame, keys: list[str], buckets: int, label: str = "table") -> DataFrame:
    """Write ``df`` bucketed and sorted on ``keys``: later joins on them shuffle only the other side."""
    spark = df.sparkSession
    name = f"ripplenet_{label}_{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1][1].append(name)
    with freed_shuffles(spark):
        (
            df.repartition(buckets, *keys)
            .write.format("parquet")
            .option("path", _fresh_path(spark, label))
            .bucketBy(buckets, *keys)
            .sortBy(*keys)
            .saveAsTable(name)
        )
    return spark.table(name)


def materialize_by(df: DataFrame, folder: str, label: str = "table") -> DataFrame:
    """Write ``df`` once in one folder for each value of ``folder``: a filter on it reads its folders only."""
    return materialized_at(df, label, folder)[0]


def read_columns(path: str, columns: Sequence[str]) -> pa.Table:
    """Columns of the Parquet files in a folder that an executor reads itself; no rows where the folder is missing."""
    files, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), re.sub("^file:", "", path))
    listed = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    parts = [pq.read_table(f.path, columns=list(columns), filesystem=files, use_threads=False) for f in listed if f.path.endswith(".parquet")]
    return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], pa.int64()) for c in columns})


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """The caller's parameters as a table: a local relation, known to the planner and free of Python tasks."""
    return spark.createDataFrame(pa.table({c: [row[i] for row in rows] for i, c in enumerate(columns)}))
