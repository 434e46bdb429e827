"""Session defaults used by the tests, the bench and local runs."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session with adaptive execution on; a cluster brings its own session instead.

    Intermediate tables and the warehouse lie in one folder that goes when the process ends.
    """
    scratch = tempfile.TemporaryDirectory(prefix="ripplenet-", ignore_cleanup_errors=True)
    atexit.register(scratch.cleanup)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ripplenet")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", scratch.name)
        .config("spark.sql.warehouse.dir", f"{scratch.name}/warehouse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
