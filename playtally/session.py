"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Runtime settings; safe to apply to a session that is already running.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A repeated member keeps its last value instead of failing the document.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark`` and return it."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new path that driver and executors share, below ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder and any other
    one a folder in the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = (spark.conf.get("spark.master", None) or "").startswith("local")
        root = _local_scratch() if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_playtally"
    return f"{root.rstrip('/')}/playtally-{label}-{uuid.uuid4().hex}"


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="spark-playtally-")


def local_session(cores: int | str = "*", **extra: str) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("playtally")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PLAYTALLY_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        # Small inputs with costly rows (JSON) should still use every core.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # Recording a call site for every expression costs more than planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**RUNTIME, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
