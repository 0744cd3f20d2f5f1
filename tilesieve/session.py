"""Session defaults used by the command line, the tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | None = None, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and small runs; a cluster brings its own."""
    cores = cores or os.cpu_count() or 1
    conf = DEFAULTS | {
        "spark.master": f"local[{cores}]",
        "spark.sql.shuffle.partitions": str(max(2, cores)),
        "spark.driver.memory": memory,
    }
    spark = SparkSession.builder.config(map=conf | extra).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
