"""Tables written to the folder that the driver and all executors share.

Iterative plans and results that several later steps read are cut here. The
folder is the session's ``spark.checkpoint.dir``; only where that is unset and Spark runs
locally a folder of our own is made and removed at exit: on a cluster its executors would
not see it, so there the setting is demanded.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group, compressed: a task that writes holds one in memory, and one that reads another.
ROW_GROUP = 8 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The URI of the shared folder, without a trailing slash."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        path = tempfile.mkdtemp(prefix="tilesieve-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[app] = f"file://{path}"
    return _own[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tilesieve/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Unlike a persisted frame the copy outlives lost executors, and it freezes
    whatever in ``df`` depended on task order.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tilesieve_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_tilesieve_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file through Hadoop's file system API."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
