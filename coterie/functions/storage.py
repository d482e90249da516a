"""Shared scratch storage: cut lineage through files every executor can read.

Spark names the shared folder in ``spark.checkpoint.dir``.  It is read from the session; only where
it is unset and the session is local (tests on one machine) a temporary folder is chosen.
"""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this process wrote: path and, for a bucketed table, its name.
_OWN: dict[str, str | None] = {}
_SESSIONS: list[SparkSession] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder all executors share.  A session on a cluster has to name one; a local one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="coterie-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, table: str | None = None) -> str:
    """A fresh path below the shared folder, removed when the process ends."""
    path = f"{scratch_root(spark)}/coterie-{uuid.uuid4().hex}"
    if not _SESSIONS:
        atexit.register(clear_scratch)
    _SESSIONS[:] = [spark]
    _OWN[path] = table
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (survives lost executors)."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, buckets: int, key: str) -> DataFrame:
    """Like :func:`materialize`, in buckets of ``key``, so that joins on it leave the rows where they are."""
    spark, name = df.sparkSession, "coterie_" + uuid.uuid4().hex
    df.write.bucketBy(buckets, key).option("path", scratch_path(spark, name)).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def drop_path(spark: SparkSession, path: str) -> None:
    if table := _OWN.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`materialize` once nothing reads them any more."""
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        own = [p for p in _OWN if p.split(":", 1)[-1].lstrip("/") == name.split(":", 1)[-1].lstrip("/")]
        drop_path(df.sparkSession, own[0] if own else name)


def scratch_paths() -> set[str]:
    """What is there now, to tell later what was added since."""
    return set(_OWN)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished jobs now, not at the driver's next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear_scratch() -> None:
    """Remove everything this process wrote."""
    for path in list(_OWN):
        try:
            drop_path(_SESSIONS[0], path)
        except Exception:  # the session has ended already; the folder's owner cleans up
            return
