"""Tables that cut lineage: written in the folder the cluster shares, and removed when they are no longer read."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session in spark.checkpoint.dir. Where none is set, a folder of our own, in local mode only."""
    context = spark.sparkContext
    known = getattr(context, "_attesta_folder", None)
    if known:
        return known
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="attesta-shared-")
    folder = context._attesta_folder = f"{base.rstrip('/')}/attesta-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, folder)
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df in the shared folder and read it back: later steps start from a table, not from everything before it."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.__dict__["_attesta_table"] = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Remove tables that stage() wrote, once nothing that is still to run reads them."""
    for table in tables:
        path = table.__dict__.pop("_attesta_table", None) if table is not None else None
        if path:
            remove(table.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder on any file system that Hadoop knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit(spark: SparkSession, folder: str) -> None:
    if folder.startswith(("/", "file:")):
        shutil.rmtree(folder.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    else:
        with contextlib.suppress(Exception):  # the session may have ended before
            remove(spark, folder)
