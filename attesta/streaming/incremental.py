"""Extraction as a stream: new or changed files of a folder are extracted as they arrive.

The stream reads files with the binaryFile source; each micro-batch anti-joins the
cache on (source, content hash), extracts what is missing and replaces those entries.
The cache is the state, so a restart or a replayed batch writes nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.functions import text as X
from attesta.operators import cache as K
from attesta.sources import documents as D

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Stream of (path, sha256, media_type, content, arrived)."""
    raw = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    found = raw.select(D.local(F.col("path")).alias("path"), "content", F.col("modificationTime").alias("arrived")).filter(X.supported("path"))
    return found.select("path", F.sha2("content", 256).alias("sha256"), X.media_type("path").alias("media_type"), "content", "arrived")


def update_cache(batch: DataFrame, cache_dir: str) -> None:
    """Bring the cache up to date with a batch of files; a source is known by its path."""
    held = f"{cache_dir.rstrip('/')}/entries"
    cached = K.read(batch.sparkSession, held)
    now = batch.withColumn("source_id", F.col("path"))
    fresh = K.misses(now, K.validity(cached)).select("path", "sha256", "media_type", "content")
    done = D.extract(fresh, "source").withColumn("source_id", F.col("path")).filter(~F.col("extraction_status").startswith("error:"))
    done = done.withColumn("file", X.cache_name("source_id", "path")).persist()
    if not done.isEmpty():
        K.write(K.records(done, "file"), held)
    done.unpersist()


def follow(spark: SparkSession, folder: str, cache_dir: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start the stream; once: take all files that are there and stop."""
    stream = files(spark, folder).writeStream.foreachBatch(lambda batch, _: update_cache(batch, cache_dir)).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def arrivals(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, media_type, n): files by event time, with a watermark for late ones."""
    return stream.withWatermark("arrived", late).groupBy(F.window("arrived", window), "media_type").agg(F.count("*").alias("n"))
