"""Incremental text cache: blocks of extracted sources, reused while source and content hash are the same.

The cache is a table of block rows (CACHE) with the safe file name of their source,
kept as JSON lines in BUCKETS folders by the hash of that name, so a corpus of millions
of sources is a few hundred folders. Only sources without a valid, equal entry are
extracted again; a dynamic partition overwrite replaces just the buckets they are in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.scratch import exists, forget, stage

VERSION, BUCKETS = "3", 256
# The columns of a cache line.
CACHE = (
    "block_count int, cache_schema_version string, document_hash string, document_id string, source_id string, extraction_method string, extraction_status string, "
    "text_quality string, record_type string, block_index int, block_id string, text_original string, text_normalized string, locator_type string, locator_value string"
)
_COLUMNS = [c.split()[0] for c in CACHE.split(", ")]


def records(parsed: DataFrame, *keep: str) -> DataFrame:
    """Cache rows of extracted sources (with source_id); a document without blocks has one metadata row. keep: further columns to carry along."""
    none = F.array(F.struct(F.lit("document-empty").alias("block_id"), F.lit("").alias("text_original"), F.lit("document").alias("locator_type"), F.lit("whole").alias("locator_value"), F.lit("").alias("heading")))
    some = F.size("blocks") > 0
    each = parsed.select("*", F.posexplode(F.when(some, F.col("blocks")).otherwise(none)).alias("i", "b"))
    rows = each.select(
        F.greatest(F.size("blocks"), F.lit(1)).alias("block_count"), F.lit(VERSION).alias("cache_schema_version"), F.col("sha256").alias("document_hash"), "document_id", "source_id",
        "extraction_method", "extraction_status", "text_quality", F.when(F.size("blocks") > 0, "block").otherwise("document-metadata").alias("record_type"), (F.col("i") + 1).alias("block_index"),
        "b.block_id", "b.text_original", *keep, X.normalize_text("b.text_original").alias("text_normalized"), "b.locator_type", "b.locator_value",
    )
    return rows.select(*_COLUMNS, *keep)


def validity(cache: DataFrame, by: str = "file") -> DataFrame:
    """(file, valid, source_id, document_hash, extraction_status, text_quality): whether the rows of each file make one whole entry."""
    n = F.count("*")
    one = lambda *names: F.count_distinct(F.struct(*names)) == 1
    filled = F.bool_and(F.coalesce(~X.blank("locator_type") & ~X.blank("locator_value"), F.lit(False)))
    whole = F.lit(True)
    for c in _COLUMNS:
        whole = whole & F.col(c).isNotNull()
    indexes = (F.min("block_index") == 1) & (F.max("block_index") == n) & (F.count_distinct("block_index") == n)
    valid = (
        F.bool_and(whole) & filled & indexes & (F.count_distinct("block_id") == n) & (F.min("block_count") == n) & (F.max("block_count") == n)
        & F.bool_and(F.col("cache_schema_version") == VERSION) & one("source_id", "document_hash", "document_id") & one("extraction_method", "extraction_status", "text_quality")
    )
    return cache.groupBy(by).agg(F.coalesce(valid, F.lit(False)).alias("valid"), *(F.min(c).alias(c) for c in ("source_id", "document_hash", "extraction_status", "text_quality")))


def plan(current: DataFrame, valid: DataFrame, force: bool = False) -> DataFrame:
    """current (source_id, sha256, ...) with reused, and the cached status where it is."""
    held = valid.filter("valid").select("source_id", F.col("document_hash").alias("sha256"), F.col("extraction_status").alias("old_status"), F.col("text_quality").alias("old_quality")).dropDuplicates(["source_id", "sha256"])
    return current.join(held, ["source_id", "sha256"], "left").withColumn("reused", F.col("old_status").isNotNull() & ~F.lit(force))


def misses(current: DataFrame, valid: DataFrame, force: bool = False) -> DataFrame:
    """The rows of current that must be extracted."""
    return current if force else current.join(valid.filter("valid").select("source_id", F.col("document_hash").alias("sha256")), ["source_id", "sha256"], "left_anti")


def _bucket(file: Column | str) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(BUCKETS)).cast("int")


def place(folder: str, file: Column) -> Column:
    """Where the entry of a source is: its bucket and its name in it."""
    return F.concat(F.lit(f"{folder}/bucket="), _bucket(file).cast("string"), F.lit("#"), file)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The cache table with `file`, empty where there is none yet. A broken line gives a row of nulls, so its entry has a line too few."""
    schema = CACHE + ", file string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", bucket int").option("mode", "PERMISSIVE").json(path).drop("bucket")


def write(rows: DataFrame, path: str) -> None:
    """Replace the entries (by `file`) that rows have and leave all others."""
    spark = rows.sparkSession
    fresh = stage(rows.withColumn("bucket", _bucket("file")), "fresh")
    if exists(spark, path):
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS at most
        held = spark.read.schema(CACHE + ", file string, bucket int").json(path).filter(F.col("bucket").isin(touched) & F.col("file").isNotNull())
        kept = held.join(fresh.select("file").distinct(), "file", "left_anti").select(fresh.columns)
        whole = stage(fresh.union(kept), "whole")
        forget(fresh)
    else:
        whole = fresh
    out = whole.repartition("bucket").sortWithinPartitions("bucket", "file", "block_index")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").json(path)
    forget(whole)
