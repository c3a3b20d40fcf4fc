"""The manifest as CSV: reading compatible files leniently, writing the full set of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import identity as I
from attesta.functions import text as X
from attesta.operators.manifest import NAMES, as_columns

_LISTS = ("aliases", "authors", "target_files", "target_locators", "candidate_source_ids", "conflicts")


def encode(rows: DataFrame) -> DataFrame:
    """All columns as text: lists as compact JSON, then the columns that older readers expect."""
    wide = as_columns(rows)
    status = F.col("extraction_status")
    old = F.when(status.isin("extracted", "cached"), "ready").when(status.isin("missing", "unusable", "unknown", "not_run"), status).when(status.startswith("error:"), "unusable").otherwise("unknown")
    said = [X.json_list(c).alias(c) if c in _LISTS else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in wide.columns]
    later = {
        "zotero_item_key": F.lit(""), "zotero_attachment_key": F.lit(""), "canonical_pdf_path": F.col("source_path"), "section": F.array_join("target_locators", " | "), "source_manifests": F.lit(""),
        "pdf_status": old, "text_cache_path": F.col("cache_path"), "validation_status": F.lit("not_validated"), "pdf_sha256": F.col("source_sha256"), "zotero_status": F.lit("disabled"),
        "manifest_status": F.col("mapping_status"),
    }
    return wide.select(*said, *(v.alias(k) for k, v in later.items()))


def write(rows: DataFrame, path: str) -> None:
    """CSV files in a folder, in the order of the rows: a sort by range, so a large manifest is written by many tasks and a small one as one file."""
    encode(rows).write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").option("lineSep", "\n").csv(path)


def read(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Manifest rows of a CSV with any subset of the columns. folder: what relative source paths start from."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return parse(raw, folder)


def parse(raw: DataFrame, folder: str) -> DataFrame:
    def text(name: str, *older: str, default: str = ""):
        names = [n for n in (name, *older) if n in raw.columns]
        return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(default))

    path = text("source_path", "canonical_pdf_path")
    path = F.when(path == "", path).otherwise(I.local_path(path, F.lit(folder)))
    given = text("mapping_status", "manifest_status")
    found = raw.select(
        X.strip(text("source_id")).alias("source_id"), X.strip(text("provider")).alias("provider"), X.strip(text("bibliography_key")).alias("bibliography_key"), X.parse_list(text("aliases")).alias("aliases"),
        text("title").alias("title"), X.parse_list(text("authors")).alias("authors"), X.strip(text("year")).try_cast("int").alias("year"), text("doi").alias("doi"), path.alias("source_path"),
        text("media_type").alias("media_type"), text("source_sha256", "pdf_sha256").alias("source_sha256"),
        F.transform(F.arrays_zip(X.parse_list(text("target_files")).alias("file"), X.parse_list(text("target_locators")).alias("locator")), lambda p: F.struct(p["file"].alias("file"), p["locator"].alias("locator"))).alias("targets"),
        F.when(given != "", given).when(text("source_id") != "", "not-applicable").otherwise("unresolved").alias("mapping_status"), text("mapping_rule", default="none").alias("mapping_rule"),
        X.parse_list(text("candidate_source_ids")).alias("candidate_source_ids"), text("extraction_status", default="not_run").alias("extraction_status"), text("text_quality", default="unknown").alias("text_quality"),
        text("cache_path", "text_cache_path").alias("cache_path"), X.parse_list(text("conflicts")).alias("conflicts"), (X.strip(given) != "").alias("told"),
    )
    # a keyed row with a path but no id gets the id its record would have
    lost = (F.col("source_id") == "") & (F.col("source_path") != "") & (F.col("bibliography_key") != "")
    aliases = X.unique(F.transform(F.concat("aliases", F.array("bibliography_key")), X.clean))
    authors = I.normalize_authors("authors")
    made = I.source_identity(I.normalize_doi("doi"), X.clean("title"), authors, F.col("year"), aliases, F.array("source_path"))
    return found.select(
        *(
            {
                "source_id": F.when(lost, made).otherwise(F.col("source_id")),
                "aliases": F.when(lost, aliases).otherwise(F.col("aliases")),
                "mapping_status": F.when(lost & ~F.col("told"), "not-applicable").otherwise(F.col("mapping_status")),
                "mapping_rule": F.when(lost & ~F.col("told"), "explicit-corpus").otherwise(F.col("mapping_rule")),
            }
            .get(n, F.col(n))
            .alias(n)
            for n in NAMES
        )
    )


def sources_of(rows: DataFrame) -> DataFrame:
    """Source records of manifest rows that name a source."""
    files = F.when(F.col("source_path") != "", F.array("source_path")).otherwise(X.empty_array())
    provider = F.when(F.col("provider") != "", F.col("provider")).otherwise(F.lit("manifest"))
    return rows.filter("source_id <> ''").select("source_id", "aliases", "title", "authors", "year", "doi", F.lit("").alias("url"), files.alias("local_files"), provider.alias("provider"))
