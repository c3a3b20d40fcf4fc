"""A training corpus from `documents`: language, quality, near duplicates, repeated passages, packed windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
that docs has; the last returns the pieces of packed windows.

Defined results: an empty table goes through every stage and gives no piece; null and
empty texts leave at the first stage; rows with a null doc_id stay in the duplicates
stage; equal rows count as duplicates; further columns of documents are carried along,
whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import language, minhash, packing, quality, repeats
from attesta.llm.common import forget, free, named, read, written

#: Least mean, over a document's words, of a word's greatest posterior: one language is likelier than all others together. A text of
#: several languages can be sure of each word.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose words favour no language."""
    names = free(docs.columns, "att_lang", "att_score", "att_sure")
    found = language.languages(docs, language.fit(docs), keep=docs.columns, names=names)
    return found.filter((F.col(names[0]) != "und") & (F.col(names[2]) >= SURE)).select(*named(docs.columns))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score below the classifier's cut."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    (score,) = free(docs.columns, "att_score")
    return quality.qualities(docs, model, keep=docs.columns, name=score).filter(F.col(score) >= quality.CUT).select(*named(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each near-duplicate class."""
    found = minhash.near_duplicates(docs)
    att_id, node = free(docs.columns, "att_id", "att_node")
    first = written(found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(att_id)).distinct(), "kept")
    kept = docs.join(first.hint("merge"), docs["doc_id"].eqNullSafe(first[att_id]), "left_semi")
    return kept.withColumn(node, F.md5(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", node]).select(*named(docs.columns))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every byte under a repeated 200-byte string out of the texts; every document stays."""
    cleaned = repeats.remove_repeats(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*named(docs.columns))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into windows of 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("packing", pack_windows),
]

#: SQL expresses none of the stages; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
