"""Report tables that are projections of other results: no score is composed and no verdict given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.sources.documents import analyzed, unusable

STATES = ("analyzed", "missing", "unusable", "not run")


def source_states(rows: DataFrame) -> DataFrame:
    """(state, n): manifest rows that name a source, by what became of its text; zeros included."""
    status, quality = F.col("extraction_status"), F.col("text_quality")
    state = F.when(status == "missing", "missing").when(unusable(status, quality), "unusable").when(status == "not_run", "not run").when(analyzed(status, quality), "analyzed")
    found = rows.filter("source_id <> ''").groupBy(state.alias("state")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return every.join(found, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def support_scorecard(measures: DataFrame, coverage: DataFrame) -> DataFrame:
    """(measure, numerator, denominator, value): six rows, value null where a measure is unavailable."""
    parts = [
        ("citation recall, whole scope", "supported", "eligible", "recall_whole"),
        ("citation precision, whole scope", "supporting_associations", "associations", "precision_whole"),
        ("citation recall, verified subset", "supported", "classifiable", "recall_verified"),
        ("citation precision, verified subset", "supporting_associations", "classifiable_associations", "precision_verified"),
        ("audit coverage", "classifiable", "eligible", "audit_coverage"),
    ]
    rows = [measures.select(F.lit(n).alias("measure"), F.col(a).alias("numerator"), F.col(b).alias("denominator"), F.col(v).alias("value")) for n, a, b, v in parts]
    rows.append(coverage.select(F.lit("corpus coverage"), "analyzed", "expected", "coverage"))
    return reduce(DataFrame.union, rows)
