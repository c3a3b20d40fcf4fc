"""Citation-support measures from claims and their citations.

claims(claim_id, eligible, has_citation[, joint]) and claim_citations(claim_id,
source_id, function, label). Labels are full, partial, none, contradicts and
unverifiable; joint is full, not_full or unverifiable and, where it is not given,
follows from the labels. No composite score is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("full", "partial", "none", "contradicts", "unverifiable")


def associations(citations: DataFrame) -> DataFrame:
    """One row for each claim, source and function."""
    return citations.groupBy("claim_id", "source_id", "function").agg(F.min("label").alias("label"))


def joint_support(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """claims with joint; a contradiction forbids full support, one full citation gives it, else unreadable evidence leaves it open."""
    has = lambda label: F.bool_or(F.col("label") == label)
    flags = associations(citations).groupBy("claim_id").agg(has("contradicts").alias("c"), has("full").alias("f"), has("unverifiable").alias("u"))
    derived = F.when(F.col("c"), "not_full").when(F.col("f"), "full").when(F.col("u"), "unverifiable").when(F.col("c").isNotNull(), "not_full")
    given = F.col("joint") if "joint" in claims.columns else F.lit(None).cast("string")
    return claims.join(flags, "claim_id", "left").withColumn("joint", F.coalesce(given, derived)).select("claim_id", "eligible", "has_citation", "joint")


def matrix(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """A row for each association with the claim's joint verdict, whether it counts and whether it supports."""
    judged = joint_support(claims, citations)
    both = associations(citations).join(judged, "claim_id")
    countable = (F.col("label") != "unverifiable") & (F.coalesce("joint", F.lit("")) != "unverifiable")
    supporting = (F.col("joint") == "full") & F.col("label").isin("full", "partial")
    return both.select("claim_id", "source_id", "function", "label", "joint", countable.alias("classifiable"), F.coalesce(supporting, F.lit(False)).alias("supporting"))


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))


def measures(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: recall and precision on the verified subset and on the whole scope, and audit coverage, each with its terms."""
    judged = joint_support(claims, citations).filter("eligible")
    open_ = F.col("has_citation") & (F.coalesce("joint", F.lit("")) == "unverifiable")
    full = F.col("has_citation") & (F.coalesce("joint", F.lit("")) == "full")
    c = judged.agg(F.count("*").alias("eligible"), _n(~open_).alias("classifiable"), _n(full & ~open_).alias("supported"))
    m = matrix(claims, citations)
    a = m.agg(F.count("*").alias("associations"), _n(F.col("classifiable")).alias("classifiable_associations"), _n(F.col("supporting") & F.col("classifiable")).alias("supporting_associations"))
    share = lambda n, d: F.round(F.try_divide(F.col(n), F.nullif(F.col(d), F.lit(0))), 4)
    return c.join(a, F.lit(True)).select(
        *c.columns, *a.columns,
        share("supported", "classifiable").alias("recall_verified"),
        share("supporting_associations", "classifiable_associations").alias("precision_verified"),
        F.when(F.col("classifiable") == F.col("eligible"), share("supported", "eligible")).alias("recall_whole"),
        F.when(F.col("classifiable_associations") == F.col("associations"), share("supporting_associations", "associations")).alias("precision_whole"),
        share("classifiable", "eligible").alias("audit_coverage"),
    )


def source_coverage(expected: DataFrame, claims: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: expected sources and those whose every dependent use can be classified."""
    uses = matrix(claims, citations).groupBy("source_id").agg(F.bool_and("classifiable").alias("usable"))
    both = expected.join(uses, "source_id", "left").withColumn("analyzed", F.col("readable") & F.coalesce("usable", F.lit(True)))
    one = both.agg(F.count("*").alias("expected"), _n(F.col("analyzed")).alias("analyzed"))
    return one.withColumn("coverage", F.round(F.try_divide(F.col("analyzed"), F.nullif(F.col("expected"), F.lit(0))), 4))


def diagnostics(claims: DataFrame, citations: DataFrame, expected: DataFrame) -> DataFrame:
    """(kind, n): separate counters, zeros included."""
    judged, m = joint_support(claims, citations), matrix(claims, citations)
    of = lambda df, kind, condition: df.agg(_n(condition).alias("n")).select(F.lit(kind).alias("kind"), "n")
    parts = [
        of(judged, "uncited claims", F.col("eligible") & ~F.col("has_citation")),
        of(judged, "claims not fully supported", F.col("eligible") & F.col("has_citation") & (F.col("joint") == "not_full")),
        of(judged, "claims left open", F.col("eligible") & F.col("has_citation") & (F.col("joint") == "unverifiable")),
        of(m, "contradicting citations", F.col("label") == "contradicts"),
        of(m, "citations without support", F.col("label") == "none"),
        of(m, "unverifiable citations", F.col("label") == "unverifiable"),
        of(expected, "unreadable sources", ~F.col("readable")),
        of(expected.join(m.select("source_id").distinct(), "source_id", "left_anti"), "sources never cited", F.lit(True)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def label_counts(citations: DataFrame) -> DataFrame:
    """(label, n) over all labels, zeros included."""
    every = citations.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    found = associations(citations).groupBy("label").agg(F.count("*").alias("n"))
    return every.join(found, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def missing_citations(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Eligible claims without any association."""
    return claims.filter("eligible").join(citations.select("claim_id").distinct(), "claim_id", "left_anti").select("claim_id")


def affected_claims(expected: DataFrame, citations: DataFrame) -> DataFrame:
    """(source_id, claims): sources that can't be read, with the claims that lean on them."""
    hit = expected.filter(~F.col("readable")).join(associations(citations), "source_id", "left")
    return hit.groupBy("source_id").agg(F.array_sort(F.collect_set("claim_id")).alias("claims"))
