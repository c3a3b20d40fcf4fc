"""Similarity over `documents` as targets and `benchmark` as sources, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import similarity as S

from .tables import read


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, their word counts, and candidate matches."""
    docs, sources = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    matches = S.candidates(S.shingles(docs, "doc_id", "text"), S.shingles(sources, "item_id", "text"))
    return docs, S.word_counts(docs, "doc_id", "text"), matches


def _adjusted(words: DataFrame, matches: DataFrame) -> DataFrame:
    """Raw and adjusted similarity. Gone are the first ten words of even documents, and every relation to each seventh source."""
    gone = words.withColumns({"first": F.lit(1), "last": F.when((F.col("doc") % 2 == 0) & (F.col("n_words") >= 10), 10).otherwise(0)}).select("doc", "first", "last")
    fewer, marked = S.exclude_words(gone, words, matches.withColumn("adjusted", F.col("source") % 7 != 0))
    return S.overall_where(marked, fewer, adjusted="adjusted_words")


def _types(matches: DataFrame) -> DataFrame:
    return matches.withColumn("match_type", F.get(F.array(*map(F.lit, S.MATCH_TYPES)), (F.col("source") % 4).cast("int")))


def _passages(matches: DataFrame) -> DataFrame:
    return S.passages(matches, ["doc", "block", "source"])


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source"), (F.col("item_id") % 5 != 0).alias("analyzed"))


def sim_overall(spark, sf_dir):
    docs, sources = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    runs = S.covered(S.shingles(docs, "doc_id", "text"), S.shingles(sources, "item_id", "text"))
    return S.overall_of_runs(runs, S.word_counts(docs, "doc_id", "text"))


def sim_per_source(spark, sf_dir):
    _, words, matches = _parts(spark, sf_dir)
    return S.by_key(matches, words, "source")


def sim_match_type(spark, sf_dir):
    _, words, matches = _parts(spark, sf_dir)
    return S.zero_filled(S.by_key(_types(matches), words, "match_type"), words, "match_type", S.MATCH_TYPES, "matched")


def sim_raw_adjusted(spark, sf_dir):
    _, words, matches = _parts(spark, sf_dir)
    return _adjusted(words, matches)


def sim_passages(spark, sf_dir):
    return _passages(_parts(spark, sf_dir)[2])


def sim_blocks(spark, sf_dir):
    found = _passages(_parts(spark, sf_dir)[2])
    return found.groupBy("doc").agg(F.count_distinct("block").alias("n_blocks"), F.count("*").alias("n_passages"))


def sim_attribution(spark, sf_dir):
    _, words, matches = _parts(spark, sf_dir)
    group = S.attribution_group(F.col("block") % 2 == 0, F.col("source") % 3 == 0)
    found = _passages(matches).withColumn("grp", group).groupBy("doc", "grp").agg(F.count("*").alias("n_passages"), F.sum("n_words").alias("matched"))
    return S.zero_filled(found, words, "grp", S.GROUPS, "n_passages", "matched")


def sim_coverage(spark, sf_dir):
    return S.corpus_coverage(_expected(spark, sf_dir))


def sim_scorecard(spark, sf_dir):
    _, words, matches = _parts(spark, sf_dir)
    return S.scorecard(_adjusted(words, matches), S.corpus_coverage(_expected(spark, sf_dir)))


def _judged(matches: DataFrame) -> DataFrame:
    """Whether someone verified a match: a judgement of the sample, by target and source."""
    return matches.withColumn("verified", (F.col("doc") + F.col("source")) % 3 != 0)


def sim_unverified(spark, sf_dir):
    """Candidates by whether they were verified; those that were not are out of every measure and are listed by target and source."""
    found = S.passages(_judged(_parts(spark, sf_dir)[2]), ["doc", "block", "source", "verified"])
    return found.groupBy("doc", "source", "verified").agg(F.count("*").alias("n_candidates"), F.sum("n_words").alias("n_words"))


def sim_verified(spark, sf_dir):
    """Overall similarity of verified matches beside that of all."""
    _, words, matches = _parts(spark, sf_dir)
    return S.overall_where(_judged(matches), words, verified="n_words")


def sim_evidence(spark, sf_dir):
    """Every passage with the lines it stands in."""
    docs, sources = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return S.evidence(S.spans(S.shingles(docs, "doc_id", "text"), S.shingles(sources, "item_id", "text")), docs, sources)


def sim_inaccessible(spark, sf_dir):
    return _expected(spark, sf_dir).filter("not analyzed").select("source")


def sim_source_results(spark, sf_dir):
    """Source-level results: every analysed source, matched or not, with its targets and positions."""
    _, _, matches = _parts(spark, sf_dir)
    hit = matches.groupBy("source").agg(F.count_distinct("doc").alias("n_targets"), F.count_distinct("doc", "pos").alias("matched"))
    found = _expected(spark, sf_dir).filter("analyzed").select("source").join(hit, "source", "left")
    return found.select("source", F.coalesce("n_targets", F.lit(0)).alias("n_targets"), F.coalesce("matched", F.lit(0)).alias("matched"))


def text_tokens(spark, sf_dir):
    found = S.tokens(read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("doc").agg(F.count("*").alias("n"), F.max("pos").cast("bigint").alias("last"), F.count_distinct("token").alias("n_distinct"))


def _shingle_sql(prefix: str, table: str, key: str) -> str:
    return f"""{prefix}l AS (SELECT {key} AS doc, generate_subscripts(l, 1) AS block, regexp_extract_all(lower(unnest(l)), '[\\p{{L}}\\p{{N}}_]+') AS t
  FROM (SELECT {key}, string_split(coalesce(text, ''), chr(10)) AS l FROM {table})),
{prefix}p AS (SELECT doc, block, t, coalesce(sum(len(t)) OVER (PARTITION BY doc ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM {prefix}l),
{prefix}s AS (SELECT doc, block, base + p AS pos, array_to_string(t[p:p+3], ' ') AS gram FROM (SELECT doc, block, base, t, unnest(range(1, len(t) - 2)) AS p FROM {prefix}p WHERE len(t) >= 4))"""


_BASE = f"""WITH {_shingle_sql("d", "documents", "doc_id")},
{_shingle_sql("b", "benchmark", "item_id")},
w AS (SELECT doc, CAST(sum(len(t)) AS BIGINT) AS n_words FROM dl GROUP BY doc),
m AS (SELECT DISTINCT d.doc, d.block, CAST(d.pos + k AS BIGINT) AS pos, s.doc AS source, CAST(s.pos + k AS BIGINT) AS source_pos FROM ds d JOIN bs s USING (gram), (SELECT unnest([0, 1, 2, 3]) AS k)),
islands AS (SELECT *, pos - source_pos AS shift, pos - row_number() OVER (PARTITION BY doc, block, source, pos - source_pos ORDER BY pos) AS island FROM m),
passages AS (SELECT doc, block, source, min(pos) AS first, max(pos) AS last, min(source_pos) AS source_first, count(*) AS n_words FROM islands GROUP BY doc, block, source, shift, island)"""
_OVERALL = """SELECT w.doc, n_words, coalesce(c, 0) AS matched, round(100.0 * coalesce(c, 0) / nullif(n_words, 0), 4) AS similarity
FROM w LEFT JOIN (SELECT doc, count(DISTINCT pos) AS c FROM {m} GROUP BY doc) h USING (doc)"""
_FEWER = """fw AS (SELECT doc, n_words - CASE WHEN doc % 2 = 0 AND n_words >= 10 THEN 10 ELSE 0 END AS n_words FROM w),
fm AS (SELECT m.* FROM m JOIN w USING (doc) WHERE source % 7 <> 0 AND NOT (doc % 2 = 0 AND n_words >= 10 AND pos <= 10)),
raw AS (""" + _OVERALL.format(m="m") + """),
adj AS (SELECT fw.doc, n_words AS adjusted_words, coalesce(c, 0) AS adjusted_matched, round(100.0 * coalesce(c, 0) / nullif(n_words, 0), 4) AS adjusted
  FROM fw LEFT JOIN (SELECT doc, count(DISTINCT pos) AS c FROM fm GROUP BY doc) h USING (doc))"""  # fmt: skip
_TYPES = "unnest(['" + "', '".join(S.MATCH_TYPES) + "'])"
_GROUPS = "unnest(['" + "', '".join(S.GROUPS) + "'])"
_COVERAGE = "SELECT count(*) AS expected, CAST(sum(CASE WHEN item_id % 5 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS analyzed, round(100.0 * sum(CASE WHEN item_id % 5 <> 0 THEN 1 ELSE 0 END) / nullif(count(*), 0), 4) AS coverage FROM benchmark"

SQL = {
    "sim_overall": f"{_BASE} {_OVERALL.format(m='m')}",
    "sim_verified": f"""{_BASE} SELECT w.doc, n_words, coalesce(c, 0) AS matched, round(100.0 * coalesce(c, 0) / nullif(n_words, 0), 4) AS similarity, n_words AS verified_words, coalesce(v, 0) AS verified_matched,
round(100.0 * coalesce(v, 0) / nullif(n_words, 0), 4) AS verified FROM w LEFT JOIN (SELECT doc, count(DISTINCT pos) AS c, count(DISTINCT CASE WHEN (doc + source) % 3 <> 0 THEN pos END) AS v FROM m GROUP BY doc) h USING (doc)""",
    "sim_evidence": f"""{_BASE}, tl AS (SELECT doc_id AS doc, generate_subscripts(l, 1) AS block, unnest(l) AS target_text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
sl AS (SELECT item_id AS source, generate_subscripts(l, 1) AS source_block, unnest(l) AS source_text FROM (SELECT item_id, string_split(coalesce(text, ''), chr(10)) AS l FROM benchmark)),
mb AS (SELECT DISTINCT d.doc, d.block, CAST(d.pos + k AS BIGINT) AS pos, s.doc AS source, s.block AS source_block, CAST(s.pos + k AS BIGINT) AS source_pos FROM ds d JOIN bs s USING (gram), (SELECT unnest([0, 1, 2, 3]) AS k)),
ib AS (SELECT *, pos - source_pos AS shift, pos - row_number() OVER (PARTITION BY doc, block, source, source_block, pos - source_pos ORDER BY pos) AS island FROM mb),
e AS (SELECT doc, block, source, source_block, min(pos) AS first, max(pos) AS last, min(source_pos) AS source_first FROM ib GROUP BY doc, block, source, source_block, shift, island)
SELECT doc, block, source, source_block, first, last, source_first, 'line:' || block AS target_locator, 'line:' || source_block AS source_locator, target_text, source_text FROM e JOIN tl USING (doc, block) JOIN sl USING (source, source_block)""",
    "sim_per_source": f"{_BASE} SELECT doc, source, count(DISTINCT pos) AS matched, round(100.0 * count(DISTINCT pos) / nullif(any_value(n_words), 0), 4) AS similarity FROM m JOIN w USING (doc) GROUP BY doc, source",
    "sim_match_type": f"""{_BASE}, typed AS (SELECT doc, (['{"', '".join(S.MATCH_TYPES)}'])[source % 4 + 1] AS match_type, count(DISTINCT pos) AS c FROM m GROUP BY 1, 2)
SELECT e.doc, e.match_type, coalesce(c, 0) AS matched FROM (SELECT doc, {_TYPES} AS match_type FROM w) e LEFT JOIN typed USING (doc, match_type)""",
    "sim_raw_adjusted": f"{_BASE}, {_FEWER} SELECT * FROM raw JOIN adj USING (doc)",
    "sim_passages": f"{_BASE} SELECT doc, block, source, first, last, source_first, n_words FROM passages",
    "sim_blocks": f"{_BASE} SELECT doc, count(DISTINCT block) AS n_blocks, count(*) AS n_passages FROM passages GROUP BY doc",
    "sim_attribution": f"""{_BASE}, g AS (SELECT doc, CASE WHEN block % 2 = 0 AND source % 3 = 0 THEN '{S.GROUPS[0]}' WHEN block % 2 = 0 THEN '{S.GROUPS[1]}' WHEN source % 3 = 0 THEN '{S.GROUPS[2]}' ELSE '{S.GROUPS[3]}' END AS grp, n_words FROM passages),
a AS (SELECT doc, grp, count(*) AS n_passages, CAST(sum(n_words) AS BIGINT) AS matched FROM g GROUP BY doc, grp)
SELECT e.doc, e.grp, coalesce(n_passages, 0) AS n_passages, coalesce(matched, 0) AS matched FROM (SELECT doc, {_GROUPS} AS grp FROM w) e LEFT JOIN a USING (doc, grp)""",
    "sim_coverage": _COVERAGE,
    "sim_scorecard": f"""{_BASE}, {_FEWER}, cov AS ({_COVERAGE}), j AS (SELECT *, analyzed = 0 OR n_words = 0 AS nil, expected > 0 AND analyzed = expected AS whole FROM raw JOIN adj USING (doc), cov)
SELECT doc, n_words, matched, CASE WHEN NOT nil THEN similarity END AS raw, adjusted_words, adjusted_matched, CASE WHEN NOT nil THEN adjusted END AS adjusted, expected, analyzed, coverage,
CASE WHEN whole THEN 'Complete' ELSE 'Partial' END AS label, CASE WHEN whole THEN 'Overall similarity' ELSE 'Observed overall similarity' END AS metric,
CASE WHEN nil THEN NULL WHEN similarity < 15 THEN 'Low' WHEN similarity <= 40 THEN 'Medium' ELSE 'High' END AS band,
CASE WHEN n_words = 0 THEN 'stop' WHEN analyzed = 0 THEN 'diagnostic' WHEN whole THEN 'complete' ELSE 'partial' END AS route FROM j""",
    "sim_unverified": f"{_BASE} SELECT doc, source, (doc + source) % 3 <> 0 AS verified, count(*) AS n_candidates, CAST(sum(n_words) AS BIGINT) AS n_words FROM passages GROUP BY doc, source",
    "sim_inaccessible": "SELECT item_id AS source FROM benchmark WHERE item_id % 5 = 0",
    "sim_source_results": f"""{_BASE}, h AS (SELECT source, count(DISTINCT doc) AS n_targets, count(DISTINCT (doc, pos)) AS matched FROM m GROUP BY source)
SELECT item_id AS source, coalesce(n_targets, 0) AS n_targets, coalesce(matched, 0) AS matched FROM benchmark LEFT JOIN h ON source = item_id WHERE item_id % 5 <> 0""",
    "text_tokens": f"WITH {_shingle_sql('d', 'documents', 'doc_id')} SELECT doc, count(*) AS n, count(*) AS last, count(DISTINCT x) AS n_distinct FROM (SELECT doc, unnest(t) AS x FROM dl) GROUP BY doc",
}
QUERIES = {name: globals()[name] for name in SQL}
