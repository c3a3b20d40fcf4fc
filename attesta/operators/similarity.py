"""Source-bounded textual similarity over token positions.

A document is blocks; a block is word tokens with a position in the document. Shared
n-grams of tokens inside blocks propose matches; a match relates one target position
to one source. Judgements (verified, match type, attribution) are columns of the
match table. Every measure is a count of distinct positions over a count of analysable
words; filters come before the union, so a position stays while any kept relation
covers it. Zero denominators give null.

Shingle joins are equi-joins on a 64-bit hash and the n-gram itself. No side is
forced: Catalyst broadcasts the sources when they are small and shuffles on the hash
otherwise, and AQE splits hot shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as X

WORDS = r"[\p{L}\p{N}_]+"
WORDS_HYPHEN = r"(?U)\b[\w'-]+\b"
WORDS_ASCII = r"[A-Za-z]+(?:'[A-Za-z]+)*|[0-9]+"
MATCH_TYPES = ("Identical Match", "Minor Changes", "Paraphrase", "Translation")
GROUPS = ("cited and quoted", "cited only", "quoted only", "neither")


def tokens(docs: DataFrame, id_col: str, text_col: str, pattern: str = WORDS) -> DataFrame:
    """(doc, block, pos, token): blocks are lines; positions count from 1 through the whole document."""
    words = lambda line: F.regexp_extract_all(F.lower(line), F.lit(pattern), F.lit(0))
    block = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("i", "line"))
    block = block.select("doc", (F.col("i") + 1).alias("block"), words(F.col("line")).alias("t"))
    before = F.coalesce(F.sum(F.size("t")).over(Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return block.withColumn("before", before).select("doc", "block", "before", F.posexplode("t").alias("k", "token")).select("doc", "block", (F.col("before") + F.col("k") + 1).alias("pos"), "token")


def shingles(docs: DataFrame, id_col: str, text_col: str, n: int = 4, pattern: str = WORDS) -> DataFrame:
    """(doc, block, pos, h, gram): the n-grams inside each line, by their first position in the document. One pass over each text, without a shuffle."""
    lines = F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda s: F.regexp_extract_all(F.lower(s), F.lit(pattern), F.lit(0)))
    split = docs.select(F.col(id_col).alias("doc"), lines.alias("lines"))
    placed = F.zip_with(X.before(F.transform("lines", F.size)), "lines", lambda at, t: F.struct(at.alias("at"), t.alias("t")))
    block = split.select("doc", F.posexplode(placed).alias("b", "line")).filter(F.size("line.t") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("line.t") - (n - 1)), lambda k: F.array_join(F.slice(F.col("line.t"), k, n), " "))
    gram = block.select("doc", (F.col("b") + 1).cast("bigint").alias("block"), F.col("line.at").alias("at"), F.posexplode(grams).alias("k", "gram"))
    return gram.select("doc", "block", (F.col("at") + F.col("k") + 1).cast("bigint").alias("pos"), F.xxhash64("gram").alias("h"), "gram")


def word_counts(docs: DataFrame, id_col: str, text_col: str, pattern: str = WORDS) -> DataFrame:
    """(doc, n_words): analysable words of each document."""
    return docs.select(F.col(id_col).alias("doc"), F.size(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(pattern), F.lit(0))).cast("bigint").alias("n_words"))


SPAN = ("doc", "block", "source", "source_block")


def spans(targets: DataFrame, sources: DataFrame, n: int = 4) -> DataFrame:
    """(doc, block, source, source_block, first, last, source_first): runs of words that a target and a source block share at one distance.

    Inputs are shingles(). Shared n-grams that overlap or adjoin are merged before
    their positions are listed, so a long passage is one row.
    """
    right = sources.select(F.col("doc").alias("source"), F.col("block").alias("source_block"), F.col("pos").alias("source_at"), "h", "gram")
    hit = targets.join(right, ["h", "gram"]).select(*SPAN, "pos", (F.col("pos") - F.col("source_at")).alias("shift"))
    line = Window.partitionBy(*SPAN, "shift").orderBy("pos")
    fresh = F.coalesce(F.col("pos") - F.lag("pos").over(line) > n, F.lit(True)).cast("int")
    island = hit.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(line))
    runs = island.groupBy(*SPAN, "shift", "island").agg(F.min("pos").alias("first"), (F.max("pos") + n - 1).alias("last"))
    return runs.select(*SPAN, "first", "last", (F.col("first") - F.col("shift")).alias("source_first"))


def covered(targets: DataFrame, sources: DataFrame, n: int = 4) -> DataFrame:
    """(doc, block, first, last): runs of target words that some source shares. A target n-gram is one row however many sources hold it."""
    some = sources.select("h", "gram").distinct()
    hit = targets.join(some, ["h", "gram"], "left_semi").select("doc", "block", "pos")
    line = Window.partitionBy("doc", "block").orderBy("pos")
    fresh = F.coalesce(F.col("pos") - F.lag("pos").over(line) > n, F.lit(True)).cast("int")
    island = hit.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(line))
    return island.groupBy("doc", "block", "island").agg(F.min("pos").alias("first"), (F.max("pos") + n - 1).alias("last")).drop("island")


def overall_of_runs(runs: DataFrame, words: DataFrame) -> DataFrame:
    """overall() from disjoint runs (doc, first, last)."""
    hit = runs.groupBy("doc").agg(F.sum(F.col("last") - F.col("first") + 1).alias("matched"))
    both = words.join(hit, "doc", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return both.select("doc", "n_words", "matched", ratio(F.col("matched"), F.nullif("n_words", F.lit(0))).alias("similarity"))


def candidates(targets: DataFrame, sources: DataFrame, n: int = 4) -> DataFrame:
    """(doc, block, pos, source, source_block, source_pos): each position of each n-gram that target and source share. Inputs are shingles()."""
    found = spans(targets, sources, n)
    each = found.select(*SPAN, "first", "source_first", F.explode(F.sequence("first", "last")).alias("pos"))
    return each.select("doc", "block", "pos", "source", "source_block", (F.col("source_first") + F.col("pos") - F.col("first")).alias("source_pos"))


def ratio(n: Column, d: Column) -> Column:
    return F.round(100.0 * F.try_divide(n, d), 4)


def overall(matches: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, n_words, matched, similarity) of every document."""
    hit = matches.select("doc", "pos").distinct().groupBy("doc").agg(F.count("*").alias("matched"))
    both = words.join(hit, "doc", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return both.select("doc", "n_words", "matched", ratio(F.col("matched"), F.nullif("n_words", F.lit(0))).alias("similarity"))


def overall_where(matches: DataFrame, words: DataFrame, **kept: str) -> DataFrame:
    """overall(), and for each name in kept the same over the matches whose flag column of that name holds, in one pass.

    kept: name of the flag column to the column of words that is its denominator.
    Adds (name_words, name_matched, name) for each.
    """
    at = matches.groupBy("doc", "pos").agg(*(F.max(k).alias(k) for k in kept))
    hit = at.groupBy("doc").agg(F.count("*").alias("matched"), *(F.sum(F.col(k).cast("bigint")).alias(f"{k}_matched") for k in kept))
    both = words.join(hit, "doc", "left").fillna(0, ["matched", *(f"{k}_matched" for k in kept)])
    share = lambda hits, of: ratio(F.col(hits), F.nullif(of, F.lit(0)))
    more = [c for k, n in kept.items() for c in (F.col(n).alias(f"{k}_words"), f"{k}_matched", share(f"{k}_matched", n).alias(k))]
    return both.select("doc", "n_words", "matched", share("matched", "n_words").alias("similarity"), *more)


def by_key(matches: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(doc, key, matched, similarity): distinct positions by source or match type, over the same denominator."""
    hit = matches.select("doc", key, "pos").distinct().groupBy("doc", key).agg(F.count("*").alias("matched"))
    return hit.join(words, "doc").select("doc", key, "matched", ratio(F.col("matched"), F.nullif("n_words", F.lit(0))).alias("similarity"))


def zero_filled(found: DataFrame, docs: DataFrame, key: str, domain: tuple[str, ...], *values: str) -> DataFrame:
    """A row for every document and value of a short domain, zeros where nothing was found."""
    every = docs.select("doc").withColumn(key, F.explode(F.array(*map(F.lit, domain))))
    joined = every.join(found.select("doc", key, *values), ["doc", key], "left")
    return joined.select("doc", key, *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def exclude_words(gone: DataFrame, words: DataFrame, matches: DataFrame, kept: str = "adjusted") -> tuple[DataFrame, DataFrame]:
    """Mark what is left when target spans (doc, first, last; disjoint in a document) go: words with the smaller count, `kept_words`, and matches with a flag `kept`.

    A flag column of that name in matches, for relations that go as a whole, is kept to.
    """
    spans = gone.groupBy("doc").agg(F.sum(F.col("last") - F.col("first") + 1).alias("gone"), F.collect_list(F.struct("first", "last")).alias("spans"))
    fewer = words.join(spans.select("doc", "gone"), "doc", "left").select("doc", "n_words", (F.col("n_words") - F.coalesce("gone", F.lit(0))).alias(f"{kept}_words"))
    inside = F.coalesce(F.exists("spans", lambda s: F.col("pos").between(s["first"], s["last"])), F.lit(False))
    whole = F.col(kept) if kept in matches.columns else F.lit(True)
    return fewer, matches.join(spans.select("doc", "spans"), "doc", "left").withColumn(kept, whole & ~inside).drop("spans")


def passages(matches: DataFrame, key: list[str]) -> DataFrame:
    """Runs of adjoining positions within a key that keep one distance to the source: first, last and length."""
    base = matches.select(*key, "pos", "source_pos").distinct().withColumn("shift", F.col("pos") - F.col("source_pos"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*key, "shift").orderBy("pos"))
    runs = base.withColumn("island", island).groupBy(*key, "shift", "island")
    return runs.agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("source_pos").alias("source_first"), F.count("*").alias("n_words")).drop("island", "shift")


def evidence(found: DataFrame, docs: DataFrame, sources: DataFrame, id_col: str = "doc_id", source_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Passages of spans() with what a reader needs to check them: the line and the text of it on either side."""

    def lines(of: DataFrame, key: str, name: str, place: str, side: str) -> DataFrame:
        each = of.select(F.col(key).alias(name), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("i", f"{side}_text"))
        return each.select(name, (F.col("i") + 1).cast("bigint").alias(place), f"{side}_text")

    shown = found.join(lines(docs, id_col, "doc", "block", "target"), ["doc", "block"]).join(lines(sources, source_id, "source", "source_block", "source"), ["source", "source_block"])
    locator = lambda c: F.concat(F.lit("line:"), F.col(c).cast("string"))
    return shown.select(*SPAN, "first", "last", "source_first", locator("block").alias("target_locator"), locator("source_block").alias("source_locator"), "target_text", "source_text")


def attribution_group(cited: Column, quoted: Column) -> Column:
    return F.when(cited & quoted, GROUPS[0]).when(cited, GROUPS[1]).when(quoted, GROUPS[2]).otherwise(GROUPS[3])


def corpus_coverage(expected: DataFrame) -> DataFrame:
    """One row of (expected, analyzed, coverage) from (source, analyzed)."""
    one = expected.agg(F.count("*").alias("expected"), F.coalesce(F.sum(F.col("analyzed").cast("bigint")), F.lit(0)).alias("analyzed"))
    return one.withColumn("coverage", ratio(F.col("analyzed"), F.nullif("expected", F.lit(0))))


def scorecard(measured: DataFrame, coverage: DataFrame) -> DataFrame:
    """A row a target: raw and adjusted similarity beside coverage, the label, the band of the raw score, and the route. measured: of overall_where(adjusted=...)."""
    both = measured.join(F.broadcast(coverage), F.lit(True))  # coverage is one row
    none = (F.col("analyzed") == 0) | (F.col("n_words") == 0)
    full = (F.col("expected") > 0) & (F.col("analyzed") == F.col("expected"))
    score, adjusted_score = (F.when(~none, F.col(c)) for c in ("similarity", "adjusted"))
    route = F.when(F.col("n_words") == 0, "stop").when(F.col("analyzed") == 0, "diagnostic").when(full, "complete").otherwise("partial")
    return both.select(
        "doc", "n_words", "matched", score.alias("raw"), "adjusted_words", "adjusted_matched", adjusted_score.alias("adjusted"), "expected", "analyzed", "coverage",
        F.when(full, "Complete").otherwise("Partial").alias("label"), F.when(full, "Overall similarity").otherwise("Observed overall similarity").alias("metric"), band(score).alias("band"), route.alias("route"),
    )


def band(score: Column) -> Column:
    return F.when(score < 15, "Low").when(score <= 40, "Medium").when(score > 40, "High")
