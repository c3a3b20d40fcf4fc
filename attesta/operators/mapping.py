"""Entity resolution of requests to sources: an ordered cascade of equi-joins, and coalescing of records.

The first rule with any candidate wins, even if it is ambiguous. Each rule is one
equi-join on a normalised key, against candidates gathered or counted once a key; the
winner is the least rank by an aggregate, so no pass pairs requests with sources.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import identity as I
from attesta.functions import text as X

RULES = ("doi", "identifier", "title-author-year", "title", "filename")
NOTES = {
    "doi": "exact normalized DOI",
    "identifier": "exact case-insensitive identifier or alias",
    "title-author-year": "normalized title, family name, and year",
    "title": "normalized title match",
    "filename": "normalized filename or document metadata match",
    "none": "no deterministic match",
    "visible-citation": "visible citation has no explicit identifier",
}
REQUEST = "request_id string, doi string, identifiers array<string>, title string, authors array<string>, year int, filenames array<string>"


def note_of(rule):
    return F.create_map(*(F.lit(x) for pair in NOTES.items() for x in pair))[rule]


def _dois(requests: DataFrame) -> DataFrame:
    given = F.array_union(F.array(F.coalesce("doi", F.lit(""))), F.coalesce("identifiers", X.empty_array()))
    return requests.select("request_id", F.explode(given).alias("v")).filter(I.looks_like_doi("v")).select("request_id", I.normalize_doi("v").alias("k"))


def _identifiers(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", F.explode("identifiers").alias("v")).select("request_id", I.identifier_key("v").alias("k")).filter("k <> ''")


def _doi_offers(sources: DataFrame) -> DataFrame:
    return sources.filter("doi <> ''").select(F.col("doi").alias("k"), "source_id")


def _identifier_offers(sources: DataFrame) -> DataFrame:
    known = sources.select("source_id", F.explode(F.concat("aliases", F.array("source_id"))).alias("v")).select(I.identifier_key("v").alias("k"), "source_id")
    return known.filter("k <> ''").distinct()


def _titled(df: DataFrame, key: str) -> DataFrame:
    """(key, authors, year, title): title as its word tokens between spaces, which no token holds."""
    tokens = df.select(key, "authors", "year", I.title_key("title").alias("t")).filter(F.size("t") > 0)
    return tokens.select(key, "authors", "year", F.array_join("t", " ").alias("title"))


def _title_keys(df: DataFrame, key: str) -> DataFrame:
    return _titled(df, key).select(key, F.col("title").alias("k"))


def _person_keys(df: DataFrame, key: str) -> DataFrame:
    author = _titled(df, key).filter("year is not null").select(key, "title", "year", F.explode("authors").alias("author"))
    family = author.select(key, "title", "year", F.explode(I.family_variants("author")).alias("family"))
    return family.select(key, F.concat_ws("\x1f", "title", F.col("year").cast("string"), F.array_join("family", " ")).alias("k")).distinct()


def _file_keys(df: DataFrame, key: str, files: str) -> DataFrame:
    return df.select(key, F.explode(files).alias("v")).select(key, I.filename_key("v").alias("k")).filter("k <> ''")


def _ranked(parts: list[DataFrame], name: str) -> DataFrame:
    return reduce(DataFrame.union, (p.select(name, F.lit(rank).alias("rank"), "k") for rank, p in enumerate(parts)))


def _asked(requests: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What requests ask for and sources offer: (request_id, rank, k) and (source_id, rank, k), k a key of the rule of that rank."""
    asks = [_dois(requests), _identifiers(requests), _person_keys(requests, "request_id"), _title_keys(requests, "request_id"), _file_keys(requests, "request_id", "filenames")]
    offers = [_doi_offers(sources), _identifier_offers(sources), _person_keys(sources, "source_id"), _title_keys(sources, "source_id"), _file_keys(sources, "source_id", "local_files")]
    return _ranked(asks, "request_id"), _ranked(offers, "source_id").distinct()


def _best(asks: DataFrame, offers: DataFrame) -> DataFrame:
    """(request_id, rank, ks, n, first): the first rule with a candidate and the request's keys that have one.

    n and first: candidates of a single key and the least of them; n is null for several keys. A key's
    candidates are counted once, whatever number of requests has it.
    """
    held = offers.groupBy("rank", "k").agg(F.count("*").alias("n"), F.min("source_id").alias("first"))
    met = asks.join(held, ["rank", "k"]).groupBy("request_id").agg(F.array_sort(F.collect_set(F.struct("rank", "k", "n", "first"))).alias("met"))
    rank = F.get("met", 0)["rank"]
    hits = met.select("request_id", rank.alias("rank"), F.filter("met", lambda m: m["rank"] == rank).alias("met"))
    return hits.select("request_id", "rank", F.col("met.k").alias("ks"), F.when(F.size("met") == 1, F.get("met", 0)["n"]).alias("n"), F.array_min("met.first").alias("first"))


def _sets(best: DataFrame, offers: DataFrame) -> DataFrame:
    """(rank, ks, source_id): candidates of each distinct set of keys, each once."""
    each = best.select("rank", "ks").distinct().select("rank", "ks", F.explode("ks").alias("k"))
    return each.join(offers, ["rank", "k"]).select("rank", "ks", "source_id").distinct()


def map_sources(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """(request_id, status, source_ids, rule, note) of each request.

    source_ids are gathered once for all requests of the same keys, but each row holds them all: where a
    title has many sources and many requests, map_counts() tells how many in a row of fixed size.
    """
    asks, offers = _asked(requests, sources)
    best = _best(asks, offers).select("request_id", "rank", "ks")
    lists = _sets(best, offers).groupBy("rank", "ks").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    return _settle(requests, best.join(lists, ["rank", "ks"]).select("request_id", "source_ids", "rank"))


def map_counts(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """(request_id, status, n, first, rule, note): map_sources() with the number of candidates and the least of them, no list."""
    asks, offers = _asked(requests, sources)
    best = _best(asks, offers)
    several = best.filter("n is null")
    counts = _sets(several, offers).groupBy("rank", "ks").agg(F.count("*").alias("n"))
    both = best.filter("n is not null").select("request_id", "rank", "n", "first").union(several.drop("n").join(counts, ["rank", "ks"]).select("request_id", "rank", "n", "first"))
    found = requests.select("request_id").join(both, "request_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return found.select("request_id", _status(F.col("n")), "n", F.coalesce("first", F.lit("")).alias("first"), *_rule())


def map_identifiers(keys: DataFrame, sources: DataFrame) -> DataFrame:
    """The cascade for requests that are one citation key each: (request_id), which is the key."""
    requests = keys.select("request_id", F.lit("").alias("doi"), F.array("request_id").alias("identifiers"))
    ranked = _ranked([_dois(requests), _identifiers(requests)], "request_id").join(_ranked([_doi_offers(sources), _identifier_offers(sources)], "source_id"), ["rank", "k"])
    by_rank = ranked.groupBy("request_id", "rank").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    return _settle(requests, by_rank.groupBy("request_id").agg(F.min_by("source_ids", "rank").alias("source_ids"), F.min("rank").alias("rank")))


def _status(n):
    return F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("status")


def _rule() -> list:
    rule = F.coalesce(F.get(F.array(*map(F.lit, RULES)), F.col("rank")), F.lit("none"))
    return [rule.alias("rule"), note_of(rule).alias("note")]


def _settle(requests: DataFrame, best: DataFrame) -> DataFrame:
    ids = F.coalesce("source_ids", X.empty_array())
    found = requests.select("request_id").join(best, "request_id", "left")
    return found.select("request_id", _status(F.size(ids)), ids.alias("source_ids"), *_rule())


def coalesce_sources(sources: DataFrame) -> DataFrame:
    """One record a source_id, each field the first of its values in order, with a conflict for each field that has several."""
    fields = ("title", "doi", "url", "provider")
    people = F.collect_set(F.when(F.size("authors") > 0, F.struct(F.transform("authors", lambda a: F.struct(F.lower(a), a)).alias("k"), F.col("authors").alias("v"))))
    grouped = sources.groupBy("source_id").agg(
        *(X.sorted_unique(F.collect_set(F.nullif(F.col(f), F.lit("")))).alias(f) for f in fields),
        F.transform(F.array_sort(people), lambda s: s["v"]).alias("authors"),
        F.array_sort(F.collect_set("year")).alias("years"),
        X.sorted_unique(F.flatten(F.collect_list("aliases"))).alias("aliases"),
        X.sorted_unique(F.flatten(F.collect_list("local_files"))).alias("local_files"),
    )
    said = lambda name, values: F.when(F.size(values) > 1, F.concat(F.lit(f"{name}: "), F.array_join(values, " <> ")))
    conflicts = F.array(
        said("title", F.col("title")), said("authors", F.transform("authors", lambda a: F.array_join(a, ", "))), said("year", F.transform("years", lambda y: y.cast("string"))),
        said("doi", F.col("doi")), said("url", F.col("url")), said("provider", F.col("provider")), said("local_files", F.col("local_files")),
    )
    first = lambda c: F.coalesce(F.get(F.col(c), 0), F.lit(""))
    return grouped.select(
        "source_id", "aliases", first("title").alias("title"), F.coalesce(F.get("authors", 0), X.empty_array()).alias("authors"), F.get("years", 0).alias("year"),
        first("doi").alias("doi"), first("url").alias("url"), "local_files", first("provider").alias("provider"), F.filter(conflicts, lambda c: c.isNotNull()).alias("conflicts"),
    )
