"""Identity of sources: DOIs, titles, names, files, and the id a record gets."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import casefold, clean, col, empty_array, fold_marks, strip, unique


def _unwrapped(x: Column) -> Column:
    """One closing bracket less if it has no opening one."""
    out = x
    for opening, closing in ("()", "[]", "{}"):
        count = lambda c: F.length(x) - F.length(F.replace(x, F.lit(c)))
        out = F.when(x.endswith(closing) & (count(closing) > count(opening)), F.regexp_replace(F.substring(x, F.lit(1), F.length(x) - 1), r"(?U)\s+$", "")).otherwise(out)
    return out


def normalize_doi(x: Column | str) -> Column:
    """Without resolver, prefix, closing punctuation and unbalanced brackets; lower case. Null is empty."""
    x = strip(F.coalesce(col(x), F.lit("")))
    x = F.regexp_replace(x, r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    x = strip(F.regexp_replace(x, r"(?iU)^doi\s*:\s*", ""))
    x = F.regexp_replace(x, r"[.,;]+$", "")
    tail = F.length(F.regexp_extract(x, r"(?U)[)\]}\s]*$", 0))
    x = F.aggregate(F.sequence(F.lit(0), tail), x, lambda acc, _: _unwrapped(acc))
    return F.lower(x)


def looks_like_doi(x: Column | str) -> Column:
    return normalize_doi(x).rlike(r"(?U)^10\.\d{4,9}/\S+$")


def title_key(x: Column | str) -> Column:
    """Word tokens without marks and case: an array that joins on equality."""
    return F.regexp_extract_all(fold_marks(F.coalesce(col(x), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def family_variants(author: pd.Series) -> pd.Series:
    """Phrases that may be the family name: before a comma, or every suffix of a name in natural order.

    Word tokens as in title_key(). A UDF, because a lambda over the tokens could not hold the folding UDF.
    """

    def of(name: str | None) -> list[list[str]]:
        family, comma, _ = (name or "").partition(",")
        plain = "".join(c for c in unicodedata.normalize("NFKD", family) if not unicodedata.combining(c))
        parts = re.findall(r"\w+", plain.casefold())
        return [parts[i:] for i in range(1 if comma and parts else len(parts))]

    return author.map(of)


def filename_key(path: Column | str) -> Column:
    return strip(casefold(F.element_at(F.split(F.regexp_replace(F.coalesce(col(path), F.lit("")), "/+$", ""), "/"), -1)))


def identifier_key(x: Column | str) -> Column:
    return casefold(strip(F.coalesce(col(x), F.lit(""))))


def natural_name(name: Column, protected: Column) -> Column:
    """`Family, Given` in natural order, unless the name is protected."""
    name = clean(name)
    family, given = strip(F.substring_index(name, ",", 1)), strip(F.regexp_replace(name, r"(?s)^[^,]*,", ""))
    flipped = F.trim(F.concat_ws(" ", F.when(given != "", given), F.when(family != "", family)))
    return F.when(~protected & name.contains(","), flipped).otherwise(name)


def normalize_authors(authors: Column | str, protected: Column | bool = False) -> Column:
    """protected: one flag for all names, or an array of flags."""
    authors = F.coalesce(col(authors), empty_array())
    if isinstance(protected, bool):
        named = F.transform(authors, lambda a: natural_name(a, F.lit(protected)))
    else:
        named = F.transform(authors, lambda a, i: natural_name(a, F.coalesce(F.get(protected, i), F.lit(False))))
    return F.filter(named, lambda a: a != "")


def local_reference(x: Column | str) -> Column:
    """Whether a link names a local file: a drive, no scheme, or the file scheme."""
    x = strip(F.coalesce(col(x), F.lit("")))
    scheme = F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return x.rlike(r"^[A-Za-z]:[\\/]") | (scheme == "") | (scheme == "file")


def local_path(x: Column | str, base: Column | str) -> Column:
    """An absolute path: file links decoded, drives with forward slashes, the rest relative to base."""
    x = F.regexp_replace(strip(F.coalesce(col(x), F.lit(""))), '^"+|"+$', "")
    linked = x.rlike("(?i)^file:")
    host = F.regexp_extract(x, r"(?i)^file://([^/]*)", 1)
    path = F.regexp_extract(x, r"(?i)^file:(?://[^/]*)?([^?#]*)", 1)
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    path = F.when((host != "") & (F.lower(host) != "localhost"), F.concat(F.lit("//"), host, path)).otherwise(path)
    x = F.when(linked, F.regexp_replace(path, r"^/([A-Za-z]:[\\/])", "$1")).otherwise(x)
    drive = x.rlike(r"^[A-Za-z]:[\\/]")
    whole = F.when(x.startswith("/"), x).otherwise(F.concat(F.regexp_replace(col(base), "/+$", ""), F.lit("/"), x))
    return F.when(drive, F.replace(x, F.lit("\\"), F.lit("/"))).otherwise(_resolved(whole))


def _resolved(path: Column) -> Column:
    """`.` and `..` taken out of an absolute path."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    done = F.aggregate(parts, empty_array(), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(done, "/"))


def source_identity(doi: Column, title: Column, authors: Column, year: Column, aliases: Column, files: Column) -> Column:
    """doi:..., or a hash of title, authors and year; of aliases and files too where title and authors are missing."""
    unit, record = "\x1f", "\x1e"
    named = F.concat_ws(unit, casefold(title), F.array_join(authors, record), F.when(F.coalesce(year, F.lit(0)) != 0, year.cast("string")).otherwise(F.lit("")))
    more = F.concat_ws(unit, named, F.array_join(F.array_sort(aliases), record), F.array_join(F.array_sort(files), record))
    hashed = F.when((title != "") | (F.size(authors) > 0), named).otherwise(more)
    return F.when(doi != "", F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit("source:"), F.sha2(hashed, 256)))


SOURCE = "source_id string, aliases array<string>, title string, authors array<string>, year int, doi string, url string, local_files array<string>, provider string"


def source_records(raw):
    """Normalised source records of raw ones: (aliases, title, authors, protected array<boolean>, year, doi, url, local_files, provider)."""
    done = raw.select(
        unique(F.transform("aliases", clean)).alias("aliases"),
        clean("title").alias("title"),
        normalize_authors("authors", F.col("protected")).alias("authors"),
        F.col("year").cast("int").alias("year"),
        normalize_doi("doi").alias("doi"),
        strip(F.coalesce("url", F.lit(""))).alias("url"),
        unique("local_files").alias("local_files"),
        "provider",
    )
    identity = source_identity(F.col("doi"), F.col("title"), F.col("authors"), F.col("year"), F.col("aliases"), F.col("local_files"))
    return done.withColumn("source_id", identity).select(*(c.split()[0] for c in SOURCE.split(", ")))
