"""Text expressions: Unicode folding, white space, lines, ordering of strings, names and locators.

Everything is a Column expression that stays in the JVM, but for Unicode folding: Spark
has no Unicode normal forms and no case folding, so these are Arrow-batched UDFs. Plain
ASCII folds in the JVM; its rows go through the UDFs as nulls.
"""

from __future__ import annotations

import mimetypes
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
# The suffixes that are read, and their media types.
SUFFIX_TYPES = {
    ".doc": "application/msword",
    ".docm": "application/vnd.ms-word.document.macroEnabled.12",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".htm": "text/html",
    ".html": "text/html",
    ".latex": "text/x-tex",
    ".md": "text/markdown",
    ".pdf": "application/pdf",
    ".qmd": "text/markdown",
    ".tex": "text/x-tex",
    ".txt": "text/plain",
}


PLAIN = r"^[\x00-\x1b\x20-\x7f]*$"  # white space that Java and Python agree on


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


@F.pandas_udf(StringType())
def _fold_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def _normalized(s: pd.Series) -> pd.Series:
    joined = re.compile(r"(?<=\w)-\s*\n\s*(?=\w)").sub
    return s.map(lambda x: " ".join(joined("", unicodedata.normalize("NFKC", x)).split()).casefold(), na_action="ignore")


def _folded(x: Column, plain: Column, udf) -> Column:
    """plain for ASCII texts, what the UDF gives for all others."""
    ascii_ = x.rlike(PLAIN)
    return F.when(ascii_, plain).otherwise(udf(F.when(~ascii_, x)))


def casefold(x: Column | str) -> Column:
    return _folded(col(x), F.lower(col(x)), _casefold)


def fold_marks(x: Column | str) -> Column:
    """NFKD without combining marks, case-folded."""
    return _folded(col(x), F.lower(col(x)), _fold_marks)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Strip any Unicode white space; Spark's trim strips only spaces."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def clean(x: Column | str) -> Column:
    """Collapse white space and strip; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", " "))


def join_hyphens(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")


def normalize_text(x: Column | str) -> Column:
    """NFKC, hyphenated line ends joined, white space collapsed, case folded; null is empty."""
    x = F.coalesce(col(x), F.lit(""))
    return _folded(x, F.lower(clean(join_hyphens(x))), _normalized)


def blank(x: Column | str) -> Column:
    return ~col(x).rlike(r"(?U)\S")


def lines(x: Column | str) -> Column:
    """Array of lines, split where Python's splitlines splits; no empty line after a final break."""
    parts = F.split(col(x), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def before(sizes: Column, chunk: int = 256) -> Column:
    """For each item of an int array the sum of the items before it, by chunks, so that long arrays cost no square."""

    def running(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), empty_array("int").alias("out"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(a, start, step, lambda acc: acc["out"])

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / chunk).cast("int")), lambda i: F.slice(sizes, i * chunk + 1, chunk))
    starts = running(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + x)))
    return F.flatten(F.zip_with(parts, starts, lambda p, s: F.transform(running(p), lambda x: x + s)))


def unique(a: Column | str) -> Column:
    """Distinct and non-empty, in first order."""
    return F.array_distinct(F.filter(col(a), lambda x: x.isNotNull() & (x != "")))


def sorted_unique(a: Column | str) -> Column:
    """Distinct, by (lower case, raw)."""
    keyed = F.transform(F.array_distinct(F.filter(col(a), lambda x: x.isNotNull())), lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def sorted_pairs(a: Column | str) -> Column:
    """Distinct (file, locator) structs, each by (lower case, raw)."""
    keyed = F.transform(
        F.array_distinct(col(a)), lambda p: F.struct(F.lower(p["file"]).alias("kf"), p["file"].alias("file"), F.lower(p["locator"]).alias("kl"), p["locator"].alias("locator"))
    )
    return F.transform(F.array_sort(keyed), lambda p: F.struct(p["file"].alias("file"), p["locator"].alias("locator")))


def empty_array(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def line_locator(first: Column | str, last: Column | str) -> Column:
    first, last = col(first).cast("string"), col(last).cast("string")
    return F.when(first == last, first).otherwise(F.concat(first, F.lit("-"), last))


def html_locator(number: Column | str, element_id: Column | str) -> Column:
    element_id = col(element_id)
    return F.concat(F.lit("block="), col(number).cast("string"), F.when(element_id.isNotNull() & (element_id != ""), F.concat(F.lit(";id="), element_id)).otherwise(F.lit("")))


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"[^/.][^/]*?(\.[^./]+)$", 1))


def supported(path: Column | str) -> Column:
    return suffix(path).isin(*SUFFIX_TYPES)


def media_type(path: Column | str) -> Column:
    """By suffix: the adapters' own types, then the common registry, then octet-stream."""
    table = {**mimetypes.types_map, **SUFFIX_TYPES}
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(pairs[suffix(path)], F.lit("application/octet-stream"))


def cache_name(source_id: Column | str, path: Column | str) -> Column:
    """A file name that is safe, readable and free of collisions."""
    source_id = col(source_id)
    safe = F.regexp_replace(F.regexp_replace(source_id, r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    safe = F.substring(F.when(safe == "", F.lit("source")).otherwise(safe), 1, 80)
    return F.concat(safe, F.lit("-"), F.substring(F.sha2(F.concat(source_id, F.lit("\x1f"), col(path)), 256), 1, 16), F.lit(".jsonl"))


def json_list(a: Column | str) -> Column:
    """Compact JSON of a string array."""
    return F.to_json(F.coalesce(col(a), empty_array()))


def parse_list(x: Column | str) -> Column:
    """A JSON list's strings; of text that is not JSON the parts between bars."""
    x = F.coalesce(col(x), F.lit(""))
    parsed = F.try_parse_json(x)
    items = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), parsed.cast("array<variant>"))
    strings = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
    bars = F.filter(F.transform(F.split(x, r"\|"), strip), lambda p: p != "")
    return F.when(parsed.isNull(), bars).otherwise(F.coalesce(strings, empty_array()))


def first_year(x: Column | str) -> Column:
    """The first number of four digits that stands alone."""
    return F.regexp_extract(F.coalesce(col(x), F.lit("")), r"(?U)\b(\d{4})\b", 1).try_cast("int")
