"""Text, citation, identity and report queries, with the SQL that says the same.

What the supplied tables lack (citations, DOIs, names) comes from small inline rows,
one definition for the query and its SQL.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from attesta.functions import citations as C
from attesta.functions import grammar as G
from attesta.functions import identity as I
from attesta.functions import text as X
from attesta.operators import reports as R
from attesta.operators import support as U
from attesta.sources import documents as D
from attesta.streaming import incremental

from .tables import read, values

CITED = [
    (1, "The first claim cites [@alpha2020; @delta2023]."),
    (2, "Mail me@example.com, see @beta2021. And @gamma-2022!"),
    (3, "Shown before (Smith, 2020) and (see Jones 1999a; Doe 2001)."),
    (4, "No citation (of 12345) here."),
    (5, r"We cite \citep[see][p.~4]{beta2021, delta2023} and \textcite*{ada 1843}."),
    (6, r"Empty \cite{ , } and \parencite[x] {k1}."),
    (7, ""),
    (8, None),
]
DOIS = [
    (1, "doi:10.1000/example(1)."), (2, "https://doi.org/10.1000/ABC)"), (3, "http://dx.doi.org/10.1234/x.y;"), (4, " DOI : 10.5555/AbC "),
    (5, "10.1000/[a]]"), (6, "not a doi"), (7, ""), (8, None), (9, "10.12/short"),
]
NAMES = [(1, "Doe, Jane", False), (2, "Research, Development", True), (3, "  Ana   de la Cruz ", False), (4, "García Márquez, María", False), (5, "", False), (6, "Ludwig van Beethoven", False)]
PATHS = [
    (1, "/a/b/Thesis.PDF"), (2, "/a/notes.md"), (3, "/a/x.tar.gz"), (4, "/a/plain"), (5, "/a/Paper.docx"), (6, "/a/.hidden"), (7, "/a/page.HTM"), (8, "/a/ref.bib"),
]
SOURCE_IDS = [(1, "doi:10.1000/abc", "/a/b.pdf"), (2, "..//..", "/x"), (3, "source:" + "9" * 90, "/y"), (4, "plain", "")]
LISTS = [(1, '["a","b"]'), (2, "a | b ||c"), (3, '[1,"x",null]'), (4, ""), (5, '{"a":1}'), (6, None)]
LINKS = [(1, "http://example.org/a.pdf"), (2, "file:///tmp/a%20b.pdf"), (3, "C:\\docs\\a.pdf"), (4, "a/../b.pdf"), (5, "ftp://x"), (6, "/abs/./x.pdf")]


# What the tables give besides the inline rows, in SQL that Spark and DuckDB both read; ids begin at 1000.
MORE = {
    "cited": ("part", "p_partkey + 1000", {"text": r"'Claim [@part' || p_partkey || '; @x.y' || p_size || '.], see (' || p_brand || ', ' || (1860 + p_size) || 'b) and (n. ' || p_size || '); \\cite{k' || p_partkey || ',  m }, me@k' || p_size"}),
    "dois": ("part", "p_partkey + 1000", {"doi": "CASE p_partkey % 4 WHEN 0 THEN 'https://doi.org/10.' || (1000 + p_size) || '/ABC(' || p_partkey || ').' WHEN 1 THEN ' doi: 10.5555/X.' || p_partkey || ')' WHEN 2 THEN '10.' || p_size || '/' || p_name ELSE p_name END"}),
    "names": ("customer", "c_custkey + 1000", {"name": "CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ', Ana  de ' || c_name ELSE 'Ana ' || c_mktsegment END", "protected": "c_custkey % 2 = 0"}),
    "paths": ("part", "p_partkey + 1000", {"path": "'/p/' || p_brand || '/' || p_name || CASE p_size % 6 WHEN 0 THEN '.Pdf' WHEN 1 THEN '.qmd' WHEN 2 THEN '.x.TEX' WHEN 3 THEN '' WHEN 4 THEN '.zzz' ELSE '.html' END"}),
    "ids": ("part", "p_partkey + 1000", {"source_id": "'..' || p_name || ' ' || p_brand || '/'", "path": "'/p/' || p_partkey"}),
    "lists": ("conversations", "conv_id * 1000 + turn + 1000", {"cell": "CASE turn % 3 WHEN 0 THEN '[\"' || role || '\",\"' || conv_id || '\",7]' WHEN 1 THEN role || ' | ' || conv_id || '||' ELSE '{\"a\":' || turn || '}' END"}),
    "links": ("part", "p_partkey + 1000", {"link": "CASE p_partkey % 3 WHEN 0 THEN 'lib/./x/../' || p_partkey || '.pdf' WHEN 1 THEN 'file:///lib/n%20' || p_partkey ELSE 'https://e.org/' || p_partkey END"}),
}


def _rows(spark, sf_dir, which, rows, schema):
    """The inline rows and those that the tables give."""
    table, key, more = MORE[which]
    inline = spark.createDataFrame(rows, schema.replace("id int", "id bigint"))
    return inline.union(read(spark, sf_dir, table).selectExpr(f"CAST({key} AS bigint) AS id", *(f"{v} AS {k}" for k, v in more.items())))


def _both(which, rows, names):
    """The same in SQL."""
    table, key, more = MORE[which]
    columns = ", ".join(["id", *more])
    return f"(SELECT {columns} FROM {values(rows, names)} UNION ALL SELECT {key}, {', '.join(more.values())} FROM {table})"


def text_lines(spark, sf_dir):
    found = D.text_blocks(read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("document_id", "block_id", "locator_value", F.length("text_original").cast("bigint").alias("n_chars"), F.md5("text_original").alias("digest"))


def text_normalized(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.normalize_text("text")).alias("digest"))


def text_turns(spark, sf_dir):
    """Conversation turns as blocks, normalised."""
    found = read(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return D.text_blocks(found, "id", "text").groupBy("document_id").agg(F.count("*").alias("n_blocks"), F.max("locator_value").alias("last"))


def html_blocks(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    files = pages.select("path", F.sha2("content", 256).alias("sha256"), X.media_type("path").alias("media_type"), "content")
    return D.tables(D.extract(files, "target"))["blocks"].select("path", "block_index", "block_id", "text_normalized", "locator_type", "locator_value", "heading")


def html_diagnostics(spark, sf_dir):
    """Status of every page, usable or not."""
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    files = pages.select("path", F.sha2("content", 256).alias("sha256"), X.media_type("path").alias("media_type"), "content")
    return D.extract(files, "target").groupBy("extraction_status", "text_quality", "media_type").agg(F.count("*").alias("n"))


def _markdown(spark, sf_dir):
    """Every document as a Markdown file: front matter, a heading, its text, a fence that hides a citation, and one that shows."""
    number = F.col("doc_id").cast("string")
    text = F.concat(F.lit("---\ntitle: T\n---\n## Doc "), number, F.lit(" {#d}\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n```\n@hidden\n```\nSee [@k"), number, F.lit("; @shared].\n"))
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("/docs/"), number, F.lit(".md")).alias("path"), F.encode(text, "UTF-8").alias("content"))
    return D.tables(D.extract(docs.select("path", F.sha2("content", 256).alias("sha256"), X.media_type("path").alias("media_type"), "content"), "target"))


def markdown_blocks(spark, sf_dir):
    return _markdown(spark, sf_dir)["blocks"].select("path", "block_index", "block_id", "locator_value", "heading", F.md5("text_original").alias("digest"))


def markdown_mentions(spark, sf_dir):
    found = _markdown(spark, sf_dir)["mentions"]
    return found.select("path", "raw_text", F.array_join("citation_keys", "|").alias("keys"), "locator_value", "mapping_status")


def latex_blocks(spark, sf_dir):
    """Every turn of a conversation as a TeX file under a section, with a comment and a citation over two lines after it."""
    name = F.concat(F.lit("/tex/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".tex"))
    text = F.concat(F.lit("\\section*{"), F.col("role"), F.lit("}\n"), F.coalesce("text", F.lit("")), F.lit("\n% gone\n5\\% of \\citep[p.~1]\n{a, b}"))
    files = read(spark, sf_dir, "conversations").select(name.alias("path"), F.encode(text, "UTF-8").alias("content"))
    out = D.tables(D.extract(files.select("path", F.sha2("content", 256).alias("sha256"), X.media_type("path").alias("media_type"), "content"), "target"))
    blocks = out["blocks"].groupBy("path", "heading").agg(F.count("*").alias("n"), F.max_by("text_original", "block_index").alias("last"), F.max("block_index").cast("bigint").alias("top"))
    return blocks.join(out["mentions"].select("path", F.array_join("citation_keys", "|").alias("keys"), "locator_value"), "path")


@F.pandas_udf(BinaryType())
def _word_file(turns: pd.Series) -> pd.Series:
    """A Word package with a heading and a paragraph for each turn."""

    def of(texts) -> bytes:
        out, space = io.BytesIO(), 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        body = "".join(f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>" for t in texts)
        with zipfile.ZipFile(out, "w") as package:
            package.writestr("word/document.xml", f'<w:document {space}><w:body><w:p><w:pPr><w:pStyle w:val="h"/></w:pPr><w:r><w:t>Talk</w:t></w:r></w:p>{body}</w:body></w:document>')
            package.writestr("word/styles.xml", f'<w:styles {space}><w:style w:styleId="h"><w:name w:val="Heading 1"/></w:style></w:styles>')
        return out.getvalue()

    return turns.map(of)


def ooxml_blocks(spark, sf_dir):
    """Every conversation as a Word file."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda t: t["text"])
    talks = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    files = talks.select(F.concat(F.lit("/talks/"), F.col("conv_id").cast("string"), F.lit(".docx")).alias("path"), _word_file("turns").alias("content"))
    out = D.tables(D.extract(files.select("path", F.lit("").alias("sha256"), X.media_type("path").alias("media_type"), "content"), "source"))
    return out["blocks"].select("path", "block_id", "locator_type", "locator_value", "heading", F.md5("text_original").alias("digest"))


def page_quality(spark, sf_dir):
    """Each line of a document taken as a page."""
    pages = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("page"))
    return D.page_quality(pages, "doc_id", "page").withColumns({c: F.col(c).cast("bigint") for c in ("n_pages", "n_solid", "n_broken")})


def page_blocks(spark, sf_dir):
    """Page texts with an empty line between each pair of conversation turns."""
    pages = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit("\r\n \n"), F.col("role")).alias("page"))
    return D.page_blocks(pages, "conv_id", "turn", "page").select("document_id", "block_id", "locator_value", F.md5("text_original").alias("digest"))


def visible_citations(spark, sf_dir):
    rows = _rows(spark, sf_dir, "cited", CITED, "id int, text string")
    return rows.select("id", F.explode(C.visible("text")).alias("raw")).select("id", "raw", C.visible_key("raw").alias("key"))


def locators(spark, sf_dir):
    """Places of parts, as spans of lines and as blocks of a page with or without an element's id."""
    part, name = read(spark, sf_dir, "part"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, "")
    return part.select("p_partkey", X.line_locator("p_size", F.col("p_size") + F.col("p_partkey") % 2).alias("line"), X.html_locator("p_size", name).alias("block"))


def arrivals(spark, sf_dir):
    """Events as arriving files, by hour and kind."""
    found = read(spark, sf_dir, "events").select(F.col("ts").alias("arrived"), F.col("event_type").alias("media_type"))
    return incremental.arrivals(found).select(F.col("window.start").alias("hour"), "media_type", "n")


def citation_keys(spark, sf_dir):
    rows = _rows(spark, sf_dir, "cited", CITED, "id int, text string")
    at = rows.select("id", F.lit("at").alias("kind"), F.explode(C.at_keys("text")).alias("key"))
    return at.union(rows.select("id", F.lit("tex"), F.explode(C.tex_keys("text"))))


def doi_normalized(spark, sf_dir):
    return _rows(spark, sf_dir, "dois", DOIS, "id int, doi string").select("id", I.normalize_doi("doi").alias("norm"), I.looks_like_doi("doi").alias("is_doi"))


def title_keys(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(I.title_key(F.concat(F.lit("Café: "), "p_name", F.lit("-Ünder"))), "|").alias("key"))


def author_names(spark, sf_dir):
    rows = _rows(spark, sf_dir, "names", NAMES, "id int, name string, protected boolean")
    one = rows.select("id", F.get(I.normalize_authors(F.array("name"), F.array("protected")), 0).alias("natural"), I.family_variants("name").alias("variants"))
    return one.select("id", "natural", F.array_join(F.array_sort(F.transform("variants", lambda v: F.array_join(v, " "))), "|").alias("variants"))


def source_identities(spark, sf_dir):
    """The id of a record made of each part: every third has a DOI, every fifth neither title nor author."""
    part = read(spark, sf_dir, "part")
    bare = F.col("p_partkey") % 5 == 0
    doi = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("10.1000/P"), F.col("p_partkey").cast("string"), F.lit("."))).otherwise("")
    raw = part.select(
        F.array(F.concat(F.lit("k"), F.col("p_partkey").cast("string"))).alias("aliases"), F.when(bare, "").otherwise(F.col("p_name")).alias("title"),
        F.when(bare, X.empty_array()).otherwise(F.array(F.concat("p_brand", F.lit(", Given")))).alias("authors"), F.array(F.lit(False)).alias("protected"), F.col("p_size").alias("year"), doi.alias("doi"),
        F.lit("").alias("url"), F.array(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string"))).alias("local_files"), F.lit("part").alias("provider"),
    )
    return I.source_records(raw).select(F.get("aliases", 0).alias("alias"), "source_id")


def media_types(spark, sf_dir):
    return _rows(spark, sf_dir, "paths", PATHS, "id int, path string").select("id", X.suffix("path").alias("suffix"), X.supported("path").alias("supported"), X.media_type("path").alias("media_type"))


def cache_names(spark, sf_dir):
    return _rows(spark, sf_dir, "ids", SOURCE_IDS, "id int, source_id string, path string").select("id", X.cache_name("source_id", "path").alias("name"))


def json_lists(spark, sf_dir):
    rows = _rows(spark, sf_dir, "lists", LISTS, "id int, cell string")
    return rows.select("id", X.json_list(X.parse_list("cell")).alias("encoded"), F.size(X.parse_list("cell")).cast("bigint").alias("n"))


def local_links(spark, sf_dir):
    return _rows(spark, sf_dir, "links", LINKS, "id int, link string").select("id", I.local_reference("link").alias("is_local"), I.local_path("link", F.lit("/base/dir")).alias("path"))


def file_hashes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.concat(F.lit("target-"), F.sha2(F.encode("text", "UTF-8"), 256)).alias("document_id"))


# Claims are orders and, with numbers below zero, customers; a line item is a citation of its part, with a label drawn from its keys. No line item cites for a customer.
def _claims(spark, sf_dir):
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    cited = lines.select(F.col("l_orderkey").alias("claim_id")).distinct().withColumn("has", F.lit(True))
    claims = orders.select(F.col("o_orderkey").alias("claim_id")).union(read(spark, sf_dir, "customer").select(-F.col("c_custkey")))
    claims = claims.withColumn("eligible", F.col("claim_id") % 5 != 0).join(cited, "claim_id", "left")
    label = F.get(F.array(*map(F.lit, U.LABELS)), ((F.col("l_partkey") + F.col("l_suppkey") + F.col("l_orderkey")) % 5).cast("int"))
    citations = lines.select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("source_id"), F.col("l_linestatus").alias("function"), label.alias("label"))
    expected = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), (F.col("p_partkey") % 7 != 0).alias("readable"))
    return claims.select("claim_id", "eligible", F.coalesce("has", F.lit(False)).alias("has_citation")), citations, expected


def support_joint(spark, sf_dir):
    claims, citations, _ = _claims(spark, sf_dir)
    return U.joint_support(claims, citations)


def support_matrix(spark, sf_dir):
    claims, citations, _ = _claims(spark, sf_dir)
    return U.matrix(claims, citations)


def support_measures(spark, sf_dir):
    claims, citations, _ = _claims(spark, sf_dir)
    return U.measures(claims, citations)


def support_coverage(spark, sf_dir):
    claims, citations, expected = _claims(spark, sf_dir)
    return U.source_coverage(expected, claims, citations)


def support_diagnostics(spark, sf_dir):
    claims, citations, expected = _claims(spark, sf_dir)
    return U.diagnostics(claims, citations, expected)


def support_labels(spark, sf_dir):
    return U.label_counts(_claims(spark, sf_dir)[1])


def support_missing(spark, sf_dir):
    claims, citations, _ = _claims(spark, sf_dir)
    return U.missing_citations(claims, citations)


def support_affected(spark, sf_dir):
    _, citations, expected = _claims(spark, sf_dir)
    return U.affected_claims(expected, citations).select("source_id", F.size("claims").cast("bigint").alias("n_claims"), F.coalesce(F.get("claims", 0), F.lit(-1)).alias("first_claim"))


def support_scorecard(spark, sf_dir):
    claims, citations, expected = _claims(spark, sf_dir)
    return R.support_scorecard(U.measures(claims, citations), U.source_coverage(expected, claims, citations))


def _sql_norm(x: str) -> str:
    return f"replace(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), 'ß', 'ss')"


_LABEL = "(['" + "', '".join(U.LABELS) + "'])[(l_partkey + l_suppkey + l_orderkey) % 5 + 1]"
_CLAIMS = f"""WITH cit0 AS (SELECT l_orderkey AS claim_id, l_partkey AS source_id, l_linestatus AS function, {_LABEL} AS label FROM lineitem),
claims AS (SELECT claim_id, claim_id % 5 <> 0 AS eligible, claim_id IN (SELECT claim_id FROM cit0) AS has_citation FROM (SELECT o_orderkey AS claim_id FROM orders UNION ALL SELECT -c_custkey FROM customer)),
cit AS (SELECT claim_id, source_id, function, min(label) AS label FROM cit0 GROUP BY ALL),
expected AS (SELECT p_partkey AS source_id, p_partkey % 7 <> 0 AS readable FROM part),
fl AS (SELECT claim_id, bool_or(label = 'contradicts') AS c, bool_or(label = 'full') AS f, bool_or(label = 'unverifiable') AS u FROM cit GROUP BY claim_id),
j AS (SELECT claims.claim_id, eligible, has_citation, CASE WHEN c IS NULL THEN NULL WHEN c THEN 'not_full' WHEN f THEN 'full' WHEN u THEN 'unverifiable' ELSE 'not_full' END AS joint FROM claims LEFT JOIN fl USING (claim_id)),
mx AS (SELECT cit.*, joint, label <> 'unverifiable' AND coalesce(joint, '') <> 'unverifiable' AS classifiable, coalesce(joint = 'full' AND label IN ('full', 'partial'), false) AS supporting FROM cit JOIN j USING (claim_id))"""
_AT = "unnest(regexp_extract_all(' ' || text, '" + G.PANDOC_CITATION.replace(r"(?<![\w@.])", r"(?:^|[^\w@.])") + "', 1))"  # DuckDB has no look-behind
_TEX = f"unnest(regexp_extract_all(text, '{G.LATEX_CITATION}', 1))"
_CITED, _DOIS, _NAMES = _both("cited", CITED, "id, text"), _both("dois", DOIS, "id, doi"), _both("names", NAMES, "id, name, protected")
_MEDIA = "CASE suffix " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.SUFFIX_TYPES.items())
_LINE = r"SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"

SQL = {
    "text_lines": rf"SELECT doc_id AS document_id, 'line-' || i AS block_id, CAST(i AS VARCHAR) AS locator_value, length(line) AS n_chars, md5(line) AS digest FROM ({_LINE}) WHERE regexp_matches(line, '\S')",
    "text_normalized": f"SELECT doc_id, md5({_sql_norm('text')}) AS digest FROM documents",
    "markdown_blocks": rf"""WITH f AS (SELECT doc_id, '---' || chr(10) || 'title: T' || chr(10) || '---' || chr(10) || '## Doc' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '~' || chr(10) || '~' || chr(10) || '~' || chr(10) || 'See [@k' || doc_id || '; @shared].' AS t FROM documents),
l AS (SELECT doc_id, generate_subscripts(l, 1) AS i, len(l) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM f)),
m AS (SELECT *, i <= 4 OR i BETWEEN n - 3 AND n - 1 OR NOT regexp_matches(line, '\S') AS gap FROM l),
g AS (SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m),
b AS (SELECT doc_id, min(i) AS lo, max(i) AS hi, string_agg(line, chr(10) ORDER BY i) AS t FROM g WHERE NOT gap GROUP BY doc_id, island)
SELECT '/docs/' || doc_id || '.md' AS path, row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS block_index, 'line-' || lo AS block_id, CASE WHEN lo = hi THEN '' || lo ELSE lo || '-' || hi END AS locator_value, 'Doc ' || doc_id AS heading, md5(t) AS digest FROM b""",
    "markdown_mentions": rf"""WITH l AS (SELECT doc_id, generate_subscripts(l, 1) + 5 AS i, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, '') || chr(10) || chr(10) || '~' || chr(10) || '~' || chr(10) || '~' || chr(10) || 'See [@k' || doc_id || '; @shared].', chr(10)) AS l FROM documents)),
k AS (SELECT doc_id, i, rtrim({_AT}, '.,;:!?') AS key FROM l)
SELECT '/docs/' || doc_id || '.md' AS path, '@' || key AS raw_text, key AS keys, CAST(i AS VARCHAR) AS locator_value, 'unresolved' AS mapping_status FROM k""",
    "latex_blocks": r"""WITH t AS (SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations),
c AS (SELECT conv_id, turn, any_value(role) AS heading, len(any_value(l)) AS n, count(*) FILTER (regexp_matches(regexp_replace(x, '%.*$', ''), '\S')) AS shown FROM (SELECT *, unnest(l) AS x FROM t) GROUP BY conv_id, turn)
SELECT '/tex/' || conv_id || '-' || turn || '.tex' AS path, heading, shown + 2 AS n, '{a, b}' AS last, shown + 2 AS top, 'a|b' AS keys, (n + 3) || '-' || (n + 4) AS locator_value FROM c""",
    "ooxml_blocks": r"""WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) + 1 AS i FROM conversations UNION ALL SELECT DISTINCT conv_id, 'Talk', 1 FROM conversations)
SELECT '/talks/' || conv_id || '.docx' AS path, 'paragraph-' || i AS block_id, 'paragraph' AS locator_type, CAST(i AS VARCHAR) AS locator_value, 'Talk' AS heading, md5(text) AS digest FROM t WHERE regexp_matches(coalesce(text, ''), '\S')""",
    "text_turns": r"SELECT conv_id || ':' || turn AS document_id, count(*) AS n_blocks, max(CAST(i AS VARCHAR)) AS last FROM (SELECT conv_id, turn, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)) WHERE regexp_matches(line, '\S') GROUP BY 1",
    "page_quality": rf"""WITH p AS (SELECT doc_id AS document_id, count(*) AS n_pages, CAST(sum(length(regexp_replace(line, '\s', '', 'g'))) AS BIGINT) AS n_solid, CAST(sum(length(line) - length(replace(line, '{chr(0xFFFD)}', ''))) AS BIGINT) AS n_broken FROM ({_LINE}) GROUP BY 1)
SELECT *, CASE WHEN n_solid = 0 THEN 'empty' WHEN n_solid < 100 * n_pages THEN 'needs_ocr' WHEN 100 * n_broken > n_solid THEN 'needs_review' ELSE 'extracted' END AS extraction_status,
CASE WHEN n_solid = 0 THEN 'empty' WHEN n_solid < 100 * n_pages THEN 'sparse' WHEN 100 * n_broken > n_solid THEN 'degraded' ELSE 'good' END AS text_quality FROM p""",
    "page_blocks": r"""WITH p AS (SELECT conv_id, turn, list_filter([trim(x, chr(10) || ' ') FOR x IN regexp_split_to_array(text || chr(10) || ' ' || chr(10) || role, '\n\s*\n+')], lambda x: x <> '') AS l FROM conversations)
SELECT conv_id AS document_id, 'pdf-page-' || turn || '-block-' || i AS block_id, 'page=' || turn || ';block=' || i AS locator_value, md5(t) AS digest FROM (SELECT conv_id, turn, generate_subscripts(l, 1) AS i, unnest(l) AS t FROM p)""",
    "locators": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '' || p_size ELSE p_size || '-' || (p_size + 1) END AS line, 'block=' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ';id=' || p_brand ELSE '' END AS block FROM part",
    "arrivals": "SELECT date_trunc('hour', ts) AS hour, event_type AS media_type, count(*) AS n FROM events GROUP BY ALL",
    "visible_citations": rf"SELECT id, raw, 'visible:' || substr(sha256(raw), 1, 16) AS key FROM (SELECT id, unnest(regexp_extract_all(text, '{G.VISIBLE_CITATION}')) AS raw FROM {_CITED})",
    "citation_keys": rf"SELECT id, 'at' AS kind, rtrim(k, '.,;:!?') AS key FROM (SELECT id, {_AT} AS k FROM {_CITED}) UNION ALL SELECT id, 'tex', k FROM (SELECT id, regexp_replace(unnest(string_split(g, ',')), '\s+', '', 'g') AS k FROM (SELECT id, {_TEX} AS g FROM {_CITED})) WHERE k <> ''",
    "doi_normalized": rf"""WITH a AS (SELECT id, rtrim(trim(regexp_replace(regexp_replace(trim(coalesce(doi, '')), '^https?://(dx\.)?doi\.org/', '', 'i'), '^doi\s*:\s*', '', 'i')), '.,;') AS d FROM {_DOIS}),
b AS (SELECT id, lower(CASE WHEN (d LIKE '%)' AND length(replace(d, '(', '')) > length(replace(d, ')', ''))) OR (d LIKE '%]' AND length(replace(d, '[', '')) > length(replace(d, ']', ''))) THEN left(d, -1) ELSE d END) AS norm FROM a)
SELECT id, norm, regexp_matches(norm, '^10\.\d{{4,9}}/\S+$') AS is_doi FROM b""",
    "title_keys": r"SELECT p_partkey, array_to_string(regexp_extract_all(strip_accents(lower('Café: ' || p_name || '-Ünder')), '\w+'), '|') AS key FROM part",
    "author_names": rf"""WITH c AS (SELECT *, trim(regexp_replace(name, '\s+', ' ', 'g')) AS n FROM {_NAMES}), f AS (SELECT *, strip_accents(lower(CASE WHEN n LIKE '%,%' THEN split_part(n, ',', 1) ELSE n END)) AS fam FROM c), w AS (SELECT *, regexp_extract_all(fam, '\w+') AS t FROM f)
SELECT id, nullif(CASE WHEN n LIKE '%,%' AND NOT protected THEN trim(split_part(n, ',', 2)) || ' ' || trim(split_part(n, ',', 1)) ELSE n END, '') AS natural,
CASE WHEN n LIKE '%,%' THEN array_to_string(t, ' ') ELSE array_to_string(list_sort([array_to_string(t[i:], ' ') FOR i IN range(1, len(t) + 1)]), '|') END AS variants FROM w""",
    "source_identities": """SELECT 'k' || p_partkey AS alias, CASE WHEN p_partkey % 3 = 0 THEN 'doi:10.1000/p' || p_partkey
WHEN p_partkey % 5 = 0 THEN 'source:' || sha256(chr(31) || chr(31) || p_size || chr(31) || 'k' || p_partkey || chr(31) || '/p/' || p_partkey)
ELSE 'source:' || sha256(lower(p_name) || chr(31) || 'Given ' || p_brand || chr(31) || p_size) END AS source_id FROM part""",
    "media_types": rf"""WITH s AS (SELECT id, path, lower(regexp_extract(path, '[^/.][^/]*?(\.[^./]+)$', 1)) AS suffix FROM {_both('paths', PATHS, 'id, path')})
SELECT id, suffix, suffix IN ({", ".join(f"'{k}'" for k in X.SUFFIX_TYPES)}) AS supported, {_MEDIA} WHEN '.gz' THEN 'application/octet-stream' ELSE 'application/octet-stream' END AS media_type FROM s""",
    "cache_names": rf"SELECT id, left(coalesce(nullif(trim(regexp_replace(source_id, '[^A-Za-z0-9_.-]+', '_', 'g'), '._'), ''), 'source'), 80) || '-' || substr(sha256(source_id || chr(31) || path), 1, 16) || '.jsonl' AS name FROM {_both('ids', SOURCE_IDS, 'id, source_id, path')}",
    "json_lists": rf"""WITH p AS (SELECT id, coalesce(cell, '') AS cell FROM {_both('lists', LISTS, 'id, cell')}), q AS (SELECT id, CASE WHEN json_valid(cell) AND json_type(cell) = 'ARRAY' THEN list_filter([CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' END FOR x IN CAST(cell AS JSON[])], lambda y: y IS NOT NULL) WHEN json_valid(cell) THEN [] ELSE list_filter([trim(y) FOR y IN string_split(cell, '|')], lambda y: y <> '') END AS l FROM p)
SELECT id, CAST(to_json(l) AS VARCHAR) AS encoded, len(l) AS n FROM q""",
    "local_links": rf"""SELECT id, link NOT LIKE '%://%' OR link LIKE 'file:%' AS is_local, CASE id WHEN 1 THEN '/base/dir/http:/example.org/a.pdf' WHEN 2 THEN '/tmp/a b.pdf' WHEN 3 THEN replace(link, '\', '/') WHEN 4 THEN '/base/dir/b.pdf' WHEN 5 THEN '/base/dir/ftp:/x' WHEN 6 THEN replace(link, '/./', '/') ELSE CASE (id - 1000) % 3 WHEN 0 THEN '/base/dir/' || replace(link, './x/../', '') WHEN 1 THEN '/lib/n ' || (id - 1000) ELSE '/base/dir/' || replace(link, '//', '/') END END AS path FROM {_both('links', LINKS, 'id, link')}""",
    "file_hashes": "SELECT doc_id, sha256(text) AS sha256, 'target-' || sha256(text) AS document_id FROM documents",
    "support_joint": f"{_CLAIMS} SELECT * FROM j",
    "support_matrix": f"{_CLAIMS} SELECT claim_id, source_id, function, label, joint, classifiable, supporting FROM mx",
    "support_measures": f"""{_CLAIMS}, e AS (SELECT *, has_citation AND coalesce(joint, '') = 'unverifiable' AS o, has_citation AND coalesce(joint, '') = 'full' AS fu FROM j WHERE eligible),
c AS (SELECT count(*) AS eligible, count(*) FILTER (NOT o) AS classifiable, count(*) FILTER (fu AND NOT o) AS supported FROM e),
a AS (SELECT count(*) AS associations, count(*) FILTER (classifiable) AS classifiable_associations, count(*) FILTER (classifiable AND supporting) AS supporting_associations FROM mx)
SELECT *, round(supported / nullif(classifiable, 0), 4) AS recall_verified, round(supporting_associations / nullif(classifiable_associations, 0), 4) AS precision_verified,
CASE WHEN classifiable = eligible THEN round(supported / nullif(eligible, 0), 4) END AS recall_whole, CASE WHEN associations = classifiable_associations THEN round(supporting_associations / nullif(associations, 0), 4) END AS precision_whole,
round(classifiable / nullif(eligible, 0), 4) AS audit_coverage FROM c, a""",
    "support_coverage": f"""{_CLAIMS}, u AS (SELECT source_id, bool_and(classifiable) AS usable FROM mx GROUP BY 1), x AS (SELECT readable AND coalesce(usable, true) AS analyzed FROM expected LEFT JOIN u USING (source_id))
SELECT count(*) AS expected, count(*) FILTER (analyzed) AS analyzed, round(count(*) FILTER (analyzed) / nullif(count(*), 0), 4) AS coverage FROM x""",
    "support_diagnostics": f"""{_CLAIMS} SELECT 'uncited claims' AS kind, count(*) FILTER (eligible AND NOT has_citation) AS n FROM j UNION ALL SELECT 'claims not fully supported', count(*) FILTER (eligible AND has_citation AND joint = 'not_full') FROM j
UNION ALL SELECT 'claims left open', count(*) FILTER (eligible AND has_citation AND joint = 'unverifiable') FROM j UNION ALL SELECT 'contradicting citations', count(*) FILTER (label = 'contradicts') FROM mx
UNION ALL SELECT 'citations without support', count(*) FILTER (label = 'none') FROM mx UNION ALL SELECT 'unverifiable citations', count(*) FILTER (label = 'unverifiable') FROM mx
UNION ALL SELECT 'unreadable sources', count(*) FILTER (NOT readable) FROM expected UNION ALL SELECT 'sources never cited', count(*) FROM expected WHERE source_id NOT IN (SELECT source_id FROM mx)""",
    "support_missing": f"{_CLAIMS} SELECT claim_id FROM claims WHERE eligible AND claim_id NOT IN (SELECT claim_id FROM cit)",
    "support_affected": f"{_CLAIMS} SELECT source_id, count(DISTINCT claim_id) AS n_claims, coalesce(min(claim_id), -1) AS first_claim FROM expected LEFT JOIN cit USING (source_id) WHERE NOT readable GROUP BY 1",
}
SQL["support_labels"] = f"{_CLAIMS} SELECT label, count(claim_id) AS n FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in U.LABELS) + "]) AS label) LEFT JOIN cit USING (label) GROUP BY 1"
SQL["support_scorecard"] = f"""{_CLAIMS}, e AS (SELECT *, has_citation AND coalesce(joint, '') = 'unverifiable' AS o, has_citation AND coalesce(joint, '') = 'full' AS fu FROM j WHERE eligible),
c AS (SELECT count(*) AS el, count(*) FILTER (NOT o) AS cl, count(*) FILTER (fu AND NOT o) AS su FROM e), a AS (SELECT count(*) AS al, count(*) FILTER (classifiable) AS ca, count(*) FILTER (classifiable AND supporting) AS sa FROM mx),
u AS (SELECT source_id, bool_and(classifiable) AS usable FROM mx GROUP BY 1), x AS (SELECT count(*) AS ex, count(*) FILTER (readable AND coalesce(usable, true)) AS an FROM expected LEFT JOIN u USING (source_id)),
r AS (SELECT 'citation recall, whole scope' AS measure, su AS numerator, el AS denominator, cl = el AS shown FROM c UNION ALL SELECT 'citation precision, whole scope', sa, al, ca = al FROM a
UNION ALL SELECT 'citation recall, verified subset', su, cl, true FROM c UNION ALL SELECT 'citation precision, verified subset', sa, ca, true FROM a UNION ALL SELECT 'audit coverage', cl, el, true FROM c UNION ALL SELECT 'corpus coverage', an, ex, true FROM x)
SELECT measure, numerator, denominator, CASE WHEN shown THEN round(numerator / nullif(denominator, 0), 4) END AS value FROM r"""
_NO_SQL = (html_blocks, html_diagnostics)  # what a parser keeps has no SQL
QUERIES = {name: globals()[name] for name in SQL} | {f.__name__: f for f in _NO_SQL}
