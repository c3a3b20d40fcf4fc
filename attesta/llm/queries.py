"""The queries of this subpackage by name, and their SQL where SQL can express them.

url_rules, base_counts and held_out are the parts of op6 to op9 that SQL can say: what
rules decide, the counts before any model, and which rows a fit must not see.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import binary, bpe, language, minhash, packing, perplexity, quality, repeats, topk, urls
from .common import read


def url_rules(spark, sf_dir):
    """Host, path, and the rule that decides each page's url."""
    return urls.by_rule(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "rule_verdict")


def base_counts(spark, sf_dir):
    """The counts of every document, and whether they fail it."""
    return perplexity.base_rules(read(spark, sf_dir, "documents"))


def held_out(spark, sf_dir):
    """The rows that the language and the quality model never learn from."""
    doc_id = F.col("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", language.held_out(doc_id).alias("of_language"), quality.held_out(doc_id).alias("of_quality"))


QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_token_binary": binary.op2_token_binary,
    "op3_suffix_array_dedup": repeats.op3_suffix_array_dedup,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_mixture_packing": packing.op5_mixture_packing,
    "op6_url_filter": urls.op6_url_filter,
    "op7_language_id": language.op7_language_id,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_quality_rules": perplexity.op9_quality_rules,
    "op10_exact_top_k": topk.op10_exact_top_k,
    "url_rules": url_rules,
    "base_counts": base_counts,
    "held_out": held_out,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN regexp_extract_all(CAST(doc_id AS VARCHAR), '.')]), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"
_RULES = "(VALUES " + ", ".join(f"('{k}', '{h}', '{p}')" for k, h, p in urls.RULES) + ") AS r(verdict, h, p)"

ORACLE_SQL: dict[str, str] = {
    # every pair of texts that shares a shingle, and the classes that links make; 0.8 of weighted Jaccard similarity
    "op1_minhash_near_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS t FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE [array_to_string(t[i:i + 4], ' ') FOR i IN range(1, len(t) - 3)] END) AS gram FROM w WHERE len(t) > 0),
s AS (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY ALL), n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS k FROM s a JOIN s b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)),
links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT links.b, root FROM reach JOIN links ON links.a = node),
c AS (SELECT node AS doc_id, min(root) AS class_id FROM reach GROUP BY node)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM documents JOIN c USING (doc_id)""",
    # every window of 200 bytes by its hexadecimal digits
    "op3_suffix_array_dedup": """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM h WHERE n >= 200)),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
m AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r),
g AS (SELECT doc_id, span, min(i) AS lo, max(i) + 200 AS hi FROM m GROUP BY doc_id, span),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM g),
f AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans, max(hi) AS last, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS front FROM k JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(front, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN f USING (doc_id)""",
    "op10_exact_top_k": """WITH v AS (SELECT row_number() OVER () AS row, vec_id, [floor(256.0 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.row <> v.row WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "url_rules": f"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
b AS (SELECT page_id, x, regexp_extract(x, '^[^/?#]*') AS raw FROM u), c AS (SELECT page_id, translate(raw, '{urls._UPPER}', '{urls._LOWER}') AS host, regexp_extract(substr(x, length(raw) + 1), '^[^?#]*') AS path FROM b),
f AS (SELECT page_id, r.h || r.p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC) AS k FROM c JOIN {_RULES} ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p))
SELECT page_id, host, path, rule, verdict AS rule_verdict FROM c LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (page_id)""",
    "base_counts": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS t FROM documents),
l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM l GROUP BY doc_id),
five AS (SELECT doc_id, i, array_to_string(t[i:i + 4], ' ') AS gram FROM (SELECT doc_id, t, unnest(range(1, len(t) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM five),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE c > 1 GROUP BY doc_id),
a AS (SELECT doc_id, len(t) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN t]), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a""",
    "held_out": f"WITH c AS (SELECT doc_id, xor({_CRC}, 4294967295) AS crc FROM documents) SELECT doc_id, crc % 4 = 2 AS of_language, crc % 5 = 0 AS of_quality FROM c",
}
