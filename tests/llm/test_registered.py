"""The registered queries over whole tables: against DuckDB, the libraries, brute force and held-out labels."""

import base64
import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from attesta.llm import packing, queries, urls


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return {i: t or "" for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}


def run(spark, sf, name, key="doc_id"):
    rows = queries.QUERIES[name](spark, sf).collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    found = queries.QUERIES[name](spark, sf)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    assert sorted(found.columns) == names
    ours, theirs = sorted(tuple(r[n] for n in names) for r in found.select(*names).collect()) if "rule" not in names else None, want.fetchall()
    theirs = [tuple(r[i] for i in at) for r in theirs]
    if ours is None:
        ours, theirs = sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr), sorted(theirs, key=repr)
    assert ours == sorted(theirs, key=None if "rule" not in names else repr)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_of_every_document(spark, sf, documents, vocabulary):
    library, found, start = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), run(spark, sf, "op2_token_binary"), 0
    for i in sorted(documents):
        ids = library.encode(documents[i], add_special_tokens=False).ids + [1]
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_every_document_as_the_library_encodes_it(spark, sf, documents, vocabulary):
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = run(spark, sf, "op4_byte_bpe")
    for i, text in documents.items():
        ids = library.encode_ordinary(text)
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_every_document_is_packed(spark, sf, documents, vocabulary):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = queries.QUERIES["op5_mixture_packing"](spark, sf).collect()
    whole = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in documents.items()}
    next_ = dict.fromkeys(whole, 0)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = whole[r["doc_id"]]
        assert r["start"] == next_[r["doc_id"]] and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        next_[r["doc_id"]] += r["length"]
    assert next_ == {i: len(ids) for i, ids in whole.items()}
    end = 0
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * packing.WINDOW + r["offset"] == end and r["offset"] + r["length"] <= packing.WINDOW
        end += r["length"]
    assert max(r["sequence_id"] for r in rows) == -(-end // packing.WINDOW) - 1


def test_url_verdicts_without_a_rule_equal_a_plain_model(spark, sf, duck):
    """The same sample, counted and smoothed with dictionaries of tuples."""
    found = run(spark, sf, "op6_url_filter", "page_id")
    rules = {r["page_id"]: r["rule_verdict"] for r in queries.QUERIES["url_rules"](spark, sf).collect()}
    rest = {i: (u or "").partition("://")[2] for i, u in duck.execute("SELECT page_id, url FROM pages").fetchall()}
    host = lambda x: x[: min((x.index(c) for c in "/?#" if c in x), default=len(x))]
    rest = {i: host(x).lower() + x[len(host(x)) :] for i, x in rest.items()}
    good, bad = ({rest[i] for i, v in rules.items() if v == kind and rest[i]} for kind in ("allow", "block"))
    held = lambda x: zlib.crc32(x.encode()) % 4 == 0

    def model(texts):
        count = collections.Counter()
        for t in texts:
            t = "\x02" + t + "\x03"
            for i in range(1, len(t)):
                for n in range(min(urls.ORDER, i) + 1):
                    count[t[i - n : i], t[i]] += 1
        after = collections.defaultdict(dict)
        for (context, c), n in count.items():
            after[context][c] = n

        def p(context, c):
            out, size = 1 / 256, 0
            while size <= len(context):
                seen = after.get(context[len(context) - size :])
                if not seen or (size and sum(seen.values()) < 2):
                    break
                out, size = (seen.get(c, 0) + len(seen) * out) / (sum(seen.values()) + len(seen)), size + 1
            return out

        return p

    pb, pg = model(x for x in bad if not held(x)), model(x for x in good if not held(x))

    def score(t):
        t = "\x02" + t + "\x03"
        return sum(np.log(pb(t[max(0, i - urls.ORDER) : i], t[i])) - np.log(pg(t[max(0, i - urls.ORDER) : i], t[i])) for i in range(1, len(t))) / (len(t) - 1)

    _, cut = urls.fit(sorted(good), sorted(bad))
    for i, r in found.items():
        want = score(rest[i]) if rest[i] else 0.0
        assert r["score"] == pytest.approx(want, abs=1e-9)
        assert r["verdict"] == (rules[i] or ("block" if rest[i] and want > cut else "allow"))


def test_held_out_languages_and_qualities(spark, sf, duck, documents):
    lang, quality = (dict(duck.execute(q).fetchall()) for q in ("SELECT doc_id, lang FROM documents", "SELECT doc_id, quality FROM labels"))
    found = run(spark, sf, "op7_language_id")
    seen = [i for i in documents if found[i]["held_out"] and lang[i] and found[i]["lang_pred"] != "und"]
    assert np.mean([found[i]["lang_pred"] == lang[i] for i in seen]) > 0.95 and len(seen) > 20
    assert all(0 <= r["score"] <= 1 for r in found.values())
    found = run(spark, sf, "op8_quality_classifier")
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found.values()) and set(found) == set(documents)
    seen = [i for i in quality if i in found and found[i]["held_out"]]
    assert np.mean([found[i]["predicted"] == quality[i] for i in seen]) >= 0.8


def test_quality_rules_keep_what_passes(spark, sf, duck):
    found = run(spark, sf, "op9_quality_rules")
    counts = {r["doc_id"]: r for r in queries.QUERIES["base_counts"](spark, sf).collect()}
    assert set(found) == set(counts)
    assert all(found[i][c] == counts[i][c] for i in found for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    passing = [r for r in found.values() if not r["base_failed"]]
    assert not any(r["kept"] for r in found.values() if r["base_failed"]) and np.mean([r["kept"] for r in passing]) > 0.8


def test_pipeline_packs_what_its_stages_leave(spark, sf, documents):
    pieces = corpus_pipeline.run(spark, sf).collect()
    by_doc = collections.Counter()
    for p in pieces:
        by_doc[p["doc_id"]] += p["length"]
    assert all(by_doc[p["doc_id"]] == p["doc_tokens"] for p in pieces) and set(by_doc) <= set(documents)
    assert len(by_doc) > 0.5 * len(documents)
