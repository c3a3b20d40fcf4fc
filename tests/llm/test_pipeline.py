"""The pipeline's stages take effect and keep what is clean."""

import random
import re

import corpus_pipeline
from attesta.llm import minhash, queries
from attesta.llm.common import written

random.seed(6)
SYLLABLES = ["thi", "ing", "ter", "and", "est", "ou", "re", "al"]
text = lambda n: " ".join("".join(random.choice(SYLLABLES) for _ in range(3)) for _ in range(n))


def test_run_on_planted_cases(spark, tmp_path):
    clean = [text(90) for _ in range(60)]
    copy = clean[0]
    near = " ".join(["changed", *clean[1].split()[1:]])
    passage = text(60)
    carriers = [f"{text(70)} {passage} {text(70)}" for _ in range(4)]
    junk = [" ".join(w.upper() + "!!" for w in text(90).split()) for _ in range(20)]
    texts = [*clean, copy, near, *carriers, *junk, "123 456", "", None]
    n = len(texts)
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, att_extra bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    junk_ids = set(range(66, 86))
    spark.createDataFrame([(i, int(i not in junk_ids), 0) for i in range(86)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = written(stage(spark, at, str(tmp_path)), name)
        assert at.columns == docs.columns
        left[name] = {r["doc_id"]: r["text"] for r in at.collect()}
    assert set(range(n)) - set(left["language"]) == {n - 3, n - 2, n - 1}
    assert set(left["language"]) - set(left["quality"]) == junk_ids
    assert set(left["quality"]) - set(left["near_duplicates"]) == {60, 61}
    assert set(left["repeated_passages"]) == set(left["near_duplicates"])
    assert all(passage[5:-5] not in left["repeated_passages"][i] and left["near_duplicates"][i].startswith(left["repeated_passages"][i][:50]) for i in range(62, 66))
    assert all(left["repeated_passages"][i] == texts[i] for i in range(2, 60))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == set(left["repeated_passages"])
    assert sum(p["length"] for p in pieces) == sum(d for _, d in {(p["doc_id"], p["doc_tokens"]) for p in pieces})


def test_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_further_columns_of_any_name_stay_intact(spark, tmp_path):
    taken = ["att_text", "ATT_NODE", "att_ranges", "att_id", "att_lang", "att_score", "att_sure", "text_clean", "node", "class_id", "bands", "queue", "ids", "part", "score", "id", "h", "a.b", "key"]
    texts = ["one two three four five six seven eight nine ten " + text(30) for _ in range(6)]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in taken)
    rows = [(i, t, "en", "s", len(t), *(f"{c}{i}" for c in taken)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, kinds)
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        assert sorted(tuple(r)[5:] for r in found.collect()) == sorted(r[5:] for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 6


def test_tables_of_a_few_words(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for n in range(1, 7):
        docs = spark.createDataFrame([(1, " ".join("abcdef"[:n]), "en", "s", n)], schema)
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, str(tmp_path)).count() == 1, (n, name)


def test_a_clean_text_of_three_languages_stays(spark, tmp_path):
    random.seed(9)
    stems = {"aa": ["ska", "ola", "ima"], "bb": ["tre", "ned", "ewe"], "cc": ["usu", "ruk", "gum"]}
    say = lambda lang, n: " ".join("".join(random.choice(stems[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(lang, 60), lang, "s", 1) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows.append((1000, " ".join(say(lang, 20) for lang in stems), None, "s", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {r[0] for r in rows}


def test_ten_queries_are_registered():
    numbers = [int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in queries.QUERIES) if m]
    assert sorted(numbers) == list(range(1, 11))
    assert minhash.op1_minhash_near_dedup.__doc__
