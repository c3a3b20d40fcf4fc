"""Mapping, merging, similarity and support on the small cases of the rules."""

from pyspark.sql import functions as F

from attesta.functions import identity as I
from attesta.functions import text as X
from attesta.operators import manifest as M
from attesta.operators import mapping as P
from attesta.operators import similarity as S
from attesta.operators import support as U

BLANK = {"provider": "", "title": "", "authors": [], "year": None, "doi": "", "source_path": "", "media_type": "", "source_sha256": "", "targets": [], "mapping_rule": "none", "candidate_source_ids": [], "extraction_status": "not_run", "text_quality": "unknown", "cache_path": "", "conflicts": [], "aliases": [], "source_id": "", "bibliography_key": "", "mapping_status": "unresolved"}


def rows(spark, *given):
    return spark.createDataFrame([tuple((BLANK | g)[n] for n in M.NAMES) for g in given], M.ROW)


def sources(spark, *given):
    full = {"aliases": [], "title": "", "authors": [], "year": None, "doi": "", "url": "", "local_files": [], "provider": "t"}
    names = [c.split()[0] for c in I.SOURCE.split(", ")]
    return spark.createDataFrame([tuple((full | g)[n] for n in names) for g in given], I.SOURCE)


def mentions(spark, *given):
    return spark.createDataFrame(list(given), "path string, raw_text string, citation_keys array<string>, locator_type string, locator_value string")


def test_normalize_text(spark):
    found = spark.createDataFrame([("inter-\nnational  TEST",), ("Ｆｕｌｌｗｉｄｔｈ Straße",), ("",), (None,)], "t string").select(X.normalize_text("t").alias("n")).collect()
    assert [r["n"] for r in found] == ["international test", "fullwidth strasse", "", ""]


def test_authors_and_doi(spark):
    one = spark.range(1).select(I.normalize_authors(F.array(F.lit("Research, Development"), F.lit("Doe, Jane")), F.array(F.lit(True), F.lit(False))).alias("a"), I.normalize_doi(F.lit("doi:10.1000/example(1).")).alias("d")).head()
    assert one["a"] == ["Research, Development", "Jane Doe"] and one["d"] == "10.1000/example(1)"


def test_raw_records_can_be_ambiguous_where_coalesced_are_not(spark):
    three = sources(spark, {"source_id": "a", "title": "Zed"}, {"source_id": "a", "title": "Zed"}, {"source_id": "b", "title": "zed"})
    request = spark.createDataFrame([("r", "", [], "Zed", [], None, [])], P.REQUEST)
    assert P.map_sources(request, three).head()["status"] == "ambiguous"
    assert P.map_sources(request, P.coalesce_sources(three.filter("source_id = 'a'"))).head()["source_ids"] == ["a"]


def test_coalesce_conflicts_and_order(spark):
    found = P.coalesce_sources(sources(spark, {"source_id": "a", "title": "b", "year": 2001, "local_files": ["/2"]}, {"source_id": "a", "title": "A", "year": 2000, "local_files": ["/1"], "authors": ["X", "B"]})).head()
    assert (found["title"], found["year"], found["authors"]) == ("A", 2000, ["X", "B"])
    assert found["conflicts"] == ["title: A <> b", "year: 2000 <> 2001", "local_files: /1 <> /2"]


def test_build_unresolved_uncited_and_keyless(spark):
    src = sources(spark, {"source_id": "cited", "aliases": ["Key"]}, {"source_id": "uncited"})
    cited = mentions(spark, ("a.md", "@key", ["key"], "line", "1"), ("a.md", "@missing", ["missing"], "line", "2"), ("b.md", "(Smith, 2020)", [], "line", "3"))
    found = {r["bibliography_key"] or r["source_id"]: r for r in M.build(cited, src).collect()}
    assert len(found) == 4 and found["key"]["source_id"] == "cited" and found["missing"]["mapping_status"] == "unresolved"
    assert found["uncited"]["mapping_rule"] == "explicit-corpus"
    (visible,) = (r for k, r in found.items() if k.startswith("visible:"))
    assert visible["mapping_rule"] == "visible-citation" and visible["targets"][0]["locator"] == "line:3"


def test_pairs_stay_paired(spark):
    src = sources(spark, {"source_id": "s", "aliases": ["k"]})
    one = M.build(mentions(spark, ("b.md", "", ["k"], "line", "1"), ("a.md", "", ["k"], "line", "2")), src).head()
    assert [(p["file"], p["locator"]) for p in one["targets"]] == [("a.md", "line:2"), ("b.md", "line:1")]


def test_key_absorbed_unless_ambiguous(spark):
    imported = rows(spark, {"bibliography_key": "b", "aliases": ["b"]}, {"bibliography_key": "c", "aliases": ["c"]})
    generated = rows(spark, {"source_id": "s", "bibliography_key": "a", "aliases": ["a", "b"], "mapping_status": "resolved"})
    found = M.merge(imported, generated, spark.createDataFrame([("a", "s"), ("b", "s")], "key string, now string")).collect()
    assert sorted((r["source_id"], r["bibliography_key"]) for r in found) == [("", "c"), ("s", "a")]


def test_two_imported_rows_of_one_key_are_one_or_stay(spark):
    imported = rows(spark, {"bibliography_key": "x"}, {"bibliography_key": "x"})
    generated = rows(spark, {"source_id": "x", "bibliography_key": "x", "mapping_status": "resolved"})
    found = M.merge(imported, generated, spark.createDataFrame([("x", "x")], "key string, now string")).collect()
    assert [(r["source_id"], r["mapping_status"]) for r in found] == [("x", "resolved")]


def test_imported_paths_conflict(spark):
    one = M.coalesce_imported(rows(spark, {"source_id": "s", "source_path": "/b", "bibliography_key": "k"}, {"source_id": "s", "source_path": "/a"})).head()
    assert one["source_path"] == "/a" and one["conflicts"] == ["source_path: /a <> /b"]


def test_summary_counts_a_row_twice_if_ambiguous_and_missing(spark):
    cached = spark.createDataFrame([], "source_id string, extraction_status string, text_quality string, reused boolean")
    one = M.summary(rows(spark, {"mapping_status": "ambiguous", "extraction_status": "missing"}), cached).head()
    assert (one["missing"], one["ambiguous"], one["resolved"], one["coverage_percent"]) == (1, 1, 0, 0.0)
    empty = M.summary(rows(spark, {}).limit(0), cached)
    assert empty.head()["expected"] == 0 and empty.head()["coverage_percent"] is None
    assert M.exit_code(empty, 0, True).head()["code"] == 2 and M.exit_code(empty, 0, False).head()["code"] == 0


def test_positions_of_two_sources_are_counted_once(spark):
    matches = spark.createDataFrame([(1, 2, "A"), (1, 3, "A"), (1, 4, "A"), (1, 4, "B"), (1, 5, "B")], "doc int, pos int, source string")
    words = spark.createDataFrame([(1, 10)], "doc int, n_words bigint")
    assert S.overall(matches, words).head()["similarity"] == 40.0
    assert S.overall(matches.filter("source <> 'A'"), words).head()["similarity"] == 20.0


def test_withheld_scores_and_bands(spark):
    words = spark.createDataFrame([(1, 1000), (2, 0)], "doc int, n_words bigint")
    matches = spark.range(1, 301).select(F.lit(1).alias("doc"), F.col("id").alias("pos"))
    gone = spark.createDataFrame([(1, 1, 100)], "doc int, first int, last int")
    fewer, marked = S.exclude_words(gone, words, matches.withColumn("adjusted", F.col("pos") % 2 == 0))
    raw = S.overall_where(marked, fewer, adjusted="adjusted_words")
    partial = spark.createDataFrame([("a", True), ("b", False)], "source string, analyzed boolean")
    card = {r["doc"]: r for r in S.scorecard(raw, S.corpus_coverage(partial)).collect()}
    assert (card[1]["adjusted_words"], card[1]["adjusted_matched"], card[1]["adjusted"]) == (900, 100, 11.1111)
    assert (card[1]["raw"], card[1]["band"], card[1]["label"], card[1]["route"]) == (30.0, "Medium", "Partial", "partial")
    assert card[2]["raw"] is None and card[2]["route"] == "stop"
    none = S.corpus_coverage(partial.withColumn("analyzed", F.lit(False)))
    assert S.scorecard(raw, none).filter("doc = 1").head()["raw"] is None


def test_spans_merge_shared_ngrams_of_one_distance(spark):
    docs = spark.createDataFrame([(1, "x\na b c d e f g h i\nq a b c d"), (2, None)], "doc_id int, text string")
    sources = spark.createDataFrame([(7, "0 0 a b c d e f zz\nf g h i a b c d")], "item_id int, text string")
    left, right = S.shingles(docs, "doc_id", "text"), S.shingles(sources, "item_id", "text")
    found = {tuple(r) for r in S.spans(left, right).collect()}
    assert found == {(1, 2, 7, 1, 2, 7, 3), (1, 2, 7, 2, 7, 10, 10), (1, 2, 7, 2, 2, 5, 14), (1, 3, 7, 1, 12, 15, 3), (1, 3, 7, 2, 12, 15, 14)}
    each = S.candidates(left, right)
    assert each.count() == each.distinct().count() == 6 + 4 * 4
    assert S.overall(each, S.word_counts(docs, "doc_id", "text")).filter("doc = 1").head()["matched"] == 13


def test_passages_split_where_the_distance_changes(spark):
    rows_ = [(1, p, p + 10) for p in (1, 2, 3)] + [(1, 4, 30)]
    found = S.passages(spark.createDataFrame(rows_, "doc int, pos int, source_pos int"), ["doc"]).orderBy("first").collect()
    assert [(r["first"], r["last"], r["n_words"]) for r in found] == [(1, 3, 3), (4, 4, 1)]


def test_support_rules(spark):
    claims = spark.createDataFrame([(1, True, True), (2, True, False), (3, True, True), (4, True, True), (5, True, True)], "claim_id int, eligible boolean, has_citation boolean")
    cites = spark.createDataFrame(
        [(1, 1, "f", "full"), (1, 2, "f", "none"), (3, 1, "f", "full"), (3, 2, "f", "contradicts"), (4, 3, "f", "unverifiable"), (4, 1, "f", "full"), (5, 3, "f", "unverifiable"), (1, 1, "f", "full")],
        "claim_id int, source_id int, function string, label string",
    )
    joint = {r["claim_id"]: r["joint"] for r in U.joint_support(claims, cites).collect()}
    assert joint == {1: "full", 2: None, 3: "not_full", 4: "full", 5: "unverifiable"}
    one = U.measures(claims, cites).head()
    assert (one["eligible"], one["classifiable"], one["supported"], one["recall_whole"], one["recall_verified"]) == (5, 4, 2, None, 0.5)
    assert (one["associations"], one["classifiable_associations"], one["supporting_associations"]) == (7, 5, 2)


def metrics(df, name):
    """A metric of every step of a plan that has run; a shuffle that is read again counts once."""
    steps, out = [df._jdf.queryExecution().executedPlan()], []
    while steps:
        step = steps.pop()
        if "ReusedExchange" in step.nodeName():
            continue
        if "AdaptiveSparkPlan" in step.nodeName():
            steps.append(step.executedPlan())
        elif "QueryStage" in step.nodeName():
            steps.append(step.plan())
        else:
            steps += [step.children().apply(i) for i in range(step.children().size())]
        if step.metrics().contains(name):
            out.append(step.metrics().apply(name).value())
    return out


def test_map_counts_equal_lists_and_pair_no_requests_with_sources(spark):
    """600 requests for a title of 600 sources: no operator makes the 360,000 pairs; several keys of one rule count a source once."""
    many = sources(spark, *({"source_id": f"s{i:03}", "title": "Zed", "aliases": [f"a{i}", f"b{i % 7}"]} for i in range(600)))
    rows = [(f"r{i:03}", "", [], "zed", [], None, []) for i in range(600)] + [("two", "", ["a1", "B1", "none"], "", [], None, []), ("lone", "", ["a5", "A5"], "", [], None, []), ("lost", "", ["x"], "", [], None, [])]
    requests = spark.createDataFrame(rows, P.REQUEST)
    counts = P.map_counts(requests, many)
    found = {r["request_id"]: r for r in counts.collect()}
    lists = {r["request_id"]: r for r in P.map_sources(requests, many).collect()}
    assert found.keys() == lists.keys() and len(found) == len(rows)
    for k, r in found.items():
        ids = lists[k]["source_ids"]
        assert (r["n"], r["first"], r["status"], r["rule"], r["note"]) == (len(ids), ids[0] if ids else "", lists[k]["status"], lists[k]["rule"], lists[k]["note"])
    assert found["r000"]["n"] == 600 and found["two"]["n"] == 86 and found["lone"]["status"] == "resolved" and found["lost"]["status"] == "unresolved"
    assert 0 < max(metrics(counts, "numOutputRows")) < 10_000


def test_manifest_build_shuffles_places_once(spark):
    """Places are the bulk of a manifest: they are dealt by key, and not again by source, nor to resolve the keys."""
    line = spark.range(40_000)
    number = F.col("id").cast("string")
    cites = line.select(F.concat(F.lit("order-"), F.sha1(number)).alias("path"), F.lit("").alias("raw_text"), F.array(F.concat(F.lit("a"), (F.col("id") % 300).cast("string"))).alias("citation_keys"), F.lit("line").alias("locator_type"), number.alias("locator_value"))
    given = sources(spark, *({"source_id": f"s{i}", "aliases": [f"a{i}", *([f"a{i + 100}"] if i < 50 else [])]} for i in range(100)))
    alone, built = M._keyed_places(cites), M.build(cites, given)
    alone.collect()
    rows = {r["source_id"] or r["bibliography_key"]: r["targets"] for r in built.collect()}
    assert len(rows) == 100 + 150 and sum(map(len, rows.values())) == 40_000
    assert len(rows["s0"]) == 267 and len(rows["s99"]) == 134 and len(rows["a299"]) == 133
    assert all([(p["file"], p["locator"]) for p in t] == sorted((p["file"], p["locator"]) for p in t) for t in rows.values())
    assert sum(metrics(built, "shuffleBytesWritten")) < 1.6 * sum(metrics(alone, "shuffleBytesWritten"))
