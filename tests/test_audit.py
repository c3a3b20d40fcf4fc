"""The runs end to end, over files."""

import http.server
import json
import os
import re
import sys
import threading
import types
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from attesta import scratch
from attesta.functions import text as X
from attesta.operators import cache as K
from attesta.plans import audit
from attesta.sources import bibliography as B
from attesta.sources import documents as D
from attesta.sources import live
from attesta.sources import manifest_csv as V
from attesta.streaming import incremental


def write(folder: Path, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def test_manifest_run(spark, tmp_path):
    lib = write(tmp_path / "lib", good__md="Readable source text.", bad__docx="not a zip")
    paper = write(tmp_path / "in", paper__md="Claim [@good; @missing].")
    request = audit.Request(str(tmp_path / "cache"), [paper], [lib], output=str(tmp_path / "out"), fail_on_missing=True)
    done = audit.run(spark, request)
    assert done.summary == {"expected": 3, "resolved": 2, "extracted": 1, "analyzed": 1, "missing": 1, "ambiguous": 0, "unusable": 1, "coverage_percent": 33.33}
    assert done.code == 2 and done.diagnostics == []
    again = audit.run(spark, audit.Request(str(tmp_path / "cache"), [paper], [lib]))
    assert again.summary["extracted"] == 0 and again.summary["analyzed"] == 1 and again.code == 0
    back = V.read(spark, request.output, str(tmp_path))
    assert back.count() == 3 and back.filter("bibliography_key = 'missing'").head()["mapping_status"] == "unresolved"
    merged = audit.run(spark, audit.Request(str(tmp_path / "cache"), [paper], manifests=[request.output]))
    assert (merged.summary["expected"], merged.summary["missing"], merged.summary["analyzed"]) == (3, 1, 1)


def test_targets_that_fail_are_diagnostics(spark, tmp_path):
    lib = write(tmp_path / "lib", good__txt="Text.")
    bad = write(tmp_path / "in", bad__docx="no")
    (tmp_path / "void").mkdir()
    done = audit.run(spark, audit.Request(str(tmp_path / "cache"), [bad, str(tmp_path / "void")], [lib]))
    assert sorted(d["extraction_status"] for d in done.diagnostics) == ["error:BadZipFile", "error:NoSupportedTargets"] and done.code == 2
    with pytest.raises(FileNotFoundError):
        audit.run(spark, audit.Request(str(tmp_path / "cache"), [str(tmp_path / "absent.md")]))


def test_cache_run_keeps_missing_and_falls_back(spark, tmp_path):
    lib = write(tmp_path / "lib", a__txt="", b__txt="usable")
    bib = write(tmp_path / "refs", r__bib=f"@article{{k, title={{T}}, file={{:{lib}/a.txt:text;:{lib}/b.txt:text}}}}")
    done = audit.run(spark, audit.Request(str(tmp_path / "cache"), sources=[f"{tmp_path}/gone.pdf"], bibliographies=[bib + "/r.bib"]))
    assert (done.summary["expected"], done.summary["missing"], done.summary["extracted"]) == (2, 1, 1)
    row = done.rows.filter("title = 'T'").head()
    assert row["source_path"].endswith("b.txt") and any("attachment attempt" in c and "a.txt" in c for c in row["conflicts"])


def test_no_input_is_a_gap(spark, tmp_path):
    paper = write(tmp_path / "in", paper__md="No citation.")
    done = audit.run(spark, audit.Request(str(tmp_path / "cache"), [paper], fail_on_missing=True))
    assert done.summary["expected"] == 0 and done.summary["coverage_percent"] is None and done.code == 2


def test_three_formats_name_one_source(spark, tmp_path):
    folder = write(
        tmp_path / "refs",
        a__bib="@article{k, title={Costs}, author={Doe, Jane and Ana de la Cruz}, year={2024}, doi={10.1000/ABC.def}}",
        a__ris="TY  - JOUR\nTI  - Costs\nAU  - Doe, Jane\nAU  - Ana de la Cruz\nPY  - 2024\nDO  - https://doi.org/10.1000/abc.def\nER  - \n",
        a__json='[{"id":"k","title":"Costs","author":[{"given":"Jane","family":"Doe"},{"given":"Ana","non-dropping-particle":"de la","family":"Cruz"}],"issued":{"date-parts":[[2024]]},"DOI":"10.1000/abc.def"}]',
    )
    found = B.load(spark, [f"{folder}/a.{s}" for s in ("bib", "ris", "json")])
    assert {(r["source_id"], tuple(r["authors"]), r["year"]) for r in found.collect()} == {("doi:10.1000/abc.def", ("Jane Doe", "Ana de la Cruz"), 2024)}
    with pytest.raises(B.UnsupportedExport):
        B.load(spark, ["x.xml"])


def test_stream_extracts_only_what_is_new(spark, tmp_path):
    folder = write(tmp_path / "in", a__txt="one\ntwo")
    cache = str(tmp_path / "cache")
    incremental.follow(spark, folder, cache, str(tmp_path / "cp")).awaitTermination()
    read = lambda: K.read(spark, cache + "/entries")
    assert read().count() == 2 and K.validity(read()).filter("valid").count() == 1
    write(tmp_path / "in", b__md="# H\n\npara")
    incremental.follow(spark, folder, cache, str(tmp_path / "cp")).awaitTermination()
    assert K.validity(read()).filter("valid").count() == 2


def test_truncated_cache_is_invalid(spark, tmp_path):
    folder = write(tmp_path / "in", a__txt="one\ntwo")
    cache = str(tmp_path / "cache")
    incremental.follow(spark, folder, cache, str(tmp_path / "cp")).awaitTermination()
    held = K.read(spark, cache + "/entries")
    assert K.validity(held.filter("block_index = 1")).head()["valid"] is False
    assert "_" not in held.select(X.suffix("source_id")).head()[0]


class Shelf:
    """A made-up local service: routes to payloads, or to errors to raise."""

    def __init__(self, **routes):
        self.routes = routes

    def __call__(self, route):
        said = self.routes.get(route.removeprefix("/api/users/0/items").split("&")[0], [])
        if isinstance(said, Exception):
            raise said
        return said


def test_live_answers(tmp_path):
    there = tmp_path / "a b.pdf"
    there.write_text("x")
    pdf = lambda key, when: {"data": {"key": key, "filename": "X.PDF", "dateModified": when}}
    item = {"data": {"key": "I", "citationKey": "k", "title": "T", "creators": [{"creatorType": "author", "name": "ACME"}, 3], "date": "1 May 1987"}}
    shelf = Shelf(**{
        "?q=k": [item, item, {"key": "J", "extra": "citation key: other"}], "/I/children": [pdf("old", "1"), pdf("new", "2"), pdf("mid", "15"), {"key": "web"}],
        "/new/file/view/url": OSError("gone"), "/mid/file/view/url": {"path": "", "url": f"file://{tmp_path}/a%20b.pdf"}, "/given/file/view/url": str(tmp_path / "absent.pdf"),
        "?q=two": [{"key": "A", "extra": "x\nCitation Key:  two \n"}, {"key": "B", "citationKey": "two"}], "/lone": {"key": "lone", "citationKey": "k"}, "/bad": ValueError("no"),
    })
    got = live.ask(shelf, "k", attachment="given")
    assert (got["status"], got["aliases"], got["local_files"], got["title"], len(got["creators"])) == ("enriched", ["k", "I", "given", "new", "mid"], [str(there)], "T", 1)
    assert live.ask(shelf, "two") == {"key": "two", "status": "ambiguous", "candidates": ["A", "B"]}
    assert live.ask(shelf, "none")["status"] == "not_found" and live.ask(shelf, "x", item="list")["status"] == "not_found"
    assert live.ask(shelf, "k", item="lone")["status"] == "enriched" and live.ask(shelf, "k", item="lone", attachment="given")["status"] == "attachment_unresolved"
    shelf.routes["/I/children"] = ValueError("no json")
    assert live.ask(shelf, "k")["status"] == "attachment_unresolved"


def test_live_service_over_http(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            assert self.headers["Accept"] == "application/json"
            if "missing" in self.path:
                return self.send_error(404)
            if "broken" in self.path:
                return self.send_error(500)
            said = json.dumps([{"key": "I", "citationKey": "here", "DOI": "10.1000/x"}] if "q=here" in self.path and "limit=25" in self.path else [])
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(said.encode())

        def log_message(self, *args):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        asked = spark.createDataFrame([("here",), ("nowhere",), ("missing",), ("broken",)], "key string")
        answers = live.look_up(asked, live.Service(f"http://127.0.0.1:{server.server_port}/", 2.0)).collect()
        server.shutdown()
    assert {r["key"]: r["status"] for r in answers} == {"here": "enriched", "nowhere": "not_found", "missing": "not_found", "broken": "error:http_500"}
    gone = live.look_up(asked, live.Service("http://127.0.0.1:9", 0.2))
    assert {r["status"] for r in gone.collect()} == {"unavailable"}
    with pytest.raises(Exception, match="not available"):
        live.look_up(asked, live.Service("http://127.0.0.1:9", 0.2), required=True).collect()


def test_manifest_run_with_live_look_up(spark, tmp_path):
    made_up = lambda route: [{"key": "I9", "citationKey": "good", "title": "Live", "DOI": "10.1000/live"}] if "q=good" in route else []
    paper = write(tmp_path / "in", paper__md="Claim [@good; @other].")
    done = audit.run(spark, audit.Request(str(tmp_path / "cache"), [paper], live=True, fetch=made_up))
    rows = {r["bibliography_key"]: r for r in done.rows.collect()}
    assert rows["good"]["source_id"] == "doi:10.1000/live" and rows["good"]["mapping_status"] == "resolved"
    assert rows["other"]["mapping_rule"] == "zotero-live" and any("not_found" in c for c in rows["other"]["conflicts"])


def test_readers_of_the_callers_own(spark, tmp_path):
    lib = write(tmp_path / "lib", a__txt="plain")
    shout = lambda content: (([("b", content.decode().upper(), "line", "1", "h")], []), "own", "extracted", "good")
    done = audit.run(spark, audit.Request(str(tmp_path / "cache"), sources=[lib], readers={".txt": shout}))
    assert done.summary["extracted"] == 1
    held = K.read(spark, str(tmp_path / "cache" / "entries")).head()
    assert (held["text_original"], held["extraction_method"]) == ("PLAIN", "own")


def test_cache_keeps_what_a_write_does_not_name(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BUCKETS", 2)
    path = str(tmp_path / "entries")
    assert K.read(spark, path).count() == 0

    def rows(names, text):
        made = spark.createDataFrame([(n, i + 1, text) for n in names for i in range(2)], "file string, block_index int, text_original string")
        return made.select(*(F.col(c) if c in made.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in (K.CACHE + ", file string").split(", "))))

    K.write(rows([f"f{i}" for i in range(9)], "old"), path)
    K.write(rows(["f3", "f9"], "new"), path)
    got = {}
    for r in K.read(spark, path).collect():
        got.setdefault(r["file"], []).append(r["text_original"])
    assert got == {f"f{i}": ["new" if i in (3, 9) else "old"] * 2 for i in range(10)}


def test_pdf_falls_back_to_a_library(monkeypatch):
    monkeypatch.setattr(D.shutil, "which", lambda name: None)
    monkeypatch.setitem(sys.modules, "pypdf", None)
    with pytest.raises(RuntimeError, match="pypdf"):
        D.pdf_texts(b"%PDF")
    page = lambda text: types.SimpleNamespace(extract_text=lambda: text)
    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=lambda file: types.SimpleNamespace(pages=[page("word " * 60), page(None)])))
    assert D.pdf_texts(b"%PDF") == (["word " * 60, ""], "pypdf")
    parsed, method, status, quality = D.READERS[".pdf"](b"%PDF")
    assert (len(parsed[0]), method, status, quality) == (1, "pypdf", "extracted", "good")
    with pytest.raises(FileNotFoundError):
        D.READERS[".doc"](b"x")


def test_pdf_and_doc_tools(tmp_path, monkeypatch):
    """Stand-ins for the two programs, which are not here."""
    from test_formats import package

    (tmp_path / "pdftotext").write_text("#!/bin/sh\nprintf 'one\\f\\nthree\\f'\n")
    (tmp_path / "made.docx").write_bytes(package("<w:p><w:r><w:t>From an old file</w:t></w:r></w:p>"))
    (tmp_path / "soffice").write_text(f'#!/bin/sh\ncp {tmp_path}/made.docx "$5/in.docx"\n')
    for tool in ("pdftotext", "soffice"):
        (tmp_path / tool).chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    assert D.pdf_texts(b"") == (["one", "\nthree"], "pdftotext-layout")
    parsed, method, *_ = D.READERS[".doc"](b"x")
    assert parsed[0][0][1] == "From an old file" and method == "soffice-docx"


def test_earlier_sums_of_long_arrays(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([5],), (list(range(1000)),)], "a array<int>")
    for given, got in ((r["a"], r["b"]) for r in rows.withColumn("b", X.before(F.col("a"), 7)).collect()):
        assert got == [sum(given[:i]) for i in range(len(given))]


def test_folding_of_plain_and_other_texts(spark):
    texts = ["Plain  TEXT\n x-\n y", "ﬁne Straße É x", "a\x1cb\x1f C", "", None, "co-\n operate", "é-\n\ng"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [" ".join(re.sub(r"(?<=\w)-\s*\n\s*(?=\w)", "", unicodedata.normalize("NFKC", t or "")).split()).casefold() for t in texts]
    assert [r["n"] for r in rows.select("i", X.normalize_text("t").alias("n")).orderBy("i").collect()] == want


def test_scratch_tables_go(spark):
    table = scratch.stage(spark.range(3), "here")
    path = table.__dict__["_attesta_table"]
    assert scratch.exists(spark, path) and table.count() == 3
    scratch.forget(table, None, spark.range(1))
    assert not scratch.exists(spark, path)


def test_arrivals_are_counted_once_their_hour_is_past(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:05:00", "b"), ("2024-01-03 09:00:00", "a")]
    table = spark.createDataFrame(rows, "arrived string, media_type string").selectExpr("to_timestamp(arrived) AS arrived", "media_type")
    table.coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = incremental.arrivals(stream).selectExpr("hour(window.start) AS hour", "media_type", "n")
    found.writeStream.outputMode("append").format("memory").queryName("arrived").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("arrived").collect()) == [(0, "a", 2), (1, "b", 1)]  # the last hour is still open


def test_named_files_are_read_by_several_tasks(spark, tmp_path):
    lib = write(tmp_path / "lib", **{f"f{i}__txt": f"text {i}" for i in range(40)})
    paths = spark.createDataFrame([(f"{lib}/f{i}.txt",) for i in range(41)] * 2, "path string").repartition(3).distinct()
    for content in (True, False):
        found = D.opened(paths, content).withColumn("task", F.spark_partition_id()).collect()
        assert len(found) == 41 and [r["path"] for r in found if r["sha256"] is None] == [f"{lib}/f40.txt"]
        assert len({r["task"] for r in found}) > 1
