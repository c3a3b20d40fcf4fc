"""The two runs of the engine end to end: `manifest` and `cache`.

    python -m attesta.plans.audit manifest --target paper.md --source lib/ --bibliography refs.bib --cache-dir cache --output manifest
    python -m attesta.plans.audit cache --source lib/ --cache-dir cache

Targets and sources are read and extracted on the executors; the driver holds paths
that were named, the one-row summary and the target diagnostics it prints.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import identity as I
from attesta.functions import text as X
from attesta.operators import cache as K
from attesta.operators import manifest as M
from attesta.operators.mapping import coalesce_sources
from attesta.sources import bibliography as B
from attesta.sources import documents as D
from attesta.sources import live
from attesta.sources import manifest_csv as V

from .tables import stage

_MENTION = "document_id string, path string, mention_index int, raw_text string, citation_keys array<string>, locator_type string, locator_value string, mapping_status string"
_DIAGNOSTIC = "block_count int, error string, extraction_method string, extraction_status string, path string, text_quality string"


@dataclass
class Request:
    cache_dir: str
    targets: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    bibliographies: list[str] = field(default_factory=list)
    manifests: list[str] = field(default_factory=list)
    output: str | None = None
    force: bool = False
    fail_on_missing: bool = False
    live: bool = False
    """Whether the citation keys of the targets are looked up in a reference manager."""
    require_live: bool = False
    fetch: live.Fetch | None = None
    """What asks the reference manager; its local service if None."""
    readers: Mapping[str, D.Reader] | None = None
    """Readers by suffix, beside the known ones."""


@dataclass
class Outcome:
    rows: DataFrame
    summary: dict
    diagnostics: list[dict]
    code: int


def targets(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Tables of all targets. A path that does not exist is an error; a folder without a supported file is a diagnostic."""
    for p in paths:
        here = Path(p)
        if not here.exists() or (here.is_file() and here.suffix.lower() not in D.SUFFIXES):
            raise FileNotFoundError(f"no such input, or its suffix is not supported: {p}")
    bare = [str(Path(p).resolve()) for p in paths if Path(p).is_dir() and not any(f.suffix.lower() in D.SUFFIXES for f in Path(p).rglob("*") if f.is_file())]
    told = [(0, "No supported target files were found for the supplied input.", "", "error:NoSupportedTargets", p, "unknown") for p in bare]
    extra = spark.createDataFrame(told, _DIAGNOSTIC)
    real = [p for p in paths if str(Path(p).resolve()) not in bare]
    if not real:
        return {"mentions": spark.createDataFrame([], _MENTION), "diagnostics": extra}
    out = D.tables(stage(D.extract(D.files(spark, real), "target"), "targets"))
    out["diagnostics"] = out["diagnostics"].unionByName(extra)
    return out


def corpus(spark: SparkSession, request: Request, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """All source records, and the imported manifest rows. answers: of a look-up in a reference manager."""
    parts, imported = [spark.createDataFrame([], I.SOURCE)], []
    if request.sources:
        found = D.requested(spark, request.sources, request.cache_dir)
        stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
        raw = found.select(
            F.array(stem).alias("aliases"), F.lit("").alias("title"), X.empty_array().alias("authors"), X.empty_array("boolean").alias("protected"), F.lit(None).cast("int").alias("year"),
            F.lit("").alias("doi"), F.lit("").alias("url"), F.array("path").alias("local_files"), F.lit("local").alias("provider"),
        )
        parts.append(I.source_records(raw))
    if request.bibliographies:
        parts.append(B.load(spark, request.bibliographies))
    for path in request.manifests:
        rows = stage(V.read(spark, path, str(Path(path).resolve().parent)), "rows")
        imported.append(rows)
        parts.append(V.sources_of(rows))
    if answers is not None:
        parts.append(live.source_records(answers))
    rows = stage(M.coalesce_imported(reduce(DataFrame.unionByName, imported)), "imported") if imported else None
    return stage(reduce(DataFrame.unionByName, parts), "sources"), rows


def cache_sources(spark: SparkSession, sources: DataFrame, cache_dir: str, force: bool, readers: Mapping[str, D.Reader] | None = None) -> tuple[DataFrame, DataFrame]:
    """Artifacts, and cache results, of all coalesced sources; only what the cache lacks is extracted and written. readers: by suffix, beside the known ones."""
    merged = stage(coalesce_sources(sources), "coalesced")
    wanted = merged.select("source_id", F.posexplode("local_files").alias("turn", "path"))
    there = stage(D.opened(wanted.select("path"), content=False), "there")
    held = f"{cache_dir.rstrip('/')}/entries"
    current = stage(wanted.join(there, "path", "left").withColumn("file", X.cache_name("source_id", "path")), "current")
    planned = stage(K.plan(current.filter("sha256 is not null"), K.validity(K.read(spark, held)), force), "planned")
    fresh = planned.filter("not reused")
    parsed = D.extract(D.opened(fresh.select("path")).filter("sha256 is not null").select("path", "sha256", "media_type", "content"), "source", readers)
    done = stage(fresh.select("source_id", "turn", "file", "path").join(parsed, "path"), "parsed")
    good = done.filter(~F.col("extraction_status").startswith("error:"))
    if not good.isEmpty():
        K.write(K.records(good, "file"), held)
    old = planned.filter("reused").select("source_id", "turn", "path", "sha256", "media_type", F.col("old_status").alias("extraction_status"), F.col("old_quality").alias("text_quality"), F.lit(True).alias("reused"))
    new = done.select("source_id", "turn", "path", "sha256", "media_type", "extraction_status", "text_quality", F.lit(False).alias("reused"))
    lost = current.filter("sha256 is null").select("source_id", "turn", "path", F.lit("").alias("sha256"), X.media_type("path").alias("media_type"), F.lit("missing").alias("extraction_status"), F.lit("unknown").alias("text_quality"), F.lit(False).alias("reused"))
    attempts = old.unionByName(new).unionByName(lost).withColumnRenamed("path", "source_path")
    chosen = stage(M.pick_attachment(stage(attempts, "attempts")), "chosen")
    ok = D.analyzed(F.col("extraction_status"), F.col("text_quality"))
    told = merged.select("source_id", F.col("conflicts").alias("own")).join(chosen, "source_id", "left")
    text = lambda c, default="": F.coalesce(c, F.lit(default)).alias(c)
    artifacts = told.select(
        "source_id", text("source_path"), text("media_type"), F.coalesce("sha256", F.lit("")).alias("source_sha256"), text("extraction_status", "missing"), text("text_quality", "unknown"),
        F.when(ok, K.place(held, X.cache_name("source_id", "source_path"))).otherwise(F.lit("")).alias("cache_path"), F.concat("own", F.coalesce("conflicts", X.empty_array())).alias("conflicts"),
    )
    return stage(artifacts, "artifacts"), chosen.select("source_id", "extraction_status", "text_quality", "reused")


def run(spark: SparkSession, request: Request) -> Outcome:
    found = targets(spark, request.targets)
    answers = None
    if request.live:
        keys = found["mentions"].select(F.explode("citation_keys").alias("key")).distinct()
        answers = stage(live.look_up(keys, request.fetch, request.require_live), "answers")
    sources, imported = corpus(spark, request, answers)
    artifacts, cached = cache_sources(spark, sources, request.cache_dir, request.force, request.readers)
    rows = stage(M.build(found["mentions"], sources, artifacts), "manifest")
    if imported is not None:
        rows = stage(M.merge(imported, rows, stage(M.resolutions(found["mentions"], sources), "now")), "merged")
    if answers is not None:
        rows = stage(M.live_refresh(rows, answers.select("key", "status", "candidates")), "live")
    if request.output:
        V.write(M.in_order(rows), request.output)
    total = M.summary(rows, cached)
    bad = [r.asDict() for r in found["diagnostics"].orderBy("path").collect()]
    code = M.exit_code(total, len(bad), request.fail_on_missing).head()["code"]
    return Outcome(rows, total.head().asDict(), bad, code)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="attesta")
    parser.add_argument("command", choices=["cache", "manifest"])
    for name in ("target", "source", "bibliography", "manifest"):
        parser.add_argument(f"--{name}", action="append", default=[])
    parser.add_argument("--cache-dir", required=True)
    parser.add_argument("--output")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--fail-on-missing", action="store_true")
    parser.add_argument("--zotero-live", action="store_true")
    parser.add_argument("--require-zotero", action="store_true")
    a = parser.parse_args(argv)
    if a.require_zotero and not a.zotero_live:
        parser.error("--require-zotero needs --zotero-live")
    if a.command == "manifest" and not a.target:
        parser.error("manifest needs a target")
    spark = SparkSession.builder.appName("attesta").getOrCreate()
    done = run(spark, Request(str(Path(a.cache_dir).resolve()), a.target, a.source, a.bibliography, a.manifest, a.output, a.force, a.fail_on_missing, a.zotero_live, a.require_zotero))
    print(json.dumps(done.summary | {"target_diagnostics": done.diagnostics, "target_unusable": len(done.diagnostics)}, sort_keys=True))
    return done.code


if __name__ == "__main__":
    sys.exit(main())
