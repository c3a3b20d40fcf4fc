"""Documents from files: listing, hashing, dispatch by suffix, extraction, and the tables that follow.

Folders are read with the binaryFile source and named files on the executors, so
reading is distributed. One mapInArrow pass extracts every format by a reader for its
suffix (READERS, or readers of the caller's own); a reader's failure becomes the status
error:<Exception> of that document and never fails the task.
"""

from __future__ import annotations

import functools
import hashlib
import io
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as X

from . import formats

SUFFIXES = tuple(X.SUFFIX_TYPES)
_BLOCK = "array<struct<block_id:string,text_original:string,locator_type:string,locator_value:string,heading:string>>"
_MENTION = "array<struct<raw_text:string,citation_keys:array<string>,locator_type:string,locator_value:string,mapping_status:string>>"
_PARSED = f"document_id string, role string, path string, media_type string, sha256 string, extraction_method string, extraction_status string, text_quality string, conversion_note string, error string, blocks {_BLOCK}, mentions {_MENTION}"
_texts = lambda *names: pa.struct([(n, pa.list_(pa.string()) if n == "citation_keys" else pa.string()) for n in names])
_ARROW = pa.schema([
    *((c.split()[0], pa.string()) for c in _PARSED.split(", ")[:-2]),
    ("blocks", pa.list_(_texts("block_id", "text_original", "locator_type", "locator_value", "heading"))),
    ("mentions", pa.list_(_texts("raw_text", "citation_keys", "locator_type", "locator_value", "mapping_status"))),
])
#: Bytes of content, and files, whose blocks Python holds at once.
SLICE, SLICE_ROWS = 1 << 20, 500
#: Blocks and mentions, extraction method, status and quality of a file's bytes.
Read = tuple[formats.Parsed, str, str, str]
Reader = Callable[[bytes], Read]


def local(path) -> str:
    """A plain path of a file: URI."""
    return F.regexp_replace(path, "^file:/+", "/")


def files(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = SUFFIXES, exclude: str | None = None) -> DataFrame:
    """(path, sha256, media_type, length, content) of the supported files under paths, each once. exclude: a folder that is not read."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    found = scan.select(local(F.col("path")).alias("path"), "length", "content").filter(X.suffix("path").isin(*suffixes))
    if exclude:
        found = found.filter(~F.col("path").startswith(exclude.rstrip("/") + "/"))
    return found.dropDuplicates(["path"]).select("path", F.sha2("content", 256).alias("sha256"), X.media_type("path").alias("media_type"), "length", "content")


def requested(spark: SparkSession, paths: list[str], exclude: str | None = None) -> DataFrame:
    """(path) of explicit sources: the files under folders, and every named file even if it is absent or unsupported."""
    whole = [Path(p).expanduser().resolve() for p in paths]
    folders = [str(p) for p in whole if p.is_dir()]
    out = spark.createDataFrame([(str(p),) for p in whole if not p.is_dir()], "path string")
    return (out.union(files(spark, folders, exclude=exclude).select("path")) if folders else out).distinct()


def opened(paths: DataFrame, content: bool = True) -> DataFrame:
    """(path, sha256, media_type, length[, content]) of named files, read on all cores of the executors, a megabyte of files at a time; all null where there is none."""

    into = pa.schema([("path", pa.string()), ("sha256", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

    def read(path: str) -> tuple:
        digest, length, kept = hashlib.sha256(), 0, []
        try:
            with open(path, "rb") as file:
                for piece in iter(functools.partial(file.read, 1 << 20), b""):
                    digest.update(piece)
                    length += len(piece)
                    if content:
                        kept.append(piece)
        except OSError:
            return path, None, None, None
        return path, digest.hexdigest(), length, b"".join(kept) if content else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sliced(parts, read, into)

    # a row is a path, but its work is a file: by their bytes all paths would be one task's
    tasks = 2 * paths.sparkSession.sparkContext.defaultParallelism
    found = paths.select("path").repartition(tasks, "path").distinct().mapInArrow(run, "path string, sha256 string, length bigint, content binary")
    kind = F.when(F.col("sha256").isNotNull(), X.media_type("path")).alias("media_type")
    return found.select("path", "sha256", kind, "length", *["content"] * content)


def _text(method: str, reader: Callable[[str], formats.Parsed]) -> Reader:
    return lambda content: (reader(content.decode("utf-8")), method, "extracted", "good")


def _word(content: bytes) -> Read:
    return formats.ooxml(content), "ooxml", "extracted", "good"


def _doc(content: bytes) -> Read:
    """A legacy Word file by way of an office program's conversion."""
    office = shutil.which("soffice")
    if office is None:
        raise FileNotFoundError("soffice")
    with tempfile.TemporaryDirectory() as work:
        (Path(work) / "in.doc").write_bytes(content)
        subprocess.run([office, "--headless", "--convert-to", "docx", "--outdir", work, f"{work}/in.doc"], check=True, capture_output=True, timeout=120)
        return formats.ooxml((Path(work) / "in.docx").read_bytes()), "soffice-docx", "extracted", "good"


def pdf_texts(content: bytes) -> tuple[list[str], str]:
    """Texts of the pages of a PDF, and what read them: the layout tool where there is one and it succeeds, else a library."""
    tool = shutil.which("pdftotext")
    if tool:
        with tempfile.NamedTemporaryFile(suffix=".pdf") as file:
            file.write(content)
            file.flush()
            done = subprocess.run([tool, "-layout", "-enc", "UTF-8", file.name, "-"], capture_output=True)
        if done.returncode == 0:
            pages = done.stdout.decode("utf-8", "replace").split("\f")
            return pages if pages[-1].strip() else pages[:-1], "pdftotext-layout"
    try:
        import pypdf
    except ImportError:
        raise RuntimeError("neither pdftotext nor pypdf is there to read PDF") from None
    return [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages], "pypdf"


def _pdf(content: bytes) -> Read:
    pages, method = pdf_texts(content)
    return formats.pdf_pages(pages), method, *formats.pdf_quality(pages)


READERS: dict[str, Reader] = {
    **dict.fromkeys((".md", ".qmd"), _text("native-markup", formats.markdown)),
    **dict.fromkeys((".tex", ".latex"), _text("native-latex", formats.latex)),
    **dict.fromkeys((".htm", ".html"), _text("html-parser", formats.html)),
    **dict.fromkeys((".docx", ".docm"), _word),
    ".txt": _text("native-text", formats.plain),
    ".doc": _doc,
    ".pdf": _pdf,
}


def extract(found: DataFrame, role: str, readers: Mapping[str, Reader] | None = None) -> DataFrame:
    """One row a file with blocks and mentions as arrays. role: target or source; readers: by suffix, instead of or beside READERS."""
    if role not in ("source", "target"):
        raise ValueError("role is source or target")
    known = {**READERS, **(readers or {})}

    def row(path: str, sha: str | None, kind: str | None, content: bytes | None) -> tuple:
        error, blocks, mentions, method, status, quality = "", [], [], "", "", "unknown"
        try:
            suffix = Path(path).suffix.lower()
            if content is None:
                status = "missing"
            elif suffix not in known:
                status, error = "error:UnsupportedFormatError", suffix
            else:
                (blocks, mentions), method, status, quality = known[suffix](content)
        except Exception as e:  # noqa: BLE001 - one document's failure is its own status
            status, error = f"error:{type(e).__name__}", str(e)
        if not blocks and (status, quality) == ("extracted", "good"):
            status, quality = "unusable", "empty"
        named = [dict(zip(("block_id", "text_original", "locator_type", "locator_value", "heading"), b, strict=True)) for b in blocks]
        cited = [dict(zip(("raw_text", "citation_keys", "locator_type", "locator_value", "mapping_status"), m, strict=True)) for m in mentions]
        return f"{role}-{sha}", role, path, kind, sha, method, status, quality, "", error, named, cited

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sliced(parts, row)

    return found.select("path", "sha256", "media_type", "content").mapInArrow(run, _PARSED)


def sliced(parts: Iterator[pa.RecordBatch], row: Callable[..., tuple], into: pa.Schema = _ARROW) -> Iterator[pa.RecordBatch]:
    """Rows of files by `row`, sent on after every SLICE bytes of content given or found, so that Python holds no batch of files."""
    rows, size = [], 0
    for part in parts:
        for i in range(part.num_rows):
            given = [column[i].as_py() for column in part.columns]
            rows.append(dict(zip(into.names, row(*given), strict=True)))
            size += len(given[-1] or b"") + len(rows[-1].get("content") or b"")
            if size >= SLICE or len(rows) == SLICE_ROWS:
                yield pa.RecordBatch.from_pylist(rows, into)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, into)


def unusable(status, quality):
    return (quality == "empty") | status.startswith("error:") | status.isin("empty", "needs_ocr", "needs_review", "unusable")


def analyzed(status, quality):
    return (status != "missing") & ~unusable(status, quality)


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """documents, blocks, mentions and diagnostics; an unusable document is only a diagnostic."""
    bad = unusable(F.col("extraction_status"), F.col("text_quality"))
    good = parsed.filter(~bad)
    block = good.select("document_id", "path", F.posexplode("blocks").alias("i", "b")).select("document_id", "path", (F.col("i") + 1).alias("block_index"), "b.*")
    mention = good.select("document_id", "path", F.posexplode("mentions").alias("i", "m")).select("document_id", "path", (F.col("i") + 1).alias("mention_index"), "m.*")
    return {
        "documents": good.drop("blocks", "mentions", "error"),
        "blocks": block.withColumn("text_normalized", X.normalize_text("text_original")),
        "mentions": mention,
        "diagnostics": parsed.filter(bad).select(F.size("blocks").alias("block_count"), F.nullif("error", F.lit("")).alias("error"), "extraction_method", "extraction_status", "path", "text_quality"),
    }


def text_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Plain text as blocks, in the JVM: one for each line that is not blank."""
    line = docs.select(F.col(id_col).alias("document_id"), F.posexplode(X.lines(F.coalesce(text_col, F.lit("")))).alias("i", "text_original")).filter(~X.blank("text_original"))
    number = (F.col("i") + 1).cast("string")
    return line.select("document_id", F.concat(F.lit("line-"), number).alias("block_id"), "text_original", F.lit("line").alias("locator_type"), number.alias("locator_value"), F.lit(formats.SCOPE).alias("heading"))


def page_blocks(pages: DataFrame, id_col: str, page_col: str, text_col: str) -> DataFrame:
    """Blocks of extracted page texts, in the JVM: parts between empty lines."""
    whole = X.strip(F.regexp_replace(F.coalesce(text_col, F.lit("")), "\r\n?", "\n"))
    parts = F.filter(F.transform(F.split(whole, r"\n\s*\n+"), X.strip), lambda p: p != "")
    each = pages.select(F.col(id_col).alias("document_id"), F.col(page_col).alias("page"), F.posexplode(parts).alias("i", "text_original"))
    where = F.concat(F.lit("page="), F.col("page").cast("string"), F.lit(";block="), (F.col("i") + 1).cast("string"))
    return each.select("document_id", F.concat(F.lit("pdf-page-"), F.col("page").cast("string"), F.lit("-block-"), (F.col("i") + 1).cast("string")).alias("block_id"), "text_original", F.lit("pdf-block").alias("locator_type"), where.alias("locator_value"), F.lit(formats.SCOPE).alias("heading"))


def page_quality(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(document_id, n_pages, n_solid, n_broken, extraction_status, text_quality) of extracted page texts."""
    text = F.coalesce(text_col, F.lit(""))
    solid = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    broken = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    one = pages.groupBy(F.col(id_col).alias("document_id")).agg(F.count("*").alias("n_pages"), F.sum(solid).alias("n_solid"), F.sum(broken).alias("n_broken"))
    pick = lambda a, b, c, d: F.when(F.col("n_solid") == 0, a).when(F.col("n_solid") < 100 * F.col("n_pages"), b).when(100 * F.col("n_broken") > F.col("n_solid"), c).otherwise(d)
    return one.withColumns({"extraction_status": pick("empty", "needs_ocr", "needs_review", "extracted"), "text_quality": pick("empty", "sparse", "degraded", "good")})
