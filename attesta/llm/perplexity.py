"""Quality rules: base counts of words, symbols and repeats, then perplexity bands by language.

The language model of each language is a modified Kneser-Ney model of real character
4-grams, no character folded into another (but for those above U+FFFF, which share
2,048 hashed codes). Spark counts in how many texts a 4-gram occurs, so that a text's
own repeats are no evidence for it, and 4-grams of one text alone are pruned; their
mass, as the discounts', goes to the shorter contexts. Continuation counts, discounts,
back-off weights and probabilities follow level by level as grouped sums and joins.

The model grows with the corpus and is nowhere as a whole. Texts are gathered in
shards of consecutive rows, as compressed blocks, beside the distinct grams of the
shard; that table is bucketed by shard. Each distinct gram of a shard is joined with
its probability, and the answers meet the shard's blocks without moving these again. There they become a hash
array: keys sorted by a 64-bit hash, with a table of where each leading-bits value
begins, so a look-up is a gather and a step or two.

A document is rejected if its log-perplexity a character lies outside its language's
band: the quartiles, widened by `wide` interquartile ranges and by `slack` at least,
and more for short texts, whose averages vary more: by sqrt(1 + median words / words).
Quartiles and medians are those of all documents that pass the base rules.

Defined results: a null or empty text has no word, all counts 0, and fails the base
rules; a null language is `und`; a language in which no document passes the base
rules rejects none by perplexity; windows and lines never cross rows; equal rows get
equal results; ids and null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attesta.scratch import remove

from .common import Prefixes, bounded, forget, mix, raw, read, runs_of, shared_folder, slices, words, written

ORDER, BITS, START, UNSEEN = 4, 16, 2, 2.0**-12
WIDE, SLACK = 6.0, 0.05
SHARD_BYTES, BLOCK_BYTES = 1 << 26, 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character, sixteen bits a character, and the texts' offsets in characters. Marks stand before a text."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    rare = np.flatnonzero(points > 0xFFFF)
    points[rare] = np.uint64(0xD800) + (mix(points[rare]) & np.uint64(0x7FF))  # no character has a code there
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = begins[offsets]
    gram = points.copy()
    for k in range(1, ORDER):
        gram[k:] |= points[:-k] << np.uint64(BITS * k)
        early = (at[:-1, None] + np.arange(k)).reshape(-1)
        early = early[early < np.repeat(at[1:], k)]
        mask = ~(np.uint64((1 << BITS) - 1) << np.uint64(BITS * k))
        gram[early] = (gram[early] & mask) | np.uint64(START << BITS * k)
    return gram, at


def texts_with(gram: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and in how many texts each occurs. Fewer than 4096 texts at a time, so that hash and text share a word."""
    distinct = np.sort(gram)
    distinct = distinct[np.append(True, distinct[1:] != distinct[:-1])] if len(gram) else distinct
    row = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    marked = np.sort((mix(gram) & ~np.uint64(0xFFF)) | row)
    marked = marked[np.append(True, marked[1:] != marked[:-1])] >> np.uint64(12) if len(gram) else marked
    opens = np.flatnonzero(np.append(True, marked[1:] != marked[:-1])) if len(gram) else np.zeros(0, np.int64)
    count = np.diff(np.append(opens, len(marked)))
    return distinct, count[np.searchsorted(marked[opens], mix(distinct) >> np.uint64(12))]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns of COUNTS for each row."""
    n = len(offsets) - 1
    start, stop, row = words(data, offsets)
    sums = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, stop, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    hashes = Prefixes(data)
    salt = mix(np.arange(n, dtype=np.uint64) + _GOLD)

    feeds = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate((offsets[:-1], feeds + 1)))
    line_row = np.sort(np.concatenate((np.arange(n), np.searchsorted(offsets, feeds, "right") - 1)))
    line_stop = np.append(line_start[1:], len(data))
    last = np.append(line_row[1:] != line_row[:-1], True)
    line_stop = np.where(last, offsets[line_row + 1], line_stop - 1)
    worded = np.concatenate(([0], np.cumsum(inside)))
    use = worded[np.maximum(line_stop, line_start)] > worded[line_start]
    key = mix(hashes(line_start[use], line_stop[use]) ^ salt[line_row[use]])
    _, first = np.unique(key, return_index=True)
    duplicate = np.bincount(line_row[use], minlength=n) - np.bincount(line_row[use][first], minlength=n)

    repeated = np.zeros(n, np.int64)
    if len(start):
        word = hashes(start, stop)
        first, count = runs_of(row, n)
        at = np.flatnonzero(np.arange(len(word)) - first[row] + 5 <= count[row])
        window = salt[row[at]].copy()
        for k in range(5):
            window = mix(window + word[at + k] + _GOLD)
        order = np.argsort(window)
        sorted_ = window[order]
        same = np.zeros(len(order), bool)
        same[1:] = sorted_[1:] == sorted_[:-1]
        same[:-1] |= sorted_[1:] == sorted_[:-1]
        twice = at[order[same]]
        edge = np.zeros(len(word) + 6, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + 5, -1)
        repeated = np.bincount(row[np.cumsum(edge)[: len(word)] > 0], minlength=n)
    return [np.bincount(row, minlength=n), sums(inside & ((data & 0xC0) != 0x80)), sums(_SYMBOL[data]), duplicate, repeated]


class HashArray:
    """Values by 64-bit key: keys in the order of their hashes, and where each value of the leading bits begins."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        hashed = mix(key)
        order = np.argsort(hashed)
        self.hashes = np.append(hashed[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.value = np.append(value[order], np.nan).astype(np.float32)
        self.shift = np.uint64(64 - max(1, len(key).bit_length()))
        self.begin = np.searchsorted(self.hashes[:-1], np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        want = mix(key)
        at = self.begin[want >> self.shift]
        todo = np.flatnonzero(self.hashes[at] < want)
        while len(todo):
            at[todo] += 1
            todo = todo[self.hashes[at[todo]] < want[todo]]
        found = self.value[at]
        found[self.hashes[at] != want] = np.nan
        return found


def bucket_of(value: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket in which Spark puts a long: its Murmur3 hash with seed 42."""
    value, h = value.astype(np.uint64), np.full(len(value), 42, np.uint32)
    turn = lambda x, k: (x << np.uint32(k)) | (x >> np.uint32(32 - k))
    for word in (value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint32)):
        h ^= turn(word * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % buckets


def shard_number(part: int, turn: int, buckets: int) -> int:
    """A number of a partition's shard that lies in a bucket of its own, as far as there are buckets."""
    tries = (part << 40 | turn << 28) + np.arange(min(1 << 28, 64 * buckets))
    hit = np.flatnonzero(bucket_of(tries, buckets) == (part + turn * (buckets // 2 + 1)) % buckets)
    return int(tries[hit[0] if len(hit) else 0])


_GATHERED = "shard bigint, lang string, gram bigint, n bigint, block binary"


def _gather(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Compressed blocks of rows, and at the end of each shard its distinct grams by language with the number of their texts."""
    part_id, turn, size = TaskContext.get().partitionId(), 0, 0
    shard = shard_number(part_id, turn, buckets)
    seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(gram)
        opens = np.flatnonzero(np.append(True, gram[order][1:] != gram[order][:-1])) if len(gram) else np.zeros(0, np.int64)
        return gram[order][opens], np.add.reduceat(n[order], opens) if len(opens) else n

    def close() -> Iterator[pa.RecordBatch]:
        for lang, parts in seen.items():
            gram, n = merged(parts)
            for i in range(0, len(gram), 1 << 16):
                g = gram[i : i + (1 << 16)].view(np.int64)
                yield _rows(shard, len(g), lang=[lang] * len(g), gram=g, n=n[i : i + (1 << 16)])
        seen.clear()

    for batch in batches:
        for part in slices(batch, "text", BLOCK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(part)
            yield _rows(shard, 1, block=[sink.getvalue().to_pybytes()])
            for lang in pc.unique(part.column("lang")).to_pylist():
                for piece in slices(part.filter(pc.equal(part.column("lang"), lang)).select(["text"]), "text"):
                    seen.setdefault(lang, []).append(texts_with(*grams(*raw(piece.column("text")))))
                if len(seen[lang]) > 64:
                    seen[lang] = [merged(seen[lang])]
            size += part.nbytes
            if size >= SHARD_BYTES:
                yield from close()
                turn, size = turn + 1, 0
                shard = shard_number(part_id, turn, buckets)
    yield from close()


def _rows(shard: int, rows: int, **given) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "gram": pa.int64(), "n": pa.int64(), "block": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([shard] * rows, pa.int64()), *(pa.array(given[c], k) if c in given else pa.nulls(rows, k) for c, k in kinds.items())], ["shard", *kinds])


def _tail(gram: Column, n: int) -> Column:
    """The last n characters."""
    return gram.bitwiseAND(F.lit((1 << BITS * n) - 1 if n < ORDER else -1))


def _level(counts: DataFrame, order: int, least: int, shorter: DataFrame | None) -> DataFrame:
    """(lang, gram, p) of one order. counts: (lang, gram, c); grams of fewer than `least` counts are pruned; shorter: the order below."""
    times = lambda k: F.greatest(F.lit(1.0), F.sum((F.col("c") == k).cast("double")))
    seen = counts.groupBy("lang").agg(*(times(k).alias(f"t{k}") for k in (1, 2, 3, 4)))  # a row a language
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    cuts = [F.least(F.greatest(k - (k + 1) * y * F.col(f"t{k + 1}") / F.col(f"t{k}"), F.lit(0.05)), F.lit(k - 0.05)) for k in (1, 2, 3)]
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    # a row a language: broadcast, or the windows below would keep a language's partitioning and with it all its grams in one task
    each = counts.join(F.broadcast(seen.select("lang", *(c.alias(f"d{k}") for k, c in enumerate(cuts, 1)))), "lang")
    each = each.select("lang", "gram", "c", F.when(F.col("c") >= least, F.col("c") - cut).otherwise(0.0).alias("x"))
    context = Window.partitionBy("lang", F.shiftrightunsigned("gram", BITS))
    each = each.withColumns({"total": F.sum("c").over(context).cast("double"), "kept": F.sum("x").over(context)})
    if shorter is None:
        each = each.withColumn("low", F.lit(UNSEEN))
    else:
        low = shorter.select("lang", F.col("gram").alias("tail"), F.col("p").alias("low"))
        each = each.withColumn("tail", _tail(F.col("gram"), order - 1)).join(low, ["lang", "tail"])
    own = F.when(F.col("total") > 0, F.col("x") / F.col("total")).otherwise(0.0)
    rest = F.when(F.col("total") > 0, 1 - F.col("kept") / F.col("total")).otherwise(1.0)
    return each.select("lang", "gram", (own + rest * F.col("low")).alias("p"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, gram, p): probability of the last character of each gram after the ones before it. counts: (lang, gram, c), texts that hold each gram."""
    levels = {ORDER: written(counts, "level", light=True)}
    for n in range(ORDER - 1, 0, -1):  # in how many ways a gram continues one that is kept
        kept = (F.col("c") >= (2 if n == ORDER - 1 else 1)).cast("bigint")
        tails = levels[n + 1].groupBy("lang", _tail(F.col("gram"), n).alias("gram")).agg(F.sum(kept).alias("c"))
        levels[n] = written(tails, "level", light=True)
    p = None
    for n in range(1, ORDER + 1):
        p, shorter = written(_level(levels[n], n, 2 if n == ORDER else 1, p), "p", light=True), p
        forget(levels[n], shorter)
    return p


def _scorer(names: list[str]):
    """Counts and log-perplexity of the documents of a shard's blocks, from the probabilities of its grams."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known = {}
        for lang in pc.unique(right.column("lang")).to_pylist():
            mine = right.filter(pc.equal(right.column("lang"), lang))
            known[lang] = HashArray(mine.column("gram").to_numpy().view(np.uint64), np.log(mine.column("p").to_numpy()))
        out = []
        for block in left.column("block"):
            whole = pa.ipc.open_stream(block.as_buffer()).read_all().combine_chunks().to_batches()[0]
            for lang in pc.unique(whole.column("lang")).to_pylist():
                for part in slices(whole.filter(pc.equal(whole.column("lang"), lang)), "text"):
                    data, offsets = raw(part.column("text"))
                    log = np.full(part.num_rows, np.nan)
                    gram, at = grams(data, offsets)
                    if len(gram):
                        found = known[lang](gram)
                        if np.isnan(found).any():
                            raise ValueError("a gram of the shard has no probability")
                        ends = np.concatenate(([0], np.cumsum(found.astype(np.float64))))
                        size = np.diff(at)
                        log = np.divide(-np.diff(ends[at]), size, out=log, where=size > 0)
                    counts = [pa.array(x.astype(np.int64)) for x in base_counts(data, offsets)]
                    out.append(pa.table([part.column("doc_id"), part.column("lang"), *counts, pa.array(log, mask=np.isnan(log))], names))
        return pa.concat_tables(out)

    return score


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, counts of COUNTS, log_perplexity) for every row, as a written table. The session's catalog holds the gathered table meanwhile."""
    spark = docs.sparkSession
    bounded(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    name = f"attesta_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    gathered = base.mapInArrow(lambda batches: _gather(batches, buckets), _GATHERED).write.option("path", path).option("compression", "lz4")
    gathered.bucketBy(buckets, "shard").saveAsTable(name)
    try:
        return _scored(spark, name, StructType(base.schema.fields[:2]))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def _scored(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    """scored() from the gathered table; schema: of id and language."""
    shards = spark.table(name).filter("gram is not null").select("shard", "lang", "gram", "n")
    p = kneser_ney(shards.groupBy("lang", "gram").agg(F.sum("n").alias("c")))
    answers = shards.select("shard", "lang", "gram").join(p.select("lang", "gram", F.col("p").cast("float").alias("p")), ["lang", "gram"])
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("log_perplexity", "double")
    blocks = spark.table(name).filter("block is not null").select(F.col("shard").alias("of"), "block")
    found = blocks.groupBy("of").cogroup(answers.groupBy("shard")).applyInArrow(_scorer(schema.names), schema)
    found = written(found, "scored")
    forget(p)
    return found


def _failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts of COUNTS, base_failed) for every row, without a model."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = StructType(base.schema.fields[:1])
    for c in COUNTS:
        schema = schema.add(c, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts = base_counts(*raw(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in counts)], schema.names)

    return base.mapInArrow(count, schema).withColumn("base_failed", _failed())


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", wide: float = WIDE, slack: float = SLACK) -> DataFrame:
    """(doc_id, counts of COUNTS, base_failed, kept, lang, log_perplexity) for every row."""
    rows = scored(docs, id_col, text_col, lang_col)
    rows = rows.withColumn("base_failed", _failed())
    quarters = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.75)), 10000)
    band = rows.filter("not base_failed").groupBy("lang").agg(quarters.alias("q"), F.percentile_approx("n_words", F.lit(0.5), 10000).alias("typical"))
    reach = F.greatest(F.lit(wide) * (F.col("q")[1] - F.col("q")[0]), F.lit(slack))
    band = written(band.select("lang", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), reach.alias("reach"), "typical"), "bands", light=True)
    far = F.col("reach") * F.sqrt(1 + F.col("typical") / F.greatest("n_words", F.lit(1)))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower") - far, F.col("upper") + far), F.lit(True))
    return rows.join(F.broadcast(band), "lang", "left").select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang", "log_perplexity")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts, and the verdict of the language's perplexity band, for every document."""
    return quality_rules(read(spark, sf_dir, "documents"))
