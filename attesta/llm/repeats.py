"""Exact repeated-substring removal: a depth-limited radix sort of suffixes, most significant digit first.

Two windows of `depth` bytes are equal when their suffixes stay in one group of a
radix sort through `depth` bytes, so groups of two or more at that depth are exactly
the repeated windows. To sort a corpus without moving every suffix, only one suffix
in about 76 bytes is sorted, the one that begins at an anchor:

1. Sparse buckets. The anchor of a window is its leftmost smallest `gram`-byte string
   under a hash. Equal windows have equal anchors at equal distances, so windows are
   bucketed by the gram, and consecutive windows that share an anchor travel as one
   run. A gram that occurs once ends there.
2. Runs of one gram that agree in all bytes they span (by gram and a 64-bit hash of
   the span) are one class. A class with two members is repeated as a whole, and one
   member stands for it from here on. A gram of one class ends there.
3. Digit passes. The classes of a gram carry their bytes to one task. There the
   suffixes that begin at the anchors are sorted in passes over digits of eight bytes,
   most significant first; only groups of two or more go on to the next digit, and no
   digit beyond the depth is read. The reversed strings that end at the anchors are
   sorted alike. A window that begins d bytes before its anchor is d bytes of the one
   and depth - d bytes of the other, so its group is the pair of its groups at these
   depths. Every comparison here is one of bytes.
4. A gram of more than LIMIT classes is not brought to one task: its windows are
   bucketed further, by all bytes that a block of neighbouring windows has in common,
   with blocks of 32, of 6 and of 1 window, until a bucket holds few classes. A block
   of one window is the window itself; its bytes are then counted by a grouped sum.

Counts are grouped sums with map-side partial sums, so a passage that thousands
of texts hold costs one row a task. Equal texts share one key (the md5 of the
text), and removal depends on the text alone. A row's list of ranges is bounded
by its text. Texts far above a slice are anchored piece by piece.

Defined results: null and empty texts have no window and nothing removed; texts
shorter than `depth` bytes are kept whole; matches never cross rows; an equal row
(same id or not) counts as another place; null ids are kept; other columns pass
through, whatever their names. remove_repeats() drops a character of which only some
bytes remain.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Prefixes, carried, forget, mix, named, raw, read, restored, slices, written

DEPTH, GRAM, BLOCKS, SEGMENT = 200, 50, (32, 6, 1), 1 << 21
LIMIT, CHUNK, SALTS = 512, 1 << 14, 32  # classes of a bucket that one task sorts, classes it holds at a time, and tasks that share a hot key
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _runs(data: np.ndarray, offsets: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor, first and last window start of each run of windows that share an anchor."""
    n, width = len(data), depth - gram + 1
    if n < depth:
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(n - gram + 1)
    bits = np.uint64(int(n).bit_length())
    value = (Prefixes(data)(at, at + gram) >> bits << bits) | at.astype(np.uint64)
    span = 1
    while span * 2 <= width:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    if width > span:
        value = np.minimum(value[: span - width], value[width - span :])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(value)]
    start = np.flatnonzero(np.arange(len(value)) + depth <= offsets[row + 1])
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    anchor = (value[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return row[start[first]], anchor[first], start[first], start[last]


def anchors(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, gram: int = GRAM):
    """Row, place of the anchor, nearest and farthest window before it, and two fingerprints: of the gram and of the span."""

    def prints(hashes: Prefixes, anchor, lo, hi):
        near, far = anchor - hi, anchor - lo
        g = hashes(anchor, anchor + gram)
        return near, far, g, mix(hashes(lo, hi + depth) + near.astype(np.uint64) * _GOLD + (far.astype(np.uint64) << np.uint64(32)))

    if len(offsets) == 2 and len(data) > 2 * SEGMENT:  # one very long text
        parts = []
        for begin in range(0, len(data), SEGMENT):
            piece = data[begin : begin + SEGMENT + depth - 1]
            parts.append(np.stack(_runs(piece, np.array([0, len(piece)]), depth, gram)[1:]) + begin)
        anchor, lo, hi = np.concatenate(parts, 1)
        new = np.append(True, anchor[1:] != anchor[:-1])  # a run may go on in the next piece
        first = np.flatnonzero(new)
        anchor, lo, hi = anchor[first], lo[first], hi[np.append(first[1:], len(new)) - 1]
        out = []
        for begin in range(0, len(data), SEGMENT):
            use = (lo >= begin) & (lo < begin + SEGMENT)
            hashes = Prefixes(data[begin : begin + SEGMENT + 3 * depth])
            out.append((anchor[use], *prints(hashes, anchor[use] - begin, lo[use] - begin, hi[use] - begin)))
        anchor, near, far, g, span = (np.concatenate(x) for x in zip(*out, strict=True))
        return np.zeros(len(anchor), np.int64), anchor, near, far, g, span
    row, anchor, lo, hi = _runs(data, offsets, depth, gram)
    near, far, g, span = prints(Prefixes(data), anchor, lo, hi)
    return row, anchor - offsets[row], near, far, g, span


def _anchorer(depth: int, gram: int, narrow: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, place, near, far, g, span = anchors(*raw(part.column("text")), depth, gram)
                if narrow:
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], ["g"])
                else:
                    node = part.column("node").take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([node, *(pa.array(x.view(np.int64)) for x in (g, span)), *(pa.array(x.astype(np.int32)) for x in (place, near, far))], ["node", "g", "span", "place", "near", "far"])

    return run


_ITEM = "g bigint, span bigint, place int, near int, far int, b int, size int"
_ROW = "g bigint, span bigint, b int, core bigint, near int, far int, bytes binary"


def _blocks(depth: int, gram: int, size: int):
    """The bytes of each block of `size` windows of each listed run, and a hash of what all windows of the block have in common."""
    names = ["g", "span", "place", "near", "far", "b", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = raw(part.column("text"))
                lists = part.column("todo")
                count = np.diff(np.asarray(lists.offsets)).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), count)
                flat = lists.flatten()
                g, span, place, near, far, b, wide = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in names)
                last = np.minimum(b + wide - 1, far)
                lo = b + np.maximum(near - b, 0) // size * size
                times = np.maximum(0, (last - lo) // size + 1)
                item = np.repeat(np.arange(len(g)), times)
                s0 = lo[item] + (np.arange(len(item)) - np.repeat(np.cumsum(times) - times, times)) * size
                s1 = np.minimum(s0 + size, depth - gram + 1) - 1
                nearest, farthest = np.maximum(near[item], s0), np.minimum(last[item], s1)
                at = offsets[row[item]] + place[item]
                core = Prefixes(data)(at - s0, at - s1 + depth)
                for i in range(0, len(item), 1 << 14):
                    use = slice(i, i + (1 << 14))
                    begin, length = (at - farthest)[use], (farthest - nearest)[use] + depth
                    ends = np.concatenate(([0], np.cumsum(length)))
                    held = data[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])]
                    held = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(held)])
                    longs = [pa.array(x[item[use]]) for x in (g, span)]
                    ints = [pa.array(x[use].astype(np.int32)) for x in (s0, nearest, farthest)]
                    yield pa.RecordBatch.from_arrays([*longs, ints[0], pa.array(core[use].view(np.int64)), *ints[1:], held], ["g", "span", "b", "core", "near", "far", "bytes"])

    return run


def digit_passes(text: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix within their groups, most significant digit first, and the common prefix with the row before; -1 where a group begins."""
    n, width = text.shape
    words = np.ascontiguousarray(np.pad(text, ((0, 0), (0, -width % 8)))).view(">u8").astype(np.uint64)
    order = np.lexsort((words[:, 0], group))
    opens = np.ones(n, bool)
    opens[1:] = (group[order[1:]] != group[order[:-1]]) | (words[order[1:], 0] != words[order[:-1], 0])
    for digit in range(1, words.shape[1]):
        alone = opens & np.append(opens[1:], True)
        at = np.flatnonzero(~alone)  # places in groups of two or more
        if not len(at):
            break
        label = np.cumsum(opens[at])
        step = np.lexsort((words[order[at], digit], label))
        order[at] = order[at][step]
        value = words[order[at], digit]
        opens[at[1:]] |= (label[1:] == label[:-1]) & (value[1:] != value[:-1])
    prefix = np.full(n, -1)
    differs = text[order[1:]] != text[order[:-1]]
    same = group[order[1:]] == group[order[:-1]]
    prefix[1:][same] = np.where(differs.any(1), differs.argmax(1), width)[same]
    return order, prefix


def equal_windows(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, near: np.ndarray, far: np.ndarray, depth: int) -> np.ndarray:
    """(rows, distances) flags of windows that two rows of a group have in common. A row's bytes are its windows far to near."""
    n, width = len(near), int(far.max()) + 1

    def matrix(begin: np.ndarray, length: np.ndarray, step: int, columns: int) -> np.ndarray:
        out = np.zeros((n, columns), np.uint8)
        row = np.repeat(np.arange(n), length)
        k = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        out[row, k] = data[begin[row] + step * k]
        return out

    anchor = offsets[:-1] + far
    classes = []
    for text in (matrix(anchor - 1, far, -1, max(1, width - 1)), matrix(anchor, depth - near, 1, depth)):
        order, prefix = digit_passes(text, group)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        classes.append((prefix, place))
    (before, left), (after, right) = classes
    found = np.zeros((n, width), bool)
    for d in range(int(near.min()), width):
        use = np.flatnonzero((near <= d) & (far >= d))
        pair = np.cumsum(before < d)[left[use]] * (n + 1) + np.cumsum(after < depth - d)[right[use]]
        _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        found[use[count[inverse] > 1], d] = True
    return found


def _sorter(depth: int):
    """Distances of repeated windows, as runs, of each class. Rows come with their buckets (g, b, core) in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sort(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
            data, offsets = raw(table.column("bytes"))
            near, far = (table.column(x).to_numpy().astype(np.int64) for x in ("near", "far"))
            found = np.pad(equal_windows(data, offsets, group, near, far, depth), ((0, 0), (1, 1))).astype(np.int8)
            edge = np.diff(found, axis=1)
            row, first = np.nonzero(edge == 1)
            _, stop = np.nonzero(edge == -1)
            of = [table.column(x).combine_chunks().take(pa.array(row)) for x in ("g", "span")]
            return pa.RecordBatch.from_arrays([*of, pa.array(first.astype(np.int32)), pa.array((stop - first).astype(np.int32))], ["g", "span", "b", "size"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            group = _bucket_of(table)
            whole = int(np.searchsorted(group, group[-1]))  # the last bucket may go on
            if whole:
                yield sort(table.slice(0, whole), group[:whole])
                held = table.slice(whole).combine_chunks().to_batches()
        if sum(x.num_rows for x in held):
            table = pa.Table.from_batches(held)
            yield sort(table, _bucket_of(table))

    return run


def _bucket_of(table: pa.Table) -> np.ndarray:
    """Number of each row's bucket, ascending."""
    key = np.stack([table.column(x).to_numpy().astype(np.int64) for x in ("g", "b", "core")], 1)
    return np.cumsum(np.append(True, (key[1:] != key[:-1]).any(1)))


def _sorted(rows: DataFrame, depth: int) -> DataFrame:
    dealt = rows.repartition("g", "b", "core").sortWithinPartitions("g", "b", "core")
    return written(dealt.mapInArrow(_sorter(depth), "g bigint, span bigint, b int, size int"), "sorted")


def _salted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with keys, the rows of one key dealt to SALTS tasks by their span. keys are hot ones: each is sent so often."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("span"), F.lit(SALTS)).cast("int"))
    return salted.join(keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "salt"]).drop("salt")


def repeated_ranges(texts: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """(node, ranges): the byte ranges of each distinct text that repeated windows cover. texts: (id, node, text), a row for each occurrence."""
    if not 0 < gram < depth:
        raise ValueError("gram is below depth")
    width = depth - gram + 1
    small = texts.select("text").mapInArrow(_anchorer(depth, gram, True), "g bigint")
    shared = written(small.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1").select("g"), "grams", light=True)
    rows = texts.select("node", "text").mapInArrow(_anchorer(depth, gram, False), "node binary, g bigint, span bigint, place int, near int, far int")
    hits = written(rows.join(shared, "g"), "hits", light=True)  # a table of its own: what follows would keep a hot gram in one task
    forget(shared)
    place = written(hits.groupBy("g", "span", "node", "place", "near", "far").agg(F.count("*").alias("m")), "anchors", light=True)
    forget(hits)

    classes = place.groupBy("g", "span").agg(F.sum("m").alias("n"), F.min(F.struct("node", "place", "near", "far")).alias("r"))
    classes = written(classes.select("g", "span", "n", "r.*"), "classes", light=True)
    mixed = written(classes.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1"), "mixed", light=True)
    todo = written(classes.join(mixed, "g").select("g", "span", "node", "place", "near", "far", F.lit(0).alias("b"), F.lit(width).alias("size"), (F.col("c") <= LIMIT).alias("few"), (F.col("n") == 1).alias("lone")), "todo", light=True)
    whole = written(classes.filter("n > 1").select("g", "span"), "whole", light=True)
    forget(classes, mixed)

    needed = written(todo.select("node").distinct(), "nodes", light=True)
    first = texts.groupBy("node").agg(F.min("id").alias("id"))  # one row for each text, before anything joins on a hot one
    owner = written(first.join(needed, "node"), "owners", light=True)
    same = texts["id"].eqNullSafe(owner["id"]) & (texts["node"] == owner["node"])
    text = written(texts.join(owner.hint("merge"), same, "left_semi").select("node", "text").dropDuplicates(["node"]), "texts")
    forget(needed, owner)

    def blocks(items: DataFrame, size: int) -> DataFrame:
        lists = items.groupBy("node").agg(F.collect_list(F.struct("g", "span", "place", "near", "far", "b", "size")).alias("todo"))
        return lists.join(text, "node").mapInArrow(_blocks(depth, gram, size), _ROW)

    found = [_sorted(blocks(todo.filter("few"), width), depth)]
    many = todo.filter("not few")
    for size in BLOCKS if not many.isEmpty() else ():
        split = written(blocks(many, size), "split")
        if size == 1:
            last = split.groupBy("g", "b", "bytes").agg(F.count("*").alias("c")).filter("c > 1").select("g", "b", "bytes")
            single = _salted(split, last, ["g", "b", "bytes"]).select("g", "span", "b").distinct()
            island = F.col("b") - F.row_number().over(Window.partitionBy("g", "span").orderBy("b"))
            runs = single.withColumn("island", island).groupBy("g", "span", "island").agg(F.min("b").alias("b"), F.count("*").cast("int").alias("size"))
            found.append(written(runs.drop("island"), "sorted"))
        else:
            counts = written(split.groupBy("g", "b", "core").agg(F.count("*").alias("c")).filter("c > 1"), "counts", light=True)
            found.append(_sorted(split.join(counts.filter(F.col("c") <= LIMIT), ["g", "b", "core"]), depth))
            more = _salted(split, counts.filter(F.col("c") > LIMIT), ["g", "b", "core"]).select("g", "span", "b", F.lit(size).alias("size"))
            runs = todo.select("g", "span", "node", "place", "near", "far")
            many = written(more.join(runs, ["g", "span"]), "many", light=True)
            forget(counts)
            if many.isEmpty():
                break
        forget(split)
    parts = functools.reduce(DataFrame.union, found).groupBy("g", "span").agg(F.collect_list(F.struct("b", "size")).alias("parts"))  # a run has few
    part = written(todo.filter("lone").select("g", "span", "node", "place", "near", "far").join(parts, ["g", "span"]), "part", light=True)  # the other classes are repeated as wholes
    forget(todo, text, *found)
    lo, hi = (lambda p: F.greatest(p["b"], F.col("near"))), (lambda p: F.least(p["b"] + p["size"] - 1, F.col("far")))
    some = F.transform(F.filter("parts", lambda p: lo(p) <= hi(p)), lambda p: F.struct((F.col("place") - hi(p)).alias("start"), (F.col("place") - lo(p) + depth).alias("stop")))
    every = F.array(F.struct((F.col("place") - F.col("far")).alias("start"), (F.col("place") - F.col("near") + depth).alias("stop")))
    ranges = place.join(whole, ["g", "span"]).select("node", every.alias("ranges")).union(part.select("node", some.alias("ranges")))
    ranges = written(ranges.groupBy("node").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "ranges", light=True)
    forget(part, whole, place)
    return ranges


def _remover(n_kept: int, names: list[str], clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = raw(part.column("text"))
                lists = part.column("ranges")
                count = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), count)
                flat = lists.flatten()
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, offsets[row] + flat.field("start").to_numpy(zero_copy_only=False), 1)
                np.add.at(edge, offsets[row] + flat.field("stop").to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(edge[:-1]) > 0
                begin = gone.copy()
                inner = np.zeros(len(data) + 1, bool)
                inner[offsets] = True
                begin[1:] &= ~gone[:-1] | inner[1:-1]
                total = np.concatenate(([0], np.cumsum(gone)))[offsets]
                spans = np.concatenate(([0], np.cumsum(begin)))[offsets]
                kept, to = data[~gone].tobytes(), offsets - total
                pieces = [kept[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]
                if clean:
                    new = [pa.array([x.decode("utf-8", "ignore") for x in pieces], pa.string())]
                else:
                    new = [pa.array(np.diff(offsets)), pa.array(np.diff(total)), pa.array(np.diff(spans)), pa.array([hashlib.sha256(x).hexdigest() for x in pieces])]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n_kept)), *new], names)

    return run


def _cleaned(docs: DataFrame, kept: list[str], id_col: str, text_col: str, depth: int, new: dict[str, str], clean: bool) -> DataFrame:
    """The kept columns of docs, as carried() has them, and what _remover() gives of each row. new: its columns and their types."""
    whole = F.coalesce(named([text_col])[0], F.lit(""))
    base = carried(docs, kept, node=F.unhex(F.md5(whole)), text=whole)
    given = named([id_col])[0] if id_col in docs.columns else F.lit(None).cast("long")
    found = repeated_ranges(docs.select(given.alias("id"), F.unhex(F.md5(whole)).alias("node"), whole.alias("text")), depth)
    schema = StructType(base.schema.fields[:-2])
    for name, kind in new.items():
        schema = schema.add(name, kind)
    return base.join(found.hint("merge"), "node", "left").drop("node").mapInArrow(_remover(len(kept), schema.names, clean), schema)


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    new = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    return restored(_cleaned(docs, [id_col], id_col, text_col, depth, new, False), ["doc_id"], {n: n for n in new})


def remove_repeats(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, id_col: str = "doc_id") -> DataFrame:
    """docs with repeated bytes taken out of the text column; other columns as they were. id_col: tells copies apart, if there is one."""
    kept = [c for c in docs.columns if c != text_col]
    done = _cleaned(docs, kept, id_col, text_col, depth, {"clean": "string"}, True)
    return restored(done, kept, {"clean": text_col}).select(*named(docs.columns))


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes under repeated 200-byte strings of all whole texts."""
    return repeat_report(read(spark, sf_dir, "documents"))
