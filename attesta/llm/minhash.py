"""Near-duplicate classes by weighted minwise signatures made of hashed darts (DartMinHash).

An element (a five-word shingle) of weight w owns the region [0, w) of a weight
axis. Darts fall on (element, weight, rank) as a Poisson process drawn from
hashes alone, so every document that owns a region sees the same darts in it.
A document keeps the darts of its own regions whose rank is below a bound set so
that about k ln k + 2k of them are expected; each dart belongs to one of k
coordinates, and the dart of the smallest rank in a coordinate is its signature
value there. Two documents agree in a coordinate with the probability of their
weighted Jaccard similarity. Work a document is O(shingles + k log k).

Bands of the signature propose pairs. A bucket first proposes each member against
one pivot, the member that shares most buckets with others. Proposed pairs are
verified on whole texts; classes are connected components of verified links, found
by min-label propagation with pointer jumping over written tables.

A bucket that still holds several classes then has its members compared across
classes on all their cells, in blocks of bounded rows and bytes: members of its
largest class meet the others, and the others meet each other. That copies no member
more than twice WIDE times on average. Buckets in which the others fill more than
WIDE blocks (many texts of one template, say) are not compared block by block: their
members go to new buckets by the rarest cells of each text, one cell in five or so. Two texts of
similarity t share one of their |x| - ceil(t |x|) + 1 rarest cells in any fixed
order of cells, so this loses nothing; the order comes from a sketch of bounded
size that counts cells over these members. No pair is settled by signatures, so
every link between texts that share a band is within a class.

Defined results: null texts and texts without a word are in a class of their own;
equal texts are always one class; a text of fewer than five words has its whole
word sequence as its only shingle; repeated rows give repeated result rows; a
null id takes part, and a class of null ids alone has a null class_id. Columns
other than the two named are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefixes, forget, mix, raw, read, runs_of, slices, words, written

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_DART = np.uint64(0xD1342543DE82EF95)
BLOCK, BLOCK_CHARS, WIDE = 256, 1 << 21, 8  # members and characters of a block of a bucket, and blocks that meet pair by pair
SKETCH_BITS = 18  # counters by which cells are ordered, whatever the corpus


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle; a shorter text has one shingle of all its words."""
    start, stop, row = words(data, offsets)
    n_rows = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = Prefixes(data)(start, stop)
    first, count = runs_of(row, n_rows)
    position = np.arange(len(word)) - first[row]
    total = np.zeros(len(word), np.uint64)
    for k in range(size):  # words beyond the text's last count as absent
        here = np.zeros(len(word), np.uint64)
        here[: max(0, len(word) - k)] = word[k:]
        here[position + k >= count[row]] = 0
        total = mix(total + here + _GOLD)
    keep = (position + size <= count[row]) | (position == 0)
    return total[keep], row[keep]


def layers(element: np.ndarray, row: np.ndarray, weighting: str) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of the regions: for weight by count, the i-th repeat of an element in a row is its cell i."""
    key = mix(element ^ mix(row.astype(np.uint64) + _GOLD))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    rank = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
    element, row = element[order], row[order]
    if weighting == "set":
        return element[new], row[new]
    return mix(element + rank.astype(np.uint64) * _DART), row


def dart_signatures(cell: np.ndarray, row: np.ndarray, n_rows: int, k: int, fill: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n_rows, k) signature and which rows have one. fill: the owned part of each unit cell, for weights that aren't whole."""
    signature = np.zeros((n_rows, k), np.uint64)
    weight = np.bincount(row, weights=fill, minlength=n_rows)
    whole = weight > 0
    bound = np.divide(k * np.log(k) + 2 * k, weight, out=np.zeros(n_rows), where=whole)
    todo = whole.copy()
    while todo.any():
        use = todo[row]
        c, r, f = cell[use], row[use], None if fill is None else fill[use]
        tau, slot, found, rank = np.zeros(len(c)), [], [], []
        for i in range(1 << 30):
            u = mix(c + np.uint64((2 * i + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
            tau = tau - np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
            near = tau < bound[r]
            c, r, tau = c[near], r[near], tau[near]
            if f is not None:
                f = f[near]
            if not len(c):
                break
            v = mix(c ^ np.uint64((2 * i + 2) * 0xA24BAED4963EE407 & (2**64 - 1)))
            own = slice(None) if f is None else ((v >> np.uint64(32)).astype(np.float64) * 2.0**-32 < f)
            slot.append((r * k + (v % np.uint64(k)).astype(np.int64))[own])
            found.append(mix(v + _GOLD)[own])
            rank.append(tau[own])
        slot, found, rank = (np.concatenate(x) if x else np.zeros(0) for x in (slot, found, rank))
        order = np.argsort(-rank, kind="stable")  # the earliest dart of a coordinate is written last
        flat, seen = signature.reshape(-1), np.zeros(n_rows * k, bool)
        slot = slot.astype(np.int64)
        flat[slot[order]] = found.astype(np.uint64)[order]
        seen[slot] = True
        todo &= ~seen.reshape(n_rows, k).all(1)
        bound[todo] *= 2
    return signature, whole


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(rows, bands) bucket keys; the band's number is part of the key."""
    n, k = signature.shape
    part = signature.reshape(n, bands, k // bands)
    key = np.tile(mix(np.arange(bands, dtype=np.uint64) + _GOLD), (n, 1))
    for i in range(k // bands):
        key = mix(key + part[:, :, i])
    return key.view(np.int64)


def _sketcher(size: int, k: int, bands: int, weighting: str):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = raw(part.column("text"))
                element, row = shingles(data, offsets, size)
                cell, row = layers(element, row, weighting)
                signature, whole = dart_signatures(cell, row, part.num_rows, k)
                keys = band_keys(signature, bands)
                at = np.concatenate(([0], np.cumsum(np.where(whole, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[whole].reshape(-1)), mask=pa.array(~whole))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), lists], ["doc_id", "node", "bands"])

    return sketch


def _verifier(size: int, weighting: str, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                sides = []
                for name in ("text_a", "text_b"):
                    cell, row = layers(*shingles(*raw(part.column(name)), size), weighting)
                    sides.append((mix(cell ^ mix(row.astype(np.uint64) + _GOLD)), row))
                (a, row_a), (b, row_b) = sides
                n = part.num_rows
                shared = np.bincount(row_a[np.isin(a, b)], minlength=n)
                union = np.bincount(row_a, minlength=n) + np.bincount(row_b, minlength=n) - shared
                keep = pa.array(shared >= threshold * np.maximum(union, 1))
                yield part.select(["a", "b"]).filter(keep)

    return verify


def shared_cells(cell: np.ndarray, row: np.ndarray, n: int, width: int = 4096) -> np.ndarray:
    """(n, n) counts of cells that two rows share; no row holds a cell twice."""
    _, inverse, count = np.unique(cell, return_inverse=True, return_counts=True)
    use = count[inverse] > 1
    at, of = (np.cumsum(count > 1) - 1)[inverse[use]], row[use]
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int((count > 1).sum()), width):
        a, b = np.searchsorted(at, (lo, lo + width))
        part = np.zeros((n, width), np.float32)
        part[of[a:b], at[a:b] - lo] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _forest(comp: list[bytes], cell: np.ndarray, row: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """Links between classes that a spanning forest of the rows needs."""
    n = len(comp)
    _, label = np.unique(np.array(comp, object), return_inverse=True)
    shared, size = shared_cells(cell, row, n), np.bincount(row, minlength=n)
    near = (shared >= threshold * (size[:, None] + size[None] - shared)) & (label[:, None] != label[None])
    for a in np.flatnonzero(near.any(1)):
        for b in np.flatnonzero(near[a]):
            if label[b] != label[a]:
                label[label == label[b]] = label[a]
                yield int(a), int(b)


def _comparer(size: int, weighting: str, threshold: float):
    """Links of each run of rows of one (key, i, j)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(group: pa.Table) -> pa.RecordBatch:
            cell, row = layers(*shingles(*raw(group.column("text")), size), weighting)
            found = list(_forest(group.column("comp").to_pylist(), cell, row, threshold))
            node = group.column("node").combine_chunks()
            return pa.RecordBatch.from_arrays([node.take(pa.array([x[i] for x in found], pa.int64())) for i in (0, 1)], ["a", "b"])

        held, of = [], None
        for batch in batches:
            spot = np.stack([batch.column(x).to_numpy() for x in ("key", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((spot[1:] != spot[:-1]).any(1)) + 1).tolist(), len(spot)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if stop == start:
                    continue
                if held and tuple(spot[start]) != of:
                    yield links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, stop - start))
                of = tuple(spot[start])
        if held:
            yield links(pa.Table.from_batches(held))

    return compare


def _sketcher_of_cells(size: int, weighting: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                cell, _ = layers(*shingles(*raw(part.column("text")), size), weighting)
                total += np.bincount((cell >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["slot", "n"])

    return count


def _rare_cells(size: int, weighting: str, threshold: float, sketch: np.ndarray):
    """(key, node): the rarest cells of each text, as many as two texts of the threshold can't both lack."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                cell, row = layers(*shingles(*raw(part.column("text")), size), weighting)
                order = np.lexsort((cell, sketch[(cell >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], row))
                cell, row = cell[order], row[order]
                first, count = runs_of(row, part.num_rows)
                take = count - np.ceil(threshold * count - 1e-9).astype(np.int64) + 1
                use = np.arange(len(row)) - first[row] < take[row]
                yield pa.RecordBatch.from_arrays([pa.array(cell[use].view(np.int64)), part.column("node").take(pa.array(row[use]))], ["key", "node"])

    return pick


def _mixed(placed: DataFrame, label: str) -> DataFrame:
    """(key, node, comp, main) of the buckets that hold several classes; main marks the largest class."""
    shares = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("key").agg(F.count("*").alias("c"), F.max(F.struct("n", "comp")).alias("p")).filter("c > 1")
    mixed = written(mixed.select("key", F.col("p.comp").alias("main")), "mixed", light=True)
    rest = written(placed.join(mixed, "key").select("key", "node", "comp", (F.col("comp") == F.col("main")).alias("main")), label, light=True)
    forget(mixed)
    return rest


def _blocks(rest: DataFrame, text: DataFrame) -> DataFrame:
    """(key, outer, inner): how many blocks the members outside and inside the largest class fill."""
    sized = rest.join(text.select("node", F.length("text").alias("size")), "node")
    parts = lambda main: F.ceil(F.greatest(F.sum(F.expr(f"int(main = {main})")) / BLOCK, F.sum(F.expr(f"if(main = {main}, size, 0L)")) / BLOCK_CHARS)).cast("int")
    return written(sized.groupBy("key").agg(parts("false").alias("outer"), parts("true").alias("inner")), "blocks", light=True)


def _compared(rest: DataFrame, counts: DataFrame, text: DataFrame, compare) -> DataFrame:
    """(a, b): links found block by block."""
    rest = rest.join(counts, "key")
    block = F.when(F.col("main"), F.col("outer") + F.pmod(F.xxhash64("node"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("node"), F.col("outer"))).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.when(F.col("main"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1))
    rest = rest.select("key", "node", "comp", block.alias("b"), meets.alias("x"))
    rest = rest.select("key", "node", "comp", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"))
    rest = rest.join(text, "node").select("key", "i", "j", "node", "comp", "text")
    rest = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return written(rest.mapInArrow(compare, "a binary, b binary"), "found")


def across(member: DataFrame, classes: DataFrame, text: DataFrame, size: int, weighting: str, threshold: float) -> list[DataFrame]:
    """(a, b): links between members of one bucket that are in different classes, as many as join all such classes."""
    compare = _comparer(size, weighting, threshold)
    placed = written(member.join(classes, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")), "placed", light=True)
    rest = _mixed(placed, "rest")
    counts = _blocks(rest, text)
    wide = written(rest.join(counts.filter(F.col("outer") > WIDE).select("key"), "key", "left_semi").select("node", "comp").distinct(), "wide", light=True)
    found = [_compared(rest, counts.filter(F.col("outer") <= WIDE), text, compare)]
    forget(placed, rest, counts)
    if not wide.isEmpty():
        texts = text.join(wide.select("node"), "node", "left_semi").select("node", "text")
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        counted = texts.mapInArrow(_sketcher_of_cells(size, weighting), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # 2**SKETCH_BITS rows at most
        sketch[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
        rare = texts.mapInArrow(_rare_cells(size, weighting, threshold, sketch), "key bigint, node binary")
        placed = written(rare.join(wide, "node").select("key", "node", "comp"), "placed", light=True)
        rest = _mixed(placed, "rest")
        counts = _blocks(rest, text)
        found.append(_compared(rest, counts, text, compare))
        forget(placed, rest, counts)
    forget(wide)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes in links (a, b): comp is the smallest node reached. Each round is a written table."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links", light=True)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels", light=True)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = written(labels.join(near, "node").select("node", F.least("comp", "m").alias("comp")), "labels", light=True)
        onto = step.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        after = written(step.join(onto, "comp").select("node", F.col("further").alias("comp")), "labels", light=True)
        moved = not after.join(labels.select("node", F.col("comp").alias("was")), "node").filter("comp <> was").isEmpty()
        forget(labels, step)
        if not moved:
            forget(both)
            return after
        labels = after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, k: int = 64, bands: int = 16, weighting: str = "count") -> DataFrame:
    """(doc_id, class_id, class_size) for every row of docs; class_id is the smallest id of the class.

    threshold: least weighted Jaccard similarity of a link. k darts a signature in
    `bands` bands: a pair of similarity 0.8 shares a band with probability
    1 - (1 - 0.8**4)**16 = 0.9998. weighting: "count" weighs a shingle by its
    repeats, "set" by one.
    """
    if weighting not in ("count", "set") or k % bands:
        raise ValueError("weighting is count or set, and bands divides k")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("node", F.unhex(F.md5("text")))
    id_type = base.schema["doc_id"].dataType.simpleString()
    sketch = written(base.select("doc_id", "node", "text").mapInArrow(_sketcher(size, k, bands, weighting), f"doc_id {id_type}, node binary, bands array<bigint>"), "sketch")

    rows = sketch.filter("bands is not null").select("node", "doc_id", F.explode("bands").alias("key"))
    rows = written(rows.groupBy("key", "node").agg(F.min("doc_id").alias("doc_id")), "bands", light=True)  # equal texts once
    full = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets", light=True)
    member = written(rows.join(full, "key").select("key", "node", "doc_id", "n"), "members", light=True)
    forget(rows, full)
    nodes = written(member.groupBy("node").agg(F.sum("n").alias("pop"), F.min("doc_id").alias("doc_id")), "nodes", light=True)
    popular = member.select("key", "node").join(nodes.select("node", "pop"), "node")
    pivot = written(popular.groupBy("key").agg(F.max(F.struct("pop", "node")).alias("p")).select("key", F.col("p.node").alias("b")), "pivots", light=True)

    same = base["doc_id"].eqNullSafe(nodes["doc_id"]) & (base["node"] == nodes["node"])
    text = base.join(nodes.hint("merge"), same, "left_semi").select("node", "text")
    text = written(text.dropDuplicates(["node"]), "texts")
    forget(nodes)

    def verified(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(text.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        with_b = with_a.join(text.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return with_b.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(size, weighting, threshold), "a binary, b binary")

    tested = written(member.select("key", "node").join(pivot, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct(), "pairs", light=True)
    links = written(verified(tested), "verified")
    forget(pivot, tested)
    classes = components(links)
    found = across(member, classes, text, size, weighting, threshold)
    forget(member, text)
    more = functools.reduce(DataFrame.union, found)
    if not more.isEmpty():
        forget(classes)
        classes = components(links.union(more))
    forget(links, *found)

    placed = sketch.select("doc_id", "node", F.col("bands").isNotNull().alias("has")).filter("has").join(classes, "node", "left")
    placed = written(placed.select("doc_id", F.coalesce("comp", "node").alias("class")), "placed", light=True)
    forget(classes)
    least = written(placed.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes", light=True)
    result = placed.join(least, "class").select("doc_id", "class_id", "class_size")
    alone = sketch.filter("bands is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    return result.union(alone)


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: its near-duplicate class, verified at 0.8 on five-word shingles."""
    return near_duplicates(read(spark, sf_dir, "documents"))
