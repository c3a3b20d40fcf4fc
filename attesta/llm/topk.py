"""Exact top-k inner products: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds.

Components become whole numbers floor(scale * x), kept as doubles, which hold them
exactly at any size; scores are exact integers. Vectors are dealt in order of
descending length into packed blocks. A rotation from the singular vectors of all
vectors (the d x d Gram matrix is summed over the cluster) moves most of each inner
product into a few leading components. A block of queries meets a block of vectors
piece by piece, longest first:

1. |q| |v| bounds every score of the piece and of all shorter ones: a query whose
   k-th score so far is above it is done with the block.
2. The partial sum over the leading components plus the product of the residual
   lengths bounds each score; only pairs whose bound reaches the query's k-th score
   are multiplied out.

The block of the longest vectors goes first and gives every query a k-th score. From
it and the longest vector of each block follows, before anything is copied, how many
blocks a query can still gain from (its reach). Queries of like reach form the sets
that meet the other blocks, so a block is sent only to sets that may need it and a
query only to blocks within its reach. Blocks bound the memory of a task; the k best
of each block are merged at the end. Queries are a stated subset against all rows.
The driver holds the greatest length of each block and the count of queries of each
reach: at most one row for each BLOCK vectors.

Defined results: vectors that are null, or hold a null, NaN or infinite component,
take no part; shorter vectors count as ending in zeros; ties go to the smaller id;
a query's own row is no candidate, while other rows of its id are, and each row of a
repeated query id is a query; rows with a null id take no part; with fewer than k
candidates all are returned; empty tables give no row; other columns are ignored. A
score that is multiplied out and does not fit a long, or a component that is not
finite after scaling, raises OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, written

BLOCK, QUERY_BLOCK, PIECE = 8192, 4096, 1024
_NONE = np.iinfo(np.int64).min


def _integers(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat = lists.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            ends = np.cumsum(size)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            good = bad[ends] == bad[ends - size]
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(scale * values)
                if not np.isfinite(whole[np.isfinite(values)]).all():
                    raise OverflowError("a component is not finite after scaling")
            rows = [whole[b - n : b] for b, n, ok in zip(ends.tolist(), size.tolist(), good.tolist(), strict=True) if ok]
            kept = batch.column("vec_id").filter(pa.array(good))
            with np.errstate(over="ignore"):
                length = pa.array([float(np.dot(x, x)) for x in rows], pa.float64())
            yield pa.RecordBatch.from_arrays([kept, length, pa.array([len(x) for x in rows], pa.int32()), pa.array([x.astype("<f8").tobytes() for x in rows], pa.binary())], ["vec_id", "length2", "dim", "v"])

    return run


def _matrix(rows: list[bytes], dim: int) -> np.ndarray:
    if rows and all(len(r) == 8 * dim for r in rows):
        return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), dim)
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        x = np.frombuffer(r, "<f8")
        out[i, : len(x)] = x
    return out


def _gram(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column("v").to_pylist(), dim)
            with np.errstate(over="ignore", invalid="ignore"):
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.reshape(-1))], ["cell", "x"])

    return run


def _packer(dim: int, block: int):
    """Blocks of rows in the order they come: ids, row numbers, the matrix and the greatest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rids, rows, longest = [], [], [], 0.0

        def close() -> pa.RecordBatch:
            values = [np.array(ids, "<i8").tobytes(), np.array(rids, "<i8").tobytes(), _matrix(rows, dim).tobytes()]
            out = pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in values), pa.array([longest])], ["ids", "rids", "m", "longest"])
            for held in (ids, rids, rows):
                held.clear()
            return out

        for batch in batches:
            for i, n, r, length2 in zip(*(batch.column(x).to_pylist() for x in ("vec_id", "rid", "v", "length2")), strict=True):
                longest = max(longest, float(np.sqrt(length2))) if ids else float(np.sqrt(length2))
                ids.append(i)
                rids.append(n)
                rows.append(r)
                if len(ids) >= block:
                    yield close()
        if ids:
            yield close()

    return run


def _scores(q: np.ndarray, v: np.ndarray, open_: np.ndarray, greatest: float) -> np.ndarray:
    """Exact scores of the open pairs, _NONE for the rest. greatest: a bound of all of them."""
    out = np.full(open_.shape, _NONE)
    if greatest < 2.0**52:  # doubles hold every partial sum
        if open_.mean() > 0.02:
            return np.where(open_, (q @ v.T).astype(np.int64), _NONE)
        a, b = np.nonzero(open_)
        out[a, b] = (q[a] * v[b]).sum(1)
    elif greatest < 2.0**62 and max(np.abs(q).max(initial=0), np.abs(v).max(initial=0)) < 2.0**62:
        out = np.where(open_, q.astype(np.int64) @ v.astype(np.int64).T, _NONE)
    else:
        for a, b in zip(*np.nonzero(open_), strict=True):
            exact = sum(int(x) * int(y) for x, y in zip(q[a].tolist(), v[b].tolist(), strict=True))
            if not -(2**63) < exact < 2**63:
                raise OverflowError("a score does not fit a long")
            out[a, b] = exact
    return out


@np.errstate(over="ignore", invalid="ignore")
def best(q: np.ndarray, query_rids: np.ndarray, least: np.ndarray, v: np.ndarray, ids: np.ndarray, rids: np.ndarray, rotation: np.ndarray, k: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, id and score of up to k best vectors for each query, of those that score `least` or more."""
    n = len(q)
    top = np.full((n, k), _NONE)
    who = np.full((n, k), np.iinfo(np.int64).max)
    floor = least.astype(np.float64).copy()
    length_q, length_v = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
    order = np.argsort(-length_v, kind="stable")
    v, ids, rids, length_v = v[order], ids[order], rids[order], length_v[order]
    rq, rv = q @ rotation, v @ rotation
    rest_q, rest_v = np.sqrt((rq[:, lead:] ** 2).sum(1)), np.sqrt((rv[:, lead:] ** 2).sum(1))
    for begin in range(0, len(v), PIECE):
        s = slice(begin, begin + PIECE)
        slack = 1e-7 * length_q * length_v[begin] + 1e-3
        live = np.flatnonzero(~(length_q * length_v[begin] + slack < floor))  # what is not a number stays
        if not len(live):
            break
        bound = rq[live, :lead] @ rv[s, :lead].T + np.outer(rest_q[live], rest_v[s]) + slack[live, None]
        open_ = ~(bound < floor[live, None])
        open_ &= query_rids[live, None] != rids[None, s]
        some = open_.any(1)
        live, open_ = live[some], open_[some]
        if not len(live):
            continue
        score = _scores(q[live], v[s], open_, float(length_q[live].max()) * float(length_v[begin]))
        by_id = np.argsort(ids[s], kind="stable")
        score, named = score[:, by_id], ids[s][by_id]
        if score.shape[1] > 4 * k:  # what is below the k-th score can go; ties stay
            kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        else:
            kth = np.full(len(live), _NONE)
        a, b = np.nonzero((score >= np.maximum(kth, top[live, -1])[:, None]) & (score > _NONE))
        row = np.concatenate((np.repeat(live, k), live[a]))
        value = np.concatenate((top[live].reshape(-1), score[a, b]))
        name = np.concatenate((who[live].reshape(-1), named[b]))
        sort = np.lexsort((name, ~value, row))
        row, value, name = row[sort], value[sort], name[sort]
        first = np.searchsorted(row, live)
        take = first[:, None] + np.arange(k)
        top[live], who[live] = value[take], name[take]
        full = live[top[live, -1] > _NONE]
        floor[full] = np.maximum(floor[full], top[full, -1].astype(np.float64))
    row, at = np.nonzero(top > _NONE)
    return row, who[row, at], top[row, at]


def _sets(counts: list[tuple[int, int]], size: int) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """First set and number of sets of each reach, and the greatest reach of each set. counts: (reach, queries), ascending."""
    of, reach, room = {}, [], 0
    for r, n in counts:
        if n <= room:
            room -= n
            of[r] = (len(reach) - 1, 1)
            reach[-1] = r
        else:
            many = -(-n // size)
            of[r] = (len(reach), many)
            reach += [r] * many
            room = size - n if many == 1 else 0
    return of, reach


def top_inner_products(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", is_query: str = "vec_id % 50 = 0", k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score). is_query: SQL condition on vec_id."""
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null and not exists(vector, x -> x is null)")
    whole = base.mapInArrow(_integers(scale), "vec_id bigint, length2 double, dim int, v binary").withColumn("rid", F.monotonically_increasing_id())
    whole = written(whole, "vectors")
    rows, dim = whole.agg(F.count("*"), F.max("dim")).head()
    result = "rid bigint, vec_id bigint, score bigint"
    spark = vectors.sparkSession
    if not rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dim = max(1, dim)
    gram = np.zeros(dim * dim)
    for r in whole.select("v").mapInArrow(_gram(dim), "cell bigint, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():  # dim * dim rows
        gram[r["cell"]] = r["x"]
    if not np.isfinite(gram).all():
        gram = np.eye(dim).reshape(-1)
    share, rotation = np.linalg.eigh(gram.reshape(dim, dim))
    order = np.argsort(-share)
    rotation = np.ascontiguousarray(rotation[:, order])
    energy = np.cumsum(np.maximum(share[order], 0))
    lead = int(min(dim, max(1, np.searchsorted(energy, 0.6 * energy[-1]) + 1))) if energy[-1] > 0 else 1

    parts = max(1, -(-rows // BLOCK))
    dealt = whole.repartitionByRange(parts, F.desc("length2"), "vec_id").sortWithinPartitions(F.desc("length2"), "vec_id")
    packed = dealt.select("vec_id", "rid", "v", "length2").mapInArrow(_packer(dim, BLOCK), "ids binary, rids binary, m binary, longest double")
    packed = written(packed.withColumn("b", F.monotonically_increasing_id()), "blocks")
    known = sorted((r["b"], r["longest"]) for r in packed.select("b", "longest").collect())  # one row a block
    longest = np.maximum.accumulate(np.array([x for _, x in known])[::-1])[::-1]
    asked = whole.filter(F.expr(is_query)).select("rid", "vec_id", "v", "length2")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        queries = _matrix(left.column("v").to_pylist(), dim)
        query_rids = left.column("rid").to_numpy().astype(np.int64)
        least = left.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
        least = np.where(np.isnan(least), -np.inf, least)
        out = []
        for ids, rids, m in zip(*(right.column(x).to_pylist() for x in ("ids", "rids", "m")), strict=True):
            ids, rids = np.frombuffer(ids, "<i8"), np.frombuffer(rids, "<i8")
            row, name, score = best(queries, query_rids, least, np.frombuffer(m, "<f8").reshape(len(ids), dim), ids, rids, rotation, k, lead)
            out.append(pa.table([pa.array(query_rids[row]), pa.array(name), pa.array(score)], ["rid", "vec_id", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 3, ["rid", "vec_id", "score"])

    def meet(queries: DataFrame, blocks: DataFrame) -> DataFrame:
        """queries: (qb, j, rid, v, least), blocks: (qb, j, ids, rids, m)."""
        return queries.groupBy("qb", "j").cogroup(blocks.groupBy("qb", "j")).applyInArrow(search, result)

    def merged(found: DataFrame) -> DataFrame:
        line = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)

    first = packed.filter(F.col("b") == known[0][0])
    sets = max(1, -(-asked.count() // QUERY_BLOCK))
    opening = asked.select(F.pmod(F.xxhash64("rid"), F.lit(sets)).alias("qb"), F.lit(0).alias("j"), "rid", "v", F.lit(None).cast("double").alias("least"))
    start = meet(opening, first.select(F.explode(F.expr(f"sequence(0L, {sets - 1}L)")).alias("qb"), F.lit(0).alias("j"), "ids", "rids", "m"))
    start = written(merged(start).drop("rank"), "first")
    found = start
    if len(known) > 1:
        least = start.groupBy("rid").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))

        def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = np.sqrt(batch.column("length2").to_numpy())
                need = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(divide="ignore", invalid="ignore"):
                    shortest = (need - 1e-3) / (size * (1 + 1e-7))  # of a vector that could reach the k-th score
                shortest = np.where(np.isfinite(shortest), shortest, -np.inf)
                reach = np.searchsorted(-longest[1:], -shortest, "right")
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("rid", "v", "least")), pa.array(reach.astype(np.int32))], ["rid", "v", "least", "reach"])

        far = asked.join(least, "rid", "left").select("rid", "v", "length2", "least").mapInArrow(reaching, "rid bigint, v binary, least double, reach int")
        far = written(far.filter("reach > 0"), "reach")
        counts = sorted((r["reach"], r["count"]) for r in far.groupBy("reach").count().collect())  # one row a block at most
        of, reach = _sets(counts, QUERY_BLOCK)
        if reach:
            dealt_to = spark.createDataFrame([(r, a, n) for r, (a, n) in of.items()], "reach int, first int, many int")
            left = far.join(dealt_to, "reach").withColumn("qb", (F.col("first") + F.pmod(F.xxhash64("rid"), F.col("many"))).cast("long"))
            left = left.select("qb", F.explode(F.sequence(F.lit(1), "reach")).alias("j"), "rid", "v", "least")
            needed = np.searchsorted(np.array(reach), np.arange(1, len(known)), "left")  # the first set that reaches block j
            places = [(known[j][0], j, int(s)) for j, s in enumerate(needed, 1) if s < len(reach)]
            right = packed.join(spark.createDataFrame(places, "b bigint, j int, s int"), "b")
            right = right.select(F.explode(F.expr(f"sequence(cast(s as bigint), {len(reach) - 1}L)")).alias("qb"), "j", "ids", "rids", "m")
            found = start.union(meet(left, right))
    best_of = merged(found).join(asked.select("rid", F.col("vec_id").alias("query_id")), "rid")
    return best_of.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The five best rows for each vector whose id 50 divides."""
    return top_inner_products(read(spark, sf_dir, "embeddings"))
