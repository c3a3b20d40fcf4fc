"""What the operators share: shared-folder tables, Arrow text buffers, and vectorised word hashing.

Texts reach Python only as Arrow buffers. A batch is cut into slices of about a
megabyte, so that the numpy arrays of a slice stay small whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.plans import tables
from attesta.scratch import forget, shared_folder, stage

__all__ = ["Prefixes", "bounded", "carried", "forget", "free", "mix", "named", "powers", "raw", "read", "restored", "runs_of", "shared_folder", "slices", "words", "written"]

SLICE_BYTES = 1 << 18
BATCH_ROWS = 2000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def bounded(spark: SparkSession) -> None:
    """Arrow batches of few rows: a batch of whole texts is held several times over while it is handed to Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded(spark)
    return tables.read(spark, sf_dir, table)


_PARALLEL = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def written(df: DataFrame, label: str, light: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    light: what follows the last shuffle is cheap, so its parts are joined to the
    advisory size instead of to one for each core, which makes fewer tasks and files.
    """
    spark = df.sparkSession
    bounded(spark)
    before = spark.conf.get(_PARALLEL)
    if light:
        spark.conf.set(_PARALLEL, "false")
    try:
        return stage(df, label)
    finally:
        if light:
            spark.conf.set(_PARALLEL, before)


def free(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, or variants of them that are not taken, whatever the case."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def named(names: Iterable[str]) -> list[Column]:
    """Columns by their exact names, dots and backticks included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def carried(docs: DataFrame, kept: list[str], **more: Column) -> DataFrame:
    """The kept columns as k0, k1, ..., whatever their names, and more ones by name."""
    return docs.select(*(c.alias(f"k{i}") for i, c in enumerate(named(kept))), *(c.alias(n) for n, c in more.items()))


def restored(done: DataFrame, kept: list[str], more: dict[str, str]) -> DataFrame:
    """carried() columns by their own names, and more ones renamed."""
    return done.select(*(F.col(f"k{i}").alias(n) for i, n in enumerate(kept)), *(F.col(a).alias(b) for a, b in more.items()))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if not len(column) or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together hold about `limit` bytes, one row at least."""
    _, offsets = raw(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, kind: str = "up") -> np.ndarray:
    """The first n powers of the hash base, or of its inverse, modulo 2**64."""
    if kind not in _powers or len(_powers[kind]) < n:
        step = np.full(max(n, 1 << 16), _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        full = np.cumprod(step, dtype=np.uint64)
        if n > 1 << 23:  # one very long text: not kept
            return full[:n]
        _powers[kind] = full
    return _powers[kind][:n]


class Prefixes:
    """64-bit hashes of any byte ranges of a buffer, in constant time each."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _TABLE):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * powers(len(data)), out=self.sums[1:], dtype=np.uint64)
        self.inverse = powers(len(data) + 1, "down")

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, members: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes outside space and 0x09-0x0D, or of member bytes; runs never cross rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[data] if members is None else members[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, stop, np.searchsorted(offsets, start, "right") - 1


def runs_of(rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's items begin and how many there are, rows being sorted."""
    count = np.bincount(rows, minlength=n_rows)
    return np.concatenate(([0], np.cumsum(count)[:-1])), count
