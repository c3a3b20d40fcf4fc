"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

An id is replaced by its rank, 0 for the most frequent id of the corpus, and the
rank is written in one to four bytes, least significant first. Two control bits a
value hold the length less one; four values share a control byte, and the control
bytes stand apart from the data bytes, so a reader finds all lengths by one table
lookup and all values by vectorised gathers.

A file is a table of blocks. A block holds whole documents in ascending doc_id
order: their ids and token counts, the number of ids before the block in the
whole output, its control bytes and its data bytes. Blocks ascend within a file
and files ascend by shard, so the output in (shard, block) order is the corpus in
doc_id order. The rank table is a second small table beside the blocks, bounded by
the vocabulary.

Each text is encoded once. Ids wait in a table of two or four bytes an id; shard
bounds come from ids and counts alone; payloads are then dealt straight to their
shard, sorted there and written.

Defined results: null and empty texts hold the end id only; repeated doc_ids are
kept, and a null doc_id comes first, rows of one id in the order of their bytes;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, read, shared_folder, slices, written
from .tokens import encoded, ids_of

BLOCK_BYTES = 1 << 20
#: Bytes of each of the four values of a control byte.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.int64)


def pack(values: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each document. A document starts a new control byte; absent values of its last one have no data."""
    values = values.astype(np.uint32)
    size = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    count = np.diff(offsets)
    quads = -(-count // 4)
    first = np.cumsum(quads) - quads
    slot = np.arange(len(values)) - np.repeat(offsets[:-1] - 4 * first, count)
    codes = np.zeros(int(quads.sum()) * 4, np.uint8)
    codes[slot] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    ends = np.concatenate(([0], np.cumsum(size)))
    data = np.zeros(int(ends[-1]), np.uint8)
    for i in range(4):
        use = size > i
        data[ends[:-1][use] + i] = values[use] >> np.uint32(8 * i) & np.uint32(0xFF)
    c, d = control.tobytes(), data.tobytes()
    at, to = np.concatenate(([0], np.cumsum(quads))), ends[offsets]
    return [c[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], [d[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]


def unpack(control: bytes, data: bytes, count: np.ndarray) -> np.ndarray:
    """The values of a block whose documents hold `count` values each."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    quads = -(-count // 4)
    first = np.cumsum(quads) - quads
    slot = np.arange(int(count.sum())) + np.repeat(4 * first - (np.cumsum(count) - count), count)
    size = size[slot]
    at = np.cumsum(size) - size
    source = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))).astype(np.uint32)
    value = source[at]
    for i in range(1, 4):
        use = size > i
        value[use] |= source[at[use] + i] << np.uint32(8 * i)
    return value


_BLOCK = "shard int, block int, start bigint, doc_ids binary, no_id binary, counts binary, control binary, data binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = 1, vocabulary: int = 1 << 16) -> None:
    """Encode every text with the tokenizers file and write blocks and ranks under path. doc_id is an integer column."""
    spark = docs.sparkSession
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    waiting = written(encoded(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, [], tokenizer, end, width), "ids")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                ids, _ = ids_of(part.column("ids"), width)
                total += np.bincount(ids, minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    counts = waiting.select("ids").mapInArrow(tally, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = counts.collect()  # one row an id at most
    order = np.array([r["id"] for r in sorted(ranked, key=lambda r: (-r["n"], r["id"]))], np.int64)
    spark.createDataFrame([(order.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(vocabulary, np.uint32)
    rank[order] = np.arange(len(order))

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = written(waiting.select("doc_id", "n_tokens").repartitionByRange(shards, "doc_id"), "sizes")
    bounds = [r["b"] for r in sizes.groupBy(F.input_file_name()).agg(F.max("doc_id").alias("b")).collect() if r["b"] is not None]  # one row a shard
    bounds = np.unique(np.array(bounds, np.int64))
    shards = max(1, len(bounds))

    def shard_of(column: pa.Array) -> np.ndarray:
        found = np.searchsorted(bounds, column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        return np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.minimum(found, shards - 1)).astype(np.int32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shards, np.int64)
        for batch in batches:
            np.add.at(total, shard_of(batch.column("doc_id")), batch.column("n_tokens").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shards, dtype=np.int32)), pa.array(total)], ["shard", "n"])

    held = np.zeros(shards, np.int64)
    for r in sizes.mapInArrow(place, "shard int, n bigint").groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row a shard
        held[r["shard"]] = r["n"]
    starts = np.cumsum(held) - held

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                ids, offsets = ids_of(part.column("ids"), width)
                control, data = pack(rank[ids], offsets)
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(part.column("doc_id"))), part.column("doc_id"), part.column("n_tokens"), pa.array(control, pa.binary()), pa.array(data, pa.binary())], ["shard", "doc_id", "n_tokens", "control", "data"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, number, shard, start = [], 0, 0, None, 0

        def close() -> pa.RecordBatch:
            nonlocal rows, size, number, start
            ids, n = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
            values = [np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(), n.astype("<u4").tobytes(), b"".join(r[2] for r in rows), b"".join(r[3] for r in rows)]
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), *(pa.array([x], pa.binary()) for x in values)], [x.split()[0] for x in _BLOCK.split(", ")])
            rows, size, number, start = [], 0, number + 1, start + int(n.sum())
            return out

        for batch in batches:
            for here, *row in zip(*(batch.column(x).to_pylist() for x in ("shard", "doc_id", "n_tokens", "control", "data")), strict=True):
                if rows and (size >= BLOCK_BYTES or here != shard):
                    yield close()
                if here != shard:
                    shard, number, start = here, 0, int(starts[here])
                rows.append(row)
                size += len(row[2]) + len(row[3])
        if rows:
            yield close()

    payload = waiting.select("doc_id", "n_tokens", "ids").mapInArrow(code, "shard int, doc_id bigint, n_tokens bigint, control binary, data binary")
    payload = payload.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n_tokens", "data", "control")
    payload.mapInArrow(block, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    forget(waiting, sizes)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files alone; ids are packed little-endian 32-bit integers."""
    order = np.frombuffer(spark.read.parquet(f"{path}/ranks").head()["ids"], "<u4")

    def unblock(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                count = np.frombuffer(r["counts"], "<u4").astype(np.int64)
                ids = order[unpack(r["control"], r["data"], count)].astype("<u4").tobytes()
                ends = np.cumsum(count)
                pieces = [ids[4 * a : 4 * b] for a, b in zip(ends - count, ends, strict=True)]
                doc = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["no_id"], np.uint8).astype(bool))
                out = [doc, pa.array(r["start"] + ends - count), pa.array(count), pa.array([zlib.crc32(x) for x in pieces], pa.int64())]
                out += [pa.array(pieces, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return spark.read.schema(_BLOCK).parquet(f"{path}/blocks").mapInArrow(unblock, schema)


def op2_token_binary(spark, sf_dir: str) -> DataFrame:
    """What the written files hold of every document."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)
