"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue: its documents' ids, in input order, as one stream. Each
round adds to every queue's deficit its share of a window; a queue sends the whole
quanta that its deficit covers, as one run, and carries the rest to the next round.
What is sent forms one tape, cut at every window, so all windows but the last are
full, whichever partition their documents come from. A queue whose share of a window
is `packet` ids or more has a quantum of one id, so a window holds its share to
within an id or two and the shift of rounds against windows; a smaller queue sends
packets of `packet` ids (or all it has), fewer rounds apart, so that no run is a mere scrap. Queues
begin with different parts of a quantum as credit, or small queues of one share would
all send in the same round.

The schedule has a closed form: after r rounds a queue of share w has sent
floor((r w window + credit) / quantum) quanta, and all it has once its rounds' shares
cover that. So a piece's place on the tape follows from its place in its queue and the
queues' totals, and deficits cross windows and partitions without any task
waiting for another. Places in a queue are prefix sums: within a partition while
encoding, then over the partitions of a queue. Only one total a source reaches the
driver and the tasks; every source has its own queue and weight, however many there are.

Defined results: null and empty texts hold the end id only; null sources are one
queue; repeated rows and ids are packed again; an empty table gives no piece; a
text longer than a window is cut; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, slices, written
from .tokens import TEXT_SLICE, encoder, id_bytes, ids_of

WINDOW, PACKET, UNIT, BLOCK = 2048, 32, 16, 1 << 18
MAX_QUEUES = 1024  # whose shares UNIT bits suffice for; more queues have more bits


class Schedule:
    """Where each id of each queue lies on the tape. totals and weights: by queue number."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, window: int, packet: int):
        self.totals, self.window = totals.astype(np.int64), window
        share = weights / max(weights.sum(), 1e-300)
        self.unit = UNIT + (max(0, len(totals) - 1) // MAX_QUEUES).bit_length()
        self.weight = np.maximum(1, np.round(share * 2**self.unit)).astype(np.int64)
        self.step = window * self.weight  # what a round adds, in parts of an id
        self.quantum = np.where(self.step >= packet << self.unit, 1, np.clip(self.totals, 1, packet))
        spread = np.arange(len(self.totals)) * 0.6180339887498949 % 1
        self.credit = (spread * (self.quantum << self.unit)).astype(np.int64)

    def sent_by(self, rounds: np.ndarray, queue: np.ndarray | slice) -> np.ndarray:
        """Ids that the queues have sent after so many rounds."""
        step, quantum, total = self.step[queue], self.quantum[queue], self.totals[queue]
        whole = (rounds * step + self.credit[queue]) // (quantum << self.unit) * quantum
        return np.where(rounds * step >> self.unit >= total, total, np.minimum(whole, total))

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """(rounds, queues): ids that each queue has sent after so many rounds."""
        return self.sent_by(rounds[:, None], slice(None))

    def round_of(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The round that sends an id."""
        quantum, step = self.quantum[queue], self.step[queue]
        by_quanta = -((self.credit[queue] - ((at // quantum + 1) * quantum << self.unit)) // step)
        return np.minimum(by_quanta, -(-(self.totals[queue] << self.unit) // step))

    def place(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tape positions of ids."""
        rounds, which = np.unique(self.round_of(queue, at), return_inverse=True)
        order = np.argsort(which, kind="stable")
        out = np.empty(len(at), np.int64)
        rows = max(1, BLOCK // max(1, len(self.totals)))
        for i in range(0, len(rounds), rows):
            lo, hi = np.searchsorted(which, (i, i + rows), sorter=order)
            mine = order[lo:hi]
            r, q = which[mine] - i, queue[mine]
            before, after = self.sent(rounds[i : i + rows] - 1), self.sent(rounds[i : i + rows])
            earlier = np.cumsum(after, 1) - after  # of the queues before it in this round
            later = before.sum(1)[:, None] - np.cumsum(before, 1)
            out[mine] = earlier[r, q] + later[r, q] + at[mine]
        return out

    def pieces(self, queue: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, start in it, length and tape position of the pieces of documents at `start` in their queues."""
        fine = self.quantum[queue] == 1  # runs by rounds; the others by packets
        end = start + np.maximum(count, 1) - 1
        first = np.where(fine, self.round_of(queue, start), start // self.quantum[queue])
        last = np.where(fine, self.round_of(queue, end), end // self.quantum[queue])
        times = np.where(count > 0, last - first + 1, 0)
        doc = np.repeat(np.arange(len(start)), times)
        run = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
        q, by_round = queue[doc], fine[doc]
        lo = np.where(by_round, self.sent_by(run - 1, q), run * self.quantum[q])
        hi = np.where(by_round, self.sent_by(run, q), (run + 1) * self.quantum[q])
        lo, hi = np.maximum(lo, start[doc]), np.minimum(hi, (start + count)[doc])
        tape = self.place(q, lo)
        new = np.ones(len(doc), bool)  # neighbours on the tape are one piece
        new[1:] = (doc[1:] != doc[:-1]) | (tape[1:] != tape[:-1] + (hi - lo)[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(doc)) - 1
        doc, lo, hi, tape = doc[head], lo[head], hi[tail], tape[head]
        cuts = np.where(hi > lo, (tape + hi - lo - 1) // self.window - tape // self.window + 1, 0)
        item = np.repeat(np.arange(len(doc)), cuts)
        step = np.arange(len(item)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = np.maximum(tape[item], (tape[item] // self.window + step) * self.window)
        end = np.minimum((tape + hi - lo)[item], (tape[item] // self.window + step + 1) * self.window)
        doc, shift = doc[item], (lo - tape)[item]
        return doc, begin + shift - start[doc], end - begin, begin


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end: int | None = 1, window: int = WINDOW, packet: int = PACKET, weights: dict[str, float] | None = None, width: str = "<u2", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, queue, ids]), a row for each piece.

    weights: target share of each source; without them a source's share of all ids,
    by which all queues end together. width: packed size of an id while it waits.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("queue"), F.coalesce(F.col(text_col), F.lit("")).alias("att_text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, part_id, held = encoder(tokenizer, end), TaskContext.get().partitionId(), {}
        for batch in batches:
            for part in slices(batch, "att_text", TEXT_SLICE):
                ids, offsets = to_ids(part.column("att_text").to_pylist())
                before = []
                for q, n in zip(part.column("queue").to_pylist(), np.diff(offsets).tolist(), strict=True):
                    before.append(held.get(q, 0))
                    held[q] = before[-1] + n
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("queue"), pa.array([part_id] * part.num_rows, pa.int32()), pa.array(before, pa.int64()), pa.array(np.diff(offsets)), id_bytes(ids, offsets, width)], ["doc_id", "queue", "part", "before", "n", "ids"])

    waiting = written(base.mapInArrow(encode, f"doc_id {kind}, queue string, part int, before bigint, n bigint, ids binary"), "ids")
    held = written(waiting.groupBy("queue", "part").agg(F.sum("n").alias("n")), "held")
    earlier = F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")
    offsets = held.select("queue", "part", earlier.alias("offset"))
    found = sorted((r["queue"], r["n"]) for r in held.groupBy("queue").agg(F.sum("n").alias("n")).collect())  # one a source
    total = np.array([n for _, n in found], np.int64)
    share = total.astype(float)
    if weights is not None:
        share = np.array([max(0.0, float(weights.get(q, 0.0))) for q, _ in found])
        share = share if share.sum() else total.astype(float)
    schedule = Schedule(total, share, window, packet)
    number = {q: i for i, (q, _) in enumerate(found)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                line = np.array([number[q] for q in part.column("queue").to_pylist()], np.int64)
                start = (part.column("before").to_numpy() + part.column("offset").to_numpy()).astype(np.int64)
                count = part.column("n").to_numpy()
                ids, at = ids_of(part.column("ids"), width)
                doc, inside, length, tape = schedule.pieces(line, start, count)
                flat = memoryview(ids.astype("<u4").tobytes())
                begin = ((at[doc] + inside) * 4).tolist()
                stop = ((at[doc] + inside + length) * 4).tolist()
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(begin, stop, strict=True)]
                out = [part.column("doc_id").take(pa.array(doc)), pa.array(inside), pa.array(length), pa.array(crc, pa.int64()), pa.array(count[doc]), pa.array(tape // window), pa.array(tape % window)]
                if with_ids:
                    out += [part.column("queue").take(pa.array(doc)), pa.array([bytes(flat[a:b]) for a, b in zip(begin, stop, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "ids"][: len(out)])

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", queue string, ids binary" * with_ids
    return waiting.join(written(offsets, "offsets"), ["queue", "part"]).mapInArrow(place, schema)


def op5_mixture_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 ids, each window mixed as the corpus is."""
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
