"""Quality of texts by attention-based multiple-instance learning with gated attention.

A text is a bag of passages of PASSAGE words. A passage's input has two parts: its
content, which is its words and the characters' four-grams inside words, hashed into
BUCKETS signed counts, so that the first layer's weights are an embedding of every
word and n-gram that the passage averages; and its form, the mix of byte-class
bigrams (lower case, capital, digit, space, line end, punctuation, symbol, other)
and a few word statistics. A tanh layer encodes it. Gated attention, softmax over the
text's passages of w . (tanh(V h) * sigmoid(U h)), weighs the encoded passages, and a
logistic output on their weighted sum scores the text. All weights are learned
together from the labels of texts, by Adam.

The model is fitted on a bounded sample of labelled rows: up to `train_size` ids of
either label by the hash of the id among rows that are not held out, one row of each
id, and of a text longer than `span` characters a span of that size at a place given
by its hash. The two samples weigh the same in the fit, and the output is moved to the
labels' proportions among all rows that may be learned from. Every text is scored
whole, and by itself alone.

Defined results: null and empty texts are one empty passage and get its score; with
no label of one kind every score is the share of label 1 (0.5 without labels);
labels other than 0 and 1 and repeated label rows of one id that disagree are not
learned from; equal texts get equal scores; rows are kept, null ids are not held
out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .common import Prefixes, carried, mix, raw, read, restored, runs_of, slices, words

PASSAGE, TRAIN, SPAN, HIDDEN, ATTENTION, CUT, BUCKETS = 64, 2000, 6000, 24, 12, 0.3, 512
_CLASS = np.full(256, 7, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
_CLASS[list(b".,;:!?'\"()-")] = 5
_CLASS[list(b"#*$%&|<>@^_~=+/\\[]{}`")] = 6
N_FORM = 64 + 7
N_FEATURES = N_FORM + BUCKETS
_SALT = mix(np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def content(hashes: Prefixes, start: np.ndarray, stop: np.ndarray, word: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
    """(n, BUCKETS) signed counts of hashed words and four-grams, as shares of the passage's."""
    _, where, inverse = np.unique(word, return_index=True, return_inverse=True)
    first, last = start[where], stop[where]
    times = np.maximum(last - first - 3, 0)
    gram = np.repeat(np.arange(len(where)), times)
    at = first[gram] + np.arange(len(gram)) - np.repeat(np.cumsum(times) - times, times)
    key = np.concatenate((mix(word[where] + _SALT[0]), mix(hashes(at, at + 4) + _SALT[1])))
    owner = np.concatenate((np.arange(len(where)), gram))
    order = np.argsort(owner, kind="stable")
    key, size = key[order], 1 + times
    begin = np.cumsum(size) - size
    item = np.repeat(np.arange(len(word)), size[inverse])  # a row for each word and each of its grams
    step = np.arange(len(item)) - np.repeat(np.cumsum(size[inverse]) - size[inverse], size[inverse])
    key = key[begin[inverse[item]] + step]
    slot = part[item] * BUCKETS + (key % np.uint64(BUCKETS)).astype(np.int64)
    sign = 1.0 - 2.0 * (key >> np.uint64(63)).astype(np.float64)
    out = np.bincount(slot, sign, n * BUCKETS).reshape(n, BUCKETS)
    return out / np.sqrt(np.maximum(np.bincount(part[item], minlength=n), 1))[:, None]


def passages(data: np.ndarray, offsets: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(passages, N_FEATURES) inputs and the text of each passage; a text has one at least."""
    n = len(offsets) - 1
    start, stop, row = words(data, offsets)
    first, count = runs_of(row, n)
    parts = np.maximum(1, -(-count // size))
    part0 = np.cumsum(parts) - parts
    owner = np.repeat(np.arange(n), parts)
    m = len(owner)
    x = np.zeros((m, N_FEATURES), np.float32)
    if not len(start):
        return x, owner
    position = np.arange(len(start)) - first[row]
    part = part0[row] + position // size
    begin = np.full(m, -1, np.int64)
    opens = np.flatnonzero(position % size == 0)
    begin[part[opens]] = start[opens]
    begin[part0] = offsets[:-1]  # what precedes the first word belongs to it
    of_byte = np.repeat(np.arange(m), np.diff(np.append(begin, len(data))))
    kind = _CLASS[data].astype(np.int64)
    pair = of_byte[1:] * 64 + kind[:-1] * 8 + kind[1:]
    pair = pair[of_byte[1:] == of_byte[:-1]]
    mix_ = np.bincount(pair, minlength=m * 64).reshape(m, 64).astype(np.float64)
    hashes = Prefixes(data)
    x[:, :64] = np.sqrt(mix_ / np.maximum(mix_.sum(1, keepdims=True), 1))
    n_words = np.bincount(part, minlength=m)
    whole = np.maximum(n_words, 1)
    length = np.minimum(stop - start, 40).astype(np.float64)
    mean = np.bincount(part, length, m) / whole
    word = hashes(start, stop)
    _, where = np.unique(mix(word ^ mix(part.astype(np.uint64) + np.uint64(1))), return_index=True)
    distinct = np.bincount(part[where], minlength=m)
    again = np.zeros(len(word))
    again[1:] = (word[1:] == word[:-1]) & (part[1:] == part[:-1])
    x[:, 64] = np.log1p(n_words) / 5
    x[:, 65] = mean / 10
    x[:, 66] = np.sqrt(np.maximum(np.bincount(part, length**2, m) / whole - mean**2, 0)) / 5
    x[:, 67] = distinct / whole
    x[:, 68] = np.bincount(part, again, m) / whole
    x[:, 69] = np.bincount(part, length <= 3, m) / whole
    x[:, 70] = np.bincount(part, kind[stop - 1] == 6, m) / whole
    x[:, N_FORM:] = content(hashes, start, stop, word, part, m)
    return x, owner


class Attention:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(size=s) / np.sqrt(s[0])
        self.w = {"A": f(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": f(HIDDEN, ATTENTION), "U": f(HIDDEN, ATTENTION), "w": f(ATTENTION), "c": f(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale, self.shift = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), 0.0

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        w = self.w
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["A"].astype(x.dtype) + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = np.clip((t * g) @ w["w"], -30, 30)
        e = np.exp(s)
        a = e / np.bincount(owner, e, n)[owner]
        z = np.stack([np.bincount(owner, a * h[:, j], n) for j in range(HIDDEN)], 1)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ w["c"] + w["d"][0]}

    def gradient(self, x: np.ndarray, owner: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.w, len(label)
        f = self.forward(x, owner, n)
        d = weight * (1 / (1 + np.exp(-f["logit"])) - label)
        dz = d[:, None] * w["c"]
        da = (dz[owner] * f["h"]).sum(1)
        ds = f["a"] * (da - np.bincount(owner, f["a"] * da, n)[owner])
        dt = ds[:, None] * w["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * w["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz[owner] + dt @ w["V"].T + dg @ w["U"].T
        dp = dh * (1 - f["h"] ** 2)
        return {"A": f["x"].T @ dp.astype(f["x"].dtype), "b": dp.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ d, "d": d.sum(keepdims=True)}

    def score(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x.astype(np.float64), owner, n)["logit"] + self.shift, -50, 50)))


def train(bags: list[np.ndarray], label: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Attention:
    model, rng = Attention(), np.random.default_rng(seed)
    every = np.concatenate(bags)
    model.mean, model.scale = every.mean(0, dtype=np.float64), np.maximum(every.std(0, dtype=np.float64), 0.02)
    model.scale[N_FORM:] *= 8  # many buckets, each of little weight
    model.mean, model.scale = model.mean.astype(np.float32), model.scale.astype(np.float32)
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            use = order[i : i + batch]
            x = np.concatenate([bags[j] for j in use])
            owner = np.repeat(np.arange(len(use)), [len(bags[j]) for j in use])
            step += 1
            for k, g in model.gradient(x, owner, label[use], weight[use] / len(use)).items():
                g = g + decay * model.w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.w[k] -= rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_size: int = TRAIN, span: int = SPAN) -> Attention | float:
    """The model, or the constant score where one kind of label is missing."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").select("doc_id", "y")
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    total = sum(counts.values())
    if not counts.get(0) or not counts.get(1):
        return counts.get(1, 0) / total if total else 0.5
    share = counts[1] / total
    sample = [marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_size) for y in (0, 1)]
    sample = sample[0].union(sample[1])  # 2 * train_size rows at most
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    place = F.pmod(F.xxhash64("text"), F.length("text") - span).cast("int") + 1
    cut = F.when(F.length("text") <= span, F.col("text")).otherwise(F.substring("text", place, F.lit(span)))
    texts = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "y", cut.alias("text"))
    rows = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).toArrow()  # 2 * train_size spans at most
    label = rows.column("y").to_numpy().astype(np.float64)
    if not 0 < label.sum() < len(label):
        return share
    rows = rows.take(pa.array(sorted(range(rows.num_rows), key=lambda i: (label[i], rows.column("text")[i].as_py()))))
    label = np.sort(label)
    bags = []
    for batch in rows.select(["text"]).combine_chunks().to_batches():
        for part in slices(batch, "text"):
            x, owner = passages(*raw(part.column("text")))
            bags += np.split(x, np.cumsum(runs_of(owner, part.num_rows)[1])[:-1])
    model = train(bags, label)
    model.shift = float(np.log(share / (1 - share)))
    return model


def qualities(docs: DataFrame, model: Attention | float, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """(doc_id, score) for every row. keep: columns to carry along instead of doc_id; name: of the new column."""
    kept = keep if keep is not None else [id_col]
    base = carried(docs, kept, text=F.coalesce(F.col(text_col), F.lit("")))
    schema = StructType(base.schema.fields[:-1]).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                if isinstance(model, float | int):
                    score = np.full(part.num_rows, float(model))
                else:
                    score = model.score(*passages(*raw(part.column("text"))), part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(score)], schema.names)

    return restored(base.mapInArrow(run, schema), kept, {"score": name})


def passage_weights(docs: DataFrame, model: Attention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, weights): how much attention each passage of a text gets, in order; the weights of a text sum to one."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = StructType(base.schema.fields[:1]).add("weights", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, owner = passages(*raw(part.column("text")))
                _, count = runs_of(owner, part.num_rows)
                weights = model.forward(x, owner, part.num_rows)["a"]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(weights.astype(np.float64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], schema.names)

    return base.mapInArrow(run, schema)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from labels that are not held out."""
    docs = read(spark, sf_dir, "documents")
    found = qualities(docs, fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
