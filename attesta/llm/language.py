"""Language of texts by a linear-chain conditional random field over words.

A word is a run of letters. Its features are hashed: prefixes and suffixes of one to
four bytes, all three-byte grams, the word itself, and whether it is in a language's
lexicon, which is learned with the rest. Label transitions are learned too, on
spliced sequences that switch language every few words, so a passage in another
language inside a text is labelled as such. A text's score for a language is the
mean over its words of the label's posterior by forward-backward; the prediction is
the best language.

Forward-backward runs over all words of a slice at once: texts are cut into segments,
the segments' transfer matrices are multiplied side by side, boundary vectors are
carried through them, and posteriors follow inside each segment. This is exact.

The field is fitted on a bounded sample: up to `train_size` distinct texts of every
language that occurs, chosen by the hash of the text; of a text longer than `span`
characters a span of that size is taken, at a place given by its hash. Every row is
predicted from its whole text alone.

Defined results: null texts and texts without a letter are `und` with score 0; with
no labelled text every row is `und`; equal texts get equal results; null ids and
repeated rows are kept (a null id is not held out); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SLICE_BYTES, Prefixes, carried, mix, raw, read, restored, runs_of, slices, words

TRAIN, SPAN, SEGMENT, BITS = 400, 20_000, 64, 17
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALT = mix(np.arange(1, 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals of a UTF-8 buffer in lower case."""
    out = _LOWER[data]
    at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[at] += 32
    return out


class Lexicon:
    """Words seen often in one language: sorted hashes and their language."""

    def __init__(self, word: np.ndarray, label: np.ndarray, n_labels: int):
        keys, inverse = np.unique(word, return_inverse=True)
        count = np.zeros((len(keys), n_labels))
        np.add.at(count, (inverse, label), 1)
        use = (count.sum(1) >= 3) & (count.max(1, initial=0) >= 0.9 * count.sum(1))
        self.keys, self.label = keys[use], count[use].argmax(1)

    def __call__(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, word), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == word)
        return hit, self.label[at[hit]]


def word_features(hashes: Prefixes, start: np.ndarray, stop: np.ndarray, word: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Word and feature number, a pair for each feature of each word."""
    size = stop - start
    everyone = np.arange(len(start))
    item, key = [everyone], [mix(word + _SALT[0])]
    for k in range(1, 5):
        use = np.flatnonzero(size >= k)
        item += [use, use]
        key += [mix(hashes(start[use], start[use] + k) + _SALT[k]), mix(hashes(stop[use] - k, stop[use]) + _SALT[4 + k])]
    times = np.maximum(size - 2, 0)
    gram = np.repeat(everyone, times)
    at = start[gram] + np.arange(len(gram)) - np.repeat(np.cumsum(times) - times, times)
    item.append(gram)
    key.append(mix(hashes(at, at + 3) + _SALT[9]))
    hit, label = lexicon(word)
    item.append(hit)
    key.append(mix(label.astype(np.uint64) + _SALT[10]))
    return np.concatenate(item), (np.concatenate(key) >> np.uint64(64 - BITS)).astype(np.int64)


def posteriors(emission: np.ndarray, row: np.ndarray, n_rows: int, start: np.ndarray, transition: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each label for each word, and its scaled backward weight; emission: (words, labels) log weights, rows sorted."""
    n, labels = emission.shape
    if not n:
        return np.zeros((0, labels)), np.zeros((0, labels))
    e = np.exp(emission - emission.max(1, keepdims=True))
    t = np.exp(transition)
    first, count = runs_of(row, n_rows)
    parts = -(-count // segment)  # segments of each row
    part0 = np.cumsum(parts) - parts
    owner = np.repeat(np.arange(n_rows), parts)
    step = np.arange(len(owner)) - part0[owner]
    begin = first[owner] + step * segment
    size = np.minimum(count[owner] - step * segment, segment)
    order = np.argsort(-size, kind="stable")
    begin, size, owner_s, step_s = begin[order], size[order], owner[order], step[order]
    longer = [int((size > k).sum()) for k in range(segment)]
    product = np.broadcast_to(np.eye(labels), (len(size), labels, labels)).copy()
    for k in range(segment):
        m = longer[k]
        if not m:
            break
        x = product[:m]
        moved = x @ t
        if k == 0:
            opening = step_s[:m] == 0  # a text's first word has start weights, not a transition
            moved[opening] = np.exp(start)[None, None] * np.ones((labels, 1))
        moved *= e[begin[:m] + k][:, None, :]
        product[:m] = moved / moved.sum((1, 2), keepdims=True)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ahead = np.full((len(size), labels), 1.0 / labels)
    behind = np.full((len(size), labels), 1.0 / labels)
    for turn in range(int(parts.max())):
        rows = np.flatnonzero(parts > turn + 1)
        if not len(rows):
            break
        here, then = place[part0[rows] + turn], place[part0[rows] + turn + 1]
        x = np.einsum("ni,nij->nj", ahead[here], product[here])
        ahead[then] = x / x.sum(1, keepdims=True)
        here, then = place[part0[rows] + parts[rows] - 1 - turn], place[part0[rows] + parts[rows] - 2 - turn]
        x = np.einsum("nij,nj->ni", product[here], behind[here])
        behind[then] = x / x.sum(1, keepdims=True)
    alpha = np.empty((n, labels))
    now = ahead
    for k in range(segment):
        m = longer[k]
        if not m:
            break
        x = now[:m] @ t
        if k == 0:
            x[step_s[:m] == 0] = np.exp(start)
        x = x * e[begin[:m] + k]
        x /= x.sum(1, keepdims=True)
        alpha[begin[:m] + k] = x
        now = x
    out, after = np.empty((n, labels)), np.empty((n, labels))
    now = behind.copy()
    for k in range(segment - 1, -1, -1):
        m = longer[k]
        if not m:
            continue
        at = begin[:m] + k
        after[at] = now[:m]
        x = alpha[at] * now[:m]
        out[at] = x / x.sum(1, keepdims=True)
        x = (e[at] * now[:m]) @ t.T
        now[:m] = x / x.sum(1, keepdims=True)
    return out, after


class Field:
    def __init__(self, labels: list[str], lexicon: Lexicon):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((1 << BITS, n), np.float32)
        self.start, self.transition = np.zeros(n), np.zeros((n, n))

    def emission(self, item: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(item, self.weights[feature, j], minlength=n) for j in range(len(self.labels))], 1)

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each word, and the posteriors of its labels."""
        data = lowered(data)
        start, stop, row = words(data, offsets, _LETTER)
        if not len(start):
            return start, stop, row, np.zeros((0, len(self.labels)))
        hashes = Prefixes(data)
        word, where, inverse = np.unique(hashes(start, stop), return_index=True, return_inverse=True)
        emission = self.emission(*word_features(hashes, start[where], stop[where], word, self.lexicon), len(word))[inverse]
        return start, stop, row, posteriors(emission, row, len(offsets) - 1, self.start, self.transition)[0]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean posterior of each label for each text, its count of words, and the mean of its words' greatest posteriors."""
        n = len(offsets) - 1
        _, _, row, p = self.label(data, offsets)
        count = np.bincount(row, minlength=n)
        total = np.stack([np.bincount(row, p[:, j], minlength=n) for j in range(p.shape[1])], 1)
        return total / np.maximum(count, 1)[:, None], count, np.bincount(row, p.max(1), minlength=n) / np.maximum(count, 1)


def train(texts: list[str], labels: list[str], epochs: int = 3, sequences: int = 4000, seed: int = 7) -> Field | None:
    """A field fitted by AdaGrad on spliced sequences of four to forty words a language."""
    names = sorted(set(labels))
    if not names:
        return None
    data, offsets = raw(pa.array(texts, pa.large_string()))
    data = lowered(data)
    begin, stop, row = words(data, offsets, _LETTER)
    if not len(begin):
        return None
    hashes = Prefixes(data)
    word = hashes(begin, stop)
    number = {x: i for i, x in enumerate(names)}
    label = np.array([number[x] for x in labels])
    gold = label[row]
    first, count = runs_of(row, len(texts))
    by = [np.flatnonzero((label == j) & (count > 0)) for j in range(len(names))]
    by = [b for b in by if len(b)]
    field = Field(names, Lexicon(word, gold, len(names)))
    rng = np.random.default_rng(seed)
    spliced = []
    for _ in range(max(sequences, 60 * len(names))):
        at = []
        for _ in range(int(rng.integers(1, 4))):
            text = int(rng.choice(by[int(rng.integers(len(by)))]))
            size = int(min(count[text], rng.integers(4, 41)))
            at.append(first[text] + int(rng.integers(count[text] - size + 1)) + np.arange(size))
        spliced.append(np.concatenate(at))
    square_w = np.full_like(field.weights, 1e-2)
    square_t, square_s = np.full_like(field.transition, 1e-2), np.full_like(field.start, 1e-2)
    for _ in range(epochs):
        rng.shuffle(spliced)
        for i in range(0, len(spliced), 100):
            group = spliced[i : i + 100]
            at = np.concatenate(group)
            seq = np.repeat(np.arange(len(group)), [len(x) for x in group])
            item, feature = word_features(hashes, begin[at], stop[at], word[at], field.lexicon)
            emission = field.emission(item, feature, len(at))
            p, after = posteriors(emission, seq, len(group), field.start, field.transition)
            truth = np.eye(len(names))[gold[at]]
            lead = np.append(True, seq[1:] != seq[:-1])
            # expected transitions: the posterior of the left label times that of the right one given it
            inner = np.flatnonzero(~lead)
            e = np.exp(emission - emission.max(1, keepdims=True))
            joint = np.exp(field.transition)[None] * (e * after)[inner][:, None, :]
            pair = (joint / joint.sum(2, keepdims=True) * p[inner - 1][:, :, None]).sum(0)
            seen = np.zeros_like(pair)
            np.add.at(seen, (gold[at][inner - 1], gold[at][inner]), 1)
            error = ((truth - p) / len(group)).astype(np.float32)
            touched, back = np.unique(feature, return_inverse=True)
            grad = np.stack([np.bincount(back, error[item, j], minlength=len(touched)) for j in range(len(names))], 1)
            square_w[touched] += grad**2
            field.weights[touched] += (0.2 * grad / np.sqrt(square_w[touched])).astype(np.float32)
            for value, square, g in ((field.transition, square_t, (seen - pair) / len(group)), (field.start, square_s, (truth - p)[lead].sum(0) / len(group))):
                square += g**2
                value += 0.2 * g / np.sqrt(square)
    return field


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_size: int = TRAIN, span: int = SPAN) -> Field | None:
    """Fit on the rows that are not held out."""
    use = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    use = use.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    langs = use.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language
    if not langs:
        return None
    shares = F.create_map(*(F.lit(x) for r in langs for x in (r["lang"], min(1.0, 2 * train_size / r["n"]))))
    chosen = use.filter(F.pmod("h", F.lit(1_000_003)) / F.lit(1_000_003.0) < shares[F.col("lang")])
    chosen = chosen.withColumn("text", F.when(F.length("text") <= span, F.col("text")).otherwise(F.substring("text", F.pmod("h", F.length("text") - span).cast("int") + 1, F.lit(span))))
    chosen = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))
    line = Window.partitionBy("lang").orderBy("h")
    rows = chosen.withColumn("n", F.row_number().over(line)).filter(F.col("n") <= train_size).orderBy("h", "lang").select("text", "lang").collect()  # train_size a language
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _slice_for(field: Field | None) -> int:
    """Bytes of text labelled at a time: a segment of words holds a matrix of all labels."""
    return SLICE_BYTES if field is None else min(SLICE_BYTES, max(1 << 14, (1 << 24) // len(field.labels) ** 2))


def languages(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "sure")) -> DataFrame:
    """(doc_id, lang_pred, score, sure) for every row. keep: columns to carry along instead of doc_id; names: of the three new columns.

    sure: the mean over the words of each word's greatest posterior, high also in a text of several languages.
    """
    kept = keep if keep is not None else [id_col]
    base = carried(docs, kept, text=F.coalesce(F.col(text_col), F.lit("")))
    schema = StructType(base.schema.fields[:-1]).add("lang", "string").add("score", "double").add("sure", "double")
    size = _slice_for(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", size):
                data, offsets = raw(part.column("text"))
                if field is None:
                    name, score, sure = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
                else:
                    mean, count, sure = field.predict(data, offsets)
                    ascii_letter = np.concatenate(([0], np.cumsum(_LETTER[data] & (data < 128))))[offsets]
                    for i in np.flatnonzero((np.diff(ascii_letter) == 0) & (count > 0)):  # is there a letter among other characters?
                        if not any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))):
                            count[i] = 0
                    best = mean.argmax(1)
                    name = [field.labels[j] if c else "und" for j, c in zip(best, count, strict=True)]
                    score = np.where(count > 0, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
                    sure = np.where(count > 0, np.clip(sure, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(name, pa.string()), pa.array(score), pa.array(sure)], schema.names)

    return restored(base.mapInArrow(run, schema), kept, dict(zip(("lang", "score", "sure"), names, strict=True)))


def language_spans(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop, lang, score): runs of words of one language, as byte ranges of the UTF-8 text, with the mean posterior of their label.

    A text without a word has no row. Only as many rows as languages change in a text.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = StructType(base.schema.fields[:1]).add("start", "long").add("stop", "long").add("lang", "string").add("score", "double")
    if field is None:
        return docs.sparkSession.createDataFrame([], schema)
    size = _slice_for(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", size):
                data, offsets = raw(part.column("text"))
                start, stop, row, p = field.label(data, offsets)
                best = p.argmax(1)
                opens = np.ones(len(best), bool)
                opens[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(opens)
                last = np.append(first[1:], len(best))[: len(first)] - 1
                sure = np.concatenate(([0.0], np.cumsum(p.max(1)))) if len(best) else np.zeros(1)
                mean = (sure[last + 1] - sure[first]) / np.maximum(last + 1 - first, 1)
                at = row[first]
                name = pa.array([field.labels[j] for j in best[first]], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), pa.array(start[first] - offsets[at]), pa.array(stop[last] - offsets[at]), name, pa.array(mean)], schema.names)

    return base.mapInArrow(run, schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, fitted on the rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    found = languages(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "sure")
