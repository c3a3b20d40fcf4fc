"""Whole texts to token ids, exactly as the named library gives them, at a few hundred nanoseconds a word.

A pre-token is encoded once and looked up afterwards: byte-pair encoding never
merges across pre-tokens, so a text's ids are its pre-tokens' ids in a row.
Texts with a character whose class or case differs between Unicode versions, or
any other rare one, skip the fast path and go to the library whole. So do all texts
of a file whose normalizer, pre-tokenizer or model options are not one of the two
pipelines that the fast path follows (PIPELINES).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefixes, mix, raw, slices

MEMO = 300_000  # pre-tokens a worker keeps
TEXT_SLICE = 1 << 18  # bytes of text encoded at a time
# What tokenizers files hold whose split the fast path knows, and whether it lowers case and drops white space.
PIPELINES = (
    ({"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}, False),
    (
        {
            "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
            "pre_tokenizer": {
                "type": "Sequence",
                "pretokenizers": [
                    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
                ],
            },
        },
        True,
    ),
)
MODEL = {"type": "BPE", "dropout": None, "byte_fallback": False, "fuse_unk": False, "continuing_subword_prefix": None}


def known_pipeline(path: str) -> bool | None:
    """Whether the file's words are lower-cased; None if the fast path doesn't know its pipeline."""
    with open(path, encoding="utf-8") as stored:
        stored = json.load(stored)
    plain = stored.get("truncation") is None and stored.get("padding") is None and all(stored["model"].get(k) == v for k, v in MODEL.items())
    for pipeline, lower in PIPELINES:
        if plain and all(stored.get(k) == v for k, v in pipeline.items()):
            return lower
    return None


def spans(points: list[int]) -> str:
    """Sorted code points as ranges of a regex class."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}")
        i = j + 1
    return "".join(out)


@lru_cache(1)
def classes() -> tuple[str, str, str]:
    """Regex ranges of letters, of numbers, and of all characters that are safe on the fast path."""
    letters, numbers, safe = [], [], []
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        if c in (9, 10, 11, 12, 13):
            safe.append(c)
            continue
        if kind[0] == "C" or kind in ("Zl", "Zp") or c in (0x130, 0x3A3) or 0x10A0 <= c <= 0x10FF or 0x13A0 <= c <= 0x13FF:
            continue
        if unicodedata.ucd_3_2_0.category(chr(c)) != kind:
            continue
        safe.append(c)
        if kind[0] == "L":
            letters.append(c)
        elif kind[0] == "N":
            numbers.append(c)
    return spans(letters), spans(numbers), spans(safe)


@lru_cache(1)
def unsafe() -> re.Pattern:
    return re.compile(f"[^{classes()[2]}]")


@lru_cache(1)
def byte_level_pattern() -> re.Pattern:
    """public_tokenizers.PATTERN for texts of safe characters."""
    L, N, _ = classes()
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+")


@lru_cache(1)
def word_pattern() -> re.Pattern:
    """The split of the lower-casing word tokenizer for texts of safe characters."""
    L, N, _ = classes()
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+")


@lru_cache(1)
def kinds() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, of each code point below 0x10000 that is safe."""
    letters, numbers, _ = classes()
    table = np.full(0x10000, 3, np.uint8)
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    for ranges, kind in ((letters, 1), (numbers, 2)):
        table[[ord(c) for c in re.findall(f"[{ranges}]", every)]] = kind
    table[[9, 10, 11, 12, 13, *(c for c in range(0x10000) if unicodedata.category(chr(c)) == "Zs")]] = 0
    return table


@lru_cache(1)
def _code_point_hashes() -> np.ndarray:
    return mix((np.arange(0x10000, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def pre_tokens(joined: str, texts: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and hash of the pre-tokens of safe texts that begin at `texts` in joined.

    The split of byte_level_pattern(), or of word_pattern() if single: kinds change, a
    space joins what follows it, the last white space before a word stands alone, and
    an apostrophe that opens a pre-token takes s, t, re, ve, m, ll or d with it.
    """
    n = len(joined)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    point = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kind = kinds()[point]
    first = np.zeros(n + 1, bool)
    first[texts] = True
    first[n] = True
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin |= first[:-1]
    if single:
        begin |= kind == 2
    else:
        last = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & ~first[1:-1])
        begin[last] = True
        begin[last[point[last] == 32] + 1] = False
    mark = np.flatnonzero((point == 39) & begin)
    if len(mark):
        after = np.zeros((2, len(mark)), np.uint32)
        for k in (1, 2):  # what follows in the same text
            inside = mark + k < n
            inside[inside] = ~first[mark[inside] + k]
            if k == 2:
                inside &= after[0] > 0
            after[k - 1, inside] = point[mark[inside] + k]
        one = np.isin(after[0], [ord(c) for c in "stmd"])
        two = np.zeros(len(mark), bool)
        for pair in ("re", "ve", "ll"):
            two |= (after[0] == ord(pair[0])) & (after[1] == ord(pair[1]))
        begin[mark[one | two] + 1] = False
        beyond = np.where(one, mark + 2, mark + 3)[one | two]
        beyond = beyond[beyond < n]
        begin[beyond] = True
    start = np.flatnonzero(begin)
    stop = np.append(start[1:], n)
    if single:
        keep = kind[start] != 0
        start, stop = start[keep], stop[keep]
    return start, stop, np.searchsorted(texts, start, "right") - 1, Prefixes(point, _code_point_hashes())(start, stop)


class Memo:
    """Hash of a pre-token to number, in sorted arrays; number n stands for flat[start[n]:start[n] + length[n]]."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], first: list[list[int]]):
        self.encode, self.first = encode, first
        self.reset()

    def reset(self) -> None:
        self.n, self.held = 0, 0
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.start, self.length = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self._store(self.first)

    def _store(self, lists: list[list[int]]) -> np.ndarray:
        """Numbers for new lists of ids."""
        numbers = np.arange(self.n, self.n + len(lists))
        self.n += len(lists)
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(size.sum())
        while self.held + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
        self.flat[self.held : self.held + total] = np.fromiter((i for x in lists for i in x), np.uint32, total)
        self.start[numbers], self.length[numbers] = self.held + np.cumsum(size) - size, size
        self.held += total
        return numbers

    def numbers(self, texts: list[str], single: bool, otherwise: Callable[[int], list[int]], skip: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts in a row, a 0 after each text, and the texts' ends in them. Texts in skip get the ids that otherwise() gives."""
        if self.n > MEMO:
            self.reset()
        out = set(skip)
        size = np.fromiter((0 if i in out else len(t) for i, t in enumerate(texts)), np.int64, len(texts))
        joined = "".join(t for i, t in enumerate(texts) if i not in out) if out else "".join(texts)
        at = np.cumsum(size) - size
        filled = np.flatnonzero(size)
        start, stop, row, key = pre_tokens(joined, at[filled], single)
        row = filled[row] if len(row) else row
        key, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, key)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == key[known]
        named = np.zeros(len(key), np.int64)
        named[known] = self.number[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            named[new] = self._store(self.encode([joined[a:b] for a, b in zip(start[where[new]].tolist(), stop[where[new]].tolist(), strict=True)]))
            self.keys = np.insert(self.keys, place[new], key[new])
            self.number = np.insert(self.number, place[new], named[new])
        own = np.bincount(row, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        count = own.copy()
        count[skip] = 1
        ends = np.cumsum(count + 1)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        if len(row):
            flat[(ends - count - 1)[row] + np.arange(len(row)) - (np.cumsum(own) - own)[row]] = named[inverse]
        if skip:
            flat[ends[skip] - 2] = self._store([otherwise(i) for i in skip])  # no later text looks these up
        return flat, ends

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbers in a row, and how many each gave."""
        size = self.length[numbers].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[numbers] - (ends - size), size) + np.arange(total)], size


@lru_cache(1)
def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte that byte-level vocabularies are written in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextEncoder:
    """Batches of texts to ids by a tokenizers file. end: an id appended to each text, or None."""

    def __init__(self, path: str, end: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        lower = known_pipeline(path)
        self.known, self.lower = lower is not None, bool(lower)
        self.end = end
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.memo = Memo(self.pieces, [[] if end is None else [end]])

    def pieces(self, new: list[str]) -> list[list[int]]:
        stand_in, tokenize = byte_characters(), self.model.tokenize
        return [[t.id for t in tokenize(x.encode().decode("latin1").translate(stand_in))] for x in new]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of the texts in them."""
        if not self.known:
            lists = [x.ids + ([] if self.end is None else [self.end]) for x in self.library.encode_batch(texts, add_special_tokens=False)]
            return np.fromiter((i for x in lists for i in x), np.uint32), np.cumsum([0, *map(len, lists)])
        rare = unsafe().search
        skip = [i for i, t in enumerate(texts) if rare(t) or any(x in t for x in self.special)]
        plain = texts
        if self.lower:
            plain = [(t if t.isascii() else unicodedata.normalize("NFC", t)).lower() for t in texts]
            skip = sorted({*skip, *(i for i, t in enumerate(plain) if not t.isascii() and rare(t))})
        flat, ends = self.memo.numbers(plain, self.lower, lambda i: self.library.encode(texts[i], add_special_tokens=False).ids, skip)
        ids, size = self.memo.gather(flat)
        return ids, np.concatenate(([0], np.cumsum(size)[ends - 1] if len(ends) else [])).astype(np.int64)


@lru_cache(2)
def encoder(path: str, end: int | None) -> TextEncoder:
    return TextEncoder(path, end)


def id_bytes(ids: np.ndarray, offsets: np.ndarray, dtype: str) -> pa.Array:
    """A binary column of each text's ids."""
    data = np.ascontiguousarray(ids, dtype)
    at = pa.py_buffer((offsets * data.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, at, pa.py_buffer(data)])


def encoded(docs: DataFrame, id_col: str, text_col: str, keep: list[str], path: str, end: int | None, width: str = "<u2") -> DataFrame:
    """(doc_id, keep..., n_tokens, ids): ids as packed little-endian integers of the given width."""
    base = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("att_text"))
    schema = base.drop("att_text").schema.add("n_tokens", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path, end)
        for batch in batches:
            for part in slices(batch, "att_text", TEXT_SLICE):
                ids, offsets = to_ids(part.column("att_text").to_pylist())
                kept = [part.column(x) for x in ("doc_id", *keep)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(offsets)), id_bytes(ids, offsets, width)], ["doc_id", *keep, "n_tokens", "ids"])

    return base.mapInArrow(run, schema)


def ids_of(column: pa.Array, width: str = "<u2") -> tuple[np.ndarray, np.ndarray]:
    data, offsets = raw(column)
    kind = np.dtype(width)
    return np.frombuffer(data.tobytes(), kind), offsets // kind.itemsize
