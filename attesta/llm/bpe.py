"""Byte-level byte-pair encoding by a lazily determinised transducer, and streaming decoding.

The merges define a nondeterministic transducer over bytes: a hypothesis is the
last token of a split of the bytes so far and a node of the vocabulary trie that
reads the token begun after it. A token may follow another only if merging would
keep the two apart, which is decided by undoing their merges from the border
outwards. Every prefix then has one split, so the splits of all hypotheses form a
tree; tokens up to the lowest common ancestor are certain and are emitted, and the
rest waits in the state. States are such trees with positions counted back from
the end; they and their transitions are made when first met and kept, so a known
path costs one dictionary lookup a byte. When STATES are made, unknown paths are
read on hypothesis by hypothesis, as lazy automata do when their cache is full.

A pre-token that is a token itself is that token, as in the usual library. Ids of
pre-tokens met before are looked up.

Decoding is a stream too: ids come in chunks of any size, and a finite-state machine
over UTF-8 decides how many bytes of what has come are whole characters; the rest of
an unfinished character waits for the next chunk. The machine has a state for each
way to be inside a character. A token is one transition of it, read from a table, and
as any token that begins a character leads to one state whatever came before, only
the few tokens after the last such one need be followed. The query decodes so.

Defined results: null and empty texts have no token, and the hashes of an empty
string; other columns are ignored; rows, ids and null ids are kept as they are.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, slices
from .tokens import TEXT_SLICE, Memo, spans, unsafe

STATES = 50_000  # transducer states made; beyond them the hypotheses are followed without new states
RARE = 100_000  # pre-tokens of texts with rare characters that a worker keeps
CHUNK = 1 << 14  # ids that the query decodes at a time


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(1)
def library_pattern() -> re.Pattern:
    """public_tokenizers.PATTERN with the library's own character classes, for texts of any characters."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}

    def of(kind: str) -> str:
        found = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        return spans(sorted(map(ord, set(bytes(found).decode()))))

    L, N, S = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")


class Merges:
    """Which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            split = self.merge(token, rank) if len(token) > 1 else [rank]
            if len(split) == 2:
                self.parts[rank] = (split[0], split[1])
                self.joined[split[0], split[1]] = rank
            else:
                self.parts[rank] = (rank, rank)
        self.apart: dict[tuple[int, int], bool] = {}

    def merge(self, token: bytes, below: int) -> list[int]:
        """Plain merging of a short byte string by ranks under `below`."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stay_apart(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > 500_000:
                self.apart.clear()
            found = self.apart[key] = self._stay_apart(left, right)
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo merges at the border, latest first; a merge across it that would have come earlier forbids the pair."""
        limit = 1 << 62
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                limit, inner = left, self.parts[left][1]
                if inner != left:
                    left = inner
                    continue
                limit, inner = right + 1, self.parts[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                limit, inner = right + 1, self.parts[right][0]
                if inner != right:
                    right = inner
                    continue
                limit, inner = left, self.parts[left][1]
                if inner == left:
                    return True
                left = inner


class Transducer:
    """States: a tree of splits, as (age, token, age of the parent), and hypotheses, as (age, trie node), ages counted from the end."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.usable = [True]
        for token, rank in merges.ranks.items():
            if len(token) > 1 and merges.parts[rank][0] == rank:
                continue  # merging never gives this token
            node = 0
            for b in token:
                step = self.child[node].get(b)
                if step is None:
                    step = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = step
            self.token[node] = rank
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.state: list[tuple] = []
        self.next: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.begin = self._number((((0, -1, -1),), ((0, 0),)))

    def _number(self, state: tuple) -> int:
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.state)
            self.state.append(state)
            self.next.append({})
        return n

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        tree, alive = self.state[state]
        last = {age: (token, parent) for age, token, parent in tree}
        after, new = [], None
        for age, node in alive:
            to = self.child[node].get(byte)
            if to is None:
                continue
            token = self.token[to]
            if token >= 0 and new is None:
                before = last[age][0]
                if before < 0 or self.merges.stay_apart(before, token):
                    new = (0, token, age + 1)
            if self.child[to]:
                after.append((age + 1, to))
        if new is None:
            raise ValueError("no split: the ranks lack a byte")
        last = {age + 1: (token, -1 if parent < 0 else parent + 1) for age, (token, parent) in last.items()}
        last[0] = (new[1], new[2])
        after.append((0, 0))
        # tokens above the lowest common ancestor of all hypotheses are certain
        paths = []
        for age, _ in after:
            path = [age]
            while last[path[-1]][1] >= 0:
                path.append(last[path[-1]][1])
            paths.append(path[::-1])
        common = 0
        while all(len(p) > common for p in paths) and len({p[common] for p in paths}) == 1:
            common += 1
        sure = paths[0][:common]
        emitted = tuple(last[age][0] for age in sure[1:])
        root = sure[-1]
        keep = sorted({age for p in paths for age in p[common:]})
        tree = tuple([(root, last[root][0], -1), *((age, *last[age]) for age in keep)])
        found = (self._number((tree, tuple(after))), emitted)
        self.next[state][byte] = found
        return found

    def encode(self, piece: bytes) -> list[int]:
        state, out, following = self.begin, [], self.next
        for i, b in enumerate(piece):
            found = following[state].get(b)
            if found is None:
                if len(self.state) >= STATES:
                    return out + self._simulate(state, piece, i)
                found = self._step(state, b)
            state, emitted = found
            if emitted:
                out += emitted
        return out + self._simulate(state, piece, len(piece))

    def _simulate(self, state: int, piece: bytes, at: int) -> list[int]:
        """The tokens after the certain ones, read on from a state without making new states."""
        tree, alive = self.state[state]
        last = {at - age: (token, at - parent if parent >= 0 else -1) for age, token, parent in tree}
        alive = [(at - age, node) for age, node in alive]
        children, tokens, apart, known = self.child, self.token, self.merges.stay_apart, self.merges.apart
        for i in range(at, len(piece)):
            b, after, found = piece[i], [], False
            for pos, node in alive:
                to = children[node].get(b)
                if to is None:
                    continue
                token = tokens[to]
                if token >= 0 and not found:
                    before = last[pos][0]
                    if before < 0:
                        found = True
                    else:
                        found = known.get((before, token))
                        if found is None:
                            found = apart(before, token)
                    if found:
                        last[i + 1] = (token, pos)
                if children[to]:
                    after.append((pos, to))
            after.append((i + 1, 0))
            alive = after
        rest, pos = [], len(piece)
        while last[pos][1] >= 0:
            rest.append(last[pos][0])
            pos = last[pos][1]
        return rest[::-1]


class Codec:
    """Texts to ids and ids to bytes by one rank file."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.transducer = Transducer(Merges(self.ranks))
        self.memo = Memo(lambda new: [self.piece(x.encode()) for x in new], [[]])
        top = max(self.ranks.values()) + 1
        names = [self.transducer.merges.bytes.get(i, b"") for i in range(top)]
        self.size = np.array([len(x) for x in names], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(names), np.uint8)
        moves, steps = np.tile(np.arange(len(_HELD), dtype=np.uint8), (top, 1)), utf8_steps()
        for i in range(int(self.size.max(initial=0))):
            use = np.flatnonzero(self.size > i)
            moves[use] = steps[moves[use], self.flat[self.start[use] + i][:, None]]
        self.resets = (moves == moves[:, :1]).all(1)
        self.moves = moves.tolist()
        self.rare: dict[str, list[int]] = {}

    def piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.transducer.encode(piece)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the texts' offsets in them."""
        rare = unsafe().search

        def whole(i: int) -> list[int]:
            out: list[int] = []
            for p in library_pattern().findall(texts[i]):
                ids = self.rare.get(p)
                if ids is None:
                    if len(self.rare) >= RARE:
                        self.rare.clear()
                    ids = self.rare[p] = self.piece(p.encode())
                out += ids
            return out

        flat, ends = self.memo.numbers(texts, False, whole, [i for i, t in enumerate(texts) if rare(t)])
        ids, size = self.memo.gather(flat)
        return ids, np.concatenate(([0], np.cumsum(size)[ends - 1] if len(ends) else [])).astype(np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row, and the texts' offsets in them."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.flat[np.repeat(self.start[ids] - (ends - size), size) + np.arange(total)]
        return data, np.concatenate(([0], ends))[offsets]

    def stream(self) -> TokenStream:
        return TokenStream(self)

    def decode_stream(self, chunks: Iterator[list[int]]) -> Iterator[str]:
        """Text pieces of a stream of id chunks; a character cut by a chunk's end comes with the next."""
        stream = self.stream()
        for ids in chunks:
            yield stream.feed(np.asarray(ids, np.int64)).decode("utf-8", "replace")
        yield stream.close().decode("utf-8", "replace")


# States of the machine: bytes of the open character so far, and which bytes may follow. 0 is between characters.
_HELD = np.array([0, 1, 1, 1, 1, 2, 1, 1, 1, 2, 3], np.int64)


@lru_cache(1)
def utf8_steps() -> np.ndarray:
    """(state, byte): the next state. A byte that may not follow ends the open character and is read from state 0."""
    steps = np.zeros((len(_HELD), 256), np.uint8)
    for lead, state in ((range(0xC2, 0xE0), 1), (range(0xE1, 0xF0), 2), ([0xE0], 3), ([0xED], 4), (range(0xF1, 0xF4), 6), ([0xF0], 7), ([0xF4], 8)):
        steps[0, list(lead)] = state
    steps[1:] = steps[0]
    for state, first, last, after in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 5), (3, 0xA0, 0xBF, 5), (4, 0x80, 0x9F, 5), (5, 0x80, 0xBF, 0), (6, 0x80, 0xBF, 9), (7, 0x90, 0xBF, 9), (8, 0x80, 0x8F, 9), (9, 0x80, 0xBF, 10), (10, 0x80, 0xBF, 0)):
        steps[state, first : last + 1] = after
    return steps


class TokenStream:
    """Bytes of the whole characters of an id stream, as they become whole."""

    def __init__(self, codec: Codec):
        self.codec, self.state, self.held = codec, 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        codec = self.codec
        last = np.flatnonzero(codec.resets[ids[-8:]])
        tail = ids[-8:][last[-1] :] if len(last) else ids
        for i in tail.tolist():
            self.state = codec.moves[i][self.state]
        data = self.held + codec.decode_batch(ids, np.array([0]))[0].tobytes()
        whole = len(data) - int(_HELD[self.state])
        self.held = data[whole:]
        return data[:whole]

    def close(self) -> bytes:
        """What an unfinished character left."""
        rest, self.held, self.state = self.held, b"", 0
        return rest


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def decimal_digests(ids: np.ndarray, offsets: np.ndarray, top: int) -> list[str]:
    """sha256 of each text's ids in decimal, joined by commas."""
    names = _names(top)
    listed = ids.tolist()
    at = offsets.tolist()
    return [hashlib.sha256(",".join(map(names.__getitem__, listed[a:b])).encode()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(2)
def _names(top: int) -> list[str]:
    return [str(i) for i in range(top)]


def encode_and_decode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("att_text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            for part in slices(batch, "att_text", TEXT_SLICE):
                ids, offsets = c.encode_batch(part.column("att_text").to_pylist())
                hashes = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    stream, digest = c.stream(), hashlib.sha256()
                    for i in range(a, b, CHUNK):
                        digest.update(stream.feed(ids[i : min(i + CHUNK, b)]))
                    digest.update(stream.close())
                    hashes.append(digest.hexdigest())
                out = [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(decimal_digests(ids, offsets, len(c.size)))]
                out.append(pa.array(hashes))
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return base.mapInArrow(run, schema)


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded, and decoded again from its ids."""
    import public_tokenizers

    return encode_and_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
