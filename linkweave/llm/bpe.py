"""Byte-level BPE: texts to token ids and back, by a vocabulary of ranked byte strings.

A text is split by the vocabulary's pattern. Each piece starts as its bytes; the neighbouring pair of lowest rank, of
equal ones the leftmost, is merged until no pair has a rank. A segment tree over byte positions holds the rank of the pair
that starts at each position; the root gives the next merge, and a merge updates three leaves on their way to the root:
the pair at the merged token, the one before it, and the removed position. Pieces of similar length are merged together,
one merge of each per step, as numpy rows. Pieces seen lately are looked up.

A piece of b bytes takes at most b merges of about log2(b) steps, so long texts without spaces stay cheap.

Defined cases: null counts as the empty text, which has no tokens; repeated rows get equal tokens; an empty
table gives an empty result. A lone surrogate, which no text column can hold, is encoded as U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.words import texts_of

_NONE = np.int64(1) << 62
_CELLS = 1 << 20  # tree leaves in work at a time
_CACHE_LIMIT = 400_000


class Vocabulary:
    """Ranked byte strings; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.strings = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.strings[rank] = token
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self.pairs = np.array([p for p, _ in pairs] + [_NONE], np.int64)
        self.merged = np.array([r for _, r in pairs] + [0], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, _NONE where it can't be merged."""
        key = (left << 32) | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.merged[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; all pieces are padded to the longest."""
        longest = max(map(len, pieces))
        bits = max(1, (longest - 1).bit_length())
        width, rows = 1 << bits, len(pieces)
        sizes = np.array([len(p) for p in pieces])
        raw = np.zeros((rows, width + 1), np.uint8)
        for i, piece in enumerate(pieces):
            raw[i, : len(piece)] = np.frombuffer(piece, np.uint8)
        ids = self.single[raw]
        ids[np.arange(width + 1) >= sizes[:, None]] = -1
        after = np.tile(np.arange(1, width + 2), (rows, 1))
        before = np.tile(np.arange(-1, width), (rows, 1))
        # leaf: rank above position, so that the smallest one is the leftmost of the lowest rank
        place = np.arange(width)
        pair = ids[:, 1:] >= 0
        first = np.full((rows, width), _NONE)
        first[pair] = self.pair_ranks(ids[:, :-1][pair], ids[:, 1:][pair])
        tree = np.full((rows, 2 * width), _NONE)
        tree[:, width:] = np.where(first < _NONE, (first << bits) | place, _NONE)
        for level in range(bits - 1, -1, -1):
            low = tree[:, 2 << level : 4 << level]
            tree[:, 1 << level : 2 << level] = np.minimum(low[:, ::2], low[:, 1::2])
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            top = tree[live, 1]
            at, rank = top & (width - 1), top >> bits
            gone = after[live, at]
            follow = after[live, gone]
            ids[live, at], ids[live, gone] = rank, -1
            after[live, at] = follow
            inside = follow <= width
            before[live[inside], follow[inside]] = at[inside]
            last = before[live, at]

            def leaf(left_at: np.ndarray, right_at: np.ndarray, live: np.ndarray = live) -> np.ndarray:
                a = np.where(left_at >= 0, ids[live, left_at], -1)
                b = np.where(right_at <= width, ids[live, np.minimum(right_at, width)], -1)
                ranks = np.full(len(live), _NONE)
                both = (a >= 0) & (b >= 0)
                ranks[both] = self.pair_ranks(a[both], b[both])
                return np.where(ranks < _NONE, (ranks << bits) | left_at, _NONE)

            tree[live, width + gone] = _NONE
            tree[live, width + at] = leaf(at, follow)
            left = leaf(last, at)
            has = last >= 0
            tree[live[has], width + last[has]] = left[has]
            paths = [width + at, width + gone, width + np.where(has, last, at)]
            for _ in range(bits):
                paths = [p >> 1 for p in paths]
                for p in paths:
                    tree[live, p] = np.minimum(tree[live, 2 * p], tree[live, 2 * p + 1])
            live = live[tree[live, 1] < _NONE]
        return [row[row >= 0] for row in ids]

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """piece -> its ids as little-endian 32-bit integers."""
        out: dict[bytes, bytes] = {}
        by_bits: dict[int, list[bytes]] = {}
        for piece in pieces:
            if (whole := self.ranks.get(piece)) is not None:
                out[piece] = whole.to_bytes(4, "little")
            else:
                by_bits.setdefault((len(piece) - 1).bit_length(), []).append(piece)
        for bits, some in by_bits.items():
            step = max(1, _CELLS >> bits)
            for i in range(0, len(some), step):
                part = some[i : i + step]
                for piece, ids in zip(part, self.merge(part), strict=True):
                    out[piece] = ids.astype("<u4").tobytes()
        return out

    def decode(self, packed: bytes) -> bytes:
        """Bytes of ids given as little-endian 32-bit integers."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """A vocabulary from lines of base64 byte strings and ranks."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})


class Encoder:
    """Encodes texts one slice after another, remembering the pieces of the last ones."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split, self.known = vocabulary, regex.compile(pattern).findall, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        pieces = [self.split(t) if t else [] for t in texts]
        fresh = set().union(*pieces).difference(self.known)
        if len(self.known) + len(fresh) > _CACHE_LIMIT:
            self.known = {}
            fresh = set().union(*pieces)
        if fresh:
            raw = {p: p.encode("utf-8", "replace") for p in fresh}
            packed = self.vocabulary.encode_pieces(set(raw.values()))
            self.known.update((p, packed[b]) for p, b in raw.items())
        known = self.known.__getitem__
        return [b"".join(map(known, some)) for some in pieces]


def _slices(batches: Iterator[pa.RecordBatch], column: str, most_chars: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows in slices of about `most_chars` characters, at least one row."""
    for batch in batches:
        for part, texts in texts_of(batch, column, 1024):
            start, held = 0, 0
            for i, text in enumerate(texts):
                held += len(text or "")
                if held >= most_chars or i == len(texts) - 1:
                    yield part.slice(start, i + 1 - start), texts[start : i + 1]
                    start, held = i + 1, 0


def _mapped(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, out: list[T.StructField], kinds: list[pa.DataType], made: Callable[[Vocabulary, bytes], tuple]) -> DataFrame:
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load(path), pattern)
        for part, texts in _slices(batches, "_text"):
            rows = [made(encoder.vocabulary, packed) for packed in encoder.encode(texts)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch([part.column(0), *columns], names=[id_col, *[f.name for f in out]])

    return narrow.mapInArrow(run, T.StructType([narrow.schema[0], *out]))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the token ids of each text. `path` names the vocabulary on every executor."""
    field = T.StructField("ids", T.ArrayType(T.LongType()))
    return _mapped(docs, path, pattern, id_col, text_col, [field], [pa.list_(pa.int64())], lambda _, p: (np.frombuffer(p, "<u4").astype(np.int64),))


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, data): the bytes behind each list of ids; null for a null list."""
    narrow = rows.select(F.col(id_col), F.col(ids_col).cast("array<long>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = load(path).strings
        for batch in batches:
            for part, lists in texts_of(batch, "_ids"):
                data = [None if ids is None else b"".join(map(strings.__getitem__, ids)) for ids in lists]
                yield pa.record_batch([part.column(0), pa.array(data, pa.binary())], names=[id_col, "data"])

    return narrow.mapInArrow(run, T.StructType([narrow.schema[0], T.StructField("data", T.BinaryType())]))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again, in one pass."""

    def made(vocabulary: Vocabulary, packed: bytes) -> tuple[int, str, str]:
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(vocabulary.decode(packed)).hexdigest()

    out = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, path, pattern, id_col, text_col, out, [pa.int64(), pa.string(), pa.string()], made)
