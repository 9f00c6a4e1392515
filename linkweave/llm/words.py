"""Words, word shingles and shared text helpers used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_CACHE_LIMIT = 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class WordHashes(dict):
    """word -> 64-bit hash, forgotten when it grows past a fixed size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `size`-word shingles of a text, A-Z lowered; a shorter text is
    one shingle, a text without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ codes[i : len(words) - width + 1 + i]) * _STEP
        out ^= out >> np.uint64(29)
    return np.unique(out)


def texts_of(batch: pa.RecordBatch, column: str, step: int = 256) -> Iterator[tuple[pa.RecordBatch, list]]:
    """A batch in slices, so that what is built from long texts stays small."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part, part.column(column).to_pylist()
