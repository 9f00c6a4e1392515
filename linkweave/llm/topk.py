"""Exact top-k search by inner product over a bit-sliced index.

Vectors become integers, floor(scale * x). Rows are dealt into blocks. In a block, each attribute is stored relative to
its smallest value there, without its lowest `drop` bits, as one bitmap per remaining bit: the slices. A
query adds the slices of each attribute, once for every set bit of its weight there (complemented where the weight is
negative), with carry-save adders over whole bitmaps. The sum is itself a set of slices. From its most significant one
downward, the k largest sums are found with bitmap operations only. What the dropped bits could add is bounded, so rows whose
sum lies within that bound of the k-th one are resolved exactly with the stored integers; all others are out.

The index is a table of blocks. Queries are gathered into blocks as well, and every block of queries meets every
block of rows once; a block yields at most k rows a query.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part; vectors are compared
with vectors of the same length only; rows repeated in full count once; rows with the query's id are its own
and no candidates; null ids take no part; ties go to the smaller id; an empty table gives an empty result. Other columns
are ignored. Scores must fit into 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.session import staged

BLOCK_ROWS = 32_768
QUERY_ROWS = 256
DROP = 2
_INDEX = pa.schema(
    [("dims", pa.int32()), ("block", pa.int32()), ("rows", pa.int32()), ("ids", pa.binary()), ("values", pa.binary()), ("wide", pa.int32()), ("lows", pa.binary()), ("counts", pa.binary()), ("slices", pa.binary())]
)


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, dims, v): distinct rows with an id and finite components, as integers."""
    wide = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), wide.alias("w"))
    finite = F.forall("w", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.filter(F.col("id").isNotNull() & F.col("w").isNotNull() & finite)
    return rows.select("id", F.size("w").alias("dims"), F.transform("w", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v")).distinct()


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate([np.empty(0, np.int64), *flat]).astype(np.int64).reshape(len(column), dims)


def sliced(values: np.ndarray, drop: int = DROP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest value and number of slices of each attribute, and the slices as rows of 64-row words, lowest bit first."""
    lows = values.min(axis=0)
    kept = (values - lows) >> drop
    counts = np.array([int(m).bit_length() for m in kept.max(axis=0)], np.int64)
    width = -(-len(values) // 64)
    slices = np.zeros((int(counts.sum()), width * 8), np.uint8)
    row = 0
    for d, count in enumerate(counts):
        for b in range(count):
            packed = np.packbits((kept[:, d] >> b & 1).astype(np.uint8), bitorder="little")
            slices[row, : len(packed)] = packed
            row += 1
    return lows, counts, slices.view(np.uint64)


def build(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index over `integers`: a row per block with its ids, integers and slices."""
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))

    def make(key: tuple, table: pa.Table) -> pa.Table:
        dims, block = key[0].as_py(), key[1].as_py()
        ids = table.column("id").to_numpy()
        values = _matrix(table.column("v"), dims)
        lows, counts, slices = sliced(values)
        small = values.astype(np.int32) if not values.size or np.abs(values).max() < 1 << 31 else values
        parts = {"dims": dims, "block": block, "rows": len(ids), "ids": ids.tobytes(), "values": small.tobytes(), "wide": small.itemsize, "lows": lows.tobytes(), "counts": counts.tobytes(), "slices": slices.tobytes()}
        return pa.table({k: [v] for k, v in parts.items()}, schema=_INDEX)

    return staged(dealt.groupBy("dims", "block").applyInArrow(make, "dims int, block int, rows int, ids binary, values binary, wide int, lows binary, counts binary, slices binary"))


def add_up(groups: dict[int, np.ndarray], words: int) -> list[np.ndarray]:
    """Slices, lowest first, of the sum of bitmaps: groups holds the bitmaps of each power of two as rows."""
    out: list[np.ndarray] = []
    weight = 0
    while groups:
        now, carries = groups.pop(weight, np.empty((0, words), np.uint64)), []
        while len(now) > 1:
            third = len(now) // 3
            if third:
                a, b, c = now[:third], now[third : 2 * third], now[2 * third : 3 * third]
                half = a ^ b
                carries.append((a & b) | (half & c))
                now = np.concatenate([half ^ c, now[3 * third :]])
            else:
                carries.append(now[:1] & now[1:])
                now = now[:1] ^ now[1:]
        out.append(now[0] if len(now) else np.zeros(words, np.uint64))
        if carries:
            above = [groups[weight + 1]] if weight + 1 in groups else []
            groups[weight + 1] = np.concatenate(above + carries)
        weight += 1
    return out


def _held(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def largest(slices: list[np.ndarray], among: np.ndarray, k: int) -> int:
    """The k-th largest sum of the rows in `among`, bit by bit from the top; `among` has at least k rows."""
    sure, level, equal = 0, 0, among
    for t in range(len(slices) - 1, -1, -1):
        ones = equal & slices[t]
        n = _held(ones)
        if sure + n >= k:
            equal, level = ones, level | 1 << t
        else:
            sure, equal = sure + n, equal & ~slices[t]
    return level


def at_least(slices: list[np.ndarray], among: np.ndarray, level: int) -> np.ndarray:
    """Rows of `among` whose sum is at least `level`."""
    if level <= 0:
        return among
    above, equal = np.zeros_like(among), among
    for t in range(len(slices) - 1, -1, -1):
        if level >> t & 1:
            equal = equal & slices[t]
        else:
            above, equal = above | (equal & slices[t]), equal & ~slices[t]
    return above | equal


class Block:
    """One block of the index, ready for queries."""

    def __init__(self, row: dict, drop: int = DROP):
        self.drop, n, dims = drop, row["rows"], row["dims"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.values = np.frombuffer(row["values"], np.int32 if row["wide"] == 4 else np.int64).reshape(n, dims)
        self.counts = np.frombuffer(row["counts"], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.words = -(-n // 64)
        slices = np.frombuffer(row["slices"], np.uint64).reshape(-1, self.words) if len(row["slices"]) else np.empty((0, self.words), np.uint64)
        self.slices = np.concatenate([slices, ~slices])
        self.half = len(slices)
        bits = np.zeros(self.words * 64, np.uint8)
        bits[:n] = 1
        self.all = np.packbits(bits, bitorder="little").view(np.uint64)

    def candidates(self, query: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Positions of all rows that may be among the k best; `own` are left out."""
        among = self.all.copy()
        for i in own:
            among[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        if _held(among) > k and self.half:
            picked: dict[int, list[np.ndarray]] = {}
            for d in np.flatnonzero((query != 0) & (self.counts > 0)):
                weight, rows = abs(int(query[d])), np.arange(self.counts[d]) + self.first[d] + (self.half if query[d] < 0 else 0)
                for p in range(weight.bit_length()):
                    if weight >> p & 1:
                        for b, r in enumerate(rows):
                            picked.setdefault(p + b, []).append(r)
            sums = add_up({w: self.slices[np.array(rows)] for w, rows in picked.items()}, self.words)
            # the dropped bits add less than this many units of the sum
            slack = int(np.abs(query).sum())
            among = at_least(sums, among, largest(sums, among, k) - slack)
        return np.flatnonzero(np.unpackbits(among.view(np.uint8), bitorder="little"))

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows."""
        at = self.candidates(query, np.flatnonzero(self.ids == query_id), k)
        scores = self.values[at].astype(np.int64) @ query
        order = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][order], scores[order]


def search(index: DataFrame, queries: DataFrame, k: int, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of the index for each row of `queries` (as from `integers`)."""
    blocks = max(1, -(-queries.count() // query_rows))
    key = F.xxhash64("id", "v")
    gathered = queries.withColumn("key", key).groupBy("dims", F.pmod("key", F.lit(blocks)).alias("qblock")).agg(F.collect_list(F.struct("id", "key", "v")).alias("queries"))
    meetings = staged(gathered).join(index.select("dims", "block"), "dims")
    pairs = meetings.join(index, ["dims", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, found = Block(row), []
                for q in row["queries"]:
                    ids, scores = block.best(q["id"], np.array(q["v"], np.int64), k)
                    found += [(q["id"], q["key"], int(v), int(s)) for v, s in zip(ids, scores, strict=True)]
                columns = list(zip(*found, strict=True)) or [[], [], [], []]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_id", "key", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    rows = staged(integers(vectors, "vec_id", "embedding"))
    return search(build(rows), rows.filter(F.col("id") % every == 0), k)


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
