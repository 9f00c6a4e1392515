"""Vector codes by product quantisation in integers, with the nearest entries memoised per grid cell.

Vectors become integers, floor(scale * x), and are cut into equal parts. Every part position has a codebook. To find
the nearest entry of a part, the part's coarse cell (its integers divided by `cell`) is hashed and looked up in
a cache. For a cell seen for the first time, the smallest and the largest distance of each entry to the cell's box are
worked out; an entry whose smallest distance exceeds the largest one of some other entry is farther than that one
wherever in the box the part lies, so it is left out. The cache keeps the others, and only those are evaluated
exactly. All arithmetic is in integers, so neither batches nor tasks change a result.

A codebook starts as the parts of the vectors with the smallest ids. A round assigns all parts and replaces each
entry by the componentwise floor(sum / count) of its parts. Tasks send one row of sums per entry and are added up in
Spark; the driver holds codebooks only (`entries` x length numbers).

Defined cases: rows whose vector is null, or holds a null or non-finite component, are left out; so are vectors whose length
is not a multiple of `parts`. Vectors of each length have codebooks of their own. Repeated rows each count, and each
has its row in the result; among equal ids the smaller vector starts a codebook; null ids start one only
after all others. Fewer vectors than `entries` make a smaller codebook. Integers beyond 2^22 (components beyond
16,384) are taken as that, so that errors fit a long; a part has at most 512 components. Null labels are equal to
one another. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.session import small_side, staged

PARTS, ENTRIES, ROUNDS, CELL = 16, 64, 2, 32
CLIP = 1 << 22
MOST_CELLS = 1 << 16  # cells that a task keeps per part; a cache that grows beyond starts anew
MOST_NUMBERS = 1 << 22  # rows times entries times components that are worked on at a time


def whole(column: Column, scale: int) -> Column:
    """The integers of a vector."""
    bound = F.lit(float(CLIP))
    return F.transform(column, lambda x: F.floor(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), bound), -bound)).cast("int"))


def integers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int = PARTS, scale: int = 256) -> DataFrame:
    """(id, label, dims, v) of the vectors that take part."""
    vec = F.col(f"`{vec_col}`")
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.filter(vec.isNotNull() & finite & (F.size(vec) % parts == 0))
    return rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.size(vec).alias("dims"), whole(vec, scale).alias("v"))


class GridCells:
    """Nearest entries of one codebook: a cache from the hash of a coarse cell to the entries that can be nearest in it."""

    def __init__(self, entries: np.ndarray, cell: int = CELL, most: int = MOST_CELLS):
        self.entries, self.cell, self.most = entries.astype(np.int64), cell, most
        # odd multipliers by a rule: the hash is only an address, the cell itself is compared
        self.mix = (np.arange(1, entries.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.cells = np.empty((0, self.entries.shape[1]), np.int64)
        self.starts, self.counts, self.kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _undominated(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many entries can be nearest somewhere in each cell, and which, cell after cell in ascending order."""
        n, k = len(cells), len(self.entries)
        least, most = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        for d in range(cells.shape[1]):
            low = cells[:, d, None] * self.cell
            high, at = low + self.cell - 1, self.entries[None, :, d]
            off = np.maximum(np.maximum(low - at, at - high), 0)
            least += off * off
            far = np.maximum(np.abs(at - low), np.abs(high - at))
            most += far * far
        row, entry = np.nonzero(least <= most.min(axis=1, keepdims=True))
        return np.bincount(row, minlength=n), entry

    def _remember(self, hashes: np.ndarray, cells: np.ndarray) -> None:
        if len(self.slots) + len(hashes) > self.most:
            self._forget()
        counts, entries = self._undominated(cells)
        self.slots.update(zip(hashes.tolist(), range(len(self.cells), len(self.cells) + len(cells)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.kept) + np.cumsum(counts) - counts])
        self.cells, self.counts, self.kept = np.concatenate([self.cells, cells]), np.concatenate([self.counts, counts]), np.concatenate([self.kept, entries])

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, the lower of equally near ones, and the squared distance."""
        step = max(1, MOST_NUMBERS // max(1, self.entries.size))
        found = [self._nearest(rows[i : i + step]) for i in range(0, len(rows), step)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = rows // self.cell
        hashed, first, back = np.unique((cells.astype(np.uint64) * self.mix).sum(axis=1, dtype=np.uint64), return_index=True, return_inverse=True)
        cells_of = cells[first]
        new = np.array([h not in self.slots for h in hashed.tolist()])
        if len(self.slots) + int(new.sum()) > self.most:
            self._forget()
            new[:] = True
        if new.any():
            self._remember(hashed[new], cells_of[new])
        slot = np.array([self.slots[h] for h in hashed.tolist()], np.int64)[back]
        counts, starts = self.counts[slot], self.starts[slot]
        ends = np.cumsum(counts)
        begins = ends - counts
        at = np.arange(ends[-1]) - np.repeat(begins - starts, counts)
        entry = self.kept[at]
        off = np.repeat(rows, counts, axis=0) - self.entries[entry]
        # distance first, then index; both fit one integer as components are clipped
        best = np.minimum.reduceat((off * off).sum(axis=1) * len(self.entries) + entry, begins)
        found, error = best % len(self.entries), best // len(self.entries)
        other = np.flatnonzero((self.cells[slot] != cells).any(axis=1))
        if len(other):  # two cells of one hash: all entries are looked at
            every = ((rows[other, None, :] - self.entries[None]) ** 2).sum(axis=2)
            found[other], error[other] = every.argmin(axis=1), every.min(axis=1)
        return found, error


def _matrix(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(batch.num_rows, parts, width)


def _sums(rows: DataFrame, books: np.ndarray, cell: int) -> DataFrame:
    """(part, entry, n, sums): a row for each entry in use in a task, added up."""
    parts, size, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [GridCells(b, cell) for b in books]
        counts, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for batch in batches:
            v = _matrix(batch, parts, width)
            for p, grid in enumerate(grids):
                found, _ = grid.nearest(v[:, p])
                counts[p] += np.bincount(found, minlength=size)
                np.add.at(sums[p], found, v[:, p])
        part, entry = np.nonzero(counts)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.record_batch(columns, names=["part", "entry", "n", "sums"])

    partial = rows.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[i]) for i in range(width)]
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*totals).alias("sums") if width else F.array().cast("array<long>").alias("sums"))


def codebooks(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL) -> np.ndarray:
    """The trained entries (part, entry, component) of the `integers` of one length."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(rows, books, cell).collect():
            books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books


def assigned(rows: DataFrame, books: np.ndarray, cell: int = CELL) -> DataFrame:
    """(id, label, code, error) for each row."""
    parts, _, width = books.shape
    label = rows.schema["label"].dataType.simpleString()
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [GridCells(b, cell) for b in books]
        for batch in batches:
            v, codes, error = _matrix(batch, parts, width), [], np.zeros(batch.num_rows, np.int64)
            for p, grid in enumerate(grids):
                found, off = grid.nearest(v[:, p])
                codes.append(found.astype(np.uint8))
                error += off
            flat = np.ascontiguousarray(np.stack(codes, axis=1))
            out = [batch.column("id"), batch.column("label"), pa.array([row.tobytes().hex() for row in flat]), pa.array(error)]
            yield pa.record_batch(out, names=["id", "label", "code", "error"])

    return rows.select("id", "label", "v").mapInArrow(run, f"id {kind}, label {label}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in order."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL
) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(id, label, dims, code, error) of all vectors that take part, and the codebooks of each length."""
    if not 1 <= entries <= 256:
        raise ValueError("a part's code is one byte")
    rows = integers(vectors, id_col, vec_col, label_col, parts)
    lengths = sorted(r["dims"] for r in rows.select("dims").distinct().collect())
    if lengths and lengths[-1] > 512 * parts:
        raise ValueError("more than 512 components in a part")
    books, coded = {}, None
    for dims in lengths:
        own = rows.filter(F.col("dims") == dims)
        books[dims] = codebooks(own, dims, parts, entries, rounds, cell)
        part = assigned(own, books[dims], cell).withColumn("dims", F.lit(dims))
        coded = part if coded is None else coded.unionAll(part)
    if coded is None:
        coded = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "dims").limit(0)
    return coded.select("id", "label", "dims", "code", "error"), books


def query(vectors: DataFrame) -> DataFrame:
    found, books = compress(vectors)
    coded = staged(found)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    named = F.coalesce(*[F.when(F.col("dims") == dims, F.lit(digest(b))) for dims, b in books.items()], F.lit(digest(np.empty(0, np.int64))))
    joined = coded.join(small_side(sums), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", named.alias("codebooks_sha256"))


_ROUND = """
, d{n} AS (
  SELECT v.i, v.p, c.e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS off FROM part v JOIN book{n} c ON c.p = v.p
), a{n} AS (SELECT i, p, min(off) AS off, arg_min(e, off * 64 + e) AS e FROM d{n} GROUP BY i, p)"""
_BOOK = """
, m{n} AS (
  SELECT p, e, list(f ORDER BY j) AS x FROM (
    SELECT a.p, a.e, j, floor(sum(v.x[j])::DOUBLE / count(*))::BIGINT AS f
    FROM a{n} a JOIN part v ON v.i = a.i AND v.p = a.p, range(1, 5) t(j) GROUP BY a.p, a.e, j) GROUP BY p, e
), book{m} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN m{n} m ON m.p = b.p AND m.e = b.e)"""

#: The same for vectors of 64 components.
SQL = (
    """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS (SELECT i, p, v[p * 4 + 1 : p * 4 + 4] AS x FROM kept, range(16) t(p))
, book0 AS (SELECT p, i - 1 AS e, x FROM part WHERE i <= 64)"""
    + "".join(_ROUND.format(n=n) + _BOOK.format(n=n, m=n + 1) for n in range(ROUNDS))
    + _ROUND.format(n=ROUNDS)
    + """
, coded AS (SELECT i, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, sum(off)::BIGINT AS error FROM a2 GROUP BY i)
SELECT k.vec_id, lower(c.code) AS code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM kept k JOIN coded c ON c.i = k.i
"""
)
