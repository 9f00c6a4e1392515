"""Near copies among embeddings: an exact range join in the metric of unit vectors, cell by cell.

Vectors of one label are linked when their cosine reaches `least`. On unit vectors that is a Euclidean distance of at most
r = sqrt(2 - 2 * least). Pivots partition the vectors: each belongs to the cell of its nearest pivot. A vector x of cell
i can have a partner in cell j only if it is within r of the points nearer to p_j than to p_i, that is if
d(x, p_j)^2 - d(x, p_i)^2 <= 2 r d(p_i, p_j); by the triangle inequality d(x, p_i) + d(x, p_j) >= d(p_i, p_j), so
every other vector has d(x, p_j) - d(x, p_i) > 2 r. Such boundary vectors are copied to cell j, in one direction (j < i),
so that every pair meets in one cell, once. Cells then join independently.

How far boundaries reach depends on the data, so the number of pivots is measured, not set: the largest power of two for
which a bounded sample averages at most `copies` rows a vector and a label's cells stay above `cell_rows`. A cell with many
rows is cut into blocks by hash, and each two blocks meet in a task of their own. Equal vectors are
one row with a count, and a task sends the number of partners of each row and links that span what is connected,
not pairs.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component, and rows with a null label or a null id, link with
nothing: their class is their own id (null for a null id) and they are kept. Vectors of different length are not
linked. Repeated rows are one vector and one row of the result; rows that share an id, but not the vector or label, are
vectors of their own in one class. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.ngram_join import components
from linkweave.session import discard, small_side, staged

SAMPLE, SAMPLE_NUMBERS = 4096, 1 << 20  # vectors, and their components, that pivots are taken from and boundaries measured on
MOST_PIVOTS = 256
CELL_ROWS = 512
COPIES = 3.0
BLOCK_ROWS = 2048
SLACK = 1e-9  # wider than all rounding of distances and cosines of unit vectors
_FOUND = pa.schema([("node", pa.int64()), ("label", pa.string()), ("h", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def spread_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors far apart from one another: the first, then always the one farthest from all before."""
    chosen, nearest = [0], 2 - 2 * sample @ sample[0]
    while len(chosen) < min(most, len(sample)):
        at = int(nearest.argmax())
        if nearest[at] <= SLACK:
            break
        chosen.append(at)
        nearest = np.minimum(nearest, 2 - 2 * sample @ sample[at])
    return sample[chosen]


class Cells:
    """Home cell and boundary copies of unit vectors."""

    def __init__(self, pivots: np.ndarray, radius: float):
        self.pivots, self.radius = pivots, radius
        self.apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, home): a row once with its home cell and once with each lower cell whose boundary it is near."""
        squares = 2 - 2 * x @ self.pivots.T
        home = squares.argmin(axis=1)
        reach = 2 * self.radius * self.apart[home] + SLACK
        near = squares - squares.min(axis=1, keepdims=True) <= reach
        near &= np.arange(len(self.pivots)) <= home[:, None]
        row, cell = np.nonzero(near)
        return row, cell, cell == home[row]


def chosen_pivots(sample: np.ndarray, most_cells: int, radius: float, copies: float = COPIES) -> np.ndarray:
    """The largest power of two of pivots, at most `most_cells`, with at most `copies` rows a vector on the sample."""
    pivots = spread_pivots(sample, min(MOST_PIVOTS, most_cells))
    # with fewer pivots than clusters boundaries run through clusters, so copies may fall again with more pivots
    fits = [k for k in (1 << t for t in range(len(pivots).bit_length())) if len(Cells(pivots[:k], radius)(sample)[0]) <= copies * len(sample)]
    return pivots[: fits[-1]]


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v, h): each vector once; label null for those that link with nothing, else its text."""
    vec = F.col(f"`{vec_col}`")
    sound = vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    sound = sound & F.exists(vec, lambda x: x != 0) & F.col(f"`{id_col}`").isNotNull()
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("_label"), vec.alias("v"), F.coalesce(sound, F.lit(False)).alias("_sound"))
    label = F.when(F.col("_sound"), F.col("_label"))
    return rows.groupBy("id", "_label", "v", "_sound").agg(F.first(F.lit(1))).select("id", label.alias("label"), "v", F.xxhash64("v").alias("h"))


def _arrays(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def dealt(reps: DataFrame, least: float, cell_rows: int = CELL_ROWS, copies: float = COPIES) -> DataFrame:
    """(dims, label, cell, home, node, h, many, x): representatives, with boundary copies; x has the bytes of the components."""
    radius = float(np.sqrt(2 - 2 * least))
    sizes = reps.groupBy(F.size("v").alias("dims"), "label").agg(F.count("*").alias("n")).groupBy("dims").agg(F.max("n").alias("n"))
    count, longest = reps.agg(F.count("*"), F.max(F.size("v"))).first()
    most = max(256, min(SAMPLE, SAMPLE_NUMBERS // (longest or 1)))
    few = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < min(1 << 30, -(-(2 * most << 30) // max(1, count)))
    sample = reps.filter(few).select(F.size("v").alias("dims"), "v").orderBy(F.xxhash64(F.xxhash64("v")), "v").limit(most).collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(r["dims"], []).append(r["v"])
    largest = {r["dims"]: r["n"] for r in sizes.filter(F.col("dims").isin(list(by_length))).collect()}
    # lengths that no sampled vector has are one cell a label
    cells = {d: Cells(chosen_pivots(unit(np.array(v, np.float64)), max(1, largest[d] // cell_rows), radius, copies), radius) for d, v in by_length.items()}

    single = reps.schema["v"].dataType.elementType.simpleString() == "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = np.diff(whole.column("v").offsets.to_numpy()) if whole.num_rows else np.empty(0, np.int64)
            for dims in np.unique(lengths):
                batch = whole.filter(pa.array(lengths == dims))
                v = _arrays(batch.column("v"))
                x = unit(v)
                row, cell, home = cells[int(dims)](x) if int(dims) in cells else (np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool))
                at = pa.array(row)
                out = [pa.array(np.full(len(row), dims, np.int32)), batch.column("label").take(at), pa.array(cell.astype(np.int32)), pa.array(home)]
                out += [batch.column(c).take(at) for c in ("node", "h", "many")] + [pa.array([y.tobytes() for y in (v.astype(np.float32) if single else v)], pa.binary()).take(at)]
                yield pa.record_batch(out, names=["dims", "label", "cell", "home", "node", "h", "many", "x"])

    return reps.select("label", "node", "h", "many", "v").mapInArrow(run, "dims int, label string, cell int, home boolean, node long, h long, many long, x binary")


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect whatever the links of the matrix connect: fewer than its rows and columns."""
    rows, columns, out = near.any(axis=1), np.ones(near.shape[1], bool), []
    while rows.any():
        front = [int(rows.argmax())]
        rows[front[0]] = False
        while front:
            at = front.pop()
            new = np.flatnonzero(near[at] & columns)
            columns[new] = False
            out += [(at, int(j)) for j in new]
            for j in new:
                met = np.flatnonzero(near[:, j] & rows)
                rows[met] = False
                out += [(int(i), int(j)) for i in met]
                front += met.tolist()
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine by plain sums, for pairs within rounding of the threshold."""
    dot = sum(x * y for x, y in zip(a.tolist(), b.tolist(), strict=True))
    return dot / (sum(x * x for x in a.tolist()) ** 0.5 * sum(x * x for x in b.tolist()) ** 0.5)


def linked(x: np.ndarray, y: np.ndarray, x_home: np.ndarray, y_home: np.ndarray, least: float) -> np.ndarray:
    """The links between two blocks: cosine reached, one of the two at home."""
    score = x @ y.T
    near = score >= least
    for i, j in zip(*np.nonzero(np.abs(score - least) <= 1e-12), strict=True):
        near[i, j] = cosine(x[i], y[j]) >= least
    return near & (x_home[:, None] | y_home[None, :])


def _met(rows: DataFrame, least: float, block_rows: int, single: bool) -> DataFrame:
    """(node, label, h, links, to): numbers of partners, each copy counted, and spanning links (with `to`)."""
    keys = ["dims", "label", "cell"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    cut = rows.join(small_side(counts), keys).withColumn("block", F.pmod(F.xxhash64("node", "h"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = cut.withColumn("_k", other).withColumn("a", F.least("block", "_k")).withColumn("b", F.greatest("block", "_k"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind = np.float32 if single else np.float64
        x = unit(np.array([np.frombuffer(y.as_py(), kind) for y in table.column("x")]).astype(np.float64))
        home, many, block = (table.column(c).to_numpy() for c in ("home", "many", "block"))
        one, two = (np.flatnonzero(block == k.as_py()) for k in key[3:])
        near = linked(x[one], x[two], home[one], home[two], least)
        links = np.zeros(len(x), np.int64)
        if key[3] == key[4]:
            np.fill_diagonal(near, True)  # a row meets itself
            links += near @ many - many
        else:
            links[one] += near @ many[two]
            links[two] += many[one] @ near
        ends = np.array([(one[i], two[j]) for i, j in spanning(near) if one[i] != two[j]], np.int64).reshape(-1, 2)
        hit = np.flatnonzero(links)
        node, label, h = (table.column(c).combine_chunks() for c in ("node", "label", "h"))
        at = pa.array(np.concatenate([hit, ends[:, 0]]))
        partner = pa.concat_arrays([pa.nulls(len(hit), pa.int64()), node.take(pa.array(ends[:, 1]))])
        number = pa.array(np.concatenate([links[hit], np.zeros(len(ends), np.int64)]))
        return pa.table([node.take(at), label.take(at), h.take(at), number, partner], schema=_FOUND)

    return met.groupBy(*keys, "a", "b").applyInArrow(run, "node long, label string, h long, links long, to long")


def near_copies(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each vector."""
    rows = staged(distinct_vectors(vectors, id_col, vec_col, label_col))
    reps = staged(rows.filter("label is not null").groupBy("label", "h", "v").agg(F.min("id").alias("node"), F.count("*").alias("many")))
    single = reps.schema["v"].dataType.elementType.simpleString() == "float"
    cells = staged(dealt(reps, least, cell_rows))
    found = staged(_met(cells, least, block_rows, single))
    discard(cells)
    links = found.filter("links > 0").groupBy("node", "label", "h").agg(F.sum("links").alias("links"))
    same = rows.filter("label is not null").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    alike = rows.join(same, "id").join(reps, ["label", "h", "v"]).select(F.col("id").alias("a"), F.col("node").alias("b"))
    classes = components(found.filter("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")).unionAll(alike))
    known = reps.join(links, ["node", "label", "h"], "left").join(classes, "node", "left")
    known = known.select("label", "h", "v", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("comp", "node").alias("component_id"))
    out = rows.join(known, ["label", "h", "v"], "left")
    component = F.coalesce("component_id", "id")
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def query(vectors: DataFrame) -> DataFrame:
    return near_copies(vectors)


SQL = """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), s AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM s x JOIN s y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b)
, low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(l.b, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(l.b, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN low l ON l.a = v.vec_id
"""
