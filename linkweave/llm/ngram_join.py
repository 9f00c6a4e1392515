"""N-gram Jaccard join: documents whose word-shingle sets overlap by 0.8 or more, and what they connect to.

Prefix filtering with several matches. The shingles of a set are ordered rare first (by a fixed-size count
sketch over all documents, then by hash). If two sets x and y with |y| <= |x| share at least t shingles, the
first |x| - t + m of x and the first |y| - t + m of y share at least m, for any m <= t. Each document picks its
own m: the expected number of partners of its prefix is read off the sketch, and the prefix is lengthened, with
as many more common shingles required, while that lowers the expected cost. A pair asks for the smaller m of the two.

Large groups of near copies are not expanded into all pairs. Documents are first reduced to distinct sets. In a round
of hubs each set is compared to one other: the sets under a prefix shingle have one of them as their hub, and a set takes
the hub that it shares most shingles with. Verified links merge sets into components. Rounds
go on with other hubs while many pairs lie across components and their number falls by a fifth or more. Then all pairs across
components are compared that can be similar, so no link between two components is lost: a pair is formed under a shingle only if
both sets have enough shingles left from there on for it to be their first common one, and very common shingles, which stand
late in most prefixes, are cut into cells of the sizes and ends that fit each other. The result is the components: links within a component are
not all computed nor listed, and `on_links` gets a connecting part of them.

Defined cases: a null text, an empty text or one of white space has no shingles and is linked with nothing; a
text shorter than a shingle is one shingle; repeated rows share their component; a null id takes part in links but is
nobody's smallest id; an empty table gives an empty result. Other columns of the input are not looked at.
Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm.words import WordHashes, shingles, texts_of
from linkweave.session import discard, staged

SKETCH_BITS = 23
CHUNK_BITS = 14  # cells of the sketch that travel as one row
BROADCAST_IDS = 500_000
MOST_PAIRS = 8  # for each posting: what may meet in the end without another round of hubs
MOST_MATCHES = 4
HEAVY = 16  # components; shingles of more are cut into cells
VERIFY_COST = 0.05  # of comparing one shingle of a candidate, against reading one posting


def _cells(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _node(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """A row (id, n, node) per document, and rows (chunk, counts) of the shingle counts of each task."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for part, texts in texts_of(batch, "text"):
                n, node = [], []
                for text in texts:
                    found = shingles(text, hashes, size)
                    n.append(len(found))
                    node.append(_node(found) if len(found) else None)
                    np.add.at(counts, _cells(found), 1)
                rows = part.num_rows
                yield pa.record_batch(
                    [part.column("id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], schema=schema
                )
        for chunk, cells in enumerate(counts.reshape(-1, 1 << CHUNK_BITS)):
            if cells.any():
                none = pa.nulls(1, pa.int64())
                yield pa.record_batch([none, none, none, pa.array([chunk], pa.int32()), pa.array([zlib.compress(cells.tobytes(), 1)])], schema=schema)

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return staged(narrow.mapInArrow(run, "id long, n long, node long, chunk int, counts binary"))


def _sketch(sets: DataFrame) -> np.ndarray:
    """Shingles per cell over all documents: 2^SKETCH_BITS numbers whatever the size of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                cells = np.frombuffer(zlib.decompress(counts.as_py()), np.uint32)
                sums[chunk] = sums.get(chunk, np.zeros(1 << CHUNK_BITS, np.uint64)) + cells
        for chunk, cells in sums.items():
            data = np.minimum(cells, np.iinfo(np.uint32).max).astype(np.uint32).tobytes()
            yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([data])], names=["chunk", "counts"])

    parts = sets.filter("chunk is not null").select("chunk", "counts").repartition(16, "chunk")
    out = np.zeros((1 << SKETCH_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.uint32)
    for row in parts.mapInArrow(run, "chunk int, counts binary").collect():
        out[row["chunk"]] = np.frombuffer(row["counts"], np.uint32)
    return out.reshape(-1)


def pick_matches(common: np.ndarray, n: int, need: int) -> int:
    """How many common prefix shingles to ask of a set: `common` holds, rare first, the expected number of other
    sets with each shingle, `need` the overlap that any partner needs."""
    best, least = 1, None
    for m in range(1, min(MOST_MATCHES, need) + 1):
        postings = float(common[: n - need + m].sum())
        cost = (n - need + m) + postings + VERIFY_COST * n * postings / m
        if least is None or cost < least:
            best, least = m, cost
    return best


def _postings(docs: DataFrame, text_col: str, size: int, sketch: np.ndarray) -> DataFrame:
    """(token, node, at, held) for each shingle of each distinct set's prefix that another set may share.

    `at` packs the set's size, the shingle's position and the number of matches to ask for; `held` counts the set's rows."""
    names = ["token", "node", "at"]
    usual = float(sketch.mean())
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, out, held = WordHashes(), set(), [], 0

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

        for batch in batches:
            for _, texts in texts_of(batch, "text"):
                for text in texts:
                    found = shingles(text, hashes, size)
                    n = len(found)
                    if not n or (node := _node(found)) in seen:
                        continue
                    seen.add(node)
                    often = shared.value[_cells(found)].astype(np.int64)
                    need = (4 * n + 4) // 5
                    order = np.lexsort((found, often))[: n - need + min(MOST_MATCHES, need)]
                    m = pick_matches(np.maximum(often[order] - usual, 0), n, need)
                    order = order[: n - need + m]
                    at = (np.arange(len(order), dtype=np.int64) << 4) + ((n << 34) + m)
                    out.append((found[order].view(np.int64), np.full(len(order), node), at))
                    held += len(order)
                    if held >= 1 << 16:
                        yield flush()
                        out, held = [], 0
        if out:
            yield flush()

    narrow = docs.select(F.col(text_col).cast("string").alias("text"))
    raw = staged(narrow.mapInArrow(run, "token long, node long, at long"))
    shared.destroy()  # the rows are written
    several = raw.groupBy("token").count().filter("count > 1").select("token")
    shared_ones = raw.join(several, "token", "left_semi").distinct()  # distinct: copies in other tasks repeat a set
    out = staged(shared_ones.withColumn("held", F.count("*").over(Window.partitionBy("node"))))  # as many as a set's prefix has
    discard(raw)
    return out


def _shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the given sets, read from one document each; other sets may come along."""
    holders = sets.filter("node is not null").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("_holder"))
    holders = staged(holders.select("_holder").distinct())
    if holders.count() <= BROADCAST_IDS:  # else the texts are shuffled by id
        holders = F.broadcast(holders)
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    texts = narrow.join(holders, F.col("_id").eqNullSafe(F.col("_holder")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for _, some in texts_of(batch, "text"):
                found = [f for f in (shingles(t, hashes, size) for t in some) if len(f)]
                node = [_node(f) for f in found]
                yield pa.record_batch([pa.array(node, pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["node", "shingles"])

    return staged(texts.mapInArrow(run, "node long, shingles array<long>"))


def _matching(pairs: DataFrame) -> DataFrame:
    """Pairs that share as many prefix shingles as they have to.

    `pairs` has node and at of either set (suffixes 1 and 2), a row per common prefix shingle whose hub is one of the pair."""
    parts = pairs.selectExpr(
        "node1", "node2", "at1 >> 34 AS n1", "at2 >> 34 AS n2", "at1 >> 4 & 1073741823 AS pos1", "at2 >> 4 & 1073741823 AS pos2", "least(at1 & 15, at2 & 15) AS m"
    ).filter("5 * least(n1, n2) >= 4 * greatest(n1, n2)")
    # as many shingles lie before and behind a common one as the overlap leaves room for
    room = parts.filter("9 * (least(pos1, pos2) + least(n1 - pos1, n2 - pos2)) >= 4 * (n1 + n2)")
    longer = "(n1 > n2 OR (n1 = n2 AND node1 > node2))"
    inside = "pos{0} < n{0} - " + "(CASE WHEN {1} THEN (4 * n{0} + 4) div 5 ELSE (8 * n{0} + 8) div 9 END) + m"
    kept = room.filter(inside.format(1, longer)).filter(inside.format(2, f"NOT {longer}"))
    counted = kept.groupBy("node1", "node2").agg(F.count("*").alias("shared"), F.first("m").alias("m")).filter("shared >= m")
    return counted.select("node1", "node2", "shared")


def _best_hub(matching: DataFrame) -> DataFrame:
    """Each set with one hub: the one it shares most with, of equal ones the smallest."""
    best = F.max_by("node1", F.struct("shared", F.bitwise_not("node1"))).alias("node1")
    return matching.groupBy("node2").agg(best).select("node1", "node2")


def _verified(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """The candidate pairs whose sets are similar enough: 100 * intersection >= 80 * union."""
    left = contents.select(F.col("node").alias("node1"), F.col("shingles").alias("_x"))
    right = contents.select(F.col("node").alias("node2"), F.col("shingles").alias("_y"))
    both = pairs.join(right, "node2").join(left, "node1")
    similar = both.filter(9 * F.size(F.array_intersect("_x", "_y")) >= 4 * (F.size("_x") + F.size("_y")))
    return similar.select(F.col("node1").alias("a"), F.col("node2").alias("b"))


def _settled(pairs: DataFrame) -> bool:
    """Whether pairs (x, y) are stars: each x has one y, and no y is an x."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("v"), F.lit(1).alias("child")), F.struct(F.col("y").alias("v"), F.lit(0).alias("child")))).alias("e"))
    uses = ends.groupBy("e.v").agg(F.sum("e.child").alias("parents"), F.min("e.child").alias("low"))
    return uses.filter("parents > 1 OR (parents > 0 AND low = 0)").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node each linked node is connected to, smallest nodes left out; links (a, b).

    Alternates large-star and small-star until the links are stars; each round is written out."""
    pairs = staged(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x <> y").distinct())
    for _ in range(most_rounds):
        if _settled(pairs):
            return pairs.select(F.col("x").alias("node"), F.col("y").alias("comp"))
        both = pairs.unionAll(pairs.select("y", "x")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("x"), F.col("low").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("low"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("low").alias("y")).unionAll(low.select("x", "low"))
        pairs = staged(small.filter("x <> y").distinct())
    raise RuntimeError("components did not settle")


def _sides(frame: DataFrame, side: int) -> DataFrame:
    return frame.select("token", *[F.col(c).alias(f"{c}{side}") for c in ("node", "comp", "at")])


def _hub_pairs(spread: DataFrame, turn: int) -> DataFrame:
    """Each set under a shingle beside the shingle's hub: one set per shingle, the same for most shingles of a group."""
    # an edit makes shingles that no other set has: first the least edited set, which most others are close to, then any
    rank = F.struct(F.xxhash64("node", F.lit(turn)) if turn else -F.col("held"), F.col("node"))
    hubs = spread.groupBy("token").agg(F.min_by(F.struct("node", "comp", "at"), rank).alias("_hub")).select("token", "_hub.*")
    return _sides(hubs, 1).join(_sides(spread, 2), "token").filter("comp1 <> comp2")


def _spread(postings: DataFrame, comps: DataFrame) -> DataFrame:
    """The postings with their set's component, of shingles that several components hold; `heavy` are those of many."""
    known = postings.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    holders = known.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(F.count("*").alias("k"))
    several = holders.filter("k > 1").select("token", (F.col("k") > HEAVY).alias("heavy"))
    return staged(known.join(several, "token"))


def _band(size: str) -> str:
    """Number of a size's band: the size itself up to 32, then steps of a twentieth."""
    return f"IF({size} <= 32, {size}, 32 + CAST(FLOOR(LN({size} / 32) / LN(1.05)) AS BIGINT))"


def _roles(spread: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings (token, cell, comp, node, n, top) that can be the first common shingle of a pair: of its smaller set, and of its larger.

    Nothing is shared before the first common shingle, so a set of n shingles that has it at `pos` has partners of at most
    top = (5 n - 9 pos) / 4 shingles there. The smaller set's top must reach the larger one's n, the larger one's top the smaller one's
    n. Under heavy shingles sets meet in cells, bands of the larger one's n and of the least of its n and its top."""
    rows = spread.selectExpr("token", "heavy", "comp", "node", "at >> 34 AS n", "(5 * (at >> 34) - 9 * (at >> 4 & 1073741823)) div 4 AS top")
    low, high = _band("n"), _band("top")
    cells = f"FLATTEN(TRANSFORM(SEQUENCE({low}, {high}), x -> TRANSFORM(SEQUENCE({low}, x), y -> x * 65536 + y)))"
    names = ("token", "cell", "comp", "node", "n", "top")
    smaller = rows.filter("top >= n").withColumn("cell", F.explode(F.expr(f"IF(heavy, {cells}, ARRAY(0L))"))).select(*names)
    larger = rows.filter("5 * top >= 4 * n").withColumn("top", F.least("n", "top"))
    return smaller, larger.withColumn("cell", F.expr(f"IF(heavy, {low} * 65536 + {high}, 0L)")).select(*names)


def _meetings(spread: DataFrame) -> DataFrame:
    """(token, cell, comp): how many postings a component has there in either role, and between which sizes."""
    smaller, larger = _roles(spread)
    both = smaller.withColumn("first", F.lit(True)).unionAll(larger.withColumn("first", F.lit(False)))
    sums = [a for i, role in ((1, F.col("first")), (2, ~F.col("first"))) for a in (F.count_if(role).alias(f"k{i}"), F.min(F.when(role, F.col("n"))).alias(f"low{i}"), F.max(F.when(role, F.col("top"))).alias(f"high{i}"))]
    return staged(both.groupBy("token", "cell", "comp").agg(*sums))


def _cross_pairs(spread: DataFrame, meetings: DataFrame) -> DataFrame:
    """The pairs of sets of different components that may be similar, by the first shingle they share; components are
    paired first, then their sets. Of these, the pairs whose prefixes share as much as they have to."""
    keys = ["token", "cell"]
    one, two = (meetings.filter(f"k{i} > 0").select(*keys, F.col("comp").alias(f"comp{i}"), f"low{i}", f"high{i}") for i in (1, 2))
    groups = one.join(two, keys).filter("comp1 <> comp2 AND low1 <= high2 AND low2 <= high1").drop("low1", "high1")
    first, second = (r.toDF(*keys, *[f"{c}{i}" for c in ("comp", "node", "n", "top")]) for i, r in enumerate(_roles(spread), 1))
    sets = groups.join(first, [*keys, "comp1"]).filter("n1 <= high2 AND low2 <= top1").drop("low2", "high2")
    both = sets.join(second, [*keys, "comp2"]).filter("n1 <= top2 AND n2 <= top1 AND (n1 < n2 OR node1 < node2)")
    pairs = both.select("node1", "node2", "n1", "n2").distinct()
    prefixes = spread.groupBy("node").agg(F.collect_list("token").alias("prefix"), F.max(F.expr("at & 15")).alias("m"))
    sides = [prefixes.toDF(f"node{i}", f"prefix{i}", f"m{i}") for i in (1, 2)]
    shared = F.size(F.array_intersect("prefix1", "prefix2"))
    found = pairs.join(sides[0], "node1").join(sides[1], "node2").withColumn("shared", shared).filter("shared >= LEAST(m1, m2)")
    # up to where one of the prefixes ends they share what was counted; behind it that set has need - m shingles
    behind = "GREATEST((4 * n1 + 4) div 5 - m1, (4 * n2 + 4) div 5 - m2)"
    return found.filter(f"9 * (shared + {behind}) >= 4 * (n1 + n2)").select("node1", "node2")


def _work(meetings: DataFrame) -> tuple[float, float]:
    """Postings that can be a pair's first common shingle, and pairs across components that meet under one."""
    sums = [F.sum(F.expr(e).cast("double")).alias(c) for e, c in (("k1", "k1"), ("k2", "k2"), ("k1 * k2", "same"))]
    row = meetings.groupBy("token", "cell").agg(*sums).agg(F.sum(F.expr("k1 + k2")), F.sum(F.expr("k1 * k2 - same"))).first()
    return row[0] or 0.0, row[1] or 0.0


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, on_links: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of `docs`; `on_links` gets the verified links between sets."""
    sets = _sets(docs, id_col, text_col, size)
    postings = _postings(docs, text_col, size, _sketch(sets))

    def linked(pairs: DataFrame) -> DataFrame:
        candidates = staged(pairs)
        nodes = candidates.select(F.col("node1").alias("node")).distinct().union(candidates.select("node2").distinct()).distinct()
        contents = _shingle_sets(docs, id_col, text_col, size, sets, nodes)
        found = staged(_verified(candidates, contents))
        discard(contents)
        if on_links:
            on_links(found)
        return found

    links = linked(_best_hub(_matching(_hub_pairs(postings.withColumn("comp", F.col("node")), 0))))
    turn, before = 1, float("inf")
    while True:
        comps = components(links)
        known = _spread(postings, comps)
        meetings = _meetings(known)
        left, across = _work(meetings)
        if across <= MOST_PAIRS * left or across > 0.8 * before:
            break
        links = links.unionAll(linked(_best_hub(_matching(_hub_pairs(known, turn)))))
        turn, before = turn + 1, across
        discard(known)
        discard(meetings)
    rest = linked(_cross_pairs(known, meetings))
    discard(known)
    discard(meetings)
    if not rest.isEmpty():
        comps = components(links.unionAll(rest))
    rows = sets.filter("chunk is null")
    joined = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    joined = staged(joined.select("id", "n", "comp"))
    least = joined.filter("comp is not null").groupBy("comp").agg(F.min("id").alias("_least"))
    out = joined.join(least, "comp", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("_least")).alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id. Documents without words stay; of equal rows
    with the same id, one stays; rows without an id stay, equal texts among them once."""
    classes = jaccard_components(docs, id_col, text_col)
    ids = classes.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    known = docs.filter(F.col(id_col).isNotNull()).join(ids, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return known.unionByName(docs.filter(F.col(id_col).isNull()).dropDuplicates([text_col])).select(docs.columns)
