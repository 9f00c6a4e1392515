"""Splitting quadratic work into bounded cells.

A group of n members is cut into k = ceil(n / tile) hashed tiles. Every member is sent to the k cells
its tile takes part in, so a cell never holds more than about two tiles of members and a hot group is
spread over k(k+1)/2 tasks. Each unordered pair meets in exactly one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_cells(tile: Column, k: Column) -> Column:
    """The cells (i, j), i <= j, of one tile as an array of structs."""
    return F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda j: F.struct(F.least(tile, j).alias("i"), F.greatest(tile, j).alias("j")),
    )


def with_cells(df: DataFrame, keys: list[str], member: str, tile: int) -> DataFrame:
    """Adds `_tile` and one row per `_cell`. Only groups above `tile` members are looked up, and there
    are at most rows/tile of those, so the join stays small and ordinary groups are not replicated."""
    hot = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > tile)
        .select(*keys, F.ceil(F.col("_n") / tile).cast("int").alias("_k"))
    )
    k = F.coalesce("_k", F.lit(1))
    return (
        df.join(hot, keys, "left")
        .withColumn("_tile", F.pmod(F.xxhash64(member), k).cast("int"))
        .withColumn("_cell", F.explode(tile_cells(F.col("_tile"), k)))
        .drop("_k")
    )


def member_pairs(df: DataFrame, keys: list[str], member: str, a: str = "a", b: str = "b", tile: int = 4096) -> DataFrame:
    """All pairs of distinct members of a group, larger member first; one row per group and pair."""
    cells = with_cells(df.select(*keys, member).distinct(), keys, member, tile)
    left = cells.withColumnsRenamed({member: a, "_tile": "_ta"})
    right = cells.withColumnsRenamed({member: b, "_tile": "_tb"})
    once = (F.col("_cell.i") == F.col("_cell.j")) | (F.col("_ta") != F.col("_tb"))
    return left.join(right, [*keys, "_cell"]).filter((F.col(a) > F.col(b)) & once).select(*keys, a, b)


def block_cells(df: DataFrame, member: str, rows: int, block: int) -> DataFrame:
    """Cells for an all-pairs kernel over one universe of `rows` members, `block` members per tile."""
    k = max(1, -(-rows // block))
    return df.withColumn("_tile", F.pmod(F.xxhash64(member), F.lit(k)).cast("int")).withColumn(
        "_cell", F.explode(tile_cells(F.col("_tile"), F.lit(k)))
    )


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], left_member: str, right_member: str, tile: int = 4096) -> DataFrame:
    """The inner join on `keys`, with keys of many rows cut into cells on both sides.

    A key with m and n rows makes m times n; where a side has more than `tile` rows they are hashed into ceil(m / tile) and
    ceil(n / tile) tiles, and a cell holds one tile of either side. Only heavy keys are looked up and only their rows are
    sent to several cells, as many as the other side has tiles; every pair of rows meets in exactly one."""
    counts = [df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((left, "_m"), (right, "_n"))]
    parts = [F.greatest(F.lit(1), F.ceil(F.col(c) / tile)).cast("int") for c in ("_m", "_n")]
    heavy = counts[0].join(counts[1], keys).filter((F.col("_m") > tile) | (F.col("_n") > tile)).select(*keys, parts[0].alias("_i"), parts[1].alias("_j"))

    def cells(df: DataFrame, member: str, own: str, other: str) -> DataFrame:
        k, many = (F.coalesce(c, F.lit(1)) for c in (own, other))
        at = F.pmod(F.xxhash64(member), k).cast("int")
        spread = df.join(heavy, keys, "left").withColumns({"_at": at, "_to": F.explode(F.sequence(F.lit(0), many - 1))})
        return spread.withColumnsRenamed({"_at": f"_c{own}", "_to": f"_c{other}"}).drop("_i", "_j")

    return cells(left, left_member, "_i", "_j").join(cells(right, right_member, "_j", "_i"), [*keys, "_c_i", "_c_j"]).drop("_c_i", "_c_j")
