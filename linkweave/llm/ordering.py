"""Running numbers and sums in the order of a hash, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CELL = 50_000


def cells_for(rows: int) -> int:
    """A power of two of hash cells, so that a cell holds about ROWS_PER_CELL rows whatever the input."""
    return 1 << max(6, (rows // ROWS_PER_CELL).bit_length())


def hash60(*parts: Column) -> Column:
    """A hash from 0 to 2^60 - 1 of the parts' text, nulls apart from empty texts."""
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def running(df: DataFrame, keys: list[str], order: Column, amount: Column, out: str, cells: int) -> DataFrame:
    """`df` with `out`: the sum of `amount` over the rows of the same keys up to and with this one, in the order of
    `order`, a hash from `hash60` (rows of equal hash come in any order). Keys may be null.

    Hash cells are summed first; a window then runs inside one cell of one key, and another one over the cell sums."""
    tagged = df.withColumn("_order", order).withColumn("_cell", F.shiftright("_order", 60 - (cells - 1).bit_length()))
    tagged = tagged.withColumn("_amount", amount)
    sums = tagged.groupBy(*keys, "_cell").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_cell").alias("_c"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_cell").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_local", F.sum("_amount").over(inside))
    same = F.col("_cell") == F.col("_c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(offsets, same).withColumn(out, F.col("_before") + F.col("_local"))
    return joined.drop("_order", "_cell", "_amount", "_local", "_c", "_before", *[f"_k_{k}" for k in keys])
