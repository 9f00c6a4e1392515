"""Order-dependent results (numbering, ranks, samples, quantiles) that never put an unbounded group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave.functions.columns import half_even
from linkweave.session import checkpointed

SAMPLE_SLOTS = 65_536


def _on(keys: list[str], left: str, right: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """`row_number()` per key. Rows are range-partitioned over (keys, order), numbered per range, and shifted by
    the counts of the ranges before, so no task holds a whole group. `order` must be a total order for a repeatable result."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(
        df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    )
    local = ranged.withColumn("_local", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)))
    # At most one row per key and range, so this window is as small as the number of ranges per key.
    before = (
        ranged.groupBy(*keys, "_range")
        .count()
        .withColumn(
            "_before",
            F.sum("count").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)),
        )
    )
    return (
        local.alias("l")
        .join(before.alias("r"), _on([*keys, "_range"], "l", "r"))
        .select("l.*", (F.col("l._local") + F.coalesce("r._before", F.lit(0))).cast("int").alias(name))
        .drop("_range", "_local")
    )


def ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows in range partitions over (keys, order), each row with its `_range`, for `scan`."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()))


def scan(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, how: str = "sum", backwards: bool = False) -> DataFrame:
    """Running `sum` or `min` of `value` per key up to and with each row of a `ranged` table (from it to the end if
    `backwards`), or the `last` value that is not null. A window runs inside one range of one key; what other ranges
    contribute is one row per key and range."""
    agg = {"sum": F.sum, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    first, last = (0, W.unboundedFollowing) if backwards else (W.unboundedPreceding, 0)
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(first, last)
    outside = W.partitionBy(*keys).orderBy("_range").rowsBetween(*((1, W.unboundedFollowing) if backwards else (W.unboundedPreceding, -1)))
    local = rows.withColumn("_local", agg(value).over(inside))
    whole_range = F.max_by(value, F.when(value.isNotNull(), F.struct(*order))) if how == "last" else agg(value)
    carried = rows.groupBy(*keys, "_range").agg(whole_range.alias("_all")).withColumn("_carried", agg("_all").over(outside))
    both = local.alias("l").join(carried.alias("r"), _on([*keys, "_range"], "l", "r"))
    here, there = F.col("l._local"), F.col("r._carried")
    whole = {"sum": here + F.coalesce(there, F.lit(0)), "min": F.least(here, there), "last": F.coalesce(here, there)}[how]
    return both.select("l.*", whole.alias(name)).drop("_local")


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per distinct value of each key: how often it occurs and its average rank.
    Counting first means a value shared by many rows is ranked once; the distinct values of a key are spread over ranges."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = [F.col(value)]
    upto = scan(ranged(counted, keys, order), keys, order, F.col("n"), "_upto")
    return upto.withColumn("avg_rank", F.col("_upto") - (F.col("n") - 1) / 2.0).drop("_upto", "_range")


def average_rank(df: DataFrame, keys: list[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Rank with ties averaged (Spearman)."""
    ranks = value_ranks(df, keys, value).drop("n").withColumnRenamed("avg_rank", name)
    return df.join(ranks, [*keys, value])


def quantile_bounds(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, weight: Column | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per key, from counted distinct values (`weight` if already counted), which are
    spread over ranges."""
    counted = df.groupBy(*keys, value).agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"))
    order = [F.col(value)]
    rows = ranged(counted, keys, order)
    totals = rows.groupBy(*keys).agg(F.sum("n").alias("_total"))
    steps = scan(rows, keys, order, F.col("n"), "_upto").alias("l").join(totals.alias("r"), _on(keys, "l", "r")).select("l.*", "_total")

    def at(p: float) -> Column:
        pos = F.lit(p) * (F.col("_total") - 1)
        # smallest value whose last position reaches the wanted one
        low = F.min(F.when(F.col("_upto") - 1 >= F.floor(pos), F.col(value)))
        high = F.min(F.when(F.col("_upto") - 1 >= F.ceil(pos), F.col(value)))
        part = F.first(pos - F.floor(pos))
        return low + (high - low) * part

    return steps.groupBy(*keys).agg(at(lo).alias("q_lo"), at(hi).alias("q_hi"))


def sample_n(df: DataFrame, n: int | Column, seed: int, keys: list[str], identity: list[str]) -> DataFrame:
    """Up to `n` rows per key without replacement, repeatable on any partitioning.

    Rows are ordered by a seeded hash of `identity`. A histogram of the hash's leading bits finds the
    slot in which the n-th row falls; every earlier slot is kept whole and only that one slot is sorted.
    """
    n = F.lit(n) if isinstance(n, int) else n
    h = F.xxhash64(*identity, F.lit(seed))
    slotted = df.withColumns({"_hash": h, "_slot": F.shiftrightunsigned(h, 48).cast("int")})
    w = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    slots = (
        slotted.groupBy(*keys, "_slot")
        .agg(F.count("*").alias("_in_slot"))
        .withColumn("_earlier", F.coalesce(F.sum("_in_slot").over(w), F.lit(0)))
    )
    placed = slotted.join(slots, [*keys, "_slot"]).filter(F.col("_earlier") < n)
    whole = placed.filter(F.col("_earlier") + F.col("_in_slot") <= n)
    cut = (
        placed.filter(F.col("_earlier") + F.col("_in_slot") > n)
        .withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_slot").orderBy("_hash", *identity)))
        .filter(F.col("_rn") + F.col("_earlier") <= n)
        .drop("_rn")
    )
    return whole.unionByName(cut).select(*df.columns)


def sample_fraction(df: DataFrame, fraction: float, seed: int, identity: list[str]) -> DataFrame:
    """Rows whose seeded hash falls in the first `fraction` of the hash range; independent of partitioning."""
    share = F.shiftrightunsigned(F.xxhash64(*identity, F.lit(seed)), 11) / F.lit(float(2**53))
    return df.filter(share < fraction)


def top_fraction(df: DataFrame, keys: list[str], value: str, fraction: float, tie: list[str]) -> DataFrame:
    """The round(n * fraction) highest rows of each key."""
    sizes = df.groupBy(*keys).agg(half_even(F.count("*") * F.lit(fraction), 0).cast("int").alias("_keep"))
    ranked = numbered(df, keys, [F.col(value).desc(), *[F.col(t) for t in tie]], "_rn")
    return ranked.join(sizes, keys).filter(F.col("_rn") <= F.col("_keep")).select(*df.columns)


def degree_bins(nodes: DataFrame, size: int = 150, node: str = "node", degree: str = "degree") -> DataFrame:
    """Bins of `size` nodes after sorting by (degree, node): numbering is done inside each degree and
    shifted by the counts of smaller degrees (distinct degrees are at most ~2*sqrt(links))."""
    inside = numbered(nodes, [degree], [F.col(node)], "_rn")
    w = W.orderBy(degree).rowsBetween(W.unboundedPreceding, -1)
    before = nodes.groupBy(degree).agg(F.count("*").alias("_n"))
    before = before.select(degree, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    position = F.col("_before") + F.col("_rn") - 1
    return inside.join(before, degree).select(
        *nodes.columns, (F.floor(position / size) + 1).cast("int").alias("bin")
    )


def dense_ids(df: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """Consecutive ids of distinct names, in order of the names."""
    ids = numbered(df.select(name_col).distinct(), [], [F.col(name_col)], id_col)
    return df.join(ids, name_col)


def complement_cdf(df: DataFrame, value: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Share of rows in or above each histogram bin."""
    counts = histogram(df, value, bins, lo, hi)
    w = W.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)
    total = W.partitionBy()
    return counts.select("bin", "n", (F.sum("n").over(w) / F.sum("n").over(total)).alias("share"))


def histogram(df: DataFrame, value: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Counts of equal-width bins 1..bins over [lo, hi]; the upper bound belongs to the last bin."""
    slot = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)) + 1, F.lit(bins)).cast("int")
    return df.filter(F.col(value).between(lo, hi)).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
