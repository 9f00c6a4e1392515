"""Relational building blocks on pair tables: identifier joins, transfer, set operations, counts, top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave.functions.columns import canonical_directed, canonical_pair, drop_self


# --- identifiers -----------------------------------------------------------------------------


def _key(col: str | Column, lower: bool) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.lower(col) if lower else col


def map_ids(
    df: DataFrame,
    mapping: DataFrame,
    cols: dict[str, str],
    lower: bool = False,
    strip_prefix: bool = False,
) -> DataFrame:
    """Replace identifier columns by protein ids; one row per match, unmapped rows fall out.

    `mapping` has (mapped_id, protein_id); `cols` names source column -> id column. With
    `strip_prefix` an identifier also matches without the part before `:`. The optimizer broadcasts
    the mapping when its measured size allows, otherwise both sides are shuffled on the identifier.
    """
    ids = mapping.select(_key("mapped_id", lower).alias("_id"), "protein_id").distinct()
    for source, target in cols.items():
        keyed = df.withColumn("_id", _key(source, lower))
        if strip_prefix:
            raw = F.col("_id")
            variants = F.array_distinct(F.array(raw, F.regexp_replace(raw, "^[^:]*:", "")))
            keyed = keyed.withColumn("_id", F.explode(variants))
        df = keyed.join(ids, "_id").drop("_id", source).withColumnRenamed("protein_id", target)
        if strip_prefix:
            df = df.distinct()
    return df


def unmapped_ids(df: DataFrame, mapping: DataFrame, col: str, lower: bool = False) -> DataFrame:
    """Identifiers that no protein carries."""
    ids = df.select(_key(col, lower).alias("identifier")).distinct()
    known = mapping.select(_key("mapped_id", lower).alias("identifier"))
    return ids.join(known, "identifier", "left_anti")


def attach_accessions(df: DataFrame, protein: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Add the accession of each id column, keeping links whose protein is unknown."""
    for id_col, name in cols.items():
        names = protein.select(F.col("protein_id").alias(id_col), F.col("uniprot_id").alias(name))
        df = df.join(names, id_col, "left")
    return df


# --- orthologs -------------------------------------------------------------------------------


def ortholog_view(ortholog: DataFrame, src: str, dst: str) -> DataFrame:
    """(src_id, dst_id) between two species, whichever side the stored rows put them on."""
    forward = ortholog.filter((F.col("species_a") == src) & (F.col("species_b") == dst)).select(
        F.col("protein_a").alias("src_id"), F.col("protein_b").alias("dst_id")
    )
    backward = ortholog.filter((F.col("species_a") == dst) & (F.col("species_b") == src)).select(
        F.col("protein_b").alias("src_id"), F.col("protein_a").alias("dst_id")
    )
    return forward.unionByName(backward)


def symmetric_orthologs(ortholog: DataFrame) -> DataFrame:
    """Every stored pair in both directions: (src_tax, src_id, dst_tax, dst_id)."""
    there = ortholog.select(
        F.col("species_a").alias("src_tax"), F.col("protein_a").alias("src_id"),
        F.col("species_b").alias("dst_tax"), F.col("protein_b").alias("dst_id"),
    )
    back = ortholog.select(
        F.col("species_b").alias("src_tax"), F.col("protein_b").alias("src_id"),
        F.col("species_a").alias("dst_tax"), F.col("protein_a").alias("dst_id"),
    )
    return there.unionByName(back)


def transfer_links(links: DataFrame, view: DataFrame, a: str = "a", b: str = "b", direction: str | None = None) -> DataFrame:
    """Carry links to another species over both end points, restore canonical order, drop repeats."""
    left = view.select(F.col("src_id").alias(a), F.col("dst_id").alias("_a"))
    right = view.select(F.col("src_id").alias(b), F.col("dst_id").alias("_b"))
    moved = links.join(left, a).join(right, b).drop(a, b).withColumnsRenamed({"_a": a, "_b": b})
    moved = canonical_directed(moved, a, b, direction) if direction else canonical_pair(moved, a, b)
    return drop_self(moved, a, b).distinct()


def mean_links(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Links that several ortholog pairs arrive at are averaged."""
    return df.groupBy(*keys).agg(F.avg(score).alias(score))


def ortholog_pair(pairs: DataFrame, view: DataFrame) -> DataFrame:
    """Ortholog counterparts of given pairs: (a, b) with every (other_a, other_b)."""
    left = view.select(F.col("src_id").alias("a"), F.col("dst_id").alias("other_a"))
    right = view.select(F.col("src_id").alias("b"), F.col("dst_id").alias("other_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "other_a", "other_b")


def transfer_network(net: DataFrame, names: DataFrame, order: list[Column]) -> DataFrame:
    """A whole network renamed to another species' proteins, best link kept per resulting pair."""
    moved = transfer_links(net, names)
    return keep_best(moved, ["a", "b"], order)


# --- set operations --------------------------------------------------------------------------


def exclude_pairs(df: DataFrame, other: DataFrame, keys: list[str] = ["a", "b"]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_anti")


def keep_pairs(df: DataFrame, other: DataFrame, keys: list[str] = ["a", "b"]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_semi")


def union_links(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)


def merge_datasets(long: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """The wide view of long scores: one column per dataset, NULL where a pair has no evidence."""
    return long.groupBy(*keys).pivot(name, names).agg(F.first(value))


def restrict_members(links: DataFrame, members: DataFrame, keys: list[str] = []) -> DataFrame:
    """Links with both ends in the member list (a pathway or tissue); `keys` join further columns."""
    left = members.select(*keys, F.col("member").alias("a"))
    right = members.select(*keys, F.col("member").alias("b"))
    return links.join(left, [*keys, "a"], "left_semi").join(right, [*keys, "b"], "left_semi")


def bipartite_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Members of one side of a group with members of the other side."""
    return left.join(right, keys)


def interval_overlap(peaks: DataFrame, genes: DataFrame, bin_size: int) -> DataFrame:
    """Peaks that overlap genes: (chrom, start_p, end_p, ...) with (chrom, start_g, end_g, ...), half-open.

    Both sides are expanded to the fixed-width bins they touch and joined on (chrom, bin). A pair that
    shares several bins is reported only from the first of them, so no later distinct is needed.
    """

    def binned(df: DataFrame, start: str, end: str) -> DataFrame:
        first, last = F.floor(F.col(start) / bin_size), F.floor((F.col(end) - 1) / bin_size)
        return df.filter(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(first, last)))

    joined = binned(peaks, "start_p", "end_p").join(binned(genes, "start_g", "end_g"), ["chrom", "_bin"])
    return joined.filter(
        (F.col("start_p") < F.col("end_g"))
        & (F.col("start_g") < F.col("end_p"))
        & (F.col("_bin") == F.floor(F.greatest("start_p", "start_g") / bin_size))
    ).drop("_bin")


# --- best rows and top-k ---------------------------------------------------------------------


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the largest by `order`. An aggregate, not a window: it is combined on the map
    side, so a key with very many rows never arrives whole at one task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*")


def keep_max_ties(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """All rows that reach the maximum of their key."""
    top = df.groupBy(*keys).agg(F.max(score).alias(score))
    return df.join(top, [*keys, score], "left_semi")


def top_links(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_key(df: DataFrame, keys: list[str], k: int | Column, order: list[Column], parts: int = 1) -> DataFrame:
    """The k best rows of each key; Spark prunes to k per key before the shuffle (window group limit). With `parts`
    the rows of a key are first cut into so many hashed parts, of which only the k best go on, so that a key with very
    many rows is not sorted by one task; `order` must then be a total order."""
    if parts > 1:
        cut = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
        df = top_per_key(cut, [*keys, "_part"], k, order).drop("_part")
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def top_links_per_node(links: DataFrame, k: int, score: str = "ppv") -> DataFrame:
    both = symmetric(links)
    return top_per_key(both, ["node"], k, [F.col(score).desc(), F.col("other")])


def min_group_size(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of groups with at least n rows."""
    big = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= n)
    return df.join(big.select(*keys), keys, "left_semi")


def cap_group_size(df: DataFrame, keys: list[str], below: int) -> DataFrame:
    """Rows of groups with fewer than `below` rows."""
    small = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") < below)
    return df.join(small.select(*keys), keys, "left_semi")


# --- counts ----------------------------------------------------------------------------------


def symmetric(links: DataFrame, node: str = "node", other: str = "other") -> DataFrame:
    """Each link seen from both ends. One pass over the links, not a union of two scans."""
    rest = [c for c in links.columns if c not in ("a", "b")]
    ends = F.array(
        F.struct(F.col("a").alias(node), F.col("b").alias(other)), F.struct(F.col("b").alias(node), F.col("a").alias(other))
    )
    return links.select(*rest, F.explode(ends).alias("_end")).select(*rest, f"_end.{node}", f"_end.{other}")


def degree(links: DataFrame, keys: list[str] = []) -> DataFrame:
    """How often a protein occurs at either end of the links."""
    ends = links.select(*keys, F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy(*keys, "node").agg(F.count("*").alias("degree"))


def node_stats(links: DataFrame) -> DataFrame:
    """Degree and sorted neighbour list per node of a (query-sized) subnetwork."""
    keys = ["query_id"] if "query_id" in links.columns else []
    return symmetric(links.select(*keys, "a", "b")).groupBy(*keys, "node").agg(
        F.count("*").alias("degree"), F.array_sort(F.collect_set("other")).alias("partners")
    )


def score_range(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(score).alias("score_min"), F.max(score).alias("score_max"))


def indegree(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per query: for every node of the links, all its links and those that lead to a seed."""
    both = symmetric(links)
    marked = both.join(
        seeds.select("query_id", F.col("gene").alias("other"), F.lit(True).alias("_seed")), ["query_id", "other"], "left"
    )
    return marked.groupBy("query_id", "node").agg(
        F.count("*").alias("degree"), F.count_if(F.col("_seed").isNotNull()).alias("indegree")
    )
