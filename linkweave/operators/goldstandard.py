"""Gold standards: pairs known to be functionally coupled, and the negatives they are tested against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.columns import canonical_directed, canonical_pair, drop_self
from linkweave.functions.ordered import sample_n
from linkweave.operators.filters import ppi_rows, ppi_supported
from linkweave.operators.pairs import bipartite_pairs, cap_group_size, exclude_pairs, keep_pairs, map_ids, transfer_links, union_links
from linkweave.operators.tiles import member_pairs
from linkweave.session import small_side


def _mapped_pairs(named: DataFrame, mapping: DataFrame, **how: bool) -> DataFrame:
    linked = map_ids(named, mapping, {"name_a": "a", "name_b": "b"}, **how)
    return drop_self(canonical_pair(linked)).distinct()


def gs_groups(members: DataFrame, mapping: DataFrame, keys: list[str], below: int | None = None) -> DataFrame:
    """Pairs of members of one group (complex, operon, pathway). `below` caps the group size of a source.
    Members are mapped before pairing, so the join is on ids and pairs are made once."""
    if below is not None:
        members = cap_group_size(members.distinct(), keys, below)
    ids = map_ids(members.select(*keys, "member").distinct(), mapping, {"member": "protein_id"})
    return member_pairs(ids, keys, "protein_id").select("a", "b").distinct()


def gs_complex(sources: list[tuple[DataFrame, int | None]], mapping: DataFrame) -> DataFrame:
    """Union over complex sources, each (complex, member) with its own size cap."""
    return union_links([gs_groups(df, mapping, ["complex"], cap) for df, cap in sources]).distinct()


def gs_operon(operons: DataFrame, mapping: DataFrame) -> DataFrame:
    """Operon members (operon, member); nematode locus names lose their prefix."""
    clean = operons.withColumn("member", F.regexp_replace("member", "^CELE_", ""))
    return gs_groups(clean, mapping, ["operon"])


def pathway_relation_pairs(entries: DataFrame, relations: DataFrame) -> DataFrame:
    """Gene pairs of the relations of a pathway: (pathway_id, name_a, name_b).
    `entries` is (pathway_id, entry_id, gene), groups already resolved to the genes of their components."""
    left = entries.select("pathway_id", F.col("entry_id").alias("entry1"), F.col("gene").alias("name_a"))
    right = entries.select("pathway_id", F.col("entry_id").alias("entry2"), F.col("gene").alias("name_b"))
    wanted = relations.filter(F.col("type").isin("ECrel", "PPrel", "GErel")).select("pathway_id", "entry1", "entry2")
    met = bipartite_pairs(bipartite_pairs(wanted, left, ["pathway_id", "entry1"]), right, ["pathway_id", "entry2"])
    return met.filter("name_a <> name_b").select("pathway_id", "name_a", "name_b")


def gs_pathway(entries: DataFrame, relations: DataFrame, mapping: DataFrame, direct: bool = True) -> DataFrame:
    """Relation pairs of all pathways or, without `direct`, all pairs of each pathway."""
    if direct:
        named = pathway_relation_pairs(entries, relations)
        return _mapped_pairs(named.select("name_a", "name_b").distinct(), mapping, strip_prefix=True)
    genes = entries.select("pathway_id", "gene").distinct()
    ids = map_ids(genes, mapping, {"gene": "protein_id"}, strip_prefix=True)
    return member_pairs(ids, ["pathway_id"], "protein_id").select("a", "b").distinct()


def gs_ppi(mitab: DataFrame, mapping: DataFrame, other_gs: DataFrame) -> DataFrame:
    """Physical interactions seen in several papers or known to another gold standard. The highest
    publication count of a pair is what counts."""
    pair = F.struct(F.greatest("protein_a", "protein_b").alias("name_a"), F.least("protein_a", "protein_b").alias("name_b"))
    named = ppi_rows(mitab).select(pair.alias("p"), "publications").groupBy("p.name_a", "p.name_b").agg(F.max("publications").alias("publications"))
    linked = drop_self(canonical_pair(map_ids(named, mapping, {"name_a": "a", "name_b": "b"}))).distinct()
    return ppi_supported(linked, other_gs)


def gs_regulatory(sources: list[DataFrame], mapping: DataFrame) -> DataFrame:
    """Directed links from regulatory sources (name_a, name_b, direction), names in any case."""
    named = union_links(sources).distinct()
    linked = map_ids(named, mapping, {"name_a": "a", "name_b": "b"}, lower=True)
    return canonical_directed(drop_self(linked)).dropDuplicates(["a", "b", "direction"])


def gs_from_orthologs(gs: DataFrame, view: DataFrame) -> DataFrame:
    """Positives of another species carried over, without direction."""
    return transfer_links(gs.select("a", "b"), view)


def gs_matrix(gs_links: DataFrame, types: list[str], min_n: int = 100) -> DataFrame:
    """One row per pair with a direction code per gold standard (0 none); gold standards with fewer than
    `min_n` links are left out. Opposite directions of one pair stay two rows."""
    sizes = gs_links.groupBy("gs").agg(F.count("*").alias("_n")).filter((F.col("_n") >= min_n) & F.col("gs").isin(types))
    # at most one row per gold-standard type
    kept = gs_links.join(F.broadcast(sizes.select("gs")), "gs", "left_semi")
    # a directed row keeps its own line, undirected codes are repeated on each of them
    directed = kept.filter(F.col("direction") > 1).select("a", "b", F.col("gs").alias("_gs"), F.col("direction").alias("_d"))
    plain = kept.filter(F.col("direction") <= 1).groupBy("a", "b").pivot("gs", types).agg(F.max("direction"))
    joined = plain.join(directed, ["a", "b"], "full_outer")
    cols = [F.coalesce(F.when(F.col("_gs") == t, F.col("_d")), F.col(t), F.lit(0)).cast("int").alias(t) for t in types]
    return joined.select("a", "b", *cols)


# --- negatives -------------------------------------------------------------------------------


def positives(links: DataFrame, gs: DataFrame) -> DataFrame:
    """Gold-standard pairs that a dataset scores: (evidence_id, gs, a, b, score). The direction must agree
    where both sides have one."""
    both = links.alias("l").join(gs.alias("g"), (F.col("l.a") == F.col("g.a")) & (F.col("l.b") == F.col("g.b")))
    undirected = (F.col("l.direction") < 2) | (F.col("g.direction") < 2)
    return both.filter(undirected | (F.col("l.direction") == F.col("g.direction"))).select("l.evidence_id", "g.gs", "l.a", "l.b", "l.score")


def negatives_llr(links: DataFrame, gs_types: list[str], own: DataFrame, ortholog: DataFrame, max_n: int, seed: int) -> DataFrame:
    """Sampled pairs of each dataset that no gold standard of the type knows, own or carried over."""
    over = small_side(links.groupBy("evidence_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > max_n).select("evidence_id"))
    if over.isEmpty():
        sampled = links
    else:
        large = links.join(over, "evidence_id", "left_semi")
        rest = links.join(over, "evidence_id", "left_anti")
        sampled = rest.unionByName(sample_n(large, max_n, seed, ["evidence_id"], ["a", "b", "direction"]))
    # the types that know a pair travel as one short list, so links meet them once and not once per type
    known = own.select("gs", "a", "b").unionByName(ortholog.select("gs", "a", "b"))
    listed = known.groupBy("a", "b").agg(F.collect_set("gs").alias("_known"))
    every = F.array(*[F.lit(g) for g in gs_types])
    free = F.when(F.col("_known").isNull(), every).otherwise(F.array_except(every, "_known"))
    met = sampled.select("evidence_id", "a", "b", "score").join(listed, ["a", "b"], "left")
    return met.select("evidence_id", F.explode(free).alias("gs"), "a", "b", "score")


POLICIES = ["reference", "carried_over", "all_species", "all_gold_standards", "no_overfit", "any_gold_standard"]


def split_pos_neg(fbs: DataFrame, own: DataFrame, ortholog: DataFrame, policy: str = "reference") -> tuple[DataFrame, DataFrame]:
    """Positives and negatives for the confidence model, from scored pairs (gs, a, b, fbs).

    `own` and `ortholog` are (gs, a, b): the species' own gold standards and those carried over.
    reference           positives own, negatives outside both
    carried_over        positives own, negatives outside the carried-over ones only
    all_species         positives own or carried over, negatives outside both
    all_gold_standards  as all_species, with every gold standard type counting for each
    no_overfit          as all_gold_standards, minus the positives the type itself was trained on
    any_gold_standard   the set form of all_gold_standards used for a single joint model
    """
    keys = ["gs", "a", "b"]
    both = own.select(*keys).unionByName(ortholog.select(*keys))
    if policy == "reference":
        return keep_pairs(fbs, own, keys), exclude_pairs(fbs, both, keys)
    if policy == "carried_over":
        return keep_pairs(fbs, own, keys), exclude_pairs(fbs, ortholog, keys)
    if policy == "all_species":
        return keep_pairs(fbs, both, keys), exclude_pairs(fbs, both, keys)
    pos, neg = keep_pairs(fbs, both, ["a", "b"]), exclude_pairs(fbs, both, ["a", "b"])
    if policy in ("all_gold_standards", "any_gold_standard"):
        return pos, neg
    if policy == "no_overfit":
        return exclude_pairs(pos, own, keys), neg
    raise ValueError(f"unknown policy {policy}, use one of {POLICIES}")


def random_negatives(ids: DataFrame, n: int, seed: int, known: DataFrame) -> DataFrame:
    """Random id pairs, canonical, distinct, without known positives. Ids are numbered densely, so both
    draws are uniform over the proteins and every row of `range(n)` is drawn where it lives."""
    from linkweave.functions.ordered import numbered

    dense = numbered(ids.select("protein_id").distinct(), [], [F.col("protein_id")], "_i")
    total = dense.count()
    spark = ids.sparkSession
    draw = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(total)) + 1
    drawn = spark.range(n).select(draw(seed).alias("_x"), draw(seed + 1).alias("_y"))
    left, right = dense.select(F.col("_i").alias("_x"), F.col("protein_id").alias("a")), dense.select(F.col("_i").alias("_y"), F.col("protein_id").alias("b"))
    pairs = drawn.join(left, "_x").join(right, "_y").select("a", "b")
    return exclude_pairs(drop_self(canonical_pair(pairs)).distinct(), known)
