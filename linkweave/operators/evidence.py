"""Scores of protein pairs under each kind of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.columns import canonical_directed, canonical_pair, drop_self, half_even
from linkweave.functions.ordered import top_fraction
from linkweave.operators.allpairs import spearman_pairs, strong_spearman_pairs
from linkweave.operators.filters import abs_score_cut, explode_probes, interaction_rows, quality_check
from linkweave.operators.normalise import boxcox_minmax, minmax
from linkweave.operators.pairs import (
    degree,
    exclude_pairs,
    interval_overlap,
    keep_best,
    keep_max_ties,
    map_ids,
    symmetric,
)
from linkweave.operators.tiles import heavy_join, member_pairs, with_cells
from linkweave.session import checkpointed, small_side


def shared_attributes(sets: DataFrame, tile: int = 4096, keep_terms: bool = False) -> DataFrame:
    """Pairs of ids with the number of attributes they share, through the inverted index.
    Attributes above `tile` ids are cut into cells; counts are combined before the shuffle."""
    pairs = member_pairs(sets.select("attr", "id"), ["attr"], "id", tile=tile)
    aggs = [F.count("*").alias("shared")]
    if keep_terms:
        aggs.append(F.array_sort(F.collect_list("attr")).alias("terms"))
    return pairs.groupBy("a", "b").agg(*aggs)


def jaccard_pairs(sets: DataFrame, keep_terms: bool = False, tile: int = 4096) -> DataFrame:
    """Jaccard index of attribute sets (id, attr) for all pairs that share something."""
    sets = sets.select("id", "attr").distinct()
    sizes = sets.groupBy("id").agg(F.count("*").alias("_n"))
    left, right = sizes.withColumnsRenamed({"id": "a", "_n": "_na"}), sizes.withColumnsRenamed({"id": "b", "_n": "_nb"})
    scored = shared_attributes(sets, tile, keep_terms).join(left, "a").join(right, "b")
    score = F.col("shared") / (F.col("_na") + F.col("_nb") - F.col("shared"))
    return scored.withColumn("score", score).drop("_na", "_nb")


def shared_terms(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The attributes behind given pairs, as a sorted list (empty lists are left out).

    Either the attributes of one end go to the pairs, or the pairs of members of every attribute meet the given ones: what makes
    fewer rows, by counts of both."""
    pairs, sets = pairs.select("a", "b"), sets.select("id", "attr").distinct()
    left, right = sets.withColumnRenamed("id", "a"), sets.withColumnRenamed("id", "b")
    held, asked = left.groupBy("a").agg(F.count("*").alias("_n")), pairs.groupBy("a").agg(F.count("*").alias("_m"))
    by_pair = held.join(asked, "a").agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0.0
    members = sets.groupBy("attr").agg(F.count("*").cast("double").alias("_n"))
    by_attr = members.agg(F.sum(F.col("_n") * (F.col("_n") - 1) / 2)).first()[0] or 0.0
    if by_pair <= by_attr:
        both = pairs.join(left, "a").join(right, ["b", "attr"])
    else:
        ends = pairs.withColumns({"_x": F.greatest("a", "b"), "_y": F.least("a", "b")})
        common = member_pairs(sets, ["attr"], "id", "_x", "_y")
        both = common.join(ends.filter("a <> b"), ["_x", "_y"]).select("a", "b", "attr").unionByName(pairs.filter("a = b").join(left, "a"))
    return both.groupBy("a", "b").agg(F.array_sort(F.collect_set("attr")).alias("terms"))


# --- domains ---------------------------------------------------------------------------------


def domain_pairs(ddi: DataFrame, hits: DataFrame) -> DataFrame:
    """Protein pairs behind domain interactions: (a, b, domain_a, domain_b, score), best score per row.
    `ddi` is (domain_a, domain_b, score), `hits` (protein_id, domain) with one row per hit."""
    hits = hits.select("protein_id", "domain").distinct()
    left = hits.select(F.col("protein_id").alias("a"), F.col("domain").alias("domain_a"))
    right = hits.select(F.col("protein_id").alias("b"), F.col("domain").alias("domain_b"))
    # domains of very many proteins are cut into tiles in either join
    once = heavy_join(ddi, left, ["domain_a"], "domain_b", "a")
    met = drop_self(heavy_join(once, right, ["domain_b"], "a", "b"))
    return canonical_pair(met).groupBy("a", "b", "domain_a", "domain_b").agg(F.max("score").alias("score"))


def domain_scores(ddi: DataFrame, hits: DataFrame) -> DataFrame:
    """Mean of score / ln(1 + fA + fB) over the domain pairs of two proteins, times the share of the
    possible domain combinations that interact; metadata lists the domain pairs, strongest first."""
    n_hits = hits.groupBy("protein_id").agg(F.count("*").alias("_n"))
    ends = ddi.select(F.explode(F.array("domain_a", "domain_b")).alias("domain"))
    freq = ends.groupBy("domain").agg(F.count("*").alias("_f"))
    fa, fb = freq.withColumnsRenamed({"domain": "domain_a", "_f": "_fa"}), freq.withColumnsRenamed({"domain": "domain_b", "_f": "_fb"})
    weighted = (
        domain_pairs(ddi, hits)
        .join(fa, "domain_a")
        .join(fb, "domain_b")
        .withColumn("w", F.col("score") * (1 / F.log(1 + F.col("_fa") + F.col("_fb"))))
    )
    listed = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), F.concat_ws("-", "domain_a", "domain_b").alias("d"))))
    grouped = weighted.groupBy("a", "b").agg(F.avg("w").alias("_mean"), F.count("*").alias("_count"), listed.alias("_l"))
    na, nb = n_hits.withColumnsRenamed({"protein_id": "a", "_n": "_na"}), n_hits.withColumnsRenamed({"protein_id": "b", "_n": "_nb"})
    score = F.col("_mean") * (F.col("_count") / (F.col("_na") * F.col("_nb")))
    return grouped.join(na, "a").join(nb, "b").select("a", "b", score.alias("score"), F.col("_l.d").alias("metadata"))


# --- physical interactions -------------------------------------------------------------------


def expand_complexes(rows: DataFrame, tile: int = 4096) -> DataFrame:
    """Complex rows -> member pairs per (complex, paper, method); the method names complex and size."""
    keys = ["protein_a", "pmid", "method"]
    complexes = rows.filter("is_complex").select(*keys, "protein_b").distinct()
    sizes = complexes.groupBy(*keys).agg(F.count("*").alias("_n"))
    pairs = member_pairs(complexes, keys, "protein_b", "x", "y", tile).join(sizes, keys)
    return pairs.select(
        F.col("x").alias("protein_a"),
        F.col("y").alias("protein_b"),
        F.concat_ws("|", "method", "protein_a", "_n").alias("method"),
        "pmid",
    )


def pairwise_rows(rows: DataFrame) -> DataFrame:
    """Cleaned interaction rows with complexes expanded: (protein_a, protein_b, method, pmid)."""
    plain = rows.filter(~F.col("is_complex")).select("protein_a", "protein_b", "method", "pmid")
    return plain.unionByName(expand_complexes(rows))


def publication_scores(rows: DataFrame) -> DataFrame:
    """Mean over the evidence rows of a pair of 1/ln(1 + pairs in the paper), divided by the log of the
    partners' joint frequency. `rows` is (a, b, method, pmid) with ids; frequencies ignore the method."""
    rows = canonical_pair(drop_self(rows.select("a", "b", "method", "pmid"))).distinct()
    # rows per (paper, pair): further counts are made from this smaller table
    per_paper = rows.groupBy("pmid", "a", "b").agg(F.count("*").alias("_rows"))
    papers = per_paper.groupBy("pmid").agg(F.count("*").alias("_papers"))
    degrees = degree(per_paper)
    scored = per_paper.join(papers, "pmid").groupBy("a", "b").agg(
        (F.sum(F.col("_rows") / F.log(1.0 + F.col("_papers"))) / F.sum("_rows")).alias("_avg"),
        F.array_sort(F.collect_set("pmid")).alias("metadata"),
    )
    da, db = degrees.withColumnsRenamed({"node": "a", "degree": "_da"}), degrees.withColumnsRenamed({"node": "b", "degree": "_db"})
    score = F.col("_avg") / F.log((F.col("_da") + F.col("_db")).cast("double"))
    return scored.join(da, "a").join(db, "b").select("a", "b", score.alias("score"), "metadata")


def host_pathogen_scores(rows: DataFrame, mapping: DataFrame, host: str, rounds: int = 5) -> DataFrame:
    """Publication score of interaction rows between two proteomes; links inside the host are dropped.
    `mapping` is (mapped_id, protein_id, tax_id) over both species."""
    tax = mapping.select("protein_id", "tax_id").distinct()
    linked = map_ids(pairwise_rows(interaction_rows(rows)), mapping, {"protein_a": "a", "protein_b": "b"})
    ta, tb = tax.withColumnsRenamed({"protein_id": "a", "tax_id": "_ta"}), tax.withColumnsRenamed({"protein_id": "b", "tax_id": "_tb"})
    crossing = linked.join(ta, "a").join(tb, "b").filter(~((F.col("_ta") == host) & (F.col("_tb") == host)))
    return boxcox_minmax(publication_scores(crossing), rounds=rounds)


# --- profiles --------------------------------------------------------------------------------


def _correlated(long: DataFrame, min_periods: int, min_abs: float | None, block: int) -> DataFrame:
    return spearman_pairs(long, min_periods, block=block) if min_abs is None else strong_spearman_pairs(long, min_periods, min_abs, block)


def genetic_profile_pairs(rows: DataFrame, min_periods: int = 5, block: int = 1024, min_abs: float | None = None) -> DataFrame:
    """Correlation between the genetic-interaction profiles of two proteins, of all pairs or above `min_abs`. `rows` is (a, b, score)."""
    mean = canonical_pair(rows).groupBy("a", "b").agg(F.avg("score").alias("value"))
    # a self interaction is one cell of the symmetric matrix
    profile = symmetric(mean, "protein_id", "sample").distinct()
    return _correlated(profile, min_periods, min_abs, block)


def coexpression_pairs(
    expr: DataFrame, mapping: DataFrame, homologs: DataFrame, n_samples: int, min_abs: float = 0.1, places: int = 4, block: int = 1024
) -> DataFrame:
    """Expression (gene, sample, value) -> (a, b, score, sign, score_min, score_max): probes split and
    mapped, averaged per protein, quality-checked, correlated, homologs removed, weak scores cut."""
    mapped = map_ids(explode_probes(expr), mapping, {"gene": "protein_id"})
    mean = mapped.groupBy("protein_id", "sample").agg(F.avg("value").alias("value"))
    r = spearman_pairs(quality_check(mean, n_samples), 3, min_abs, block)
    strong = abs_score_cut(exclude_pairs(r, homologs), min_abs)
    lo_hi = strong.agg(F.struct(half_even(F.min("score"), 4).alias("lo"), half_even(F.max("score"), 4).alias("hi"))).scalar()
    ranged = strong.withColumn("_r", lo_hi).withColumns({"score_min": F.col("_r.lo"), "score_max": F.col("_r.hi")}).drop("_r")
    return minmax(ranged, places=places)


def abundance_tissues(abundance: DataFrame) -> DataFrame:
    """Tissues in which a gene is among the top quarter: (tax_id, gene, tissue), for species with more
    than three such tissues. `abundance` is (tax_id, organ, filename, gene, value)."""
    top = top_fraction(abundance, ["tax_id", "filename"], "value", 0.25, ["gene"])
    tissue = F.concat(F.upper(F.substring("organ", 1, 1)), F.lower(F.expr("substring(organ, 2)")))
    links = top.select("tax_id", "gene", tissue.alias("tissue")).distinct()
    per_species = links.select("tax_id", "tissue").distinct().groupBy("tax_id").agg(F.count("*").alias("_n"))
    return links.join(per_species.filter(F.col("_n") > 3).select("tax_id"), "tax_id", "left_semi")


def abundance_pairs(abundance: DataFrame, method: str = "jaccard", block: int = 1024, min_abs: float | None = None) -> DataFrame:
    """Co-abundance by shared top tissues (jaccard) or by abundance profile (spearman, of all pairs or above `min_abs`) of one species."""
    if method == "jaccard":
        return jaccard_pairs(abundance_tissues(abundance).select(F.col("gene").alias("id"), F.col("tissue").alias("attr")))
    mean = abundance.groupBy(F.col("gene").alias("protein_id"), F.col("filename").alias("sample")).agg(F.avg("value").alias("value"))
    return _correlated(mean, 5, min_abs, block)


def presence_profiles(orthologs: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Species in which a protein has an ortholog, its own included: (protein_id, species array).
    With a mapping, the fullest of several identifiers of one protein is kept."""
    own = orthologs.select("protein", F.col("species").alias("s"))
    other = orthologs.select("protein", F.col("other_species").alias("s"))
    profiles = own.unionByName(other).groupBy("protein").agg(F.array_sort(F.collect_set("s")).alias("species"))
    if mapping is None:
        return profiles.withColumnRenamed("protein", "protein_id")
    mapped = map_ids(profiles, mapping, {"protein": "protein_id"})
    return keep_fullest_profile(mapped)


def keep_fullest_profile(profiles: DataFrame) -> DataFrame:
    return keep_best(profiles.select("protein_id", "species"), ["protein_id"], [F.size("species"), F.array_join("species", ",")])


# --- ontology --------------------------------------------------------------------------------

IS_A, PART_OF = 0.8, 0.6


def go_semantic_values(edges: DataFrame, part_of_weight: float = PART_OF, max_rounds: int = 100) -> DataFrame:
    """(term, ancestor, s): the largest product of edge weights over all paths from term up to ancestor.
    `edges` is (child, parent, relation). Each round extends only the values that improved last time."""
    weight = F.when(F.col("relation") == "part_of", F.lit(part_of_weight)).otherwise(F.lit(IS_A))
    weighted = checkpointed(edges.select("child", "parent", weight.alias("w")).groupBy("child", "parent").agg(F.max("w").alias("w")))
    terms = weighted.select(F.explode(F.array("child", "parent")).alias("term")).distinct()
    values = checkpointed(terms.select("term", F.col("term").alias("ancestor"), F.lit(1.0).alias("s")))
    fresh = values
    for _ in range(max_rounds):
        reached = (
            fresh.join(weighted, fresh["ancestor"] == weighted["child"])
            .groupBy("term", F.col("parent").alias("ancestor"))
            .agg(F.max(F.col("s") * F.col("w")).alias("s"))
        )
        known = values.withColumnRenamed("s", "_old")
        fresh = checkpointed(
            reached.join(known, ["term", "ancestor"], "left").filter(F.col("_old").isNull() | (F.col("s") > F.col("_old"))).drop("_old")
        )
        if fresh.isEmpty():
            return values
        values = checkpointed(values.unionByName(fresh).groupBy("term", "ancestor").agg(F.max("s").alias("s")))
    raise ValueError("the ontology has a cycle or is deeper than max_rounds")


def term_similarity(sv: DataFrame, tile: int = 4096) -> DataFrame:
    """Similarity of two terms: the values of their common ancestors over all their values."""
    total = sv.groupBy("term").agg(F.sum("s").alias("_sv"))
    # the root is an ancestor of everything: cells keep it from being one task
    cells = with_cells(sv, ["ancestor"], "term", tile)
    left = cells.select("ancestor", "_cell", F.col("_tile").alias("_ta"), F.col("term").alias("term_a"), F.col("s").alias("_sa"))
    right = cells.select("ancestor", "_cell", F.col("_tile").alias("_tb"), F.col("term").alias("term_b"), F.col("s").alias("_sb"))
    once = (F.col("_cell.i") == F.col("_cell.j")) | (F.col("_ta") != F.col("_tb"))
    shared = (
        left.join(right, ["ancestor", "_cell"])
        .filter((F.col("term_a") > F.col("term_b")) & once)
        .groupBy("term_a", "term_b")
        .agg(F.sum(F.col("_sa") + F.col("_sb")).alias("_common"))
    )
    ta, tb = total.withColumnsRenamed({"term": "term_a", "_sv": "_va"}), total.withColumnsRenamed({"term": "term_b", "_sv": "_vb"})
    sim = F.col("_common") / (F.col("_va") + F.col("_vb"))
    return shared.join(ta, "term_a").join(tb, "term_b").select("term_a", "term_b", sim.alias("sim"))


def close_terms(sv: DataFrame, min_sim: float, tile: int = 4096) -> DataFrame:
    """`term_similarity` of `min_sim` or more, formed from the pairs that can reach it -> (term_a, term_b, sim).

    If the shared values are a share `min_sim` of both terms' values, they are so of one of the two. Its ancestors, rarest
    first, need to be looked up only until what is left of its values is below that share: a term near the root of many
    terms meets no others through the root alone."""
    sv = checkpointed(sv.select("term", "ancestor", "s"))
    below = sv.groupBy("ancestor").agg(F.count("*").alias("_below"))
    listed = sv.join(below, "ancestor").groupBy("term").agg(F.array_sort(F.collect_list(F.struct("_below", "ancestor", "s"))).alias("_l"), F.sum("s").alias("_sv"))
    total = checkpointed(listed)
    at = total.select("term", "_sv", F.posexplode("_l").alias("_at", "_e"), "_l")
    before = F.aggregate(F.slice("_l", F.lit(1), F.col("_at")), F.lit(0.0), lambda acc, e: acc + e["s"])
    # an ancestor is looked up while it and what follows hold enough
    probes = at.filter(F.col("_sv") - before >= min_sim * F.col("_sv") - 1e-9).select(F.col("term").alias("x"), F.col("_e.ancestor").alias("ancestor"))
    met = heavy_join(probes, sv.select(F.col("term").alias("y"), "ancestor"), ["ancestor"], "x", "y", tile).filter("x <> y")
    pairs = met.select(F.greatest("x", "y").alias("term_a"), F.least("x", "y").alias("term_b")).distinct()
    left = sv.select(F.col("term").alias("term_a"), "ancestor", F.col("s").alias("_sa"))
    right = sv.select(F.col("term").alias("term_b"), "ancestor", F.col("s").alias("_sb"))
    shared = pairs.join(left, "term_a").join(right, ["term_b", "ancestor"]).groupBy("term_a", "term_b").agg(F.sum(F.col("_sa") + F.col("_sb")).alias("_common"))
    ta, tb = (total.select(F.col("term").alias(f"term_{c}"), F.col("_sv").alias(f"_v{c}")) for c in ("a", "b"))
    sim = F.col("_common") / (F.col("_va") + F.col("_vb"))
    return shared.join(ta, "term_a").join(tb, "term_b").select("term_a", "term_b", sim.alias("sim")).filter(F.round("sim", 12) >= min_sim)


def roll_up_terms(ann: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Annotations replaced by all ancestors of their term, the term itself included."""
    up = ancestors.select("term", F.col("ancestor").alias("_up"))
    return ann.join(up, "term").drop("term").withColumnRenamed("_up", "term").distinct()


# --- regulatory binding ----------------------------------------------------------------------


def binding_pairs(peaks: DataFrame, genes: DataFrame, files: DataFrame, bin_size: int = 100_000, rounds: int = 5) -> DataFrame:
    """Transcription factor -> gene links from binding peaks: (a, b, direction, score, file).

    Peaks (file, chrom, start_p, end_p, value) are joined with genes (protein_id, chrom, start_g, end_g);
    values are normalised per file, all rows at a pair's best score are kept, factor -> gene is direction 2.
    `files` is (file, tf_id). A file with a single hit has no range and is left out.
    """
    hits = interval_overlap(peaks, genes, bin_size).select("file", F.col("protein_id").alias("b"), F.col("value").alias("score"))
    many = hits.groupBy("file").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("file")
    scored = boxcox_minmax(hits.join(many, "file", "left_semi"), keys=["file"], rounds=rounds)
    linked = scored.join(small_side(files.select("file", F.col("tf_id").alias("a"))), "file").select("a", "b", "score", "file").distinct()
    best = keep_max_ties(linked, ["a", "b"])
    return canonical_directed(drop_self(best).withColumn("direction", F.lit(2)))


def fisher_combine(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Fisher's combined p-value: the chi-square tail with 2n degrees of freedom is a finite sum."""
    half = df.groupBy(*keys).agg((-F.sum(F.log(p))).alias("_h"), F.count("*").cast("int").alias("_n"))
    tail = F.aggregate(
        F.sequence(F.lit(1), F.col("_n")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, i: F.struct((acc["term"] * F.col("_h") / i).alias("term"), (acc["total"] + acc["term"]).alias("total")),
        lambda acc: acc["total"],
    )
    return half.select(*keys, (F.exp(-F.col("_h")) * tail).alias("p"))


def homolog_pairs(hits: DataFrame, mapping: DataFrame, max_evalue: float = 1e-3) -> DataFrame:
    """Protein pairs too similar in sequence for their co-expression to mean anything."""
    near = hits.filter((F.col("query") != F.col("subject")) & (F.col("evalue") <= max_evalue))
    linked = map_ids(near.select("query", "subject").distinct(), mapping, {"query": "a", "subject": "b"})
    return canonical_pair(linked).distinct()
