"""Network queries; every operator carries `query_id`, so one job answers a batch of queries.

`genes` is (query_id, gene). The network is (a, b, ppv, ...) unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave import vocab
from linkweave.functions.columns import genes_of_text, half_even, ppv_of_fbs, scientific
from linkweave.functions.stats import hypergeom_tail, p_adjust
from linkweave.operators.pairs import indegree, keep_pairs, symmetric, top_per_key
from linkweave.operators.tiles import heavy_join
from linkweave.session import checkpointed, small_side

PARTS = 64  # of one query's rows when the best are taken

# --- names -----------------------------------------------------------------------------------


def parse_genes(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, name) from free text."""
    return queries.select("query_id", F.explode(genes_of_text(text)).alias("name"))


def resolve_genes(names: DataFrame, id_mapping: DataFrame) -> DataFrame:
    """Case-insensitive exact look-up: (query_id, name, protein_ids, status found | multi | missing)."""
    ids = id_mapping.select(F.lower("mapped_id").alias("_k"), "protein_id").distinct()
    wanted = names.select("query_id", "name", F.lower("name").alias("_k")).distinct()
    hit = wanted.join(ids, "_k", "left").groupBy("query_id", "name").agg(F.array_sort(F.collect_set("protein_id")).alias("protein_ids"))
    n = F.size("protein_ids")
    return hit.withColumn("status", F.when(n == 0, "missing").when(n == 1, "found").otherwise("multi"))


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of `size` letters; none of a shorter text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def suggest_genes(names: DataFrame, id_mapping: DataFrame, tile: int = 4096) -> DataFrame:
    """Identifiers that contain a typed name, exact ones first: (name, mapped_id, protein_id, rank). Empty names find nothing.

    An index holds the identifiers under their runs of one, two and three letters. A name is looked up under the one of its
    runs of three letters that fewest identifiers have, or as it is if it is shorter; what is found is checked. Runs
    that are in very many identifiers are cut into tiles."""
    typed = names.select("name").distinct().withColumn("_l", F.lower("name")).filter(F.length("_l") > 0)
    own = F.when(F.length("_l") >= 3, _grams(F.col("_l"), 3)).otherwise(F.array("_l"))
    asked = typed.select("name", "_l", F.explode(own).alias("_gram"))
    low = F.lower(F.col("mapped_id"))
    every = F.concat(*[_grams(low, n) for n in (1, 2, 3)])
    held = id_mapping.filter("mapped_id IS NOT NULL").select("mapped_id", "protein_id").distinct().withColumn("_gram", F.explode(every))
    index = checkpointed(held.join(asked.select("_gram").distinct(), "_gram", "left_semi"))
    often = asked.join(index.groupBy("_gram").agg(F.count("*").alias("_n")), "_gram", "left")
    rarest = often.groupBy("name", "_l").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    hit = heavy_join(rarest, index, ["_gram"], "name", "mapped_id", tile).filter(F.contains(F.lower("mapped_id"), F.col("_l")))
    rank = F.when(F.lower("mapped_id") == F.col("_l"), 0).otherwise(1)
    return hit.select("name", "mapped_id", "protein_id", rank.alias("rank")).distinct()


# --- links -----------------------------------------------------------------------------------


def neighbour_links(net: DataFrame, genes: DataFrame) -> DataFrame:
    """Links with at least one end in the query's gene set."""
    ends = net.withColumn("_end", F.explode(F.array("a", "b")))
    hit = ends.join(genes.select("query_id", F.col("gene").alias("_end")).distinct(), "_end")
    # a link with both ends in the set arrives twice
    return hit.select("query_id", *net.columns).dropDuplicates(["query_id", "a", "b"])


def induced_links(net: DataFrame, genes: DataFrame) -> DataFrame:
    """Links with both ends in the query's gene set."""
    g = genes.select("query_id", "gene").distinct()
    left = net.join(g.withColumnRenamed("gene", "a"), "a")
    return left.join(g.withColumnRenamed("gene", "b"), ["query_id", "b"], "left_semi").select("query_id", *net.columns)


def restrict_gold_standard(net: DataFrame, gold_standard: str) -> DataFrame:
    """The network under one gold standard: (a, b, ppv, fbs, direction) from the nested details."""
    one = net.select("a", "b", "direction", F.explode("gs").alias("g")).filter(F.col("g.gs") == gold_standard)
    return one.select("a", "b", F.col("g.ppv").alias("ppv"), F.col("g.fbs").alias("fbs"), "direction")


def rescore(
    net: DataFrame, ppv_model: DataFrame, evidence: list[str] | None = None, species: list[str] | None = None, lo: float = 0.0
) -> DataFrame:
    """Scores from chosen evidence types or species only: (a, b, gs, fbs, ppv). The breakdown is summed
    again and turned into confidence by the stored model."""
    column, chosen = ("llr_ev", evidence) if evidence is not None else ("llr_sp", species)
    details = net.select("a", "b", F.explode("gs").alias("g")).select("a", "b", "g.gs", F.col(f"g.{column}").alias("_m"))
    values = F.map_values(F.map_filter("_m", lambda k, v: k.isin(chosen)))
    fbs = half_even(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), 3)
    model = small_side(ppv_model.select("gs", F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("c").alias("_c")))
    scored = details.withColumn("fbs", fbs).drop("_m").join(model, "gs", "left")
    return scored.select("a", "b", "gs", "fbs", ppv_of_fbs(F.col("fbs"), F.col("_a"), F.col("_b"), F.col("_c"), lo).alias("ppv"))


# --- expansion -------------------------------------------------------------------------------


def _confident(net: DataFrame, threshold: float, score: str) -> DataFrame:
    return net.filter(F.col(score) >= threshold)


def expand_group(
    net: DataFrame, genes: DataFrame, depth: int, k: int, threshold: float = 0.0, score: str = "ppv", common: bool = False
) -> DataFrame:
    """Gene sets after `depth` steps, each adding up to k nodes for the set as a whole: those with the best
    link, or with `common` those with most links (sets of one gene always use the best link). Ties go to
    the smaller id. Members compete too, so k plus the set's size are looked at when ranking by link."""
    edges = _confident(net, threshold, score).select("a", "b", score)
    current = genes.select("query_id", "gene").distinct()
    for _ in range(depth):
        links = neighbour_links(edges, current)
        nodes = symmetric(links.select("query_id", "a", "b", score)).groupBy("query_id", "node").agg(
            F.max(score).alias("best"), F.count("*").alias("links")
        )
        sizes = current.groupBy("query_id").agg(F.count("*").alias("size"))
        member = current.select("query_id", F.col("gene").alias("node"), F.lit(True).alias("_in"))
        ranked = nodes.join(member, ["query_id", "node"], "left").join(sizes, "query_id")
        by_links = (F.col("size") > 1) if common else F.lit(False)
        order = [F.when(by_links, F.col("links")).otherwise(F.col("best")).desc(), F.col("node")]
        # a hub's neighbours are all nodes: parts of a query send on their best rows only
        limit = F.when(by_links, F.lit(k)).otherwise(k + F.col("size"))
        best = top_per_key(ranked.filter(~by_links | F.col("_in").isNull()), ["query_id"], limit, order, PARTS)
        fresh = top_per_key(best.filter(F.col("_in").isNull()), ["query_id"], k, order)
        current = checkpointed(current.unionByName(fresh.select("query_id", F.col("node").alias("gene"))))
    return current


def expand_local(net: DataFrame, genes: DataFrame, depth: int, k: int, threshold: float = 0.0, score: str = "ppv") -> DataFrame:
    """Gene sets after `depth` steps in which every gene brings the ends of its own k best links. A gene
    without links is no longer part of the set."""
    edges = symmetric(_confident(net, threshold, score).select("a", "b", score))
    current = genes.select("query_id", "gene").distinct()
    for _ in range(depth):
        mine = edges.join(current.withColumnRenamed("gene", "node"), "node")
        best = top_per_key(mine, ["query_id", "node"], k, [F.col(score).desc(), F.col("other")])
        current = checkpointed(best.select("query_id", F.explode(F.array("node", "other")).alias("gene")).distinct())
    return current


def linked_candidates(
    net: DataFrame, genes: DataFrame, k: int, max_fdr: float, n_nodes: int | Column, threshold: float = 0.0, score: str = "ppv"
) -> DataFrame:
    """Candidates connected to the seeds beyond chance: the k best seed links name candidates, whose
    seed links among all their links are tested (hypergeometric, Benjamini-Hochberg below `max_fdr`)."""
    edges = _confident(net, threshold, score).select("a", "b", score)
    first = neighbour_links(edges, genes)
    top = top_per_key(first, ["query_id"], k, [F.col(score).desc(), F.col("a"), F.col("b")], PARTS)
    near = checkpointed(top.select("query_id", F.explode(F.array("a", "b")).alias("gene")).distinct())
    links = neighbour_links(edges, near)
    seeds = genes.select("query_id", "gene").distinct()
    sizes = seeds.groupBy("query_id").agg(F.count("*").alias("n_seeds"))
    counts = indegree(links.select("query_id", "a", "b"), seeds).withColumnRenamed("node", "gene")
    tested = (
        counts.join(near, ["query_id", "gene"], "left_semi").join(seeds, ["query_id", "gene"], "left_anti").join(sizes, "query_id")
    )
    n = F.lit(n_nodes) if isinstance(n_nodes, int) else n_nodes
    p = hypergeom_tail(F.col("indegree"), n, F.col("n_seeds"), F.col("degree"))
    return p_adjust(tested.withColumn("p", p), ["query_id"]).filter(F.col("fdr") <= max_fdr)


def candidate_report(candidates: DataFrame) -> DataFrame:
    """Printed form of tested candidates."""
    return candidates.select(
        "query_id", "gene", "indegree", "degree", *[scientific(c).alias(c) for c in ("p", "fdr", "fwer")]
    )


# --- presentation ----------------------------------------------------------------------------


def link_direction(
    grg: Column, gs_code: Column, grg_llr: Column, ppv: Column, llr_threshold: float, ppv_threshold: float
) -> Column:
    """Direction of a link under one gold standard: a known direction, joined by the binding direction
    where that is well supported; 2 and 3 together give 5."""
    known = F.when(gs_code.isin(2, 3), gs_code).otherwise(0)
    supported = (ppv >= ppv_threshold) & (grg != known) & (grg_llr > llr_threshold)
    return F.when(gs_code == 5, 5).otherwise(F.when(supported, known + grg).otherwise(known)).cast("int")


def overall_direction(details: Column, ppv_threshold: float) -> Column:
    """Folds the directions of all gold standards of a link, in their fixed order, into one."""

    def step(acc: Column, d: Column) -> Column:
        local, code = d["direction"], d["is_gs"]
        joins = local.isin(2, 3) & acc.isin(0, 2, 3) & (acc != local)
        counted = F.when(acc == 5, acc).when(local == 5, 5).when(joins, acc + local).otherwise(acc)
        return F.when(code == 5, 5).when(d["ppv"] >= ppv_threshold, counted).otherwise(acc).cast("int")

    return F.aggregate(details, F.lit(0), step)


def score_details(
    links: DataFrame, restrict: str | None = None, llr_threshold: float = 0.0, ppv_threshold: float = 0.5
) -> DataFrame:
    """(query_id, a, b, direction, details): details lists gold standards with a score or a known link,
    best first, with direction and whether the coupling is known here (This), elsewhere (Other) or not."""
    any_known = F.exists("gs", lambda e: e["is_gs"] > 0)

    def detail(e: Column) -> Column:
        grg_llr = F.coalesce(F.try_element_at(e["llr_ev"], F.lit("GRG")), F.lit(0.0))
        known = F.when(e["is_gs"] > 0, "This").when(any_known, "Other").otherwise("None")
        return F.struct(
            (-e["ppv"]).alias("_p"), (-e["fbs"]).alias("_f"), e["gs"].alias("gs"), e["ppv"].alias("ppv"), e["fbs"].alias("fbs"),
            e["is_gs"].alias("is_gs"), e["is_ppv_gs"].alias("is_ppv_gs"), known.alias("known"),
            link_direction(F.col("direction"), e["is_gs"], grg_llr, e["ppv"], llr_threshold, ppv_threshold).alias("direction"),
        )

    shown = F.filter("gs", lambda e: ((e["ppv"] > 0) | (e["is_gs"] > 0)) & (F.lit(restrict is None) | (e["gs"] == (restrict or ""))))
    details = links.withColumn("_d", F.transform(shown, detail))
    keep = [c for c in ("query_id",) if c in links.columns]
    ordered = F.transform(
        F.array_sort("_d"),
        lambda d: F.struct(*[d[n].alias(n) for n in ("gs", "ppv", "fbs", "known", "is_ppv_gs", "direction")]),
    )
    return details.select(*keep, "a", "b", overall_direction(F.col("_d"), ppv_threshold).alias("direction"), ordered.alias("details"))


def annotate_nodes(genes: DataFrame, protein: DataFrame, id_mapping: DataFrame, pathway: DataFrame, tissue: DataFrame, label: str = "Gene_Symbol") -> DataFrame:
    """Nodes with a readable label (preferred mapping type, else accession), mappings, pathways, tissues."""
    ids = genes.select("gene").distinct()
    mine = id_mapping.withColumnRenamed("protein_id", "gene").join(ids, "gene", "left_semi")
    names = mine.groupBy("gene").agg(
        F.min(F.when(F.col("type") == label, F.col("mapped_id"))).alias("_label"),
        F.array_sort(F.collect_set(F.concat_ws(":", "type", "mapped_id"))).alias("mappings"),
    )

    def collected(df: DataFrame, col: str, name: str) -> DataFrame:
        own = df.withColumnRenamed("protein_id", "gene").join(ids, "gene", "left_semi")
        return own.groupBy("gene").agg(F.array_sort(F.collect_set(col)).alias(name))

    text = "array<string>"
    nodes = (
        ids.join(protein.withColumnRenamed("protein_id", "gene").select("gene", "uniprot_id"), "gene", "left")
        .join(names, "gene", "left")
        .join(collected(pathway, "pathway_id", "pathways"), "gene", "left")
        .join(collected(tissue, "tissue", "tissues"), "gene", "left")
    )
    empty = F.array().cast(text)
    return nodes.select(
        "gene", F.coalesce("_label", "uniprot_id").alias("label"), "uniprot_id",
        *[F.coalesce(c, empty).alias(c) for c in ("mappings", "pathways", "tissues")],
    )


# --- other species ---------------------------------------------------------------------------


def compare_species(links: DataFrame, other_net: DataFrame, genes: DataFrame, view: DataFrame, orthologs_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The query in a second species. `links` is the query's own subnetwork, `view` (src_id, dst_id).

    Returns the links found in the other network (around the orthologs of the query genes, or with
    `orthologs_only` among the orthologs of all nodes) and the ortholog pairs that connect both."""
    nodes = links.select("query_id", F.explode(F.array("a", "b")).alias("gene")).distinct()
    source = nodes if orthologs_only else genes.select("query_id", "gene").distinct()
    start = source.join(view.select(F.col("src_id").alias("gene"), "dst_id"), "gene")
    start = start.select("query_id", F.col("dst_id").alias("gene")).distinct()
    other = induced_links(other_net, start) if orthologs_only else neighbour_links(other_net, start)
    found = other.select("query_id", F.explode(F.array("a", "b")).alias("dst_id")).distinct()
    ties = nodes.join(view.select(F.col("src_id").alias("gene"), "dst_id"), "gene").select("query_id", F.col("gene").alias("src_id"), "dst_id")
    return other, keep_pairs(ties.distinct(), found, ["query_id", "dst_id"])


def query_transferred(net: DataFrame, genes: DataFrame, names: DataFrame) -> DataFrame:
    """A query against a network of a modelled species in the names of another one. `names` is (own, other):
    names go in, the answer's ends are given back in those names (one row per name pair)."""
    start = genes.join(names.select(F.col("other").alias("gene"), "own"), "gene").select("query_id", F.col("own").alias("gene")).distinct()
    found = neighbour_links(net, start)
    left, right = names.select(F.col("own").alias("a"), F.col("other").alias("name_a")), names.select(F.col("own").alias("b"), F.col("other").alias("name_b"))
    return found.join(left, "a").join(right, "b").select("query_id", "name_a", "name_b", "ppv").distinct()


def query_host_pathogen(net: DataFrame, genes: DataFrame, host: DataFrame, pathogen: DataFrame) -> DataFrame:
    """Links around the genes with the species role of both ends. `host` and `pathogen` are (protein_id)."""
    role = host.select("protein_id", F.lit("host").alias("_r")).unionByName(pathogen.select("protein_id", F.lit("pathogen").alias("_r")))
    found = neighbour_links(net, genes)
    left, right = role.withColumnsRenamed({"protein_id": "a", "_r": "role_a"}), role.withColumnsRenamed({"protein_id": "b", "_r": "role_b"})
    return found.join(left, "a").join(right, "b")


def link_details(
    links: DataFrame, gs: str, species: str, symmetric_orthologs: DataFrame, evidence_link: DataFrame, evidence: DataFrame, models: DataFrame, mex_cut: float = 0.5
) -> DataFrame:
    """All raw evidence behind links (a, b): own scores and, for transferable types, those of ortholog pairs,
    as LLR under the gold standard's models and with the stored score scaled back.

    `evidence` is (evidence_id, score_min, score_max, scoring range as stored). For expression the LLR
    uses the scores above the cut, scaled again between cut and maximum, as in training."""
    from linkweave.functions.columns import clip, polynomial

    pairs = links.select("a", "b").distinct()
    own = pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"), F.lit(species).alias("tax_id"))
    view = symmetric_orthologs.filter(F.col("src_tax") == species).select(F.col("dst_tax").alias("tax_id"), "src_id", "dst_id")
    left, right = view.select("tax_id", F.col("src_id").alias("a"), F.col("dst_id").alias("x")), view.select("tax_id", F.col("src_id").alias("b"), F.col("dst_id").alias("y"))
    carried = pairs.join(left, "a").join(right, ["tax_id", "b"]).select("a", "b", "x", "y", "tax_id")
    wanted = own.unionByName(carried).select("a", "b", "tax_id", F.greatest("x", "y").alias("ea"), F.least("x", "y").alias("eb")).distinct()
    raw = evidence_link.withColumnsRenamed({"a": "ea", "b": "eb"}).join(wanted, ["tax_id", "ea", "eb"])
    raw = raw.filter((F.col("tax_id") == species) | F.col("type").isin(vocab.ORTHOLOGY_TRANSFER))
    model = models.filter((F.col("gs") == gs) & F.col("coefficients").isNotNull()).select("evidence_id", "coefficients", "x_min", "x_max")
    full = raw.join(small_side(evidence.select("evidence_id", "score_min", "score_max")), "evidence_id").join(small_side(model), "evidence_id")
    original = half_even(F.col("score") * (F.col("score_max") - F.col("score_min")) + F.col("score_min"), 3)
    is_mex = F.col("type") == "MEX"
    full = full.withColumn("raw_score", F.when(F.col("score_min").isNull(), F.col("score")).otherwise(original))
    rescaled = half_even((F.col("raw_score") - mex_cut) / (F.col("score_max") - mex_cut), 4)
    used = F.when(is_mex, rescaled).otherwise(F.col("score"))
    llr = half_even(polynomial("coefficients", clip(used, "x_min", "x_max")), 3)
    return full.filter(~is_mex | (F.col("raw_score") > mex_cut)).select("a", "b", "evidence_id", "type", "tax_id", "ea", "eb", "raw_score", llr.alias("llr"))


def catalogue(membership: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct entries for selection lists (pathways, tissues, datasets, gold standards)."""
    return membership.select(*keys).distinct()
