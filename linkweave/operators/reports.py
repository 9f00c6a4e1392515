"""Reference tables, species relations, counts and reports."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions.columns import compact_species_name
from linkweave.functions.ordered import dense_ids
from linkweave.operators.filters import tissue_rows
from linkweave.operators.pairs import bipartite_pairs, keep_best, map_ids, min_group_size
from linkweave.session import checkpointed

# --- species relations -----------------------------------------------------------------------


def closest_species(distances: DataFrame, modelled: DataFrame) -> DataFrame:
    """(tax_id, closest, distance): the nearest modelled species, itself excluded, ties to the smaller id.
    `distances` is (tax_a, tax_b, distance)."""
    known = distances.join(modelled.select(F.col("tax_id").alias("tax_b")), "tax_b", "left_semi").filter("tax_a <> tax_b")
    best = known.groupBy(F.col("tax_a").alias("tax_id")).agg(F.min(F.struct("distance", "tax_b")).alias("m"))
    return best.select("tax_id", F.col("m.tax_b").alias("closest"), F.col("m.distance").alias("distance"))


def ancestors(taxonomy: DataFrame, species: DataFrame) -> DataFrame:
    """(tax_id, ancestor, depth) by climbing the parent column up to the roots, which are their own parents.
    A lineage longer than there are taxa runs in a circle and raises an error."""
    taxa = taxonomy.select("tax_id").distinct().count()
    parents = checkpointed(taxonomy.select(F.col("tax_id").alias("ancestor"), "parent"))
    level = checkpointed(species.select("tax_id").distinct().select("tax_id", F.col("tax_id").alias("ancestor"), F.lit(0).alias("depth")))
    found = level
    for depth in count(1):
        if depth > taxa:
            raise ValueError("the taxonomy has a circle")
        level = level.join(parents, "ancestor").filter("parent <> ancestor")
        level = checkpointed(level.select("tax_id", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def closest_by_lineage(taxonomy: DataFrame, distances: DataFrame, species: DataFrame, modelled: DataFrame) -> DataFrame:
    """(tax_id, closest, method): the modelled species with the deepest common ancestor, ties by distance
    then id; species outside the taxonomy fall back to distance alone."""
    mine = ancestors(taxonomy, species).withColumnRenamed("depth", "up")
    theirs = ancestors(taxonomy, modelled).select(F.col("tax_id").alias("closest"), "ancestor")
    met = mine.join(theirs, "ancestor").filter("tax_id <> closest").groupBy("tax_id", "closest").agg(F.min("up").alias("up"))
    d = distances.select(F.col("tax_a").alias("tax_id"), F.col("tax_b").alias("closest"), "distance")
    ranked = met.join(d, ["tax_id", "closest"], "left").withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))
    by_tree = ranked.groupBy("tax_id").agg(F.min(F.struct("up", "distance", "closest")).alias("m")).select("tax_id", F.col("m.closest").alias("closest"), F.lit("lineage").alias("method"))
    rest = closest_species(distances, modelled).join(species.select("tax_id"), "tax_id", "left_semi").join(by_tree, "tax_id", "left_anti")
    return by_tree.unionByName(rest.select("tax_id", "closest", F.lit("distance").alias("method")))


def species_labels(species: DataFrame) -> DataFrame:
    return species.withColumn("compact", compact_species_name("species_name"))


# --- counts and reports ----------------------------------------------------------------------


def network_stats(net: DataFrame, protein: DataFrame, origin: str = "trained") -> DataFrame:
    """(tax_id, num_links, num_nodes, genome_size, origin). `net` is (tax_id, a, b)."""
    links = net.groupBy("tax_id").agg(F.count("*").alias("num_links"))
    nodes = net.select("tax_id", F.explode(F.array("a", "b")).alias("node")).distinct().groupBy("tax_id").agg(F.count("*").alias("num_nodes"))
    genome = protein.groupBy("tax_id").agg(F.count("*").alias("genome_size"))
    joined = links.join(nodes, "tax_id").join(genome, "tax_id", "left")
    return joined.withColumn("origin", F.lit(origin))


def upsert_stats(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace rows of `old` with the same key; others stay."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def count_links(links: DataFrame, catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """Links per catalogue entry, zeros included."""
    n = links.groupBy(*keys).agg(F.count("*").alias("n_links"))
    return catalogue.join(n, keys, "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def training_report(models: DataFrame, key: str, outcomes: list[str]) -> DataFrame:
    """Fits per type and outcome; `outcome` is ok or the reason of the failure."""
    rows = models.withColumn("outcome", F.coalesce("error", F.lit("ok")))
    return rows.groupBy(key).pivot("outcome", outcomes).count().fillna(0)


def prune_report(links: DataFrame, evidence: DataFrame, homologs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a clean-up would drop: datasets without links, and links between homologs."""
    empty = evidence.join(links.select("evidence_id").distinct(), "evidence_id", "left_anti")
    return empty, links.join(homologs.select("a", "b"), ["a", "b"], "left_semi")


def species_links(links: DataFrame, tax_id: str) -> DataFrame:
    """Links of a species, for removal or re-loading."""
    return links.filter(F.col("tax_id") == tax_id)


def ppv_bands(net: DataFrame, keys: list[str], bands: list[tuple[str, float]], score: str = "max_ppv") -> DataFrame:
    """Links per confidence band. `bands` names lower limits, highest last."""
    name: Column = F.lit(None).cast("string")
    for label, low in bands:
        name = F.when(F.col(score) >= low, label).otherwise(name)
    return net.withColumn("band", name).filter("band is not null").groupBy(*keys, "band").agg(F.count("*").alias("n_links"))


def llr_share(net: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """LLR sum, positive links and share of the total per evidence type (`llr_ev`) or species (`llr_sp`)."""
    from pyspark.sql import Window as W

    parts = net.select(*keys, F.explode(column).alias("part", "llr"))
    sums = parts.groupBy(*keys, "part").agg(F.sum("llr").alias("llr"), F.count_if(F.col("llr") > 0).alias("n_positive"))
    return sums.withColumn("share", F.col("llr") / F.sum("llr").over(W.partitionBy(*keys)))


def gold_standard_share(net: DataFrame, keys: list[str]) -> DataFrame:
    """Links under each gold standard and how many of them got their confidence from it."""
    g = net.select(*keys, F.explode("gs").alias("g")).filter(F.col("g.ppv") > 0)
    return g.groupBy(*keys, F.col("g.gs").alias("gs")).agg(F.count("*").alias("n_links"), F.count_if(F.col("g.is_ppv_gs") == 1).alias("n_from_gs"))


def directed_links(net: DataFrame, keys: list[str]) -> DataFrame:
    return net.filter(F.col("direction") > 0).groupBy(*keys).agg(F.count("*").alias("n_directed"))


# --- reference tables ------------------------------------------------------------------------


def pathway_members(entries: DataFrame, mapping: DataFrame) -> DataFrame:
    """(pathway_id, protein_id) from pathway entries (pathway_id, gene), with or without species prefix."""
    return map_ids(entries.select("pathway_id", "gene").distinct(), mapping, {"gene": "protein_id"}, strip_prefix=True)


def tissue_members(calls: DataFrame, mapping: DataFrame, fmt: str, min_rows: int = 100) -> DataFrame:
    """(protein_id, tissue, tissue_id) of tissues with enough calls."""
    kept = min_group_size(tissue_rows(calls, fmt), ["tissue"], min_rows)
    return dense_ids(map_ids(kept, mapping, {"gene": "protein_id"}).distinct(), "tissue", "tissue_id")


def build_id_mapping(proteins: DataFrame, idmap: DataFrame) -> DataFrame:
    """(uniprot_id, type, mapped_id): the accession itself, its mappings, and mappings of alternative
    accessions - not in the proteome, sharing an Ensembl gene, and with a single Ensembl gene themselves.

    `proteins` is (uniprot_id), `idmap` (acc, type, mapped_id). The last Ensembl id of a protein counts;
    here the largest, which does not depend on file order."""
    known = proteins.select("uniprot_id").distinct()
    itself = known.select("uniprot_id", F.lit("UniProtID").alias("type"), F.col("uniprot_id").alias("mapped_id"))
    direct = idmap.join(known.withColumnRenamed("uniprot_id", "acc"), "acc", "left_semi").select(F.col("acc").alias("uniprot_id"), "type", "mapped_id")
    gene = direct.filter("type = 'Ensembl'").groupBy("uniprot_id").agg(F.max("mapped_id").alias("ensembl"))
    outside = idmap.join(known.withColumnRenamed("uniprot_id", "acc"), "acc", "left_anti")
    single = outside.filter("type = 'Ensembl'").groupBy("acc").agg(F.count("*").alias("n"), F.max("mapped_id").alias("ensembl")).filter("n < 2")
    # a gene with many accessions is on the alternative side; the protein side has one row per protein
    alt = single.join(gene, "ensembl").select("uniprot_id", "acc")
    alt_ids = alt.select("uniprot_id", F.lit("alt_uniprot_id").alias("type"), F.col("acc").alias("mapped_id"))
    alt_maps = outside.join(alt, "acc").select("uniprot_id", F.concat(F.lit("alt_"), "type").alias("type"), "mapped_id")
    return itself.unionByName(direct).unionByName(alt_ids).unionByName(alt_maps).distinct()


def new_mappings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Mappings not stored yet."""
    keys = ["protein_id", "type", "mapped_id"]
    return new.join(old.select(*keys), keys, "left_anti").distinct()


def build_orthologs(groups: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ortholog pairs from groups (pair_id, group, tax_id, protein): every member of one species with every
    member of the other, ids mapped, the species with the larger tax id first. `mapping` has tax_id."""
    left = groups.select("pair_id", "group", F.col("tax_id").alias("species_a"), F.col("protein").alias("name_a"))
    right = groups.select("pair_id", "group", F.col("tax_id").alias("species_b"), F.col("protein").alias("name_b"))
    ordered = F.col("species_a").cast("bigint") > F.col("species_b").cast("bigint")
    ids = mapping.select("mapped_id", "protein_id", "tax_id").distinct()
    ia = ids.withColumnsRenamed({"mapped_id": "name_a", "protein_id": "protein_a", "tax_id": "species_a"})
    ib = ids.withColumnsRenamed({"mapped_id": "name_b", "protein_id": "protein_b", "tax_id": "species_b"})
    pairs = bipartite_pairs(left.join(ia, ["name_a", "species_a"]), right.join(ib, ["name_b", "species_b"]), ["pair_id", "group"])
    return pairs.filter(ordered).select("protein_a", "protein_b", "species_a", "species_b").distinct()


def missing_datasets(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Configured datasets (type, tax_id, version, scoring_method) that are not loaded."""
    keys = ["type", "tax_id", "version", "scoring_method"]
    return wanted.join(stored.select(*keys), keys, "left_anti")


def refresh_orthologs(old: DataFrame, new: DataFrame, species: DataFrame) -> DataFrame:
    """Rows that involve refreshed species come from `new`, all others stay."""
    a, b = species.select(F.col("tax_id").alias("species_a")), species.select(F.col("tax_id").alias("species_b"))
    kept = old.join(a, "species_a", "left_anti").join(b, "species_b", "left_anti")
    fresh = new.join(a, "species_a", "left_semi").unionByName(new.join(a, "species_a", "left_anti").join(b, "species_b", "left_semi"))
    return kept.unionByName(fresh.select(*old.columns))


def best_transferred(net: DataFrame) -> DataFrame:
    return keep_best(net, ["a", "b"], [F.col("ppv"), F.col("fbs")])
