"""Writers of networks, links and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave import vocab
from linkweave.functions.columns import scientific
from linkweave.operators.integration import explode_best_gs

# How direction codes are written.
DIRECTION_TEXT = {0: "", 1: "", 2: "->", 3: "<-", 5: "<->"}


def write_links(df: DataFrame, path: str, mode: str = "append") -> None:
    """Scored links as a dataset: one folder per type and dataset, so later reads prune to what they use.
    Rebalancing gathers the rows of a dataset and splits the ones that are too large for one file."""
    df.hint("rebalance", F.col("type"), F.col("evidence_id")).write.mode(mode).partitionBy("type", "evidence_id").parquet(path)


def network_tsv(net: DataFrame, protein: DataFrame, types=vocab.GOLD_STANDARDS, evidence=vocab.EVIDENCE_TYPES, species=vocab.SPECIES) -> DataFrame:
    """The flat network with numbered headers: accessions, ids, best gold standard, scores, flags, direction,
    then one column per gold standard, evidence type and species."""
    flat = explode_best_gs(net)
    for end, name in (("a", "_acc_a"), ("b", "_acc_b")):
        flat = flat.join(protein.select(F.col("protein_id").alias(end), F.col("uniprot_id").alias(name)), end, "left")
    arrow = F.create_map(*[F.lit(x) for kv in DIRECTION_TEXT.items() for x in kv])
    number = lambda m, k: F.coalesce(F.try_element_at(F.col(m), F.lit(k)), F.lit(0.0))
    cols: list[tuple[str, Column]] = [
        ("ProteinA", F.col("_acc_a")), ("ProteinB", F.col("_acc_b")), ("IdA", F.col("a")), ("IdB", F.col("b")),
        ("GoldStandard", F.col("gold_standard")), ("PPV", F.col("ppv")), ("FBS_max", F.col("fbs_max")),
        ("isGoldStandard", F.col("is_gs")), ("isPPVgoldstandard", F.col("is_ppv_gs")), ("GRG_direction", arrow[F.col("direction")]),
        *[(f"FBS_{t}", number("fbs", t)) for t in types],
        *[(f"LLR_{e}", number("llr_ev", e)) for e in evidence],
        *[(f"LLR_{s}", number("llr_sp", s)) for s in species],
    ]
    return flat.select(*[c.alias(f"{i}:{n}") for i, (n, c) in enumerate(cols)])


COMPACT_COLUMNS = 10


def write_network_tsv(net: DataFrame, protein: DataFrame, path: str, compact: bool = False, **order) -> None:
    """Gzip TSV sorted by confidence and score, best first. Rows are range-partitioned, so part files follow
    each other in order and no task sorts the whole network."""
    flat = network_tsv(net, protein, **order)
    if compact:
        flat = flat.select(*[F.col(f"`{c}`") for c in flat.columns[:COMPACT_COLUMNS]])
    ordered = flat.orderBy(F.col("`5:PPV`").desc(), F.col("`6:FBS_max`").desc(), F.col("`2:IdA`"), F.col("`3:IdB`"))
    ordered.write.mode("overwrite").option("header", True).option("sep", "\t").option("compression", "gzip").option("emptyValue", "").csv(path)


def subnetwork_json(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Node-link JSON: one row per node and per link of a query, (query_id, kind, json)."""
    n = nodes.select("query_id", F.lit("node").alias("kind"), F.to_json(F.struct(*[c for c in nodes.columns if c != "query_id"])).alias("json"))
    e = links.select("query_id", F.lit("link").alias("kind"), F.to_json(F.struct(*[c for c in links.columns if c != "query_id"])).alias("json"))
    return n.unionByName(e)


def gene_mapping_table(ids: DataFrame, id_mapping: DataFrame, tax_id: str | None = None) -> DataFrame:
    """(identifier, uniprot ids of the same protein): the mapping download."""
    m = id_mapping if tax_id is None else id_mapping.filter(F.col("tax_id") == tax_id)
    hit = ids.select("identifier").distinct().join(m.select(F.col("mapped_id").alias("identifier"), "protein_id").distinct(), "identifier")
    accession = m.filter("type = 'UniProtID'").select("protein_id", F.col("mapped_id").alias("accession"))
    return hit.join(accession, "protein_id").select("identifier", "accession").distinct()


def species_table(stats: DataFrame) -> DataFrame:
    """Species that have a network."""
    return stats.filter(F.col("num_links") > 0).select("tax_id", "species_name", "common_name", "num_links", "num_nodes", "origin").distinct()


def enrichment_table(result: DataFrame, names: DataFrame) -> DataFrame:
    """Printed enrichment: pathway name and id, both tests' corrected p-values, observed / expected, overlap."""
    return result.join(names, "pathway_id").select(
        "query_id", F.col("pathway_name"), "pathway_id",
        *[F.coalesce(scientific(c), F.lit("")).alias(c) for c in ("crosstalk_fdr", "crosstalk_fwer", "overlap_fdr", "overlap_fwer")],
        F.coalesce(F.concat_ws("/", F.col("crosstalk").cast("string"), F.format_string("%.2f", "expected")), F.lit("")).alias("observed_expected"),
        F.coalesce(F.col("overlap").cast("string"), F.lit("")).alias("overlap"),
    )


def write_enrichment_tsv(result: DataFrame, names: DataFrame, path: str) -> None:
    enrichment_table(result, names).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
