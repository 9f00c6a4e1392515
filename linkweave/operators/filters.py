"""Row admission rules of the biological sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave.functions.columns import clean_method, extract_accession, last_of_list

# PSI-MI terms accepted as physical association (the association branch of the ontology).
PHYSICAL_INTERACTION_TERMS = [
    "MI:2232", "MI:0914", "MI:0915", "MI:0407", "MI:0195", "MI:0408", "MI:0556", "MI:1126", "MI:1127", "MI:0414",
    "MI:0192", "MI:2356", "MI:0557", "MI:0193", "MI:1143", "MI:1148", "MI:1139", "MI:0194", "MI:1355", "MI:0212",
    "MI:0198", "MI:0200", "MI:0201", "MI:0202", "MI:0910", "MI:0572", "MI:0902", "MI:0571", "MI:0570", "MI:1310",
    "MI:0197", "MI:2280", "MI:0985", "MI:1140", "MI:0199", "MI:0558", "MI:0871", "MI:0569", "MI:0203", "MI:0568",
    "MI:0204", "MI:1027", "MI:0207", "MI:0559", "MI:2252", "MI:0210", "MI:1250", "MI:1251", "MI:1237", "MI:0211",
    "MI:0206", "MI:0209", "MI:0214", "MI:0216", "MI:0213", "MI:0567", "MI:0986", "MI:0701", "MI:0987", "MI:0881",
    "MI:0882", "MI:0883", "MI:0945", "MI:1146", "MI:0971", "MI:0217", "MI:0844", "MI:2263", "MI:1327", "MI:0566",
    "MI:2272", "MI:2273", "MI:0220", "MI:1230",
]

# Words that mark a pathway as signaling.
SIGNALING_WORDS = ["signal", "transduction", "potenti", "junction", "sensing", "adhesio", "interaction", "contraction"]

# Order in which expression sources are preferred.
EXPRESSION_SOURCE_ORDER = ["EBI", "rseq", "ma"]


def tax_of(col: str | Column) -> Column:
    """`taxid:9606(Homo sapiens)` -> `9606`."""
    return F.regexp_extract(col, r"taxid:(-?\d+)", 1)


def same_species(df: DataFrame) -> DataFrame:
    """Rows whose partners are of one species; a complex row has no species on side A and takes side B's."""
    a = F.when(F.col("tax_a") == "-", F.col("tax_b")).otherwise(F.col("tax_a"))
    return df.withColumn("tax_a", a).filter(F.col("tax_a") == F.col("tax_b"))


def interaction_rows(df: DataFrame) -> DataFrame:
    """MITAB rows -> (protein_a | complex, protein_b, method, pmid); rows without accession or paper fall out."""
    complex_a = F.col("id_a").contains("complex:")
    accession_a = extract_accession("id_a", "alt_a", "alt2_a")
    return (
        df.select(
            F.when(complex_a, F.col("id_a")).otherwise(accession_a).alias("protein_a"),
            extract_accession("id_b", "alt_b", "alt2_b").alias("protein_b"),
            clean_method("method").alias("method"),
            last_of_list("pmid").alias("pmid"),
            F.element_at(F.split("tax_b", r"\("), 1).alias("tax"),
            complex_a.alias("is_complex"),
        )
        .filter(F.col("protein_a").isNotNull() & F.col("protein_b").isNotNull())
        .filter(F.col("pmid") != "-")
    )


def host_pathogen_rows(df: DataFrame, host: str, pathogen: str, unreviewed: str = "pubmed:8888") -> DataFrame:
    """Rows whose partners belong to the two species, without unreviewed papers (marked by their prefix)."""
    filled = df.withColumn("tax_a", F.when(F.col("tax_a") == "-", F.col("tax_b")).otherwise(F.col("tax_a")))
    both = tax_of("tax_a").isin(host, pathogen) & tax_of("tax_b").isin(host, pathogen)
    return filled.filter(both & ~last_of_list("pmid").contains(unreviewed))


def filter_taxon(df: DataFrame, tax_id: str, col: str = "taxon") -> DataFrame:
    return df.filter(F.col(col) == f"taxon:{tax_id}")


def genetic_rows(df: DataFrame) -> DataFrame:
    """Genetic interactions with a score, both partners given as swiss-prot accessions."""
    swiss = lambda c: F.upper(F.regexp_extract(c, r"swiss-prot:([^|]+)", 1))
    keep = (
        F.col("itype").contains("genetic")
        & (F.col("score") != "-")
        & F.col("alt_a").contains("swiss-prot")
        & F.col("alt_b").contains("swiss-prot")
    )
    return df.filter(keep).select(
        swiss("alt_a").alias("gene_a"),
        swiss("alt_b").alias("gene_b"),
        F.regexp_replace("score", "score:", "").cast("double").alias("score"),
    )


def go_rows(df: DataFrame, terms: DataFrame) -> DataFrame:
    """Annotations with experimental support, not negated, on terms of the wanted branch."""
    kept = df.filter((F.col("evidence_code") != "IEA") & ~F.col("association").startswith("NOT"))
    return kept.join(terms.select("term"), "term", "left_semi")


def quality_check(long: DataFrame, n_samples: int, max_bad: float = 0.2) -> DataFrame:
    """Proteins with less than `max_bad` zero or missing cells, and one protein (the lowest id) of each
    set of identical profiles. `long` is (protein_id, sample, value); absent cells count as missing."""
    good = F.count_if(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != 0))
    cells = F.array_sort(F.collect_list(F.struct("sample", "value")))
    profiles = long.groupBy("protein_id").agg(good.alias("_good"), cells.alias("_cells"))
    kept = profiles.filter((F.lit(n_samples) - F.col("_good")) / n_samples < max_bad)
    # the profile is as long as the experiment has samples; equal ones are found by their hash and values
    unique = kept.groupBy("_cells").agg(F.min("protein_id").alias("protein_id"))
    return unique.select("protein_id", F.explode("_cells").alias("c")).select("protein_id", "c.sample", "c.value")


def explode_probes(df: DataFrame, col: str = "gene", sep: str = "///") -> DataFrame:
    """`a /// b` names two genes: one row each."""
    return df.withColumn(col, F.explode(F.split(col, sep))).withColumn(col, F.trim(col)).filter(F.col(col) != "")


def ppi_rows(df: DataFrame, types: list[str] = PHYSICAL_INTERACTION_TERMS, max_lpr: int = 100) -> DataFrame:
    """Pairwise, same-species, physical rows of small experiments -> (protein_a, protein_b, tax, publications)."""
    term = F.coalesce(F.nullif(F.regexp_extract("itype", r'"(MI:\d+)"', 1), F.lit("")), F.col("itype"))
    stated = F.col("confidence") != "-"
    lpr = F.when(stated, F.regexp_extract("confidence", r"lpr:(\d+)", 1).cast("int")).otherwise(1)
    papers = F.when(stated, F.regexp_extract("confidence", r"np:(\d+)", 1).cast("int")).otherwise(1)
    a = extract_accession("alt2_a", "alt_a", "id_a", cut_isoform=True)
    b = extract_accession("alt2_b", "alt_b", "id_b", cut_isoform=True)
    return (
        df.filter((F.col("edge_type") == "X") & (tax_of("tax_a") == tax_of("tax_b")) & term.isin(types) & (lpr <= max_lpr))
        .select(a.alias("protein_a"), b.alias("protein_b"), tax_of("tax_a").alias("tax"), papers.alias("publications"))
        .filter(F.col("protein_a").isNotNull() & F.col("protein_b").isNotNull())
    )


def ppi_supported(df: DataFrame, other_gs: DataFrame) -> DataFrame:
    """Pairs with more than one publication, or already known to another gold standard."""
    many = df.filter(F.col("publications") > 1)
    known = df.join(other_gs.select("a", "b"), ["a", "b"], "left_semi")
    return many.unionByName(known).drop("publications").distinct()


def capitalize(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substr(col, F.lit(2))))


def tissue_rows(df: DataFrame, fmt: str) -> DataFrame:
    """Trusted presence calls -> (gene, tissue) with cleaned tissue names."""
    if fmt == "hpa":
        kept = df.filter((F.col("reliability") != "Uncertain") & (F.col("level") != "Not detected"))
        return kept.select(F.trim("gene").alias("gene"), F.trim(capitalize(F.col("tissue"))).alias("tissue"))
    kept = df.filter((F.col("expression") == "present") & (F.col("call_quality") == "gold quality"))
    name = F.element_at(F.split(F.regexp_replace("tissue", "[\"']", ""), r"\("), 1)
    return kept.select(F.trim("gene").alias("gene"), F.trim(capitalize(name)).alias("tissue"))


def select_pathways(index: DataFrame, kind: str, previous: DataFrame) -> DataFrame:
    """Pathways to use for a gold standard, with status kept / added / removed against the previous list.

    Metabolic: class Metabolism without global (011) and structure (010) maps. Signaling: a signaling
    word in the name, human diseases excluded. A previous pathway stays as long as it still exists.
    """
    if kind == "Metabolic":
        rule = (F.col("class") == "Metabolism") & ~F.col("pathway_id").rlike("^01[01]")
    else:
        rule = F.col("name").rlike("|".join(SIGNALING_WORDS)) & (F.col("class") != "Human Diseases")
    prev = previous.select("pathway_id", F.lit(True).alias("_prev"))
    joined = index.withColumn("_rule", rule).join(prev, "pathway_id", "full_outer")
    status = (
        F.when(F.col("_prev").isNull() & F.col("_rule"), "added")
        .when(F.col("_prev").isNotNull() & F.col("name").isNull(), "removed")
        .when(F.col("_prev").isNotNull(), "kept")
    )
    return joined.withColumn("status", status).filter(F.col("status").isNotNull()).select("pathway_id", "name", "status")


def cap_datasets(df: DataFrame, n: int) -> DataFrame:
    """First n datasets per species by source preference and listed position. (A configuration-sized table.)"""
    rank = F.array_position(F.array(*[F.lit(s) for s in EXPRESSION_SOURCE_ORDER]), F.col("source"))
    w = W.partitionBy("tax_id").orderBy(rank, "position", "dataset")
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def abs_score_cut(df: DataFrame, cut: float = 0.1, score: str = "score") -> DataFrame:
    """Strong scores of either sign; the sign moves to its own column and the score becomes absolute."""
    return df.filter(F.abs(score) > cut).withColumns(
        {"sign": F.when(F.col(score) < 0, "-").otherwise(""), score: F.abs(score)}
    )


def confidence_filter(df: DataFrame, threshold: float, col: str = "max_ppv") -> DataFrame:
    return df.filter(F.col(col) >= threshold)


def any_positive_fbs(df: DataFrame, keys: list[str] = ["a", "b"]) -> DataFrame:
    """Rows of pairs for which at least one gold standard's score is above zero."""
    positive = df.groupBy(*keys).agg(F.max(F.col("fbs") > 0).alias("_any")).filter("_any").drop("_any")
    return df.join(positive, keys, "left_semi")
