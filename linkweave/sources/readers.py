"""Readers of the biological file formats.

Each `parse_x` turns text lines (column `value`) into a table, each `read_x` applies it to files. Lines are
cut by column position, so only the wanted fields leave the scan; every file in a folder is read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.ordered import ranged, scan

# UniProt idmapping types that are kept, and their names in the mapping table.
ID_TYPES = {
    "Gene_Name": "Gene_Symbol",
    "GeneID": "Gene_ID",
    "Ensembl_PRO": "Ensembl_Protein",
    "Ensembl": "Ensembl",
    "EnsemblGenome": "Ensembl",
    "EnsemblGenome_PRO": "Ensembl_Protein",
    "Gene_Synonym": "Alt_Gene_Name",
    "KEGG": "KEGG",
    "UniProtKB-ID": "UniProtKB_ID",
    "Gene_ORFName": "Gene_ORFName",
    "Gene_OrderedLocusName": "Gene_OrderedLocusName",
    "MGI": "MGI",
    "RGD": "RGD",
    "SGD": "SGD",
    "ZFIN": "ZFIN",
    "WormBase": "WormBase",
    "dictyBase": "dictyBase",
    "Ensembl_TRS": "Ensembl_Transcript",
    "EnsemblGenome_TRS": "Ensembl_Transcript",
    "RefSeq_NT": "RefSeq_NT",
}

# Abundance samples that are no single tissue.
MIXED_ORGANS = ["WHOLE_ORGANISM", "CELL_LINE"]

# Words of the four regulatory sources that state a regulation (source -> column positions, words).
REGULATORY_FORMATS = {
    "regnetwork": (" ", (0, 2, 4), ["-->", "--|", "-/-"]),
    "regulondb": ("\t", (2, 4, 6), ["Strong", "Confirmed", "Weak"]),
    "trrust": ("\t", (0, 1, 2), ["Activation", "Repression", "Unknown"]),
    "yeastract": ("\t", (1, 3, 5), ["Positive", "Negative", "Unknown"]),
}


def text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one or many files (gzip by suffix), without NUL bytes."""
    return spark.read.text(path).withColumn("value", F.regexp_replace("value", "\u0000", ""))


def fields(lines: DataFrame, positions: dict[str, int], sep: str = "\t", comment: str | None = "#") -> DataFrame:
    """The named fields of separated lines; comment and empty lines are left out."""
    kept = lines.filter(F.trim("value") != "")
    if comment:
        kept = kept.filter(~F.col("value").startswith(comment))
    parts = F.split("value", sep, -1)
    keep = [c for c in lines.columns if c != "value"]
    return kept.withColumn("_f", parts).select(*keep, *[F.get("_f", F.lit(i)).alias(n) for n, i in positions.items()])


def between(col: str, left: str, right: str) -> Column:
    return F.regexp_extract(col, f"{left}(.*?){right}", 1)


# --- proteomes -------------------------------------------------------------------------------


def parse_fasta_headers(lines: DataFrame, tax_id: str) -> DataFrame:
    """`>db|ACC|NAME text OS=...` -> (uniprot_id, description, tax_id)."""
    parts = F.split("value", r"\|")
    text_part = F.element_at(F.split(F.get(parts, F.lit(2)), "OS="), 1)
    return lines.filter(F.col("value").startswith(">")).select(
        F.trim(F.get(parts, F.lit(1))).alias("uniprot_id"), F.trim(text_part).alias("description"), F.lit(tax_id).alias("tax_id")
    )


def read_fasta_headers(spark: SparkSession, path: str, tax_id: str) -> DataFrame:
    return parse_fasta_headers(text(spark, path), tax_id)


def parse_idmapping(lines: DataFrame, types: dict[str, str] = ID_TYPES) -> DataFrame:
    """(acc, type, mapped_id): isoform suffixes and Ensembl versions cut, wanted types renamed."""
    names = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    rows = fields(lines, {"acc": 0, "source": 1, "mapped_id": 2}, comment=None).filter(F.col("source").isin(list(types)))
    named = rows.select(F.element_at(F.split("acc", "-"), 1).alias("acc"), F.element_at(names, F.col("source")).alias("type"), "mapped_id")
    versioned = F.col("type").isin("Ensembl", "Ensembl_Protein")
    return named.withColumn("mapped_id", F.when(versioned, F.element_at(F.split("mapped_id", r"\."), 1)).otherwise(F.col("mapped_id")))


def read_idmapping(spark: SparkSession, path: str, types: dict[str, str] = ID_TYPES) -> DataFrame:
    return parse_idmapping(text(spark, path), types)


def parse_species_index(lines: DataFrame) -> DataFrame:
    """Proteome index lines -> (proteome_id, tax_id, domain, species_name, common_name). The name is the last
    column; a parenthesis holds the common name, unless it names the strain."""
    parts = F.split("value", "\t")
    n = F.size(parts)
    name = F.trim(F.when(n < 8, F.get(parts, F.lit(5))).otherwise(F.get(parts, F.lit(7))))
    rows = lines.filter(F.col("value").startswith("UP0") & (n > 4)).select(
        F.get(parts, F.lit(0)).alias("proteome_id"), F.trim(F.get(parts, F.lit(1))).alias("tax_id"), F.get(parts, F.lit(3)).alias("domain"), name.alias("full")
    )
    strain = F.col("full").contains("strain")
    brackets = F.length("full") - F.length(F.replace("full", F.lit("("), F.lit("")))
    bare = lambda c: F.trim(F.regexp_replace(c, r"[()]", ""))
    after = F.element_at(F.split("full", r"\) "), 2)
    species = (
        F.when(brackets == 0, F.col("full"))
        .when(strain & (brackets > 1), F.concat(F.element_at(F.split("full", r"\) "), 1), F.lit(")")))
        .when(strain, F.col("full"))
        .otherwise(F.trim(F.element_at(F.split("full", r"\("), 1)))
    )
    common = (
        F.when(brackets == 0, F.col("full"))
        .when(strain & (brackets > 1), bare(after))
        .when(strain, F.col("full"))
        .otherwise(bare(F.element_at(F.split("full", r"\("), 2)))
    )
    return rows.select("proteome_id", "tax_id", "domain", species.alias("species_name"), common.alias("common_name"))


def read_species_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_species_index(text(spark, path))


def parse_ortholog_groups(lines: DataFrame) -> DataFrame:
    """(group, bitscore, tax_id, inparalog_score, protein, seed_score); columns kept beside `value`, such as
    the species pair a file stands for, stay."""
    rows = fields(lines, {"group": 0, "bitscore": 1, "species": 2, "inparalog_score": 3, "protein": 4, "seed_score": 5}, comment=None)
    keep = [c for c in lines.columns if c != "value"]
    return rows.select(
        *keep, "group", F.col("bitscore").cast("double").alias("bitscore"), F.element_at(F.split("species", r"\."), 1).alias("tax_id"),
        F.col("inparalog_score").cast("double").alias("inparalog_score"), F.trim("protein").alias("protein"), "seed_score",
    )


def read_ortholog_groups(spark: SparkSession, path: str) -> DataFrame:
    """The file name identifies the species pair: groups of different files are different."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("pair_id"))
    return parse_ortholog_groups(lines)


# --- interactions ----------------------------------------------------------------------------

MITAB = {
    "id_a": 0, "id_b": 1, "alt_a": 2, "alt_b": 3, "method": 6, "pmid": 8, "tax_a": 9, "tax_b": 10,
    "itype": 11, "confidence": 14, "alt2_a": 38, "alt2_b": 39, "edge_type": 52,
}


def parse_mitab(lines: DataFrame, cols: list[str] = list(MITAB)) -> DataFrame:
    return fields(lines, {c: MITAB[c] for c in cols})


def read_mitab(spark: SparkSession, path: str, cols: list[str] = list(MITAB)) -> DataFrame:
    return parse_mitab(text(spark, path), cols)


def parse_genetic_mitab(lines: DataFrame, tax_id: str) -> DataFrame:
    from linkweave.operators.filters import genetic_rows

    return genetic_rows(fields(lines, {"alt_a": 2, "alt_b": 3, "itype": 6, "score": 14})).withColumn("tax_id", F.lit(tax_id))


def read_genetic_mitab(spark: SparkSession, path: str, tax_id: str) -> DataFrame:
    return parse_genetic_mitab(text(spark, path), tax_id)


def parse_domain_interactions(lines: DataFrame) -> DataFrame:
    """(domain_a, domain_b, score > 0); scores use a decimal comma, header rows have no number there."""
    rows = fields(lines, {"domain_a": 0, "domain_b": 1, "score": 23}, comment=None)
    score = F.replace("score", F.lit(","), F.lit(".")).try_cast("double")
    return rows.withColumn("score", score).filter(F.col("score") > 0)


def read_domain_interactions(spark: SparkSession, path: str) -> DataFrame:
    return parse_domain_interactions(text(spark, path))


def parse_domain_hits(lines: DataFrame) -> DataFrame:
    """Domain scan output -> (protein, domain), one row per hit."""
    rows = fields(lines.withColumn("value", F.trim("value")), {"seq": 0, "dom": 5}, sep=r"\s+")
    return rows.select(F.get(F.split("seq", r"\|"), F.lit(1)).alias("protein"), F.element_at(F.split("dom", r"\."), 1).alias("domain"))


def read_domain_hits(spark: SparkSession, path: str) -> DataFrame:
    return parse_domain_hits(text(spark, path))


def parse_mirna_targets(lines: DataFrame) -> DataFrame:
    return fields(lines, {"mirna": 0, "gene": 2}).distinct()


def read_mirna_targets(spark: SparkSession, path: str) -> DataFrame:
    return parse_mirna_targets(text(spark, path))


def parse_tf_targets(lines: DataFrame, tax_id: str | None = None) -> DataFrame:
    """(tf, gene) of a species, given in the ninth column."""
    rows = fields(lines, {"tf": 0, "gene": 1, "tax_id": 8})
    return (rows if tax_id is None else rows.filter(F.col("tax_id") == tax_id)).distinct()


def read_tf_targets(spark: SparkSession, path: str, tax_id: str | None = None) -> DataFrame:
    return parse_tf_targets(text(spark, path), tax_id)


# --- abundance, expression -------------------------------------------------------------------


def parse_abundance(lines: DataFrame) -> DataFrame:
    """Lines with their file (`file`, `value`) -> (tax_id, organ, filename, gene, value). Header lines name the
    organ; integrated files and mixed samples are left out."""
    lines = lines.filter(~F.col("file").contains("integrated"))
    words = F.split(F.trim("value"), r"\s+")
    organ = F.max(F.when(F.col("value").startswith("#organ"), F.get(words, F.lit(1))))
    stem = F.regexp_extract("value", r"^#filename:?\s+[^-]*-([^.]*)\.", 1)
    named = F.max(F.when(F.col("value").startswith("#filename"), stem))
    heads = lines.filter(F.col("value").startswith("#")).groupBy("file").agg(organ.alias("organ"), named.alias("filename"))
    rows = lines.filter(~F.col("value").startswith("#")).select("file", F.get(words, F.lit(0)).alias("id"), F.get(words, F.lit(1)).cast("double").alias("value"))
    joined = rows.join(heads.filter(~F.col("organ").isin(MIXED_ORGANS)), "file")
    return joined.select(
        F.element_at(F.split("id", r"\."), 1).alias("tax_id"), "organ", F.coalesce("filename", "file").alias("filename"),
        F.regexp_replace("id", r"^[^.]*\.", "").alias("gene"), "value",
    )


def read_abundance(spark: SparkSession, path: str) -> DataFrame:
    return parse_abundance(spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")))


def melt_expression(wide: DataFrame, gene: str) -> DataFrame:
    """Genes x samples -> (gene, sample, value)."""
    samples = [c for c in wide.columns if c != gene]
    typed = wide.select(F.col(gene).alias("gene"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in samples])
    return typed.unpivot(["gene"], samples, "sample", "value")


def read_expression(spark: SparkSession, path: str, fmt: str = "tsv") -> DataFrame:
    """Expression matrix with sample names in its first line; other columns than numbers become missing."""
    sep = {"tsv": "\t", "csv": ","}[fmt]
    wide = spark.read.option("header", True).option("sep", sep).option("comment", "#").csv(path)
    return melt_expression(wide, wide.columns[0])


# --- genomes ---------------------------------------------------------------------------------


def parse_narrowpeak(lines: DataFrame) -> DataFrame:
    rows = fields(lines, {"chrom": 0, "start_p": 1, "end_p": 2, "value": 6})
    return rows.withColumns({"start_p": F.col("start_p").cast("bigint"), "end_p": F.col("end_p").cast("bigint"), "value": F.col("value").cast("double")})


def read_narrowpeak(spark: SparkSession, path: str) -> DataFrame:
    """Peaks of many files; the file accession is the name before the first dot."""
    lines = spark.read.text(path).select("value", F.element_at(F.split("_metadata.file_name", r"\."), 1).alias("file"))
    return parse_narrowpeak(lines)


def parse_gtf_genes(lines: DataFrame) -> DataFrame:
    """Protein-coding genes -> (chrom, start_g, end_g, strand, gene_id, gene_name), names in lower case,
    chromosomes with the `chr` prefix."""
    rows = fields(lines, {"chrom": 0, "type": 2, "start_g": 3, "end_g": 4, "strand": 6, "attributes": 8})
    kept = rows.filter((F.col("type") == "gene") & F.col("attributes").contains("protein_coding"))
    chrom = F.when(F.col("chrom").contains("chr"), F.col("chrom")).otherwise(F.concat(F.lit("chr"), "chrom"))
    attribute = lambda n: F.lower(F.nullif(F.regexp_extract("attributes", f'{n} "(.*?)"', 1), F.lit("")))
    return kept.select(
        chrom.alias("chrom"), F.col("start_g").cast("bigint").alias("start_g"), F.col("end_g").cast("bigint").alias("end_g"),
        "strand", attribute("gene_id").alias("gene_id"), attribute("gene_name").alias("gene_name"),
    ).distinct()


def read_gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf_genes(text(spark, path))


def annotate_genes(genes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Genes with protein ids, through whichever of gene id and gene name maps more genes."""
    ids = mapping.select(F.lower("mapped_id").alias("name"), "protein_id").distinct()
    by_id, by_name = (genes.withColumnRenamed(c, "name").join(ids, "name") for c in ("gene_id", "gene_name"))
    hits = {c: genes.join(ids, genes[c] == ids["name"], "left_semi").count() for c in ("gene_id", "gene_name")}
    best = by_id if hits["gene_id"] > hits["gene_name"] else by_name
    return best.select("protein_id", "chrom", "start_g", "end_g", "strand")


# --- annotation ------------------------------------------------------------------------------


def parse_gaf(lines: DataFrame) -> DataFrame:
    return fields(lines, {"gene": 1, "association": 3, "term": 4, "evidence_code": 6, "taxon": 12}, comment="!")


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    return parse_gaf(text(spark, path))


def parse_obo_edges(stanzas: DataFrame, namespace: str) -> DataFrame:
    """Term stanzas (one per row) -> (child, parent, relation) of one namespace."""
    terms = stanzas.filter(F.trim("value").startswith("[Term]") & F.col("value").rlike(rf"(?m)^namespace: {namespace}\s*$"))
    terms = terms.filter(~F.col("value").rlike(r"(?m)^is_obsolete: true"))
    child = F.regexp_extract("value", r"(?m)^id: (\S+)", 1)

    def edges(pattern: str, relation: str) -> DataFrame:
        parents = F.regexp_extract_all("value", F.lit(pattern), F.lit(1))
        return terms.select(child.alias("child"), F.explode(parents).alias("parent"), F.lit(relation).alias("relation"))

    return edges(r"(?m)^is_a: (\S+)", "is_a").unionByName(edges(r"(?m)^relationship: part_of (\S+)", "part_of"))


def read_obo_edges(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    return parse_obo_edges(spark.read.option("lineSep", "\n\n").text(path), namespace)


KGML_SCHEMA = """_name STRING, entry ARRAY<STRUCT<_id: STRING, _name: STRING, _type: STRING, component: ARRAY<STRUCT<_id: STRING>>>>,
 relation ARRAY<STRUCT<_entry1: STRING, _entry2: STRING, _type: STRING>>"""


def kgml_tables(pathways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested pathways -> entries (pathway_id, entry_id, gene) with groups resolved to their components'
    genes, and relations (pathway_id, entry1, entry2, type)."""
    pid = F.element_at(F.split("_name", ":"), -1).alias("pathway_id")
    entry = pathways.select(pid, F.explode("entry").alias("e"))
    genes = entry.filter("e._type = 'gene'").select("pathway_id", F.col("e._id").alias("entry_id"), F.explode(F.split("e._name", r"\s+")).alias("gene"))
    parts = entry.filter("e._type = 'group'").select("pathway_id", F.col("e._id").alias("group_id"), F.explode("e.component").alias("c"))
    in_groups = parts.select("pathway_id", "group_id", F.col("c._id").alias("entry_id")).join(genes, ["pathway_id", "entry_id"])
    entries = genes.unionByName(in_groups.select("pathway_id", F.col("group_id").alias("entry_id"), "gene"))
    relations = pathways.select(pid, F.explode("relation").alias("r")).select(
        "pathway_id", F.col("r._entry1").alias("entry1"), F.col("r._entry2").alias("entry2"), F.col("r._type").alias("type")
    )
    return entries, relations


def parse_kgml(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pathway documents, one per row."""
    body = F.regexp_replace("value", r"(?s)^.*?(?=<pathway\b)", "")
    parsed = docs.select(F.from_xml(body, KGML_SCHEMA, {"rowTag": "pathway"}).alias("p")).select("p.*")
    return kgml_tables(parsed)


def read_kgml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_kgml(spark.read.text(path, wholetext=True))


def parse_pathway_index(lines: DataFrame) -> DataFrame:
    """Hierarchy lines (`line_no`, `value`) -> (pathway_id, name, class): `A` lines open a class, `C` lines are
    pathways. The order carries the meaning: lines are read in ranges, each with the class that was open before it."""
    opened = F.when(F.col("value").startswith("A"), F.regexp_extract("value", r"^A(?:<b>|\d+\s+)?([^<]*)", 1))
    order = [F.col("line_no")]
    rows = scan(ranged(lines, [], order), [], order, opened, "class", "last").filter(F.col("value").startswith("C"))
    pattern = r"^C\s+(\S+)\s*(.*)$"
    return rows.select(F.regexp_extract("value", pattern, 1).alias("pathway_id"), F.trim(F.regexp_extract("value", pattern, 2)).alias("name"), F.trim("class").alias("class"))


def read_pathway_index(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return parse_pathway_index(whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value")))


# --- gold-standard sources -------------------------------------------------------------------


def parse_complexes(lines: DataFrame, fmt: str) -> DataFrame:
    """(complex, species, member). corum: `;` lists; portal: `|` lists of `ID(stoichiometry)`, small molecules
    left out, chains reduced to their protein; mitab: complex rows, isoforms cut."""
    if fmt == "corum":
        rows = fields(lines, {"complex": 1, "species": 2, "members": 5})
        return rows.select("complex", "species", F.explode(F.split("members", ";")).alias("member")).distinct()
    if fmt == "portal":
        rows = fields(lines, {"complex": 0, "members": 4}).select("complex", F.explode(F.split("members", r"\|")).alias("m"))
        kept = rows.filter(~F.col("m").contains("CHEBI") & F.col("m").contains("("))
        bare = F.element_at(F.split("m", r"\("), 1)
        chain = F.when(F.col("m").contains("-PRO_"), F.element_at(F.split(bare, "-"), 1)).otherwise(bare)
        return kept.select("complex", F.lit(None).cast("string").alias("species"), chain.alias("member")).distinct()
    rows = fields(lines, {"id_a": 0, "id_b": 1, "tax_b": 10}).filter(F.col("id_a").contains("complex") & F.col("id_b").contains("uniprot"))
    member = F.element_at(F.split(F.element_at(F.split("id_b", ":"), 2), "-"), 1)
    species = F.regexp_extract("tax_b", r"taxid:(\d+)", 1)
    return rows.select(F.element_at(F.split("id_a", ":"), 2).alias("complex"), species.alias("species"), member.alias("member")).filter("species <> ''").distinct()


def read_complexes(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return parse_complexes(text(spark, path), fmt)


def parse_operons(lines: DataFrame) -> DataFrame:
    rows = fields(lines, {"operon": 0, "species": 1, "members": 3})
    return rows.select("operon", "species", F.explode(F.split("members", ",")).alias("member")).distinct()


def read_operons(spark: SparkSession, path: str) -> DataFrame:
    return parse_operons(text(spark, path))


def parse_regulatory(lines: DataFrame, fmt: str) -> DataFrame:
    """(name_a, name_b, direction 2) of rows that state a regulation; a missing sign counts as unknown."""
    sep, (a, b, sign), words = REGULATORY_FORMATS[fmt]
    rows = fields(lines, {"name_a": a, "name_b": b, "sign": sign}, sep=sep)
    if fmt == "yeastract":
        rows = rows.fillna("Unknown", ["sign"]).withColumn("sign", F.when(F.trim("sign") == "", "Unknown").otherwise(F.col("sign")))
    return rows.filter(F.col("sign").isin(words)).select("name_a", "name_b", F.lit(2).alias("direction"))


def read_regulatory(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return parse_regulatory(text(spark, path), fmt)


def parse_tissue_calls(lines: DataFrame, fmt: str) -> DataFrame:
    names = {
        "hpa": {"gene": 0, "tissue": 2, "level": 4, "reliability": 5},
        "bgee": {"gene": 0, "tissue": 3, "expression": 4, "call_quality": 5},
    }[fmt]
    return fields(lines, names).filter(~F.col("gene").isin("Gene", "Gene ID"))


def read_tissue_calls(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return parse_tissue_calls(text(spark, path), fmt)


def parse_homolog_hits(lines: DataFrame) -> DataFrame:
    """(query, subject, evalue, bitscore); ids are the middle part of `db|ACC|NAME`."""
    rows = fields(lines, {"query": 0, "subject": 1, "evalue": 2, "bitscore": 3})
    acc = lambda c: F.get(F.split(c, r"\|"), F.lit(1)).alias(c)
    return rows.select(acc("query"), acc("subject"), F.col("evalue").cast("double").alias("evalue"), F.col("bitscore").cast("double").alias("bitscore"))


def read_homolog_hits(spark: SparkSession, path: str) -> DataFrame:
    return parse_homolog_hits(text(spark, path))


# --- species relations -----------------------------------------------------------------------


def parse_distance_matrix(files: DataFrame) -> DataFrame:
    """Square matrix, one file per row, first line the tax ids -> (tax_a, tax_b, distance). Header words of up
    to two letters are not species. A matrix is as large as the list of species squared."""
    rows = F.filter(F.split("value", r"\r?\n"), lambda r: F.btrim(r, F.lit(" \t")) != "")
    head = F.transform(F.split(F.get(rows, F.lit(0)), "\t"), lambda t: F.trim(t))
    named = files.select(rows.alias("_r"), F.filter(head, lambda t: F.length(t) > 2).alias("_n"))
    each = named.select("_n", F.posexplode(F.slice("_r", F.lit(2), F.size("_r"))).alias("i", "line"))
    cells = each.select("_n", "i", F.posexplode(F.split(F.btrim("line", F.lit(" \t")), "\t")).alias("j", "d"))
    return cells.select(F.get("_n", F.col("i")).alias("tax_a"), F.get("_n", F.col("j")).alias("tax_b"), F.col("d").cast("double").alias("distance"))


def read_distance_matrix(spark: SparkSession, path: str) -> DataFrame:
    return parse_distance_matrix(spark.read.text(path, wholetext=True))


def parse_taxonomy(lines: DataFrame) -> DataFrame:
    parts = F.split("value", r"\|")
    return lines.filter(F.trim("value") != "").select(*[F.btrim(F.get(parts, F.lit(i)), F.lit(" \t")).alias(n) for i, n in enumerate(("tax_id", "parent", "rank"))])


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return parse_taxonomy(text(spark, path))


# --- own files, peak metadata ----------------------------------------------------------------


def read_network_tsv(spark: SparkSession, path: str, cols: list[str] | None = None, min_ppv: float | None = None) -> DataFrame:
    """Own network files: `i:Name` headers lose their number, numbers are typed; the confidence cut is made
    while reading."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    names = {c: c.split(":", 1)[-1] for c in raw.columns}
    numeric = ("PPV", "FBS", "LLR")
    typed = raw.select(*[(F.col(f"`{c}`").cast("double") if n.startswith(numeric) else F.col(f"`{c}`")).alias(n) for c, n in names.items()])
    if min_ppv is not None:
        typed = typed.filter(F.col("PPV") >= min_ppv)
    return typed.select(*cols) if cols else typed


def peak_file_index(experiments: DataFrame, files: DataFrame, species: str, preferred_only: bool = True) -> DataFrame:
    """(file, tf, experiment): peak files of the experiments on a species' factors. `experiments` has accession
    and target (`/targets/TF-species/`), `files` accession, dataset (`/experiments/ACC/`), preferred_default."""
    target = F.regexp_extract("target", rf"/targets/(.*?)-{species}", 1)
    exp = experiments.select(F.col("accession").alias("experiment"), target.alias("tf")).filter("tf <> ''")
    acc = F.element_at(F.split("dataset", "/"), -2)
    peaks = files.select(F.col("accession").alias("file"), acc.alias("experiment"), F.coalesce("preferred_default", F.lit(False)).alias("preferred"))
    joined = peaks.join(exp, "experiment")
    return (joined.filter("preferred") if preferred_only else joined).select("file", "tf", "experiment")


def read_peak_file_index(spark: SparkSession, experiments: str, files: str, species: str, preferred_only: bool = True) -> DataFrame:
    e = spark.read.schema("accession STRING, target STRING").json(experiments)
    f = spark.read.schema("accession STRING, dataset STRING, preferred_default BOOLEAN").json(files)
    return peak_file_index(e, f, species, preferred_only)
