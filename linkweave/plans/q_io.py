"""Registered queries: file formats. The lines of each format are written by Spark from the given tables and
read back by the format's reader; sinks are written to the shared folder and read again."""

import uuid

from pyspark.sql import functions as F

from linkweave.operators import queries as R
from linkweave.operators.pairs import node_stats
from linkweave.plans import fixtures as X
from linkweave.plans import q_training as T
from linkweave.plans.registry import QUERIES, query, table
from linkweave.session import ensure_checkpoint_dir
from linkweave.sinks import writers as K
from linkweave.sources import readers as S


def folder(spark, name: str) -> str:
    """A new place in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def lines(df, *cols, sep="\t"):
    return df.select(F.concat_ws(sep, *cols).alias("value"))


# --- sources ---------------------------------------------------------------------------------


@query("s01_read_fasta_headers", "SELECT 'P' || p_partkey AS uniprot_id, 'NAME ' || p_name AS description, '9606' AS tax_id FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    head = F.concat(F.lit(">sp|P"), "p_partkey", F.lit("|NAME "), "p_name", F.lit(" OS=Homo sapiens"))
    rows = p.select(F.explode(F.array(head, F.upper("p_name"))).alias("value"))
    path = folder(spark, "fasta")
    rows.write.option("compression", "gzip").text(path)
    return S.read_fasta_headers(spark, path, "9606")


@query(
    "s02_read_idmapping",
    """SELECT 'P' || l_partkey AS acc, CASE l_returnflag WHEN 'A' THEN 'Ensembl' ELSE 'Gene_Symbol' END AS type, CASE l_returnflag WHEN 'A' THEN 'E' || l_suppkey ELSE 'E' || l_suppkey || '.' || l_linenumber END AS mapped_id FROM lineitem WHERE l_returnflag <> 'R'""",
)
def _(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "EnsemblGenome").when(F.col("l_returnflag") == "N", "Gene_Name").otherwise("PubMed")
    acc = F.concat(F.lit("P"), "l_partkey", F.when(F.col("l_linenumber") > 3, "-2").otherwise(""))
    ids = F.concat(F.lit("E"), "l_suppkey", F.lit("."), "l_linenumber")
    return S.parse_idmapping(lines(table(spark, sf, "lineitem"), acc, kind, ids))


@query(
    "s03_read_species_index",
    """SELECT 'UP0' || c_custkey AS proteome_id, c_nationkey::VARCHAR AS tax_id, 'eukaryota' AS domain,
       CASE WHEN c_acctbal < 0 THEN 'Sp ' || c_custkey || ' (strain K' || c_nationkey || ')' ELSE 'Sp ' || c_custkey END AS species_name,
       CASE WHEN c_acctbal < 0 THEN 'Common ' || c_mktsegment WHEN c_acctbal < 5000 THEN c_mktsegment ELSE 'Sp ' || c_custkey END AS common_name FROM customer""",
)
def _(spark, sf):
    sp = F.concat(F.lit("Sp "), "c_custkey")
    strain = F.concat(sp, F.lit(" (strain K"), "c_nationkey", F.lit(") (Common "), "c_mktsegment", F.lit(")"))
    full = F.when(F.col("c_acctbal") < 0, strain).when(F.col("c_acctbal") < 5000, F.concat(sp, F.lit(" ("), "c_mktsegment", F.lit(")"))).otherwise(sp)
    cols = [F.concat(F.lit("UP0"), "c_custkey"), F.col("c_nationkey").cast("string"), F.lit("OS"), F.lit("eukaryota"), F.lit("1"), F.lit("2"), F.lit("3"), full]
    return S.parse_species_index(lines(table(spark, sf, "customer"), *cols))


@query("s04_read_ortholog_groups", """SELECT l_orderkey::VARCHAR AS "group", l_quantity AS bitscore, l_suppkey::VARCHAR AS tax_id, l_tax AS inparalog_score, 'P' || l_partkey AS protein FROM lineitem""")
def _(spark, sf):
    cols = ["l_orderkey", "l_quantity", F.concat("l_suppkey", F.lit(".fa")), "l_tax", F.concat(F.lit("P"), "l_partkey")]
    return S.parse_ortholog_groups(lines(table(spark, sf, "lineitem"), *cols)).drop("seed_score")


def _mitab_lines(spark, sf):
    m = X.mitab(spark, sf)
    cells = [F.lit("-")] * 53
    for name, i in S.MITAB.items():
        cells[i] = F.col(name)
    return m.select(F.concat_ws("\t", *cells).alias("value"))


@query("s05_read_mitab", "SELECT id_a, id_b, alt_a, pmid, tax_b, edge_type FROM mitab", "mitab")
def _(spark, sf):
    path = folder(spark, "mitab")
    _mitab_lines(spark, sf).write.text(path)
    return S.read_mitab(spark, path, ["id_a", "id_b", "alt_a", "pmid", "tax_b", "edge_type"])


@query(
    "s06_read_genetic_mitab",
    "SELECT 'P' || l_partkey AS gene_a, 'Q' || l_suppkey AS gene_b, l_discount AS score, '4932' AS tax_id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'",
)
def _(spark, sf):
    cells = [F.lit("-")] * 15
    cells[2], cells[3] = F.concat(F.lit("uniprot/swiss-prot:p"), "l_partkey", F.lit("|x")), F.concat(F.lit("uniprot/swiss-prot:q"), "l_suppkey")
    cells[6] = F.when(F.col("l_returnflag") == "R", "negative genetic interaction").otherwise("direct")
    cells[14] = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("score:"), "l_discount")).otherwise("-")
    return S.parse_genetic_mitab(lines(table(spark, sf, "lineitem"), *cells), "4932")


@query("s07_read_domain_interactions", "SELECT p_brand AS domain_a, p_type AS domain_b, p_retailprice AS score FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_discount > 0")
def _(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    cells = [F.lit("-")] * 24
    cells[0], cells[1] = F.col("p_brand"), F.col("p_type")
    cells[23] = F.when(F.col("l_discount") > 0, F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))).otherwise("0,0")
    return S.parse_domain_interactions(lines(p.join(li, F.col("l_partkey") == F.col("p_partkey")), *cells))


@query("s08_read_domain_hits", "SELECT 'P' || l_partkey AS protein, 'PF' || l_suppkey AS domain FROM lineitem")
def _(spark, sf):
    row = F.concat(F.lit("sp|P"), "l_partkey", F.lit("|X   1  9  2   8  PF"), "l_suppkey", F.lit(".5   name"))
    return S.parse_domain_hits(table(spark, sf, "lineitem").select(row.alias("value")))


@query("s09_read_mirna_targets", "SELECT DISTINCT 'mir-' || l_suppkey AS mirna, 'g' || l_partkey AS gene FROM lineitem")
def _(spark, sf):
    return S.parse_mirna_targets(lines(table(spark, sf, "lineitem"), F.concat(F.lit("mir-"), "l_suppkey"), "l_orderkey", F.concat(F.lit("g"), "l_partkey")))


@query("s10_read_tf_targets", "SELECT DISTINCT 'tf' || l_suppkey AS tf, 'g' || l_partkey AS gene, l_returnflag AS tax_id FROM lineitem WHERE l_returnflag = 'A'")
def _(spark, sf):
    cells = [F.concat(F.lit("tf"), "l_suppkey"), F.concat(F.lit("g"), "l_partkey"), *[F.lit("x")] * 6, F.col("l_returnflag")]
    return S.parse_tf_targets(lines(table(spark, sf, "lineitem"), *cells), "A")


@query(
    "s11_read_abundance",
    """SELECT '9606' AS tax_id, organ, 'f_' || l_suppkey AS filename, 'G' || l_partkey AS gene, l_quantity AS value FROM
       (SELECT *, CASE WHEN s_acctbal < 0 THEN 'CELL_LINE' WHEN s_acctbal < 5000 THEN 'LIVER' ELSE 'BRAIN' END AS organ FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) WHERE organ <> 'CELL_LINE'""",
)
def _(spark, sf):
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    file = lambda c: F.concat(F.lit("9606-"), c, F.lit(".txt")).alias("file")
    organ = F.when(F.col("s_acctbal") < 0, "CELL_LINE").when(F.col("s_acctbal") < 5000, "LIVER").otherwise("BRAIN")
    heads = s.select(file("s_suppkey"), F.explode(F.array(F.concat(F.lit("#organ: "), organ), F.concat(F.lit("#filename: 9606-f_"), "s_suppkey", F.lit(".txt")))).alias("value"))
    rows = li.select(file("l_suppkey"), F.concat(F.lit("9606.G"), "l_partkey", F.lit("\t"), "l_quantity").alias("value"))
    return S.parse_abundance(heads.unionByName(rows))


@query(
    "s12_read_expression",
    """SELECT 'V' || vec_id AS gene, 's' || (generate_subscripts(embedding, 1) - 1) AS sample, round_even(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    wide = e.select(F.concat(F.lit("V"), "vec_id").alias("gene"), *[F.col("embedding")[i].cast("double").alias(f"s{i}") for i in range(64)])
    path = folder(spark, "expression")
    wide.write.option("header", True).option("sep", "\t").csv(path)
    from linkweave.functions.columns import half_even

    return S.read_expression(spark, path).withColumn("value", half_even("value", 6))


@query("s13_read_narrowpeak", "SELECT 'chr' || user_id AS chrom, event_id AS start_p, event_id + 100 AS end_p, value FROM events")
def _(spark, sf):
    cells = [F.concat(F.lit("chr"), "user_id"), "event_id", F.col("event_id") + 100, F.lit("p"), F.lit("0"), F.lit("."), "value", F.lit("-1"), F.lit("-1"), F.lit("5")]
    return S.parse_narrowpeak(lines(table(spark, sf, "events"), *cells))


@query(
    "s14_read_gtf_genes",
    """SELECT DISTINCT 'chr' || s_nationkey AS chrom, s_suppkey AS start_g, s_suppkey + 1000 AS end_g, '+' AS strand, 'ens' || s_suppkey AS gene_id, lower(s_name) AS gene_name FROM supplier WHERE s_acctbal > 0""",
)
def _(spark, sf):
    kind = F.when(F.col("s_acctbal") > 0, "protein_coding").otherwise("lncRNA")
    attributes = F.concat(F.lit('gene_id "ENS'), "s_suppkey", F.lit('"; gene_name "'), "s_name", F.lit('"; gene_type "'), kind, F.lit('";'))
    cells = ["s_nationkey", F.lit("src"), F.lit("gene"), "s_suppkey", F.col("s_suppkey") + 1000, F.lit("."), F.lit("+"), F.lit("."), attributes]
    return S.parse_gtf_genes(lines(table(spark, sf, "supplier"), *cells))


@query("s15_read_gaf", "SELECT 'P' || l_partkey AS gene, 'part_of' AS association, 'GO:' || l_suppkey AS term, l_returnflag AS evidence_code, 'taxon:' || l_linenumber AS taxon FROM lineitem")
def _(spark, sf):
    cells = [F.lit("-")] * 13
    cells[1], cells[3], cells[4] = F.concat(F.lit("P"), "l_partkey"), F.lit("part_of"), F.concat(F.lit("GO:"), "l_suppkey")
    cells[6], cells[12] = F.col("l_returnflag"), F.concat(F.lit("taxon:"), "l_linenumber")
    return S.parse_gaf(lines(table(spark, sf, "lineitem"), *cells))


@query(
    "s16_read_obo_edges",
    """SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent, 'is_a' AS relation FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'c' || c_custkey, c_mktsegment, 'part_of' FROM customer WHERE c_acctbal > 0""",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    space = F.when(F.col("c_acctbal") > 0, "cellular_component").otherwise("molecular_function")
    stanza = F.concat(F.lit("[Term]\nid: c"), "c_custkey", F.lit("\nname: x\nnamespace: "), space, F.lit("\nis_a: n"), "c_nationkey", F.lit(" ! nation\nrelationship: part_of "), "c_mktsegment", F.lit(" ! x\n"))
    path = folder(spark, "obo")
    c.select(stanza.alias("value")).write.text(path)
    return S.read_obo_edges(spark, path, "cellular_component")


@query(
    "s17_read_kgml",
    """SELECT DISTINCT l_orderkey::VARCHAR AS pathway_id, 'e' || l_linenumber || '_' || l_suppkey || l_returnflag AS entry_id, 'sup:' || l_suppkey AS gene FROM lineitem
       UNION SELECT l_orderkey::VARCHAR, 'g', 'sup:' || l_suppkey FROM lineitem WHERE l_returnflag = 'R'""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    eid = F.concat(F.lit("e"), "l_linenumber", F.lit("_"), "l_suppkey", "l_returnflag")
    entry = F.concat(F.lit('<entry id="'), eid, F.lit('" name="sup:'), "l_suppkey", F.lit('" type="gene"/>'))
    part = F.when(F.col("l_returnflag") == "R", F.concat(F.lit('<component id="'), eid, F.lit('"/>')))
    xml = li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("e"), F.array_join(F.array_sort(F.collect_list(part)), "").alias("c"))
    group = F.when(F.col("c") != "", F.concat(F.lit('<entry id="g" name="undefined" type="group">'), "c", F.lit("</entry>"))).otherwise("")
    doc = F.concat(F.lit('<pathway name="path:'), "l_orderkey", F.lit('">'), "e", group, F.lit('<relation entry1="e1" entry2="g" type="PPrel"/></pathway>'))
    return S.parse_kgml(xml.select(doc.alias("value")))[0].distinct()


@query(
    "s18_read_pathway_index",
    """SELECT lpad(p_partkey::VARCHAR, 5, '0') AS pathway_id, p_name AS name, p_type AS class FROM part""",
)
def _(spark, sf):
    # class lines come before their pathways: line numbers leave room for them
    p = table(spark, sf, "part")
    types = p.select("p_type").distinct()
    from linkweave.functions.ordered import dense_ids

    ids = dense_ids(types, "p_type", "t")
    heads = ids.select((F.col("t").cast("long") * 1000000000).alias("line_no"), F.concat(F.lit("A<b>"), "p_type", F.lit("</b>")).alias("value"))
    rows = p.join(ids, "p_type").select((F.col("t").cast("long") * 1000000000 + F.col("p_partkey") + 1).alias("line_no"), F.concat(F.lit("C    "), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit(" "), "p_name").alias("value"))
    return S.parse_pathway_index(heads.unionByName(rows))


@query("s19_read_complexes", "SELECT DISTINCT 'c' || l_orderkey AS complex, 'Human' AS species, 'P' || l_partkey AS member FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("P"), "l_partkey")), ";").alias("m"))
    cells = [F.lit("1"), F.concat(F.lit("c"), "l_orderkey"), F.lit("Human"), F.lit("x"), F.lit("x"), "m"]
    return S.parse_complexes(lines(li, *cells), "corum")


@query("s20_read_operons", "SELECT DISTINCT 'o' || l_orderkey AS operon, 'eco' AS species, 'CELE_' || l_suppkey AS member FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("CELE_"), "l_suppkey")), ",").alias("m"))
    return S.parse_operons(lines(li, F.concat(F.lit("o"), "l_orderkey"), F.lit("eco"), F.lit("x"), "m"))


@query("s21_read_regulatory", "SELECT 'tf' || l_suppkey AS name_a, 'g' || l_partkey AS name_b, 2 AS direction FROM lineitem WHERE l_returnflag <> 'R'")
def _(spark, sf):
    sign = F.when(F.col("l_returnflag") == "A", "-->").when(F.col("l_returnflag") == "N", "--|").otherwise("-p")
    cells = [F.concat(F.lit("tf"), "l_suppkey"), F.lit("1"), F.concat(F.lit("g"), "l_partkey"), F.lit("2"), sign]
    return S.parse_regulatory(lines(table(spark, sf, "lineitem"), *cells, sep=" "), "regnetwork")


@query("s22_read_tissue_calls", "SELECT 'g' || c_custkey AS gene, c_mktsegment AS tissue, 'High' AS level, 'Approved' AS reliability FROM customer")
def _(spark, sf):
    cells = [F.concat(F.lit("g"), "c_custkey"), F.lit("n"), "c_mktsegment", F.lit("cell"), F.lit("High"), F.lit("Approved")]
    return S.parse_tissue_calls(lines(table(spark, sf, "customer"), *cells), "hpa")


@query("s23_read_homolog_hits", "SELECT 'P' || l_partkey AS query, 'P' || l_suppkey AS subject, l_tax AS evalue, l_quantity AS bitscore FROM lineitem")
def _(spark, sf):
    acc = lambda c: F.concat(F.lit("sp|P"), c, F.lit("|X"))
    return S.parse_homolog_hits(lines(table(spark, sf, "lineitem"), acc("l_partkey"), acc("l_suppkey"), "l_tax", "l_quantity"))


@query(
    "s24_read_distance_matrix",
    """WITH n AS (SELECT DISTINCT 'sp' || c_nationkey AS t, c_nationkey AS k FROM customer), c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1)
       SELECT x.t AS tax_a, y.t AS tax_b, (cx.n + cy.n)::DOUBLE AS distance FROM n x, n y, c cx, c cy WHERE cx.k = x.k AND cy.k = y.k""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    # one row per species, so the list is as long as the list of species
    every = c.agg(F.array_sort(F.collect_list(F.struct("c_nationkey", "n"))).alias("all"))
    head = F.concat(F.lit("\t"), F.array_join(F.transform("all", lambda e: F.concat(F.lit("sp"), e["c_nationkey"])), "\t"))
    body = F.transform("all", lambda x: F.array_join(F.transform("all", lambda e: (e["n"] + x["n"]).cast("string")), "\t"))
    return S.parse_distance_matrix(every.select(F.concat_ws("\n", head, body).alias("value")))


@query("s25_read_taxonomy", "SELECT c_custkey::VARCHAR AS tax_id, c_nationkey::VARCHAR AS parent, 'species' AS rank FROM customer")
def _(spark, sf):
    row = F.concat("c_custkey", F.lit("\t|\t"), "c_nationkey", F.lit("\t|\tspecies\t|"))
    return S.parse_taxonomy(table(spark, sf, "customer").select(row.alias("value")))


@query(
    "s27_peak_file_index",
    "SELECT 'F' || l_orderkey || '-' || l_linenumber AS file, 'TF' || o_custkey AS tf, 'E' || o_orderkey AS experiment FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' AND o_orderstatus = 'F'",
)
def _(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    species = F.when(F.col("o_orderstatus") == "F", "human").otherwise("mouse")
    experiments = o.select(F.concat(F.lit("E"), "o_orderkey").alias("accession"), F.concat(F.lit("/targets/TF"), "o_custkey", F.lit("-"), species, F.lit("/")).alias("target"))
    files = li.select(F.concat(F.lit("F"), "l_orderkey", F.lit("-"), "l_linenumber").alias("accession"), F.concat(F.lit("/experiments/E"), "l_orderkey", F.lit("/")).alias("dataset"), F.when(F.col("l_returnflag") == "A", True).alias("preferred_default"))
    e, f = folder(spark, "experiments"), folder(spark, "files")
    experiments.write.json(e)
    files.write.json(f)
    return S.read_peak_file_index(spark, e, f, "human")


# --- sinks -----------------------------------------------------------------------------------


@query("k01_write_links", "SELECT evidence_id, type, tax_id, a, b, score, direction FROM evidence_link WHERE type = 'MEX'", "evidence_link")
def _(spark, sf):
    path = folder(spark, "links")
    K.write_links(X.evidence_link(spark, sf), path)
    return spark.read.parquet(path).filter("type = 'MEX'").select("evidence_id", "type", "tax_id", "a", "b", "score", "direction")


def _protein(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("protein_id"), F.concat(F.lit("P"), "p_partkey").alias("uniprot_id"))


_FLAT = """WITH m AS (SELECT *, max(ppv) OVER (PARTITION BY a, b) AS top, row_number() OVER (PARTITION BY a, b ORDER BY ppv DESC, fbs DESC, pos) AS rn FROM final_gs)
   SELECT 'P' || a AS "ProteinA", 'P' || b AS "ProteinB", string_agg(left(gs, 1), '' ORDER BY pos) FILTER (ppv = top) AS "GoldStandard", any_value(top) AS "PPV", max(fbs) FILTER (rn = 1) AS "FBS_max",
     max(is_gs) FILTER (rn = 1)::VARCHAR AS "isGoldStandard", coalesce(CASE any_value(direction) WHEN 2 THEN '->' WHEN 3 THEN '<-' END, '') AS "GRG_direction"{more} FROM m GROUP BY a, b"""


def _written(spark, sf, compact):
    path = folder(spark, "network")
    K.write_network_tsv(T.network(spark, sf), _protein(spark, sf), path, compact=compact)
    return path


@query("k02_write_network_tsv", _FLAT.format(more=""", max(fbs) FILTER (gs = 'PPI') AS "FBS_PPI\""""), "final_gs")
def _(spark, sf):
    d = S.read_network_tsv(spark, _written(spark, sf, False), ["ProteinA", "ProteinB", "GoldStandard", "PPV", "FBS_max", "isGoldStandard", "GRG_direction", "FBS_PPI"])
    return d.fillna("", ["GRG_direction"])


@query("k03_write_compact_tsv", _FLAT.format(more=""), "final_gs")
def _(spark, sf):
    d = S.read_network_tsv(spark, _written(spark, sf, True)).drop("IdA", "IdB", "isPPVgoldstandard")
    return d.fillna("", ["GRG_direction"])


@query("s26_read_network_tsv", "WITH m AS (" + _FLAT.format(more="") + """) SELECT "ProteinA", "ProteinB", "PPV" FROM m WHERE "PPV" >= 0.95""", "final_gs")
def _(spark, sf):
    return S.read_network_tsv(spark, _written(spark, sf, True), ["ProteinA", "ProteinB", "PPV"], 0.95)


@query(
    "k05_subnetwork_json",
    """WITH l AS (SELECT x.query_id, a, b FROM net JOIN seeds x ON x.gene = a JOIN seeds y ON y.gene = b AND y.query_id = x.query_id), e AS (SELECT query_id, a AS node FROM l UNION ALL SELECT query_id, b FROM l)
       SELECT query_id, 'node' AS kind, '{"node":' || node || ',"degree":' || count(*) || '}' AS json FROM e GROUP BY query_id, node UNION ALL SELECT query_id, 'link', '{"a":' || a || ',"b":' || b || '}' FROM l""",
    "net seeds",
)
def _(spark, sf):
    links = R.induced_links(X.net(spark, sf), X.seeds(spark, sf)).select("query_id", "a", "b")
    return K.subnetwork_json(node_stats(links).select("query_id", "node", "degree"), links)


@query(
    "f07_json",
    "SELECT event_id, '{\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS json FROM events",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct("user_id", "event_type")).alias("json"))


@query("k06_gene_mapping_table", "SELECT DISTINCT m.mapped_id AS identifier, u.mapped_id AS accession FROM id_mapping m JOIN id_mapping u ON u.protein_id = m.protein_id AND u.type = 'UniProtID'", "id_mapping")
def _(spark, sf):
    m = X.id_mapping(spark, sf)
    return K.gene_mapping_table(m.select(F.col("mapped_id").alias("identifier")), m)


@query(
    "k07_species_table",
    """SELECT c_nationkey::VARCHAR AS tax_id, n_name AS species_name, r_name AS common_name, count(*) FILTER (c_acctbal > 9500) AS num_links, count(*) AS num_nodes, 'trained' AS origin
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL HAVING count(*) FILTER (c_acctbal > 9500) > 0""",
)
def _(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    s = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    stats = s.groupBy(F.col("c_nationkey").cast("string").alias("tax_id"), F.col("n_name").alias("species_name"), F.col("r_name").alias("common_name")).agg(
        F.count_if(F.col("c_acctbal") > 9500).alias("num_links"), F.count("*").alias("num_nodes"), F.lit("trained").alias("origin")
    )
    return K.species_table(stats)


@query("k09_enrichment_table")
def _(spark, sf):
    result = QUERIES["x07_combine_enrichment"](spark, sf)
    names = table(spark, sf, "part").select(F.col("p_brand").alias("pathway_id"), F.concat(F.lit("Pathway "), "p_brand").alias("pathway_name")).distinct()
    path = folder(spark, "enrichment")
    K.write_enrichment_tsv(result, names, path)
    return spark.read.option("header", True).option("sep", "\t").csv(path)

