"""Each format from a small file."""

import gzip

from pyspark.sql import functions as F

from linkweave.operators import filters as P
from linkweave.sources import readers as S


def put(tmp_path, name, text):
    path = tmp_path / name
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "p.fasta.gz", ">sp|P1|A_HUMAN Protein one OS=Homo sapiens\nMKV\n>tr|Q2|B_HUMAN Two OS=x\nMM\n")
    got = [tuple(r) for r in S.read_fasta_headers(spark, path, "9606").orderBy("uniprot_id").collect()]
    assert got == [("P1", "A_HUMAN Protein one", "9606"), ("Q2", "B_HUMAN Two", "9606")]


def test_idmapping(spark, tmp_path):
    path = put(tmp_path, "m.gz", "P1-2\tEnsembl\tENSG1.3\nP1\tGene_Name\tABC\nP1\tPubMed\t1\n")
    assert {tuple(r) for r in S.read_idmapping(spark, path).collect()} == {("P1", "Ensembl", "ENSG1"), ("P1", "Gene_Symbol", "ABC")}


def test_species_index(spark, tmp_path):
    lines = [
        "UP000005640\t9606\tHUMAN\teukaryota\t1\t2\t3\tHomo sapiens (Human)",
        "UP000000625\t83333\tECOLI\tbacteria\t1\t2\t3\tEscherichia coli (strain K12)",
        "UP000002311\t559292\tYEAST\teukaryota\t1\t2\t3\tSaccharomyces cerevisiae (strain S288c) (Baker's yeast)",
        "UP000001\t7\tX\teukaryota\tSp five\tSp five\n",
        "header line",
    ]
    got = {r.tax_id: (r.species_name, r.common_name) for r in S.read_species_index(spark, put(tmp_path, "README", "\n".join(lines))).collect()}
    assert got["9606"] == ("Homo sapiens", "Human")
    assert got["83333"] == ("Escherichia coli (strain K12)",) * 2
    assert got["559292"] == ("Saccharomyces cerevisiae (strain S288c)", "Baker's yeast")
    assert got["7"] == ("Sp five", "Sp five")


def test_ortholog_groups_of_two_files(spark, tmp_path):
    d = tmp_path / "groups"
    d.mkdir()
    put(d, "9606-10090", "1\t100\t9606.fa\t1.0\tA\t100%\n1\t100\t10090.fa\t1.0\tB\n")
    put(d, "9606-7227", "1\t90\t9606.fa\t1.0\tA\n1\t90\t7227.fa\t0.5\tC\n")
    from linkweave.operators.reports import build_orthologs

    groups = S.read_ortholog_groups(spark, str(d))
    ids = spark.createDataFrame([("A", 1, "9606"), ("B", 2, "10090"), ("C", 3, "7227")], "mapped_id string, protein_id long, tax_id string")
    got = {tuple(r) for r in build_orthologs(groups, ids).collect()}
    assert got == {(2, 1, "10090", "9606"), (1, 3, "9606", "7227")}


def test_mitab_complex_and_pair(spark, tmp_path):
    def row(**kw):
        cells = ["-"] * 53
        for k, v in kw.items():
            cells[S.MITAB[k]] = v
        return "\t".join(cells)

    text = "#uidA\theader\n" + "\n".join(
        [
            row(id_a="uniprotkb:P1-2", id_b="uniprotkb:P2\u0000", tax_a="taxid:9606(x)", tax_b="taxid:9606(x)", method='psi-mi:"MI:0018"(two hybrid)', pmid="pubmed:1|pubmed:2",
                edge_type="X", itype='psi-mi:"MI:0915"(physical association)', confidence="hpr:1|lpr:20|np:3"),
            row(id_a="complex:C1", id_b="uniprotkb:P3", tax_b="taxid:9606(x)", pmid="pubmed:5", edge_type="C"),
            row(id_a="complex:C1", id_b="uniprotkb:P4", tax_b="taxid:9606(x)", pmid="pubmed:5", edge_type="C"),
            row(id_a="refseq:N", id_b="uniprotkb:P4", tax_a="taxid:9606", tax_b="taxid:9606", pmid="-", edge_type="X"),
        ]
    )
    m = S.read_mitab(spark, put(tmp_path, "i.mitab", text))
    clean = P.interaction_rows(P.same_species(m)).collect()
    assert {(r.protein_a, r.protein_b, r.method, r.pmid, r.is_complex) for r in clean} == {
        ("P1-2", "P2", "MI:0018", "pubmed:2", False), ("complex:C1", "P3", "MI:0000", "pubmed:5", True), ("complex:C1", "P4", "MI:0000", "pubmed:5", True)
    }
    from linkweave.operators.evidence import expand_complexes

    assert [tuple(r) for r in expand_complexes(P.interaction_rows(m)).collect()] == [("P4", "P3", "MI:0000|complex:C1|2", "pubmed:5")]
    assert [tuple(r) for r in P.ppi_rows(m).collect()] == [("P1", "P2", "9606", 3)]


def test_genetic_domain_and_hits(spark, tmp_path):
    g = ["-"] * 15
    g[2], g[3], g[6], g[14] = "entrez:1|uniprot/swiss-prot:p1|x", "uniprot/swiss-prot:P2", "genetic interference", "score:-0.3"
    bad = list(g)
    bad[14] = "-"
    path = put(tmp_path, "b.mitab", "\t".join(g) + "\n" + "\t".join(bad) + "\n")
    assert [tuple(r) for r in S.read_genetic_mitab(spark, path, "4932").collect()] == [("P1", "P2", -0.3, "4932")]
    d = lambda s: "\t".join(["PF1", "PF2", *["x"] * 21, s])
    path = put(tmp_path, "d.tsv", "\n".join(["title"] * 10 + [d("0,75"), d("0")]))
    assert [tuple(r) for r in S.read_domain_interactions(spark, path).collect()] == [("PF1", "PF2", 0.75)]
    path = put(tmp_path, "h.txt", "# scan\n\nsp|P1|X_Y   1 20   1 22 PF00001.5  name\n")
    assert [tuple(r) for r in S.read_domain_hits(spark, path).collect()] == [("P1", "PF00001")]


def test_targets_are_distinct(spark, tmp_path):
    path = put(tmp_path, "t.tsv", "mir-1\tx\tG1\nmir-1\tx\tG1\nmir-1\ty\tG2\n")
    assert S.read_mirna_targets(spark, path).count() == 2
    row = lambda tax: "\t".join(["TF", "G", *["x"] * 6, tax])
    assert S.read_tf_targets(spark, put(tmp_path, "tf.tsv", row("9606") + "\n" + row("10090")), "9606").count() == 1


def test_abundance_headers_join_their_rows(spark, tmp_path):
    d = tmp_path / "9606"
    d.mkdir()
    body = "9606.G1\t3.5\n9606.G2\t1\n"
    put(d, "9606-liver.txt", "#name: x\n#organ: LIVER\n#filename: 9606-liver_a.txt\n" + body)
    put(d, "9606-whole.txt", "#organ: WHOLE_ORGANISM\n" + body)
    put(d, "9606-integrated.txt", "#organ: BRAIN\n" + body)
    got = {tuple(r) for r in S.read_abundance(spark, str(d)).collect()}
    assert got == {("9606", "LIVER", "liver_a", "G1", 3.5), ("9606", "LIVER", "liver_a", "G2", 1.0)}


def test_expression_and_quality(spark, tmp_path):
    text = "gene\ts1\ts2\ts3\ts4\ts5\ts6\nA\t1\t2\t3\t4\t5\t6\nB\t0\t0\t1\t2\t3\t4\nC\t1\t2\t3\t4\t5\t6\nD /// E\t1\tNA\t3\t4\t5\t7\n"
    long = S.read_expression(spark, put(tmp_path, "e.tsv", text))
    assert long.count() == 24
    split = P.explode_probes(long)
    assert {r.gene for r in split.select("gene").distinct().collect()} == {"A", "B", "C", "D", "E"}
    ids = split.withColumn("protein_id", F.ascii("gene"))
    kept = {chr(r.protein_id) for r in P.quality_check(ids.select("protein_id", "sample", "value"), 6).select("protein_id").distinct().collect()}
    assert kept == {"A", "D"}  # B has too many zeros, C repeats A, E repeats D


def test_genome_files(spark, tmp_path):
    d = tmp_path / "peaks"
    d.mkdir()
    put(d, "F1.bed", "chr1\t10\t20\tp\t0\t.\t7.5\t-1\t-1\t5\n")
    assert [tuple(r) for r in S.read_narrowpeak(spark, str(d)).collect()] == [("F1", "chr1", 10, 20, 7.5)]
    gtf = '#!x\n1\te\tgene\t5\t15\t.\t+\t.\tgene_id "ENSG1"; gene_name "ABC"; gene_biotype "protein_coding";\n1\te\tgene\t5\t15\t.\t+\t.\tgene_id "ENSG2"; gene_biotype "lncRNA";\n'
    genes = S.read_gtf_genes(spark, put(tmp_path, "g.gtf", gtf))
    assert [tuple(r) for r in genes.collect()] == [("chr1", 5, 15, "+", "ensg1", "abc")]
    ids = spark.createDataFrame([("ABC", 1)], "mapped_id string, protein_id long")
    assert S.annotate_genes(genes, ids).first().protein_id == 1


def test_gaf_and_obo(spark, tmp_path):
    row = ["db", "P1", "x", "part_of", "GO:1", "r", "IDA", *["x"] * 5, "taxon:9606"]
    gaf = S.read_gaf(spark, put(tmp_path, "a.gaf", "!gaf-version\n" + "\t".join(row) + "\n"))
    assert tuple(P.filter_taxon(gaf, "9606").first()) == ("P1", "part_of", "GO:1", "IDA", "taxon:9606")
    obo = "format-version: 1.2\n\n[Term]\nid: GO:3\nnamespace: cellular_component\nis_a: GO:2 ! two\nrelationship: part_of GO:1 ! one\n\n[Term]\nid: GO:9\nnamespace: biological_process\nis_a: GO:8\n"
    got = {tuple(r) for r in S.read_obo_edges(spark, put(tmp_path, "g.obo", obo), "cellular_component").collect()}
    assert got == {("GO:3", "GO:2", "is_a"), ("GO:3", "GO:1", "part_of")}


def test_kgml_groups(spark, tmp_path):
    xml = """<?xml version="1.0"?>
<!DOCTYPE pathway SYSTEM "x">
<pathway name="path:hsa1" org="hsa"><entry id="1" name="hsa:1 hsa:2" type="gene"/><entry id="2" name="hsa:3" type="gene"/>
<entry id="3" name="undefined" type="group"><component id="1"/><component id="2"/></entry>
<relation entry1="2" entry2="3" type="PPrel"/><relation entry1="1" entry2="2" type="maplink"/></pathway>"""
    entries, relations = S.read_kgml(spark, put(tmp_path, "k.xml", xml))
    from linkweave.operators.goldstandard import pathway_relation_pairs

    assert {(r.name_a, r.name_b) for r in pathway_relation_pairs(entries, relations).collect()} == {("hsa:3", "hsa:1"), ("hsa:3", "hsa:2")}


def test_pathway_index(spark, tmp_path):
    text = "+D\tx\nA<b>Metabolism</b>\nB x\nC    00010 Glycolysis\nC    01100 Global\nA<b>Human Diseases</b>\nC    05200 Cancer signal\n"
    index = S.read_pathway_index(spark, put(tmp_path, "k.txt", text))
    prev = spark.createDataFrame([("00099",), ("01100",)], "pathway_id string")
    got = {(r.pathway_id, r.status) for r in P.select_pathways(index, "Metabolic", prev).collect()}
    assert got == {("00010", "added"), ("00099", "removed"), ("01100", "kept")}
    assert P.select_pathways(index, "Signaling", prev.filter("false")).count() == 0


def test_complex_operon_regulatory(spark, tmp_path):
    path = put(tmp_path, "c.tsv", "1\tcx\tHuman\tx\tx\tP1;P2\n")
    assert {r.member for r in S.read_complexes(spark, path, "corum").collect()} == {"P1", "P2"}
    path = put(tmp_path, "p.tsv", "#Complex ac\nCPX-1\tn\ta\t9606\tP1(1)|CHEBI:5(1)|P2-PRO_01(0)|P3\n")
    assert {r.member for r in S.read_complexes(spark, path, "portal").collect()} == {"P1", "P2"}
    path = put(tmp_path, "m.tsv", "\t".join(["complex:C1", "uniprotkb:P7-2", *["-"] * 8, "taxid:9606(x)"]))
    assert tuple(S.read_complexes(spark, path, "mitab").first()) == ("C1", "9606", "P7")
    assert S.read_operons(spark, put(tmp_path, "o.tsv", "o1\tceg\tx\ta,b,c\n")).count() == 3
    assert S.read_regulatory(spark, put(tmp_path, "r.txt", "TF 1 G 2 -->\nTF 1 H 2 -p\n"), "regnetwork").count() == 1
    path = put(tmp_path, "y.tsv", "x\tTF\tx\tG\tx\tPositive\nx\tTF\tx\tH\tx\t\n")
    assert S.read_regulatory(spark, path, "yeastract").count() == 2


def test_tissues(spark, tmp_path):
    rows = "Gene\tName\tTissue\tCell\tLevel\tReliability\nG1\tn\tLIVER \tc\tHigh\tApproved\nG2\tn\tliver\tc\tHigh\tUncertain\nG3\tn\tliver\tc\tNot detected\tApproved\n"
    calls = S.read_tissue_calls(spark, put(tmp_path, "t.tsv", rows), "hpa")
    assert [tuple(r) for r in P.tissue_rows(calls, "hpa").collect()] == [("G1", "Liver")]
    rows = 'G1\tn\ti\t"big brain (adult)"\tpresent\tgold quality\nG2\tn\ti\tx\tabsent\tgold quality\n'
    calls = S.read_tissue_calls(spark, put(tmp_path, "b.tsv", rows), "bgee")
    assert [tuple(r) for r in P.tissue_rows(calls, "bgee").collect()] == [("G1", "Big brain")]


def test_distances_taxonomy_homologs_peaks(spark, tmp_path):
    path = put(tmp_path, "m.txt", "x\t9606\t10090\t7227\n0\t1\t2\n1\t0\t3\n2\t3\t0\n")
    got = {(r.tax_a, r.tax_b): r.distance for r in S.read_distance_matrix(spark, path).collect()}
    assert got[("9606", "7227")] == 2.0 and len(got) == 9
    assert tuple(S.read_taxonomy(spark, put(tmp_path, "n.dmp", "9606\t|\t9605\t|\tspecies\t|\n")).first()) == ("9606", "9605", "species")
    assert tuple(S.read_homolog_hits(spark, put(tmp_path, "h.tsv", "sp|A|x\tsp|B|y\t1e-5\t80\n")).first()) == ("A", "B", 1e-5, 80.0)
    e = put(tmp_path, "e.json", '{"accession":"E1","target":"/targets/CTCF-human/"}\n{"accession":"E2","target":"/targets/CTCF-mouse/"}\n')
    f = put(tmp_path, "f.json", '{"accession":"F1","dataset":"/experiments/E1/","preferred_default":true}\n{"accession":"F2","dataset":"/experiments/E1/"}\n{"accession":"F3","dataset":"/experiments/E2/","preferred_default":true}\n')
    assert [tuple(r) for r in S.read_peak_file_index(spark, e, f, "human").collect()] == [("F1", "CTCF", "E1")]
