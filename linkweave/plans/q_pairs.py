"""Registered queries: projections, filters, joins, set operations, aggregates and windows."""

from pyspark.sql import functions as F

from linkweave.functions.columns import half_even
from linkweave.functions import columns as C
from linkweave.functions import ordered as O
from linkweave.operators import filters as P
from linkweave.operators import normalise as N
from linkweave.operators import pairs as J
from linkweave.operators import tiles
from linkweave.plans import fixtures as X
from linkweave.plans.registry import query, table

# --- projections, filters --------------------------------------------------------------------


def _ends(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("f"))


@query(
    "p01_canonical_pair",
    """SELECT greatest(l_partkey, l_suppkey) AS a, least(l_partkey, l_suppkey) AS b, count(*) AS n
       FROM lineitem GROUP BY ALL""",
)
def _(spark, sf):
    return C.canonical_pair(_ends(spark, sf)).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(
    "p02_canonical_directed",
    """SELECT greatest(a, b) AS a, least(a, b) AS b,
       CASE WHEN a < b AND d = 2 THEN 3 WHEN a < b AND d = 3 THEN 2 ELSE d END AS direction, count(*) AS n
       FROM (SELECT l_partkey a, l_suppkey b, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 3 ELSE 0 END d FROM lineitem)
       WHERE a <> b GROUP BY ALL""",
)
def _(spark, sf):
    d = F.when(F.col("f") == "A", 2).when(F.col("f") == "R", 3).otherwise(0)
    df = C.canonical_directed(C.drop_self(_ends(spark, sf).withColumn("direction", d)))
    return df.groupBy("a", "b", "direction").agg(F.count("*").alias("n"))


@query("p03_drop_self", "SELECT l_partkey AS a, l_suppkey AS b, l_returnflag AS f FROM lineitem WHERE l_partkey <> l_suppkey")
def _(spark, sf):
    return C.drop_self(_ends(spark, sf))


_CLEAN_SQL = """SELECT CASE WHEN l_returnflag = 'R' THEN 'complex:' || l_orderkey ELSE 'P' || l_suppkey END AS protein_a,
       'P' || l_partkey || '-' || l_linenumber AS protein_b,
       CASE WHEN l_linestatus = 'O' THEN 'MI:00' || (l_linenumber + 10) ELSE 'MI:0000' END AS method,
       'pubmed:' || l_orderkey AS pmid, 'taxid:' || c_nationkey AS tax, l_returnflag = 'R' AS is_complex
       FROM mitab WHERE l_linenumber <> 7"""


@query("p04_extract_accession", f"SELECT protein_a, protein_b, count(*) AS n FROM ({_CLEAN_SQL}) GROUP BY ALL", "mitab")
def _(spark, sf):
    return P.interaction_rows(X.mitab(spark, sf)).groupBy("protein_a", "protein_b").agg(F.count("*").alias("n"))


@query("p05_clean_interactions", f"SELECT method, pmid, tax, is_complex, count(*) AS n FROM ({_CLEAN_SQL}) GROUP BY ALL", "mitab")
def _(spark, sf):
    return P.interaction_rows(X.mitab(spark, sf)).groupBy("method", "pmid", "tax", "is_complex").agg(F.count("*").alias("n"))


@query(
    "p06_same_species",
    """SELECT id_a, id_b, CASE WHEN tax_a = '-' THEN tax_b ELSE tax_a END AS tax_a, tax_b FROM mitab
       WHERE tax_a = '-' OR tax_a = tax_b""",
    "mitab",
)
def _(spark, sf):
    return P.same_species(X.mitab(spark, sf)).select("id_a", "id_b", "tax_a", "tax_b")


@query(
    "p07_host_pathogen_rows",
    """SELECT id_a, id_b, CASE WHEN l_returnflag = 'R' THEN tax_b ELSE tax_a END AS tax_a, tax_b, pmid FROM mitab
       WHERE c_nationkey IN (3, 11) AND (l_returnflag = 'R' OR s_nationkey IN (3, 11))
       AND (l_linenumber = 7 OR NOT starts_with(l_orderkey::VARCHAR, '8888'))""",
    "mitab",
)
def _(spark, sf):
    return P.host_pathogen_rows(X.mitab(spark, sf), "3", "11").select("id_a", "id_b", "tax_a", "tax_b", "pmid")


@query(
    "p08_filter_taxon",
    "SELECT p_partkey AS id, 'taxon:' || p_size AS taxon FROM part WHERE p_size = 7",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    return P.filter_taxon(part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("taxon:"), "p_size").alias("taxon")), "7")


def _genetic(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", 'psi-mi:"MI:0794"(synthetic genetic interaction)').otherwise("direct").alias("itype"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise(F.concat(F.lit("score:"), F.col("l_discount") - F.col("l_tax"))).alias("score"),
        F.concat(F.lit("entrez:1|uniprot/swiss-prot:p"), "l_partkey", F.lit("|x")).alias("alt_a"),
        F.when(F.col("l_linenumber") == 1, "entrez:2").otherwise(F.concat(F.lit("uniprot/swiss-prot:q"), "l_suppkey")).alias("alt_b"),
    )


@query(
    "p09_genetic_rows",
    """SELECT 'P' || l_partkey AS gene_a, 'Q' || l_suppkey AS gene_b, round_even(l_discount - l_tax, 6) AS score FROM lineitem
       WHERE l_linestatus = 'F' AND l_returnflag <> 'R' AND l_linenumber <> 1""",
)
def _(spark, sf):
    return P.genetic_rows(_genetic(spark, sf)).withColumn("score", half_even("score", 6))


def _annotations(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("gene"),
        F.concat(F.lit("GO:"), "l_suppkey").alias("term"),
        F.when(F.col("l_linestatus") == "O", "IEA").otherwise("IDA").alias("evidence_code"),
        F.when(F.col("l_returnflag") == "R", "NOT|part_of").otherwise("part_of").alias("association"),
    )


@query(
    "p10_go_rows",
    """SELECT l_partkey AS gene, 'GO:' || l_suppkey AS term FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       WHERE l_linestatus <> 'O' AND l_returnflag <> 'R' AND s_acctbal > 0""",
)
def _(spark, sf):
    terms = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("GO:"), "s_suppkey").alias("term"))
    return P.go_rows(_annotations(spark, sf), terms).select("gene", "term")


@query(
    "p11_quality_check",
    """WITH m AS (SELECT l_suppkey AS protein_id, month(l_shipdate) AS sample, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS value
                  FROM lineitem GROUP BY ALL),
       p AS (SELECT protein_id, list([sample, value] ORDER BY sample) AS cells, count(*) FILTER (value <> 0) AS good FROM m GROUP BY 1),
       k AS (SELECT min(protein_id) AS protein_id FROM p WHERE (12 - good) / 12 < 0.2 GROUP BY cells)
       SELECT protein_id, sample, value FROM m JOIN k USING (protein_id)""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    value = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    long = li.groupBy(F.col("l_suppkey").alias("protein_id"), F.month("l_shipdate").cast("long").alias("sample")).agg(value.alias("value"))
    return P.quality_check(long, 12)


@query(
    "p12_explode_probes",
    """SELECT p_partkey AS probe, unnest(list_filter([trim(x) FOR x IN string_split(p_type || ' /// ' || p_brand || '///', '///')], lambda x: x <> '')) AS gene FROM part""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    return P.explode_probes(part.select(F.col("p_partkey").alias("probe"), F.concat("p_type", F.lit(" /// "), "p_brand", F.lit("///")).alias("gene")))


@query(
    "p13_cap_group_size",
    "SELECT grp, member FROM co_member WHERE grp IN (SELECT grp FROM co_member GROUP BY grp HAVING count(*) < 5)",
    "co_member",
)
def _(spark, sf):
    return J.cap_group_size(X.co_member(spark, sf), ["grp"], 5)


_PPI_SQL = """SELECT 'P' || l_suppkey AS protein_a, 'P' || l_partkey AS protein_b, s_nationkey::VARCHAR AS tax, l_linenumber AS publications
       FROM mitab WHERE edge_type = 'X' AND s_nationkey = c_nationkey AND l_linestatus = 'O' AND CAST(l_quantity * 3 AS INT) <= 100"""


@query("p14_ppi_rows", _PPI_SQL, "mitab")
def _(spark, sf):
    return P.ppi_rows(X.mitab(spark, sf))


@query(
    "p15_ppi_supported",
    """SELECT DISTINCT p.a, p.b FROM (SELECT a, b, n FROM pairs) p
       WHERE n > 1 OR EXISTS (SELECT 1 FROM gs_link g WHERE g.gs = 'Signaling' AND g.a = p.a AND g.b = p.b)""",
    "pairs gs_link",
)
def _(spark, sf):
    rows = X.pairs(spark, sf).withColumnRenamed("n", "publications")
    return P.ppi_supported(rows, X.gs_link(spark, sf).filter("gs = 'Signaling'"))


@query(
    "p16_tissue_rows",
    """SELECT 'G' || c_custkey AS gene, upper(left(t, 1)) || lower(substr(t, 2)) AS tissue FROM
       (SELECT c_custkey, c_mktsegment AS t, c_acctbal, c_nationkey FROM customer) WHERE c_acctbal >= 0 AND c_nationkey <> 0""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        F.concat(F.lit(" G"), "c_custkey").alias("gene"),
        F.concat(F.lit('"'), "c_mktsegment", F.lit(' (adult)"')).alias("tissue"),
        F.when(F.col("c_acctbal") >= 0, "present").otherwise("absent").alias("expression"),
        F.when(F.col("c_nationkey") != 0, "gold quality").otherwise("silver quality").alias("call_quality"),
    )
    return P.tissue_rows(c, "bgee")


@query(
    "p17_select_pathways",
    """WITH idx AS (SELECT lpad(p_partkey::VARCHAR, 5, '0') AS pathway_id, p_name AS name, CASE WHEN p_type = 'PROMO' THEN 'Metabolism' ELSE p_type END AS class FROM part),
       prev AS (SELECT DISTINCT lpad(l_partkey::VARCHAR, 5, '0') AS pathway_id FROM lineitem WHERE l_quantity = 50
                UNION SELECT 'x' || n_nationkey FROM nation)
       SELECT coalesce(i.pathway_id, p.pathway_id) AS pathway_id, i.name,
         CASE WHEN p.pathway_id IS NULL THEN 'added' WHEN i.pathway_id IS NULL THEN 'removed' ELSE 'kept' END AS status
       FROM idx i FULL JOIN prev p ON i.pathway_id = p.pathway_id
       WHERE p.pathway_id IS NOT NULL OR (class = 'Metabolism' AND NOT starts_with(i.pathway_id, '010') AND NOT starts_with(i.pathway_id, '011'))""",
)
def _(spark, sf):
    pid = lambda c: F.lpad(F.col(c).cast("string"), 5, "0").alias("pathway_id")
    cls = F.when(F.col("p_type") == "PROMO", "Metabolism").otherwise(F.col("p_type"))
    index = table(spark, sf, "part").select(pid("p_partkey"), F.col("p_name").alias("name"), cls.alias("class"))
    previous = table(spark, sf, "lineitem").filter("l_quantity = 50").select(pid("l_partkey"))
    gone = table(spark, sf, "nation").select(F.concat(F.lit("x"), "n_nationkey").alias("pathway_id"))
    return P.select_pathways(index, "Metabolic", previous.union(gone).distinct())


@query(
    "p18_min_group_size",
    "SELECT grp, member FROM co_member WHERE grp IN (SELECT grp FROM co_member GROUP BY grp HAVING count(*) >= 5)",
    "co_member",
)
def _(spark, sf):
    return J.min_group_size(X.co_member(spark, sf), ["grp"], 5)


@query(
    "p19_cap_datasets",
    """SELECT tax_id, dataset, source, position FROM (SELECT *, row_number() OVER (PARTITION BY tax_id ORDER BY
         CASE source WHEN 'EBI' THEN 1 WHEN 'rseq' THEN 2 ELSE 3 END, position, dataset) rn FROM
         (SELECT s_nationkey::VARCHAR AS tax_id, s_name AS dataset, CASE WHEN s_acctbal < 0 THEN 'EBI' WHEN s_acctbal < 5000 THEN 'rseq' ELSE 'ma' END AS source, s_suppkey AS position FROM supplier))
       WHERE rn <= 5""",
)
def _(spark, sf):
    src = F.when(F.col("s_acctbal") < 0, "EBI").when(F.col("s_acctbal") < 5000, "rseq").otherwise("ma")
    s = table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("string").alias("tax_id"), F.col("s_name").alias("dataset"), src.alias("source"), F.col("s_suppkey").alias("position")
    )
    return P.cap_datasets(s, 5)


@query(
    "p20_abs_score_cut",
    """SELECT a, b, abs(score) AS score, CASE WHEN score < 0 THEN '-' ELSE '' END AS sign
       FROM (SELECT a, b, round_even(score * 2 - 1, 6) AS score FROM evidence_link) WHERE abs(score) > 0.1""",
    "evidence_link",
)
def _(spark, sf):
    e = X.evidence_link(spark, sf).select("a", "b", half_even(F.col("score") * 2 - 1, 6).alias("score"))
    return P.abs_score_cut(e)


@query(
    "p21_rescale_cut",
    """WITH r AS (SELECT evidence_id, a, b, score * (0.9 - 0.1) + 0.1 AS score FROM evidence_link WHERE type = 'MEX'),
       k AS (SELECT * FROM r WHERE score > 0.5),
       m AS (SELECT evidence_id, min(score) lo, max(score) hi FROM k GROUP BY 1)
       SELECT evidence_id, a, b, round_even((score - lo) / (hi - lo), 4) AS score FROM k JOIN m USING (evidence_id)""".replace("0.9 - 0.1", "0.9::DOUBLE - 0.1::DOUBLE").replace("+ 0.1 AS", "+ 0.1::DOUBLE AS"),
    "evidence_link",
)
def _(spark, sf):
    e = X.evidence_link(spark, sf).filter("type = 'MEX'").select("evidence_id", "a", "b", "score")
    ranges = e.groupBy("evidence_id").agg(F.lit(0.1).alias("score_min"), F.lit(0.9).alias("score_max"))
    return N.rescale_cut(e, ranges)


@query("p22_confidence_filter", "SELECT a, b, ppv, fbs FROM net WHERE ppv >= 0.85", "net")
def _(spark, sf):
    return P.confidence_filter(X.net(spark, sf), 0.85, "ppv")


@query(
    "p23_any_positive_fbs",
    """WITH f AS (SELECT a, b, type AS gs, round_even(sum(score - 0.6::DOUBLE), 6) AS fbs FROM evidence_link GROUP BY ALL)
       SELECT a, b, gs, fbs FROM (SELECT *, max(fbs) OVER (PARTITION BY a, b) AS best FROM f) WHERE best > 0""",
    "evidence_link",
)
def _(spark, sf):
    f = X.evidence_link(spark, sf).groupBy("a", "b", F.col("type").alias("gs")).agg(half_even(F.sum(F.col("score") - 0.6), 6).alias("fbs"))
    return P.any_positive_fbs(f)


# --- joins -----------------------------------------------------------------------------------


@query(
    "j01_map_ids",
    """SELECT x.protein_id AS a, y.protein_id AS b FROM named_links JOIN id_mapping x ON x.mapped_id = name_a
       JOIN id_mapping y ON y.mapped_id = name_b""",
    "named_links id_mapping",
)
def _(spark, sf):
    return J.map_ids(X.named_links(spark, sf), X.id_mapping(spark, sf), {"name_a": "a", "name_b": "b"})


@query(
    "j02_map_ids_any_case",
    """SELECT x.protein_id AS a, y.protein_id AS b FROM (SELECT upper(name_a) AS name_a, lower(name_b) AS name_b FROM named_links)
       JOIN id_mapping x ON lower(x.mapped_id) = lower(name_a) JOIN id_mapping y ON lower(y.mapped_id) = lower(name_b)""",
    "named_links id_mapping",
)
def _(spark, sf):
    links = X.named_links(spark, sf).select(F.upper("name_a").alias("name_a"), F.lower("name_b").alias("name_b"))
    return J.map_ids(links, X.id_mapping(spark, sf), {"name_a": "a", "name_b": "b"}, lower=True)


@query(
    "j03_map_ids_prefixed",
    """SELECT DISTINCT s.grp, m.protein_id FROM (SELECT DISTINCT l_orderkey AS grp, 'sup:' || l_suppkey AS name FROM lineitem) s
       JOIN id_mapping m ON m.mapped_id = s.name OR m.mapped_id = split_part(s.name, ':', 2)""",
    "id_mapping",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("grp"), F.concat(F.lit("sup:"), "l_suppkey").alias("name")).distinct()
    return J.map_ids(li, X.id_mapping(spark, sf), {"name": "protein_id"}, strip_prefix=True)


@query(
    "j04_unmapped_ids",
    "SELECT DISTINCT l_partkey::VARCHAR AS identifier FROM lineitem WHERE l_partkey::VARCHAR NOT IN (SELECT mapped_id FROM id_mapping)",
    "id_mapping",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("gene"))
    return J.unmapped_ids(li, X.id_mapping(spark, sf), "gene")


_MOVED = """SELECT DISTINCT greatest(x.protein_a, y.protein_a) AS a, least(x.protein_a, y.protein_a) AS b, score,
       CASE WHEN x.protein_a < y.protein_a THEN 5 - direction ELSE direction END AS direction
       FROM sup_links l JOIN ortholog x ON x.protein_b = l.a JOIN ortholog y ON y.protein_b = l.b WHERE x.protein_a <> y.protein_a"""


@query("j05_transfer_links", f"SELECT DISTINCT a, b, score FROM ({_MOVED})", "sup_links ortholog")
def _(spark, sf):
    links = X.sup_links(spark, sf).drop("direction")
    return J.transfer_links(links, J.ortholog_view(X.ortholog(spark, sf), "9606", "10090"))


@query("j05_transfer_directed", _MOVED, "sup_links ortholog")
def _(spark, sf):
    view = J.ortholog_view(X.ortholog(spark, sf), "9606", "10090")
    return J.transfer_links(X.sup_links(spark, sf), view, direction="direction")


@query("j06_ortholog_view", "SELECT protein_b AS src_id, protein_a AS dst_id FROM ortholog", "ortholog")
def _(spark, sf):
    return J.ortholog_view(X.ortholog(spark, sf), "9606", "10090")


@query(
    "j07_mean_links",
    """SELECT greatest(x.protein_b, y.protein_b) AS a, least(x.protein_b, y.protein_b) AS b, round_even(avg(s), 10) AS score FROM
       (SELECT x.c_custkey a, y.c_custkey b, round_even(abs(x.c_acctbal - y.c_acctbal) / 19997, 4) s FROM customer x JOIN customer y
          ON x.c_nationkey = y.c_nationkey AND x.c_mktsegment = y.c_mktsegment AND x.c_custkey > y.c_custkey) l
       JOIN ortholog x ON x.protein_a = l.a JOIN ortholog y ON y.protein_a = l.b WHERE x.protein_b <> y.protein_b
       GROUP BY 1, 2""".replace("avg(s)", "avg(DISTINCT s)"),
    "ortholog",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    p = tiles.member_pairs(c.select(F.col("c_nationkey").alias("g1"), F.col("c_mktsegment").alias("g2"), F.col("c_custkey").alias("m")), ["g1", "g2"], "m")
    bal = c.select("c_custkey", "c_acctbal")
    links = (
        p.join(bal.withColumnsRenamed({"c_custkey": "a", "c_acctbal": "x"}), "a")
        .join(bal.withColumnsRenamed({"c_custkey": "b", "c_acctbal": "y"}), "b")
        .select("a", "b", half_even(F.abs(F.col("x") - F.col("y")) / 19997, 4).alias("score"))
    )
    moved = J.transfer_links(links, J.ortholog_view(X.ortholog(spark, sf), "10090", "9606"))
    return J.mean_links(moved, ["a", "b"]).withColumn("score", half_even("score", 10))


@query(
    "j08_ortholog_pair",
    """SELECT l.a, l.b, x.protein_a AS other_a, y.protein_a AS other_b FROM sup_links l
       JOIN ortholog x ON x.protein_b = l.a JOIN ortholog y ON y.protein_b = l.b""",
    "sup_links ortholog",
)
def _(spark, sf):
    return J.ortholog_pair(X.sup_links(spark, sf).select("a", "b"), J.ortholog_view(X.ortholog(spark, sf), "9606", "10090"))


@query("j09_exclude_pairs", "SELECT a, b, n FROM pairs ANTI JOIN gs_link USING (a, b)", "pairs gs_link")
def _(spark, sf):
    return J.exclude_pairs(X.pairs(spark, sf), X.gs_link(spark, sf))


@query("j10_keep_pairs", "SELECT a, b, n FROM pairs SEMI JOIN gs_link USING (a, b)", "pairs gs_link")
def _(spark, sf):
    return J.keep_pairs(X.pairs(spark, sf), X.gs_link(spark, sf))


@query(
    "j11_merge_datasets",
    "SELECT a, b, " + ", ".join(f"max(CASE WHEN evidence_id = {i} THEN score END) AS \"{i}\"" for i in range(1, 7)) + " FROM evidence_link WHERE evidence_id < 7 GROUP BY ALL",
    "evidence_link",
)
def _(spark, sf):
    return J.merge_datasets(X.evidence_link(spark, sf).filter("evidence_id < 7"), ["a", "b"], "evidence_id", "score", [1, 2, 3, 4, 5, 6])


@query(
    "j13_interval_overlap",
    """WITH p AS (SELECT event_id, user_id AS chrom, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + CAST(floor(value * 60) AS BIGINT) + 1 AS e FROM events),
       g AS (SELECT DISTINCT user_id AS chrom, floor(floor(epoch(ts)) / 21600)::BIGINT * 21600 AS s FROM events)
       SELECT event_id, p.chrom, g.s AS start_g FROM p JOIN g ON p.chrom = g.chrom AND p.s < g.s + 21600 AND g.s < p.e""",
)
def _(spark, sf):
    ev = table(spark, sf, "events")
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    peaks = ev.select(
        "event_id", F.col("user_id").alias("chrom"), start.alias("start_p"), (start + F.floor(F.col("value") * 60) + 1).alias("end_p")
    )
    tile = (F.floor(start / 21600) * 21600).alias("start_g")
    genes = ev.select(F.col("user_id").alias("chrom"), tile).distinct().withColumn("end_g", F.col("start_g") + 21600)
    return J.interval_overlap(peaks, genes, 21600).select("event_id", "chrom", "start_g")


@query(
    "j15_gs_with_scores",
    "SELECT g.gs, g.a, g.b, n.ppv FROM gs_link g LEFT JOIN (SELECT * FROM net WHERE ppv >= 0.85) n ON g.a = n.a AND g.b = n.b",
    "gs_link net",
)
def _(spark, sf):
    return X.gs_link(spark, sf).join(P.confidence_filter(X.net(spark, sf), 0.85, "ppv"), ["a", "b"], "left").select("gs", "a", "b", "ppv")


@query(
    "j16_attach_accessions",
    "SELECT a, b, x.p_name AS accession_a, y.p_name AS accession_b FROM pairs LEFT JOIN part x ON x.p_partkey = a LEFT JOIN part y ON y.p_partkey = b",
    "pairs",
)
def _(spark, sf):
    protein = table(spark, sf, "part").select(F.col("p_partkey").alias("protein_id"), F.col("p_name").alias("uniprot_id"))
    return J.attach_accessions(X.pairs(spark, sf).drop("n"), protein, {"a": "accession_a", "b": "accession_b"})


@query(
    "j17_transfer_network",
    """SELECT a, b, max(score) AS score FROM (SELECT greatest(x.protein_a, y.protein_a) AS a, least(x.protein_a, y.protein_a) AS b, score
       FROM sup_links l JOIN ortholog x ON x.protein_b = l.a JOIN ortholog y ON y.protein_b = l.b) GROUP BY ALL""",
    "sup_links ortholog",
)
def _(spark, sf):
    names = J.ortholog_view(X.ortholog(spark, sf), "9606", "10090")
    return J.transfer_network(X.sup_links(spark, sf).drop("direction"), names, [F.col("score")])


@query(
    "j18_restrict_members",
    """SELECT net.* FROM net JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b
       WHERE x.p_type = 'ECONOMY' AND y.p_type = 'ECONOMY'""",
    "net",
)
def _(spark, sf):
    members = table(spark, sf, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("member"))
    return J.restrict_members(X.net(spark, sf), members)


@query(
    "j20_species_labels",
    """SELECT n_nationkey::VARCHAR AS tax_id, name, left(name, 1) || '.' || list_extract(string_split(name, ' '), -1) AS compact
       FROM (SELECT n_nationkey, upper(left(r_name, 1)) || lower(substr(r_name, 2)) || ' ' || lower(n_name) AS name FROM nation JOIN region ON n_regionkey = r_regionkey)""",
)
def _(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat(P.capitalize(F.col("r_name")), F.lit(" "), F.lower("n_name"))
    n = n.select(F.col("n_nationkey").cast("string").alias("tax_id"), name.alias("name"))
    return n.withColumn("compact", C.compact_species_name(F.concat("name", F.lit(" (common)"))))


@query(
    "j21_member_pairs",
    "SELECT x.grp, x.member AS a, y.member AS b FROM co_member x JOIN co_member y ON x.grp = y.grp AND x.member > y.member",
    "co_member",
)
def _(spark, sf):
    return tiles.member_pairs(X.co_member(spark, sf), ["grp"], "member")


@query(
    "j22_bipartite_pairs",
    """SELECT DISTINCT x.l_orderkey AS grp, x.l_partkey AS left_member, y.l_partkey AS right_member
       FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE x.l_returnflag = 'A' AND y.l_returnflag = 'R'""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("grp"), "l_partkey", "l_returnflag")
    left = li.filter("l_returnflag = 'A'").select("grp", F.col("l_partkey").alias("left_member")).distinct()
    right = li.filter("l_returnflag = 'R'").select("grp", F.col("l_partkey").alias("right_member")).distinct()
    return J.bipartite_pairs(left, right, ["grp"])


# --- set operations, sorting, limits ---------------------------------------------------------


@query("u01_union_links", "SELECT a, b, n::DOUBLE AS n, NULL::DOUBLE AS ppv FROM pairs UNION ALL SELECT a, b, NULL, ppv FROM net", "pairs net")
def _(spark, sf):
    return J.union_links([X.pairs(spark, sf), X.net(spark, sf).drop("fbs")]).select("a", "b", F.col("n").cast("double").alias("n"), "ppv")


@query("u02_distinct_pairs", "SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem")
def _(spark, sf):
    return _ends(spark, sf).select("a", "b").distinct()


@query("u03_difference", "SELECT a, b FROM pairs EXCEPT SELECT a, b FROM gs_link", "pairs gs_link")
def _(spark, sf):
    return J.exclude_pairs(X.pairs(spark, sf).select("a", "b"), X.gs_link(spark, sf))


@query("u05_sort_links", "SELECT a, b, ppv, fbs FROM net", "net")
def _(spark, sf):
    return X.net(spark, sf).orderBy(F.col("ppv").desc(), F.col("fbs").desc())


@query("u06_top_links", "SELECT a, b, ppv, fbs FROM net ORDER BY ppv DESC, fbs DESC, a, b LIMIT 500", "net")
def _(spark, sf):
    return J.top_links(X.net(spark, sf), 500, [F.col("ppv").desc(), F.col("fbs").desc(), F.col("a"), F.col("b")])


_SYM = "SELECT a AS node, b AS other, ppv, fbs FROM net UNION ALL SELECT b, a, ppv, fbs FROM net"


@query(
    "u07_top_links_per_node",
    f"SELECT node, other, ppv, fbs FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ppv DESC, other) rn FROM ({_SYM})) WHERE rn <= 10",
    "net",
)
def _(spark, sf):
    return J.top_links_per_node(X.net(spark, sf), 10)


@query(
    "u08_top_fraction",
    """WITH ab AS (SELECT o_orderpriority AS organ, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
       SELECT organ, gene, value FROM (SELECT *, row_number() OVER (PARTITION BY organ ORDER BY value DESC, gene) rn,
         count(*) OVER (PARTITION BY organ) n FROM ab) WHERE rn <= round_even(n * 0.25, 0)""",
)
def _(spark, sf):
    return O.top_fraction(abundance(spark, sf), ["organ"], "value", 0.25, ["gene"])


def abundance(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_orderpriority").alias("organ"), F.col("l_partkey").alias("gene"))
        .agg(F.sum("l_quantity").alias("value"))
    )


@query("u09_sample_n", "SELECT evidence_id, least(count(*), 1000) AS n FROM evidence_link GROUP BY 1", "evidence_link")
def _(spark, sf):
    picked = O.sample_n(X.evidence_link(spark, sf), 1000, 42, ["evidence_id"], ["a", "b", "direction"])
    return picked.groupBy("evidence_id").agg(F.count("*").alias("n"))


@query("u10_sample_fraction")
def _(spark, sf):
    return O.sample_fraction(X.pairs(spark, sf), 0.25, 42, ["a", "b"])


# --- aggregations ----------------------------------------------------------------------------


@query("g01_mean_by", "SELECT a, b, round_even(avg(score), 6) AS score FROM evidence_link GROUP BY ALL", "evidence_link")
def _(spark, sf):
    return J.mean_links(X.evidence_link(spark, sf), ["a", "b"]).withColumn("score", half_even("score", 6))


@query(
    "g03_members",
    "SELECT a, b, string_agg(DISTINCT type, ',' ORDER BY type) AS members FROM evidence_link GROUP BY ALL",
    "evidence_link",
)
def _(spark, sf):
    m = F.array_join(F.array_sort(F.collect_set("type")), ",")
    return X.evidence_link(spark, sf).groupBy("a", "b").agg(m.alias("members"))


@query("g04_degree", "SELECT node, count(*) AS degree FROM (SELECT a AS node FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY 1", "pairs")
def _(spark, sf):
    return J.degree(X.pairs(spark, sf))


@query("g05_max_by_pair", "SELECT a, b, max(score) AS score FROM evidence_link GROUP BY ALL", "evidence_link")
def _(spark, sf):
    return X.evidence_link(spark, sf).groupBy("a", "b").agg(F.max("score").alias("score"))


@query("g06_count_distinct", "SELECT evidence_id, count(DISTINCT node) AS n FROM (SELECT evidence_id, a AS node FROM evidence_link UNION ALL SELECT evidence_id, b FROM evidence_link) GROUP BY 1", "evidence_link")
def _(spark, sf):
    # two-step count: distinct (dataset, node) first, so no reducer holds a whole dataset's set
    ends = X.evidence_link(spark, sf).select("evidence_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    return ends.groupBy("evidence_id").agg(F.count("*").alias("n"))


@query("g07_group_sizes", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p_brand")


@query("g08_score_range", "SELECT evidence_id, min(score) AS score_min, max(score) AS score_max FROM evidence_link GROUP BY 1", "evidence_link")
def _(spark, sf):
    return J.score_range(X.evidence_link(spark, sf), ["evidence_id"])


@query(
    "g13_indegree",
    """WITH l AS (SELECT s.query_id, net.a, net.b FROM net JOIN seeds s ON s.gene = a UNION SELECT s.query_id, net.a, net.b FROM net JOIN seeds s ON s.gene = b),
       e AS (SELECT query_id, a AS node, b AS other FROM l UNION ALL SELECT query_id, b, a FROM l)
       SELECT e.query_id, node, count(*) AS degree, count(s.gene) AS indegree FROM e LEFT JOIN seeds s ON s.query_id = e.query_id AND s.gene = other GROUP BY ALL""",
    "net seeds",
)
def _(spark, sf):
    from linkweave.operators.queries import neighbour_links

    links = neighbour_links(X.net(spark, sf), X.seeds(spark, sf))
    return J.indegree(links, X.seeds(spark, sf))


# --- windows ---------------------------------------------------------------------------------


@query(
    "w01_keep_best",
    "SELECT a, b, evidence_id, score FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, evidence_id) rn FROM evidence_link) WHERE rn = 1",
    "evidence_link",
)
def _(spark, sf):
    e = X.evidence_link(spark, sf).select("a", "b", "evidence_id", "score")
    return J.keep_best(e, ["a", "b"], [F.col("score"), -F.col("evidence_id")])


@query(
    "w02_keep_max_ties",
    "SELECT a, b, evidence_id, score FROM (SELECT *, max(score) OVER (PARTITION BY a, b) m FROM evidence_link) WHERE score = m",
    "evidence_link",
)
def _(spark, sf):
    return J.keep_max_ties(X.evidence_link(spark, sf), ["a", "b"]).select("a", "b", "evidence_id", "score")


@query(
    "w04_degree_bins",
    """WITH d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY 1)
       SELECT node, degree, (row_number() OVER (ORDER BY degree, node) - 1) // 150 + 1 AS bin FROM d""",
    "pairs",
)
def _(spark, sf):
    return O.degree_bins(J.degree(X.pairs(spark, sf)))


@query(
    "w05_average_rank",
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
       SELECT vec_id, i AS sample, rank() OVER (PARTITION BY vec_id ORDER BY x) + (count(*) OVER (PARTITION BY vec_id, x) - 1) / 2 AS avg_rank FROM v""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
    return O.average_rank(e, ["vec_id"], "x").select("vec_id", (F.col("p") + 1).alias("sample"), "avg_rank")


@query(
    "w07_dense_ids",
    "SELECT p_partkey, p_type AS tissue, dense_rank() OVER (ORDER BY p_type) AS tissue_id FROM part",
)
def _(spark, sf):
    return O.dense_ids(table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("tissue")), "tissue", "tissue_id")


@query(
    "w10_complement_cdf",
    """WITH h AS (SELECT least(floor((ppv - 0.5) / (0.5 / 20)) + 1, 20)::INT AS bin, count(*) AS n FROM net WHERE ppv BETWEEN 0.5 AND 1 GROUP BY 1)
       SELECT bin, n, round_even(sum(n) OVER (ORDER BY bin DESC) / sum(n) OVER (), 6) AS share FROM h""".replace("(0.5 / 20)", "(0.5::DOUBLE / 20)"),
    "net",
)
def _(spark, sf):
    return O.complement_cdf(X.net(spark, sf), "ppv", 20, 0.5, 1.0).withColumn("share", half_even("share", 6))


# --- normalisation ---------------------------------------------------------------------------


@query("n01_minmax", "SELECT a, b, round_even((n - lo) / (hi - lo), 4) AS score FROM pairs, (SELECT min(n) lo, max(n) hi FROM pairs)", "pairs")
def _(spark, sf):
    return N.minmax(X.pairs(spark, sf).withColumnRenamed("n", "score"))


_BOX_ROUND = """{out} AS (SELECT k, i, step, lam, (lam - 1) * sum(ln(x)) - count(*)::DOUBLE / 2.0::DOUBLE * ln(var_pop(CASE WHEN abs(lam) < 1e-12 THEN ln(x) ELSE (pow(x, lam) - 1) / lam END)) AS llf
    FROM src, (SELECT k, i, step, c + i * step AS lam FROM ({prev}), (SELECT unnest(range(-20, 21)) i)) GROUP BY k, i, step, lam)"""


def boxcox_sql(rounds: int = 5) -> str:
    """The lambda search as chained CTEs over `src(x)`; the last one is `best(lam)`. The first round is tried for ranges
    that double, and the first of them with the best exponent inside is taken."""
    parts = [_BOX_ROUND.format(out="r0", prev="SELECT k, 0.0::DOUBLE AS c, 0.1::DOUBLE * pow(2, k) AS step FROM (SELECT unnest(range(6)) k)")]
    parts.append("b0 AS (SELECT DISTINCT ON (k) k, i, step, lam FROM r0 ORDER BY k, round(llf, 7) DESC, lam)")
    prev = "SELECT k, lam AS c, step * 2 / 40 AS step FROM b0 WHERE abs(i) < 20 ORDER BY k LIMIT 1"
    for r in range(1, rounds):
        parts.append(_BOX_ROUND.format(out=f"r{r}", prev=prev))
        prev = f"SELECT k, lam AS c, step * 2 / 40 AS step FROM r{r} ORDER BY round(llf, 7) DESC, lam LIMIT 1"
    parts.append(f"best AS (SELECT c AS lam FROM ({prev}))")
    return ",\n".join(parts)


@query(
    "n02_boxcox_minmax",
    f"""WITH src AS (SELECT a, b, score, score AS x FROM sup_links WHERE score > 0), {boxcox_sql()},
       t AS (SELECT a, b, (pow(x, lam) - 1) / lam AS y FROM src, best)
       SELECT a, b, round_even((y - (SELECT min(y) FROM t)) / ((SELECT max(y) FROM t) - (SELECT min(y) FROM t)), 4) AS score FROM t""",
    "sup_links",
)
def _(spark, sf):
    return N.boxcox_minmax(X.sup_links(spark, sf).drop("direction"))


@query(
    "n03_minmax_to_range",
    "SELECT a, b, round_even((n - lo) / (hi - lo) * (0.8::DOUBLE - 0.2::DOUBLE) + 0.2::DOUBLE, 4) AS score FROM pairs, (SELECT min(n) lo, max(n) hi FROM pairs)",
    "pairs",
)
def _(spark, sf):
    return N.minmax(X.pairs(spark, sf).withColumnRenamed("n", "score"), lo=0.2, hi=0.8)
