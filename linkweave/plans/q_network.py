"""Registered queries: network queries, enrichment, reports, scalar functions."""

from pyspark.sql import functions as F

from linkweave.functions import columns as C
from linkweave.functions import ordered as O
from linkweave.functions import stats as S
from linkweave.functions.columns import half_even
from linkweave.operators import enrichment as E
from linkweave.operators import graph
from linkweave.operators import pairs as J
from linkweave.operators import queries as R
from linkweave.operators import reports as B
from linkweave.operators import training as M
from linkweave.plans import fixtures as X
from linkweave.plans import q_training as T
from linkweave.plans.q_pairs import abundance
from linkweave.plans.registry import query, table, view
from linkweave.session import checkpointed

# --- names -----------------------------------------------------------------------------------


@query(
    "r01_parse_genes",
    """SELECT o_orderkey AS query_id, unnest([o_orderstatus, o_orderpriority, 'C' || o_custkey]) AS name FROM
       (SELECT o_orderkey, o_orderstatus, o_custkey, split_part(o_orderpriority, ' ', 1) AS o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '% %')
       UNION ALL SELECT o_orderkey, unnest([o_orderstatus, split_part(o_orderpriority, ' ', 1), split_part(o_orderpriority, ' ', 2), 'C' || o_custkey]) FROM orders WHERE o_orderpriority LIKE '% %'""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.lit(" "), "o_orderstatus", F.lit(", "), "o_orderpriority", F.lit(",,\n"), F.lit("C"), "o_custkey", F.lit(" "))
    return R.parse_genes(o.select(F.col("o_orderkey").alias("query_id"), text.alias("text")))


def _typed_names(spark, sf):
    """Every order asks for its customer's nation gene and its lines' suppliers by upper-cased name."""
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    named = li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    each = F.explode(F.array(F.upper("s_name"), F.concat(F.lit("gene"), "s_nationkey"), F.concat(F.lit("part"), "l_partkey")))
    return named.select(F.col("l_returnflag").alias("query_id"), each.alias("name")).distinct()


view(
    "typed_names",
    """SELECT DISTINCT l_returnflag AS query_id, name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey,
       LATERAL (SELECT upper(s_name) AS name UNION ALL SELECT 'gene' || s_nationkey UNION ALL SELECT 'part' || l_partkey)""",
)


@query(
    "r02_resolve_genes",
    """SELECT query_id, name, coalesce(string_agg(DISTINCT protein_id::VARCHAR, ',' ORDER BY protein_id::VARCHAR), '') AS protein_ids,
       CASE count(DISTINCT protein_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'multi' END AS status
       FROM typed_names LEFT JOIN id_mapping ON lower(mapped_id) = lower(name) GROUP BY ALL""",
    "typed_names id_mapping",
)
def _(spark, sf):
    r = R.resolve_genes(_typed_names(spark, sf), X.id_mapping(spark, sf))
    ids = F.array_join(F.array_sort(F.transform("protein_ids", lambda p: p.cast("string"))), ",")
    return r.select("query_id", "name", ids.alias("protein_ids"), "status")


@query(
    "r03_suggest_genes",
    """SELECT DISTINCT name, mapped_id, protein_id, (lower(mapped_id) <> lower(name))::INT AS rank FROM
         (SELECT DISTINCT 'r#' || lpad((l_suppkey // 10)::VARCHAR, 8, '0') AS name FROM lineitem) JOIN id_mapping ON contains(lower(mapped_id), lower(name))""",
    "id_mapping",
)
def _(spark, sf):
    # supplier names by all but their last digit: each text suggests up to ten suppliers
    li = table(spark, sf, "lineitem")
    name = F.concat(F.lit("r#"), F.lpad(F.floor(F.col("l_suppkey") / 10).cast("string"), 8, "0"))
    return R.suggest_genes(li.select(name.alias("name")).distinct(), X.id_mapping(spark, sf))


@query(
    "r03_suggest_short_names",
    """SELECT DISTINCT name, mapped_id, protein_id, (lower(mapped_id) <> lower(name))::INT AS rank FROM
         (SELECT l_linenumber::VARCHAR AS name FROM lineitem UNION SELECT left(n_name, 2) FROM nation UNION SELECT left(o_orderpriority, 1) FROM orders) JOIN id_mapping ON contains(lower(mapped_id), lower(name))""",
    "id_mapping",
)
def _(spark, sf):
    # one and two letters: line numbers, beginnings of nations and of priorities
    li, n, o = (table(spark, sf, t) for t in ("lineitem", "nation", "orders"))
    names = [li.select(F.col("l_linenumber").cast("string")), n.select(F.substring("n_name", 1, 2)), o.select(F.substring("o_orderpriority", 1, 1))]
    return R.suggest_genes(names[0].union(names[1]).union(names[2]).toDF("name"), X.id_mapping(spark, sf))


# --- links -----------------------------------------------------------------------------------

view(
    "near_links",
    "SELECT s.query_id, net.* FROM net JOIN seeds s ON s.gene = a UNION SELECT s.query_id, net.* FROM net JOIN seeds s ON s.gene = b",
    "net seeds",
)


@query("r04_neighbour_links", "SELECT * FROM near_links", "near_links")
def _(spark, sf):
    return R.neighbour_links(X.net(spark, sf), X.seeds(spark, sf))


@query("r05_induced_links", "SELECT x.query_id, net.* FROM net JOIN seeds x ON x.gene = a JOIN seeds y ON y.gene = b AND y.query_id = x.query_id", "net seeds")
def _(spark, sf):
    return R.induced_links(X.net(spark, sf), X.seeds(spark, sf))


@query("r06_restrict_gold_standard", "SELECT a, b, ppv, fbs, direction FROM final_gs WHERE gs = 'Metabolic'", "final_gs")
def _(spark, sf):
    return R.restrict_gold_standard(T.network(spark, sf), "Metabolic")


_RESCORE = """WITH t AS (SELECT a, b, direction, gs, {part} AS part, round_even(sum({inner}), 3) AS v FROM (SELECT a, b, direction, gs, type, tax_id, sum(wllr) AS v FROM weighted GROUP BY ALL) GROUP BY ALL),
   f AS (SELECT n.a, n.b, n.gs, coalesce(sum(v) FILTER (part IN ({chosen})), 0) AS s FROM final_gs n LEFT JOIN t ON t.a = n.a AND t.b = n.b AND t.direction = n.direction AND t.gs = n.gs
         AND (t.a, t.b, t.direction) IN (SELECT (a, b, direction) FROM fbs) GROUP BY ALL),
   r AS (SELECT a, b, gs, round_even(s, 3) AS fbs FROM f)
   SELECT a, b, gs, fbs, {ppv} AS ppv FROM r LEFT JOIN ppv_model USING (gs)"""


@query(
    "r07_rescore_evidence",
    _RESCORE.format(part="type", inner="v", chosen="'PIN', 'MEX'", ppv=T._PPV.format(lo=0.0)),
    "weighted fbs final_gs ppv_model",
)
def _(spark, sf):
    of = X.feat_stage(spark, sf)
    return R.rescore(T.network(spark, sf, of), T._ppv_model(spark, sf, of), evidence=["PIN", "MEX"])


@query(
    "r08_rescore_species",
    _RESCORE.format(part="tax_id", inner="round_even(v, 3)", chosen="'9606'", ppv=T._PPV.format(lo=0.0)),
    "weighted fbs final_gs ppv_model",
)
def _(spark, sf):
    of = X.feat_stage(spark, sf)
    return R.rescore(T.network(spark, sf, of), T._ppv_model(spark, sf, of), species=["9606"])


# --- expansion -------------------------------------------------------------------------------

_EXPAND = """WITH e AS (SELECT query_id, a AS node, ppv FROM near_links WHERE ppv >= 0.6 UNION ALL SELECT query_id, b, ppv FROM near_links WHERE ppv >= 0.6),
   n AS (SELECT query_id, node, max(ppv) AS best, count(*) AS links FROM e GROUP BY ALL),
   z AS (SELECT query_id, count(*) AS size FROM seeds GROUP BY 1),
   k AS (SELECT n.*, size, s.gene IS NOT NULL AS inside, row_number() OVER (PARTITION BY n.query_id ORDER BY {order} DESC, node) AS rn FROM n JOIN z USING (query_id) LEFT JOIN seeds s ON s.query_id = n.query_id AND s.gene = node),
   f AS (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY rn) AS fr FROM k WHERE NOT inside AND {cut})
   SELECT query_id, gene FROM seeds UNION ALL SELECT query_id, node FROM f WHERE fr <= 5"""


@query("r09_expand_group", _EXPAND.format(order="best", cut="rn <= 5 + size"), "near_links seeds")
def _(spark, sf):
    return R.expand_group(X.net(spark, sf), X.seeds(spark, sf), 1, 5, 0.6)


@query("r10_expand_common", _EXPAND.format(order="CASE WHEN size > 1 THEN links ELSE best END", cut="(size > 1 OR rn <= 5 + size)"), "near_links seeds")
def _(spark, sf):
    return R.expand_group(X.net(spark, sf), X.seeds(spark, sf), 1, 5, 0.6, common=True)


@query(
    "r11_expand_local",
    """WITH s AS (SELECT a AS node, b AS other, ppv FROM net UNION ALL SELECT b, a, ppv FROM net),
       m AS (SELECT query_id, node, other, row_number() OVER (PARTITION BY query_id, node ORDER BY ppv DESC, other) rn FROM s JOIN seeds ON gene = node WHERE ppv >= 0.6),
       one AS (SELECT query_id, node AS gene FROM m WHERE rn <= 2 UNION SELECT query_id, other FROM m WHERE rn <= 2),
       m2 AS (SELECT query_id, node, other, row_number() OVER (PARTITION BY query_id, node ORDER BY ppv DESC, other) rn FROM s JOIN one ON gene = node WHERE ppv >= 0.6)
       SELECT query_id, node AS gene FROM m2 WHERE rn <= 2 UNION SELECT query_id, other FROM m2 WHERE rn <= 2""",
    "net seeds",
)
def _(spark, sf):
    return R.expand_local(X.net(spark, sf), X.seeds(spark, sf), 2, 2, 0.6)


def _tail(k, n, m, d):
    """P(X >= k) as a sum of exponentials of log-factorials."""
    term = f"exp(lgamma({m} + 1) - lgamma(j + 1) - lgamma({m} - j + 1) + lgamma({n} - {m} + 1) - lgamma({d} - j + 1) - lgamma({n} - {m} - {d} + j + 1) - lgamma({n} + 1) + lgamma({d} + 1) + lgamma({n} - {d} + 1))"
    return f"least(1, CASE WHEN {k} <= greatest(0, {d} + {m} - {n}) THEN 1.0::DOUBLE ELSE coalesce(list_sum([{term} FOR j IN range({k}, least({m}, {d}) + 1)]), 0) END)"


_BH = """ranked AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY p) + count(*) OVER (PARTITION BY query_id, p) - 1 AS rk, count(*) OVER (PARTITION BY query_id) AS m FROM tested),
   adjusted AS (SELECT *, least(1, min(p * m / rk) OVER (PARTITION BY query_id ORDER BY p DESC)) AS fdr, least(1, p * m) AS fwer FROM ranked)"""


@query(
    "r12_linked_candidates",
    f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ppv DESC, a, b) rn FROM near_links WHERE ppv >= 0.6),
       near AS (SELECT query_id, a AS gene FROM f WHERE rn <= 20 UNION SELECT query_id, b FROM f WHERE rn <= 20),
       l AS (SELECT n.query_id, a, b FROM net JOIN near n ON n.gene = a WHERE ppv >= 0.6 UNION SELECT n.query_id, a, b FROM net JOIN near n ON n.gene = b WHERE ppv >= 0.6),
       e AS (SELECT query_id, a AS node, b AS other FROM l UNION ALL SELECT query_id, b, a FROM l),
       c AS (SELECT e.query_id, node AS gene, count(*) AS degree, count(s.gene) AS indegree FROM e LEFT JOIN seeds s ON s.query_id = e.query_id AND s.gene = other GROUP BY ALL),
       z AS (SELECT query_id, count(*) AS n_seeds FROM seeds GROUP BY 1), n AS (SELECT count(*) AS total FROM part),
       tested AS (SELECT c.*, n_seeds, round({_tail('indegree', 'total', 'n_seeds', 'degree')}, 12) AS p FROM c JOIN z USING (query_id), n
                  WHERE (query_id, gene) IN (SELECT (query_id, gene) FROM near) AND (query_id, gene) NOT IN (SELECT (query_id, gene) FROM seeds)), {_BH}
       SELECT query_id, gene, indegree, degree, round_even(p, 6) AS p FROM adjusted WHERE fdr <= 0.9""",
    "near_links net seeds",
)
def _(spark, sf):
    n = table(spark, sf, "part").count()
    c = R.linked_candidates(X.net(spark, sf), X.seeds(spark, sf), 20, 0.9, n, 0.6)
    return c.select("query_id", "gene", "indegree", "degree", half_even("p", 6).alias("p"))


# --- modules ---------------------------------------------------------------------------------


def _type_links(spark, sf):
    """One graph per part type: all links between its parts."""
    return X.feat(spark, sf).filter("type_a = type_b").select(F.col("type_a").alias("query_id"), "a", "b")


view("type_links", "SELECT type_a AS query_id, a, b FROM feat WHERE type_a = type_b", "feat")
_REACH = """WITH RECURSIVE s AS (SELECT query_id, a AS x, b AS y FROM type_links UNION ALL SELECT query_id, b, a FROM type_links),
   reach(query_id, node, other) AS (SELECT query_id, x, x FROM s UNION SELECT r.query_id, r.node, s.y FROM reach r JOIN s ON s.query_id = r.query_id AND s.x = r.other),
   comp AS (SELECT query_id, node, min(other) AS component FROM reach GROUP BY ALL)"""


@query("r13_components", _REACH + " SELECT * FROM comp", "type_links")
def _(spark, sf):
    return graph.components(_type_links(spark, sf))


@query(
    "r13_largest_component",
    _REACH + """, z AS (SELECT query_id, component, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, component) rn FROM (SELECT query_id, component, count(*) AS n FROM comp GROUP BY ALL))
       SELECT l.* FROM type_links l JOIN comp c ON c.query_id = l.query_id AND c.node = l.a JOIN z ON z.query_id = c.query_id AND z.component = c.component AND rn = 1""",
    "type_links",
)
def _(spark, sf):
    return graph.largest_component(_type_links(spark, sf)).select("query_id", "a", "b")


def _typed_seeds(spark, sf):
    """Dear parts are the seeds of their type."""
    p = table(spark, sf, "part")
    return p.filter("p_size >= 40").select(F.col("p_type").alias("query_id"), F.col("p_partkey").alias("gene"))


@query(
    "r14_path_connectors",
    """WITH s AS MATERIALIZED (SELECT query_id AS q, a, b FROM type_links UNION SELECT query_id, b, a FROM type_links),
       sd AS MATERIALIZED (SELECT p_type AS q, p_partkey AS g FROM part WHERE p_size >= 40),
       r1 AS MATERIALIZED (SELECT s.q, sd.g AS src, s.b AS node, min(s.a) AS pred FROM sd JOIN s ON s.q = sd.q AND s.a = sd.g WHERE s.b <> sd.g GROUP BY ALL),
       r2 AS MATERIALIZED (SELECT s.q, r1.src, s.b AS node, min(s.a) AS pred FROM r1 JOIN s ON s.q = r1.q AND s.a = r1.node
              LEFT JOIN r1 o ON o.q = s.q AND o.src = r1.src AND o.node = s.b WHERE s.b <> r1.src AND o.q IS NULL GROUP BY ALL),
       r3 AS MATERIALIZED (SELECT s.q, r2.src, s.b AS node, min(s.a) AS pred FROM r2 JOIN s ON s.q = r2.q AND s.a = r2.node JOIN sd ON sd.q = s.q AND sd.g = s.b
              LEFT JOIN r1 o ON o.q = s.q AND o.src = r2.src AND o.node = s.b LEFT JOIN r2 t ON t.q = s.q AND t.src = r2.src AND t.node = s.b
              WHERE s.b <> r2.src AND o.q IS NULL AND t.q IS NULL GROUP BY ALL)
       SELECT r2.q AS query_id, r2.pred AS node FROM r2 JOIN sd ON sd.q = r2.q AND sd.g = r2.node UNION SELECT q, pred FROM r3
       UNION SELECT r2.q, r2.pred FROM r3 JOIN r2 ON r2.q = r3.q AND r2.src = r3.src AND r2.node = r3.pred""",
    "type_links",
)
def _(spark, sf):
    return graph.path_connectors(_type_links(spark, sf), _typed_seeds(spark, sf), 2)


@query("r15_seed_rank")
def _(spark, sf):
    return graph.seed_rank(_type_links(spark, sf), _typed_seeds(spark, sf))


@query("r16_prune_modules")
def _(spark, sf):
    links = checkpointed(_type_links(spark, sf))
    seeds = _typed_seeds(spark, sf)
    return graph.prune_modules(links, seeds, graph.seed_rank(links, seeds))


@query("r16_seed_module")
def _(spark, sf):
    net = X.net(spark, sf).select("a", "b")
    return graph.seed_module(net, X.seeds(spark, sf), 2)


# --- presentation ----------------------------------------------------------------------------


@query(
    "r17_link_direction",
    """WITH g AS (SELECT type, a, b, max(llr) AS llr FROM llr WHERE type = 'GRG' AND gs = 'Complex' GROUP BY ALL),
       x AS (SELECT n.a, n.b, n.direction, n.gs, n.pos, n.is_gs, n.ppv, coalesce(t.v, 0) AS grg FROM final_gs n LEFT JOIN
             (SELECT a, b, direction, gs, round_even(sum(wllr), 3) AS v FROM weighted WHERE type = 'GRG' GROUP BY ALL) t ON t.a = n.a AND t.b = n.b AND t.direction = n.direction AND t.gs = n.gs
             AND (t.a, t.b, t.direction) IN (SELECT (a, b, direction) FROM fbs)),
       k AS (SELECT *, CASE WHEN is_gs IN (2, 3) THEN is_gs ELSE 0 END AS known FROM x)
       SELECT a, b, gs, CASE WHEN is_gs = 5 THEN 5 WHEN ppv >= 0.6 AND direction <> known AND grg > 0.5 THEN known + direction ELSE known END AS link_direction FROM k""",
    "final_gs weighted fbs llr",
)
def _(spark, sf):
    n = T.network(spark, sf).select("a", "b", "direction", F.explode("gs").alias("g"))
    grg = F.coalesce(F.try_element_at("g.llr_ev", F.lit("GRG")), F.lit(0.0))
    d = R.link_direction(F.col("direction"), F.col("g.is_gs"), grg, F.col("g.ppv"), 0.5, 0.6)
    return n.select("a", "b", "g.gs", d.alias("link_direction"))


@query(
    "r18_score_details",
    """WITH k AS (SELECT *, max(is_gs) OVER (PARTITION BY a, b) AS any_gs FROM final_gs)
       SELECT a, b, string_agg(gs || ':' || CASE WHEN is_gs > 0 THEN 'This' WHEN any_gs > 0 THEN 'Other' ELSE 'None' END, ',' ORDER BY ppv DESC, fbs DESC, gs) AS details
       FROM k WHERE ppv > 0 OR is_gs > 0 GROUP BY a, b""",
    "final_gs",
)
def _(spark, sf):
    d = R.score_details(T.network(spark, sf))
    shown = F.array_join(F.transform("details", lambda e: F.concat(e["gs"], F.lit(":"), e["known"])), ",")
    return d.select("a", "b", shown.alias("details"))


@query(
    "r19_annotate_nodes",
    """WITH g AS (SELECT DISTINCT l_suppkey AS gene FROM lineitem),
       m AS (SELECT protein_id, max(CASE WHEN type = 'Gene_Symbol' THEN mapped_id END) AS label, string_agg(type || ':' || mapped_id, ',' ORDER BY type || ':' || mapped_id) AS mappings FROM id_mapping GROUP BY 1),
       p AS (SELECT l_suppkey AS s, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS pathways, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS tissues FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
       SELECT gene, label, s_name AS uniprot_id, mappings, coalesce(pathways, '') AS pathways, coalesce(tissues, '') AS tissues FROM g JOIN supplier ON s_suppkey = gene LEFT JOIN m ON m.protein_id = gene LEFT JOIN p ON p.s = gene""",
    "id_mapping",
)
def _(spark, sf):
    li, p, s = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    joined = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    n = R.annotate_nodes(
        li.select(F.col("l_suppkey").alias("gene")), s.select(F.col("s_suppkey").alias("protein_id"), F.col("s_name").alias("uniprot_id")), X.id_mapping(spark, sf),
        joined.select(F.col("l_suppkey").alias("protein_id"), F.col("p_brand").alias("pathway_id")), joined.select(F.col("l_suppkey").alias("protein_id"), F.col("p_type").alias("tissue")),
    )
    return n.select("gene", "label", "uniprot_id", *[F.array_join(c, ",").alias(c) for c in ("mappings", "pathways", "tissues")])


@query(
    "r20_node_stats",
    """WITH l AS (SELECT x.query_id, a, b FROM net JOIN seeds x ON x.gene = a JOIN seeds y ON y.gene = b AND y.query_id = x.query_id),
       e AS (SELECT query_id, a AS node, b AS other FROM l UNION ALL SELECT query_id, b, a FROM l)
       SELECT query_id, node, count(*) AS degree, string_agg(other::VARCHAR, ',' ORDER BY other) AS partners FROM e GROUP BY ALL""",
    "net seeds",
)
def _(spark, sf):
    s = J.node_stats(R.induced_links(X.net(spark, sf), X.seeds(spark, sf)))
    return s.select("query_id", "node", "degree", F.array_join(F.transform("partners", lambda p: p.cast("string")), ",").alias("partners"))


# --- other species ---------------------------------------------------------------------------


def _species_pair(spark, sf):
    """Suppliers of one nation linked, customers of one nation and segment linked, orthologs between them."""
    c = table(spark, sf, "customer")
    from linkweave.operators.tiles import member_pairs

    other = member_pairs(c.select(F.col("c_nationkey").alias("g1"), F.col("c_mktsegment").alias("g2"), F.col("c_custkey").alias("m")), ["g1", "g2"], "m").select("a", "b")
    seeds = table(spark, sf, "supplier").select(F.concat(F.lit("q"), "s_nationkey").alias("query_id"), F.col("s_suppkey").alias("gene"))
    return X.sup_links(spark, sf).select("a", "b"), other, seeds, J.ortholog_view(X.ortholog(spark, sf), "9606", "10090")


view("cust_net", "SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey AND x.c_mktsegment = y.c_mktsegment AND x.c_custkey > y.c_custkey")
view("cust_start", "SELECT DISTINCT 'q' || s_nationkey AS query_id, protein_a AS gene FROM supplier JOIN ortholog ON protein_b = s_suppkey", "ortholog")


@query(
    "r21_compare_species",
    "SELECT s.query_id, n.a, n.b FROM cust_net n JOIN cust_start s ON s.gene = n.a UNION SELECT s.query_id, n.a, n.b FROM cust_net n JOIN cust_start s ON s.gene = n.b",
    "cust_net cust_start",
)
def _(spark, sf):
    net, other, seeds, vw = _species_pair(spark, sf)
    return R.compare_species(R.induced_links(net, seeds), other, seeds, vw)[0]


_IN_LINKS = """nodes AS (SELECT 'q' || s_nationkey AS query_id, a AS gene FROM sup_links JOIN supplier ON s_suppkey = a UNION SELECT 'q' || s_nationkey, b FROM sup_links JOIN supplier ON s_suppkey = b),
   st AS (SELECT DISTINCT query_id, protein_a AS gene FROM nodes JOIN ortholog ON protein_b = gene)"""


@query(
    "r22_compare_orthologs_only",
    f"WITH {_IN_LINKS} SELECT x.query_id, n.a, n.b FROM cust_net n JOIN st x ON x.gene = n.a JOIN st y ON y.gene = n.b AND y.query_id = x.query_id",
    "cust_net ortholog sup_links",
)
def _(spark, sf):
    net, other, seeds, vw = _species_pair(spark, sf)
    return R.compare_species(R.induced_links(net, seeds), other, seeds, vw, orthologs_only=True)[0]


@query(
    "r22_ortholog_ties",
    f"""WITH {_IN_LINKS}, o AS (SELECT x.query_id, n.a, n.b FROM cust_net n JOIN st x ON x.gene = n.a JOIN st y ON y.gene = n.b AND y.query_id = x.query_id),
       f AS (SELECT query_id, a AS d FROM o UNION SELECT query_id, b FROM o)
       SELECT DISTINCT nodes.query_id, gene AS src_id, protein_a AS dst_id FROM nodes JOIN ortholog ON protein_b = gene JOIN f ON f.query_id = nodes.query_id AND f.d = protein_a""",
    "cust_net ortholog sup_links",
)
def _(spark, sf):
    net, other, seeds, vw = _species_pair(spark, sf)
    return R.compare_species(R.induced_links(net, seeds), other, seeds, vw, orthologs_only=True)[1]


@query(
    "r23_query_transferred",
    """WITH st AS (SELECT DISTINCT 'n' || c_nationkey AS query_id, protein_b AS gene FROM customer JOIN ortholog ON protein_a = c_custkey),
       l AS (SELECT query_id, a, b, score FROM sup_links JOIN st ON gene = a UNION SELECT query_id, a, b, score FROM sup_links JOIN st ON gene = b)
       SELECT DISTINCT query_id, x.protein_a AS name_a, y.protein_a AS name_b, score AS ppv FROM l JOIN ortholog x ON x.protein_b = l.a JOIN ortholog y ON y.protein_b = l.b""",
    "sup_links ortholog",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("query_id"), F.col("c_custkey").alias("gene"))
    names = J.ortholog_view(X.ortholog(spark, sf), "9606", "10090").withColumnsRenamed({"src_id": "own", "dst_id": "other"})
    return R.query_transferred(X.sup_links(spark, sf).select("a", "b", F.col("score").alias("ppv")), c, names)


@query(
    "r24_query_host_pathogen",
    """WITH n AS (SELECT l_suppkey + 10000000 AS a, l_partkey AS b, max(l_discount) AS ppv FROM lineitem GROUP BY ALL), s AS (SELECT 'b' || p_brand AS query_id, p_partkey AS gene FROM part)
       SELECT query_id, a, b, ppv, 'host' AS role_a, 'pathogen' AS role_b FROM n JOIN s ON gene = b""",
)
def _(spark, sf):
    li, p, s = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    net = li.groupBy((F.col("l_suppkey") + 10000000).alias("a"), F.col("l_partkey").alias("b")).agg(F.max("l_discount").alias("ppv"))
    genes = p.select(F.concat(F.lit("b"), "p_brand").alias("query_id"), F.col("p_partkey").alias("gene"))
    host = s.select((F.col("s_suppkey") + 10000000).alias("protein_id"))
    return R.query_host_pathogen(net, genes, host, p.select(F.col("p_partkey").alias("protein_id")))


view(
    "raw_evidence",
    """SELECT 1 AS evidence_id, 'PIN' AS type, '9606' AS tax_id, a, b, score FROM sup_links
       UNION ALL SELECT 2, 'MEX', '10090', x.c_custkey, y.c_custkey, round_even(abs(x.c_acctbal - y.c_acctbal) / 11003, 4) FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey AND x.c_mktsegment = y.c_mktsegment AND x.c_custkey > y.c_custkey
       UNION ALL SELECT 3, 'DOM', '10090', x.c_custkey, y.c_custkey, 0.5 FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey AND x.c_mktsegment = y.c_mktsegment AND x.c_custkey > y.c_custkey""",
    "sup_links",
)


@query(
    "r25_link_details",
    """WITH w AS (SELECT a, b, a AS x, b AS y, '9606' AS tax_id FROM sup_links UNION SELECT l.a, l.b, greatest(p.protein_a, q.protein_a), least(p.protein_a, q.protein_a), '10090' FROM sup_links l JOIN ortholog p ON p.protein_b = l.a JOIN ortholog q ON q.protein_b = l.b),
       m AS (SELECT evidence_id, min(score) AS x_min, max(score) AS x_max FROM raw_evidence GROUP BY 1),
       r AS (SELECT w.a, w.b, e.evidence_id, e.type, e.tax_id, e.a AS ea, e.b AS eb, e.score, x_min, x_max, CASE WHEN type = 'MEX' THEN round_even(score * (0.9::DOUBLE - 0.1::DOUBLE) + 0.1::DOUBLE, 3) ELSE score END AS raw_score
             FROM w JOIN raw_evidence e ON e.tax_id = w.tax_id AND e.a = w.x AND e.b = w.y JOIN m USING (evidence_id) WHERE e.type <> 'DOM'),
       u AS (SELECT *, CASE WHEN type = 'MEX' THEN round_even((raw_score - 0.5::DOUBLE) / (0.9::DOUBLE - 0.5::DOUBLE), 4) ELSE score END AS used FROM r WHERE type <> 'MEX' OR raw_score > 0.5)
       SELECT a, b, evidence_id, type, tax_id, ea, eb, raw_score, round_even(2.0::DOUBLE * least(greatest(used, x_min), x_max) + -0.5::DOUBLE, 3) AS llr FROM u""",
    "raw_evidence ortholog sup_links",
)
def _(spark, sf):
    net, other, _, _ = _species_pair(spark, sf)
    bal = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    scored = other.join(bal.withColumnsRenamed({"c_custkey": "a", "c_acctbal": "x"}), "a").join(bal.withColumnsRenamed({"c_custkey": "b", "c_acctbal": "y"}), "b")

    def rows(df, i, kind, tax, score):
        return df.select(F.lit(i).alias("evidence_id"), F.lit(kind).alias("type"), F.lit(tax).alias("tax_id"), "a", "b", score.alias("score"))

    raw = rows(X.sup_links(spark, sf), 1, "PIN", "9606", F.col("score"))
    raw = raw.unionByName(rows(scored, 2, "MEX", "10090", half_even(F.abs(F.col("x") - F.col("y")) / 11003, 4))).unionByName(rows(scored, 3, "DOM", "10090", F.lit(0.5)))
    ends = J.score_range(raw, ["evidence_id"])
    models = ends.select("evidence_id", F.lit("PPI").alias("gs"), F.array(F.lit(2.0), F.lit(-0.5)).alias("coefficients"), F.col("score_min").alias("x_min"), F.col("score_max").alias("x_max"))
    is_mex = F.col("evidence_id") == 2
    ranges = ends.select("evidence_id", F.when(is_mex, 0.1).alias("score_min"), F.when(is_mex, 0.9).alias("score_max"))
    return R.link_details(net, "PPI", "9606", J.symmetric_orthologs(X.ortholog(spark, sf)), raw, ranges, models)


@query("r26_catalogue", "SELECT DISTINCT p_brand AS pathway_id, p_type AS tissue FROM part JOIN lineitem ON l_partkey = p_partkey")
def _(spark, sf):
    p = table(spark, sf, "part").join(table(spark, sf, "lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    return R.catalogue(p.select(F.col("p_brand").alias("pathway_id"), F.col("p_type").alias("tissue")), ["pathway_id", "tissue"])


# --- enrichment ------------------------------------------------------------------------------


def _pathways(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("pathway_id"), F.col("p_partkey").alias("protein_id"))


view("conf", "SELECT a, b FROM net WHERE ppv >= 0.95", "net")
view("conf_sym", "SELECT a AS node, b AS other FROM conf UNION ALL SELECT b, a FROM conf", "conf")
view("net_pw", "SELECT p_brand AS pathway_id, p_partkey AS g FROM part WHERE p_partkey IN (SELECT node FROM conf_sym) QUALIFY count(*) OVER (PARTITION BY p_brand) >= 5", "conf_sym")
view("talk", "SELECT node, pathway_id, count(*) AS n FROM conf_sym JOIN net_pw ON g = other GROUP BY ALL", "conf_sym net_pw")


@query("x01_crosstalk", "SELECT * FROM talk", "talk")
def _(spark, sf):
    return E.crosstalk(X.net(spark, sf), _pathways(spark, sf))


def _sets(spark, sf):
    """Gene sets to enrich: the parts of each type and size."""
    p = table(spark, sf, "part")
    return p.select(F.concat_ws("-", "p_type", "p_size").alias("query_id"), F.col("p_partkey").alias("gene"))


view("sets", "SELECT p_type || '-' || p_size AS query_id, p_partkey AS gene FROM part")


@query("x02_matched_samples", "SELECT query_id, draw, count(*) AS n FROM sets JOIN (SELECT DISTINCT node FROM conf_sym) ON node = gene, (SELECT unnest(range(5))::INT AS draw) GROUP BY ALL", "sets conf_sym")
def _(spark, sf):
    bins = E.network_bins(X.net(spark, sf))
    drawn = E.matched_samples(_sets(spark, sf), bins, 5, 9606).distinct()
    return drawn.groupBy("query_id", "draw").agg(F.count("*").alias("n"))


def _type_sets(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_type").alias("query_id"), F.col("p_partkey").alias("gene"))


view("net_bins", "SELECT node, ((row_number() OVER (ORDER BY d, node) - 1) // 150 + 1)::INT AS bin FROM (SELECT node, count(*) AS d FROM conf_sym GROUP BY 1)", "conf_sym")


@query(
    "x03_crosstalk_moments",
    """WITH need AS (SELECT p_type AS query_id, bin, count(*) AS need FROM part JOIN net_bins ON node = p_partkey GROUP BY ALL), size AS (SELECT bin, count(*) AS size FROM net_bins GROUP BY 1),
       sums AS (SELECT bin, pathway_id, sum(n) AS s1, sum(n * n) AS s2 FROM talk JOIN net_bins USING (node) GROUP BY ALL),
       m AS (SELECT query_id, pathway_id, sum(need * s1 / size) AS m1, sum(CASE WHEN size > 1 THEN need * (size - need) / (size - 1) * (s2 / size - (s1 / size) * (s1 / size)) ELSE 0 END) AS v FROM need JOIN size USING (bin) JOIN sums USING (bin) GROUP BY ALL)
       SELECT query_id, pathway_id, round_even(m1, 6) AS m1, round_even(v + m1 * m1, 4) AS m2 FROM m""",
    "net_bins talk",
)
def _(spark, sf):
    net = X.net(spark, sf)
    m = E.exact_moments(_type_sets(spark, sf), E.network_bins(net), E.crosstalk(net, _pathways(spark, sf)))
    return m.select("query_id", "pathway_id", half_even("m1", 6).alias("m1"), half_even("m2", 4).alias("m2"))


@query("x03_crosstalk_test")
def _(spark, sf):
    return E.crosstalk_enrichment(X.net(spark, sf), _type_sets(spark, sf), _pathways(spark, sf))


@query("x03_refined_crosstalk_test")
def _(spark, sf):
    return E.crosstalk_enrichment(X.net(spark, sf), _sets(spark, sf), _pathways(spark, sf), draws=100, refine=True)


@query("x07_combine_enrichment")
def _(spark, sf):
    # the sets are random, so the report keeps every pathway instead of the significant ones
    n = table(spark, sf, "part").count()
    return E.enrichment(X.net(spark, sf), _type_sets(spark, sf), _pathways(spark, sf), n, max_fwer=2.0)


@query(
    "x04_hypergeom_tail",
    f"""WITH t AS (SELECT l_suppkey AS s, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS d, (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS m FROM lineitem GROUP BY 1)
       SELECT s, k, d, round_even({_tail('k', 'n', 'm', 'd')}, 6) AS p FROM t""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    total = li.agg(F.struct(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("m"))).scalar()
    t = li.groupBy(F.col("l_suppkey").alias("s")).agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("d")).withColumn("t", total)
    return t.select("s", "k", "d", half_even(S.hypergeom_tail(F.col("k"), F.col("t.n"), F.col("t.m"), F.col("d")), 6).alias("p"))


@query(
    "x05_p_adjust",
    f"""WITH tested AS (SELECT l_returnflag AS query_id, l_orderkey, l_linenumber, (l_discount * 10 + l_tax + 0.001::DOUBLE) / 20 AS p FROM lineitem), {_BH.replace('min(p * m / rk) OVER (PARTITION BY query_id ORDER BY p DESC)', 'min(p * m / rk) OVER (PARTITION BY query_id ORDER BY p DESC)')}
       SELECT query_id, l_orderkey, l_linenumber, round_even(fdr, 6) AS fdr, round_even(fwer, 6) AS fwer FROM adjusted""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("query_id"), "l_orderkey", "l_linenumber", ((F.col("l_discount") * 10 + F.col("l_tax") + 0.001) / 20).alias("p"))
    return S.p_adjust(li, ["query_id"]).select("query_id", "l_orderkey", "l_linenumber", half_even("fdr", 6).alias("fdr"), half_even("fwer", 6).alias("fwer"))


@query(
    "w08_reverse_cumulative_min",
    "WITH v AS (SELECT p_brand, p_partkey, p_retailprice AS v FROM part) SELECT p_brand, p_partkey, min(v) OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS v FROM v",
)
def _(spark, sf):
    from pyspark.sql import Window as W

    p = table(spark, sf, "part")
    w = W.partitionBy("p_brand").orderBy(F.col("p_partkey").desc()).rowsBetween(W.unboundedPreceding, 0)
    return p.select("p_brand", "p_partkey", F.min("p_retailprice").over(w).alias("v"))


@query(
    "x06_ease",
    f"""WITH q AS (SELECT query_id, count(*) AS lt FROM sets GROUP BY 1), p AS (SELECT p_brand AS pathway_id, count(*) AS ph FROM part GROUP BY 1), n AS (SELECT count(*) AS n FROM part),
       o AS (SELECT query_id, p_brand AS pathway_id, count(*) AS lh FROM sets JOIN part ON p_partkey = gene GROUP BY ALL),
       t AS (SELECT q.query_id, p.pathway_id, lt, ph, n, coalesce(lh, 0) AS lh FROM q CROSS JOIN p CROSS JOIN n LEFT JOIN o ON o.query_id = q.query_id AND o.pathway_id = p.pathway_id),
       k AS (SELECT *, greatest(lh, 1) - 1 AS k FROM t), c AS (SELECT *, k + (ph - lh + 1) + (lt - lh) + (n - lt - ph + lh) AS total, k + ph - lh + 1 AS m, k + lt - lh AS d FROM k),
       tested AS (SELECT query_id, pathway_id, lh AS overlap, round({_tail('k', 'total', 'm', 'd')}, 12) AS p FROM c), {_BH}
       SELECT query_id, pathway_id, overlap, round_even(p, 6) AS p, round_even(fwer, 6) AS fwer FROM adjusted""",
    "sets",
)
def _(spark, sf):
    n = table(spark, sf, "part").count()
    e = E.ease(_sets(spark, sf), _pathways(spark, sf), n)
    return e.select("query_id", "pathway_id", "overlap", half_even("p", 6).alias("p"), half_even("fwer", 6).alias("fwer"))


@query(
    "x23_set_crosstalk",
    """SELECT query_id, p_brand AS pathway_id, count(DISTINCT (greatest(node, other), least(node, other))) AS n FROM conf_sym JOIN sets ON gene = node JOIN part ON p_partkey = other GROUP BY ALL""",
    "conf_sym sets",
)
def _(spark, sf):
    return E.set_crosstalk(X.net(spark, sf), _sets(spark, sf), _pathways(spark, sf))


# --- species, reports ------------------------------------------------------------------------


def _distances(spark, sf):
    """Distance of two nations: how much less they share customers' suppliers than the busiest pair."""
    li, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("c_nationkey").cast("string").alias("tax_a"), F.col("s_nationkey").cast("string").alias("tax_b")).agg((1 / F.count("*")).alias("distance"))


view(
    "dist",
    """SELECT c_nationkey::VARCHAR AS tax_a, s_nationkey::VARCHAR AS tax_b, 1 / count(*) AS distance FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
)


@query(
    "x08_closest_species",
    "SELECT tax_a AS tax_id, tax_b AS closest, distance FROM (SELECT *, row_number() OVER (PARTITION BY tax_a ORDER BY distance, tax_b) rn FROM dist WHERE tax_a <> tax_b AND tax_b IN (SELECT DISTINCT s_nationkey::VARCHAR FROM supplier WHERE s_acctbal > 5000)) WHERE rn = 1",
    "dist",
)
def _(spark, sf):
    modelled = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").cast("string").alias("tax_id")).distinct()
    return B.closest_species(_distances(spark, sf), modelled)


@query(
    "x09_closest_by_lineage",
    """WITH md AS (SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_acctbal > 9000), sp AS (SELECT DISTINCT c_nationkey AS n FROM customer),
       cand AS (SELECT sp.n AS x, md.n AS y, CASE WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 2 END AS up FROM sp JOIN nation a ON a.n_nationkey = sp.n JOIN md ON md.n <> sp.n JOIN nation b ON b.n_nationkey = md.n),
       r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY up, coalesce(distance, 'inf'::DOUBLE), y::VARCHAR) rn FROM cand LEFT JOIN dist ON tax_a = x::VARCHAR AND tax_b = y::VARCHAR)
       SELECT x::VARCHAR AS tax_id, y::VARCHAR AS closest, 'lineage' AS method FROM r WHERE rn = 1""",
    "dist",
)
def _(spark, sf):
    n = table(spark, sf, "nation")
    taxonomy = n.select(F.col("n_nationkey").cast("string").alias("tax_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).unionByName(
        n.select(F.concat(F.lit("r"), "n_regionkey").alias("tax_id"), F.lit("root").alias("parent")).distinct()
    )
    species = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("tax_id")).distinct()
    modelled = table(spark, sf, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").cast("string").alias("tax_id")).distinct()
    return B.closest_by_lineage(taxonomy, _distances(spark, sf), species, modelled)


def _typed_net(spark, sf):
    return X.feat(spark, sf).filter("type_a = type_b").select(F.col("type_a").alias("tax_id"), "a", "b")


@query(
    "x10_network_stats",
    """WITH n AS (SELECT type_a AS tax_id, a, b FROM feat WHERE type_a = type_b), e AS (SELECT tax_id, a AS node FROM n UNION ALL SELECT tax_id, b FROM n)
       SELECT n.tax_id, count(*) AS num_links, any_value(k) AS num_nodes, any_value(g) AS genome_size, 'trained' AS origin FROM n JOIN (SELECT tax_id, count(DISTINCT node) AS k FROM e GROUP BY 1) USING (tax_id)
       JOIN (SELECT p_type AS tax_id, count(*) AS g FROM part GROUP BY 1) USING (tax_id) GROUP BY 1""",
    "feat",
)
def _(spark, sf):
    return B.network_stats(_typed_net(spark, sf), table(spark, sf, "part").select(F.col("p_type").alias("tax_id")))


@query(
    "k08_upsert_stats",
    """WITH n AS (SELECT type_a AS tax_id, count(*) AS num_links FROM feat WHERE type_a = type_b AND n > 1 GROUP BY 1), o AS (SELECT p_type AS tax_id, 0::BIGINT AS num_links FROM part GROUP BY 1 UNION ALL SELECT r_name, 1 FROM region)
       SELECT * FROM n UNION ALL SELECT * FROM o WHERE tax_id NOT IN (SELECT tax_id FROM n)""",
    "feat",
)
def _(spark, sf):
    new = X.feat(spark, sf).filter("type_a = type_b and n > 1").groupBy(F.col("type_a").alias("tax_id")).agg(F.count("*").alias("num_links"))
    old = table(spark, sf, "part").select(F.col("p_type").alias("tax_id"), F.lit(0).cast("long").alias("num_links")).distinct()
    old = old.unionByName(table(spark, sf, "region").select(F.col("r_name").alias("tax_id"), F.lit(1).cast("long").alias("num_links")))
    return B.upsert_stats(new, old, ["tax_id"])


@query("x11_count_links", "SELECT gs, coalesce(n, 0) AS n_links FROM (SELECT unnest(['Complex', 'Metabolic', 'Operon', 'PPI', 'Regulatory', 'Signaling']) AS gs) LEFT JOIN (SELECT gs, count(*) AS n FROM gs_link GROUP BY 1) USING (gs)", "gs_link")
def _(spark, sf):
    from linkweave import vocab

    names = spark.createDataFrame([(g,) for g in vocab.GOLD_STANDARDS], "gs string")
    return B.count_links(X.gs_link(spark, sf), names, ["gs"])


@query(
    "x12_training_report",
    """WITH m AS (SELECT evidence_id, gs, CASE WHEN count(*) < 500 THEN '|PGS|<500' END AS error FROM pos GROUP BY ALL)
       SELECT gs, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS "|PGS|<500" FROM m GROUP BY 1""",
    "pos",
)
def _(spark, sf):
    from linkweave.operators import goldstandard as G

    pos = G.positives(X.evidence_link(spark, sf), X.gs_link(spark, sf)).groupBy("evidence_id", "gs").agg(F.when(F.count("*") < 500, "|PGS|<500").alias("error"))
    return B.training_report(pos, "gs", ["ok", "|PGS|<500"])


@query("x13_prune_empty_datasets", "SELECT s_suppkey AS evidence_id FROM supplier WHERE s_suppkey NOT IN (SELECT evidence_id FROM evidence_link)", "evidence_link")
def _(spark, sf):
    datasets = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("evidence_id"))
    return B.prune_report(X.evidence_link(spark, sf), datasets, X.pairs(spark, sf))[0]


@query("x13_prune_homolog_links", "SELECT evidence_id, a, b, direction FROM evidence_link WHERE (a, b) IN (SELECT (a, b) FROM pairs WHERE n > 1)", "evidence_link pairs")
def _(spark, sf):
    datasets = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("evidence_id"))
    found = B.prune_report(X.evidence_link(spark, sf), datasets, X.pairs(spark, sf).filter("n > 1"))[1]
    return found.select("evidence_id", "a", "b", "direction")


@query("x13_species_links", "SELECT evidence_id, a, b FROM evidence_link WHERE tax_id = '10090'", "evidence_link")
def _(spark, sf):
    return B.species_links(X.evidence_link(spark, sf), "10090").select("evidence_id", "a", "b")


@query(
    "x14_ppv_bands",
    """SELECT brand_a AS brand, CASE WHEN ppv >= 0.95 THEN 'high' WHEN ppv >= 0.85 THEN 'medium' ELSE 'low' END AS band, count(*) AS n_links FROM net JOIN feat USING (a, b) WHERE ppv >= 0.6 GROUP BY ALL""",
    "net feat",
)
def _(spark, sf):
    from linkweave.plans.fixtures import size_gap

    f = X.feat(spark, sf).withColumn("ppv", half_even(0.5 + 0.5 * (1 - size_gap() / 50.0), 3)).withColumn("brand", F.col("brand_a"))
    return B.ppv_bands(f, ["brand"], [("low", 0.6), ("medium", 0.85), ("high", 0.95)], "ppv")


@query("x14_gold_standard_share", "SELECT gs, count(*) AS n_links, count(*) FILTER (is_ppv_gs = 1) AS n_from_gs FROM final_gs WHERE ppv > 0 GROUP BY 1", "final_gs")
def _(spark, sf):
    return B.gold_standard_share(T.network(spark, sf), [])


@query(
    "x14_llr_share",
    """WITH e AS (SELECT gs, type AS part, round_even(sum(wllr), 3) AS v FROM weighted WHERE (a, b, direction) IN (SELECT (a, b, direction) FROM fbs) GROUP BY a, b, direction, gs, type)
       SELECT gs, part, round_even(sum(v), 2) AS llr, count(*) FILTER (v > 0) AS n_positive, round_even(sum(v) / sum(sum(v)) OVER (PARTITION BY gs), 6) AS share FROM e GROUP BY gs, part""",
    "weighted fbs",
)
def _(spark, sf):
    s = B.llr_share(T.fbs_table(spark, sf), "llr_ev", ["gs"])
    return s.select("gs", "part", half_even("llr", 2).alias("llr"), "n_positive", half_even("share", 6).alias("share"))


@query("x14_directed_links", "SELECT direction, count(DISTINCT (a, b)) AS n_directed FROM final_gs WHERE direction > 0 GROUP BY 1", "final_gs")
def _(spark, sf):
    return B.directed_links(T.network(spark, sf), ["direction"])


@query("x15_histogram", "SELECT least(floor((fbs - 0.0::DOUBLE) / ((2.0::DOUBLE - 0.0::DOUBLE) / 40)) + 1, 40)::INT AS bin, count(*) AS n FROM net WHERE fbs BETWEEN 0 AND 2 GROUP BY 1", "net")
def _(spark, sf):
    return O.histogram(X.net(spark, sf), "fbs", 40, 0.0, 2.0)


@query(
    "x16_pathway_members",
    "SELECT DISTINCT o_custkey AS pathway_id, protein_id FROM (SELECT DISTINCT o_custkey, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN id_mapping ON mapped_id = 'sup:' || s OR mapped_id = s::VARCHAR",
    "id_mapping",
)
def _(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    entries = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("pathway_id"), F.concat(F.lit("sup:"), "l_suppkey").alias("gene"))
    return B.pathway_members(entries, X.id_mapping(spark, sf))


@query(
    "x17_tissue_members",
    """WITH k AS (SELECT s_name AS gene, upper(left(o_orderpriority, 1)) || lower(substr(o_orderpriority, 2)) AS tissue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' AND l_linenumber <> 1),
       g AS (SELECT tissue FROM k GROUP BY 1 HAVING count(*) >= 100), j AS (SELECT DISTINCT protein_id, tissue FROM k JOIN g USING (tissue) JOIN id_mapping ON mapped_id = gene)
       SELECT protein_id, tissue, dense_rank() OVER (ORDER BY tissue) AS tissue_id FROM j""",
    "id_mapping",
)
def _(spark, sf):
    li, o, s = (table(spark, sf, t) for t in ("lineitem", "orders", "supplier"))
    calls = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit(" "), "s_name").alias("gene"), F.col("o_orderpriority").alias("tissue"),
        F.when(F.col("l_returnflag") == "R", "High").otherwise("Not detected").alias("level"), F.when(F.col("l_linenumber") == 1, "Uncertain").otherwise("Approved").alias("reliability"),
    )
    return B.tissue_members(calls, X.id_mapping(spark, sf), "hpa")


def _accessions(spark, sf):
    """Customers' accessions, their names as Ensembl ids shared inside a nation and segment of one balance sign."""
    c = table(spark, sf, "customer")
    acc = F.concat(F.lit("C"), "c_custkey")
    gene = F.concat_ws("-", F.lit("ENS"), "c_nationkey", F.floor(F.col("c_acctbal") / 1000))
    return c.filter("c_mktsegment = 'BUILDING'").select(acc.alias("uniprot_id")), c.select(acc.alias("acc"), F.lit("Ensembl").alias("type"), gene.alias("mapped_id")).unionByName(
        c.filter("c_nationkey = 7").select(acc.alias("acc"), F.lit("Ensembl").alias("type"), F.lit("ENS-x").alias("mapped_id"))
    ).unionByName(c.select(acc.alias("acc"), F.lit("Gene_Symbol").alias("type"), F.col("c_name").alias("mapped_id")))


@query(
    "x18_build_id_mapping",
    """WITH m AS (SELECT 'C' || c_custkey AS acc, 'Ensembl' AS type, 'ENS-' || c_nationkey || '-' || floor(c_acctbal / 1000)::BIGINT AS mapped_id FROM customer
                  UNION ALL SELECT 'C' || c_custkey, 'Ensembl', 'ENS-x' FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'C' || c_custkey, 'Gene_Symbol', c_name FROM customer),
       p AS (SELECT 'C' || c_custkey AS u FROM customer WHERE c_mktsegment = 'BUILDING'), g AS (SELECT u, max(mapped_id) AS e FROM p JOIN m ON acc = u AND type = 'Ensembl' GROUP BY 1),
       o AS (SELECT * FROM m WHERE acc NOT IN (SELECT u FROM p)), s AS (SELECT acc, max(mapped_id) AS e FROM o WHERE type = 'Ensembl' GROUP BY 1 HAVING count(*) < 2), a AS (SELECT u, acc FROM s JOIN g USING (e))
       SELECT u AS uniprot_id, 'UniProtID' AS type, u AS mapped_id FROM p UNION SELECT acc, type, mapped_id FROM m WHERE acc IN (SELECT u FROM p)
       UNION SELECT u, 'alt_uniprot_id', acc FROM a UNION SELECT u, 'alt_' || type, mapped_id FROM a JOIN o USING (acc)""",
)
def _(spark, sf):
    return B.build_id_mapping(*_accessions(spark, sf))


@query("x19_new_mappings", "SELECT protein_id, type, mapped_id FROM id_mapping WHERE tax_id >= '2' EXCEPT SELECT protein_id, type, mapped_id FROM id_mapping WHERE type = 'KEGG'", "id_mapping")
def _(spark, sf):
    m = X.id_mapping(spark, sf)
    return B.new_mappings(m.filter("type = 'KEGG'"), m.filter("tax_id >= '2'").drop("tax_id"))


@query(
    "x20_build_orthologs",
    """WITH g AS (SELECT DISTINCT l_orderkey AS g, 'S' || l_suppkey AS p, 9606 AS t FROM lineitem UNION SELECT DISTINCT l_orderkey, 'P' || l_partkey, 10090 FROM lineitem)
       SELECT DISTINCT substr(x.p, 2)::BIGINT AS protein_a, substr(y.p, 2)::BIGINT AS protein_b, x.t::VARCHAR AS species_a, y.t::VARCHAR AS species_b FROM g x JOIN g y ON x.g = y.g AND x.t > y.t""",
)
def _(spark, sf):
    li, s, p = (table(spark, sf, t) for t in ("lineitem", "supplier", "part"))
    each = F.explode(F.array(F.struct(F.lit("9606").alias("t"), F.concat(F.lit("S"), "l_suppkey").alias("p")), F.struct(F.lit("10090").alias("t"), F.concat(F.lit("P"), "l_partkey").alias("p"))))
    groups = li.select(F.lit("9606-10090").alias("pair_id"), F.col("l_orderkey").alias("group"), each.alias("e")).select("pair_id", "group", F.col("e.t").alias("tax_id"), F.col("e.p").alias("protein")).distinct()
    ids = s.select(F.concat(F.lit("S"), "s_suppkey").alias("mapped_id"), F.col("s_suppkey").alias("protein_id"), F.lit("9606").alias("tax_id")).unionByName(
        p.select(F.concat(F.lit("P"), "p_partkey").alias("mapped_id"), F.col("p_partkey").alias("protein_id"), F.lit("10090").alias("tax_id"))
    )
    return B.build_orthologs(groups, ids)


@query(
    "x21_missing_datasets",
    """SELECT p_type AS type, p_size::VARCHAR AS tax_id, p_brand AS version, 'm' AS scoring_method FROM part GROUP BY ALL
       EXCEPT SELECT p_type, p_size::VARCHAR, p_brand, 'm' FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity = 50""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    cfg = [F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("tax_id"), F.col("p_brand").alias("version"), F.lit("m").alias("scoring_method")]
    stored = p.join(table(spark, sf, "lineitem").filter("l_quantity = 50"), F.col("l_partkey") == F.col("p_partkey")).select(*cfg)
    return B.missing_datasets(p.select(*cfg).distinct(), stored)


@query(
    "x22_refresh_orthologs",
    """WITH o AS (SELECT l_partkey AS protein_a, l_suppkey AS protein_b, p_size::VARCHAR AS species_a, s_nationkey::VARCHAR AS species_b, l_returnflag AS version FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
       SELECT DISTINCT * FROM o WHERE version = 'N' AND species_a NOT IN ('3', '7') AND species_b NOT IN ('3', '7') UNION ALL SELECT DISTINCT * FROM o WHERE version = 'R' AND (species_a IN ('3', '7') OR species_b IN ('3', '7'))""",
)
def _(spark, sf):
    li, p, s, n = (table(spark, sf, t) for t in ("lineitem", "part", "supplier", "nation"))
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_partkey").alias("protein_a"), F.col("l_suppkey").alias("protein_b"), F.col("p_size").cast("string").alias("species_a"), F.col("s_nationkey").cast("string").alias("species_b"), F.col("l_returnflag").alias("version")
    ).distinct()
    again = n.filter("n_nationkey in (3, 7)").select(F.col("n_nationkey").cast("string").alias("tax_id"))
    return B.refresh_orthologs(rows.filter("version = 'N'"), rows.filter("version = 'R'"), again)


# --- scalar functions ------------------------------------------------------------------------


@query(
    "f01_string_functions",
    """SELECT c_custkey, upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2) AS capital, replace(c_name, '#', ' ') AS name, split_part(c_name, '#', 2) AS number, starts_with(c_name, 'Customer') AS is_customer, trim(' ' || c_mktsegment || ' ') AS trimmed FROM customer""",
)
def _(spark, sf):
    from linkweave.operators.filters import capitalize

    return table(spark, sf, "customer").select(
        "c_custkey", capitalize(F.col("c_mktsegment")).alias("capital"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("name"),
        C.last_of_list("c_name", "#").alias("number"), F.col("c_name").startswith("Customer").alias("is_customer"), F.trim(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("trimmed"),
    )


@query("f02_regex", "SELECT event_id, regexp_extract(props, '\"k\": ([0-9]+)', 1) AS k, len(regexp_split_to_array(props, '\\W+')) AS words FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.regexp_extract("props", '"k": ([0-9]+)', 1).alias("k"), F.size(F.split("props", r"\W+")).alias("words"))


@query(
    "f03_math",
    """SELECT l_orderkey, l_linenumber, round_even((0.5::DOUBLE * x + -1.0::DOUBLE) * x + 2.0::DOUBLE, 6) AS poly, round_even(1.0::DOUBLE / (1 + exp(-2.0::DOUBLE * (x - 0.5::DOUBLE))), 6) AS logistic, round_even(ln(x) + log10(x), 6) AS logs
       FROM (SELECT l_orderkey, l_linenumber, least(greatest(l_quantity / 25, 0.1::DOUBLE), 1.5::DOUBLE) AS x FROM lineitem)""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.clip(F.col("l_quantity") / 25, F.lit(0.1), F.lit(1.5)).alias("x"))
    poly = C.polynomial(F.array(F.lit(0.5), F.lit(-1.0), F.lit(2.0)), "x")
    return li.select(
        "l_orderkey", "l_linenumber", half_even(poly, 6).alias("poly"),
        half_even(C.logistic(F.col("x"), F.lit(1.0), F.lit(2.0), F.lit(0.5)), 6).alias("logistic"), half_even(F.log("x") + F.log10("x"), 6).alias("logs"),
    )


@query(
    "f04_array_sets",
    """WITH s AS (SELECT l_orderkey, list_distinct(list(l_suppkey) FILTER (l_returnflag = 'R')) AS x, list_distinct(list(l_suppkey) FILTER (l_returnflag <> 'R')) AS y FROM lineitem GROUP BY 1)
       SELECT l_orderkey, len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) AS n_union, len(list_intersect(coalesce(x, []), coalesce(y, []))) AS n_both, coalesce(len(x), 0) - len(list_intersect(coalesce(x, []), coalesce(y, []))) AS n_only FROM s""",
)
def _(spark, sf):
    r = F.col("l_returnflag") == "R"
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(r, F.col("l_suppkey"))).alias("x"), F.collect_set(F.when(~r, F.col("l_suppkey"))).alias("y"))
    return s.select("l_orderkey", *[F.size(e).cast("long").alias(n) for e, n in ((F.array_union("x", "y"), "n_union"), (F.array_intersect("x", "y"), "n_both"), (F.array_except("x", "y"), "n_only"))])


@query("f05_map_lookup", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 3 ELSE 0 END AS direction FROM lineitem")
def _(spark, sf):
    codes = F.create_map(F.lit("A"), F.lit(2), F.lit("R"), F.lit(3))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(codes[F.col("l_returnflag")], F.lit(0)).alias("direction"))


@query(
    "f06_flags",
    """WITH c AS (SELECT a, b, gs, max(direction) AS d FROM gs_link GROUP BY ALL), p AS (SELECT DISTINCT a, b FROM c), t AS (SELECT unnest(['Complex', 'Metabolic', 'Operon', 'PPI', 'Regulatory', 'Signaling']) AS gs, unnest(range(6)) AS pos)
       SELECT p.a, p.b, string_agg(coalesce(d, 0)::VARCHAR, '' ORDER BY pos) AS flags, count(d) AS n_known FROM p CROSS JOIN t LEFT JOIN c ON c.a = p.a AND c.b = p.b AND c.gs = t.gs GROUP BY ALL""",
    "gs_link",
)
def _(spark, sf):
    from linkweave import vocab

    d = X.gs_link(spark, sf).groupBy("a", "b").agg(*[F.coalesce(F.max(F.when(F.col("gs") == g, F.col("direction"))), F.lit(0)).alias(g) for g in vocab.GOLD_STANDARDS])
    flags = F.array(*vocab.GOLD_STANDARDS)
    return d.select("a", "b", C.join_flags(flags).alias("flags"), F.size(F.filter(flags, lambda f: f > 0)).cast("long").alias("n_known"))


@query("f08_nulls", "SELECT g.a, g.b, coalesce(n.ppv, 0) AS ppv FROM gs_link g LEFT JOIN (SELECT a, b, ppv FROM net WHERE ppv > 0.9) n ON n.a = g.a AND n.b = g.b", "gs_link net")
def _(spark, sf):
    return X.gs_link(spark, sf).join(X.net(spark, sf).filter("ppv > 0.9").select("a", "b", "ppv"), ["a", "b"], "left").fillna({"ppv": 0.0}).select("a", "b", "ppv")


@query("f09_scientific", "SELECT p_partkey, printf('%.2e', 1 / (p_retailprice * 1000)) AS p FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.scientific(1 / (F.col("p_retailprice") * 1000)).alias("p"))


@query("g12_pivot_report", "SELECT p_brand, count(*) FILTER (p_type = 'PROMO') AS promo, count(*) FILTER (p_type = 'ECONOMY') AS economy FROM part GROUP BY 1")
def _(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand").pivot("p_type", ["PROMO", "ECONOMY"]).count().fillna(0)
    return p.withColumnsRenamed({"PROMO": "promo", "ECONOMY": "economy"})


@query("w09_rank_with_previous", "SELECT a, b, evidence_id, row_number() OVER w AS rk, coalesce(lag(evidence_id) OVER w, -1) AS prev FROM evidence_link WINDOW w AS (PARTITION BY a, b ORDER BY score DESC, evidence_id, direction)", "evidence_link")
def _(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("a", "b").orderBy(F.col("score").desc(), "evidence_id", "direction")
    return X.evidence_link(spark, sf).select("a", "b", "evidence_id", F.row_number().over(w).alias("rk"), F.coalesce(F.lag("evidence_id").over(w), F.lit(-1)).alias("prev"))
