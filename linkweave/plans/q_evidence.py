"""Registered queries: pair scores under each kind of evidence."""

import pandas as pd
from pyspark.sql import functions as F

from linkweave.functions.columns import half_even
from linkweave.operators import allpairs as A
from linkweave.operators import evidence as E
from linkweave.operators import filters as P
from linkweave.operators import pairs as J
from linkweave.plans import fixtures as X
from linkweave.plans.q_pairs import abundance, boxcox_sql
from linkweave.plans.registry import query, table, view

_JACCARD = """SELECT x.id AS a, y.id AS b, count(*) AS shared, round_even(count(*) / (any_value(nx.n) + any_value(ny.n) - count(*)), 6) AS score
   FROM {s} x JOIN {s} y ON x.attr = y.attr AND x.id > y.id
   JOIN (SELECT id, count(*) n FROM {s} GROUP BY 1) nx ON nx.id = x.id JOIN (SELECT id, count(*) n FROM {s} GROUP BY 1) ny ON ny.id = y.id
   GROUP BY 1, 2"""


@query("e01_jaccard_pairs", _JACCARD.format(s="sup_sets"), "sup_sets")
def _(spark, sf):
    return E.jaccard_pairs(X.sup_sets(spark, sf)).withColumn("score", half_even("score", 6))


@query(
    "u04_shared_terms",
    """SELECT l.a, l.b, string_agg(x.attr::VARCHAR, ',' ORDER BY x.attr) AS terms FROM sup_links l
       JOIN sup_sets x ON x.id = l.a JOIN sup_sets y ON y.id = l.b AND y.attr = x.attr GROUP BY ALL""",
    "sup_links sup_sets",
)
def _(spark, sf):
    terms = E.shared_terms(X.sup_links(spark, sf), X.sup_sets(spark, sf))
    return terms.select("a", "b", F.array_join(F.transform("terms", lambda t: t.cast("string")), ",").alias("terms"))


def _expression(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("protein_id"), F.posexplode("embedding").alias("sample", "value")).withColumn("value", F.col("value").cast("double"))


view(
    "expr_rank",
    """SELECT protein_id, sample, rank() OVER (PARTITION BY protein_id ORDER BY value) + (count(*) OVER (PARTITION BY protein_id, value) - 1) / 2 AS r
       FROM (SELECT vec_id AS protein_id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) AS sample FROM embeddings)""",
)
view("spearman", "SELECT x.protein_id AS a, y.protein_id AS b, round(corr(x.r, y.r), 12) AS r FROM expr_rank x JOIN expr_rank y ON x.sample = y.sample AND x.protein_id > y.protein_id GROUP BY 1, 2", "expr_rank")


@query("e02_spearman_pairs", "SELECT a, b, round_even(r, 9) AS score FROM spearman WHERE abs(r) > 0.1", "spearman")
def _(spark, sf):
    return A.spearman_pairs(_expression(spark, sf), 3, 0.1).withColumn("score", half_even("score", 9))


@query("e02_strong_spearman_pairs", "SELECT a, b, round_even(r, 9) AS score FROM spearman WHERE abs(r) > 0.5", "spearman")
def _(spark, sf):
    return A.strong_spearman_pairs(_expression(spark, sf), 3, 0.5).withColumn("score", half_even("score", 9))


def _monthly(spark, sf):
    """Supplier x day profiles with gaps: days without goods are missing."""
    li = table(spark, sf, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return li.groupBy(F.col("l_suppkey").alias("protein_id"), day.alias("sample")).agg(F.sum("l_quantity").alias("value"))


@query(
    "e02_spearman_with_gaps",
    """WITH m AS (SELECT l_suppkey AS id, strftime(l_shipdate, '%Y-%m-%d') AS s, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
       c AS (SELECT x.id AS a, y.id AS b, x.s, x.v AS vx, y.v AS vy FROM m x JOIN m y ON x.s = y.s AND x.id > y.id),
       r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY vx) + (count(*) OVER (PARTITION BY a, b, vx) - 1) / 2 AS rx,
                    rank() OVER (PARTITION BY a, b ORDER BY vy) + (count(*) OVER (PARTITION BY a, b, vy) - 1) / 2 AS ry FROM c)
       SELECT a, b, round_even(corr(rx, ry), 9) AS score FROM r GROUP BY ALL HAVING count(*) >= 5 AND corr(rx, ry) IS NOT NULL AND NOT isnan(corr(rx, ry))""",
)
def _(spark, sf):
    return A.spearman_pairs(_monthly(spark, sf), 5).withColumn("score", half_even("score", 9))


def _hits(spark, sf):
    """Brand and type play the domains of a part; order lines of suppliers repeat them."""
    li = table(spark, sf, "lineitem")
    p = table(spark, sf, "part")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("protein_id"), F.col("p_brand").alias("domain"))


def _ddi(spark, sf):
    """Brand pairs of co-ordered parts of equal size, scored by the mean shared-order count."""
    f = X.feat(spark, sf).filter("size_a = size_b AND brand_a < brand_b")
    return f.groupBy(F.col("brand_a").alias("domain_a"), F.col("brand_b").alias("domain_b")).agg(F.max(F.col("price_a") / 1000).alias("score"))


view("hits", "SELECT l_suppkey AS protein_id, p_brand AS domain FROM lineitem JOIN part ON l_partkey = p_partkey")
view("ddi", "SELECT brand_a AS domain_a, brand_b AS domain_b, max(price_a / 1000) AS score FROM feat WHERE size_a = size_b AND brand_a < brand_b GROUP BY ALL", "feat")
view(
    "ddi_pairs",
    """SELECT greatest(x.protein_id, y.protein_id) AS a, least(x.protein_id, y.protein_id) AS b, domain_a, domain_b, max(score) AS score
       FROM ddi JOIN (SELECT DISTINCT * FROM hits) x ON x.domain = domain_a JOIN (SELECT DISTINCT * FROM hits) y ON y.domain = domain_b
       WHERE x.protein_id <> y.protein_id GROUP BY ALL""",
    "ddi hits",
)


@query("j14_domain_pairs", "SELECT * FROM ddi_pairs", "ddi_pairs")
def _(spark, sf):
    return E.domain_pairs(_ddi(spark, sf), _hits(spark, sf))


_DOMAIN = """WITH f AS (SELECT domain, count(*) AS f FROM (SELECT domain_a AS domain FROM ddi UNION ALL SELECT domain_b FROM ddi) GROUP BY 1),
   n AS (SELECT protein_id, count(*) AS n FROM hits GROUP BY 1),
   w AS (SELECT p.*, score / ln(1 + fa.f + fb.f) AS w FROM ddi_pairs p JOIN f fa ON fa.domain = domain_a JOIN f fb ON fb.domain = domain_b)
   SELECT a, b, round_even(avg(w) * (count(*) / (any_value(na.n) * any_value(nb.n))), 8) AS score, {meta}
   FROM w JOIN n na ON na.protein_id = a JOIN n nb ON nb.protein_id = b GROUP BY a, b"""


@query("e03_domain_scores", _DOMAIN.format(meta="count(*) AS n_domains"), "ddi_pairs")
def _(spark, sf):
    d = E.domain_scores(_ddi(spark, sf), _hits(spark, sf))
    return d.select("a", "b", half_even("score", 8).alias("score"), F.size("metadata").cast("long").alias("n_domains"))


@query(
    "g02_domain_pair_agg",
    _DOMAIN.format(meta="string_agg(domain_a || '-' || domain_b, ',' ORDER BY domain_a || '-' || domain_b) AS metadata"),
    "ddi_pairs",
)
def _(spark, sf):
    d = E.domain_scores(_ddi(spark, sf), _hits(spark, sf))
    return d.select("a", "b", half_even("score", 8).alias("score"), F.array_join(F.array_sort("metadata"), ",").alias("metadata"))


def _paper_rows(spark, sf):
    """Every order is a paper reporting all its part pairs, once per return flag of the first part."""
    members = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pmid"), F.col("l_returnflag").alias("method"), F.col("l_partkey").alias("m"))
    from linkweave.operators.tiles import member_pairs

    return member_pairs(members, ["pmid", "method"], "m").select("a", "b", "method", F.col("pmid").cast("string").alias("pmid"))


@query(
    "e04_publication_scores",
    """WITH m AS (SELECT DISTINCT l_orderkey AS pmid, l_returnflag AS method, l_partkey AS m FROM lineitem),
       r AS (SELECT x.m AS a, y.m AS b, pmid, count(*) AS n FROM m x JOIN m y USING (pmid, method) WHERE x.m > y.m GROUP BY ALL),
       p AS (SELECT pmid, count(*) AS c FROM r GROUP BY 1),
       d AS (SELECT node, count(*) AS d FROM (SELECT a AS node FROM r UNION ALL SELECT b FROM r) GROUP BY 1)
       SELECT a, b, round_even(sum(n / ln(1 + c)) / sum(n) / ln(any_value(x.d) + any_value(y.d)), 8) AS score
       FROM r JOIN p USING (pmid) JOIN d x ON x.node = a JOIN d y ON y.node = b GROUP BY a, b""",
)
def _(spark, sf):
    return E.publication_scores(_paper_rows(spark, sf)).select("a", "b", half_even("score", 8).alias("score"))


@query(
    "e05_expand_complexes",
    """WITH c AS (SELECT DISTINCT 'complex:' || l_orderkey AS cx, 'pubmed:' || l_orderkey AS pmid,
                  CASE WHEN l_linestatus = 'O' THEN 'MI:00' || (l_linenumber + 10) ELSE 'MI:0000' END AS method, 'P' || l_partkey || '-' || l_linenumber AS m
                  FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 7)
       SELECT x.m AS protein_a, y.m AS protein_b, x.method || '|' || x.cx || '|' || (SELECT count(*) FROM c z WHERE z.cx = x.cx AND z.pmid = x.pmid AND z.method = x.method) AS method, x.pmid
       FROM c x JOIN c y ON x.cx = y.cx AND x.pmid = y.pmid AND x.method = y.method AND x.m > y.m""",
)
def _(spark, sf):
    return E.expand_complexes(P.interaction_rows(X.mitab(spark, sf)))


_GENETIC = """WITH m AS (SELECT p, s, avg(v) AS v FROM (SELECT greatest(l_suppkey, b) AS x, least(l_suppkey, b) AS y, v FROM
                    (SELECT l_suppkey, c_nationkey + 1000000 AS b, l_discount - l_tax AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey))
                  , LATERAL (SELECT x AS p, y AS s UNION ALL SELECT y, x) GROUP BY p, s),
       c AS (SELECT x.p AS a, y.p AS b, x.v AS vx, y.v AS vy FROM m x JOIN m y ON x.s = y.s AND x.p > y.p),
       r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY round(vx, 9)) + (count(*) OVER (PARTITION BY a, b, round(vx, 9)) - 1) / 2 AS rx,
                    rank() OVER (PARTITION BY a, b ORDER BY round(vy, 9)) + (count(*) OVER (PARTITION BY a, b, round(vy, 9)) - 1) / 2 AS ry FROM c)
       SELECT a, b, round_even(corr(rx, ry), 9) AS score FROM r GROUP BY ALL HAVING count(*) >= 5 AND corr(rx, ry) IS NOT NULL AND NOT isnan(corr(rx, ry))"""


def _genetic(spark, sf):
    li, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    rows = (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("l_suppkey").alias("a"), (F.col("c_nationkey") + 1000000).cast("long").alias("b"), (F.col("l_discount") - F.col("l_tax")).alias("score"))
    )
    # scores are means of two-digit numbers: equal means must tie whatever order they were added in
    return rows.groupBy("a", "b").agg(F.round(F.avg("score"), 9).alias("score"))


@query("e06_genetic_profile_pairs", _GENETIC)
def _(spark, sf):
    return E.genetic_profile_pairs(_genetic(spark, sf)).withColumn("score", half_even("score", 9))


@query("e06_strong_genetic_pairs", f"SELECT * FROM ({_GENETIC}) WHERE abs(score) > 0.30005")
def _(spark, sf):
    return E.genetic_profile_pairs(_genetic(spark, sf), min_abs=0.30005).withColumn("score", half_even("score", 9))


@query(
    "e07_coexpression_pairs",
    """WITH h AS (SELECT DISTINCT greatest(x.vec_id, y.vec_id) AS a, least(x.vec_id, y.vec_id) AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id),
       k AS (SELECT a, b, abs(r) AS s, CASE WHEN r < 0 THEN '-' ELSE '' END AS sign FROM spearman WHERE abs(r) > 0.1 AND (a, b) NOT IN (SELECT (a, b) FROM h)),
       g AS (SELECT min(s) AS lo, max(s) AS hi FROM k)
       SELECT a, b, round_even((s - lo) / (hi - lo), 6) AS score, sign, round_even(lo, 4) AS score_min, round_even(hi, 4) AS score_max FROM k, g""",
    "spearman",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    expr = _expression(spark, sf).select(F.concat(F.lit("V"), "protein_id").alias("gene"), "sample", "value")
    mapping = e.select(F.concat(F.lit("V"), "vec_id").alias("mapped_id"), F.col("vec_id").alias("protein_id"))
    from linkweave.operators.tiles import member_pairs

    homologs = member_pairs(e.select("label", "vec_id"), ["label"], "vec_id").select("a", "b")
    return E.coexpression_pairs(expr, mapping, homologs, 64, places=6)


def _abundance(spark, sf):
    return abundance(spark, sf).select(F.lit("9606").alias("tax_id"), "organ", F.col("organ").alias("filename"), "gene", "value")


view(
    "top_tissue",
    """SELECT gene AS id, upper(left(organ, 1)) || lower(substr(organ, 2)) AS attr FROM (
         SELECT *, row_number() OVER (PARTITION BY organ ORDER BY value DESC, gene) rn, count(*) OVER (PARTITION BY organ) n FROM
           (SELECT o_orderpriority AS organ, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL))
       WHERE rn <= round_even(n * 0.25, 0)""",
)


@query("e08_abundance_tissues", "SELECT '9606' AS tax_id, id AS gene, attr AS tissue FROM top_tissue", "top_tissue")
def _(spark, sf):
    return E.abundance_tissues(_abundance(spark, sf))


@query(
    "e08_abundance_pairs_jaccard",
    "WITH j AS (" + _JACCARD.format(s="top_tissue") + """) SELECT shared, score, count(*) AS n FROM j GROUP BY ALL""",
    "top_tissue",
)
def _(spark, sf):
    j = E.abundance_pairs(_abundance(spark, sf))
    return j.groupBy("shared", half_even("score", 6).alias("score")).agg(F.count("*").alias("n"))


_COABUNDANT = """WITH m AS (SELECT l_suppkey AS id, o_orderpriority || l_returnflag AS s, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
       c AS (SELECT x.id AS a, y.id AS b, x.v AS vx, y.v AS vy FROM m x JOIN m y ON x.s = y.s AND x.id > y.id),
       r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY vx) + (count(*) OVER (PARTITION BY a, b, vx) - 1) / 2 AS rx,
                    rank() OVER (PARTITION BY a, b ORDER BY vy) + (count(*) OVER (PARTITION BY a, b, vy) - 1) / 2 AS ry FROM c)
       SELECT a, b, round_even(corr(rx, ry), 9) AS score FROM r GROUP BY ALL HAVING count(*) >= 5 AND corr(rx, ry) IS NOT NULL AND NOT isnan(corr(rx, ry))"""


def _supplies(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("l_suppkey").alias("gene"), F.concat("o_orderpriority", "l_returnflag").alias("filename"))
        .agg(F.sum("l_quantity").alias("value"))
    )


@query("e08_abundance_pairs_spearman", _COABUNDANT)
def _(spark, sf):
    return E.abundance_pairs(_supplies(spark, sf), "spearman").withColumn("score", half_even("score", 9))


@query("e08_strong_abundance_pairs", f"SELECT * FROM ({_COABUNDANT}) WHERE abs(score) > 0.60005")
def _(spark, sf):
    return E.abundance_pairs(_supplies(spark, sf), "spearman", min_abs=0.60005).withColumn("score", half_even("score", 9))


def _presence(spark, sf):
    """Nations that buy no less than the average of a supplier's nations, seen as ortholog hits."""
    li, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    bought = rows.groupBy("l_suppkey", "c_nationkey").agg(F.sum("l_quantity").alias("q"))
    usual = bought.groupBy("l_suppkey").agg(F.sum("q").alias("total"), F.count("*").alias("n"))
    good = bought.join(usual, "l_suppkey").filter("q * n >= total").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return good.select(F.col("s_suppkey").alias("protein"), F.col("s_nationkey").alias("species"), F.col("c_nationkey").alias("other_species"))


view(
    "buyers",
    """SELECT p, other FROM (SELECT *, sum(q) OVER (PARTITION BY p) AS total, count(*) OVER (PARTITION BY p) AS n FROM
         (SELECT l_suppkey AS p, c_nationkey AS other, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL))
       WHERE q * n >= total""",
)
view("presence", "SELECT DISTINCT p, s FROM (SELECT p, s_nationkey AS own, other FROM buyers JOIN supplier ON p = s_suppkey), LATERAL (SELECT own AS s UNION ALL SELECT other)", "buyers")


@query("e09_presence_profiles", "SELECT p AS protein_id, string_agg(s::VARCHAR, ',' ORDER BY s) AS profile FROM presence GROUP BY 1", "presence")
def _(spark, sf):
    p = E.presence_profiles(_presence(spark, sf))
    return p.select("protein_id", F.array_join(F.transform("species", lambda s: s.cast("string")), ",").alias("profile"))


@query(
    "w03_keep_fullest_profile",
    """WITH q AS (SELECT s_nationkey::BIGINT AS protein_id, p, count(*) AS n, string_agg(s::VARCHAR, ',' ORDER BY s) AS profile FROM presence JOIN supplier ON s_suppkey = p GROUP BY ALL)
       SELECT protein_id, profile FROM (SELECT *, row_number() OVER (PARTITION BY protein_id ORDER BY n DESC, profile DESC) rn FROM q) WHERE rn = 1""",
    "presence",
)
def _(spark, sf):
    # several suppliers of a nation stand for identifiers of one protein
    mapping = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("mapped_id"), F.col("s_nationkey").cast("long").alias("protein_id"))
    p = E.presence_profiles(_presence(spark, sf), mapping)
    return p.select("protein_id", F.array_join(F.transform("species", lambda s: s.cast("string")), ",").alias("profile"))


def nation_branches(spark, sf) -> pd.DataFrame:
    """Two-level tree nation -> region; 30 branches at any scale."""
    n = table(spark, sf, "nation").toPandas()
    leaf = pd.DataFrame({"species": n.n_nationkey, "branch": "n" + n.n_nationkey.astype(str), "length": 1 + n.n_nationkey / 100})
    top = pd.DataFrame({"species": n.n_nationkey, "branch": "r" + n.n_regionkey.astype(str), "length": 1 + n.n_regionkey / 100})
    return pd.concat([leaf, top])


_PHYLO = """WITH br AS (SELECT n_nationkey AS s, 'n' || n_nationkey AS branch, 1 + n_nationkey / 100 AS len FROM nation UNION ALL SELECT n_nationkey, 'r' || n_regionkey, 1 + n_regionkey / 100 FROM nation),
       ids AS (SELECT DISTINCT p FROM presence),
       cmp AS (SELECT x.p AS a, y.p AS b, s.n_nationkey AS s, (px.s IS NOT NULL)::INT + (py.s IS NOT NULL)::INT AS k
               FROM ids x JOIN ids y ON x.p > y.p CROSS JOIN nation s LEFT JOIN presence px ON px.p = x.p AND px.s = s.n_nationkey LEFT JOIN presence py ON py.p = y.p AND py.s = s.n_nationkey),
       brk AS (SELECT a, b, branch, any_value(len) AS len, max(k) AS k FROM cmp JOIN br USING (s) WHERE k > 0 GROUP BY a, b, branch),
       sums AS (SELECT a, b, sum(CASE WHEN k = 2 THEN len ELSE 0 END) AS pos, sum(CASE WHEN k = 1 THEN len ELSE 0 END) AS neg FROM brk GROUP BY a, b),
       cnt AS (SELECT a, b, count(*) FILTER (k = 2) AS n_both, count(*) FILTER (k > 0) AS n_total FROM cmp GROUP BY a, b)
       SELECT a, b, round_even(ln((1 + pos) / (1 + neg)), 6) AS score, n_both, n_total FROM sums JOIN cnt USING (a, b)"""


@query("e10_phylo_pairs", _PHYLO, "presence")
def _(spark, sf):
    p = E.presence_profiles(_presence(spark, sf))
    return A.phylo_pairs(p, nation_branches(spark, sf)).withColumn("score", half_even("score", 6))


@query("e10_close_phylo_pairs", _PHYLO.replace("SELECT a, b, round_even(", "SELECT * FROM (SELECT a, b, round_even(") + ") WHERE score >= 0.80005", "presence")
def _(spark, sf):
    p = E.presence_profiles(_presence(spark, sf))
    return A.phylo_pairs(p, nation_branches(spark, sf), min_score=0.80005).withColumn("score", half_even("score", 6))


def _edges(spark, sf):
    """nation -> region (is_a), part type -> region (part_of), region -> root, and a nation -> nation short cut."""
    n, r, c = table(spark, sf, "nation"), table(spark, sf, "region"), table(spark, sf, "customer")
    is_a = n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit("is_a").alias("relation"))
    root = r.select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("root").alias("parent"), F.lit("part_of").alias("relation"))
    leaf = c.select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.when(F.col("c_acctbal") > 0, "is_a").otherwise("part_of").alias("relation"))
    seg = c.select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.lit("root").alias("parent"), F.lit("part_of").alias("relation"))
    return is_a.union(root).union(leaf).union(seg.filter("child is not null"))


view(
    "edges",
    """SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent, 0.8::DOUBLE AS w FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root', 0.6 FROM region
       UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_acctbal > 0 THEN 0.8 ELSE 0.6 END FROM customer UNION ALL SELECT 'c' || c_custkey, 'root', 0.6 FROM customer""",
)
_SV = """WITH RECURSIVE up(term, ancestor, s) AS (SELECT t, t, 1.0::DOUBLE FROM (SELECT child AS t FROM edges UNION SELECT parent FROM edges)
     UNION ALL SELECT up.term, e.parent, up.s * e.w FROM up JOIN edges e ON e.child = up.ancestor)"""


@query("e11_go_semantic_values", _SV + " SELECT term, ancestor, round_even(max(s), 8) AS s FROM up GROUP BY ALL", "edges")
def _(spark, sf):
    return E.go_semantic_values(_edges(spark, sf)).withColumn("s", half_even("s", 8))


def _nation_sv(spark, sf):
    return E.go_semantic_values(_edges(spark, sf).filter(~F.col("child").startswith("c")))


_NSV = "sv AS (SELECT term, ancestor, max(s) AS s FROM (SELECT t AS term, t AS ancestor, 1.0::DOUBLE AS s FROM (SELECT child AS t FROM e2 UNION SELECT parent FROM e2) UNION ALL SELECT child, parent, w FROM e2 UNION ALL SELECT x.child, y.parent, x.w * y.w FROM e2 x JOIN e2 y ON x.parent = y.child) GROUP BY ALL)"
_TS = f"""WITH e2 AS (SELECT * FROM edges WHERE child NOT LIKE 'c%'), {_NSV}, v AS (SELECT term, sum(s) AS sv FROM sv GROUP BY 1),
   ts AS (SELECT x.term AS term_a, y.term AS term_b, sum(x.s + y.s) / (any_value(vx.sv) + any_value(vy.sv)) AS sim FROM sv x JOIN sv y ON x.ancestor = y.ancestor AND x.term > y.term
          JOIN v vx ON vx.term = x.term JOIN v vy ON vy.term = y.term GROUP BY 1, 2)"""


@query("e12_term_similarity", _TS + " SELECT term_a, term_b, round_even(sim, 6) AS sim FROM ts", "edges")
def _(spark, sf):
    return E.term_similarity(_nation_sv(spark, sf)).withColumn("sim", half_even("sim", 6))


@query(
    "e12_close_terms",
    _SV + """, sv AS (SELECT term, ancestor, max(s) AS s FROM up GROUP BY ALL), v AS (SELECT term, sum(s) AS sv FROM sv GROUP BY 1)
       SELECT * FROM (SELECT x.term AS term_a, y.term AS term_b, round_even(sum(x.s + y.s) / (any_value(vx.sv) + any_value(vy.sv)), 6) AS sim FROM sv x JOIN sv y ON x.ancestor = y.ancestor AND x.term > y.term
         JOIN v vx ON vx.term = x.term JOIN v vy ON vy.term = y.term GROUP BY 1, 2) WHERE sim >= 0.66005""",
    "edges",
)
def _(spark, sf):
    """All terms, leaves included."""
    return E.close_terms(E.go_semantic_values(_edges(spark, sf)), 0.66005).withColumn("sim", half_even("sim", 6))


def _nation_annotation(spark, sf):
    p = _presence(spark, sf)
    return p.select(F.col("protein").alias("protein_id"), F.concat(F.lit("n"), "other_species").alias("term")).distinct()


view("nation_ann", "SELECT p AS g, 'n' || other AS t FROM buyers", "buyers")


_GENES = _TS + """, sym AS (SELECT term_a AS t, term_b AS u, sim FROM ts UNION ALL SELECT term_b, term_a, sim FROM ts UNION ALL SELECT DISTINCT t, t, 1.0::DOUBLE FROM nation_ann),
       best AS (SELECT x.g AS a, y.g AS b, x.t, max(sim) AS m FROM nation_ann x JOIN sym ON sym.t = x.t JOIN nation_ann y ON y.t = sym.u AND y.g <> x.g GROUP BY ALL),
       n AS (SELECT g, count(*) AS n FROM nation_ann GROUP BY 1)
       SELECT greatest(a, b) AS a, least(a, b) AS b, round_even(sum(m) / any_value(nx.n + ny.n), 6) AS score FROM best JOIN n nx ON nx.g = a JOIN n ny ON ny.g = b GROUP BY 1, 2"""


@query("e13_gene_similarity", _GENES, "edges nation_ann")
def _(spark, sf):
    sim = E.term_similarity(_nation_sv(spark, sf))
    return A.gene_similarity(_nation_annotation(spark, sf), sim).withColumn("score", half_even("score", 6))


@query("e13_similar_genes", _GENES.replace("SELECT greatest(a, b)", "SELECT * FROM (SELECT greatest(a, b)") + ") WHERE score >= 0.85005", "edges nation_ann")
def _(spark, sf):
    sim = E.term_similarity(_nation_sv(spark, sf))
    return A.similar_genes(_nation_annotation(spark, sf), sim, 0.85005).withColumn("score", half_even("score", 6))


_MI = """WITH nt AS (SELECT t, count(*) AS n FROM nation_ann GROUP BY 1), tot AS (SELECT count(*) AS total, (SELECT count(*) FROM nt) AS nterms FROM nation_ann),
       w AS (SELECT t, 1 - n / total AS w1, n / total AS w0 FROM nt, tot),
       ids AS (SELECT DISTINCT g FROM nation_ann),
       u AS (SELECT x.g AS a, y.g AS b, w.*, ax.t IS NOT NULL AS ha, ay.t IS NOT NULL AS hb FROM ids x JOIN ids y ON x.g > y.g CROSS JOIN w
             LEFT JOIN nation_ann ax ON ax.g = x.g AND ax.t = w.t LEFT JOIN nation_ann ay ON ay.g = y.g AND ay.t = w.t WHERE ax.t IS NOT NULL OR ay.t IS NOT NULL),
       s AS (SELECT a, b, coalesce(sum(w1 * w1) FILTER (ha AND hb), 0) AS s11, coalesce(sum(w1 * w0) FILTER (ha AND NOT hb), 0) AS s10, coalesce(sum(w1 * w0) FILTER (hb AND NOT ha), 0) AS s01,
             coalesce(sum(w1) FILTER (ha), 0) AS a1, coalesce(sum(w0) FILTER (NOT ha), 0) AS a0, coalesce(sum(w1) FILTER (hb), 0) AS b1, coalesce(sum(w0) FILTER (NOT hb), 0) AS b0 FROM u GROUP BY a, b)
       SELECT a, b, round_even(CASE WHEN s11 > 0 THEN s11 / nterms * log2(s11 * nterms / (a1 * b1)) ELSE 0 END
         + CASE WHEN s10 > 0 THEN s10 / nterms * log2(s10 * nterms / (a1 * b0)) ELSE 0 END
         + CASE WHEN s01 > 0 THEN s01 / nterms * log2(s01 * nterms / (a0 * b1)) ELSE 0 END, 6) AS score FROM s, tot"""


@query("e14_weighted_mi_pairs", _MI, "nation_ann")
def _(spark, sf):
    return A.weighted_mi_pairs(_nation_annotation(spark, sf)).withColumn("score", half_even("score", 6))


@query("e14_informative_pairs", _MI.replace("SELECT a, b, round_even(", "SELECT * FROM (SELECT a, b, round_even(") + ") WHERE score >= 0.22005", "nation_ann")
def _(spark, sf):
    return A.weighted_mi_pairs(_nation_annotation(spark, sf), min_score=0.22005).withColumn("score", half_even("score", 6))


@query(
    "j19_roll_up_terms",
    f"""WITH e2 AS (SELECT * FROM edges WHERE child NOT LIKE 'c%'), {_NSV} SELECT DISTINCT g AS protein_id, ancestor AS term FROM nation_ann JOIN sv ON sv.term = t""",
    "edges nation_ann",
)
def _(spark, sf):
    return E.roll_up_terms(_nation_annotation(spark, sf), _nation_sv(spark, sf))


def _binding(spark, sf):
    """Events as peaks of per-type files on one chromosome per user; six-hour tiles as genes."""
    ev = table(spark, sf, "events")
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    peaks = ev.filter("value > 0").select(
        F.col("event_type").alias("file"), F.col("user_id").alias("chrom"), start.alias("start_p"), (start + F.floor(F.col("value") * 60) + 1).alias("end_p"), "value"
    )
    tile = F.floor(start / 21600)
    genes = ev.select(F.col("user_id").alias("chrom"), tile.alias("t")).distinct()
    genes = genes.select((F.col("chrom") * 1000000 + F.col("t")).alias("protein_id"), "chrom", (F.col("t") * 21600).alias("start_g"), ((F.col("t") + 1) * 21600).alias("end_g"))
    files = ev.groupBy(F.col("event_type").alias("file")).agg(F.max("user_id").alias("tf_id"))
    return peaks, genes, files


view(
    "binding_hits",
    """SELECT event_type AS file, g.id AS b, value AS x FROM (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events WHERE value > 0) p
       JOIN (SELECT DISTINCT user_id AS chrom, floor(floor(epoch(ts)) / 21600)::BIGINT AS t, user_id * 1000000 + floor(floor(epoch(ts)) / 21600)::BIGINT AS id FROM events) g
         ON g.chrom = user_id AND s < (t + 1) * 21600 AND t * 21600 < s + floor(value * 60)::BIGINT + 1""",
)


def _grouped_boxcox(rounds: int = 5) -> str:
    """The per-file lambda search as chained CTEs."""
    parts, prev, step = [], "SELECT DISTINCT file, 0.0::DOUBLE AS c FROM binding_hits", 0.1
    for r in range(rounds):
        lam = f"(c + i * {step!r}::DOUBLE)"
        parts.append(
            f"""g{r} AS (SELECT file, {lam} AS lam, ({lam} - 1) * sum(ln(x)) - count(*) / 2.0::DOUBLE * ln(var_pop(CASE WHEN abs({lam}) < 1e-12 THEN ln(x) ELSE (pow(x, {lam}) - 1) / {lam} END)) AS llf
             FROM binding_hits JOIN ({prev}) USING (file), (SELECT unnest(range(-20, 21)) AS i) GROUP BY file, i, c)"""
        )
        prev = f"SELECT file, lam AS c FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(llf, 7) DESC, lam) rn FROM g{r}) WHERE rn = 1"
        step = step * 2 / 40
    parts.append(f"best AS ({prev.replace('AS c', 'AS lam')})")
    return ", ".join(parts)


@query(
    "e15_binding_pairs",
    f"""WITH {_grouped_boxcox()},
       t AS (SELECT file, b, (pow(x, lam) - 1) / lam AS y FROM binding_hits JOIN best USING (file)),
       m AS (SELECT file, min(y) AS lo, max(y) AS hi FROM t GROUP BY 1),
       f AS (SELECT event_type AS file, max(user_id) AS a FROM events GROUP BY 1),
       s AS (SELECT DISTINCT a, b, file, round_even((y - lo) / (hi - lo), 4) AS score FROM t JOIN m USING (file) JOIN f USING (file)),
       k AS (SELECT * FROM s QUALIFY score = max(score) OVER (PARTITION BY a, b))
       SELECT greatest(a, b) AS a, least(a, b) AS b, CASE WHEN a < b THEN 3 ELSE 2 END AS direction, file, score FROM k WHERE a <> b""",
    "binding_hits",
)
def _(spark, sf):
    return E.binding_pairs(*_binding(spark, sf), bin_size=21600)


@query(
    "e16_fisher_combine",
    """WITH p AS (SELECT l_orderkey AS k, sum(-ln(l_discount * 0.5 + 0.01)) AS h, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT k, round_even(exp(-h) * list_sum([pow(h, i) / gamma(i + 1) FOR i IN range(n)]), 8) AS p FROM p""".replace("l_discount * 0.5 + 0.01", "l_discount * 0.5::DOUBLE + 0.01::DOUBLE"),
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_discount") * 0.5 + 0.01).alias("p"))
    return E.fisher_combine(li, ["k"]).withColumn("p", half_even("p", 8))


@query(
    "e17_homolog_pairs",
    """SELECT DISTINCT greatest(x.protein_id, y.protein_id) AS a, least(x.protein_id, y.protein_id) AS b FROM
         (SELECT DISTINCT s_name AS q, 'Gene' || c_nationkey AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_tax <= 0.001)
       JOIN id_mapping x ON x.mapped_id = q JOIN id_mapping y ON y.mapped_id = s""",
    "id_mapping",
)
def _(spark, sf):
    li, s, o, c = (table(spark, sf, t) for t in ("lineitem", "supplier", "orders", "customer"))
    hits = (
        li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("s_name").alias("query"), F.concat(F.lit("Gene"), "c_nationkey").alias("subject"), F.col("l_tax").alias("evalue"))
    )
    return E.homolog_pairs(hits, X.id_mapping(spark, sf))


@query(
    "e18_host_pathogen_scores",
    f"""WITH rows AS (SELECT * FROM mitab WHERE c_nationkey IN (3, 11) AND (l_returnflag = 'R' OR s_nationkey IN (3, 11)) AND l_linenumber <> 7 AND NOT starts_with(l_orderkey::VARCHAR, '8888')),
       clean AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'complex:' || l_orderkey ELSE 'S' || l_suppkey END AS pa, 'P' || l_partkey AS pb, l_returnflag = 'R' AS cx,
            CASE WHEN l_linestatus = 'O' THEN 'MI:00' || (l_linenumber + 10) ELSE 'MI:0000' END AS method, l_orderkey AS pmid FROM rows),
       cm AS (SELECT DISTINCT pa, pmid, method, pb FROM clean WHERE cx),
       lr AS (SELECT pa, pb, method, pmid FROM clean WHERE NOT cx UNION ALL
              SELECT x.pb, y.pb, x.method || '|' || x.pa, x.pmid FROM cm x JOIN cm y ON x.pa = y.pa AND x.pmid = y.pmid AND x.method = y.method AND x.pb > y.pb),
       map AS (SELECT 'S' || s_suppkey AS name, s_suppkey + 10000000 AS id, '3' AS tax FROM supplier UNION ALL SELECT 'P' || p_partkey, p_partkey, CASE WHEN p_size > 25 THEN '3' ELSE '11' END FROM part),
       li AS (SELECT DISTINCT greatest(x.id, y.id) AS a, least(x.id, y.id) AS b, method, pmid FROM lr JOIN map x ON x.name = pa JOIN map y ON y.name = pb WHERE x.id <> y.id AND NOT (x.tax = '3' AND y.tax = '3')),
       r AS (SELECT a, b, pmid, count(*) AS n FROM li GROUP BY ALL), p AS (SELECT pmid, count(*) AS c FROM r GROUP BY 1),
       d AS (SELECT node, count(*) AS d FROM (SELECT a AS node FROM r UNION ALL SELECT b FROM r) GROUP BY 1),
       src AS (SELECT a, b, sum(n / ln(1 + c)) / sum(n) / ln(any_value(x.d) + any_value(y.d)) AS x FROM r JOIN p USING (pmid) JOIN d x ON x.node = a JOIN d y ON y.node = b GROUP BY a, b),
       {boxcox_sql()}, t AS (SELECT a, b, (pow(x, lam) - 1) / lam AS y FROM src, best)
       SELECT a, b, round_even((y - (SELECT min(y) FROM t)) / ((SELECT max(y) FROM t) - (SELECT min(y) FROM t)), 4) AS score FROM t""",
    "mitab",
)
def _(spark, sf):
    rows = P.host_pathogen_rows(X.mitab(spark, sf), "3", "11")
    # suppliers and parts are the two proteomes; accessions lose their isoform here
    rows = rows.withColumns({"id_a": F.regexp_replace("id_a", "uniprotkb:P", "uniprotkb:S"), "alt_a": F.regexp_replace("alt_a", "uniprotkb:P", "uniprotkb:S"), "id_b": F.regexp_replace("id_b", "-[0-9]+$", "")})
    s = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("mapped_id"), (F.col("s_suppkey") + 10000000).alias("protein_id"), F.lit("3").alias("tax_id"))
    p = table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("mapped_id"), F.col("p_partkey").alias("protein_id"), F.when(F.col("p_size") > 25, "3").otherwise("11").alias("tax_id"))
    return E.host_pathogen_scores(rows, s.unionByName(p), "3").select("a", "b", "score")
