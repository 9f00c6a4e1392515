"""Registered queries: gold standards, training, integration, network assembly."""

import uuid

from pyspark.sql import functions as F

from linkweave.functions.columns import half_even
from linkweave import vocab
from linkweave.functions import ordered as O
from linkweave.operators import goldstandard as G
from linkweave.operators import integration as I
from linkweave.operators import pairs as J
from linkweave.operators import training as M
from linkweave.plans import fixtures as X
from linkweave.plans import train as plan
from linkweave.plans.registry import query, table, view
from linkweave.session import shared_folder

# --- gold standards --------------------------------------------------------------------------

_SUP_COMPLEX = "SELECT l_orderkey AS grp, s_name AS member FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"


def _complexes(spark, sf, key="complex"):
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias(key), F.col("s_name").alias("member"))


@query(
    "l01_gs_complex",
    f"""WITH m AS (SELECT DISTINCT * FROM ({_SUP_COMPLEX})), k AS (SELECT grp, protein_id AS p FROM m JOIN id_mapping ON mapped_id = member WHERE grp IN (SELECT grp FROM m GROUP BY grp HAVING count(*) < 4)),
       n AS (SELECT n_name AS grp, s_suppkey AS p FROM nation JOIN supplier ON s_nationkey = n_nationkey)
       SELECT DISTINCT x.p AS a, y.p AS b FROM k x JOIN k y ON x.grp = y.grp AND x.p > y.p
       UNION SELECT DISTINCT x.p, y.p FROM n x JOIN n y ON x.grp = y.grp AND x.p > y.p""",
    "id_mapping",
)
def _(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    second = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("complex"), F.col("s_name").alias("member"))
    # order keys and nation names are two sources of complexes; only the first has a size cap
    first = _complexes(spark, sf).withColumn("complex", F.col("complex").cast("string"))
    return G.gs_complex([(first, 4), (second, None)], X.id_mapping(spark, sf))


def _pathway(spark, sf):
    """Orders as pathways: entries are order lines, relations go from returned to accepted lines."""
    li = table(spark, sf, "lineitem")
    entries = li.select(F.col("l_orderkey").alias("pathway_id"), F.concat_ws("-", "l_orderkey", "l_returnflag").alias("entry_id"), F.concat(F.lit("sup:"), "l_suppkey").alias("gene")).distinct()
    one, two = F.concat_ws("-", "l_orderkey", F.lit("R")), F.concat_ws("-", "l_orderkey", F.lit("A"))
    kind = F.when(F.max("l_linestatus") == "O", "ECrel").otherwise("maplink")
    rel = li.groupBy("l_orderkey").agg(kind.alias("type")).select(F.col("l_orderkey").alias("pathway_id"), one.alias("entry1"), two.alias("entry2"), "type")
    return entries, rel


view("pw", "SELECT DISTINCT l_orderkey AS o, l_returnflag AS f, l_suppkey AS s FROM lineitem")
_PW_MAP = "SELECT DISTINCT o, f, protein_id AS p FROM pw JOIN id_mapping ON mapped_id = 'sup:' || s OR mapped_id = s::VARCHAR"


@query(
    "l02_gs_pathway_relations",
    f"""WITH m AS ({_PW_MAP}), k AS (SELECT l_orderkey AS o FROM lineitem GROUP BY 1 HAVING max(l_linestatus) = 'O')
       SELECT DISTINCT greatest(x.p, y.p) AS a, least(x.p, y.p) AS b FROM k JOIN m x ON x.o = k.o AND x.f = 'R' JOIN m y ON y.o = k.o AND y.f = 'A' WHERE x.p <> y.p""",
    "pw id_mapping",
)
def _(spark, sf):
    return G.gs_pathway(*_pathway(spark, sf), X.id_mapping(spark, sf))


@query(
    "l02_gs_pathway_all_pairs",
    f"WITH m AS ({_PW_MAP}) SELECT DISTINCT x.p AS a, y.p AS b FROM m x JOIN m y ON x.o = y.o AND x.p > y.p",
    "pw id_mapping",
)
def _(spark, sf):
    return G.gs_pathway(*_pathway(spark, sf), X.id_mapping(spark, sf), direct=False)


@query(
    "l03_gs_operon",
    f"""WITH k AS (SELECT DISTINCT grp, protein_id AS p FROM ({_SUP_COMPLEX}) JOIN id_mapping ON mapped_id = member)
       SELECT DISTINCT x.p AS a, y.p AS b FROM k x JOIN k y ON x.grp = y.grp AND x.p > y.p""",
    "id_mapping",
)
def _(spark, sf):
    ops = _complexes(spark, sf, "operon").withColumn("member", F.concat(F.lit("CELE_"), "member"))
    return G.gs_operon(ops, X.id_mapping(spark, sf))


@query(
    "l04_gs_ppi",
    """WITH r AS (SELECT l_suppkey + 10000000 AS x, l_partkey AS y, max(l_linenumber) AS n FROM mitab WHERE edge_type = 'X' AND s_nationkey = c_nationkey
          AND l_linestatus = 'O' AND CAST(l_quantity * 3 AS INT) <= 100 GROUP BY ALL)
       SELECT DISTINCT x AS a, y AS b FROM r WHERE n > 1 OR (x, y) IN (SELECT (l_suppkey + 10000000, l_partkey) FROM lineitem WHERE l_tax = 0)""",
    "mitab",
)
def _(spark, sf):
    s, p, li = (table(spark, sf, t) for t in ("supplier", "part", "lineitem"))
    # supplier accessions get their own letter so that the two id ranges stay apart
    rows = X.mitab(spark, sf).withColumns({c: F.regexp_replace(c, "uniprotkb:P", "uniprotkb:S") for c in ("id_a", "alt_a")})
    m = s.select(F.concat(F.lit("S"), "s_suppkey").alias("mapped_id"), (F.col("s_suppkey") + 10000000).alias("protein_id")).unionByName(
        p.select(F.concat(F.lit("P"), "p_partkey").alias("mapped_id"), F.col("p_partkey").alias("protein_id"))
    )
    other = li.filter("l_tax = 0").select((F.col("l_suppkey") + 10000000).alias("a"), F.col("l_partkey").alias("b"))
    return G.gs_ppi(rows, m, other)


@query(
    "l05_gs_regulatory",
    """WITH s AS (SELECT DISTINCT * FROM (SELECT upper(name_a) AS name_a, name_b, 2 AS direction FROM named_links UNION ALL SELECT lower(name_b), name_a, 2 FROM named_links)),
       l AS (SELECT DISTINCT x.protein_id AS x, y.protein_id AS y FROM s JOIN id_mapping x ON lower(x.mapped_id) = lower(name_a) JOIN id_mapping y ON lower(y.mapped_id) = lower(name_b))
       SELECT DISTINCT greatest(x, y) AS a, least(x, y) AS b, CASE WHEN x < y THEN 3 ELSE 2 END AS direction FROM l WHERE x <> y""",
    "named_links id_mapping",
)
def _(spark, sf):
    links = X.named_links(spark, sf)
    one = links.select(F.upper("name_a").alias("name_a"), "name_b", F.lit(2).alias("direction"))
    two = links.select(F.lower("name_b").alias("name_a"), F.col("name_a").alias("name_b"), F.lit(2).alias("direction"))
    return G.gs_regulatory([one, two], X.id_mapping(spark, sf))


@query(
    "l06_gs_from_orthologs",
    """SELECT DISTINCT greatest(x.protein_a, y.protein_a) AS a, least(x.protein_a, y.protein_a) AS b FROM sup_links l
       JOIN ortholog x ON x.protein_b = l.a JOIN ortholog y ON y.protein_b = l.b""",
    "sup_links ortholog",
)
def _(spark, sf):
    return G.gs_from_orthologs(X.sup_links(spark, sf), J.ortholog_view(X.ortholog(spark, sf), "9606", "10090"))


def _ortholog_gs(spark, sf, of=None):
    """Gold standards 'carried over': pairs of equal retail price band, for two types."""
    f = (X.feat(spark, sf) if of is None else of).filter("abs(price_a - price_b) < 20")
    return f.select(F.explode(F.array(F.lit("Complex"), F.lit("PPI"))).alias("gs"), "a", "b")


view("ortholog_gs", "SELECT gs, a, b FROM feat, (SELECT unnest(['Complex', 'PPI']) AS gs) WHERE abs(price_a - price_b) < 20", "feat")
view(
    "pos",
    """SELECT l.evidence_id, g.gs, l.a, l.b, l.score FROM evidence_link l JOIN gs_link g ON l.a = g.a AND l.b = g.b
       WHERE l.direction < 2 OR g.direction < 2 OR l.direction = g.direction""",
    "evidence_link gs_link",
)
view(
    "neg",
    """SELECT evidence_id, gs, a, b, score FROM (SELECT * FROM evidence_link, (SELECT unnest(['Complex', 'Metabolic', 'Operon', 'PPI', 'Regulatory', 'Signaling']) AS gs))
       ANTI JOIN (SELECT gs, a, b FROM gs_link UNION ALL SELECT gs, a, b FROM ortholog_gs) USING (gs, a, b)""",
    "evidence_link gs_link ortholog_gs",
)


def _pos(spark, sf, of=None):
    of = X.feat_stage(spark, sf) if of is None else of
    return G.positives(X.evidence_link(spark, sf, of), X.gs_link(spark, sf, of))


def _neg(spark, sf, of=None):
    of = X.feat_stage(spark, sf) if of is None else of
    return G.negatives_llr(X.evidence_link(spark, sf, of), vocab.GOLD_STANDARDS, X.gs_link(spark, sf, of), _ortholog_gs(spark, sf, of), 1_000_000, 9606)


@query("j12_positives", "SELECT evidence_id, gs, a, b, score FROM pos", "pos")
def _(spark, sf):
    return _pos(spark, sf)


@query("l07_negatives_llr", "SELECT evidence_id, gs, a, b, score FROM neg", "neg")
def _(spark, sf):
    return _neg(spark, sf)


def _pair_scores(spark, sf, of=None):
    """(gs, a, b, fbs) with one score per pair and gold standard."""
    f = X.net(spark, sf, of).select("a", "b", "ppv", "fbs")
    gs = F.explode(F.array(*[F.lit(g) for g in ("Complex", "Metabolic", "PPI", "Signaling")]))
    return f.withColumn("gs", gs).select("gs", "a", "b", half_even(F.col("ppv") * 4 - F.col("fbs") / 10, 3).alias("fbs"))


view("pair_scores", "SELECT gs, a, b, round_even(ppv * 4 - fbs / 10, 3) AS fbs FROM net, (SELECT unnest(['Complex', 'Metabolic', 'PPI', 'Signaling']) AS gs)", "net")


view(
    "marked",
    """SELECT p.*, o.a IS NOT NULL AS own, c.a IS NOT NULL AS carried, k.a IS NOT NULL AS known FROM pair_scores p
       LEFT JOIN (SELECT DISTINCT gs, a, b FROM gs_link) o USING (gs, a, b) LEFT JOIN (SELECT DISTINCT gs, a, b FROM ortholog_gs) c USING (gs, a, b)
       LEFT JOIN (SELECT a, b FROM gs_link UNION SELECT a, b FROM ortholog_gs) k USING (a, b)""",
    "pair_scores gs_link ortholog_gs",
)
_SPLITS = {
    "reference": ("own", "NOT (own OR carried)"),
    "carried_over": ("own", "NOT carried"),
    "all_species": ("own OR carried", "NOT (own OR carried)"),
    "all_gold_standards": ("known", "NOT known"),
    "no_overfit": ("known AND NOT own", "NOT known"),
}


def _register_split(policy):
    pos, neg = _SPLITS[policy]
    sql = f"SELECT gs, a, b, fbs, 'pos' AS cls FROM marked WHERE {pos} UNION ALL SELECT gs, a, b, fbs, 'neg' FROM marked WHERE {neg}"

    @query(f"{'l08' if policy == 'reference' else 'l09'}_split_{policy}", sql, "marked")
    def _(spark, sf):
        of = X.feat_stage(spark, sf)
        pos, neg = G.split_pos_neg(_pair_scores(spark, sf, of), X.gs_link(spark, sf, of), _ortholog_gs(spark, sf, of), policy)
        return pos.withColumn("cls", F.lit("pos")).unionByName(neg.withColumn("cls", F.lit("neg")))


for _policy in _SPLITS:
    _register_split(_policy)


@query("l10_random_negatives")
def _(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("protein_id"))
    return G.random_negatives(part, part.count() * 20, 7, X.gs_link(spark, sf))


@query(
    "l11_gs_matrix",
    """WITH big AS (SELECT gs FROM gs_link GROUP BY gs HAVING count(*) >= 100), g AS (SELECT * FROM gs_link WHERE gs IN (SELECT gs FROM big)),
       p AS (SELECT a, b, max((gs = 'Complex')::INT) AS c, max((gs = 'Metabolic')::INT) AS m, max((gs = 'PPI')::INT) AS p, max((gs = 'Signaling')::INT) AS s FROM g WHERE direction = 1 GROUP BY ALL),
       d AS (SELECT a, b, direction FROM g WHERE direction > 1)
       SELECT coalesce(p.a, d.a) AS a, coalesce(p.b, d.b) AS b, coalesce(c, 0) AS "Complex", coalesce(m, 0) AS "Metabolic", 0 AS "Operon", coalesce(p, 0) AS "PPI",
         coalesce(direction, 0) AS "Regulatory", coalesce(s, 0) AS "Signaling" FROM p FULL JOIN d ON p.a = d.a AND p.b = d.b""",
    "gs_link",
)
def _(spark, sf):
    return G.gs_matrix(X.gs_link(spark, sf), vocab.GOLD_STANDARDS)


# --- training --------------------------------------------------------------------------------

_TRIM = "SELECT evidence_id, a, b, direction, score FROM evidence_link JOIN (SELECT evidence_id, quantile_cont(score, 0.01) lo, quantile_cont(score, 0.99) hi FROM evidence_link GROUP BY 1) USING (evidence_id) WHERE score BETWEEN lo AND hi"


@query("m01_trim_percentiles", _TRIM, "evidence_link")
def _(spark, sf):
    e = X.evidence_link(spark, sf).select("evidence_id", "a", "b", "direction", "score")
    return M.trim_percentiles(e, ["evidence_id"])


view("scored", "SELECT evidence_id, gs, 1 AS cls, score, count(*) AS n FROM pos GROUP BY ALL UNION ALL SELECT evidence_id, gs, 0, score, count(*) FROM neg GROUP BY ALL", "pos neg")
view(
    "support",
    """SELECT s.* FROM scored s JOIN (SELECT evidence_id, gs, greatest(min(score) FILTER (cls = 1), min(score) FILTER (cls = 0)) lo, least(max(score) FILTER (cls = 1), max(score) FILTER (cls = 0)) hi
       FROM scored GROUP BY ALL) USING (evidence_id, gs) WHERE score > lo AND score < hi""",
    "scored",
)
view(
    "kde_par",
    """WITH m AS (SELECT evidence_id, gs, cls, sum(n) AS cn, sum(n * score) / sum(n) AS mean, min(score) AS lo, max(score) AS hi FROM support GROUP BY ALL),
       v AS (SELECT evidence_id, gs, cls, any_value(cn)::DOUBLE AS cn, any_value(lo) lo, any_value(hi) hi, sqrt(sum(n * pow(score - mean, 2)) / (any_value(cn) - 1)) AS sd FROM support JOIN m USING (evidence_id, gs, cls) GROUP BY ALL)
       SELECT evidence_id, gs, p.cn AS n1, q.cn AS n0, greatest(p.lo, q.lo) AS x_min, least(p.hi, q.hi) AS x_max, pow(p.cn * 0.75, -0.2) AS bw_pos, pow(q.cn * 0.75, -0.2) AS bw_neg,
         pow(p.cn * 0.75, -0.2) * p.sd AS h1, pow(q.cn * 0.75, -0.2) * q.sd AS h0
       FROM (SELECT * FROM v WHERE cls = 1) p JOIN (SELECT * FROM v WHERE cls = 0) q USING (evidence_id, gs)""",
    "support",
)


def _counts(spark, sf):
    from linkweave.session import checkpointed

    of = X.feat_stage(spark, sf)
    rows = _pos(spark, sf, of).withColumn("cls", F.lit(1)).unionByName(_neg(spark, sf, of).withColumn("cls", F.lit(0)))
    return checkpointed(rows.groupBy("evidence_id", "gs", "cls", "score").agg(F.count("*").alias("n")))


@query("m03_common_support", "SELECT evidence_id, gs, cls, score, n FROM support", "support")
def _(spark, sf):
    return M.common_support(_counts(spark, sf), M.MODEL)


@query(
    "m04_kde_parameters",
    "SELECT evidence_id, gs, n1::BIGINT AS n1, n0::BIGINT AS n0, x_min, x_max, round_even(bw_pos, 9) AS bw_pos, round_even(bw_neg, 9) AS bw_neg, round_even(h1, 9) AS h1, round_even(h0, 9) AS h0 FROM kde_par",
    "kde_par",
)
def _(spark, sf):
    counts = M.common_support(_counts(spark, sf), M.MODEL)
    p = M.kde_parameters(counts, M.MODEL).filter("n1 is not null and n0 is not null")
    return p.select("evidence_id", "gs", "n1", "n0", "x_min", "x_max", *[half_even(c, 9).alias(c) for c in ("bw_pos", "bw_neg", "h1", "h0")])


view(
    "kde",
    """SELECT evidence_id, gs, i, any_value(x_min + i * ((x_max - x_min) / 999)) AS x,
         sum(CASE WHEN cls = 1 THEN n * exp(pow((x_min + i * ((x_max - x_min) / 999) - score) / h1, 2) * -0.5::DOUBLE) / (n1 * h1 * sqrt(2 * pi())) ELSE 0 END) AS pos,
         sum(CASE WHEN cls = 0 THEN n * exp(pow((x_min + i * ((x_max - x_min) / 999) - score) / h0, 2) * -0.5::DOUBLE) / (n0 * h0 * sqrt(2 * pi())) ELSE 0 END) AS neg
       FROM support JOIN kde_par USING (evidence_id, gs), (SELECT unnest(range(1000))::INT AS i) WHERE h1 > 0 AND h0 > 0 AND x_max > x_min GROUP BY ALL""",
    "support kde_par",
)


def _grid(spark, sf):
    counts = M.common_support(_counts(spark, sf), M.MODEL)
    return M.kde_grid(counts, M.kde_parameters(counts, M.MODEL), M.MODEL)


@query("m04_kde_grid", "SELECT evidence_id, gs, i, round_even(x, 6) AS x, round_even(pos, 6) AS pos, round_even(neg, 6) AS neg FROM kde", "kde")
def _(spark, sf):
    return _grid(spark, sf).select("evidence_id", "gs", "i", *[half_even(c, 6).alias(c) for c in ("x", "pos", "neg")])


@query("m05_log_ratio", "SELECT evidence_id, gs, i, round_even(CASE WHEN pos > 0 AND neg > 0 THEN ln(pos / neg) END, 6) AS llr FROM kde", "kde")
def _(spark, sf):
    return M.log_ratio(_grid(spark, sf)).select("evidence_id", "gs", "i", half_even("llr", 6).alias("llr"))


@query("m02_fit_llr")
def _(spark, sf):
    of = X.feat_stage(spark, sf)
    return M.fit_llr(_pos(spark, sf, of), _neg(spark, sf, of))


@query("m06_fit_poly")
def _(spark, sf):
    return M.fit_poly(M.log_ratio(_grid(spark, sf)), M.MODEL)


def _models(spark, sf, of=None):
    """Models whose coefficients come from each dataset's mean and range (no fitting, so SQL can follow)."""
    e = X.evidence_link(spark, sf, of).groupBy("evidence_id").agg(half_even(F.avg("score"), 2).alias("m"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    gs = F.explode(F.array(*[F.struct(F.lit(g).alias("gs"), F.lit(k / 10).alias("k")) for k, g in enumerate(("Complex", "Metabolic", "PPI"))])).alias("g")
    m = e.select("*", gs).select("*", "g.*").drop("g")
    coefficients = F.array(F.lit(1.5), F.lit(2.0) + F.col("k"), -2.5 * F.col("m"))
    return m.select("evidence_id", "gs", coefficients.alias("coefficients"), (F.col("lo") + 0.02).alias("x_min"), (F.col("hi") - 0.02).alias("x_max"))


view(
    "llr",
    """WITH e AS (SELECT evidence_id, round_even(avg(score), 2) AS m, min(score) + 0.02::DOUBLE AS x_min, max(score) - 0.02::DOUBLE AS x_max FROM evidence_link GROUP BY 1),
       g AS (SELECT * FROM (VALUES ('Complex', 0.0::DOUBLE), ('Metabolic', 0.1::DOUBLE), ('PPI', 0.2::DOUBLE)) t(gs, k))
       SELECT evidence_id, type, tax_id, direction, a, b, gs, round_even((1.5::DOUBLE * x + (2.0::DOUBLE + k)) * x + -2.5::DOUBLE * m, 3) AS llr
       FROM (SELECT l.*, gs, k, m, least(greatest(score, x_min), x_max) AS x FROM evidence_link l JOIN e USING (evidence_id), g)""",
    "evidence_link",
)


def llr_links(spark, sf, of=None):
    of = X.feat_stage(spark, sf) if of is None else of
    return M.score_to_llr(X.evidence_link(spark, sf, of), _models(spark, sf, of))


@query("m07_score_to_llr", "SELECT evidence_id, type, tax_id, direction, a, b, gs, llr FROM llr", "llr")
def _(spark, sf):
    return llr_links(spark, sf).select("evidence_id", "type", "tax_id", "direction", "a", "b", "gs", "llr")


@query(
    "m08_redundancy",
    """WITH p AS (SELECT x.gs, x.evidence_id AS evidence_a, y.evidence_id AS evidence_b, x.llr AS x, y.llr AS y FROM llr x JOIN llr y ON x.gs = y.gs AND x.type = y.type AND x.a = y.a AND x.b = y.b
                  AND x.direction = y.direction AND x.evidence_id > y.evidence_id),
       r AS (SELECT gs, evidence_a, evidence_b, rank() OVER (PARTITION BY gs, evidence_a, evidence_b ORDER BY x) + (count(*) OVER (PARTITION BY gs, evidence_a, evidence_b, x) - 1) / 2 AS rx,
                    rank() OVER (PARTITION BY gs, evidence_a, evidence_b ORDER BY y) + (count(*) OVER (PARTITION BY gs, evidence_a, evidence_b, y) - 1) / 2 AS ry FROM p)
       SELECT gs, evidence_a, evidence_b, round_even(corr(rx, ry), 6) AS correlation FROM r GROUP BY ALL HAVING count(*) >= 100 AND corr(rx, ry) > 0""",
    "llr",
)
def _(spark, sf):
    return M.redundancy(llr_links(spark, sf)).withColumn("correlation", half_even("correlation", 6))


view(
    "merged",
    """SELECT l.evidence_id, l.type, l.tax_id, l.a, l.b, l.gs, l.llr, coalesce(d.direction, 0) AS direction FROM llr l
         LEFT JOIN (SELECT DISTINCT a, b, direction FROM llr WHERE type = 'GRG') d ON d.a = l.a AND d.b = l.b WHERE l.type <> 'GRG'
       UNION ALL SELECT evidence_id, type, tax_id, a, b, gs, llr, direction FROM llr WHERE type = 'GRG'""",
    "llr",
)
view(
    "weighted",
    """SELECT *, llr * CASE WHEN type = 'MEX' THEN pow(0.7::DOUBLE, row_number() OVER (PARTITION BY a, b, direction, gs, type ORDER BY llr DESC, evidence_id) - 1) ELSE 1 END AS wllr FROM merged""",
    "merged",
)


@query("m13_merge_types", "SELECT direction, gs, type, count(*) AS n, round_even(sum(llr), 3) AS total FROM merged GROUP BY ALL", "merged")
def _(spark, sf):
    m = I.merge_types(llr_links(spark, sf))
    return m.groupBy("direction", "gs", "type").agg(F.count("*").alias("n"), half_even(F.sum("llr"), 3).alias("total"))


_W = "SELECT a, b, direction, gs, evidence_id, round_even(wllr, 6) AS wllr FROM weighted"


@query("m09_integrate_weighted", _W + " WHERE type = 'MEX'", "weighted")
def _(spark, sf):
    m = I.merge_types(llr_links(spark, sf)).filter("type = 'MEX'")
    return I.integrate_weighted(m).select("a", "b", "direction", "gs", "evidence_id", half_even("wllr", 6).alias("wllr"))


@query(
    "m09_integrate_correlated",
    """WITH r AS (SELECT 'Complex' AS gs, 3 AS ea, 2 AS eb, count(*) % 7 / 10.0::DOUBLE AS r FROM merged UNION ALL SELECT 'PPI', 4, 2, 0.25 FROM merged LIMIT 2),
       o AS (SELECT *, lag(evidence_id) OVER w AS prev FROM merged WHERE type = 'MEX' WINDOW w AS (PARTITION BY a, b, direction, gs ORDER BY llr DESC, evidence_id)),
       s AS (SELECT o.*, CASE WHEN prev IS NULL THEN 1 ELSE 0.7::DOUBLE * (1 - coalesce(r, 0)) END AS step FROM o LEFT JOIN rr ON rr.gs = o.gs AND ea = greatest(evidence_id, prev) AND eb = least(evidence_id, prev))
       SELECT a, b, direction, gs, evidence_id, round_even(llr * exp(sum(ln(step)) OVER (PARTITION BY a, b, direction, gs ORDER BY llr DESC, evidence_id ROWS UNBOUNDED PRECEDING)), 6) AS wllr FROM s""".replace(
        "r AS (SELECT 'Complex' AS gs, 3 AS ea, 2 AS eb, count(*) % 7 / 10.0::DOUBLE AS r FROM merged UNION ALL SELECT 'PPI', 4, 2, 0.25 FROM merged LIMIT 2),",
        "rr AS (SELECT gs, x.evidence_id AS ea, y.evidence_id AS eb, round_even(least(avg(x.score), avg(y.score)), 2) AS r FROM evidence_link x JOIN evidence_link y ON x.type = y.type AND x.type = 'MEX' AND x.a = y.a AND x.b = y.b AND x.evidence_id > y.evidence_id, (SELECT unnest(['Complex', 'PPI']) AS gs) GROUP BY ALL),",
    ),
    "merged",
)
def _(spark, sf):
    of = X.feat_stage(spark, sf)
    e = X.evidence_link(spark, sf, of).filter("type = 'MEX'").select("a", "b", "evidence_id", "score")
    both = e.withColumnsRenamed({"evidence_id": "evidence_a", "score": "x"}).join(e.withColumnsRenamed({"evidence_id": "evidence_b", "score": "y"}), ["a", "b"])
    r = both.filter("evidence_a > evidence_b").groupBy("evidence_a", "evidence_b").agg(half_even(F.least(F.avg("x"), F.avg("y")), 2).alias("correlation"))
    r = r.withColumn("gs", F.explode(F.array(F.lit("Complex"), F.lit("PPI"))))
    m = I.merge_types(llr_links(spark, sf, of)).filter("type = 'MEX'")
    return I.integrate_weighted(m, correlations=r).select("a", "b", "direction", "gs", "evidence_id", half_even("wllr", 6).alias("wllr"))


@query("m10_integrate_sum", "SELECT a, b, direction, gs, round_even(sum(llr), 3) AS total FROM merged WHERE type IN ('PIN', 'TFB') GROUP BY ALL", "merged")
def _(spark, sf):
    m = I.integrate_sum(I.merge_types(llr_links(spark, sf)).filter("type in ('PIN', 'TFB')"))
    return m.groupBy("a", "b", "direction", "gs").agg(half_even(F.sum("wllr"), 3).alias("total"))


@query("m11_integrate_single", "SELECT a, b, direction, gs, llr AS wllr FROM merged WHERE type = 'DOM'", "merged")
def _(spark, sf):
    m = I.integrate_single(I.merge_types(llr_links(spark, sf)).filter("type = 'DOM'"))
    return m.select("a", "b", "direction", "gs", "wllr")


@query("m12_integrate", _W, "weighted")
def _(spark, sf):
    m = I.integrate(I.merge_types(llr_links(spark, sf)))
    return m.select("a", "b", "direction", "gs", "evidence_id", half_even("wllr", 6).alias("wllr"))


@query("m14_applicable_datasets", "SELECT DISTINCT evidence_id, type, tax_id FROM evidence_link WHERE tax_id = '10116' OR type IN ('GIN','GRG','MEX','MIR','PEX','PIN','TFB')", "evidence_link")
def _(spark, sf):
    return M.applicable_datasets(X.evidence_link(spark, sf), "10116").select("evidence_id", "type", "tax_id").distinct()


view(
    "fbs",
    """WITH e AS (SELECT a, b, direction, gs, type, round_even(sum(wllr), 3) AS ev FROM weighted GROUP BY ALL),
       f AS (SELECT a, b, direction, gs, round_even(sum(ev), 3) AS fbs FROM e GROUP BY ALL)
       SELECT a, b, direction, gs, fbs FROM (SELECT *, max(fbs) OVER (PARTITION BY a, b, direction) AS best FROM f) WHERE best > 0""",
    "weighted",
)


def fbs_table(spark, sf, of=None):
    return I.compute_fbs(I.integrate(I.merge_types(llr_links(spark, sf, of))))


@query("m15_compute_fbs", "SELECT a, b, direction, gs, fbs FROM fbs", "fbs")
def _(spark, sf):
    return fbs_table(spark, sf).select("a", "b", "direction", "gs", "fbs")


@query(
    "g09_llr_breakdown",
    """WITH t AS (SELECT a, b, direction, gs, type, tax_id, sum(wllr) AS v FROM weighted GROUP BY ALL),
       e AS (SELECT gs, type AS part, round_even(sum(v), 3) AS v FROM t JOIN fbs USING (a, b, direction, gs) GROUP BY a, b, direction, gs, type),
       s AS (SELECT gs, tax_id AS part, round_even(sum(round_even(v, 3)), 3) AS v FROM t JOIN fbs USING (a, b, direction, gs) GROUP BY a, b, direction, gs, tax_id)
       SELECT gs, part, count(*) AS n, round_even(sum(v), 3) AS total FROM (SELECT * FROM e UNION ALL SELECT * FROM s) GROUP BY ALL""",
    "weighted fbs",
)
def _(spark, sf):
    f = fbs_table(spark, sf)
    parts = f.select("gs", F.explode("llr_ev").alias("part", "v")).unionByName(f.select("gs", F.explode("llr_sp").alias("part", "v")))
    return parts.groupBy("gs", "part").agg(F.count("*").alias("n"), half_even(F.sum("v"), 3).alias("total"))


@query("m16_fbs_to_pfc", "SELECT a, b, direction, gs, round_even(1 / (1 + exp(-(fbs - -ln(0.001::DOUBLE)))), 3) AS pfc FROM fbs", "fbs")
def _(spark, sf):
    return M.fbs_to_pfc(fbs_table(spark, sf)).select("a", "b", "direction", "gs", "pfc")


view("fbs_counts", "SELECT gs, fbs, count(*) FILTER (own) AS n_pos, count(*) FILTER (NOT (own OR carried)) AS n_neg FROM marked WHERE fbs > 0 AND (own OR NOT carried) GROUP BY ALL", "marked")
view(
    "curve",
    """WITH e AS (SELECT gs, min(fbs) AS lo, max(fbs) AS hi FROM fbs_counts GROUP BY 1),
       s AS (SELECT gs, ceil(round((fbs - lo) / ((hi - lo) / 999), 9))::INT AS slot, sum(n_pos) AS p, sum(n_neg) AS n FROM fbs_counts JOIN e USING (gs) GROUP BY ALL),
       g AS (SELECT gs, i, lo + i * ((hi - lo) / 999) AS threshold FROM e, (SELECT unnest(range(1000))::INT AS i)),
       c AS (SELECT g.gs, i, any_value(threshold) AS threshold, coalesce(sum(p), 0) AS tp, coalesce(sum(n), 0) AS fp FROM g LEFT JOIN s ON s.gs = g.gs AND slot > i GROUP BY g.gs, i)
       SELECT gs, i, threshold, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS ppv FROM c""",
    "fbs_counts",
)


def _fbs_counts(spark, sf):
    of = X.feat_stage(spark, sf)
    pos, neg = G.split_pos_neg(_pair_scores(spark, sf, of), X.gs_link(spark, sf, of), _ortholog_gs(spark, sf, of))
    return M.fbs_counts(pos, neg)


@query("m17_precision_curve", "SELECT gs, i, round_even(threshold, 6) AS threshold, round_even(ppv, 6) AS ppv FROM curve", "curve")
def _(spark, sf):
    c = M.precision_curve(_fbs_counts(spark, sf))
    return c.select("gs", "i", half_even("threshold", 6).alias("threshold"), half_even("ppv", 6).alias("ppv"))


@query(
    "w06_cumulative_counts",
    "SELECT gs, fbs, sum(n_pos) OVER w::BIGINT AS tp, sum(n_neg) OVER w::BIGINT AS fp FROM fbs_counts WINDOW w AS (PARTITION BY gs ORDER BY fbs DESC)".replace("sum(n_pos) OVER w::BIGINT", "(sum(n_pos) OVER w)::BIGINT").replace("sum(n_neg) OVER w::BIGINT", "(sum(n_neg) OVER w)::BIGINT"),
    "fbs_counts",
)
def _(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("gs").orderBy(F.col("fbs").desc()).rowsBetween(W.unboundedPreceding, 0)
    return _fbs_counts(spark, sf).select("gs", "fbs", F.sum("n_pos").over(w).alias("tp"), F.sum("n_neg").over(w).alias("fp"))


@query("m17_bootstrap_precision")
def _(spark, sf):
    return M.bootstrap_precision(_fbs_counts(spark, sf))


@query("m18_fit_logistic")
def _(spark, sf):
    return M.fit_logistic(M.bootstrap_precision(_fbs_counts(spark, sf)), min_r2=0.5)


def _ppv_model(spark, sf, of=None):
    """A confidence curve per gold standard centred on its mean score."""
    m = _pair_scores(spark, sf, of).groupBy("gs").agg(half_even(F.avg("fbs"), 2).alias("c"))
    return m.filter("gs <> 'PPI'").select("gs", F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), "c")


view("ppv_model", "SELECT gs, 1.0::DOUBLE AS pa, 2.0::DOUBLE AS pb, round_even(avg(fbs), 2) AS pc FROM pair_scores WHERE gs <> 'PPI' GROUP BY 1", "pair_scores")
_PPV = "CASE WHEN pa IS NULL THEN 0 ELSE round_even(least(greatest(pa / (1 + exp(-pb * (greatest(fbs, 0) - pc))), {lo}::DOUBLE), 1), 3) END"


@query("m19_fbs_to_ppv", f"SELECT gs, a, b, fbs, {_PPV.format(lo=0.5)} AS ppv FROM pair_scores LEFT JOIN ppv_model USING (gs)", "pair_scores ppv_model")
def _(spark, sf):
    of = X.feat_stage(spark, sf)
    return M.fbs_to_ppv(_pair_scores(spark, sf, of), _ppv_model(spark, sf, of))


view(
    "scored_net",
    f"SELECT a, b, direction, gs, fbs, {_PPV.format(lo=0.5)} AS ppv FROM fbs LEFT JOIN ppv_model USING (gs)",
    "fbs ppv_model",
)


def scored_network(spark, sf, of=None):
    of = X.feat_stage(spark, sf) if of is None else of
    return I.max_ppv(M.fbs_to_ppv(fbs_table(spark, sf, of), _ppv_model(spark, sf, of)))


@query("m20_max_ppv", "SELECT a, b, direction, max(ppv) AS max_ppv FROM scored_net GROUP BY ALL", "scored_net")
def _(spark, sf):
    return scored_network(spark, sf).select("a", "b", "direction", "max_ppv")


@query(
    "g10_row_max",
    "SELECT a, b, direction, max(fbs) AS fbs FROM fbs GROUP BY ALL",
    "fbs",
)
def _(spark, sf):
    return fbs_table(spark, sf).groupBy("a", "b", "direction").agg(F.max("fbs").alias("fbs"))


_CODES = "SELECT a, b, gs, sum(greatest(direction, 1))::INT AS code FROM (SELECT DISTINCT * FROM gs_link) GROUP BY ALL"


@query(
    "g11_merge_gs_rows",
    f"""WITH c AS ({_CODES}), s AS (SELECT a, b, string_agg(gs || '=' || code, ',' ORDER BY gs) AS codes FROM c GROUP BY ALL),
       r AS (SELECT a, b, direction, max(ppv) AS max_ppv FROM scored_net GROUP BY ALL), k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY max_ppv DESC, direction) = 1)
       SELECT s.a, s.b, codes, coalesce(direction, -1) AS direction, max_ppv FROM s LEFT JOIN k ON k.a = s.a AND k.b = s.b""",
    "gs_link scored_net",
)
def _(spark, sf):
    of = X.feat_stage(spark, sf)
    m = I.merge_gs_rows(X.gs_link(spark, sf, of), scored_network(spark, sf, of))
    codes = F.array_sort(F.transform(F.map_entries("codes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return m.select("a", "b", F.array_join(codes, ",").alias("codes"), F.coalesce("direction", F.lit(-1)).alias("direction"), "max_ppv")


view(
    "final_gs",
    f"""WITH c AS ({_CODES}), n AS (SELECT a, b, count(*) AS n FROM c GROUP BY ALL),
       r AS (SELECT a, b, direction, max(ppv) AS max_ppv FROM scored_net GROUP BY ALL),
       k AS (SELECT a, b, direction, max_ppv FROM r QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY max_ppv DESC, direction) = 1),
       u AS (SELECT a, b, direction, max_ppv, (a, b) IN (SELECT (a, b) FROM c) AS known FROM k UNION ALL SELECT a, b, 0, 0, true FROM n WHERE (a, b) NOT IN (SELECT (a, b) FROM k)),
       t AS (SELECT unnest(['Complex', 'Metabolic', 'Operon', 'PPI', 'Regulatory', 'Signaling']) AS gs, unnest(range(6)) AS pos),
       x AS (SELECT u.a, u.b, u.direction, t.gs, t.pos, coalesce(code, 0) AS is_gs, coalesce(s.ppv, 0) AS ppv, coalesce(s.fbs, 0) AS fbs,
               CASE WHEN n.n = 1 THEN 0.85::DOUBLE WHEN n.n = 2 THEN 0.9 WHEN n.n = 3 THEN 0.95 ELSE 1 END AS level
             FROM u, t LEFT JOIN c ON c.a = u.a AND c.b = u.b AND c.gs = t.gs LEFT JOIN scored_net s ON s.a = u.a AND s.b = u.b AND s.direction = u.direction AND s.gs = t.gs
             LEFT JOIN n ON n.a = u.a AND n.b = u.b WHERE u.known OR u.max_ppv >= 0.85)
       SELECT a, b, direction, gs, pos, CASE WHEN is_gs > 0 AND ppv < level THEN level ELSE ppv END AS ppv, fbs, is_gs, (is_gs > 0 AND ppv < level)::INT AS is_ppv_gs FROM x WHERE a <> b""",
    "gs_link scored_net",
)


def network(spark, sf, of=None):
    of = X.feat_stage(spark, sf) if of is None else of
    return I.assemble_network(scored_network(spark, sf, of), X.gs_link(spark, sf, of))


@query("m21_apply_gs_ppv", "SELECT a, b, gs, ppv, is_ppv_gs FROM final_gs WHERE is_gs > 0", "final_gs")
def _(spark, sf):
    of = X.feat_stage(spark, sf)
    n = I.apply_gs_ppv(I.merge_gs_rows(X.gs_link(spark, sf, of), scored_network(spark, sf, of)))
    return n.select("a", "b", F.explode("gs").alias("g")).select("a", "b", "g.gs", "g.ppv", "g.is_ppv_gs", "g.is_gs").filter("is_gs > 0").drop("is_gs")


@query(
    "m22_format_gs_links",
    """SELECT a, b, direction, string_agg(is_gs::VARCHAR, '' ORDER BY pos) AS is_gs, string_agg(is_ppv_gs::VARCHAR, '' ORDER BY pos) AS is_ppv_gs, max(ppv) AS max_ppv
       FROM final_gs GROUP BY ALL HAVING max(is_gs) > 0""".replace("SELECT a, b, direction,", "SELECT a, b, direction,"),
    "final_gs",
)
def _(spark, sf):
    from linkweave.functions.columns import join_flags

    of = X.feat_stage(spark, sf)
    n = I.apply_gs_ppv(I.merge_gs_rows(X.gs_link(spark, sf, of), scored_network(spark, sf, of)))
    return n.select("a", "b", "direction", join_flags(F.transform("gs", lambda e: e["is_gs"])).alias("is_gs"), join_flags(F.transform("gs", lambda e: e["is_ppv_gs"])).alias("is_ppv_gs"), "max_ppv")


@query("m23_assemble_network", "SELECT a, b, direction, gs, ppv, fbs, is_gs, is_ppv_gs FROM final_gs", "final_gs")
def _(spark, sf):
    return network(spark, sf).select("a", "b", "direction", F.explode("gs").alias("g")).select("a", "b", "direction", "g.gs", "g.ppv", "g.fbs", "g.is_gs", "g.is_ppv_gs")


@query(
    "m24_explode_best_gs",
    """WITH m AS (SELECT *, max(ppv) OVER (PARTITION BY a, b) AS top, row_number() OVER (PARTITION BY a, b ORDER BY ppv DESC, fbs DESC, pos) AS rn FROM final_gs)
       SELECT a, b, any_value(top) AS ppv, string_agg(left(gs, 1), '' ORDER BY pos) FILTER (ppv = top) AS gold_standard, max(fbs) FILTER (rn = 1) AS fbs_max, max(is_gs) FILTER (rn = 1) AS is_gs, max(is_ppv_gs) FILTER (rn = 1) AS is_ppv_gs
       FROM m GROUP BY a, b""",
    "final_gs",
)
def _(spark, sf):
    return I.explode_best_gs(network(spark, sf)).select("a", "b", "ppv", "gold_standard", "fbs_max", "is_gs", "is_ppv_gs")


@query(
    "k04_pack_network",
    """SELECT a, b, max(ppv) AS max_ppv, string_agg(ppv::VARCHAR, ',' ORDER BY pos) AS ppv, string_agg(fbs::VARCHAR, ',' ORDER BY pos) AS fbs_goldstandard, repeat(any_value(direction)::VARCHAR, 6) AS grg_direction,
       string_agg(is_gs::VARCHAR, '' ORDER BY pos) AS is_goldstandard, string_agg(is_ppv_gs::VARCHAR, '' ORDER BY pos) AS is_ppv_goldstandard FROM final_gs GROUP BY a, b""",
    "final_gs",
)
def _(spark, sf):
    return I.pack_network(network(spark, sf)).drop("llr_evidence")


@query("k04_unpack_network", "SELECT a, b, direction, gs, ppv, fbs, is_gs, is_ppv_gs FROM final_gs", "final_gs")
def _(spark, sf):
    n = I.unpack_network(I.pack_network(network(spark, sf)))
    return n.select("a", "b", "direction", F.explode("gs").alias("g")).select("a", "b", "direction", "g.gs", "g.ppv", "g.fbs", "g.is_gs", "g.is_ppv_gs")


@query(
    "m25_score_host_pathogen",
    """WITH r AS (SELECT l.a, l.b, m.*, e.score, min(e.score) OVER (PARTITION BY e.type, m.gs) AS lo, max(e.score) OVER (PARTITION BY e.type, m.gs) AS hi FROM evidence_link e JOIN pairs l ON l.a = e.a AND l.b = e.b
              JOIN (SELECT type, gs, k, min(score) + 0.02::DOUBLE AS x_min, max(score) - 0.02::DOUBLE AS x_max, round_even(avg(score), 2) AS m FROM evidence_link, (SELECT * FROM (VALUES ('Complex', 0.0::DOUBLE), ('Metabolic', 0.1::DOUBLE), ('PPI', 0.2::DOUBLE)) t(gs, k)) WHERE type IN ('PIN', 'DOM') GROUP BY ALL) m ON m.type = e.type),
       x AS (SELECT a, b, gs, k, m, least(greatest(round_even((score - lo) / (hi - lo) * (x_max - x_min) + x_min, 4), x_min), x_max) AS x FROM r),
       f AS (SELECT a, b, gs, round_even(sum(round_even((1.5::DOUBLE * x + (2.0::DOUBLE + k)) * x + -2.5::DOUBLE * m, 3)), 3) AS fbs FROM x GROUP BY ALL)
       SELECT a, b, gs, fbs, """ + _PPV.format(lo=0.5) + """ AS ppv FROM f LEFT JOIN ppv_model USING (gs)""",
    "evidence_link pairs ppv_model",
)
def _(spark, sf):
    of = X.feat_stage(spark, sf)
    e = X.evidence_link(spark, sf, of).filter("type in ('PIN', 'DOM')")
    types = e.select("evidence_id", "type").distinct()
    models = _models(spark, sf, of).join(types, "evidence_id")
    return I.score_host_pathogen(e.select("a", "b", "type", "score"), models, _ppv_model(spark, sf, of))


@query(
    "m28_coverage_curve",
    """WITH c AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS cutoff), n AS (SELECT a AS node, ppv FROM net UNION ALL SELECT b, ppv FROM net)
       SELECT cutoff, count(DISTINCT node) AS n_proteins FROM c JOIN n ON ppv <= cutoff GROUP BY 1""",
    "net",
)
def _(spark, sf):
    return M.coverage_curve(X.net(spark, sf), [0.5, 0.6, 0.7, 0.8, 0.9, 1.0], "ppv")


def fixture_config() -> plan.TrainingConfig:
    """The tables are random, so the quality gates are open; every other rule is the default."""
    return plan.TrainingConfig(min_r2=-1e9, min_ppv_r2=-1e9)


def trained(spark, sf):
    of = X.feat_stage(spark, sf)
    return plan.train(X.evidence_link(spark, sf, of), X.gs_link(spark, sf, of), _ortholog_gs(spark, sf, of), "9606", fixture_config())


@query("m27_train_network")
def _(spark, sf):
    return I.explode_best_gs(trained(spark, sf).network).select("a", "b", "direction", "gold_standard", "ppv", "fbs_max", "is_gs", "is_ppv_gs")


@query("m26_train_without_species")
def _(spark, sf):
    of = X.feat_stage(spark, sf)
    t = plan.train_without(X.evidence_link(spark, sf, of), X.gs_link(spark, sf, of), _ortholog_gs(spark, sf, of), "9606", "10090", fixture_config())
    return I.explode_best_gs(t.network).select("a", "b", "direction", "gold_standard", "ppv", "fbs_max", "is_gs", "is_ppv_gs")


@query("m27_train_all_species")
def _(spark, sf):
    """Three species at the default quality gates, from one job; what the store had finished before would be left alone."""
    wanted = spark.createDataFrame([(t,) for t in X.SHIFT], "tax_id string")
    path = f"{shared_folder(spark)}/networks-{uuid.uuid4().hex}"
    net = plan.train_remaining(X.species_evidence(spark, sf), X.species_gs(spark, sf), X.species_orthologs(spark, sf), wanted, path, plan.TrainingConfig())
    flat = [I.explode_best_gs(net.filter(F.col("tax_id") == t).drop("tax_id")).withColumn("tax_id", F.lit(t)) for t in X.SHIFT]
    whole = flat[0].unionByName(flat[1]).unionByName(flat[2])
    return whole.select("tax_id", "a", "b", "direction", "gold_standard", "ppv", "fbs_max", "is_gs", "is_ppv_gs")
