"""The given tables seen as biological inputs, once as DataFrames and once as SQL views for the oracle.

Parts and suppliers play proteins, orders play complexes and papers, nations play species or terms,
events play peaks. Nothing is invented: every row comes from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions.columns import half_even
from linkweave.operators.tiles import member_pairs
from linkweave.plans.registry import table, view
from linkweave.session import staged

S = SparkSession

# --- parts co-occurring in orders ------------------------------------------------------------


def co_member(spark: S, sf: str) -> DataFrame:
    """(grp, member): distinct parts of each order."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("member")).distinct()


view("co_member", "SELECT DISTINCT l_orderkey AS grp, l_partkey AS member FROM lineitem")


def pairs(spark: S, sf: str) -> DataFrame:
    """Pairs of parts that share an order, with the number of shared orders."""
    return member_pairs(co_member(spark, sf), ["grp"], "member").groupBy("a", "b").agg(F.count("*").alias("n"))


view(
    "pairs",
    """SELECT x.member AS a, y.member AS b, count(*) AS n FROM co_member x
       JOIN co_member y ON x.grp = y.grp AND x.member > y.member GROUP BY ALL""",
    "co_member",
)


def feat(spark: S, sf: str) -> DataFrame:
    """Co-ordered pairs with the attributes of both parts."""
    part = table(spark, sf, "part")

    def side(s: str) -> DataFrame:
        return part.select(
            F.col("p_partkey").alias(s),
            F.col("p_size").alias(f"size_{s}"),
            F.col("p_retailprice").alias(f"price_{s}"),
            F.col("p_brand").alias(f"brand_{s}"),
            F.col("p_type").alias(f"type_{s}"),
        )

    return pairs(spark, sf).join(side("a"), "a").join(side("b"), "b")


view(
    "feat",
    """SELECT a, b, n, x.p_size AS size_a, y.p_size AS size_b, x.p_retailprice AS price_a, y.p_retailprice AS price_b,
       x.p_brand AS brand_a, y.p_brand AS brand_b, x.p_type AS type_a, y.p_type AS type_b
       FROM pairs JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b""",
    "pairs",
)


def feat_stage(spark: S, sf: str) -> DataFrame:
    """`feat`, written once: for queries that read it several times."""
    return staged(feat(spark, sf))


def size_gap():
    return F.abs(F.col("size_a") - F.col("size_b"))


def price_gap():
    return F.abs(F.col("price_a") - F.col("price_b"))


def evidence_link(spark: S, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Seven scored datasets over the co-ordered pairs: (evidence_id, type, tax_id, a, b, score, direction). `of` is `feat`, where a query has it already."""
    ratio = F.least("size_a", "size_b") / F.greatest("size_a", "size_b")
    same_type, same_brand = F.col("type_a") == F.col("type_b"), F.col("brand_a") == F.col("brand_b")

    def row(i, etype, tax, cond, score, direction=None):
        direction = F.lit(0) if direction is None else direction
        return F.when(
            cond,
            F.struct(
                F.lit(i).alias("evidence_id"), F.lit(etype).alias("type"), F.lit(tax).alias("tax_id"),
                half_even(score, 4).alias("score"), direction.cast("int").alias("direction"),
            ),
        )

    rows = F.array(
        row(1, "PIN", "9606", F.lit(True), 1 - size_gap() / 50.0),
        row(2, "MEX", "9606", same_type, 1 / (1 + price_gap() / 200)),
        row(3, "MEX", "10090", F.col("size_a") > F.col("size_b"), ratio),
        row(4, "MEX", "10116", F.col("size_a") < F.col("size_b"), size_gap() / 50.0),
        row(5, "DOM", "9606", same_type, ratio),
        row(6, "TFB", "10090", same_brand, 1 / (1 + price_gap() / 200)),
        row(7, "GRG", "9606", size_gap() >= 40, size_gap() / 50.0, F.when(F.col("size_a") > F.col("size_b"), 2).otherwise(3)),
        row(7, "GRG", "9606", (size_gap() >= 40) & (F.col("n") >= 2), 1 - size_gap() / 100.0, F.when(F.col("size_a") > F.col("size_b"), 3).otherwise(2)),
    )
    return (feat(spark, sf) if of is None else of).select("a", "b", F.explode(F.array_compact(rows)).alias("e")).select("e.*", "a", "b")


view(
    "evidence_link",
    """SELECT 1 AS evidence_id, 'PIN' AS type, '9606' AS tax_id, round_even(1 - abs(size_a - size_b) / 50.0::DOUBLE, 4) AS score, 0 AS direction, a, b FROM feat
       UNION ALL SELECT 2, 'MEX', '9606', round_even(1 / (1 + abs(price_a - price_b) / 200), 4), 0, a, b FROM feat WHERE type_a = type_b
       UNION ALL SELECT 3, 'MEX', '10090', round_even(least(size_a, size_b) / greatest(size_a, size_b), 4), 0, a, b FROM feat WHERE size_a > size_b
       UNION ALL SELECT 4, 'MEX', '10116', round_even(abs(size_a - size_b) / 50.0::DOUBLE, 4), 0, a, b FROM feat WHERE size_a < size_b
       UNION ALL SELECT 5, 'DOM', '9606', round_even(least(size_a, size_b) / greatest(size_a, size_b), 4), 0, a, b FROM feat WHERE type_a = type_b
       UNION ALL SELECT 6, 'TFB', '10090', round_even(1 / (1 + abs(price_a - price_b) / 200), 4), 0, a, b FROM feat WHERE brand_a = brand_b
       UNION ALL SELECT 7, 'GRG', '9606', round_even(abs(size_a - size_b) / 50.0::DOUBLE, 4), CASE WHEN size_a > size_b THEN 2 ELSE 3 END, a, b FROM feat WHERE abs(size_a - size_b) >= 40
       UNION ALL SELECT 7, 'GRG', '9606', round_even(1 - abs(size_a - size_b) / 100.0::DOUBLE, 4), CASE WHEN size_a > size_b THEN 3 ELSE 2 END, a, b FROM feat WHERE abs(size_a - size_b) >= 40 AND n >= 2""",
    "feat",
)


def gs_link(spark: S, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Gold-standard pairs: (gs, a, b, direction)."""

    def row(gs, cond, direction=None):
        direction = F.lit(1) if direction is None else direction

        return F.when(cond, F.struct(F.lit(gs).alias("gs"), direction.cast("int").alias("direction")))

    rows = F.array(
        row("Complex", F.col("brand_a") == F.col("brand_b")),
        row("Metabolic", (F.col("type_a") == F.col("type_b")) & (size_gap() <= 5)),
        row("PPI", F.col("n") >= 2),
        row("Regulatory", size_gap() >= 42, F.when(F.col("size_a") > F.col("size_b"), 2).otherwise(3)),
        row("Regulatory", (size_gap() >= 42) & (F.col("n") >= 2), F.when(F.col("size_a") > F.col("size_b"), 3).otherwise(2)),
        row("Signaling", size_gap() <= 1),
    )
    return (feat(spark, sf) if of is None else of).select("a", "b", F.explode(F.array_compact(rows)).alias("g")).select("g.*", "a", "b")


#: Each species has proteins of its own: part keys, shifted.
SHIFT = {"9606": 0, "10090": 10_000_000, "10116": 20_000_000}


def _shift(tax) -> F.Column:
    return F.coalesce(*[F.when(tax == t, F.lit(n)) for t, n in SHIFT.items()])


def species_evidence(spark: S, sf: str) -> DataFrame:
    """`evidence_link` on the proteins of each dataset's species."""
    by = _shift(F.col("tax_id"))
    return evidence_link(spark, sf).withColumns({"a": F.col("a") + by, "b": F.col("b") + by})


def species_gs(spark: S, sf: str) -> DataFrame:
    """Gold standards of three species: (tax_id, gs, a, b, direction). The second and third know two pairs of three."""
    known = gs_link(spark, sf).withColumn("tax_id", F.explode(F.array(*map(F.lit, SHIFT))))
    known = known.filter((F.col("tax_id") == "9606") | (F.pmod(F.col("a") + F.col("b"), F.lit(3)) != F.when(F.col("tax_id") == "10090", 0).otherwise(1)))
    by = _shift(F.col("tax_id"))
    return known.select("tax_id", "gs", (F.col("a") + by).alias("a"), (F.col("b") + by).alias("b"), "direction")


def species_orthologs(spark: S, sf: str) -> DataFrame:
    """(src_tax, src_id, dst_tax, dst_id) between all species; every tenth part has none."""
    ids = table(spark, sf, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("p"))
    pairs = [F.struct(F.lit(s).alias("src_tax"), (F.col("p") + i).alias("src_id"), F.lit(t).alias("dst_tax"), (F.col("p") + j).alias("dst_id")) for s, i in SHIFT.items() for t, j in SHIFT.items() if s != t]
    return ids.select(F.explode(F.array(*pairs)).alias("o")).select("o.*")


view(
    "gs_link",
    """SELECT 'Complex' AS gs, 1 AS direction, a, b FROM feat WHERE brand_a = brand_b
       UNION ALL SELECT 'Metabolic', 1, a, b FROM feat WHERE type_a = type_b AND abs(size_a - size_b) <= 5
       UNION ALL SELECT 'PPI', 1, a, b FROM feat WHERE n >= 2
       UNION ALL SELECT 'Regulatory', CASE WHEN size_a > size_b THEN 2 ELSE 3 END, a, b FROM feat WHERE abs(size_a - size_b) >= 42
       UNION ALL SELECT 'Regulatory', CASE WHEN size_a > size_b THEN 3 ELSE 2 END, a, b FROM feat WHERE abs(size_a - size_b) >= 42 AND n >= 2
       UNION ALL SELECT 'Signaling', 1, a, b FROM feat WHERE abs(size_a - size_b) <= 1""",
    "feat",
)


def net(spark: S, sf: str, of: DataFrame | None = None) -> DataFrame:
    """A weighted network over parts: (a, b, ppv, fbs)."""
    ppv = half_even(0.5 + 0.5 * (1 - size_gap() / 50.0), 3)
    return (feat(spark, sf) if of is None else of).select("a", "b", ppv.alias("ppv"), half_even(price_gap() / 100, 3).alias("fbs"))


view(
    "net",
    """SELECT a, b, round_even(0.5::DOUBLE + 0.5::DOUBLE * (1 - abs(size_a - size_b) / 50.0::DOUBLE), 3) AS ppv,
       round_even(abs(price_a - price_b) / 100, 3) AS fbs FROM feat""",
    "feat",
)


def seeds(spark: S, sf: str) -> DataFrame:
    """Gene queries: every part is a seed of the query named after its brand and type."""
    part = table(spark, sf, "part")
    return part.select(F.concat_ws("/", "p_brand", "p_type").alias("query_id"), F.col("p_partkey").alias("gene"))


view("seeds", "SELECT p_brand || '/' || p_type AS query_id, p_partkey AS gene FROM part")


# --- suppliers: small universe, attribute sets, identifiers ----------------------------------


def sup_sets(spark: S, sf: str) -> DataFrame:
    """(id, attr): distinct parts each supplier delivers."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("attr")).distinct()


view("sup_sets", "SELECT DISTINCT l_suppkey AS id, l_partkey AS attr FROM lineitem")


def id_mapping(spark: S, sf: str) -> DataFrame:
    """Names of suppliers: accession, number, a shared (ambiguous) account name, a prefixed name."""
    s = table(spark, sf, "supplier")
    names = F.array(
        F.struct(F.lit("UniProtID").alias("type"), F.col("s_name").alias("mapped_id")),
        F.struct(F.lit("Gene_ID").alias("type"), F.col("s_suppkey").cast("string").alias("mapped_id")),
        F.struct(F.lit("Gene_Symbol").alias("type"), F.concat(F.lit("Gene"), F.col("s_nationkey")).alias("mapped_id")),
        F.struct(F.lit("KEGG").alias("type"), F.concat(F.lit("sup:"), F.col("s_suppkey")).alias("mapped_id")),
    )
    return s.select(
        F.col("s_suppkey").alias("protein_id"), F.col("s_nationkey").cast("string").alias("tax_id"), F.explode(names).alias("m")
    ).select("protein_id", "tax_id", "m.type", "m.mapped_id")


view(
    "id_mapping",
    """SELECT s_suppkey AS protein_id, s_nationkey::VARCHAR AS tax_id, 'UniProtID' AS type, s_name AS mapped_id FROM supplier
       UNION ALL SELECT s_suppkey, s_nationkey::VARCHAR, 'Gene_ID', s_suppkey::VARCHAR FROM supplier
       UNION ALL SELECT s_suppkey, s_nationkey::VARCHAR, 'Gene_Symbol', 'Gene' || s_nationkey FROM supplier
       UNION ALL SELECT s_suppkey, s_nationkey::VARCHAR, 'KEGG', 'sup:' || s_suppkey FROM supplier""",
)


def named_links(spark: S, sf: str) -> DataFrame:
    """Supplier pairs of one order, given by name: (name_a, name_b)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    named = li.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("grp"), F.col("s_name").alias("member")
    )
    return member_pairs(named, ["grp"], "member", "name_a", "name_b").select("name_a", "name_b").distinct()


view(
    "named_links",
    """SELECT DISTINCT x.s_name AS name_a, y.s_name AS name_b
       FROM (SELECT DISTINCT l_orderkey o, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) x
       JOIN (SELECT DISTINCT l_orderkey o, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) y
       ON x.o = y.o AND x.s_name > y.s_name""",
)


def sup_links(spark: S, sf: str) -> DataFrame:
    """Pairs of suppliers of one nation, scored by account balance: (a, b, score, direction)."""
    s = table(spark, sf, "supplier")
    p = member_pairs(s.select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("member")), ["grp"], "member")
    bal = s.select("s_suppkey", "s_acctbal")
    return (
        p.join(bal.withColumnsRenamed({"s_suppkey": "a", "s_acctbal": "bal_a"}), "a")
        .join(bal.withColumnsRenamed({"s_suppkey": "b", "s_acctbal": "bal_b"}), "b")
        .select(
            "a", "b", half_even(1 - F.abs(F.col("bal_a") - F.col("bal_b")) / 19997, 4).alias("score"),
            F.when(F.col("bal_a") > F.col("bal_b"), 2).otherwise(3).alias("direction"),
        )
    )


view(
    "sup_links",
    """SELECT x.s_suppkey AS a, y.s_suppkey AS b, round_even(1 - abs(x.s_acctbal - y.s_acctbal) / 19997, 4) AS score,
       CASE WHEN x.s_acctbal > y.s_acctbal THEN 2 ELSE 3 END AS direction
       FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey > y.s_suppkey""",
)


def ortholog(spark: S, sf: str) -> DataFrame:
    """Customers are orthologs of the supplier they bought most from (many to one).
    Species 9606 = suppliers, 10090 = customers; the larger tax id is stored as species A."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    bought = (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_suppkey")
        .agg(F.sum("l_quantity").alias("q"))
    )
    top = bought.groupBy("o_custkey").agg(F.max_by("l_suppkey", F.struct("q", -F.col("l_suppkey"))).alias("s"))
    return top.select(
        F.col("o_custkey").alias("protein_a"), F.col("s").alias("protein_b"),
        F.lit("10090").alias("species_a"), F.lit("9606").alias("species_b"),
    )


view(
    "ortholog",
    """SELECT o_custkey AS protein_a, l_suppkey AS protein_b, '10090' AS species_a, '9606' AS species_b FROM (
         SELECT o_custkey, l_suppkey, row_number() OVER (PARTITION BY o_custkey ORDER BY q DESC, l_suppkey) rn FROM (
           SELECT o_custkey, l_suppkey, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)) WHERE rn = 1""",
)


def mitab(spark: S, sf: str) -> DataFrame:
    """Order lines written as interaction rows between the supplier and the part."""
    li, s, o, c = (table(spark, sf, t) for t in ("lineitem", "supplier", "orders", "customer"))
    rows = (
        li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
    )
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    return rows.select(
        F.when(flag == "R", F.concat(F.lit("complex:"), "l_orderkey"))
        .when(flag == "A", F.concat(F.lit("uniprotkb:P"), "l_suppkey"))
        .otherwise(F.concat(F.lit("refseq:NP_"), "l_suppkey"))
        .alias("id_a"),
        F.concat(F.lit("uniprotkb:P"), "l_partkey", F.lit("-"), line).alias("id_b"),
        F.when(flag == "N", F.concat(F.lit("uniprotkb:P"), "l_suppkey", F.lit("|refseq:x"))).otherwise("-").alias("alt_a"),
        F.lit("-").alias("alt_b"),
        F.lit("-").alias("alt2_a"),
        F.lit("-").alias("alt2_b"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit('psi-mi:"MI:00'), line + 10, F.lit('"(two hybrid)')))
        .otherwise("-")
        .alias("method"),
        F.when(line == 7, "-").otherwise(F.concat(F.lit("pubmed:"), line, F.lit("|pubmed:"), "l_orderkey")).alias("pmid"),
        F.when(flag == "R", "-").otherwise(F.concat(F.lit("taxid:"), "s_nationkey", F.lit("(nation)"))).alias("tax_a"),
        F.concat(F.lit("taxid:"), "c_nationkey", F.lit("(nation)")).alias("tax_b"),
        F.when(F.col("l_linestatus") == "O", 'psi-mi:"MI:0915"(physical association)')
        .otherwise('psi-mi:"MI:0254"(genetic interference)')
        .alias("itype"),
        F.concat(F.lit("hpr:1|lpr:"), (F.col("l_quantity") * 3).cast("int"), F.lit("|np:"), line).alias("confidence"),
        F.when(flag == "R", "C").otherwise("X").alias("edge_type"),
    )


view(
    "mitab",
    """SELECT CASE l_returnflag WHEN 'R' THEN 'complex:' || l_orderkey WHEN 'A' THEN 'uniprotkb:P' || l_suppkey
                ELSE 'refseq:NP_' || l_suppkey END AS id_a,
       'uniprotkb:P' || l_partkey || '-' || l_linenumber AS id_b,
       CASE WHEN l_returnflag = 'N' THEN 'uniprotkb:P' || l_suppkey || '|refseq:x' ELSE '-' END AS alt_a,
       '-' AS alt_b, '-' AS alt2_a, '-' AS alt2_b,
       CASE WHEN l_linestatus = 'O' THEN 'psi-mi:"MI:00' || (l_linenumber + 10) || '"(two hybrid)' ELSE '-' END AS method,
       CASE WHEN l_linenumber = 7 THEN '-' ELSE 'pubmed:' || l_linenumber || '|pubmed:' || l_orderkey END AS pmid,
       CASE WHEN l_returnflag = 'R' THEN '-' ELSE 'taxid:' || s_nationkey || '(nation)' END AS tax_a,
       'taxid:' || c_nationkey || '(nation)' AS tax_b,
       CASE WHEN l_linestatus = 'O' THEN 'psi-mi:"MI:0915"(physical association)'
            ELSE 'psi-mi:"MI:0254"(genetic interference)' END AS itype,
       'hpr:1|lpr:' || CAST(l_quantity * 3 AS INT) || '|np:' || l_linenumber AS confidence,
       CASE WHEN l_returnflag = 'R' THEN 'C' ELSE 'X' END AS edge_type, l_orderkey, l_partkey, l_suppkey, l_linenumber,
       l_returnflag, l_linestatus, l_quantity, s_nationkey, c_nationkey
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey""",
)
