"""Mixing sources to target weights by entropy balancing.

Rates r_i of the documents minimise the relative entropy sum s_i (r_i ln(r_i / b_i) - r_i) to the base rates b_i, over
words (s_i: the document's size), such that each source's words come to its target, with r_i at most `most`. The dual has
one multiplier a source, and its solution tilts the base rates exponentially: r_i = min(most, b_i exp(lambda_source)). Newton
steps on the dual climb until each source's words are within `tolerance` of its target; the sums in each step run over
(source, base rate) cells made from all documents, as a distributed table.

Targets: a source's weight times all words; a target stops at `most` times what its source has, and the excess goes to the
others by weight until none is above. That point is where every uncapped source has the same ratio of target to weight, and is
found over the sources ordered by capacity per weight.

Rates become whole copies. A document takes floor(r) copies. What its stratum (source, size class) still lacks is given
as one more copy to its documents in the order of a hash, until the running sum of their sizes is nearest to it. What the
classes of a source miss together is made up in the smallest class that has room for it, a few times over, so that a
source ends within about one small document of its target.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, ordered last;
repeated rows are taken each on its own account; a source without words has target 0; an empty table gives an empty result.
Other columns are carried along by `mixed` and ignored by `plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm.ordering import cells_for, hash60, running
from linkweave.llm.words import n_words
from linkweave.session import staged


def repeating_weights(sources: DataFrame, source_col: str, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """`sources` (a row per source) with `weight`: the weights in turn, by code point order, null last.

    One task numbers the sources; there is a row for each, however many documents it has."""
    by_code_point = Window.partitionBy(F.lit(0)).orderBy(F.col(source_col).isNull(), F.encode(F.col(source_col), "UTF-8"))
    turn = (F.row_number().over(by_code_point) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))


def capped_targets(sources: DataFrame, most: float) -> DataFrame:
    """`sources` (size, weight) with `target`: shares of all words by weight, none above `most` times its size.

    Sources fill up in the order of capacity / weight. Source j is full if, once all before it are full, its share of
    the rest is above its capacity."""
    everything = Window.partitionBy(F.lit(0))
    rising = everything.orderBy("_level", F.col("weight"), F.col("size")).rowsBetween(Window.unboundedPreceding, -1)
    parts = sources.withColumn("_capacity", F.lit(float(most)) * F.col("size")).withColumn("_level", F.col("_capacity") / F.col("weight"))
    parts = parts.withColumn("_left", F.sum("size").over(everything) - F.coalesce(F.sum("_capacity").over(rising), F.lit(0.0)))
    parts = parts.withColumn("_open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
    parts = parts.withColumn("_full", F.col("_left") * F.col("weight") > F.col("_capacity") * F.col("_open"))
    # the level of the sources that never fill up is that of the first of them
    level = F.min(F.when(~F.col("_full"), F.struct("_level", F.col("weight").alias("w"), "size", (F.col("_left") / F.col("_open")).alias("per")))).over(everything)
    return parts.withColumn("target", F.when(F.col("_full"), F.col("_capacity")).otherwise(level["per"] * F.col("weight"))).drop("_capacity", "_level", "_left", "_open", "_full")


def multipliers(cells: DataFrame, source_col: str, most: float, tolerance: float = 1e-12, most_steps: int = 200) -> DataFrame:
    """(source_col, lambda) by Newton steps on the dual; `cells` has source, base, words and the source's target.

    Words rise with the multiplier, so each step narrows an interval around the solution; a Newton step that would
    leave it, as may happen where rates reach `most`, is replaced by halving it. Where the target is the whole
    capacity every rate is `most`, which any large multiplier gives."""
    full = F.col("target") >= float(most) * F.col("_all") * (1 - 1e-12)
    none = F.col("target") <= 0
    start = F.when(full, 700.0).when(none, -700.0).otherwise(0.0)
    per_source = cells.groupBy(source_col, "target").agg(F.sum("words").alias("_all"))
    state = staged(per_source.select(source_col, "target", start.alias("lambda"), F.lit(-700.0).alias("_low"), F.lit(700.0).alias("_high"), (full | none).alias("_done")))
    for _ in range(most_steps):
        if state.filter("NOT _done").isEmpty():
            return state.select(source_col, "lambda")
        tilted = F.col("base") * F.exp("lambda")
        moments = cells.drop("target").alias("c").join(state.alias("s"), F.col(f"c.{source_col}").eqNullSafe(F.col(f"s.{source_col}")))
        moments = moments.groupBy(F.col(f"s.{source_col}").alias(source_col), "target", "lambda", "_low", "_high", "_done").agg(
            F.sum(F.col("words") * F.least(tilted, F.lit(float(most)))).alias("_mass"), F.sum(F.when(tilted < most, F.col("words") * tilted).otherwise(0.0)).alias("_slope")
        )
        miss = F.col("target") - F.col("_mass")
        moments = moments.withColumn("_low", F.when(miss > 0, F.col("lambda")).otherwise(F.col("_low"))).withColumn("_high", F.when(miss < 0, F.col("lambda")).otherwise(F.col("_high")))
        newton = F.col("lambda") + miss / F.nullif(F.col("_slope"), F.lit(0.0))
        moved = F.when((newton > F.col("_low")) & (newton < F.col("_high")), newton).otherwise((F.col("_low") + F.col("_high")) / 2)
        done = F.col("_done") | (F.abs(miss) <= tolerance * F.col("target")) | (F.col("_high") - F.col("_low") < 1e-15)
        state = staged(moments.select(source_col, "target", F.when(done, F.col("lambda")).otherwise(moved).alias("lambda"), "_low", "_high", done.alias("_done")))
    raise RuntimeError("the dual did not converge")


def strata(docs: DataFrame, most: int, rows: int, rounds: int = 4) -> DataFrame:
    """(source, class, floor, cutoff): documents of a source and size class take `floor` copies, and one more if their
    key is at most `cutoff` (null: none does). `docs` has source, size, key and rate."""
    down = F.least(F.floor(F.col("rate") + 1e-9), F.lit(most)).cast("long")
    rest = F.greatest(F.col("rate") - down, F.lit(0.0))
    rest = F.when((rest > 1e-9) & (down < most), rest).otherwise(F.lit(0.0))
    keys = ["source", "floor", "class"]
    parts = docs.select("source", "key", "size", down.alias("floor"), rest.alias("rest"), size_class(F.col("size")).alias("class"))
    summed = staged(running(parts, keys, F.col("key"), F.col("size"), "upto", cells_for(rows)))
    middle = F.col("upto") - F.col("size") / 2
    wanted = summed.groupBy(*keys).agg(F.sum(F.col("size") * F.col("rest")).alias("wanted"), F.sum(F.when(F.col("rest") > 0, F.col("size")).otherwise(0)).alias("room"))
    goals = staged(wanted.withColumn("goal", F.col("wanted")))
    got = F.sum(F.when((F.col("rest") > 0) & (middle <= F.col("goal")), F.col("size")).otherwise(0))
    of_source = Window.partitionBy("source")
    for _ in range(rounds):
        now = _with_strata(summed, goals, keys).groupBy(*keys, "goal", "room", "wanted").agg(got.alias("got"))
        now = now.withColumn("miss", F.sum(F.col("wanted") - F.col("got")).over(of_source))
        now = now.withColumn("up", F.greatest(F.lit(0.0), F.least(F.col("room").cast("double"), F.col("got") + F.col("miss"))))
        now = now.withColumn("after", F.round(F.abs(F.col("got") + F.col("miss") - F.col("up")), 6))
        chosen = F.min(F.struct("after", "class", "floor")).over(of_source)
        here = (F.col("class") == chosen["class"]) & (F.col("floor") == chosen["floor"])
        goals = staged(now.select(*keys, F.when(here, F.col("up")).otherwise(F.col("goal")).alias("goal"), "room", "wanted"))
    last = F.max(F.when((F.col("rest") > 0) & (middle <= F.col("goal")), F.col("key")))
    return staged(_with_strata(summed, goals.drop("room", "wanted"), keys).groupBy(*keys).agg(last.alias("cutoff")))


def size_class(size: Column) -> Column:
    """Binary digits of a size."""
    return F.length(F.bin(size))


def _with_strata(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their stratum, of which a source has at most 64 for each base rate."""
    named = table.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(named, same).drop(*[f"_{k}" for k in keys])


def _sized(source_col: str, id_col: str, text_col: str, base_col: str | None) -> list[Column]:
    source, text = F.col(source_col).cast("string"), F.col(text_col).cast("string")
    base = F.col(base_col).cast("double") if base_col else F.lit(1.0)
    key = hash60(F.col(id_col), source, F.md5(text))
    return [source.alias("source"), n_words(text).alias("size"), key.alias("key"), base.alias("base")]


def balanced(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", most: int = 3, base_col: str | None = None) -> DataFrame:
    """(_doc, _mix) for each row of `docs`: its columns, and a struct of size, source_size, target, rate and copies.
    `base_col` holds base rates, 1 without it."""
    sized = staged(docs.select(*_sized(source_col, id_col, text_col, base_col)))
    cells = staged(sized.groupBy("source", "base").agg(F.sum("size").alias("words"), F.count("*").alias("docs")))
    sources = cells.groupBy("source").agg(F.sum("words").alias("size"))
    targets = capped_targets(repeating_weights(sources, "source"), float(most)).select(F.col("source").alias("_t"), F.col("size").alias("source_size"), "target")
    targets = staged(targets)
    tilts = multipliers(cells.join(targets, F.col("source").eqNullSafe(F.col("_t"))).drop("_t", "docs", "source_size"), "source", float(most))
    tilts = staged(targets.join(tilts, F.col("_t").eqNullSafe(F.col("source"))).drop("source"))

    def rated(rows: DataFrame) -> DataFrame:
        rate = F.least(F.lit(float(most)), F.col("base") * F.exp("lambda"))
        return rows.join(tilts, F.col("source").eqNullSafe(F.col("_t"))).withColumn("rate", rate).drop("_t", "lambda")

    rows = cells.agg(F.sum("docs")).first()[0] or 0
    table = strata(rated(sized), most, rows)
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_doc")
    down = F.least(F.floor(F.col("rate") + 1e-9), F.lit(most)).cast("long")
    keyed = rated(docs.select(own, *_sized(source_col, id_col, text_col, base_col))).withColumn("floor", down).withColumn("class", size_class(F.col("size")))
    chosen = _with_strata(keyed, table, ["source", "floor", "class"])
    copies = F.col("floor") + F.when(F.col("key") <= F.col("cutoff"), 1).otherwise(0)
    return chosen.select("_doc", F.struct("size", "source_size", "target", "rate", copies.alias("copies")).alias("_mix"))


def mixed(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns."""
    taken = balanced(docs, source_col, id_col, text_col, most).filter("_mix.copies > 0")
    turns = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix.copies")))
    return taken.withColumn("_turn", turns).select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    mix = balanced(docs)
    taken = (F.col("_mix.copies") * F.col("_mix.size")).alias("taken")
    return mix.select("_doc.doc_id", "_mix.size", "_mix.source_size", "_mix.target", taken, "_mix.copies")


def _sql(rounds: int = 4) -> str:
    """The plan in SQL, for base rates of 1: exact rates instead of Newton's, the same order and cutoffs."""
    ctes = [
        r"""sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
          ('0x' || substr(md5(concat_ws('|', coalesce('=' || doc_id::VARCHAR, '-'), coalesce('=' || source, '-'), coalesce('=' || md5(text), '-'))), 1, 15))::BIGINT AS key FROM documents)""",
        "has AS (SELECT source, sum(size)::DOUBLE AS has, 1.0::DOUBLE + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS w FROM sized GROUP BY source)",
        """filling AS (SELECT *, sum(has) OVER () - coalesce(sum(3 * has) OVER p, 0) AS rest_words, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS rest_w
          FROM has WINDOW p AS (ORDER BY 3 * has / w, w, has ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        "level AS (SELECT rest_words / rest_w AS per FROM filling WHERE rest_words * w <= 3 * has * rest_w ORDER BY 3 * has / w, w, has LIMIT 1)",
        "goals AS (SELECT source, has, CASE WHEN rest_words * w > 3 * has * rest_w THEN 3 * has ELSE per * w END AS target FROM filling LEFT JOIN level ON true)",
        """rated AS (SELECT s.*, g.has::BIGINT AS source_size, target, least(floor(rate + 1e-9), 3)::BIGINT AS down, length(bin(size)) AS class,
          CASE WHEN rate - least(floor(rate + 1e-9), 3) > 1e-9 THEN rate - least(floor(rate + 1e-9), 3) ELSE 0 END AS rest
          FROM (SELECT *, CASE WHEN has = 0 THEN 0 ELSE target / has END AS rate FROM goals) g JOIN sized s ON s.source IS NOT DISTINCT FROM g.source)""",
        "summed AS (SELECT *, sum(size) OVER (PARTITION BY source, class ORDER BY key) - size / 2.0::DOUBLE AS middle FROM rated)",
        """s0 AS (SELECT source, class, sum(size * rest)::DOUBLE AS wanted, sum(CASE WHEN rest > 0 THEN size ELSE 0 END)::DOUBLE AS room, sum(size * rest)::DOUBLE AS goal
          FROM summed GROUP BY source, class)""",
    ]
    for i in range(rounds):
        ctes += [
            f"""g{i} AS (SELECT s.source, s.class, any_value(wanted) AS wanted, any_value(room) AS room, any_value(goal) AS goal, sum(CASE WHEN rest > 0 AND middle <= goal THEN size ELSE 0 END)::DOUBLE AS got
              FROM summed d JOIN s{i} s ON d.source IS NOT DISTINCT FROM s.source AND d.class = s.class GROUP BY s.source, s.class)""",
            f"m{i} AS (SELECT *, got + sum(wanted - got) OVER (PARTITION BY source) AS whole FROM g{i})",
            f"""s{i + 1} AS (SELECT source, class, wanted, room, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY round(abs(whole - greatest(0, least(room, whole))), 6), class) = 1
              THEN greatest(0, least(room, whole)) ELSE goal END AS goal FROM m{i})""",
        ]
    ctes.append(
        f"""cut AS (SELECT s.source, s.class, max(CASE WHEN rest > 0 AND middle <= goal THEN key END) AS cutoff
          FROM summed d JOIN s{rounds} s ON d.source IS NOT DISTINCT FROM s.source AND d.class = s.class GROUP BY s.source, s.class)"""
    )
    return (
        "WITH " + ",\n".join(ctes) + """
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM (
  SELECT d.*, down + CASE WHEN key <= cutoff THEN 1 ELSE 0 END AS copies FROM rated d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source AND d.class = c.class)"""
    )


SQL = _sql()
