"""From per-dataset LLRs to the confidence-weighted network.

The tables stay long: one row per (pair, direction, gold standard, dataset). Everything here is keyed by the
pair, so the rows are hash-partitioned by (a, b) once and the windows and aggregates that follow reuse it. Tables that
come straight from `score_to_llr` are made a pair at a time (`pairwise.py`), without sorting the long rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave import vocab
from linkweave.functions.columns import half_even, join_flags
from linkweave.operators import pairwise
from linkweave.operators.pairs import keep_best
from linkweave.session import small_side

ROW = ["a", "b", "direction"]


def integrate_weighted(llr: DataFrame, alpha: float = vocab.REDUNDANCY_ALPHA, correlations: DataFrame | None = None) -> DataFrame:
    """Datasets of one type ordered by falling LLR; the i-th is weighted alpha^(i-1), or with measured
    correlations by the product of alpha * (1 - r) between neighbours in that order. Adds `wllr`."""
    w = W.partitionBy(*ROW, "gs", "type").orderBy(F.col("llr").desc(), "evidence_id")
    if correlations is None:
        weight = F.pow(F.lit(alpha), F.row_number().over(w) - 1)
        return llr.withColumn("wllr", F.col("llr") * weight)
    prev = llr.withColumn("_prev", F.lag("evidence_id").over(w))
    r = small_side(
        correlations.select(F.col("gs").alias("_gs"), F.col("evidence_a").alias("_ea"), F.col("evidence_b").alias("_eb"), "correlation")
    )
    known = prev.join(
        r,
        (F.col("gs") == F.col("_gs"))
        & (F.greatest("evidence_id", "_prev") == F.col("_ea"))
        & (F.least("evidence_id", "_prev") == F.col("_eb")),
        "left",
    ).drop("_gs", "_ea", "_eb")
    step = F.when(F.col("_prev").isNull(), 1.0).otherwise(alpha * (1 - F.coalesce("correlation", F.lit(0.0))))
    running = W.partitionBy(*ROW, "gs", "type").orderBy(F.col("llr").desc(), "evidence_id").rowsBetween(W.unboundedPreceding, 0)
    product = F.exp(F.sum(F.log(F.greatest(step, F.lit(1e-300)))).over(running))
    return known.withColumn("wllr", F.col("llr") * product).drop("_prev", "correlation")


def integrate_sum(llr: DataFrame) -> DataFrame:
    """Datasets count in full (types that only gather independent species)."""
    return llr.withColumn("wllr", F.col("llr"))


def integrate_single(llr: DataFrame) -> DataFrame:
    """Species-local types have one dataset. More than one is refused, because the evidence share and the
    species share would then disagree."""
    w = W.partitionBy(*ROW, "gs", "type")
    n = F.count("*").over(w)
    return llr.withColumn("wllr", F.when(n == 1, F.col("llr")).otherwise(F.raise_error(F.lit("several datasets of a species-local type"))))


def integrate(
    llr: DataFrame,
    weighted: list[str] = vocab.REDUNDANCY_WEIGHTED,
    alpha: float = vocab.REDUNDANCY_ALPHA,
    correlations: DataFrame | None = None,
) -> DataFrame:
    """Weighted types through `integrate_weighted`, all others in full."""
    if correlations is not None:
        return integrate_weighted(llr.filter(F.col("type").isin(weighted)), alpha, correlations).unionByName(
            integrate_sum(llr.filter(~F.col("type").isin(weighted)))
        )
    steps = pairwise.steps_of(llr, "merged")
    if steps is not None:
        steps = replace(steps, stage="integrated", weighted=tuple(weighted), alpha=alpha)
        return pairwise.remember(pairwise.rows_of(steps, "integrated", [*llr.columns, "wllr"]), steps)
    w = W.partitionBy(*ROW, "gs", "type").orderBy(F.col("llr").desc(), "evidence_id")
    power = F.when(F.col("type").isin(weighted), F.row_number().over(w) - 1).otherwise(0)
    return llr.withColumn("wllr", F.col("llr") * F.pow(F.lit(alpha), power))


def merge_types(llr: DataFrame, directed: list[str] = vocab.DIRECTED_EVIDENCE) -> DataFrame:
    """Undirected evidence repeated on every direction a pair has directed evidence for; direction 0 if none."""
    steps = pairwise.steps_of(llr, "llr")
    if steps is not None:
        steps = replace(steps, stage="merged", directed=tuple(directed))
        return pairwise.remember(pairwise.rows_of(steps, "merged", llr.columns), steps)
    is_directed = F.col("type").isin(directed)
    # one window over the pair instead of a self-join: its partitioning serves every later step
    arrows = F.array_sort(F.collect_set(F.when(is_directed, F.col("direction"))).over(W.partitionBy("a", "b")))
    own = F.when(is_directed, F.array("direction")).when(F.size("_arrows") == 0, F.array(F.lit(0))).otherwise(F.col("_arrows"))
    return llr.withColumn("_arrows", arrows).withColumn("direction", F.explode(own)).drop("_arrows")


def _present(names: list[str], prefix: str) -> Column:
    """The columns `prefix<name>` that are not NULL, as a map by name."""
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"{prefix}{n}").alias("v")) for n in sorted(names)])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def compute_fbs(
    integrated: DataFrame, prune: bool = True, types: list[str] = vocab.EVIDENCE_TYPES, species: list[str] = vocab.SPECIES
) -> DataFrame:
    """(a, b, direction, gs, fbs, llr_ev, llr_sp): the score is the sum over evidence types, each rounded to
    3; breakdowns by type and by species. Pairs without any positive score are dropped when `prune`.

    Types and species are fixed lists, so the breakdown is one plain sum per entry. A type or species that
    is not listed has no place in the network table and is refused."""
    steps = pairwise.steps_of(integrated, "integrated")
    if steps is not None:
        steps = replace(steps, stage="fbs", types=tuple(types), species=tuple(species), prune=prune)
        return pairwise.remember(pairwise.rows_of(steps, "fbs", [*ROW, "gs", "fbs", "llr_ev", "llr_sp"]), steps)
    known = F.col("type").isin(types) & F.col("tax_id").isin(species)
    value = F.when(known, F.col("wllr")).otherwise(F.raise_error(F.concat(F.lit("not in the fixed lists: "), "type", F.lit(" / "), "tax_id")))
    cells = integrated.groupBy(*ROW, "gs", "type", "tax_id").agg(F.sum(value.cast("double")).alias("v"))
    sums = cells.groupBy(*ROW, "gs").agg(
        *[half_even(F.sum(F.when(F.col("type") == t, F.col("v"))), 3).alias(f"ev_{t}") for t in types],
        *[half_even(F.sum(F.when(F.col("tax_id") == s, half_even("v", 3))), 3).alias(f"sp_{s}") for s in species],
    )
    total = F.lit(0.0)
    for t in types:
        total = total + F.coalesce(f"ev_{t}", F.lit(0.0))
    fbs = sums.select(*ROW, "gs", half_even(total, 3).alias("fbs"), _present(types, "ev_").alias("llr_ev"), _present(species, "sp_").alias("llr_sp"))
    if not prune:
        return fbs
    best = F.max("fbs").over(W.partitionBy(*ROW))
    return fbs.withColumn("_best", best).filter("_best > 0").drop("_best")


def max_ppv(scored: DataFrame) -> DataFrame:
    """One row per (a, b, direction) with the best confidence and the gold-standard details as an array."""
    steps = pairwise.steps_of(scored, "ppv")
    if steps is not None:
        steps = replace(steps, stage="scored")
        return pairwise.remember(pairwise.rows_of(steps, "scored", [*ROW, "max_ppv", "gs"]), steps)
    detail = F.struct("gs", "ppv", "fbs", "llr_ev", "llr_sp")
    return scored.groupBy(*ROW).agg(F.max("ppv").alias("max_ppv"), F.array_sort(F.collect_list(detail), _by_name).alias("gs"))


def _by_name(x: Column, y: Column) -> Column:
    return F.when(x["gs"] < y["gs"], -1).when(x["gs"] > y["gs"], 1).otherwise(0)


def gs_ppv(n: Column, min_ppv: float = vocab.MIN_PPV) -> Column:
    """Confidence given to a known link by the number of gold standards that hold it."""
    step = (1 - min_ppv) / 3
    return F.when(n <= 1, min_ppv).when(n == 2, round(min_ppv + step, 3)).when(n == 3, round(min_ppv + 2 * step, 3)).otherwise(1.0)


def merge_gs_rows(known: DataFrame, scored: DataFrame, how: str = "left") -> DataFrame:
    """Gold-standard pairs with their network row: (a, b, codes, direction, max_ppv, gs).

    `known` is (gs, a, b, direction code). Codes of one pair and gold standard add up, so both directions
    (2 + 3) become 5; of several scored rows the one with the highest confidence is kept."""
    # one shuffle by the pair serves the three aggregates and the join
    codes = known.select("a", "b", "gs", F.greatest("direction", F.lit(1)).alias("code")).repartition("a", "b").distinct()
    codes = codes.groupBy("a", "b", "gs").agg(F.sum("code").cast("int").alias("code"))
    codes = codes.groupBy("a", "b").agg(F.map_from_entries(F.collect_list(F.struct("gs", "code"))).alias("codes"))
    steps = pairwise.steps_of(scored, "scored")
    if steps is not None:
        best = pairwise.rows_of(steps, "best", scored.columns)
    else:
        best = keep_best(scored, ["a", "b"], [F.col("max_ppv"), -F.col("direction")])
    return codes.join(best, ["a", "b"], how)


def apply_gs_ppv(merged: DataFrame, types: list[str] = vocab.GOLD_STANDARDS, min_ppv: float = vocab.MIN_PPV) -> DataFrame:
    """Raise the confidence of known links to the gold-standard level where the evidence gives less."""
    codes = F.coalesce("codes", F.create_map().cast("map<string,int>"))
    known = gs_ppv(F.size(codes), min_ppv)
    empty_map = F.create_map().cast("map<string,double>")
    details = F.coalesce("gs", F.array().cast(merged.schema["gs"].dataType))

    def detail_of(t: str) -> Column:
        return F.get(F.filter(details, lambda e: e["gs"] == t), F.lit(0))

    entries = []
    for t in types:
        found = detail_of(t)
        code = F.coalesce(F.try_element_at(codes, F.lit(t)), F.lit(0))
        ppv = F.coalesce(found["ppv"], F.lit(0.0))
        raised = (code > 0) & (ppv < known)
        entries.append(
            F.struct(
                F.lit(t).alias("gs"),
                F.when(raised, known).otherwise(ppv).alias("ppv"),
                F.coalesce(found["fbs"], F.lit(0.0)).alias("fbs"),
                code.alias("is_gs"),
                raised.cast("int").alias("is_ppv_gs"),
                F.coalesce(found["llr_ev"], empty_map).alias("llr_ev"),
                F.coalesce(found["llr_sp"], empty_map).alias("llr_sp"),
            )
        )
    out = merged.withColumn("gs", F.array(*entries))
    return out.select(
        "a", "b", F.coalesce("direction", F.lit(0)).alias("direction"),
        F.array_max(F.transform("gs", lambda e: e["ppv"])).alias("max_ppv"), "gs",
    )


def assemble_network(
    scored: DataFrame, known: DataFrame, types: list[str] = vocab.GOLD_STANDARDS, min_ppv: float = vocab.MIN_PPV
) -> DataFrame:
    """The network table: confident pairs without gold-standard pairs, plus all gold-standard pairs at their
    raised confidence, one row per pair. `scored` comes from `max_ppv`, `known` is (gs, a, b, direction)."""
    merged = merge_gs_rows(known, scored, "full_outer")
    kept = merged.filter(F.col("codes").isNotNull() | (F.col("max_ppv") >= min_ppv))
    return apply_gs_ppv(kept, types, min_ppv).filter(F.col("a") != F.col("b"))


def explode_best_gs(net: DataFrame) -> DataFrame:
    """One flat row per link with its best gold standard (by ppv, then fbs), the letters of all gold
    standards tied at the best ppv, and the chosen one's breakdowns."""
    # struct order: highest ppv, then highest fbs, then first gold standard
    ranks = F.transform("gs", lambda e, i: F.struct((-e["ppv"]).alias("p"), (-e["fbs"]).alias("f"), i.alias("i")))
    best = F.get("gs", F.array_min(ranks)["i"])
    letters = F.array_join(
        F.transform(F.filter("gs", lambda e: e["ppv"] == F.col("max_ppv")), lambda e: F.upper(F.substring(e["gs"], 1, 1))), ""
    )
    return net.withColumn("_best", best).select(
        "a", "b", "direction", letters.alias("gold_standard"), F.col("max_ppv").alias("ppv"), F.col("_best.fbs").alias("fbs_max"),
        F.col("_best.is_gs").alias("is_gs"), F.col("_best.is_ppv_gs").alias("is_ppv_gs"),
        F.map_from_entries(F.transform("gs", lambda e: F.struct(e["gs"], e["fbs"]))).alias("fbs"),
        F.col("_best.llr_ev").alias("llr_ev"), F.col("_best.llr_sp").alias("llr_sp"),
    )


def score_host_pathogen(links: DataFrame, models: DataFrame, ppv_model: DataFrame) -> DataFrame:
    """Host-pathogen links (a, b, type, score) under the host's models, nothing retrained: scores are
    scaled to each host model's range, turned into LLR, summed and given the host's confidence.
    `models` is the host's llr_model with the dataset's `type`."""
    from linkweave.functions.columns import clip, polynomial
    from linkweave.operators.normalise import minmax
    from linkweave.operators.training import fbs_to_ppv

    usable = models.filter(F.col("coefficients").isNotNull()).select("type", "gs", "coefficients", "x_min", "x_max")
    scaled = minmax(links.join(small_side(usable), "type"), lo=F.col("x_min"), hi=F.col("x_max"), keys=["type", "gs"])
    llr = half_even(polynomial("coefficients", clip("score", "x_min", "x_max")), 3)
    fbs = scaled.withColumn("llr", llr).groupBy("a", "b", "gs").agg(half_even(F.sum("llr"), 3).alias("fbs"))
    return fbs_to_ppv(fbs, ppv_model)


# --- packed text -----------------------------------------------------------------------------


def _numbers(values: Column) -> Column:
    # an absent share prints as 0, a present one as a decimal number
    return F.array_join(F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("0"))), ",")


def pack_network(
    net: DataFrame, types: list[str] = vocab.GOLD_STANDARDS, evidence: list[str] = vocab.EVIDENCE_TYPES, species: list[str] = vocab.SPECIES
) -> DataFrame:
    """The network with its details as text: `ppv` and `fbs` by gold standard, `llr_evidence` as
    `ev1,..|sp1,..` per gold standard joined by `;`, flags as digits."""
    ev, sp = F.array(*[F.lit(e) for e in evidence]), F.array(*[F.lit(s) for s in species])
    shares = F.transform(
        "gs",
        lambda e: F.concat(
            _numbers(F.transform(ev, lambda k: e["llr_ev"][k])), F.lit("|"), _numbers(F.transform(sp, lambda k: e["llr_sp"][k]))
        ),
    )
    return net.select(
        "a", "b", "max_ppv",
        F.array_join(F.transform("gs", lambda e: e["ppv"].cast("string")), ",").alias("ppv"),
        F.array_join(F.transform("gs", lambda e: e["fbs"].cast("string")), ",").alias("fbs_goldstandard"),
        F.array_join(shares, ";").alias("llr_evidence"),
        F.repeat(F.col("direction").cast("string"), len(types)).alias("grg_direction"),
        join_flags(F.transform("gs", lambda e: e["is_gs"])).alias("is_goldstandard"),
        join_flags(F.transform("gs", lambda e: e["is_ppv_gs"])).alias("is_ppv_goldstandard"),
    )


def unpack_network(
    packed: DataFrame, types: list[str] = vocab.GOLD_STANDARDS, evidence: list[str] = vocab.EVIDENCE_TYPES, species: list[str] = vocab.SPECIES
) -> DataFrame:
    """The inverse of `pack_network`; shares printed as `0` are absent again."""
    names = F.array(*[F.lit(t) for t in types])

    def shares(text: Column, keys: list[str]) -> Column:
        pairs = F.arrays_zip(F.array(*[F.lit(k) for k in keys]).alias("k"), F.split(text, ",").alias("v"))
        kept = F.filter(pairs, lambda p: p["v"] != "0")
        return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], p["v"].cast("double"))))

    def detail(t: Column, i: Column) -> Column:
        parts = F.split(F.get(F.col("_llr"), i), r"\|")
        return F.struct(
            t.alias("gs"),
            F.get(F.col("_ppv"), i).cast("double").alias("ppv"),
            F.get(F.col("_fbs"), i).cast("double").alias("fbs"),
            F.substring(F.col("is_goldstandard"), i + 1, F.lit(1)).cast("int").alias("is_gs"),
            F.substring(F.col("is_ppv_goldstandard"), i + 1, F.lit(1)).cast("int").alias("is_ppv_gs"),
            shares(F.get(parts, F.lit(0)), evidence).alias("llr_ev"),
            shares(F.get(parts, F.lit(1)), species).alias("llr_sp"),
        )

    split = packed.withColumns(
        {"_ppv": F.split("ppv", ","), "_fbs": F.split("fbs_goldstandard", ","), "_llr": F.split("llr_evidence", ";")}
    )
    direction = F.substring("grg_direction", 1, 1).cast("int").alias("direction")
    return split.select("a", "b", direction, "max_ppv", F.transform(names, detail).alias("gs"))
