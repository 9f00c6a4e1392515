"""Fitting score -> log-likelihood-ratio and sum-of-LLR -> confidence models.

Millions of scored pairs are reduced to counts of distinct scores by Spark; only curves of 1000 points per
model reach numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave import vocab
from linkweave.functions.columns import clip, half_even, logistic, polynomial, ppv_of_fbs
from linkweave.functions.ordered import quantile_bounds, sample_n
from linkweave.operators import pairwise
from linkweave.operators.pairs import mean_links
from linkweave.session import checkpointed, small_side

MODEL = ["evidence_id", "gs"]
GRID = vocab.GRID_POINTS


def trim_percentiles(df: DataFrame, keys: list[str], lo: float = 1, hi: float = 99, score: str = "score") -> DataFrame:
    """Rows between two percentiles of their key, both included (linear interpolation)."""
    bounds = small_side(quantile_bounds(df, keys, score, lo / 100, hi / 100))
    return df.join(bounds, keys).filter(F.col(score).between(F.col("q_lo"), F.col("q_hi"))).drop("q_lo", "q_hi")


def common_support(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts (keys, cls, score, n) strictly inside the score range both classes reach."""
    ends = counts.groupBy(*keys).agg(
        F.greatest(F.min(F.when(F.col("cls") == 1, F.col("score"))), F.min(F.when(F.col("cls") == 0, F.col("score")))).alias("_lo"),
        F.least(F.max(F.when(F.col("cls") == 1, F.col("score"))), F.max(F.when(F.col("cls") == 0, F.col("score")))).alias("_hi"),
    )
    return counts.join(ends, keys).filter((F.col("score") > F.col("_lo")) & (F.col("score") < F.col("_hi"))).drop("_lo", "_hi")


def kde_parameters(counts: DataFrame, keys: list[str], mode: str = "dynamic") -> DataFrame:
    """Per key: grid range, and per class size, Silverman factor and kernel width."""
    n, s = F.col("n"), F.col("score")

    def of(c: int) -> list[Column]:
        is_c = F.col("cls") == c
        total = F.sum(F.when(is_c, n))
        mean = F.sum(F.when(is_c, n * s)) / total
        return [
            total.alias(f"n{c}"),
            mean.alias(f"mean{c}"),
            F.min(F.when(is_c, s)).alias(f"min{c}"),
            F.max(F.when(is_c, s)).alias(f"max{c}"),
        ]

    first = counts.groupBy(*keys).agg(*of(1), *of(0))
    # second pass for the variance: numerically safe, and counts are small
    spread = counts.join(first, keys).groupBy(*keys).agg(
        *[F.sum(F.when(F.col("cls") == c, n * F.pow(s - F.col(f"mean{c}"), 2))).alias(f"ss{c}") for c in (1, 0)]
    )
    p = first.join(spread, keys)
    silverman = {c: F.pow(F.col(f"n{c}") * 0.75, -0.2) for c in (1, 0)}
    factor = {
        "dynamic": silverman,
        "fixed": {1: F.lit(0.1), 0: F.lit(0.1)},
        "max": dict.fromkeys((1, 0), F.greatest(silverman[1], silverman[0])),
        "min": dict.fromkeys((1, 0), F.least(silverman[1], silverman[0])),
    }[mode]
    sd = {c: F.sqrt(F.col(f"ss{c}") / (F.col(f"n{c}") - 1)) for c in (1, 0)}
    return p.select(
        *keys, "n1", "n0",
        F.greatest("min1", "min0").alias("x_min"), F.least("max1", "max0").alias("x_max"),
        factor[1].alias("bw_pos"), factor[0].alias("bw_neg"),
        (factor[1] * sd[1]).alias("h1"), (factor[0] * sd[0]).alias("h0"),
    )


def kde_grid(counts: DataFrame, params: DataFrame, keys: list[str], points: int = GRID) -> DataFrame:
    """Both densities on the grid: (keys, i, x, pos, neg). Each batch of distinct scores becomes one product of kernels
    and counts per key, so a key sends one pair of vectors per batch; Spark adds the vectors up."""
    p = params.select(*keys, "x_min", "x_max", "n1", "n0", "h1", "h0").filter("h1 > 0 and h0 > 0 and x_max > x_min")
    rows = counts.select(*keys, "cls", "score", "n").join(p, keys)
    key_types = [f for f in rows.schema.fields if f.name in keys]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, part in batch.groupby(keys, sort=False):
                at = part.iloc[0]
                x = at["x_min"] + np.arange(points) * ((at["x_max"] - at["x_min"]) / (points - 1))
                sums = []
                for c, size, width in ((1, at["n1"], at["h1"]), (0, at["n0"], at["h0"])):
                    total = np.zeros(points)
                    own = part[part["cls"] == c]
                    for i in range(0, len(own), 512):
                        score, n = own["score"].to_numpy(float)[i : i + 512], own["n"].to_numpy(float)[i : i + 512]
                        total += n @ np.exp(np.square((x[None, :] - score[:, None]) / width) * -0.5)
                    sums.append(total / (size * width * math.sqrt(2 * math.pi)))
                out.append({k: at[k] for k in keys} | {"i": np.arange(points, dtype=np.int32), "x": x, "pos": sums[0], "neg": sums[1]})
            if out:
                yield pd.concat([pd.DataFrame(o) for o in out])[[*keys, "i", "x", "pos", "neg"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted(key_types, key=lambda f: keys.index(f.name)))
    spread = rows.mapInPandas(partial, f"{schema}, i int, x double, pos double, neg double")
    return spread.groupBy(*keys, "i").agg(F.max("x").alias("x"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def log_ratio(grid: DataFrame) -> DataFrame:
    """ln(pos / neg) at each grid point; no value where a density vanishes."""
    ratio = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.log(F.col("pos") / F.col("neg")))
    return grid.withColumn("llr", ratio)


def _r2(y: np.ndarray, fitted: np.ndarray) -> float:
    total = float(((y - y.mean()) ** 2).sum())
    return 1 - float(((y - fitted) ** 2).sum()) / total if total else float("nan")


def fit_poly(grid: DataFrame, keys: list[str], degrees: tuple[int, int] = (2, 4), min_r2: float = vocab.MIN_R2) -> DataFrame:
    """Polynomial of the lowest degree in [degrees) that reaches `min_r2`, per key: 1000 points each."""
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grid.schema if f.name in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x, y = pdf["x"].to_numpy(float), pdf["llr"].to_numpy(float)
        row = {k: pdf[k].iloc[0] for k in keys} | {"coefficients": None, "r2": None, "degree": None}
        if np.isfinite(y).all():
            r2 = 0.0
            for degree in range(*degrees):
                c = np.polyfit(x, y, degree)
                r2 = _r2(y, np.polyval(c, x))
                row |= {"coefficients": [float(v) for v in c], "r2": r2, "degree": degree}
                if r2 >= min_r2:
                    break
            if not r2 >= min_r2:
                row["coefficients"] = None
        return pd.DataFrame([row])

    ordered = ", ".join(sorted(key_types.split(", "), key=lambda t: keys.index(t.split()[0])))
    return grid.groupBy(*keys).applyInPandas(fit, f"{ordered}, coefficients array<double>, r2 double, degree int")


def fit_llr(
    pos: DataFrame,
    neg: DataFrame,
    keys: list[str] = MODEL,
    sample: tuple[int, int] = vocab.SAMPLE_RANGE,
    percentiles: tuple[float, float] = (1, 99),
    mode: str = "dynamic",
    min_r2: float = vocab.MIN_R2,
    degrees: tuple[int, int] = (2, 4),
    seed: int = 9606,
) -> DataFrame:
    """The llr_model rows of all (dataset, gold standard) keys, failed ones with the reason in `error`.
    `pos` and `neg` are (keys, a, b, score)."""
    min_n, max_n = sample
    rows = pos.select(*keys, "a", "b", "score", F.lit(1).alias("cls")).unionByName(
        neg.select(*keys, "a", "b", "score", F.lit(0).alias("cls"))
    )
    by_class = [*keys, "cls"]
    # a stage table: distinct scores with counts, all that the fits below read
    counted = checkpointed(rows.groupBy(*by_class, "score").agg(F.count("*").alias("n")))
    bounds = quantile_bounds(counted, by_class, "score", percentiles[0] / 100, percentiles[1] / 100, F.col("n"))
    inside = F.col("score").between(F.col("q_lo"), F.col("q_hi"))
    trimmed = counted.join(bounds, by_class).withColumn("_in", inside)
    sizes = trimmed.groupBy(*by_class).agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("_in"), F.col("n")).otherwise(0)).alias("n_in"))
    over = sizes.filter(F.col("n_in") > max_n)
    kept = trimmed.filter("_in").select(*by_class, "score", "n")
    if not over.isEmpty():
        # the upper sample size is a training rule: only classes above it are drawn from, row by row
        large = rows.join(over.select(*by_class), by_class, "left_semi").join(bounds, by_class).filter(inside)
        drawn = sample_n(large.select(*rows.columns), max_n, seed, by_class, ["a", "b"])
        drawn_counts = drawn.groupBy(*by_class, "score").agg(F.count("*").alias("n"))
        kept = kept.join(over.select(*by_class), by_class, "left_anti").unionByName(drawn_counts)
    per_key = sizes.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("cls") == 1, F.col("n_in"))), F.lit(0)).alias("n_pos"),
        F.coalesce(F.max(F.when(F.col("cls") == 0, F.col("n_in"))), F.lit(0)).alias("n_neg"),
    )
    enough = per_key.filter((F.col("n_pos") >= min_n) & (F.col("n_neg") >= min_n)).select(*keys)
    counts = common_support(kept.join(enough, keys, "left_semi"), keys)
    params = kde_parameters(counts, keys, mode)
    fitted = fit_poly(log_ratio(kde_grid(counts, params, keys)), keys, degrees, min_r2)
    error = (
        F.when(F.col("n_pos") < min_n, F.lit(f"|PGS|<{min_n}"))
        .when(F.col("n_neg") < min_n, F.lit(f"|NGS|<{min_n}"))
        .when(F.col("coefficients").isNull(), F.lit(f"no polynomial below degree {degrees[1]} reaches R2 {min_r2}"))
    )
    return (
        per_key.join(params.select(*keys, "x_min", "x_max", "bw_pos", "bw_neg"), keys, "left")
        .join(fitted, keys, "left")
        .select(*keys, "coefficients", "x_min", "x_max", "bw_pos", "bw_neg", "r2", "n_pos", "n_neg", error.alias("error"))
    )


def score_to_llr(links: DataFrame, models: DataFrame) -> DataFrame:
    """LLR of every scored link under every usable model of its dataset: score clipped to the model's
    range, polynomial, 3 places. Models are few and meet the links without moving them."""
    usable = small_side(models.filter(F.col("coefficients").isNotNull()).select("evidence_id", "gs", "coefficients", "x_min", "x_max"))
    x = clip("score", "x_min", "x_max")
    llr = links.join(usable, "evidence_id").withColumn("llr", half_even(polynomial("coefficients", x), 3)).drop("coefficients", "x_min", "x_max", "score")
    return pairwise.remember(llr, pairwise.begin(links, usable))


def applicable_datasets(evidence: DataFrame, species: str, transferable: list[str] = vocab.ORTHOLOGY_TRANSFER) -> DataFrame:
    """Datasets used for a species: its own, and those of all species for transferable types."""
    return evidence.filter((F.col("tax_id") == species) | F.col("type").isin(transferable))


def scores_for_species(evidence: DataFrame, orthologs: DataFrame, species: str) -> DataFrame:
    """Scores of all applicable datasets on the species' own proteins. Links of other species are carried
    over their orthologs and averaged. `orthologs` is (src_tax, src_id, dst_tax, dst_id)."""
    from linkweave.functions.columns import canonical_directed, drop_self

    used = applicable_datasets(evidence, species)
    own = used.filter(F.col("tax_id") == species)
    view = orthologs.filter(F.col("dst_tax") == species).select(F.col("src_tax").alias("tax_id"), "src_id", "dst_id")
    left = view.select("tax_id", F.col("src_id").alias("a"), F.col("dst_id").alias("_a"))
    right = view.select("tax_id", F.col("src_id").alias("b"), F.col("dst_id").alias("_b"))
    moved = used.filter(F.col("tax_id") != species).join(left, ["tax_id", "a"]).join(right, ["tax_id", "b"])
    moved = moved.drop("a", "b").withColumnsRenamed({"_a": "a", "_b": "b"})
    moved = drop_self(canonical_directed(moved)).select(*evidence.columns).distinct()
    averaged = mean_links(moved, ["evidence_id", "type", "tax_id", "a", "b", "direction"])
    return own.unionByName(averaged.select(*own.columns))


def scores_for_all(evidence: DataFrame, orthologs: DataFrame, targets: list[str], transferable: list[str] = vocab.ORTHOLOGY_TRANSFER) -> DataFrame:
    """`scores_for_species` of several species in one plan, told apart by `target`: links of a species meet the orthologs of
    all targets once."""
    from linkweave.functions.columns import canonical_directed, drop_self

    own = evidence.filter(F.col("tax_id").isin(targets)).withColumn("target", F.col("tax_id"))
    view = orthologs.filter(F.col("dst_tax").isin(targets) & (F.col("dst_tax") != F.col("src_tax")))
    left = view.select(F.col("src_tax").alias("tax_id"), F.col("src_id").alias("a"), F.col("dst_tax").alias("target"), F.col("dst_id").alias("_a"))
    right = view.select(F.col("src_tax").alias("tax_id"), F.col("src_id").alias("b"), F.col("dst_tax").alias("target"), F.col("dst_id").alias("_b"))
    moved = evidence.filter(F.col("type").isin(transferable)).join(left, ["tax_id", "a"]).join(right, ["tax_id", "target", "b"])
    moved = moved.drop("a", "b").withColumnsRenamed({"_a": "a", "_b": "b"})
    moved = drop_self(canonical_directed(moved)).select(*evidence.columns, "target").distinct()
    averaged = mean_links(moved, ["evidence_id", "type", "tax_id", "a", "b", "direction", "target"])
    return own.unionByName(averaged.select(*own.columns))


# --- redundancy ------------------------------------------------------------------------------


def _common_values(llr: DataFrame) -> DataFrame:
    """(gs, evidence_a, evidence_b, x, y, n): how many common links of two datasets of a type have LLRs x and y.

    Straight from `score_to_llr` the scored links meet, before models multiply them, and only those of types with several
    datasets; models are applied to the counted pairs of scores."""
    link, keys = ["type", "a", "b", "direction"], ["gs", "evidence_a", "evidence_b"]

    def met(rows: DataFrame, on: list[str], value: str) -> DataFrame:
        rows = rows.select(*on, "evidence_id", value)
        left = rows.withColumnsRenamed({"evidence_id": "evidence_a", value: "x"})
        right = rows.withColumnsRenamed({"evidence_id": "evidence_b", value: "y"})
        return left.join(right, on).filter(F.col("evidence_a") > F.col("evidence_b"))

    steps = pairwise.steps_of(llr, "llr")
    if steps is None:
        return met(llr, ["gs", *link], "llr").groupBy(*keys, "x", "y").agg(F.count("*").alias("n"))
    links = steps.links
    several = links.groupBy("type").agg(F.min("evidence_id").alias("_lo"), F.max("evidence_id").alias("_hi")).filter("_lo < _hi")
    used = links.join(small_side(several.select("type")), "type", "left_semi")
    counted = met(used, link, "score").groupBy("evidence_a", "evidence_b", "x", "y").agg(F.count("*").alias("n"))
    models = llr.sparkSession.createDataFrame(
        [(i, gs, list(c), lo, hi) for i, gs, c, lo, hi in steps.models],
        f"_id {dict(links.dtypes)['evidence_id']}, gs string, coefficients array<double>, x_min double, x_max double",
    )
    for side, value in (("evidence_a", "x"), ("evidence_b", "y")):
        own = F.broadcast(models.withColumnRenamed("_id", side))  # at most MOST_MODELS
        scored = counted.join(own, [c for c in ("gs", side) if c in counted.columns])
        counted = scored.withColumn(value, half_even(polynomial("coefficients", clip(value, "x_min", "x_max")), 3)).drop("coefficients", "x_min", "x_max")
    return counted.groupBy(*keys, "x", "y").agg(F.sum("n").alias("n"))


def redundancy(llr: DataFrame, min_n: int = vocab.REDUNDANCY_MIN_SIZE, method: str = "spearman") -> DataFrame:
    """Positive correlation between the LLRs of two datasets of one type on their common pairs.

    Links are reduced to counts of (llr, llr) value pairs per dataset pair; ranks come from the counted
    marginals (LLRs have three places), so a dataset pair with very many links is no larger than others.
    """
    keys = ["gs", "evidence_a", "evidence_b"]
    cells = _common_values(llr)
    if method == "spearman":
        for value, rank in (("x", "rx"), ("y", "ry")):
            marginal = cells.groupBy(*keys, value).agg(F.sum("n").alias("m"))
            upto = F.sum("m").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
            cells = cells.join(marginal.select(*keys, value, (upto - (F.col("m") - 1) / 2.0).alias(rank)), [*keys, value])
    else:
        cells = cells.withColumns({"rx": F.col("x"), "ry": F.col("y")})
    n, x, y = F.col("n"), F.col("rx"), F.col("ry")
    sums = cells.groupBy(*keys).agg(
        F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"),
        F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"), F.sum(n * x * y).alias("sxy"),
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    var = (F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n)
    return sums.filter(n >= min_n).select(*keys, F.when(var > 0, cov / F.sqrt(var)).alias("correlation")).filter("correlation > 0")


# --- confidence ------------------------------------------------------------------------------


def fbs_counts(pos: DataFrame, neg: DataFrame, keys: list[str] = ["gs"]) -> DataFrame:
    """Positive scores of both classes reduced to counts of distinct values (three places)."""
    rows = pos.select(*keys, "fbs", F.lit(1).alias("cls")).unionByName(neg.select(*keys, "fbs", F.lit(0).alias("cls")))
    return (
        rows.filter(F.col("fbs") > 0)
        .groupBy(*keys, "fbs")
        .agg(F.count_if(F.col("cls") == 1).alias("n_pos"), F.count_if(F.col("cls") == 0).alias("n_neg"))
    )


def precision_curve(counts: DataFrame, keys: list[str] = ["gs"], thresholds: int = GRID) -> DataFrame:
    """Precision above evenly spaced thresholds: (keys, i, threshold, ppv); nothing predicted counts as 1.
    A score exceeds ceil((s - min) / step) thresholds, so one bucketed count and a running sum suffice."""
    ends = counts.groupBy(*keys).agg(F.min("fbs").alias("lo"), F.max("fbs").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (thresholds - 1)
    slots = (
        counts.join(ends, keys)
        .withColumn("slot", F.ceil(F.round((F.col("fbs") - F.col("lo")) / step, 9)).cast("int"))
        .groupBy(*keys, "slot")
        .agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    )
    grid = ends.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(thresholds))))
    w = W.partitionBy(*keys).orderBy(F.col("slot").desc()).rowsBetween(W.unboundedPreceding, 0)
    above = grid.join(slots, [*keys, "slot"], "left").select(
        *keys, (F.col("slot") - 1).alias("i"), (F.col("lo") + (F.col("slot") - 1) * step).alias("threshold"),
        F.coalesce(F.sum("n_pos").over(w), F.lit(0)).alias("tp"), F.coalesce(F.sum("n_neg").over(w), F.lit(0)).alias("fp"),
    )
    predicted = F.col("tp") + F.col("fp")
    return above.select(*keys, "i", "threshold", F.when(predicted == 0, 1.0).otherwise(F.col("tp") / predicted).alias("ppv"))


def _draw(rng: np.random.Generator, counts: np.ndarray, size: int) -> np.ndarray:
    """How many of each value a sample without replacement contains."""
    total = int(counts.sum())
    if size >= total:
        return counts
    if 2 * size > total:
        return counts - _draw(rng, counts, total - size)
    # positions without replacement; memory follows the sample, not the population
    picked = np.unique(rng.integers(total, size=size))
    while len(picked) < size:
        more = np.setdiff1d(rng.integers(total, size=2 * (size - len(picked)) + 8), picked)
        picked = np.union1d(picked, rng.permutation(more)[: size - len(picked)])
    return np.bincount(np.searchsorted(np.cumsum(counts), picked, side="right"), minlength=len(counts))


def _precisions(fbs: np.ndarray, n_pos: np.ndarray, n_neg: np.ndarray, thresholds: int) -> tuple[np.ndarray, np.ndarray]:
    seen = (n_pos + n_neg) > 0
    t = np.linspace(fbs[seen].min(), fbs[seen].max(), thresholds)
    order = np.argsort(fbs)
    first = np.searchsorted(fbs[order], t, side="right")
    tp = np.concatenate([np.cumsum(n_pos[order][::-1])[::-1], [0]])[first]
    fp = np.concatenate([np.cumsum(n_neg[order][::-1])[::-1], [0]])[first]
    with np.errstate(divide="ignore", invalid="ignore"):
        return t, np.where(tp + fp > 0, tp / (tp + fp), 1.0)


def bootstrap_precision(counts: DataFrame, keys: list[str] = ["gs"], boots: int = vocab.BOOTSTRAPS, thresholds: int = GRID, seed: int = 1) -> DataFrame:
    """Precision curves against balanced draws of the negatives: (keys, boot, threshold, ppv).
    The draw is made on the counts of distinct scores, so a group is as large as its distinct scores; each draw of
    each key is a group of its own."""
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema if f.name in keys)

    def curve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fbs")
        boot = int(pdf["boot"].iloc[0])
        fbs, n_pos, n_neg = pdf["fbs"].to_numpy(float), pdf["n_pos"].to_numpy(np.int64), pdf["n_neg"].to_numpy(np.int64)
        out = pd.DataFrame({"threshold": [], "ppv": []})
        if n_pos.sum() and n_neg.sum():
            rng = np.random.default_rng([seed, boot])
            t, ppv = _precisions(fbs, n_pos, _draw(rng, n_neg, int(min(n_pos.sum(), n_neg.sum()))), thresholds)
            out = pd.DataFrame({"threshold": t, "ppv": ppv})
        for k in [*keys, "boot"]:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "boot", "threshold", "ppv"]]

    draws = counts.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(boots - 1))))
    return draws.groupBy(*keys, "boot").applyInPandas(curve, f"{key_types}, boot int, threshold double, ppv double")


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Least-squares a / (1 + exp(-b (x - c))) from (1, 1, 1) by damped Gauss-Newton."""
    p, damping = np.ones(3), 1e-3

    def curve(p: np.ndarray) -> np.ndarray:
        return p[0] / (1 + np.exp(np.clip(-p[1] * (x - p[2]), -500, 500)))

    best = float(((y - curve(p)) ** 2).sum())
    for _ in range(rounds):
        s = curve(np.array([1.0, p[1], p[2]]))
        slope = p[0] * s * (1 - s)
        jac = np.column_stack([s, slope * (x - p[2]), -slope * p[1]])
        gram, grad = jac.T @ jac, jac.T @ (y - curve(p))
        step = np.linalg.lstsq(gram + damping * np.diag(np.maximum(np.diag(gram), 1e-12)), grad, rcond=None)[0]
        cost = float(((y - curve(p + step)) ** 2).sum())
        if cost < best:
            small = best - cost < 1e-14 * max(best, 1e-300)
            p, best, damping = p + step, cost, max(damping / 5, 1e-12)
            if small:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    return p, _r2(y, curve(p))


def fit_logistic(curve: DataFrame, keys: list[str] = ["gs"], min_r2: float = vocab.MIN_R2) -> DataFrame:
    """ppv_model rows (keys, a, b, c, r2, error): one small curve per key."""
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in curve.schema if f.name in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in ("boot", "threshold") if c in pdf.columns])
        p, r2 = logistic_fit(pdf["threshold"].to_numpy(float), pdf["ppv"].to_numpy(float))
        row = {k: pdf[k].iloc[0] for k in keys}
        if np.isfinite(r2) and r2 >= min_r2:
            row |= {"a": p[0], "b": p[1], "c": p[2], "r2": r2, "error": None}
        else:
            row |= {"a": None, "b": None, "c": None, "r2": r2, "error": f"no logistic fit reaches R2 {min_r2}"}
        return pd.DataFrame([row])

    return curve.groupBy(*keys).applyInPandas(fit, f"{key_types}, a double, b double, c double, r2 double, error string")


def fbs_to_ppv(fbs: DataFrame, ppv_model: DataFrame, lo: float = 0.5, keys: list[str] = ["gs"]) -> DataFrame:
    """Adds `ppv`; a gold standard without a usable model gives 0."""
    m = small_side(ppv_model.select(*keys, F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("c").alias("_c")))
    steps = pairwise.with_confidence(pairwise.steps_of(fbs, "fbs"), m, lo) if keys == ["gs"] else None
    if steps is not None:
        return pairwise.remember(pairwise.rows_of(steps, "ppv", ["gs", *[c for c in fbs.columns if c != "gs"], "ppv"]), steps)
    scored = fbs.join(m, keys, "left").withColumn("ppv", ppv_of_fbs(F.col("fbs"), F.col("_a"), F.col("_b"), F.col("_c"), lo))
    return scored.drop("_a", "_b", "_c")


def fbs_to_pfc(fbs: DataFrame, prior: float = 0.001) -> DataFrame:
    """Fixed-prior confidence, the alternative to a fitted curve."""
    return fbs.withColumn("pfc", half_even(logistic(F.col("fbs"), F.lit(1.0), F.lit(1.0), F.lit(-math.log(prior))), 3))


def coverage_curve(net: DataFrame, cutoffs: list[float], score: str = "max_ppv") -> DataFrame:
    """Proteins among links up to each cutoff. A protein enters at its lowest link score, so one minimum
    per protein and a histogram replace one distinct count per cutoff."""
    entry = net.select(F.explode(F.array("a", "b")).alias("node"), score).groupBy("node").agg(F.min(score).alias("lowest"))
    marks = F.array(*[F.lit(float(c)) for c in cutoffs])
    reached = entry.select(F.explode(F.filter(marks, lambda c: c >= F.col("lowest"))).alias("cutoff"))
    return reached.groupBy("cutoff").agg(F.count("*").alias("n_proteins"))
