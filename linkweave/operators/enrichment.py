"""Pathway enrichment of gene sets: overlap test and network crosstalk test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from linkweave import vocab
from linkweave.functions.ordered import degree_bins
from linkweave.functions.stats import digamma, hypergeom_tail, log_gamma, p_adjust, row_sums, trigamma
from linkweave.operators.pairs import degree, min_group_size, symmetric
from linkweave.session import checkpointed


def crosstalk(links: DataFrame, pathways: DataFrame, ppv: float = vocab.ENRICHMENT_PPV, min_genes: int = 5) -> DataFrame:
    """Links from each node to each pathway: (node, pathway_id, n). `pathways` is (pathway_id, protein_id);
    pathways with fewer than `min_genes` genes in the network are left out."""
    edges = symmetric(links.filter(F.col("ppv") >= ppv).select("a", "b"))
    kept = network_pathways(links, pathways, ppv, min_genes)
    return edges.join(kept.withColumnRenamed("protein_id", "other"), "other").groupBy("node", "pathway_id").agg(F.count("*").alias("n"))


def network_pathways(links: DataFrame, pathways: DataFrame, ppv: float = vocab.ENRICHMENT_PPV, min_genes: int = 5) -> DataFrame:
    """Pathway genes that are in the confident network, for pathways with enough of them."""
    nodes = links.filter(F.col("ppv") >= ppv).select(F.explode(F.array("a", "b")).alias("protein_id")).distinct()
    present = pathways.select("pathway_id", "protein_id").distinct().join(nodes, "protein_id", "left_semi")
    return min_group_size(present, ["pathway_id"], min_genes)


def network_bins(links: DataFrame, ppv: float = vocab.ENRICHMENT_PPV, size: int = vocab.DEGREE_BIN) -> DataFrame:
    """Degree bins of the confident network: (node, degree, bin)."""
    return degree_bins(degree(links.filter(F.col("ppv") >= ppv)), size)


def set_crosstalk(links: DataFrame, sets: DataFrame, pathways: DataFrame, ppv: float = vocab.ENRICHMENT_PPV) -> DataFrame:
    """Edges between a gene set and a pathway, an edge inside both counted once: (query_id, pathway_id, n)."""
    edges = symmetric(links.filter(F.col("ppv") >= ppv).select("a", "b"))
    met = (
        edges.join(sets.select("query_id", F.col("gene").alias("node")).distinct(), "node")
        .join(pathways.select("pathway_id", F.col("protein_id").alias("other")).distinct(), "other")
        .select("query_id", "pathway_id", F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))
    )
    return met.distinct().groupBy("query_id", "pathway_id").agg(F.count("*").alias("n"))


def matched_samples(query: DataFrame, bins: DataFrame, draws: int, seed: int) -> DataFrame:
    """Random gene sets with the query's number of genes per degree bin: (query_id, draw, gene).
    A bin holds a fixed number of nodes, so a draw orders at most that many."""
    need = query.join(bins.withColumnRenamed("node", "gene"), "gene").groupBy("query_id", "bin").agg(F.count("*").alias("need"))
    each = need.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pool = each.join(bins.select("node", "bin"), "bin")
    ranked = pool.withColumn("_o", F.xxhash64("node", "draw", "query_id", F.lit(seed)))
    rn = F.row_number().over(W.partitionBy("query_id", "draw", "bin").orderBy("_o", "node"))
    return ranked.withColumn("_rn", rn).filter(F.col("_rn") <= F.col("need")).select("query_id", "draw", F.col("node").alias("gene"))


def every_pathway(queries: DataFrame, pathway_sizes: DataFrame) -> DataFrame:
    """One row per query and pathway, which is the family each query is tested in. The pathways are a
    vocabulary: they travel as one list and are unfolded beside every query."""
    names = pathway_sizes.agg(F.collect_list(F.struct("pathway_id", F.col("n").alias("_p")))).scalar()
    listed = queries.withColumn("_all", names)
    return listed.select(*queries.columns, F.explode("_all").alias("_w")).select(*queries.columns, "_w.*")


def mid_p_values(k: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half the probability of k plus that of more, under a beta-binomial; the shorter tail is summed. NaN where the
    parameters fit none."""
    ok = (a > 0) & (b > 0) & (n > 0) & (k >= 0) & (k <= n)
    k, n, a, b = (np.where(ok, v, 1) for v in (k, n, a, b))
    fixed = log_gamma(n + 1) - log_gamma(n + a + b) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)

    def term(j: np.ndarray, r: np.ndarray) -> np.ndarray:
        return fixed[r] - log_gamma(j + 1) - log_gamma(n[r] - j + 1) + log_gamma(j + a[r]) + log_gamma(n[r] - j + b[r])

    every = np.arange(len(k))
    upper = n - k <= k
    total = row_sums(np.where(ok, np.where(upper, n - k, k + 1), 0).astype(np.int64), np.where(upper, k + 1, 0).astype(np.int64), term)
    above = np.where(upper, total, 1.0 - total)
    return np.where(ok, np.clip(0.5 * np.exp(term(k, every)) + above, 0.0, 1.0), np.nan)


def mid_p(k: int, n: int, a: float, b: float) -> float:
    return float(mid_p_values(*(np.array([v], float) for v in (k, n, a, b)))[0])


def moment_fit(n: np.ndarray, mean: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parameters of the beta-binomials with these moments; -1 where none has them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        divisor = n * (square / mean - mean - 1) + mean
        a, b = (n * mean - square) / divisor, (n - mean) * (n - square / mean) / divisor
        fits = (mean > 0) & (divisor != 0) & np.isfinite(a) & np.isfinite(b)
    return np.where(fits, a, -1.0), np.where(fits, b, -1.0)


MOST_LOG = 18.0  # of a parameter: what is drawn varies no more than a binomial


def likelihood_fit(row: np.ndarray, value: np.ndarray, count: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Beta-binomial parameters of highest likelihood for many fits at once, by Newton steps on their logarithms from the
    start (a, b). `value` was drawn `count` times in fit `row`, from 0 to n[row]. A step that gains nothing is halved; where
    the likelihood is not concave the step follows the gradient."""
    sums = lambda x: np.bincount(row, weights=count * x, minlength=len(n))
    v, r = value, n[row]

    def likelihood(u: np.ndarray, w: np.ndarray) -> np.ndarray:
        p, q = np.exp(u)[row], np.exp(w)[row]
        return sums(log_gamma(v + p) - log_gamma(p) + log_gamma(r - v + q) - log_gamma(q) - log_gamma(r + p + q) + log_gamma(p + q))

    u, w = np.minimum(np.log(a), MOST_LOG), np.minimum(np.log(b), MOST_LOG)
    now = likelihood(u, w)
    for _ in range(rounds):
        a, b = np.exp(u), np.exp(w)
        p, q = a[row], b[row]
        both1, both2 = digamma(p + q) - digamma(r + p + q), trigamma(p + q) - trigamma(r + p + q)
        gu, gw = a * sums(digamma(v + p) - digamma(p) + both1), b * sums(digamma(r - v + q) - digamma(q) + both1)
        huu = a * a * sums(trigamma(v + p) - trigamma(p) + both2) + gu
        hww = b * b * sums(trigamma(r - v + q) - trigamma(q) + both2) + gw
        huw = a * b * sums(both2)
        det = huu * hww - huw * huw
        concave = (huu < 0) & (det > 0)
        safe = np.where(concave, det, 1.0)
        scale = np.maximum(np.maximum(np.abs(gu), np.abs(gw)), 1e-300)
        su = np.clip(np.where(concave, (huw * gw - hww * gu) / safe, gu / scale), -2, 2)
        sw = np.clip(np.where(concave, (huw * gu - huu * gw) / safe, gw / scale), -2, 2)
        step, done = np.ones(len(n)), np.zeros(len(n), bool)
        for _ in range(30):
            nu, nw = np.minimum(u + step * su, MOST_LOG), np.minimum(w + step * sw, MOST_LOG)
            then = likelihood(nu, nw)
            done = then >= now
            if done.all():
                break
            step = np.where(done, step, step / 2)
        gain = np.where(done, then - now, 0.0)
        u, w, now = np.where(done, nu, u), np.where(done, nw, w), np.where(done, then, now)
        if (gain <= 1e-10 * (1 + np.abs(now))).all():
            break
    return np.exp(u), np.exp(w)


@F.pandas_udf(StructType([StructField("a", DoubleType()), StructField("b", DoubleType())]))
def _fit(trials: pd.Series, draws: pd.Series, values: pd.Series, counts: pd.Series) -> pd.DataFrame:
    """Of the drawn values that are not zero, with how often each was drawn; the other draws are zero."""
    n, all_draws = trials.to_numpy(float), draws.to_numpy(float)
    sizes = np.array([len(v) for v in values], int)
    row = np.repeat(np.arange(len(n)), sizes)
    value, count = (np.concatenate([np.asarray(x, float) for x in c]) if len(c) else np.zeros(0) for c in (values, counts))
    total = lambda x: np.bincount(row, weights=x, minlength=len(n))
    a, b = moment_fit(n, total(count * value) / all_draws, total(count * value * value) / all_draws)
    # drawn values above the trials, or moments no beta-binomial has: no fit
    good = np.nonzero((a > 0) & (b > 0) & (total(count * (value > n[row])) == 0))[0]
    if len(good):
        place = np.full(len(n), -1)
        place[good] = np.arange(len(good))
        mine = place[row] >= 0
        rows = np.concatenate([place[row[mine]], np.arange(len(good))])
        zeros = (all_draws - total(count))[good]
        a[good], b[good] = likelihood_fit(rows, np.concatenate([value[mine], np.zeros(len(good))]), np.concatenate([count[mine], zeros]), n[good], a[good], b[good])
    return pd.DataFrame({"a": a, "b": b})


@F.pandas_udf(DoubleType())
def _mid_p(k: pd.Series, n: pd.Series, m1: pd.Series, m2: pd.Series) -> pd.Series:
    size = n.to_numpy(float)
    value = mid_p_values(k.to_numpy(float), size, *moment_fit(size, m1.to_numpy(float), m2.to_numpy(float)))
    return pd.Series(np.where(np.isnan(value), 1.0, value))


@F.pandas_udf(DoubleType())
def _mid_p_of_fit(k: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    value = mid_p_values(*(c.to_numpy(float) for c in (k, n, a, b)))
    return pd.Series(np.where(np.isnan(value), 1.0, value))


def _trials() -> Column:
    return F.col("_q") * F.col("_p") - F.least("_q", "_p")


def refined_fits(random: DataFrame, draws: int, query_sizes: DataFrame, pathway_sizes: DataFrame) -> DataFrame:
    """(query_id, pathway_id, a, b): beta-binomials of highest likelihood for the crosstalk of drawn sets (query_id, draw,
    pathway_id, n) without zero rows. A fit holds at most `draws` values. Moments that no beta-binomial has give a = -1."""
    often = random.groupBy("query_id", "pathway_id", "n").agg(F.count("*").alias("c"))
    lists = often.groupBy("query_id", "pathway_id").agg(F.collect_list(F.struct("n", "c")).alias("_l"))
    sized = lists.join(query_sizes.select("query_id", F.col("n").alias("_q")), "query_id").join(pathway_sizes.select("pathway_id", F.col("n").alias("_p")), "pathway_id")
    fit = _fit(_trials().cast("double"), F.lit(float(draws)), F.col("_l.n").cast("array<double>"), F.col("_l.c").cast("array<double>"))
    return sized.select("query_id", "pathway_id", fit.alias("_f")).select("query_id", "pathway_id", "_f.a", "_f.b")


def drawn_moments(random: DataFrame, draws: int) -> DataFrame:
    """(query_id, pathway_id, m1, m2) of the crosstalk of drawn sets (query_id, draw, pathway_id, n) without zero rows."""
    return random.groupBy("query_id", "pathway_id").agg((F.sum("n") / F.lit(draws)).alias("m1"), (F.sum(F.col("n") * F.col("n")) / F.lit(draws)).alias("m2"))


def exact_moments(query: DataFrame, bins: DataFrame, talk: DataFrame) -> DataFrame:
    """The moments that infinitely many degree-matched draws would have: a bin gives as many of its nodes as the query has
    there, without replacement, so mean and variance follow from each bin's sums and sums of squares."""
    nodes = bins.select("node", "bin")
    need = query.join(nodes.withColumnRenamed("node", "gene"), "gene").groupBy("query_id", "bin").agg(F.count("*").alias("need"))
    size = nodes.groupBy("bin").agg(F.count("*").alias("size"))
    sums = talk.join(nodes, "node").groupBy("bin", "pathway_id").agg(F.sum("n").alias("s1"), F.sum(F.col("n") * F.col("n")).alias("s2"))
    each = need.join(size, "bin").join(sums, "bin")
    mean = F.col("s1") / F.col("size")
    spread = F.when(F.col("size") > 1, F.col("need") * (F.col("size") - F.col("need")) / (F.col("size") - 1) * (F.col("s2") / F.col("size") - mean * mean)).otherwise(0.0)
    total = each.groupBy("query_id", "pathway_id").agg(F.sum(F.col("need") * mean).alias("m1"), F.sum(spread).alias("_v"))
    return total.select("query_id", "pathway_id", "m1", (F.col("_v") + F.col("m1") * F.col("m1")).alias("m2"))


def crosstalk_test(observed: DataFrame, moments: DataFrame, query_sizes: DataFrame, pathway_sizes: DataFrame, fits: DataFrame | None = None) -> DataFrame:
    """Network crosstalk against degree-matched sets: (query_id, pathway_id, n, expected, p, fdr, fwer).

    The two moments of matched sets (query_id, pathway_id, m1, m2) fix a beta-binomial with
    n = |query| * |pathway| - min(|query|, |pathway|), unless its parameters (query_id, pathway_id, a, b) are given. No fit
    gives p = 1."""
    keys = ["query_id", "pathway_id"]
    every = every_pathway(query_sizes.select("query_id", F.col("n").alias("_q")), pathway_sizes)
    sized = every.join(observed, keys, "left").join(moments, keys, "left").fillna(0, ["n", "m1", "m2"])
    if fits is None:
        p = _mid_p(F.col("n"), _trials(), F.col("m1"), F.col("m2"))
    else:
        sized = sized.join(fits.select(*keys, F.col("a").alias("_a"), F.col("b").alias("_b")), keys, "left").fillna(-1.0, ["_a", "_b"])
        p = _mid_p_of_fit(F.col("n"), _trials(), F.col("_a"), F.col("_b"))
    tested = sized.select("query_id", "pathway_id", "n", F.col("m1").alias("expected"), p.alias("p"))
    return p_adjust(tested, ["query_id"])


def summed_crosstalk(genes: DataFrame, talk: DataFrame, keys: list[str]) -> DataFrame:
    """Crosstalk of gene sets as the sum over their genes' rows."""
    return genes.join(talk.withColumnRenamed("node", "gene"), "gene").groupBy(*keys, "pathway_id").agg(F.sum("n").alias("n"))


def ease(query: DataFrame, pathways: DataFrame, population: int | Column) -> DataFrame:
    """Overlap test with one gene taken off the overlap (an overlap of zero counts as one):
    (query_id, pathway_id, overlap, p, fdr, fwer) for every query and pathway."""
    q, members = query.select("query_id", "gene").distinct(), pathways.select("pathway_id", F.col("protein_id").alias("gene")).distinct()
    q_size = q.groupBy("query_id").agg(F.count("*").alias("_lt"))
    p_size = members.groupBy("pathway_id").agg(F.count("*").alias("n"))
    overlap = q.join(members, "gene").groupBy("query_id", "pathway_id").agg(F.count("*").alias("overlap"))
    every = every_pathway(q_size, p_size)
    table = every.join(overlap, ["query_id", "pathway_id"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    n = F.lit(population) if isinstance(population, int) else population
    lh, lt, ph = F.col("overlap"), F.col("_lt"), F.col("_p")
    # the 2x2 table [[k, ph-lh+1], [lt-lh, n-lt-ph+lh]] with k = max(lh, 1) - 1
    k = F.greatest(lh, F.lit(1)) - 1
    total = k + (ph - lh + 1) + (lt - lh) + (n - lt - ph + lh)
    p = hypergeom_tail(k, total, k + (ph - lh + 1), k + (lt - lh))
    return p_adjust(table.select("query_id", "pathway_id", "overlap", p.alias("p")), ["query_id"])


def combine_enrichment(crosstalk_result: DataFrame, ease_result: DataFrame, max_fwer: float = 0.05) -> DataFrame:
    """Pathways significant in either test, ordered by their best corrected p-value."""
    c = crosstalk_result.filter(F.col("fwer") < max_fwer).select(
        "query_id", "pathway_id", F.col("n").alias("crosstalk"), "expected", F.col("fdr").alias("crosstalk_fdr"), F.col("fwer").alias("crosstalk_fwer")
    )
    e = ease_result.filter(F.col("fwer") < max_fwer).select(
        "query_id", "pathway_id", "overlap", F.col("fdr").alias("overlap_fdr"), F.col("fwer").alias("overlap_fwer")
    )
    both = c.join(e, ["query_id", "pathway_id"], "full_outer")
    return both.withColumn("min_fwer", F.least("crosstalk_fwer", "overlap_fwer")).orderBy("query_id", "min_fwer", "pathway_id")


def crosstalk_enrichment(
    links: DataFrame, query: DataFrame, pathways: DataFrame, draws: int | None = None, seed: int = 9606, ppv: float = vocab.ENRICHMENT_PPV, refine: bool = False
) -> DataFrame:
    """The network test for a batch of gene sets: bins and crosstalk once, then moments, exact ones or those of `draws` sets.
    With `refine` the moments of the draws are the start of a fit by likelihood."""
    bins = checkpointed(network_bins(links, ppv))
    talk = checkpointed(crosstalk(links, pathways, ppv))
    inside = query.join(bins.select(F.col("node").alias("gene")), "gene", "left_semi")
    sizes = network_pathways(links, pathways, ppv).groupBy("pathway_id").agg(F.count("*").alias("n"))
    q_sizes = inside.groupBy("query_id").agg(F.count("*").alias("n"))
    fits = None
    if draws is None:
        if refine:
            raise ValueError("a fit by likelihood needs draws")
        moments = exact_moments(inside, bins, talk)
    else:
        random = checkpointed(summed_crosstalk(matched_samples(inside, bins, draws, seed), talk, ["query_id", "draw"]))
        moments = drawn_moments(random, draws)
        fits = refined_fits(random, draws, q_sizes, sizes) if refine else None
    return crosstalk_test(summed_crosstalk(inside, talk, ["query_id"]), moments, q_sizes, sizes, fits)


def enrichment(
    links: DataFrame, query: DataFrame, pathways: DataFrame, population: int, draws: int | None = None, seed: int = 9606,
    ppv: float = vocab.ENRICHMENT_PPV, max_fwer: float = 0.05,
) -> DataFrame:
    """Both tests for a batch of gene sets."""
    tested = crosstalk_enrichment(links, query, pathways, draws, seed, ppv)
    return combine_enrichment(tested, ease(query, pathways, population), max_fwer)
