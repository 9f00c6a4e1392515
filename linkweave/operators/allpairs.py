"""Dense pair scores. Members are cut into blocks, every pair of blocks is one bounded cell, and a cell is
scored by matrix products in numpy. Spark partitions and shuffles the cells; no task sees a whole universe.

With a least score, pairs that cannot reach it are not formed: dense scores leave out pairs of blocks by bounds from
the blocks' summaries (`pairs_from`), similarities of annotations start from the rarest terms that a pair must share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions.ordered import numbered
from linkweave.operators.tiles import block_cells, heavy_join
from linkweave.session import checkpointed

BLOCK = 1024
SUMMARIES = 128  # blocks whose summaries meet in one cell
SLACK = 1e-9  # of a bound, for rounding
# scores of one cell: (left rows, right rows) -> (score matrix, extra columns as matrices)
Kernel = Callable[[pd.DataFrame, pd.DataFrame], dict[str, np.ndarray]]


def all_pairs(df: DataFrame, member: str, kernel: Kernel, schema: str, block: int = BLOCK) -> DataFrame:
    """Rows (a, b, ...) with a > b for all pairs the kernel gives a finite score to."""
    return _scored(block_cells(df, member, df.count(), block), member, kernel, schema)


def _scored(cells: DataFrame, member: str, kernel: Kernel, schema: str) -> DataFrame:
    # one cell per group; many small groups are packed into the shuffle partitions
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = pdf["_cell"].iloc[0]
        left = pdf[pdf["_tile"] == cell["i"]].sort_values(member).reset_index(drop=True)
        right = pdf[pdf["_tile"] == cell["j"]].sort_values(member).reset_index(drop=True)
        names = [c.split()[0] for c in schema.split(",")]
        if left.empty or right.empty:
            return pd.DataFrame({n: [] for n in names})
        out = kernel(left, right)
        keep = np.isfinite(out["score"])
        if cell["i"] == cell["j"]:
            keep &= np.tril(np.ones(keep.shape, dtype=bool), k=-1)
        i, j = np.nonzero(keep)
        x, y = left[member].to_numpy()[i], right[member].to_numpy()[j]
        cols = {"a": np.maximum(x, y), "b": np.minimum(x, y)}
        cols |= {name: m[i, j] for name, m in out.items()}
        return pd.DataFrame(cols)[names]

    return cells.groupBy("_cell").applyInPandas(score, schema)


# --- pairs above a cut -----------------------------------------------------------------------


@dataclass(frozen=True)
class Bound:
    """What a block tells about the pairs it may hold.

    Blocks are runs of members in the order of `order`, which should bring alike members together. `summary` makes the
    one row of a block, of columns `schema`; `most` gives for blocks x blocks the highest score that any pair of their
    members may have, by which a pair of blocks is left out."""

    order: list[Column]
    schema: str
    summary: Callable[[pd.DataFrame], dict[str, object]]
    most: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def block_pairs(df: DataFrame, member: str, bound: Bound, cut: float, block: int = BLOCK) -> DataFrame:
    """The members with `_tile`, a row per `_cell` of two blocks whose pairs may reach the cut. Rows grow with the
    members and with such pairs of blocks; the others are known by their summaries only, which meet in tiles."""
    run = ((F.col("_rn") - 1) / block).cast("long")
    tiled = checkpointed(numbered(df, [], [*bound.order, F.col(member)], "_rn").withColumn("_tile", run).drop("_rn"))

    summary, most = bound.summary, bound.most  # the order's columns stay on the driver

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"_block": key[0]} | summary(pdf)])

    blocks = checkpointed(tiled.groupBy("_tile").applyInPandas(summarise, f"_block bigint, {bound.schema}"))

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> dict[str, np.ndarray]:
        return {"score": np.where(most(left, right) >= cut - SLACK, 1.0, np.nan)}

    across = all_pairs(blocks, "_block", kernel, "a bigint, b bigint", SUMMARIES)
    inside = blocks.select(F.col("_block").alias("a"), F.col("_block").alias("b"))
    met = across.unionByName(inside).select(F.struct(F.col("b").alias("i"), F.col("a").alias("j")).alias("_cell"))
    ends = met.select(F.explode(F.array_distinct(F.array("_cell.i", "_cell.j"))).alias("_tile"), "_cell")
    return tiled.join(ends, "_tile")


def pairs_from(df: DataFrame, member: str, kernel: Kernel, schema: str, bound: Bound, cut: float, block: int = BLOCK) -> DataFrame:
    """`all_pairs` of which the score is `cut` or more (settled to twelve places)."""

    def strong(left: pd.DataFrame, right: pd.DataFrame) -> dict[str, np.ndarray]:
        out = kernel(left, right)
        return out | {"score": np.where(np.round(out["score"], 12) >= cut, out["score"], np.nan)}

    return _scored(block_pairs(df, member, bound, cut, block), member, strong, schema)


# --- rank correlation ------------------------------------------------------------------------


def _row_ranks(m: np.ndarray) -> np.ndarray:
    return pd.DataFrame(m).rank(axis=1).to_numpy()


def _standardise(r: np.ndarray) -> np.ndarray:
    r = r - r.mean(axis=1, keepdims=True)
    norm = np.sqrt((r * r).sum(axis=1, keepdims=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        return r / norm


def spearman_matrix(x: np.ndarray, y: np.ndarray, min_periods: int) -> np.ndarray:
    """Spearman of every row of x with every row of y; rows are re-ranked on the samples both have."""
    full_x, full_y = ~np.isnan(x), ~np.isnan(y)
    if full_x.all() and full_y.all():
        if x.shape[1] < min_periods:
            return np.full((len(x), len(y)), np.nan)
        return _standardise(_row_ranks(x)) @ _standardise(_row_ranks(y)).T
    out = np.full((len(x), len(y)), np.nan)
    for i in range(len(x)):
        has = full_x[i]
        common = full_y[:, has]
        n = common.sum(axis=1)
        use = np.nonzero(n >= min_periods)[0]
        if not len(use):
            continue
        other = _row_ranks(y[np.ix_(use, has)])
        own = _row_ranks(np.where(common[use], x[i, has], np.nan))
        other = other - np.nanmean(other, axis=1, keepdims=True)
        own = own - np.nanmean(own, axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.nansum(other * own, axis=1) / np.sqrt(np.nansum(other**2, axis=1) * np.nansum(own**2, axis=1))
        out[i, use] = r
    return out


def spearman_pairs(long: DataFrame, min_periods: int, min_abs: float | None = None, block: int = BLOCK) -> DataFrame:
    """All-pairs Spearman of (protein_id, sample, value) -> (a, b, score). Pairs with fewer than
    `min_periods` common samples have no score; with `min_abs` weaker ones are dropped in the cell."""
    return all_pairs(_profiles(long), "protein_id", _spearman_kernel(min_periods, min_abs), "a bigint, b bigint, score double", block)


def strong_spearman_pairs(long: DataFrame, min_periods: int, min_abs: float, block: int = BLOCK) -> DataFrame:
    """`spearman_pairs` above `min_abs`, without the pairs of blocks that cannot hold any.

    Ranks of a profile, centred and of length one, are a point on a sphere, and a correlation is the cosine of two. A
    block in which all have the same samples is a cap with a centre and a radius, so the angle between two caps bounds the
    correlations across them, negative ones from the other side. Where samples are missing, ranks depend on the partner:
    such blocks are left out only if they have too few samples in common."""
    profiles = _profiles(long)
    by_value = F.sort_array(F.transform(F.sequence(F.lit(1), F.size("values")), lambda i: F.struct(F.element_at("values", i).alias("v"), F.element_at("samples", i).alias("s"))), False)
    # members that peak in the same samples are neighbours
    peaks = F.transform(F.slice(by_value, 1, 3), lambda x: x["s"])

    def summary(pdf: pd.DataFrame) -> dict[str, object]:
        held = sorted({s for own in pdf["samples"] for s in own})
        out = {"samples": [str(s) for s in held], "centre": None, "radius": None}
        if all(len(own) == len(held) for own in pdf["samples"]):
            points = _standardise(_row_ranks(np.stack([np.asarray(v, float) for v in pdf["values"]])))
            points = points[np.isfinite(points).all(axis=1)]  # a constant profile has no score at all
            middle = points.sum(axis=0) if len(points) else np.zeros(len(held))
            length = np.linalg.norm(middle)
            if length > 1e-6:
                middle = middle / length
                out |= {"centre": middle.tolist(), "radius": float(np.arccos(np.clip(points @ middle, -1, 1)).max())}
        return out

    def most(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        names = np.unique(np.concatenate([*left["samples"], *right["samples"]]))
        x, y = (_held(pdf["samples"], names) for pdf in (left, right))
        out = np.where(x @ y.T >= min_periods, 1.0, -1.0)
        same = x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] == 2 * (x @ y.T)
        i, j = np.nonzero(same & left["centre"].notna().to_numpy()[:, None] & right["centre"].notna().to_numpy()[None, :] & (out > 0))
        if len(i):
            cosine = np.array([np.dot(left["centre"].iat[p], right["centre"].iat[q]) for p, q in zip(i, j, strict=True)])
            reach = left["radius"].to_numpy(float)[i] + right["radius"].to_numpy(float)[j]
            angle = np.arccos(np.clip(cosine, -1, 1))
            out[i, j] = np.cos(np.maximum(0, np.minimum(angle, np.pi - angle) - reach - 1e-7))
        return out

    bound = Bound([peaks], "samples array<string>, centre array<double>, radius double", summary, most)
    cells = block_pairs(profiles, "protein_id", bound, min_abs, block)
    return _scored(cells, "protein_id", _spearman_kernel(min_periods, min_abs), "a bigint, b bigint, score double")


def _held(lists: pd.Series, names: np.ndarray) -> np.ndarray:
    """A row per list: 1 where it has the name."""
    m = np.zeros((len(lists), len(names)))
    for k, own in enumerate(lists):
        m[k, np.searchsorted(names, own)] = 1
    return m


def _profiles(long: DataFrame) -> DataFrame:
    profiles = long.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).groupBy("protein_id").agg(
        F.array_sort(F.collect_list(F.struct("sample", F.col("value").cast("double").alias("value")))).alias("cells")
    )
    return profiles.select("protein_id", F.col("cells.sample").alias("samples"), F.col("cells.value").alias("values"))


def _spearman_kernel(min_periods: int, min_abs: float | None) -> Kernel:
    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> dict[str, np.ndarray]:
        names = np.unique(np.concatenate([*left["samples"], *right["samples"]]))

        def dense(pdf: pd.DataFrame) -> np.ndarray:
            m = np.full((len(pdf), len(names)), np.nan)
            for k, (s, v) in enumerate(zip(pdf["samples"], pdf["values"])):
                m[k, np.searchsorted(names, s)] = v
            return m

        r = spearman_matrix(dense(left), dense(right), min_periods)
        if min_abs is not None:
            # correlations of ranks are fractions; a value equal to the cut must not pass on rounding noise
            r = np.where(np.abs(np.round(r, 12)) > min_abs, r, np.nan)
        return {"score": r}

    return kernel


# --- phylogenetic profiles -------------------------------------------------------------------


def phylo_pairs(profiles: DataFrame, branches: pd.DataFrame, block: int = BLOCK, min_score: float | None = None) -> DataFrame:
    """Profile similarity on a species tree -> (a, b, score, n_both, n_total).

    `profiles` is (protein_id, species array). `branches` (species, branch, length) lists the branches on
    the path from the root to each species; its size is that of the species tree, not of the data.

    With `min_score`, pairs of blocks are left out whose branches cannot agree enough: what two members share is at most
    the branches that some member of either block has, and what they have together is at least what all members have.
    """
    species = sorted(branches["species"].unique())
    lengths = branches.groupby("branch")["length"].first().sort_index()
    on_path = pd.crosstab(branches["species"], branches["branch"]).reindex(index=species, columns=lengths.index).to_numpy(float)
    on_path = (on_path > 0).astype(np.float32)
    weight = lengths.to_numpy(float)
    position = {s: k for k, s in enumerate(species)}

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> dict[str, np.ndarray]:
        def dense(pdf: pd.DataFrame) -> np.ndarray:
            m = np.zeros((len(pdf), len(species)), np.float32)
            for k, present in enumerate(pdf["species"]):
                m[k, [position[s] for s in present if s in position]] = 1
            return m

        x, y = dense(left), dense(right)
        score, both, total = (np.empty((len(x), len(y))) for _ in range(3))
        for i in range(len(x)):
            shared = y * x[i]
            single = np.abs(y - x[i])
            agree = shared @ on_path > 0
            differ = (single @ on_path > 0) & ~agree
            score[i] = np.log((1 + agree @ weight) / (1 + differ @ weight))
            both[i], total[i] = shared.sum(axis=1), shared.sum(axis=1) + single.sum(axis=1)
        return {"score": score, "n_both": both.astype(int), "n_total": total.astype(int)}

    schema = "a bigint, b bigint, score double, n_both int, n_total int"
    if min_score is None:
        return all_pairs(profiles, "protein_id", kernel, schema, block)

    def summary(pdf: pd.DataFrame) -> dict[str, object]:
        held = np.stack([on_path[[position[s] for s in present if s in position]].max(axis=0, initial=0) for present in pdf["species"]])
        return {"some": held.max(axis=0).tolist(), "every": held.min(axis=0).tolist()}

    def most(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        (sx, ex), (sy, ey) = ((np.stack(pdf["some"]), np.stack(pdf["every"])) for pdf in (left, right))
        agree = (sx * weight) @ sy.T
        together = (ex @ weight)[:, None] + (ey @ weight)[None, :] - (ex * weight) @ ey.T
        return np.log((1 + agree) / (1 + np.maximum(0, together - agree)))

    bound = Bound([F.col("species")], "some array<double>, every array<double>", summary, most)
    return pairs_from(profiles, "protein_id", kernel, schema, bound, min_score, block)


# --- annotation similarity -------------------------------------------------------------------


def _incidence(pdf: pd.DataFrame, terms: np.ndarray) -> np.ndarray:
    m = np.zeros((len(pdf), len(terms)))
    for k, own in enumerate(pdf["terms"]):
        m[k, np.searchsorted(terms, own)] = 1
    return m


def weighted_mi_pairs(ann: DataFrame, block: int = BLOCK, min_score: float | None = None) -> DataFrame:
    """Weighted mutual information of term presence for all gene pairs -> (a, b, score).

    A term held by n of the N annotations weighs 1 - n/N when present and n/N when absent; only terms of
    either gene count, so four sums over the shared and one-sided terms give the score.

    With `min_score`, pairs of blocks are left out by the most each part of the sum may come to: j log(j / f) is convex
    in j, so its highest value is at the largest shared weight or zero; for one-sided terms j / f is at most the number
    of terms over the smallest weight of a member, as a term's weights are below one.
    """
    ann = ann.select("protein_id", "term").distinct()
    sizes = ann.groupBy("term").agg(F.count("*").alias("n"))
    # scalar subqueries: one number each
    absent = F.col("n") / sizes.agg(F.sum("n")).scalar()
    weighted = sizes.select("term", (1 - absent).alias("w1"), absent.alias("w0"))
    cells = F.array_sort(F.collect_list(F.struct("term", "w1", "w0")))
    genes = ann.join(weighted, "term").groupBy("protein_id").agg(cells.alias("c"))
    genes = genes.select("protein_id", F.col("c.term").alias("terms"), F.col("c.w1").alias("w1"), F.col("c.w0").alias("w0"))
    n_terms = sizes.count()

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> dict[str, np.ndarray]:
        terms = np.unique(np.concatenate([*left["terms"], *right["terms"]]))
        w1, w0 = np.zeros(len(terms)), np.zeros(len(terms))
        for pdf in (left, right):
            for own, p, q in zip(pdf["terms"], pdf["w1"], pdf["w0"]):
                at = np.searchsorted(terms, own)
                w1[at], w0[at] = p, q
        x, y = _incidence(left, terms), _incidence(right, terms)

        def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            shared = (x * w) @ y.T
            return shared, (x @ w)[:, None] - shared, (y @ w)[None, :] - shared

        s11 = sums(w1 * w1)[0]
        _, s10, s01 = sums(w1 * w0)
        _, only_x0, only_y0 = sums(w0)
        fx1, fy1 = (x @ w1)[:, None], (y @ w1)[None, :]
        score = np.zeros(s11.shape)
        # (joint, frequency on the left, frequency on the right)
        for joint, fx, fy in ((s11, fx1, fy1), (s10, fx1, only_x0), (s01, only_y0, fy1)):
            j, f = joint / n_terms, fx * fy / n_terms**2
            with np.errstate(divide="ignore", invalid="ignore"):
                score += np.where(joint > 1e-12, j * np.log2(j / f), 0.0)
        return {"score": score}

    schema = "a bigint, b bigint, score double"
    if min_score is None:
        return all_pairs(genes, "protein_id", kernel, schema, block)

    def summary(pdf: pd.DataFrame) -> dict[str, object]:
        weights = {t: (p, q) for row in zip(pdf["terms"], pdf["w1"], pdf["w0"]) for t, p, q in zip(*row)}
        some = sorted(weights)
        every = set(some).intersection(*[set(own) for own in pdf["terms"]])
        return {
            "terms": some, "w1": [float(weights[t][0]) for t in some], "w0": [float(weights[t][1]) for t in some],
            "every": [t for t in some if t in every], "least": float(min(np.sum(p) for p in pdf["w1"])),
        }

    def most(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        terms = np.unique(np.concatenate([*left["terms"], *right["terms"]]))
        w1, w0 = np.zeros(len(terms)), np.zeros(len(terms))
        for pdf in (left, right):
            for own, p, q in zip(pdf["terms"], pdf["w1"], pdf["w0"]):
                at = np.searchsorted(terms, own)
                w1[at], w0[at] = p, q
        x, y, ex, ey = (_held(pdf[c], terms) for c in ("terms", "every") for pdf in (left, right))
        lx, ly = (np.maximum(pdf["least"].to_numpy(float), 1e-12) for pdf in (left, right))
        shared = (x * (w1 * w1)) @ y.T / n_terms
        only_x = ((x @ (w1 * w0))[:, None] - (x * (w1 * w0)) @ ey.T) / n_terms
        only_y = ((y @ (w1 * w0))[None, :] - (ex * (w1 * w0)) @ y.T) / n_terms
        with np.errstate(divide="ignore", invalid="ignore"):
            both = np.where(shared > 0, shared * np.log2(shared * n_terms**2 / (lx[:, None] * ly[None, :])), 0)
        one = only_x * np.log2(np.maximum(1, n_terms / lx))[:, None] + only_y * np.log2(np.maximum(1, n_terms / ly))[None, :]
        return np.maximum(0, both) + one

    text = genes.schema["terms"].dataType.simpleString()
    bound = Bound([F.col("terms")], f"terms {text}, w1 array<double>, w0 array<double>, every {text}, least double", summary, most)
    return pairs_from(genes, "protein_id", kernel, schema, bound, min_score, block)


def gene_similarity(ann: DataFrame, term_sim: DataFrame, block: int = BLOCK) -> DataFrame:
    """Best-match average of term similarities for all gene pairs -> (a, b, score).

    First the best match of every term in every gene is one distributed aggregate; the sum over the
    terms of the other gene is then a matrix product per cell. `term_sim` (term_a, term_b, sim) holds
    unordered pairs; a term is fully similar to itself.
    """
    ann = ann.select("protein_id", "term").distinct()
    both = term_sim.select(
        F.explode(
            F.array(
                F.struct(F.col("term_a").alias("term"), F.col("term_b").alias("other")),
                F.struct(F.col("term_b").alias("term"), F.col("term_a").alias("other")),
            )
        ).alias("t"),
        "sim",
    ).select("t.term", "t.other", "sim")
    own = ann.select("protein_id", "term", F.lit(1.0).alias("sim"))
    matched = ann.withColumnRenamed("term", "other").join(both, "other").select("protein_id", "term", "sim")
    best = matched.unionByName(own).groupBy("protein_id", "term").agg(F.max("sim").alias("sim"))
    held = ann.withColumn("held", F.lit(1))
    cells = F.array_sort(F.collect_list(F.struct("term", "sim", F.coalesce("held", F.lit(0)).alias("held"))))
    genes = best.join(held, ["protein_id", "term"], "left").groupBy("protein_id").agg(cells.alias("c"))
    genes = genes.select("protein_id", F.col("c.term").alias("terms"), F.col("c.sim").alias("sims"), F.col("c.held").alias("held"))

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> dict[str, np.ndarray]:
        terms = np.unique(np.concatenate([*left["terms"], *right["terms"]]))

        def dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            sim, has = np.zeros((len(pdf), len(terms))), np.zeros((len(pdf), len(terms)))
            for k, (own, s, h) in enumerate(zip(pdf["terms"], pdf["sims"], pdf["held"])):
                at = np.searchsorted(terms, own)
                sim[k, at], has[k, at] = s, h
            return sim, has

        (sx, hx), (sy, hy) = dense(left), dense(right)
        size = hx.sum(axis=1)[:, None] + hy.sum(axis=1)[None, :]
        return {"score": (hx @ sy.T + sx @ hy.T) / size}

    return all_pairs(genes, "protein_id", kernel, "a bigint, b bigint, score double", block)


def similar_genes(ann: DataFrame, term_sim: DataFrame, min_score: float, near: float | None = None) -> DataFrame:
    """`gene_similarity` of `min_score` or more, formed from the pairs that can reach it -> (a, b, score).

    The score is the mean of the best matches of both genes' terms, so in one of the two genes the mean is no less, and
    at least a share (min_score - near) / (1 - near) of its n terms has a match of `near` or more. Leaving out one term
    fewer than that, those that reach most genes, leaves one with such a match: only the others look for partners.
    Neither a gene of many terms nor a term of many genes makes pairs that share only frequent terms."""
    near = 0.75 * min_score if near is None else near
    ann = checkpointed(ann.select("protein_id", "term").distinct())
    own = ann.select(F.col("term").alias("term_a"), F.col("term").alias("term_b"), F.lit(1.0).alias("sim")).distinct()
    turned = term_sim.select(F.col("term_b").alias("term_a"), F.col("term_a").alias("term_b"), "sim")
    both = checkpointed(term_sim.select("term_a", "term_b", "sim").unionByName(turned).filter("sim > 0").unionByName(own))
    alike = both.filter(F.col("sim") >= near - SLACK).drop("sim")
    held = ann.groupBy("term").agg(F.count("*").alias("_genes"))
    reach = alike.join(held, F.col("term_b") == F.col("term")).groupBy("term_a").agg(F.sum("_genes").alias("_reach"))
    ranked = ann.join(reach.withColumnRenamed("term_a", "term"), "term", "left").withColumn("_reach", F.coalesce("_reach", F.lit(0)))
    rare = F.array_sort(F.collect_list(F.struct("_reach", "term")))
    spare = F.ceil(F.round(F.size("_t") * ((min_score - near) / (1 - near)), 9)) - 1
    lists = ranked.groupBy("protein_id").agg(rare.alias("_t"))
    probes = lists.select(F.col("protein_id").alias("x"), F.explode(F.slice("_t", F.lit(1), (F.size("_t") - F.greatest(spare, F.lit(0))).cast("int"))["term"]).alias("term_a"))
    # a probe of many genes and a term of many genes are cut into tiles on both sides
    asked = probes.join(alike, "term_a").select("x", F.col("term_b").alias("term")).distinct()
    met = heavy_join(asked, ann.withColumnRenamed("protein_id", "y"), ["term"], "x", "y").filter("x <> y")
    pairs = checkpointed(met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    sizes = ann.groupBy("protein_id").agg(F.count("*").alias("_n"))
    # the best match of each term of one gene among the terms of the other, by the terms it is like
    ends = pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select("a", "b", F.col("b").alias("x"), F.col("a").alias("y")))
    best = ann.withColumnRenamed("term", "term_b").join(both, "term_b").groupBy(F.col("protein_id").alias("y"), F.col("term_a").alias("term")).agg(F.max("sim").alias("sim"))
    sums = ends.join(ann.withColumnRenamed("protein_id", "x"), "x").join(best, ["y", "term"]).groupBy("a", "b").agg(F.sum("sim").alias("_sum"))
    na, nb = (sizes.withColumnsRenamed({"protein_id": c, "_n": f"_n{c}"}) for c in ("a", "b"))
    score = F.col("_sum") / (F.col("_na") + F.col("_nb"))
    scored = sums.join(na, "a").join(nb, "b").select("a", "b", score.alias("score"))
    return scored.filter(F.round("score", 12) >= min_score)
