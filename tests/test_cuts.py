"""Pairs above a cut against all pairs, joins on heavy keys against plain joins, fits by likelihood, and reading in ranges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkweave.functions import stats as S
from linkweave.operators import allpairs as A
from linkweave.operators import enrichment
from linkweave.operators import evidence as E
from linkweave.operators import queries as R
from linkweave.operators import tiles
from linkweave.sources import readers


def above(df, cut, score="score", keys=("a", "b")):
    """The settled pairs of a score at or above the cut."""
    return sorted((*(r[k] for k in keys), round(r[score], 9)) for r in df.collect() if round(r[score], 12) >= cut)


@pytest.fixture(scope="module")
def profiles(spark):
    """Four groups of like presence profiles over twelve species, one profile without a species of the tree."""
    rng = np.random.default_rng(3)
    rows = [(i, sorted({int(s) for s in range(12) if (s // 3 == i % 4) != (rng.random() < 0.08)})) for i in range(80)]
    return spark.createDataFrame([*rows, (80, [99])], "protein_id long, species array<int>")


def test_phylo_pairs_above_a_cut(profiles):
    tree = pd.DataFrame({"species": list(range(12)) * 2, "branch": [f"s{i}" for i in range(12)] + [f"g{i // 3}" for i in range(12)], "length": [1 + i / 10 for i in range(12)] + [2.0] * 12})
    every = A.phylo_pairs(profiles, tree, block=16)
    for cut in (-1.0, 0.3, 1.2):
        assert above(A.phylo_pairs(profiles, tree, block=7, min_score=cut), cut) == above(every, cut) != []


def annotations(spark, seed, genes=60):
    rng = np.random.default_rng(seed)
    rows = [(g, f"t{int(t)}") for g in range(genes) for t in {0, *rng.integers(1 + 10 * (g % 4), 12 + 10 * (g % 4), rng.integers(1, 7))}]
    return spark.createDataFrame([(g, t) for g, t in rows] + [rows[0]], "protein_id long, term string")


def test_mutual_information_above_a_cut(spark):
    ann = annotations(spark, 5)
    every = A.weighted_mi_pairs(ann, block=16)
    top = sorted(r["score"] for r in every.collect())
    for cut in (round(top[len(top) // 2], 4), round(top[-40], 4)):
        assert above(A.weighted_mi_pairs(ann, block=4, min_score=cut), cut) == above(every, cut) != []


@pytest.mark.parametrize("min_score", [0.5, 0.8, 1.0])
def test_similar_genes_lose_no_pair(spark, min_score):
    ann = annotations(spark, 7)
    rng = np.random.default_rng(8)
    sims = {(f"t{max(i, j)}", f"t{min(i, j)}"): float(rng.random()) for i, j in rng.integers(0, 42, (400, 2)) if i != j}
    term_sim = spark.createDataFrame([(*k, v) for k, v in sims.items()], "term_a string, term_b string, sim double")
    want = above(A.gene_similarity(ann, term_sim), min_score)
    assert above(A.similar_genes(ann, term_sim, min_score), min_score) == want
    assert want or min_score == 1.0


def test_close_terms_lose_no_pair(spark):
    rng = np.random.default_rng(9)
    up = [(f"n{i}", f"n{int(p)}", "is_a" if rng.random() < 0.6 else "part_of") for i in range(1, 90) for p in {int(x) for x in rng.integers(max(0, i - 30), i, 2)}]
    sv = E.go_semantic_values(spark.createDataFrame(up, "child string, parent string, relation string"))
    every = E.term_similarity(sv)
    for cut in (0.3, 0.6, 0.8):
        got = above(E.close_terms(sv, cut, tile=5), cut, "sim", ("term_a", "term_b"))
        assert got == above(every, cut, "sim", ("term_a", "term_b")) != []


def test_the_root_alone_makes_no_candidates(spark):
    """Terms that share the root only: it is not among what they look up."""
    up = [(f"n{i}", "root", "is_a") for i in range(50)]
    sv = E.go_semantic_values(spark.createDataFrame(up, "child string, parent string, relation string"))
    assert E.close_terms(sv, 0.65).count() == 0
    assert {r["term_b"] if r["term_a"] == "root" else r["term_a"] for r in E.close_terms(sv, 0.6).collect()} == {f"n{i}" for i in range(50)}


@pytest.mark.parametrize("gaps", [0.0, 0.3])
def test_strong_correlations_lose_no_pair(spark, gaps):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(5, 14))
    rows = [(i, s, float(sign * base[i % 5, s] + 0.2 * rng.normal())) for i in range(70) for sign in [1 if i % 7 else -1] for s in range(14) if rng.random() >= gaps]
    rows += [(70, s, 1.0) for s in range(14)]  # constant: no score
    long = spark.createDataFrame(rows, "protein_id long, sample int, value double")
    every = [(r["a"], r["b"], round(r["score"], 9)) for r in A.spearman_pairs(long, 5).collect() if abs(round(r["score"], 12)) > 0.7]
    got = [(r["a"], r["b"], round(r["score"], 9)) for r in A.strong_spearman_pairs(long, 5, 0.7, block=8).collect()]
    assert sorted(got) == sorted(every) != []


def test_blocks_that_cannot_reach_the_cut_do_not_meet(spark, profiles):
    """Members of four far groups: pairs of blocks across groups are left out, so rows do not grow with the square."""
    rows = [(i, [i // 64 * 3, i // 64 * 3 + 1]) for i in range(256)]
    alike = spark.createDataFrame(rows, "protein_id long, species array<int>")
    share = lambda l, r: np.array([[1.0 if set(x) & set(y) else 0.0 for y in r["some"]] for x in l["some"]])
    bound = A.Bound([F.col("species")], "some array<int>", lambda pdf: {"some": sorted({s for own in pdf["species"] for s in own})}, share)
    cells = A.block_pairs(alike, "protein_id", bound, 0.5, 16).cache()
    # each member with the four blocks of its own group of sixteen blocks
    assert cells.count() == 256 * 4
    assert cells.select("_cell").distinct().count() == 4 * (4 * 5 // 2)


def test_cuts_on_empty_tables(spark):
    none = spark.createDataFrame([], "protein_id long, term string")
    sims = spark.createDataFrame([], "term_a string, term_b string, sim double")
    assert A.similar_genes(none, sims, 0.5).count() == 0
    long = spark.createDataFrame([], "protein_id long, sample int, value double")
    assert A.strong_spearman_pairs(long, 5, 0.5).count() == 0
    assert E.close_terms(spark.createDataFrame([], "term string, ancestor string, s double"), 0.5).count() == 0


def test_heavy_keys_on_both_sides(spark):
    rng = np.random.default_rng(13)
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 40 + [2] * 3 + [None] + rng.integers(3, 9, 20).tolist())], "k int, x int")
    right = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 30 + [2] * 50 + [None] + rng.integers(3, 9, 20).tolist())], "k int, y int")
    got = sorted(map(tuple, tiles.heavy_join(left, right, ["k"], "x", "y", tile=7).select("k", "x", "y").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))


def test_a_domain_of_half_of_all_proteins(spark):
    hits = spark.createDataFrame([(p, d) for p in range(60) for d in ({0, p % 5} if p % 2 else {1 + p % 7})], "protein_id long, domain int")
    ddi = spark.createDataFrame([(a, b, (a + b) / 10) for a in range(8) for b in range(a, 8)], "domain_a int, domain_b int, score double")
    held = {}
    for r in hits.collect():
        held.setdefault(r["protein_id"], set()).add(r["domain"])
    want = set()
    for r in ddi.collect():
        for a, own in held.items():
            for b, other in held.items():
                if a != b and r["domain_a"] in own and r["domain_b"] in other:
                    want.add((max(a, b), min(a, b), r["score"]))
    got = E.domain_pairs(ddi, hits)
    assert {(r["a"], r["b"], r["score"]) for r in got.collect()} == want


def test_names_of_any_length_are_found_by_their_rarest_run(spark):
    ids = [("Gene1", 1), ("gene12", 2), ("sup:1", 3), ("x", 4), ("", 5), (None, 6), ("Gene1", 1)] + [(f"hot{i}", 100 + i) for i in range(40)]
    names = ["g", "GE", "gene1", "Gene12", "hot", "ot3", "x", "zz", "", None, "1"]
    got = R.suggest_genes(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(ids, "mapped_id string, protein_id long"), tile=5)
    want = {(n, m, p, int(m.lower() != n.lower())) for n in names if n for m, p in ids if m is not None and n.lower() in m.lower()}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_classes_are_carried_over_ranges(spark):
    lines = ["C early none"] + [x for k in range(6) for x in [f"A<b>class {k}</b>", "B other", *(f"C    {k}{i:02d} path {i}" for i in range(k * 9))]]
    table = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    plan = readers.parse_pathway_index(table)
    want = [("early", "none", None)] + [(f"{k}{i:02d}", f"path {i}", f"class {k}") for k in range(6) for i in range(k * 9)]
    assert sorted(map(tuple, plan.collect()), key=str) == sorted(want, key=str)


def test_digamma_and_trigamma_are_derivatives():
    x, d = np.array([0.3, 1.0, 2.5, 40.0]), 1e-4
    assert np.allclose(S.digamma(x), (S.log_gamma(x + d) - S.log_gamma(x - d)) / (2 * d), atol=1e-6)
    assert np.allclose(S.trigamma(x), (S.digamma(x + d) - S.digamma(x - d)) / (2 * d), atol=1e-5)


def test_likelihood_fits_are_the_highest():
    """No point of a grid around a fit is likelier, and the parameters of many draws come back."""
    rng = np.random.default_rng(17)
    true = [(2.0, 9.0, 50), (0.6, 3.0, 200), (30.0, 4.0, 20)]
    drawn = [rng.binomial(n, rng.beta(a, b, 3000)) for a, b, n in true]
    row = np.repeat(np.arange(3), 3000)
    value, n = np.concatenate(drawn).astype(float), np.array([float(t[2]) for t in true])
    start = enrichment.moment_fit(n, np.array([d.mean() for d in drawn]), np.array([(d * d).mean() for d in drawn]))
    a, b = enrichment.likelihood_fit(row, value, np.ones(len(row)), n, *start)
    for i, (ta, tb, _) in enumerate(true):
        v = drawn[i]
        fit = lambda p, q: float(np.sum(S.log_gamma(v + p) + S.log_gamma(n[i] - v + q) - S.log_gamma(n[i] + p + q)) + len(v) * (S.log_gamma(p + q) - S.log_gamma(p) - S.log_gamma(q)))  # noqa: E731, B023
        best = fit(a[i], b[i])
        assert all(fit(a[i] * s, b[i] * t) <= best + 1e-6 for s in (0.99, 1, 1.01) for t in (0.99, 1, 1.01))
        assert abs(a[i] / ta - 1) < 0.15 and abs(b[i] / tb - 1) < 0.15


def test_refined_fits_by_rows(spark):
    """Zero draws count; values that vary no more than a binomial have no start and no fit."""
    rng = np.random.default_rng(19)
    wide, even = rng.binomial(28, rng.beta(1.5, 6, 400)), np.full(400, 7)
    rows = [("q", d, p, int(v)) for p, values in (("wide", wide), ("even", even)) for d, v in enumerate(values) if v]
    sizes = lambda key, rows: spark.createDataFrame(rows, f"{key} string, n long")
    fits = enrichment.refined_fits(spark.createDataFrame(rows, "query_id string, draw int, pathway_id string, n long"), 400, sizes("query_id", [("q", 4)]), sizes("pathway_id", [("wide", 8), ("even", 8)]))
    got = {r["pathway_id"]: (r["a"], r["b"]) for r in fits.collect()}
    n = np.array([28.0])
    start = enrichment.moment_fit(n, np.array([wide.mean()]), np.array([(wide * wide).mean()]))
    a, b = enrichment.likelihood_fit(np.zeros(400, int), wide.astype(float), np.ones(400), n, *start)
    assert np.allclose(got["wide"], (a[0], b[0]), rtol=1e-3) and min(got["even"]) < 0
