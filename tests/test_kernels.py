"""Numeric kernels and order-dependent helpers against plain loops on small inputs."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from linkweave.functions import ordered as O
from linkweave.functions import stats as S
from linkweave.operators import allpairs as A
from linkweave.operators import enrichment as E
from linkweave.operators import evidence as V
from linkweave.operators import graph
from linkweave.operators import normalise as N
from linkweave.operators import pairs as J
from linkweave.operators import tiles
from linkweave.operators import training as M


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_member_pairs_of_a_hot_group_are_whole(spark):
    members = [(1, i) for i in range(60)] + [(2, 5), (2, 9)] + [(3, 1)]
    got = tiles.member_pairs(df(spark, members, "g int, m long"), ["g"], "m", tile=7).collect()
    want = {(1, a, b) for a, b in itertools.product(range(60), repeat=2) if a > b} | {(2, 9, 5)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_jaccard_does_not_depend_on_tiles(spark):
    rng = np.random.default_rng(3)
    sets = {i: set(rng.choice(12, rng.integers(1, 9), replace=False).tolist()) for i in range(25)}
    rows = df(spark, [(i, a) for i, s in sets.items() for a in s], "id long, attr long")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a > b and sets[a] & sets[b]}
    for tile in (2, 5, 4096):
        got = {(r.a, r.b): r.score for r in V.jaccard_pairs(rows, tile=tile).collect()}
        assert got.keys() == want.keys() and all(0 < v <= 1 and math.isclose(v, want[k]) for k, v in got.items())


@pytest.mark.parametrize("block", [3, 100])
def test_spearman_with_missing_cells(spark, block):
    rng = np.random.default_rng(5)
    m = rng.integers(0, 6, (11, 9)).astype(float)
    m[rng.random(m.shape) < 0.25] = np.nan
    want = pd.DataFrame(m.T).corr(method=lambda x, y: np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1] if len(x) >= 4 else np.nan, min_periods=4)
    long = [(i, j, float(m[i, j])) for i in range(11) for j in range(9) if not np.isnan(m[i, j])]
    got = {(r.a, r.b): r.score for r in A.spearman_pairs(df(spark, long, "protein_id long, sample int, value double"), 4, block=block).collect()}
    expected = {(a, b): want.iloc[a, b] for a in range(11) for b in range(a) if np.isfinite(want.iloc[a, b])}
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k], abs_tol=1e-9) for k in got)


def test_phylo_score_by_hand(spark):
    branches = pd.DataFrame({"species": [0, 0, 1, 1, 2], "branch": ["x", "top", "y", "top", "z"], "length": [1.0, 2.0, 3.0, 2.0, 5.0]})
    profiles = df(spark, [(1, [0, 1]), (2, [0, 2]), (3, [1])], "protein_id long, species array<int>")
    got = {(r.a, r.b): r for r in A.phylo_pairs(profiles, branches, block=2).collect()}
    # 1 and 2 share species 0 (x, top); species 1 adds y (top is already positive), species 2 adds z
    assert math.isclose(got[(2, 1)].score, math.log((1 + 3) / (1 + 3 + 5)))
    assert (got[(2, 1)].n_both, got[(2, 1)].n_total) == (1, 3)
    assert math.isclose(got[(3, 2)].score, math.log(1 / (1 + 3 + 2 + 1 + 5)))


def test_boxcox_lambda_is_the_maximum(spark):
    x = np.random.default_rng(1).lognormal(0.3, 0.8, 800)
    lam = N.boxcox_lambda(df(spark, [(float(v),) for v in x], "score double")).first()["lambda"]

    def llf(p):
        t = np.log(x) if abs(p) < 1e-12 else (x**p - 1) / p
        return (p - 1) * np.log(x).sum() - len(x) / 2 * np.log(t.var())

    grid = np.arange(-2, 2, 0.0005)
    assert abs(lam - grid[np.argmax([llf(g) for g in grid])]) < 1e-3


def test_boxcox_range_widens(spark):
    """The best exponent of a power of a normal sample lies far outside the first range."""
    x = np.random.default_rng(2).normal(10, 1, 4_000) ** (1 / 5.35)
    lam = N.boxcox_lambda(df(spark, [(float(v),) for v in x], "score double")).first()["lambda"]

    def llf(p):
        return (p - 1) * np.log(x).sum() - len(x) / 2 * np.log(((x**p - 1) / p).var())

    grid = np.arange(3, 8, 0.0005)
    assert 4 < lam < 7 and abs(lam - grid[np.argmax([llf(g) for g in grid])]) < 2e-3


def test_moments_of_matched_sets_against_all_draws(spark):
    bins = df(spark, [(i, 1 if i < 5 else 2) for i in range(9)], "node long, bin int")
    count = {(i, "p"): i * i % 5 for i in range(9)} | {(i, "r"): i % 2 for i in range(9)}
    talk = df(spark, [(i, w, n) for (i, w), n in count.items() if n], "node long, pathway_id string, n long")
    query = df(spark, [("q", 0), ("q", 1), ("q", 7)], "query_id string, gene long")
    got = {r.pathway_id: (r.m1, r.m2) for r in E.exact_moments(query, bins, talk).collect()}
    for w in ("p", "r"):
        sums = [count[a, w] + count[b, w] + count[c, w] for a, b in itertools.combinations(range(5), 2) for c in range(5, 9)]
        assert np.allclose(got[w], (np.mean(sums), np.mean(np.square(sums))))


def test_draws_without_replacement():
    rng = np.random.default_rng(0)
    counts = np.array([5, 0, 1000, 30, 10**12])
    for size in (0, 1, 700):
        got = M._draw(rng, counts, size)
        assert got.sum() == size and (got <= counts).all() and (got >= 0).all()
    small = np.array([3, 50, 7])
    mean = np.mean([M._draw(rng, small, 40) for _ in range(4000)], axis=0)
    assert np.abs(mean - small * 40 / 60).max() < 0.1 and (M._draw(rng, small, 60) == small).all()


def _score_frames(spark, rng):
    pos, neg = rng.beta(4, 2, 900).round(4), rng.beta(2, 4, 1500).round(4)
    make = lambda v: df(spark, [(1, "PPI", i, 0, float(s)) for i, s in enumerate(v)], "evidence_id int, gs string, a long, b long, score double")
    return pos, neg, make(pos), make(neg)


def _naive_llr(pos, neg):
    keep = lambda s: s[(s >= np.percentile(s, 1)) & (s <= np.percentile(s, 99))]
    pos, neg = keep(pos), keep(neg)
    lo, hi = max(pos.min(), neg.min()), min(pos.max(), neg.max())
    pos, neg = (s[(s > lo) & (s < hi)] for s in (pos, neg))
    lo, hi = max(pos.min(), neg.min()), min(pos.max(), neg.max())
    x = np.linspace(lo, hi, 1000)

    def kde(s):
        h = (len(s) * 0.75) ** -0.2 * s.std(ddof=1)
        return np.exp(-0.5 * ((x[:, None] - s) / h) ** 2).sum(axis=1) / (len(s) * h * math.sqrt(2 * math.pi))

    return x, np.log(kde(pos) / kde(neg))


def test_llr_fit_follows_the_plain_computation(spark):
    pos, neg, p, n = _score_frames(spark, np.random.default_rng(8))
    row = M.fit_llr(p, n, min_r2=0.9).first()
    x, y = _naive_llr(pos, neg)
    degree = len(row.coefficients) - 1
    assert row.error is None and row.r2 >= 0.9 and degree in (2, 3)
    assert math.isclose(row.x_min, x[0]) and math.isclose(row.x_max, x[-1])
    np.testing.assert_allclose(row.coefficients, np.polyfit(x, y, degree), rtol=1e-6, atol=1e-6)


def test_too_few_samples_give_an_error_row(spark):
    _, _, p, n = _score_frames(spark, np.random.default_rng(8))
    row = M.fit_llr(p.filter("a < 50"), n).first()
    assert row.error == "|PGS|<100" and row.coefficients is None


def test_upper_sample_size_is_drawn(spark):
    _, _, p, n = _score_frames(spark, np.random.default_rng(8))
    row = M.fit_llr(p, n, sample=(100, 300), min_r2=-1e9).first()
    assert row.coefficients is not None


def test_logistic_fit_recovers_a_curve():
    x = np.linspace(0, 6, 400)
    y = 0.97 / (1 + np.exp(-1.7 * (x - 2.5)))
    p, r2 = M.logistic_fit(x, y)
    np.testing.assert_allclose(p, [0.97, 1.7, 2.5], rtol=1e-4)
    assert r2 > 0.999999


def test_precision_curve_and_bootstrap(spark):
    rng = np.random.default_rng(2)
    pos, neg = rng.normal(3, 1, 120).clip(0.01).round(3), rng.normal(2, 1, 120).clip(0.01).round(3)
    make = lambda v: df(spark, [("PPI", float(s)) for s in v], "gs string, fbs double")
    counts = M.fbs_counts(make(pos), make(neg))
    t = np.linspace(min(pos.min(), neg.min()), max(pos.max(), neg.max()), 1000)
    want = np.array([1.0 if (pos > v).sum() + (neg > v).sum() == 0 else (pos > v).sum() / ((pos > v).sum() + (neg > v).sum()) for v in t])
    boot = M.bootstrap_precision(counts, boots=2).orderBy("boot", "threshold").toPandas()
    # classes of equal size: a balanced draw takes every negative
    np.testing.assert_allclose(boot[boot.boot == 1].ppv, want, atol=1e-12)
    curve = M.precision_curve(counts).orderBy("i").toPandas()
    assert (np.abs(curve.ppv - want) < 1e-9).mean() > 0.995 and curve.ppv.iloc[-1] == 1.0


def test_hypergeom_tail_is_exact(spark):
    cases = [(k, 20, m, d) for k in range(0, 6) for m in (1, 5, 12) for d in (1, 4, 15)]
    got = df(spark, cases, "k long, n long, m long, d long").withColumn("p", S.hypergeom_tail(F.col("k"), F.col("n"), F.col("m"), F.col("d"))).collect()
    for r in got:
        want = sum(Fraction(math.comb(r.m, j) * math.comb(r.n - r.m, r.d - j), math.comb(r.n, r.d)) for j in range(max(r.k, 0), min(r.m, r.d) + 1) if r.d - j <= r.n - r.m)
        assert math.isclose(r.p, float(want), abs_tol=1e-12)


def test_bh_is_monotone_and_not_below_raw(spark):
    p = np.random.default_rng(4).random(60).round(2)
    got = S.p_adjust(df(spark, [("q", i, float(v)) for i, v in enumerate(p)], "query_id string, i int, p double"), ["query_id"]).toPandas().sort_values("p")
    assert len(got) == 60 and (got.fdr >= got.p - 1e-12).all() and got.fdr.is_monotonic_increasing
    m = len(p)
    order = np.sort(p)[::-1]
    want = np.minimum.accumulate(order * m / np.arange(m, 0, -1)).clip(max=1)[::-1]
    np.testing.assert_allclose(got.fdr, want, atol=1e-12)


def test_mid_p_against_a_plain_sum():
    n, a, b = 30, 2.5, 7.0
    beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    pmf = np.array([math.comb(n, k) * math.exp(beta(k + a, n - k + b) - beta(a, b)) for k in range(n + 1)])
    assert math.isclose(pmf.sum(), 1, rel_tol=1e-9)
    for k in (0, 3, 15, 30):
        assert math.isclose(E.mid_p(k, n, a, b), 0.5 * pmf[k] + pmf[k + 1 :].sum(), abs_tol=1e-9)
    assert math.isnan(E.mid_p(3, 30, -1, 2))


def test_numbering_by_ranges_equals_the_window(spark):
    rng = np.random.default_rng(6)
    rows = df(spark, [(0 if i < 150 else int(i % 4), int(v), i) for i, v in enumerate(rng.integers(0, 9, 240))], "k int, v int, i int")
    order = [F.col("v"), F.col("i")]
    one = {r.i: r.rn for r in rows.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order))).collect()}
    two = {r.i: r.rn for r in O.numbered(rows, ["k"], order).collect()}
    assert one == two


def test_sample_is_exact_and_independent_of_partitions(spark):
    rows = df(spark, [(i % 3, i) for i in range(3000)], "k int, i long")
    picks = [sorted((r.k, r.i) for r in O.sample_n(rows.repartition(n), 137, 9, ["k"], ["i"]).collect()) for n in (1, 7, 40)]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 3 * 137
    assert len(O.sample_n(rows, 5000, 9, ["k"], ["i"]).collect()) == 3000


def test_quantiles_interpolate_like_numpy(spark):
    v = np.random.default_rng(7).integers(0, 40, 333).astype(float)
    r = O.quantile_bounds(df(spark, [("a", float(x)) for x in v], "k string, x double"), ["k"], "x", 0.013, 0.87).first()
    np.testing.assert_allclose([r.q_lo, r.q_hi], np.percentile(v, [1.3, 87]))


# --- graphs ----------------------------------------------------------------------------------


def _graph(seed, n=18, p=0.14):
    rng = np.random.default_rng(seed)
    return [(a, b) for a in range(n) for b in range(a) if rng.random() < p]


def _neighbours(edges):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    return adj


def _component(adj, start):
    seen, todo = {start}, [start]
    while todo:
        for y in adj.get(todo.pop(), ()):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    edges = _graph(seed, 30, 0.05) + [(100 + i, 99 + i) for i in range(1, 20)]
    adj = _neighbours(edges)
    got = {r.node: r.component for r in graph.components(df(spark, [("q", a, b) for a, b in edges], "query_id string, a long, b long")).collect()}
    assert got == {n: min(_component(adj, n)) for n in adj}


def test_path_connectors(spark):
    edges = _graph(4)
    adj, seeds, steps = _neighbours(edges), [0, 3, 7, 11], 2
    want = set()
    for s in [x for x in seeds if x in adj]:
        pred, level = {s: None}, [s]
        while level:
            new = {}
            for x in level:
                for y in adj[x]:
                    if y not in pred:
                        new[y] = min(new.get(y, x), x)
            pred |= new
            level = list(new)
        for t in seeds:
            path, x = [], t
            if t in pred and t != s:
                while pred[x] is not None:
                    x = pred[x]
                    path.append(x)
                if len(path) - 1 <= steps:
                    want |= set(path[:-1])
    got = graph.path_connectors(
        df(spark, [("q", a, b) for a, b in edges], "query_id string, a long, b long"), df(spark, [("q", s) for s in seeds], "query_id string, gene long"), steps
    )
    assert {r.node for r in got.collect()} == want


def test_seed_rank(spark):
    edges = _graph(5)
    adj = _neighbours(edges)
    seeds = [s for s in (0, 5, 9) if s in adj]
    nodes = sorted(adj)
    restart = np.array([1 / len(seeds) if n in seeds else 0 for n in nodes])
    x = np.full(len(nodes), 1 / len(nodes))
    for _ in range(300):
        x = np.array([0.75 * sum(x[nodes.index(m)] / len(adj[m]) for m in adj[n]) for n in nodes]) + 0.25 * restart
    got = graph.seed_rank(
        df(spark, [("q", a, b) for a, b in edges], "query_id string, a long, b long"), df(spark, [("q", s) for s in seeds], "query_id string, gene long"), tol=1e-9
    )
    ranks = {r.node: r["rank"] for r in got.collect()}
    np.testing.assert_allclose([ranks[n] for n in nodes], x, atol=1e-6)


def test_pruning_keeps_seeds_together(spark):
    # seeds 1, 2, 3; connector 4 joins all, 5 and 6 are detours
    edges = [(4, 1), (4, 2), (4, 3), (5, 1), (5, 2), (6, 5)]
    e = df(spark, [("q", a, b) for a, b in edges], "query_id string, a long, b long")
    s = df(spark, [("q", n) for n in (1, 2, 3)], "query_id string, gene long")
    r = df(spark, [("q", n, v) for n, v in {1: 0.2, 2: 0.2, 3: 0.2, 4: 0.3, 5: 0.05, 6: 0.01}.items()], "query_id string, node long, rank double")
    got = {(x.a, x.b) for x in graph.prune_modules(e, s, r).collect()}
    assert got == {(4, 1), (4, 2), (4, 3)}


def _pruned(edges, seeds, rank):
    """Connectors one after another, in plain Python: the links that stay."""
    nodes = {n for e in edges for n in e}
    alive, seeds = set(nodes), seeds & nodes

    def reached(start, among):
        seen, front = {start}, [start]
        while front:
            at = front.pop()
            new = {b if a == at else a for a, b in edges if at in (a, b) and a in among and b in among} - seen
            seen |= new
            front += new
        return seen

    for k in sorted(nodes - seeds, key=lambda n: (rank[n], n)):
        if k in alive and seeds and seeds <= (left := reached(min(seeds), alive - {k})):
            alive = left
    return {(a, b) for a, b in edges if a in alive and b in alive}


def test_pruning_against_one_by_one(spark):
    rng = np.random.default_rng(8)
    modules, want = {}, set()
    for q in range(60):
        n = int(rng.integers(3, 26))
        m = int(rng.integers(n - 1, 3 * n))
        pairs = {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(m)}
        if q % 3:  # connected, by a random tree; every third is left as it falls
            pairs |= {(int(rng.integers(0, i)), i) for i in range(1, n)}
        seeds = set(map(int, rng.choice(n, int(rng.integers(0, min(n, 7))), replace=False)))
        rank = {i: float(rng.integers(0, 6)) for i in range(n)}  # ties go by id
        modules[f"q{q}"] = (pairs, seeds, rank)
        want |= {(f"q{q}", *e) for e in _pruned(pairs, seeds, rank)}
    e = df(spark, [(q, *x) for q, (p, _, _) in modules.items() for x in p], "query_id string, a long, b long")
    s = df(spark, [(q, x) for q, (_, s, _) in modules.items() for x in s], "query_id string, gene long")
    r = df(spark, [(q, n, v) for q, (_, _, rank) in modules.items() for n, v in rank.items()], "query_id string, node long, rank double")
    assert {tuple(x) for x in graph.prune_modules(e, s, r).collect()} == want


def test_connectors_against_all_shortest_paths(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(110)})
    seeds = list(range(0, 60, 9))
    near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in range(60)}
    for steps in (1, 2, 3):
        want = set()
        for s in seeds:
            depth, pred, front = {s: 0}, {}, [s]
            for d in range(1, steps + 2):
                new = {}
                for u in sorted(front):
                    for v in near[u] - depth.keys():
                        new.setdefault(v, u)
                depth |= dict.fromkeys(new, d)
                pred |= new
                front = list(new)
            for t in seeds:
                at = pred.get(t)
                while at is not None and at != s:
                    want.add(at)
                    at = pred.get(at)
        got = graph.path_connectors(df(spark, [("q", a, b) for a, b in pairs], "query_id string, a long, b long"), df(spark, [("q", s) for s in seeds], "query_id string, gene long"), steps)
        assert {r["node"] for r in got.collect()} == want


def test_ranks_and_quantiles_of_one_hot_key(spark):
    rng = np.random.default_rng(12)
    hot, small = rng.normal(size=20_000).round(4), np.array([2.0, 1.0, 2.0, 5.0])
    rows = [("hot", float(x)) for x in hot] + [("small", float(x)) for x in small]
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "x"]))
    distinct = table.distinct()
    ranges = O.ranged(distinct, ["k"], [F.col("x")]).filter("k = 'hot'").groupBy("_range").count().collect()
    # no task has the whole key
    assert len(ranges) > 2 and max(r["count"] for r in ranges) < 0.6 * len(set(hot))
    got = O.value_ranks(table, ["k"], "x").collect()
    for k, values in (("hot", hot), ("small", small)):
        want = dict(zip(values, pd.Series(values).rank()))
        assert {r["x"]: r["avg_rank"] for r in got if r["k"] == k} == want
    bounds = {r["k"]: (r["q_lo"], r["q_hi"]) for r in O.quantile_bounds(table, ["k"], "x", 0.013, 0.985).collect()}
    for k, values in (("hot", hot), ("small", small)):
        assert np.allclose(bounds[k], np.quantile(values, [0.013, 0.985]), atol=1e-12)


def test_adjusted_p_of_one_hot_family(spark):
    rng = np.random.default_rng(13)
    p = {"hot": (rng.random(8000) ** 3).round(4), "small": np.array([0.5, 0.01, 0.01, 1.0])}
    table = spark.createDataFrame(pd.DataFrame([(k, i, float(x)) for k, xs in p.items() for i, x in enumerate(xs)], columns=["k", "i", "p"]))
    got = {(r["k"], r["i"]): (r["fdr"], r["fwer"]) for r in S.p_adjust(table, ["k"]).collect()}
    for k, xs in p.items():
        order, least = np.argsort(-xs), 1.0
        upto = pd.Series(xs).rank(method="max").to_numpy()
        for i in order:
            least = min(least, xs[i] * len(xs) / upto[i])
            assert math.isclose(got[k, int(i)][0], least, rel_tol=1e-12) and math.isclose(got[k, int(i)][1], min(1.0, xs[i] * len(xs)), rel_tol=1e-12)


def test_best_rows_of_a_hot_key_in_parts(spark):
    rng = np.random.default_rng(14)
    rows = [("hub", i, float(rng.integers(0, 50))) for i in range(4000)] + [("q", i, 1.0) for i in range(3)]
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "i", "x"]))
    order = [F.col("x").desc(), F.col("i")]
    want = sorted(tuple(r) for r in J.top_per_key(table, ["k"], 7, order).collect())
    assert sorted(tuple(r) for r in J.top_per_key(table, ["k"], 7, order, 16).collect()) == want and len(want) == 10
    by_row = J.top_per_key(table, ["k"], F.when(F.col("k") == "hub", 5).otherwise(1), order, 16)
    assert {r["k"]: r["count"] for r in by_row.groupBy("k").count().collect()} == {"hub": 5, "q": 1}
