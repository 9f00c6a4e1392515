"""Steps taken a pair at a time give what the long tables give."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linkweave.operators import integration as I
from linkweave.operators import pairwise
from linkweave.operators import training as M

LINKS = "evidence_id int, type string, tax_id string, a long, b long, score double, direction int"
MODELS = "evidence_id int, gs string, coefficients array<double>, x_min double, x_max double"
KINDS = [(1, "PIN", "9606"), (2, "MEX", "9606"), (3, "MEX", "10090"), (4, "MEX", "10116"), (5, "GRG", "9606"), (6, "TFB", "10090"), (7, "DOM", "9606")]


def _inputs(spark, seed=3, n=600):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        i, kind, tax = rng.choice(KINDS)
        a, b = rng.choice([None, *range(20, 40)]), rng.randrange(1, 9)
        score = rng.choice([None, float("nan"), *[round(rng.random(), 4) for _ in range(9)]])
        rows.append((i, kind, tax, a, b, score, rng.choice([2, 3, None]) if kind == "GRG" else 0))
    rows += rows[:40] + [(None, "PIN", "9606", 21, 3, 0.5, 0), (8, "PIN", "9606", 21, 3, 0.5, 0)]
    models = [(i, gs, [float(k), 2.0 - i / 5, -1.2][: 3 - (i == 2)], 0.05, 0.9) for i in range(1, 8) for k, gs in enumerate(("Complex", "PPI", "Metabolic")) if (i + k) % 4]
    models += [(1, "Signaling", None, 0.0, 1.0), (6, "PPI", [0.5], 0.1, 0.8)]
    return spark.createDataFrame(rows, LINKS), spark.createDataFrame(models, MODELS)


def _plain(df):
    return sorted(repr(tuple(sorted(map(repr, v)) if isinstance(v, list) else sorted(v.items()) if isinstance(v, dict) else v for v in r)) for r in df.collect())


def _forget(df):
    return df.select("*")


@pytest.mark.parametrize("rows", [7, 32_768])
def test_each_step_from_links_is_the_step_on_long_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(pairwise, "ROWS", rows)
    links, models = _inputs(spark)
    ppv = spark.createDataFrame([("Complex", 1.0, 2.0, 0.5), ("PPI", None, None, None), ("Metabolic", 0.9, None, 0.1)], "gs string, a double, b double, c double")
    llr = M.score_to_llr(links, models)
    merged, long = I.merge_types(llr), I.merge_types(_forget(llr))
    # rows of equal score and dataset may take each other's place: their weights are compared, not which row has which
    both = I.integrate(merged), I.integrate(long)
    fbs = I.compute_fbs(both[0]), I.compute_fbs(_forget(both[1]))
    whole = I.compute_fbs(both[0], prune=False), I.compute_fbs(_forget(both[1]), prune=False)
    scored = [M.fbs_to_ppv(fbs[0], ppv, 0.4), M.fbs_to_ppv(_forget(fbs[1]), ppv, 0.4)]
    packed = I.max_ppv(scored[0]), I.max_ppv(_forget(scored[1]))
    known = spark.createDataFrame([("PPI", 25, 3, 1), ("PPI", 25, 3, 3), ("Complex", 90, 1, 0)], "gs string, a long, b long, direction int")
    nets = I.assemble_network(packed[0], known), I.assemble_network(_forget(packed[1]), known)
    for one, other in ((merged, long), both, fbs, whole, scored, packed, nets):
        assert one.columns == other.columns and [t for _, t in one.dtypes] == [t for _, t in other.dtypes]
        assert _plain(one) == _plain(other)
    assert fbs[0].count() > 100


def test_long_rows_are_not_sorted_again(spark):
    links, models = _inputs(spark, n=50)
    fbs = I.compute_fbs(I.integrate(I.merge_types(M.score_to_llr(links, models))))
    plan = fbs._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "Aggregate" not in plan


def test_other_rows_take_the_general_way(spark):
    links, models = _inputs(spark, n=50)
    merged = I.merge_types(M.score_to_llr(links, models))
    assert pairwise.steps_of(merged.filter("type = 'MEX'"), "merged") is None
    assert pairwise.steps_of(I.merge_types(M.score_to_llr(links.withColumn("more", F.lit(1)), models)), "merged") is None
    unlisted = links.withColumn("tax_id", F.lit("1"))
    with pytest.raises(Exception, match="not in the fixed lists: .* / 1"):
        I.compute_fbs(I.integrate(I.merge_types(M.score_to_llr(unlisted, models)))).collect()


def test_redundancy_counts_scores_before_models(spark):
    links, models = _inputs(spark, n=4000)
    llr = M.score_to_llr(links, models)
    for method in ("spearman", "pearson"):
        one, other = M.redundancy(llr, 3, method), M.redundancy(_forget(llr), 3, method)
        assert one.columns == other.columns and one.dtypes == other.dtypes
    cells = M._common_values(llr)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    # the links meet before the gold standards of the models multiply them
    meet = [line for line in plan.splitlines() if re.search(r"Join Inner.* type#|Join Inner.*\(type#", line)]
    assert len(meet) == 1 and "score#" not in meet[0] and "gs#" not in meet[0]
    assert _plain(cells) == _plain(M._common_values(_forget(llr)).select(*cells.columns))
    assert cells.count() > 20
