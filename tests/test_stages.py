"""Queries that read the co-ordered pairs several times make them once."""

import pytest

from linkweave.plans import catalog, fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["j12_positives", "m02_fit_llr", "m06_fit_poly", "m09_integrate_correlated", "m17_precision_curve", "m25_score_host_pathogen"])
def test_pairs_are_made_once(spark, monkeypatch, name):
    made, pairs = [], fixtures.pairs
    monkeypatch.setattr(fixtures, "pairs", lambda *at: made.append(at) or pairs(*at))
    catalog.QUERIES[name](spark, SF)
    assert len(made) == 1
