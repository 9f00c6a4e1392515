"""Properties of the model and one test per place where observed behaviour had to be decided."""

import shutil
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkweave import vocab
from linkweave.functions import columns as C
from linkweave.operators import evidence as E
from linkweave.operators import filters as P
from linkweave.operators import goldstandard as G
from linkweave.operators import integration as I
from linkweave.operators import pairs as J
from linkweave.operators import queries as R
from linkweave.operators import training as M
from linkweave.plans import catalog, fixtures
from linkweave.plans import train as plan
from linkweave.sinks import writers as K
from linkweave.sources import readers as S

LLR = "evidence_id int, type string, tax_id string, direction int, a long, b long, gs string, llr double"
few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@few
@given(rows=st.lists(st.tuples(st.integers(1, 9), st.integers(1, 9), st.sampled_from([0, 2, 3, 5])), min_size=1, max_size=20))
def test_canonical_directed_is_stable(spark, rows):
    one = C.canonical_directed(C.drop_self(df(spark, rows, "a int, b int, direction int")))
    turn = one.select(F.col("b").alias("a"), F.col("a").alias("b"), F.when(F.col("direction") == 2, 3).when(F.col("direction") == 3, 2).otherwise(F.col("direction")).alias("direction"))
    two = C.canonical_directed(turn)
    got, again = sorted(map(tuple, one.collect())), sorted(map(tuple, two.collect()))
    assert got == again and all(a > b for a, b, _ in got)


def test_half_even_like_numpy(spark):
    import numpy as np

    v = [0.0785, 1.0015, 2.0005, -0.0005, 1.3145, 0.1 + 0.2]
    got = [r.x for r in df(spark, [(x,) for x in v], "x double").select(C.half_even("x", 3).alias("x")).collect()]
    np.testing.assert_allclose(got, np.round(v, 3), atol=1e-12)


def _llr(spark):
    rows = [
        (1, "MEX", "9606", 0, 5, 2, "PPI", 2.0), (2, "MEX", "10090", 0, 5, 2, "PPI", 3.0), (3, "MEX", "10116", 0, 5, 2, "PPI", -1.0),
        (4, "PIN", "9606", 0, 5, 2, "PPI", 0.5), (5, "PIN", "10090", 0, 5, 2, "PPI", 0.25), (4, "PIN", "9606", 0, 9, 1, "PPI", -0.5),
        (6, "GRG", "9606", 2, 5, 2, "PPI", 1.0), (6, "GRG", "9606", 3, 5, 2, "PPI", 1.5),
    ]
    return df(spark, rows, LLR)


def test_alpha_weights_follow_the_order_of_scores(spark):
    got = {r.evidence_id: r.wllr for r in I.integrate_weighted(_llr(spark).filter("type = 'MEX'")).collect()}
    assert got[2] == 3.0 and math.isclose(got[1], 1.4) and math.isclose(got[3], -0.49)
    plain = I.integrate_weighted(_llr(spark).filter("type = 'MEX'"), alpha=1.0).agg(F.sum("wllr")).first()[0]
    assert math.isclose(plain, 4.0)


def test_correlated_weights_multiply_between_neighbours(spark):
    r = df(spark, [("PPI", 2, 1, 0.5)], "gs string, evidence_a int, evidence_b int, correlation double")
    got = {x.evidence_id: x.wllr for x in I.integrate_weighted(_llr(spark).filter("type = 'MEX'"), correlations=r).collect()}
    assert got[2] == 3.0 and math.isclose(got[1], 2.0 * 0.35) and math.isclose(got[3], -1.0 * 0.35 * 0.7)


def test_both_directions_carry_the_undirected_evidence(spark):
    fbs = I.compute_fbs(I.integrate(I.merge_types(_llr(spark))))
    rows = {(r.a, r.direction): r for r in fbs.collect()}
    # the pair without a positive score is pruned
    assert set(rows) == {(5, 2), (5, 3)}
    mex, pin = 3.0 + 1.4 - 0.49, 0.75
    assert math.isclose(rows[(5, 2)].fbs, round(mex + pin + 1.0, 3)) and math.isclose(rows[(5, 3)].fbs, round(mex + pin + 1.5, 3))
    for r in rows.values():
        assert math.isclose(sum(r.llr_ev.values()), r.fbs, abs_tol=2e-3) and math.isclose(sum(r.llr_sp.values()), r.fbs, abs_tol=2e-3)


def test_single_dataset_types_are_checked(spark):
    with pytest.raises(Exception, match="several datasets"):
        I.integrate_single(_llr(spark).filter("type = 'PIN'")).collect()


def _scored(spark):
    fbs = I.compute_fbs(I.integrate(I.merge_types(_llr(spark))))
    model = df(spark, [("PPI", 1.0, 1.0, 3.0)], "gs string, a double, b double, c double")
    return fbs, model, I.max_ppv(M.fbs_to_ppv(fbs, model))


def test_network_rules(spark):
    _, _, scored = _scored(spark)
    known = df(spark, [("PPI", 9, 1, 1), ("Regulatory", 9, 1, 2), ("Regulatory", 9, 1, 3), ("Complex", 5, 2, 1)], "gs string, a long, b long, direction int")
    net = {(r.a, r.b): r for r in I.assemble_network(scored, known).collect()}
    assert set(net) == {(9, 1), (5, 2)}
    # known pair without evidence: two gold standards give 0.9, both directions add to 5
    lone = {g.gs: g for g in net[(9, 1)].gs}
    assert net[(9, 1)].max_ppv == 0.9 and lone["Regulatory"].is_gs == 5 and lone["PPI"].is_ppv_gs == 1
    # evidence above the gold-standard level stays; the better direction is kept
    best = {g.gs: g for g in net[(5, 2)].gs}
    assert net[(5, 2)].direction == 3 and best["PPI"].ppv > 0.85 and best["Complex"].ppv == 0.85 and best["Complex"].is_ppv_gs == 1


def test_confidence_clips_and_missing_models(spark):
    rows = df(spark, [("PPI", -5.0), ("PPI", 0.0), ("PPI", 9.0), ("Operon", 9.0)], "gs string, fbs double")
    model = df(spark, [("PPI", 1.2, 1.0, 3.0)], "gs string, a double, b double, c double")
    got = {(r.gs, r.fbs): r.ppv for r in M.fbs_to_ppv(rows, model).collect()}
    assert got == {("PPI", -5.0): 0.5, ("PPI", 0.0): 0.5, ("PPI", 9.0): 1.0, ("Operon", 9.0): 0.0}
    free = {(r.gs, r.fbs): r.ppv for r in M.fbs_to_ppv(rows, model, lo=0.0).collect()}
    assert math.isclose(free[("PPI", -5.0)], 0.057)


def test_rescoring_with_everything_returns_the_stored_score(spark):
    _, model, scored = _scored(spark)
    net = I.apply_gs_ppv(scored.withColumn("codes", F.create_map().cast("map<string,int>")))
    full = R.rescore(net, model, evidence=vocab.EVIDENCE_TYPES).filter("gs = 'PPI'")
    stored = net.select("a", "b", F.explode("gs").alias("g")).filter("g.gs = 'PPI'").select(F.col("g.fbs"))
    assert sorted(r.fbs for r in full.collect()) == sorted(r.fbs for r in stored.collect())


def test_packing_round_trip_and_file(spark, tmp_path):
    _, _, scored = _scored(spark)
    known = df(spark, [("PPI", 9, 1, 1), ("Complex", 5, 2, 1)], "gs string, a long, b long, direction int")
    net = I.assemble_network(scored, known)
    packed = I.pack_network(net)
    row = packed.filter("a = 9").first()
    assert row.ppv == "0.0,0.0,0.0,0.85,0.0,0.0" and row.is_goldstandard == "000100" and row.llr_evidence.count(";") == 5
    plain = lambda d: sorted((r.a, r.b, r.direction, r.max_ppv, [(*g[:5], sorted(g.llr_ev.items()), sorted(g.llr_sp.items())) for g in r.gs]) for r in d.collect())
    assert plain(I.unpack_network(packed)) == plain(net)
    protein = df(spark, [(i, f"P{i}") for i in (1, 2, 5, 9)], "protein_id long, uniprot_id string")
    K.write_network_tsv(net, protein, str(tmp_path / "net"))
    back = S.read_network_tsv(spark, str(tmp_path / "net"), ["ProteinA", "GoldStandard", "PPV", "LLR_PIN"]).collect()
    assert [r.ProteinA for r in back] == ["P5", "P9"] and back[0].LLR_PIN == 0.75


def test_transfer_turns_directions(spark):
    # observed elsewhere: swapped directed links lose their direction; here they turn
    links = df(spark, [(4, 2, 2)], "a long, b long, direction int")
    view = df(spark, [(4, 10), (2, 20)], "src_id long, dst_id long")
    assert [tuple(r) for r in J.transfer_links(links, view, direction="direction").select("a", "b", "direction").collect()] == [(20, 10, 3)]
    same = df(spark, [(4, 4), (2, 2)], "src_id long, dst_id long")
    assert [tuple(r) for r in J.transfer_links(links, same, direction="direction").select("a", "b", "direction").collect()] == [(4, 2, 2)]


def test_split_policies(spark):
    fbs = df(spark, [("PPI", i, 0, 1.0) for i in range(1, 5)], "gs string, a long, b long, fbs double")
    own, ort = df(spark, [("PPI", 1, 0)], "gs string, a long, b long"), df(spark, [("PPI", 2, 0), ("Complex", 3, 0)], "gs string, a long, b long")
    ids = lambda d: sorted(r.a for r in d.collect())
    split = {p: tuple(map(ids, G.split_pos_neg(fbs, own, ort, p))) for p in G.POLICIES}
    assert split["reference"] == ([1], [3, 4]) and split["carried_over"] == ([1], [1, 3, 4]) and split["all_species"] == ([1, 2], [3, 4])
    assert split["all_gold_standards"] == ([1, 2, 3], [4]) and split["no_overfit"] == ([2, 3], [4])


def test_complex_cap_is_per_source(spark):
    members = df(spark, [("big", f"p{i}") for i in range(5)] + [("small", "p0"), ("small", "p1")], "complex string, member string")
    ids = df(spark, [(f"p{i}", i) for i in range(5)], "mapped_id string, protein_id long")
    assert G.gs_complex([(members, 5)], ids).count() == 1
    assert G.gs_complex([(members, None)], ids).count() == 10


def test_ontology_weights(spark):
    edges = df(spark, [("c", "b", "is_a"), ("b", "a", "part_of"), ("c", "a", "part_of")], "child string, parent string, relation string")
    sv = {(r.term, r.ancestor): r.s for r in E.go_semantic_values(edges).collect()}
    assert math.isclose(sv[("c", "a")], 0.6) and math.isclose(sv[("c", "b")], 0.8) and sv[("a", "a")] == 1.0
    flat = {(r.term, r.ancestor): r.s for r in E.go_semantic_values(edges, part_of_weight=0.8).collect()}
    assert math.isclose(flat[("c", "a")], 0.8)


def test_direction_codes_add_up(spark):
    one = df(spark, [(2, 3, 1.0, 0.9), (2, 2, 1.0, 0.9), (0, 2, 9.0, 0.9), (5, 0, 0.0, 0.0), (1, 3, 0.0, 0.9)], "code int, grg int, llr double, ppv double")
    got = [r.d for r in one.select(R.link_direction(F.col("grg"), F.col("code"), F.col("llr"), F.col("ppv"), 0.5, 0.8).alias("d")).collect()]
    assert got == [5, 2, 2, 5, 0]


def test_host_pathogen_rows(spark):
    rows = df(spark, [("taxid:9606(x)", "taxid:2697049(y)", "pubmed:1"), ("-", "taxid:2697049", "pubmed:2"), ("taxid:9606", "taxid:10090", "pubmed:3"), ("taxid:9606", "taxid:2697049", "pubmed:88880001")], "tax_a string, tax_b string, pmid string")
    assert {r.pmid for r in P.host_pathogen_rows(rows, "9606", "2697049").collect()} == {"pubmed:1", "pubmed:2"}


def test_results_do_not_depend_on_partitions(spark):
    base = _llr(spark)
    seen = {str(sorted(map(str, I.compute_fbs(I.integrate(I.merge_types(base.repartition(n)))).collect()))) for n in (1, 7, 64)}
    assert len(seen) == 1


def test_seed_modules_come_from_the_whole_network(spark):
    sf = "/root/testdata/sf0.001"
    got = catalog.QUERIES["r16_seed_module"](spark, sf).join(fixtures.net(spark, sf).select("a", "b", "ppv"), ["a", "b"])
    assert got.filter("ppv < 0.97").count() > 0


def test_species_are_trained_together_and_only_once(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    ev, gs, orth = fixtures.species_evidence(spark, sf), fixtures.species_gs(spark, sf), fixtures.species_orthologs(spark, sf)
    cfg = plan.TrainingConfig(min_r2=-1e9, min_ppv_r2=-1e9, boots=5)
    path = str(tmp_path / "store")

    def wanted(*names):
        return spark.createDataFrame([(n,) for n in names], "tax_id string")

    def flat(net):
        return sorted(map(str, I.explode_best_gs(net.drop("tax_id")).select("a", "b", "direction", "gold_standard", "ppv", "fbs_max", "is_gs", "is_ppv_gs", "llr_ev").collect()))

    first = flat(plan.train_remaining(ev, gs, orth, wanted("10090"), path, cfg))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "network" / "tax_id=10090").iterdir()}
    # a species that was stopped before its row was written has files already
    shutil.copytree(tmp_path / "store" / "network" / "tax_id=10090", tmp_path / "store" / "network" / "tax_id=10116")
    both = plan.train_remaining(ev, gs, orth, wanted("9606", "10090", "10116"), path, cfg)
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "network" / "tax_id=10090").iterdir()}
    assert {r["tax_id"]: r["num_links"] for r in spark.read.parquet(f"{path}/stats").collect()} == {r["tax_id"]: r["count"] for r in both.groupBy("tax_id").count().collect()}
    assert both.filter("tax_id = '10116'").agg(F.min("a")).first()[0] > 20_000_000
    for species, of_all in (("10090", first), ("9606", flat(both.filter("tax_id = '9606'")))):
        own, carried = (x.withColumns({"a": F.col("a.id"), "b": F.col("b.id")}) for x in plan._gold_standards(gs, orth, [species]))
        assert flat(plan.train(ev, own, carried.select("gs", "a", "b"), species, cfg, orth).network) == of_all and len(of_all) > 1000
