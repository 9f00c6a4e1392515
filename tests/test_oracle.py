"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

from linkweave.plans import catalog
from tools.check import TABLES, rows

SF = "/root/testdata/sf0.001"
# one or two of each family; tools/check.py runs all of them
NAMES = """p01_canonical_pair p02_canonical_directed p04_extract_accession p14_ppi_rows p17_select_pathways p21_rescale_cut
 j01_map_ids j03_map_ids_prefixed j05_transfer_directed j13_interval_overlap j21_member_pairs u07_top_links_per_node u08_top_fraction
 g06_count_distinct w01_keep_best w04_degree_bins w05_average_rank n01_minmax n02_boxcox_minmax e01_jaccard_pairs e02_spearman_with_gaps
 e03_domain_scores e04_publication_scores e10_phylo_pairs e11_go_semantic_values e14_weighted_mi_pairs e16_fisher_combine
 l02_gs_pathway_relations l08_split_reference l11_gs_matrix m05_log_ratio m08_redundancy m15_compute_fbs m17_precision_curve
 m24_explode_best_gs k04_unpack_network r02_resolve_genes r03_suggest_genes r09_expand_group r12_linked_candidates r13_components r25_link_details
 x01_crosstalk x05_p_adjust x06_ease x09_closest_by_lineage x18_build_id_mapping x20_build_orthologs s02_read_idmapping s03_read_species_index
 s11_read_abundance s17_read_kgml""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalog.ORACLES[name]).df()
    assert rows(got) == rows(want)


def test_every_key_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 220


def test_flagship_runs(spark):
    net = catalog.flagship(spark, SF)
    assert net.columns == ["a", "b", "direction", "gold_standard", "ppv", "fbs_max", "is_gs", "is_ppv_gs"]
    assert net.count() > 0
