"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from linkweave.plans import catalog  # noqa: E402
from linkweave.session import local_session  # noqa: E402

HEADLINE = [
    "e01_jaccard_pairs",
    "j21_member_pairs",
    "g04_degree",
    "e02_spearman_pairs",
    "e04_publication_scores",
    "e10_phylo_pairs",
    "j05_transfer_links",
    "j13_interval_overlap",
    "m04_kde_grid",
    "m07_score_to_llr",
    "m15_compute_fbs",
    "m17_bootstrap_precision",
    "m23_assemble_network",
    "r04_neighbour_links",
    "r09_expand_group",
    "r12_linked_candidates",
    "r13_components",
    "u07_top_links_per_node",
    "x01_crosstalk",
    "x06_ease",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the session outside the timings
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
