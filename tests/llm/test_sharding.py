import zlib

import numpy as np
import pytest

from linkweave.llm import sharding


def test_shards_are_near_equal_and_slots_gapless(spark):
    rows = [(i, "x" * (50 + (i * 37) % 900), "a") for i in range(3000)] + [(9000, None, None), (9001, "", "a"), (None, "é" * 20, "a"), (5, "again", "a"), (5, "again", "a"), (9002, "y" * 20_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3)
    got = sharding.query(docs).collect()
    assert len(got) == len(rows)
    want = sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows if i is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == want
    held, numbers = np.zeros(24), {}
    for r in got:
        held[r["shard"]] += r["size"]
        numbers.setdefault(r["shard"], []).append(r["slot"])
    assert held.max() - held.min() <= 0.01 * held.mean()
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())
    assert {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    assert sorted(map(str, got)) == sorted(map(str, sharding.query(docs.repartition(5)).collect()))


def test_later_runs_edit_the_stored_map(spark, tmp_path):
    def run(n, shards):
        docs = spark.createDataFrame([(i, "x" * (i * 31 % 700)) for i in range(n)], "doc_id long, text string")
        rows, slots = sharding.sharded(docs, n_shards=shards, n_slots=512, path=str(tmp_path / "map"))
        return {r["doc_id"]: r["shard"] for r in rows.collect()}, rows.count(), slots

    def loads(n, placed):
        return np.bincount([placed[i] for i in range(n)], weights=[i * 31 % 700 + 8 for i in range(n)])

    first, count, slots = run(2000, 5)
    assert count == 2000 and slots.latest() == 2
    same, count, slots = run(2000, 5)
    assert count == 2000 and same == first and slots.latest() == 2
    more, count, slots = run(2600, 5)  # rebalanced for what came: slots that stay keep their records
    assert count == 2600 and slots.latest() == 3 and loads(2600, more).max() <= 1.05 * loads(2600, more).mean()
    assert 0 < sum(more[i] != first[i] for i in first) < 1000
    grown, count, slots = run(2600, 7)
    assert count == 2600 and slots.latest() == 5 and {grown[i] for i in more if grown[i] != more[i]} == {5, 6}
    maps = [{r["slot"]: r["shard"] for r in slots.read(v).collect()} for v in range(1, 6)]
    assert all(len(m) == 512 for m in maps)
    assert {maps[3][s] for s in maps[3] if maps[3][s] != maps[2][s]} == {5}
    with pytest.raises(ValueError):
        run(10, 6)
    with pytest.raises(Exception, match="already exists"):
        slots.append(5, 7, np.zeros(512, np.int64))


def test_edits():
    rng = np.random.default_rng(1)
    sizes = (rng.pareto(1.5, 4096) * 1000).astype(np.int64) + 8
    before = sharding.first_map(4096, 24)
    after = sharding.rebalanced(before, sizes, 24)
    held = np.bincount(after, weights=sizes)
    assert held.max() - held.min() <= 2 + 0.001 * held.mean() or sizes.max() > held.mean()
    grown = sharding.grown(after, sizes, 24)
    assert set(grown[grown != after]) == {24}
    assert abs(np.bincount(grown, weights=sizes)[24] - sizes.sum() / 25) < 0.05 * sizes.sum() / 25


def test_empty_table(spark):
    assert sharding.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
