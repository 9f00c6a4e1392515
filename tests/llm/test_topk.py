import numpy as np
import pytest

from linkweave.llm import topk


def brute(rows, k=5, every=50):
    ok = {(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, u in ok:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(u))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


@pytest.mark.parametrize("blocks", [60, 10_000])
def test_against_all_products(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "BLOCK_ROWS", blocks)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.3, 12))]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2050, [0.1, None] * 6), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (None, rows[0][1]), (0, rows[0][1])]
    rows += [(2200, [1.0, 2.0]), (2201, [1.0, -2.0]), (2250, []), (2300, [0.0] * 12)]
    got = topk.search(topk.build(r := topk.integers(table(spark, rows), "vec_id", "embedding"), blocks), r.filter("id % 50 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_bitmap_sums():
    rng = np.random.default_rng(5)
    values = rng.integers(-200, 200, (300, 7))
    lows, counts, slices = topk.sliced(values, drop=0)
    bits = np.unpackbits(slices.view(np.uint8), axis=1, bitorder="little")[:, :300]
    weights = np.array([5, 0, 3, 1, 9, 2, 6])
    groups, row = {}, 0
    for d, count in enumerate(counts):
        for b in range(count):
            for p in range(4):
                if weights[d] >> p & 1:
                    groups.setdefault(p + b, []).append(slices[row])
            row += 1
    sums = topk.add_up({w: np.array(x) for w, x in groups.items()}, slices.shape[1])
    got = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:300].astype(int) << t for t, s in enumerate(sums))
    assert bits.shape[0] == counts.sum() and (got == (values - lows) @ weights).all()


def test_empty_table(spark):
    assert topk.query(table(spark, [])).count() == 0
    assert topk.query(table(spark, [(50, [1.0, 2.0])])).count() == 0
