import numpy as np
import pytest

from linkweave.llm import metric_join as mj


def brute(rows, least=0.98):
    """(id, links, class, kept) of rows (id, vector, label), by all pairs; ids occur once."""
    ok = {i: np.array(v, np.float64) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    labels = {i: lab for i, _, lab in rows}
    links = {i: [] for i, _, _ in rows}
    for i, x in ok.items():
        for j, y in ok.items():
            if i != j and labels[i] == labels[j] and len(x) == len(y) and mj.cosine(x, y) >= least:
                links[i].append(j)
    out = []
    for i in links:
        seen, front = {i}, [i]
        while front:
            new = set(links[front.pop()]) - seen
            seen |= new
            front += new
        out.append((i, len(links[i]), min(seen), min(seen) == i))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "y") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, n_links int, h string")


def planted(seed, n=400, dims=12):
    """Noise, clusters wide and tight, chains of small steps, copies, scaled copies."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(0, 1, dims) for _ in range(n)]
    for _ in range(12):
        centre = rng.normal(0, 1, dims)
        rows += [centre + rng.normal(0, s, dims) for s in (0.02, 0.1, 0.2) for _ in range(12)]
    at, step = rng.normal(0, 1, dims), rng.normal(0, 0.15, dims)
    rows += [at + k * step for k in range(30)] + [rows[3] * f for f in (1, 1, 2, 0.5, 1e-30, 1e30)] + [-rows[3]]
    order = rng.permutation(len(rows))
    out = [(int(k), [float(x) for x in np.float32(rows[i])], int(i) % 2) for k, i in enumerate(order)]
    k = len(out)
    return out + [(k, None, 0), (k + 1, [], 0), (k + 2, [0.0] * dims, 0), (k + 3, [float("nan")] * dims, 0), (k + 4, [None] * dims, 1), (k + 5, out[0][1], None), (k + 6, out[0][1], None), (k + 7, [1.0, 2.0], 0), (k + 8, [2.0, 4.0], 0)]


@pytest.mark.parametrize(("cell_rows", "block_rows"), [(20, 1024), (20, 16), (10_000, 64)])
def test_against_all_pairs(spark, cell_rows, block_rows):
    rows = planted(cell_rows + block_rows)
    got = mj.near_copies(table(spark, rows), cell_rows=cell_rows, block_rows=block_rows)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_cells_meet_every_near_pair_once():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (30, 8))
    x = mj.unit(centres[rng.integers(0, 30, 600)] + rng.normal(0, 0.15, (600, 8)))
    for radius in (0.1, 0.2, 0.5):
        cells = mj.Cells(mj.chosen_pivots(x, 64, radius, copies=6.0), radius)
        assert len(cells.pivots) > 1
        row, cell, home = cells(x)
        assert np.bincount(row[home], minlength=600).tolist() == [1] * 600
        met = np.zeros((600, 600), int)
        for c in range(len(cells.pivots)):
            inside, at_home = row[cell == c], home[cell == c]
            met[np.ix_(inside, inside)] += at_home[:, None] | at_home[None, :]
        near = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)) <= radius
        assert (met[near] == 1).all() and (met <= 1).all()


def test_pivots_are_measured():
    rng = np.random.default_rng(6)
    noise = mj.unit(rng.normal(0, 1, (800, 64)))
    centres = mj.unit(rng.normal(0, 1, (64, 64)))
    tight = mj.unit(centres[rng.integers(0, 64, 800)] + rng.normal(0, 0.005, (800, 64)))
    assert len(mj.chosen_pivots(tight, 64, 0.2)) == 64 > len(mj.chosen_pivots(noise, 64, 0.2))


def test_repeated_ids_and_rows(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, 0), (1, a, 0), (2, a, 0), (3, b, 0), (2, b, 0), (7, c, 0), (9, c, 1), (None, c, 0), (None, c, 0)]
    got = sorted(map(tuple, mj.near_copies(table(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False), (7, 0, 7, True), (9, 0, 9, True), (None, 0, None, True)], key=str)


def test_empty_table(spark):
    assert mj.query(table(spark, [])).count() == 0
    assert [tuple(r) for r in mj.query(table(spark, [(5, None, 1)])).collect()] == [(5, 0, 5, True)]
