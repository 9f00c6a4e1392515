import hashlib

import numpy as np
import pytest

from linkweave.llm import codes


def brute(rows):
    """The rows of the query, in plain loops; rows: (id, vector, label)."""
    kept = [(i, tuple(int(np.floor(256 * float(x))) for x in v), lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v) % 16 == 0]
    out = []
    for dims in {len(v) for _, v, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == dims), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        w = dims // 16
        part = lambda v, p: v[p * w : p * w + w]
        books = [[part(v, p) for _, v, _ in own[:64]] for p in range(16)]

        def nearest(x, book):
            return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

        for _ in range(2):
            for p in range(16):
                met = {}
                for _, v, _ in own:
                    met.setdefault(nearest(part(v, p), books[p])[1], []).append(part(v, p))
                for e, xs in met.items():
                    books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
        sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for i, v, lab in own:
            found = [nearest(part(v, p), books[p]) for p in range(16)]
            out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab, sha))
    total = {}
    for *_, e, lab, _ in out:
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, c, e, total[lab], sha) for i, c, e, lab, sha in out), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, code string")


def run(spark, rows):
    return sorted(map(tuple, codes.query(table(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.12, 64))], int(i) % 3 if i % 7 else None) for i in rng.permutation(300)]
    rows += [(400 + i, rows[3][1], 9) for i in range(90)]  # a group of copies
    rows += [rows[5], rows[5], (rows[0][0], rows[9][1], 1), (None, rows[8][1], 2)]
    rows += [(900, None, 1), (901, [None] + [0.1] * 63, 1), (902, [float("nan")] * 64, 1), (903, [float("inf")] * 64, 1), (904, [0.1] * 63, 1)]
    assert run(spark, rows) == brute(rows)


def test_ties_lengths_and_empty(spark):
    grid = [(i, [float((i >> (d % 4)) & 1) for d in range(32)], None) for i in range(16)]  # equally near entries
    odd = [(100, [1.0] * 16, 4), (101, [2.0] * 16, 4), (102, [], 4), (103, [], 5)]
    assert run(spark, grid + odd) == brute(grid + odd)
    assert codes.query(table(spark, [])).count() == 0
    assert codes.query(table(spark, [(1, None, 1)])).count() == 0


def test_large_components_are_clipped(spark):
    got = codes.query(table(spark, [(1, [1e30] * 16, 1), (2, [-1e30] * 16, 1)])).collect()
    assert [r["error"] for r in got] == [0, 0] and len({r["code"] for r in got}) == 2


@pytest.mark.parametrize(("cell", "most"), [(1, 4), (5, 50), (32, 1 << 16), (10_000, 10)])
def test_cells_lose_no_nearest_entry(cell, most):
    rng = np.random.default_rng(cell)
    book = rng.integers(-90, 90, (64, 4))
    book[40:44] = book[3]  # equal entries
    grid = codes.GridCells(book, cell, most)
    for _ in range(4):
        rows = rng.integers(-130, 130, (500, 4))
        found, error = grid.nearest(rows)
        every = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
        assert (found == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()


def test_cells_of_equal_hash():
    rng = np.random.default_rng(1)
    grid = codes.GridCells(rng.integers(-90, 90, (64, 4)), 8)
    grid.mix = np.zeros(4, np.uint64)
    rows = rng.integers(-130, 130, (200, 4))
    every = ((rows[:, None] - grid.entries[None]) ** 2).sum(axis=2)
    for _ in range(2):
        assert (grid.nearest(rows)[0] == every.argmin(axis=1)).all()


def test_boxes_rule_entries_out():
    rng = np.random.default_rng(2)
    grid = codes.GridCells(rng.normal(0, 32, (64, 4)).astype(np.int64), 32)
    grid.nearest(rng.normal(0, 32, (5000, 4)).astype(np.int64))
    assert grid.counts.mean() < 32 and len(grid.counts) < 2500
