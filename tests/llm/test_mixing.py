import math

from linkweave.llm import mixing


def targets(sizes, most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1.0 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left, open_weight = total - sum(most * sizes[s] for s in full), sum(w for s, w in weight.items() if s not in full)
        goal = {s: most * sizes[s] if s in full else left * weight[s] / open_weight for s in names}
        above = {s for s in names if s not in full and goal[s] > most * sizes[s]}
        if not above:
            return goal
        full |= above


def rows():
    out, i = [], 0
    for source, n in [("a", 300), ("b", 5), ("é", 40), ("Z", 1), (None, 30), ("", 60), ("none", 4)]:
        for j in range(n):
            words = 0 if source == "none" else 1 + (j * j * 7 + len(str(source))) % 90
            out.append((i, " ".join("w" * (1 + k % 4) for k in range(words)) if words or j % 2 else None, source, "x"))
            i += 1
    out += [out[0], out[0]]
    return [*out, (None, "some words here", "a", "x"), (i + 1, "long " * 20_000, "b", "y")]


def test_targets_rates_and_copies(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size string").repartition(4)
    got = mixing.query(docs).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = targets(sizes)
    by_id = {i: s for i, _, s, _ in data}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        source = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[source] and math.isclose(r["target"], goal[source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[source] += r["taken"]
    for s in sizes:
        spare = 10_000 if s == "b" else 100  # one very long document takes whole copies
        assert abs(taken[s] - goal[s]) <= spare, (s, taken[s], goal[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.query(docs.repartition(2)).collect()))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def test_newton_reaches_capped_targets_from_other_base_rates(spark):
    cells = spark.createDataFrame([("a", 1.0, 100, 290.0), ("a", 0.1, 50, 290.0), ("b", 2.0, 10, 1.0), ("c", 1.0, 5, 15.0)], "source string, base double, words long, target double")
    found = {r["source"]: r["lambda"] for r in mixing.multipliers(cells, "source", 3.0).collect()}
    mass = {}
    for r in cells.collect():
        mass[r["source"]] = mass.get(r["source"], 0) + r["words"] * min(3.0, r["base"] * math.exp(found[r["source"]]))
    assert math.isclose(mass["a"], 290, rel_tol=1e-9) and math.isclose(mass["b"], 1, rel_tol=1e-9) and mass["c"] == 15


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.query(docs).count() == 0 and mixing.mixed(docs).count() == 0
    bare = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["size"], r["taken"], r["target"]) for r in mixing.query(bare).collect()) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
