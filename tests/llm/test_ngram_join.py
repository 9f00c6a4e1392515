import random

import pytest

from linkweave.llm import ngram_join
from linkweave.llm.ngram_join import jaccard_components, keep_one


def brute(rows):
    sets = []
    for _, text in rows:
        words = text.encode().lower().split() if text else []
        k = min(5, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min([x for x in (doc, least.get(find(i))) if x is not None], default=None)
    return sorted(((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def corpus(seed, groups=12, longest=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 30, 60, longest]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            words = edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3])) if rng.random() < 0.8 else base + [f"y{rng.randrange(10**6)}" for _ in range(len(base) // 8)]
            rows.append(" ".join(passage + words if rng.random() < 0.2 else words))
        rows.append("  ".join(w.upper() for w in base))
    rows += [None, "", " \t\n", " ".join(f"z{i % 7}" for i in range(30_000))]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [2])
def test_against_every_pair(spark, seed):
    rows = corpus(seed)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_hub_rounds_lose_no_link(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5])))) for i in range(150)]
    calls = []
    real = ngram_join._hub_pairs
    monkeypatch.setattr(ngram_join, "_hub_pairs", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(ngram_join, "MOST_PAIRS", 0)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert len(calls) > 1


def test_more_matches_where_shingles_are_common():
    import numpy as np

    assert ngram_join.pick_matches(np.zeros(30), 100, 80) == 1
    assert ngram_join.pick_matches(np.full(30, 50.0), 100, 80) > 1
    assert ngram_join.pick_matches(np.full(30, 50.0), 1, 1) == 1


def test_nulls_repeats_and_other_columns(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "A B c d e f", None), (3, None, "node"), (None, None, None), (4, "é b", "y"), (5, "É b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumnRenamed("node", "comp")
    got = sorted((tuple(r) for r in jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (3, 0, 3), (None, 0, None), (4, 1, 4), (5, 1, 5)], key=str)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0], r[1]) for r in kept.collect() if r[0] is not None) == [(1, "a b c d e f"), (3, None), (4, "é b"), (5, "É b")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(docs).columns == ["doc_id", "n_shingles", "component_id"]
    assert jaccard_components(docs).count() == 0
