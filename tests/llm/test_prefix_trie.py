import hashlib
import random
import zlib

import pytest

from linkweave.llm import prefix_trie as pt


def brute(rows):
    """The query's rows, node by node; rows: (conv_id, turn, role, text)."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            mark = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            convs.setdefault(c, []).append((t is not None, t or 0, mark, r, x))
    plain = {c: [s[3:] for s in sorted(ts)] for c, ts in convs.items()}
    whole = {}
    for c, ts in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(plain.get(int(c / 100) * 100, [])[:h] + ts[h:])
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = []
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(m[: len(n)] == n and len(m) > len(n) for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in held if whole[c] == node)))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def run(spark, rows, shards):
    found = pt.trie(pt.rebuilt(pt.paths(table(spark, rows))), shards).select(COLUMNS)
    return sorted(map(tuple, found.collect()), key=str)


def made(seed, n=250):
    """Few distinct turns, so that prefixes are shared; groups of copies; missing bases; a long one; gaps, ties, nulls."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(700), n):
        if c != 300:
            rows += [(c, t, "user" if t % 2 else "bot", rng.choice(["", "hi", "hoé\U0001f600"])) for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1080) for t in range(7)]
    rows += [(2000, t, "user", f"long {t // 2}") for t in range(120)] + [(2101, t, "user", "z") for t in range(1)]
    rows += [(3000, None, "a", None), (3000, None, None, "b"), (3000, 1, "a", "b"), (3000, 1, "a", "b"), (3000, 1, "ab", ""), (-7, 1, "a", "b"), (-7, 2, "a", "b"), (None, 1, "a", "b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [1, 7, 60])
def test_against_all_prefixes(spark, monkeypatch, shards):
    monkeypatch.setattr(pt, "PIECE", 3)
    rows = made(shards)
    assert run(spark, rows, shards) == brute(rows)


def test_copies_over_many_shards(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 30_000, 100) for t in range(3)]
    assert run(spark, rows, 12) == brute(rows)


def test_splitters_are_bounded_and_ordered(spark, monkeypatch):
    convs = pt.paths(table(spark, made(5))).cache()
    cuts = pt.splitters(convs, 9)
    assert cuts == sorted(cuts) and 0 < len(cuts) <= 8
    bones = pt.Skeleton(cuts)
    assert all(p < k for k, p in enumerate(bones.parents)) and len(bones.parents) <= 1 + sum(len(p) // pt.WIDE for p, _ in cuts)


def test_turnless_and_empty(spark):
    assert pt.query(table(spark, [])).count() == 0
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lone, 1, "a", "text")]
    got = [tuple(r) for r in pt.query(table(spark, rows)).select(COLUMNS).collect()]
    assert got == brute(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_texts_of_nodes(spark):
    rows = [(200, 1, "user", "first"), (200, 2, None, None)]
    turns = table(spark, rows)
    nodes = pt.with_texts(pt.trie(pt.rebuilt(pt.paths(turns))), turns)
    assert sorted((r["depth"], r["role"], r["text"]) for r in nodes.collect()) == [(0, None, None), (1, "user", "first"), (2, "", "")]
