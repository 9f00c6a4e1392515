import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.llm import quality, toxicity
from linkweave.llm.labelled import fold

CLEAN = [f"w{a}{b}" for a in "aeiou" for b in "bcdfghklmnprst"]
RUDE = ["idiot", "loser", "scum"]


def documents():
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        elif i % 6 == 1:
            words[5:5] = ["scum", "pond"]  # harmless where it stands
        poor = i % 5 == 2
        if poor:
            words = [w + "###" for w in words] if i % 2 else [w for w in words[:8] for _ in range(12)]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(not poor), int(toxic)))
    labels += [(None, 1, 1), (5000, None, None), (1, 1, 0), (3, 7, 7)]
    docs += [(7000, None, "x"), (7001, "", "x"), (7002, " \n", "x"), (None, "idiot loser " * 4, None), (0, docs[0][1], "x"), (7003, "wab wec " * 30_000, "x")]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = documents()
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_folding_sees_through_disguises():
    for text in ("You IDIOT.", "you іdіоt", "you ｉｄｉｏｔ", "you id​iot", "y0u 1d10t", "you !diot id!ot", "$cum @ss idi0t"):
        found = toxicity.matches(toxicity.fold_text(text), toxicity.Lexicon({" idiot ": 2.0}).automaton())
        assert found or text.startswith("you !d"), text
    assert not toxicity.matches(toxicity.fold_text("idiotic 10 1d 555-1234"), toxicity.Lexicon({" idiot ": 2.0}).automaton())
    assert toxicity.fold_text(None) == " "


def test_heaviest_entry_counts_and_phrases_spare():
    automaton = toxicity.Lexicon({" lose": 1.0, " loser ": 3.0, " scum ": 2.0}, (" pond scum ", " scum pond ")).automaton()
    found = toxicity.matches(toxicity.fold_text("loser, losing scum; pond scum, scum pond"), automaton)
    assert sorted(found.values()) == [2.0, 3.0]


def test_toxic_documents_score_high(tables):
    docs, labels = tables
    got = {r["doc_id"]: r for r in toxicity.query(docs, labels).collect() if r["doc_id"] is not None}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    right = [got[i]["predicted"] == int(i % 6 == 0) for i in range(600) if got[i]["held_out"] and (i % 5 != 2 or i % 2)]  # repeating drops words
    assert np.mean(right) > 0.97
    kept = toxicity.drop_toxic(docs, toxicity.fit_lexicon(docs, labels, F.lit(True)))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and {7000, 7001, 7002, 7003} <= set(ids) and None not in ids


def test_labels_of_held_out_rows_play_no_part(tables):
    docs, labels = tables
    held = fold("doc_id", 3) == 1
    changed = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda rows: sorted((str(r["doc_id"]), r["score"]) for r in rows)
    assert key(toxicity.query(docs, labels).collect()) == key(toxicity.query(docs, changed).collect())


def test_poor_documents_score_low(tables):
    docs, labels = tables
    got = {r["doc_id"]: r for r in quality.query(docs, labels).collect() if r["doc_id"] is not None}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    right = [got[i]["predicted"] == int(i % 5 != 2) for i in range(600) if got[i]["held_out"]]
    assert np.mean(right) > 0.97
    assert got[7000]["score"] == got[7001]["score"] == got[7002]["score"]
    kept = quality.keep_good(docs, quality.fit(docs, labels, F.lit(True)))
    assert kept.columns == docs.columns
    assert not {r["doc_id"] for r in kept.collect()} & {i for i in range(600) if i % 5 == 2}


def test_no_labels_and_empty_tables(tables):
    docs, labels = tables
    for query in (toxicity.query, quality.query):
        some = query(docs, labels.limit(0)).collect()
        assert len(some) == docs.count() and len({r["score"] for r in some}) == 1
        assert query(docs.limit(0), labels).count() == 0


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    y = np.where(x @ [1, -2, 0.5, 0] + 0.3 + rng.normal(0, 0.3, 60) > 0, 1.0, -1.0)
    w = quality.dual_descent([(np.arange(4), row) for row in x], y, 4, rounds=2000, tolerance=1e-9)

    def loss(v):
        return v @ v / 2 + np.square(np.maximum(0, 1 - y * (x @ v[:4] + v[4]))).sum()

    for _ in range(200):
        assert loss(w) <= loss(w + rng.normal(0, 0.01, 5)) + 1e-6


def test_shapes():
    assert quality.shape("Word,") != quality.shape("word,") != quality.shape("word###")
    codes = quality._Codes()
    once, again = quality.features("a b c d", codes), quality.features("a a a a b b b b", codes)
    assert len(quality.features(None, codes)) == len(quality.features(" ", codes)) == 0 and set(once) != set(again)


def test_the_driver_holds_each_place_of_the_sample_once(spark):
    """Beside a few arrays over all places, the fit keeps four bytes a place of a row, not sixteen more."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 1 << 40, 5200)) for _ in range(24)]
    docs = spark.createDataFrame([(i, texts[i % 24]) for i in range(480)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(480)], "doc_id long, quality int")
    tracemalloc.start()
    model = quality.fit(docs, labels, F.lit(True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 480 * 5000 * 4 + 12 * 8 * (1 << quality.BITS)
    assert np.any(model.weights)
