import numpy as np
from pyspark.sql import functions as F

from linkweave.llm import media

RATE = 4410


def tune(seed, notes):
    rng = np.random.default_rng(seed)
    t = np.arange(int(RATE * 0.125)) / RATE
    return np.concatenate([np.sin(2 * np.pi * 220.0 * 2 ** (rng.integers(0, 36) / 12) * t) * 0.4 for _ in range(notes)])


def test_integral_image_filters_equal_plain_sums():
    frames = media.chroma(tune(1, 60), RATE)
    codes = media.fingerprint(frames)
    assert len(codes) == len(frames) - media.SPAN + 1
    for at in (0, 7, len(codes) - 1):
        want = 0
        for kind, width, low, classes in media.FILTERS:
            high = min(12, low + classes)
            middle, half = (low + high) // 2, width // 2
            area = lambda a, b, c, d: frames[at + a : at + b, c:d].sum()  # noqa: E731, B023
            value = [
                lambda: area(0, width, low, middle) - area(0, width, middle, high),
                lambda: area(0, half, low, high) - area(half, width, low, high),
                lambda: area(0, half, low, middle) + area(half, width, middle, high) - area(0, half, middle, high) - area(half, width, low, middle),
                lambda: area(0, width, low, high) - area(0, width, 0, 12) * (high - low) / 12,
            ][kind]() / (width * max(1, high - low))
            want = want << 2 | [0, 1, 3, 2][sum(value > e for e in media.EDGES)]
        assert want == codes[at]


def test_pitch_classes():
    t = np.arange(RATE) / RATE
    for semitone in (0, 3, 7):
        frames = media.chroma(np.sin(2 * np.pi * 440 * 2 ** (semitone / 12) * t), RATE)
        assert set(frames.argmax(axis=1)) == {semitone}
    assert not media.chroma(np.zeros(RATE), RATE).any()


def test_recordings_align_at_their_offset(spark):
    rng = np.random.default_rng(3)
    song = tune(5, 90)
    late = np.concatenate([tune(6, 20), song])  # twenty notes earlier begins something else
    noisy = song + rng.normal(0, 0.02, len(song))
    rows = [(50, song), (1, late), (2, noisy), (3, tune(7, 90)), (4, song), (100, np.zeros(RATE * 8))]
    data = [(i, media.wav(x, RATE), "z") for i, x in rows] + [(5, None, "z"), (6, b"", None), (7, b"RIFFxxxxWAVEnothing", "z"), (None, media.wav(song, RATE), "z"), (8, media.wav(song[:500], RATE), "z")]
    table = spark.createDataFrame(data, "id long, media binary, codes string")
    prints = media.fingerprints(table, "id", "media")
    assert {r["id"]: len(r["codes"]) for r in prints.collect()}[5] == 0
    found, members = media.align(prints, F.col("id") % 50 == 0)
    got = {(r["query_class"], r["class"]): r for r in found.collect()}
    assert set(got) == {(4, 1), (4, 2)}  # 50 and 4 are one class, named after 4
    assert got[4, 1]["offset"] == 20 and got[4, 1]["bit_error"] == 0
    assert got[4, 2]["offset"] == 0 and got[4, 2]["bit_error"] < 0.2
    assert {r["id"] for r in members.collect() if r["class"] == 4} == {4, 50}


def test_wav_forms():
    x = np.sin(np.arange(4000) / 7)
    mono, rate = media.samples_of(media.wav(x, 8000))
    assert rate == 8000 and np.abs(mono - x).max() < 1e-3
    assert len(media.samples_of(media.wav(x, 8000)[:30])[0]) == 0
    assert len(media.samples_of(media.wav(x, 8000)[:101])[0]) == 28


def test_empty_table_and_missing_components(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert media.query(empty).count() == 0
    odd = spark.createDataFrame([(0, None), (50, [0.1, None, float("nan")] * 20), (None, [0.5] * 60), (50, [])], "vec_id long, embedding array<float>")
    got = media.query(odd).collect()
    assert sorted((r["vec_id"] is None, r["n_codes"] > 0) for r in got) == [(False, False), (False, False), (False, True), (True, True)]


def test_passages_between_different_parts_align(spark):
    shared, second, silence = tune(12, 60), tune(21, 50), np.zeros(int(RATE * 0.125) * 80)
    rows = [
        (50, [tune(11, 80), shared, tune(13, 80), silence, second]),
        (1, [tune(14, 120), shared, tune(15, 40)]),  # less than half of the overlap is shared
        (2, [silence, tune(16, 30), shared, tune(17, 90)]),  # silence has more positions than the passage
        (3, [second, tune(18, 40), shared]),  # two passages at two offsets
        (4, [tune(19, 200)]),
    ]
    table = spark.createDataFrame([(i, media.wav(np.concatenate(x), RATE)) for i, x in rows], "id long, media binary")
    found, _ = media.align(media.fingerprints(table, "id", "media"), F.col("id") == 50)
    got = {(r["class"], r["offset"]): r for r in found.collect()}
    assert {(1, 40), (2, 30), (3, 10), (3, -300)} <= set(got) and 4 not in {c for c, _ in got}
    assert all(got[at]["overlap"] >= 33 and got[at]["bit_error"] <= 0.25 for at in [(1, 40), (2, 30), (3, 10), (3, -300)])


def test_stretches_equal_plain_search():
    rng = np.random.default_rng(8)
    for _ in range(60):
        x = rng.integers(0, 33, rng.integers(0, 40)) // rng.integers(1, 4)
        ok = any(x[i:j].mean() <= 8 for i in range(len(x)) for j in range(i + 5, len(x) + 1))
        got = media.stretches(x, 5, 0.25)
        assert bool(got) == ok
        assert all(e - b >= 5 and x[b:e].mean() <= 8 for b, e in got) and all(a[1] <= b[0] for a, b in zip(got, got[1:]))
