import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from linkweave.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load(PATH).ranks, special_tokens={})


def odd_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcehorst é日本\n\t 0'9!ß") for _ in range(rng.randrange(200))) for _ in range(200)]
    return [*texts, "", None, "a" * 3000, "ab" * 500 + " " * 700, "<|endoftext|> don't  stop", "  x\r\n\r\n", "👍🏽" * 40, "日本語" * 300]


def test_same_ids_as_the_library(reference):
    texts = odd_texts()
    encoder = bpe.Encoder(bpe.load(PATH), P.PATTERN)
    for text, packed in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text or "")
        assert encoder.vocabulary.decode(packed) == (text or "").encode()


def test_leftmost_of_equal_ranks_first():
    vocabulary = bpe.Vocabulary({bytes([i]): i for i in range(256)} | {b"aa": 256, b"aab": 257, b"aaaa": 258})
    assert [x.tolist() for x in vocabulary.merge([b"aaa", b"aaab", b"aaaaa", b"b"])] == [[256, 97], [256, 97, 98], [258, 97], [98]]


def test_a_full_cache_starts_anew(monkeypatch, reference):
    monkeypatch.setattr(bpe, "_CACHE_LIMIT", 20)
    encoder = bpe.Encoder(bpe.load(PATH), P.PATTERN)
    for text in odd_texts()[:50]:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text or "")


def test_query_and_round_trip(spark, reference):
    rows = [(i if i % 9 else None, t, f"{i}") for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, ids string").repartition(3)
    got = bpe.digests(docs, PATH, P.PATTERN).collect()
    want = []
    for i, t, _ in rows + rows[:3]:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    encoded = bpe.encode(docs, PATH, P.PATTERN)
    back = bpe.decode(encoded, PATH)
    assert sorted(bytes(r["data"]) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in rows + rows[:3])
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0
