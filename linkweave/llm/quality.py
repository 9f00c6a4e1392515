"""Text quality: naive Bayes log-count ratios as features of a linear support vector machine.

A document's features are indicators of n-grams, hashed to 2^BITS places: its words, and one to three neighbouring
word shapes. A shape says how a token is written (case, digits, what stands before and behind it) and whether it repeats
the token before or the one before that. Each feature is scaled by the log ratio of its smoothed shares in either class,
each document to length one, and the squared hinge loss is minimised by dual coordinate descent. The curve from margin to
probability is fitted on training rows that the machine has not seen.

The fit uses a bounded sample of the labelled rows (`per_class`), reduced to at most `most_features` features a
document by hash; Spark finds the features, counts and descent over this bounded sample run on the driver. All documents
are scored over their whole texts.

Defined cases: null and empty texts have no features and get the score of the bias alone; without labels of both
classes all texts get the prior; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.labelled import fit_logistic, fold, probability, sample
from linkweave.llm.words import texts_of

BITS = 18
_PARTS = re.compile(r"^(\W*)(.*?)([\W_]*)$", re.S)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CACHE_LIMIT = 300_000


def shape(token: str) -> str:
    """How a token is written: before, case, digits, length class, behind."""
    before, core, behind = _PARTS.match(token).groups()
    case = "-" if not core else "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l" if core.islower() else "m"
    digits = "9" if any(c.isdigit() for c in core) else ""
    return f"{before[:2]}{case}{digits}{min(len(core), 30) // 6}{behind[:2]}"


class _Codes(dict):
    """token -> (hash of the lowered word, hash of the shape), forgotten when it grows past a fixed size."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        word = _PARTS.match(token.lower())[2] or token
        self[token] = value = (xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(shape(token)))
        return value


def features(text: str | None, codes: _Codes) -> np.ndarray:
    """Sorted distinct feature places of a text."""
    tokens = text.split() if text else []
    if not tokens:
        return np.empty(0, np.int32)
    both = np.array([codes[t] for t in tokens], np.uint64)
    words, shapes = both[:, 0], both[:, 1]
    again = np.zeros(len(words), np.uint64)
    again[2:][words[2:] == words[:-2]] = 2
    again[1:][words[1:] == words[:-1]] = 1
    shapes = (shapes + again) * _STEP
    found = [words * _STEP]
    grams = shapes
    for n in range(1, 4):
        if n > 1:
            grams = (grams[:-1] ^ (grams[:-1] >> np.uint64(31))) * _STEP + shapes[n - 1 :]
        if not len(grams):
            break
        found.append((grams ^ np.uint64(n)) * _STEP)
    return np.unique(np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Weight of each feature place (its log-count ratio times the machine's weight), its ratio, bias and curve."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    curve: tuple[float, float]

    def scores(self, texts: list, codes: _Codes) -> np.ndarray:
        margins = np.empty(len(texts))
        for i, text in enumerate(texts):
            at = features(text, codes)
            norm = np.sqrt(np.square(self.ratios[at]).sum()) if len(at) else 0.0
            margins[i] = self.weights[at].sum() / norm + self.bias if norm else self.bias
        return probability(self.curve[0] * margins + self.curve[1])


class _Scaled(Sequence):
    """(places, values) of each row, its values of length one. Values are formed when asked for, so that the driver
    holds four bytes a place and no second copy."""

    def __init__(self, places: list[np.ndarray], ratios: np.ndarray):
        self.places, self.ratios = places, ratios
        self.norms = [np.sqrt(np.square(ratios[at]).sum()) for at in places]

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, norm = self.places[i], self.norms[i]
        return at, self.ratios[at] / norm if norm else self.ratios[at]


def dual_descent(rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = 1.0, rounds: int = 30, tolerance: float = 1e-3, seed: int = 0) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss. rows: places and values of each row; y: -1 or 1."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    diagonal = 0.5 / cost
    square = np.array([np.square(v).sum() + 1.0 + diagonal for _, v in rows])
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            gradient = y[i] * (w[at] @ value + w[-1]) - 1 + diagonal * alpha[i]
            projected = min(gradient, 0.0) if alpha[i] == 0 else gradient
            most = max(most, abs(projected))
            if projected:
                new = max(alpha[i] - gradient / square[i], 0.0)
                change = (new - alpha[i]) * y[i]
                w[at] += change * value
                w[-1] += change
                alpha[i] = new
        if most < tolerance:
            break
    return w


def _places(rows: DataFrame, most_features: int) -> DataFrame:
    """(label, part, places) of the sampled rows; a longer list keeps the places of lowest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            for part, texts in texts_of(batch, "text", 64):
                found = [features(t, codes) for t in texts]
                found = [f if len(f) <= most_features else np.sort(f[np.argsort((f.astype(np.uint64) + np.uint64(1)) * _STEP)[:most_features]]) for f in found]
                yield pa.record_batch([part.column("label").cast(pa.int32()), part.column("part").cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["label", "part", "places"])

    return rows.mapInArrow(run, "label int, part int, places array<int>")


def fit(docs: DataFrame, labels: DataFrame, training: Column, label_col: str = "quality", per_class: int = 5000, smoothing: float = 1.0, most_features: int = 5000) -> Model:
    """A model from up to about `per_class` labelled rows of either class."""
    found = sample(docs, labels, label_col, training, per_class)
    rows = _places(found.rows, most_features).toArrow()
    learn, y = rows["part"].to_numpy() < 75, rows["label"].to_numpy()
    if len(set(y[learn])) < 2:
        empty = np.zeros(1 << BITS)
        return Model(empty, empty, 0.0, (0.0, found.prior_shift((1, 1))))
    # views of the batches as they came
    places = [at for chunk in rows["places"].chunks if len(chunk) for at in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1])]
    counts = np.zeros((2, 1 << BITS))
    for at, label, use in zip(places, y, learn, strict=True):
        if use:
            counts[label][at] += 1
    shares = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
    ratios = np.log(shares[1] / shares[0])
    check = ~learn if len(set(y[~learn])) == 2 else learn
    learned, checked = (_Scaled([at for at, use in zip(places, part, strict=True) if use], ratios) for part in (learn, check))
    w = dual_descent(learned, np.where(y[learn] == 1, 1.0, -1.0), 1 << BITS)
    margins = np.array([w[at] @ value + w[-1] for at, value in checked])
    a, b = fit_logistic(margins[:, None], y[check])
    return Model(w[:-1] * ratios, ratios, float(w[-1]), (float(a), float(b) + found.prior_shift(((y[check] == 0).sum(), (y[check] == 1).sum()))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for each row."""
    narrow = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * 2^BITS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            for part, texts in texts_of(batch, "_text"):
                yield pa.record_batch([part.column(0), pa.array(shared.value.scores(texts, codes))], names=[id_col, "score"])

    return narrow.mapInArrow(run, T.StructType([narrow.schema[id_col], T.StructField("score", T.DoubleType())]))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    scored = score(docs, fit(docs, labels, fold("doc_id", 5) != 0))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that score `least` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            for part, texts in texts_of(batch, text_col):
                yield part.filter(pa.array(shared.value.scores(texts, codes) >= least))

    return docs.mapInArrow(run, docs.schema)
