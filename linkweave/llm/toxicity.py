"""Toxicity from a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding lowers case, undoes compatibility forms, maps look-alike letters of other scripts to Latin ones and digits
to the letters they stand for, and turns everything between words into spaces. The digit 1 may stand for i or l; it
stays, and entries with i or l are also matched with 1 in their place. Entries are words or beginnings of words, with
weights: log ratios of the shares of toxic and other training documents that hold them. Each word counts with the
heaviest entry that it matches, unless it lies in an exception phrase: a neighbouring word pair around a match that
occurs in other documents rather than in toxic ones. A document's sum of weights, alone and per hundred words, goes
through a logistic curve fitted on training rows that the lexicon has not seen.

The fit uses a bounded sample of the labelled rows (`per_class`); all documents are scored over their whole texts.

Defined cases: null and empty texts have no matches and get the score of a text without any; without toxic labels the
lexicon is empty and all texts get the prior; rows are scored one by one, so repeated rows get equal scores; an empty
table gives an empty result. Other columns are passed through or ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm.labelled import fit_logistic, fold, probability, sample
from linkweave.llm.words import texts_of

# Letters of other scripts that look like the Latin letters below them, digits and the letters they stand for.
LOOKALIKES = "аеорсухіјѕԁһԛԝкмнтвгαοεικνρτυχηωβ"
LATIN_FORM = "aeopcyxijsdhqwkmhtbraoeikvptuxnwb"
DIGITS, LETTERS = "0345678", "oeasgtb"
HIDDEN = "­​‌‍⁠﻿"
_FOLD = {ord(a): b for a, b in zip(LOOKALIKES + DIGITS, LATIN_FORM + LETTERS, strict=True)} | {ord(c): None for c in HIDDEN}
_FOLD |= {c: " " for c in range(0x250) if not chr(c).isalnum() and c != 0xAD} | {c: " " for c in range(0x2010, 0x2060) if c not in _FOLD}
_SIGNS = {"$": "s", "@": "a", "!": "i", "|": "l"}
_SIGN = re.compile(r"[$@](?=[^\W\d_])|(?<=[^\W\d_])[!|](?=[^\W\d_])")

PREFIXES = range(3, 13)
MOST_ENTRIES, MOST_PHRASES = 2000, 2000


def fold_text(text: str | None) -> str:
    """The text as the lexicon sees it, between two spaces."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "$" in text or "@" in text or "!" in text or "|" in text:
        text = _SIGN.sub(lambda m: _SIGNS[m[0]], text)
    return f" {text.lower().translate(_FOLD)} "


def _spellings(entry: str) -> list[str]:
    at = [i for i, c in enumerate(entry) if c in "il"]
    choices = product(*[(False, True)] * len(at)) if len(at) <= 4 else [[False] * len(at), [True] * len(at)]
    out = []
    for chosen in choices:
        letters = list(entry)
        for i, digit in zip(at, chosen, strict=True):
            letters[i] = "1" if digit else letters[i]
        out.append("".join(letters))
    return out


@dataclass(frozen=True)
class Lexicon:
    """Entries begin with a space, and end with one where they are whole words; phrases are two words between spaces."""

    weights: dict[str, float] = field(default_factory=dict)
    phrases: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            for spelling in _spellings(entry):
                if spelling not in found or found.get(spelling)[1] < weight:
                    found.add_word(spelling, (len(spelling), weight))
        for phrase in self.phrases:
            for spelling in _spellings(phrase):
                found.add_word(spelling, (len(spelling), None))
        found.make_automaton()
        return found

    def logit(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return a * np.log1p(total) + b * np.log1p(100 * total / np.maximum(words, 1)) + c


def matches(folded: str, automaton) -> dict[int, float]:
    """Start of each matching word -> weight of its heaviest entry, without words inside exception phrases."""
    if automaton is None:
        return {}
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if spared:
        best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
    return best


def _counted(rows: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(entry, ones, zeros): training documents of either label that hold an entry or a phrase around a match."""

    def entries(folded: str, automaton) -> set[str]:
        if automaton is None:
            out = set()
            for w in set(folded.split()):
                out.update(f" {w[:k]}" for k in PREFIXES if k <= len(w))
                out.add(f" {w} ")
            return out
        out = set()
        for at in matches(folded, automaton):
            word, *rest = folded[at : at + 200].split(None, 2)[:2]
            before = folded[max(0, at - 100) : at].split()[-1:]
            out.update(f" {word} {x} " for x in rest)
            out.update(f" {x} {word} " for x in before)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton() if lexicon else None
        counts = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            out = pa.record_batch([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["entry", "ones", "zeros"])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for part, texts in texts_of(batch, "text", 64):
                for text, label in zip(texts, part.column("label").to_pylist(), strict=True):
                    counts[label].update(entries(fold_text(text), automaton))
                if len(counts[0]) + len(counts[1]) > 200_000:
                    yield flush()
        yield flush()

    found = rows.mapInArrow(run, "entry string, ones long, zeros long")
    return found.groupBy("entry").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def _totals(rows: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """`keep` of each row, and the sum of its weights and its number of words."""
    schema = T.StructType([f for f in rows.schema.fields if f.name in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for part, texts in texts_of(batch, "text"):
                folded = [fold_text(t) for t in texts]
                total = [sum(matches(t, automaton).values()) for t in folded]
                words = [len(t.split()) for t in folded]
                columns = [part.column(c) for c in schema.names] + [pa.array(total, pa.float64()), pa.array(words, pa.int64())]
                yield pa.record_batch(columns, names=[*schema.names, "_total", "_words"])

    out = T.StructType([*schema.fields, T.StructField("_total", T.DoubleType()), T.StructField("_words", T.LongType())])
    return rows.select(*schema.names, *[c for c in ["text"] if c not in schema.names]).mapInArrow(run, out)


def _most_specific(entries: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights without the beginnings that hardly occur but as beginnings of one longer entry."""
    needless = {e[:k] for e, (ones, _) in entries.items() for k in range(2, len(e)) if e[:k] in entries and ones >= 0.9 * entries[e[:k]][0]}
    return {e: weight for e, (_, weight) in entries.items() if e not in needless}


def fit_lexicon(
    docs: DataFrame, labels: DataFrame, training: Column, label_col: str = "toxic", per_class: int = 6000, least_docs: int = 5, least_ratio: float = 8.0, least_evidence: float = 20.0
) -> Lexicon:
    """Entries held by at least `least_docs` toxic documents and `least_ratio` times the share of others, by more than chance:
    twice the log-likelihood ratio against equal shares is at least `least_evidence`."""
    found = sample(docs, labels, label_col, training, per_class)
    learn, check = found.rows.filter("part < 80"), found.rows.filter("part >= 80")
    n = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
    ones, zeros = n.get(1, 0), n.get(0, 0)
    if not ones:
        return Lexicon(curve=(0.0, 0.0, found.prior_shift((1, 1))))
    weight = F.log((F.col("ones") + 0.5) / (ones + 1)) - F.log((F.col("zeros") + 0.5) / (zeros + 1))
    expected = (F.col("ones") + F.col("zeros")) * F.lit(ones / (ones + zeros))
    others = (F.col("ones") + F.col("zeros")) * F.lit(zeros / (ones + zeros))
    rest = F.when(F.col("zeros") > 0, F.col("zeros") * F.log(F.col("zeros") / others)).otherwise(0.0)
    entries = _counted(learn).filter(F.col("ones") >= least_docs).withColumn("weight", weight).filter(F.col("weight") >= float(np.log(least_ratio)))
    entries = entries.filter(2 * (F.col("ones") * F.log(F.col("ones") / expected) + rest) >= least_evidence)
    rows = entries.orderBy(F.desc(F.col("ones") * F.col("weight")), "entry").limit(MOST_ENTRIES).collect()
    lexicon = Lexicon(_most_specific({r["entry"]: (r["ones"], round(r["weight"], 4)) for r in rows}))
    if not rows:
        return Lexicon(curve=(0.0, 0.0, found.prior_shift((1, 1))))
    harmless = _counted(learn, lexicon).filter((F.col("zeros") >= 3) & (F.col("ones") / ones < F.col("zeros") / zeros))
    phrases = tuple(r["entry"] for r in harmless.orderBy(F.desc("zeros"), "entry").limit(MOST_PHRASES).collect())
    lexicon = Lexicon(lexicon.weights, phrases)
    seen = _totals(check, lexicon, ["label"]).toPandas()
    y, total, words = seen["label"].to_numpy(float), seen["_total"].to_numpy(float), seen["_words"].to_numpy(float)
    a, b, c = fit_logistic(np.column_stack([np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))]), y)
    return Lexicon(lexicon.weights, phrases, (float(a), float(b), float(c) + found.prior_shift(((y == 0).sum(), (y == 1).sum()))))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, total, words) for each row."""
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    a, b, c = lexicon.curve
    rate = F.log1p(100 * F.col("_total") / F.greatest("_words", F.lit(1)))
    logit = F.lit(a) * F.log1p("_total") + F.lit(b) * rate + F.lit(c)
    return _totals(narrow, lexicon, ["_id"]).select(
        F.col("_id").alias(id_col), (1 / (1 + F.exp(-logit))).alias("score"), F.col("_total").alias("total"), F.col("_words").alias("words")
    )


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    scored = score(docs, fit_lexicon(docs, labels, fold("doc_id", 3) != 1))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents that score below `least`, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for part, texts in texts_of(batch, text_col):
                folded = [fold_text(t) for t in texts]
                total = np.array([sum(matches(t, automaton).values()) for t in folded])
                words = np.array([len(t.split()) for t in folded])
                yield part.filter(pa.array(probability(lexicon.logit(total, words)) < least))

    return docs.mapInArrow(run, docs.schema)
