"""Labelled rows for fitting classifiers, and the step from a raw score to a probability."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.session import staged


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


@dataclass(frozen=True)
class Sample:
    """Labelled texts (text, label, part) of which no class has many more than the bound, and how many rows of
    either label there were; part is a hash from 0 to 99 for splitting them."""

    rows: DataFrame
    labelled: tuple[int, int]

    def prior_shift(self, taken: tuple[float, float]) -> float:
        """What the log odds of label 1 differ by between all labelled rows and those taken."""
        zeros, ones = (max(x, 0.5) for x in self.labelled)
        return float(np.log(ones / zeros) - np.log(max(taken[1], 0.5) / max(taken[0], 0.5)))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, training: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> Sample:
    """Up to about `per_class` labelled rows of each class, chosen by a hash of the id among rows where `training`
    (over the id column) holds. Labels other than 0 and 1 and null ids are left out; an id with several labels takes the largest."""
    clean = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & training)
    clean = clean.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in clean.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, per_class / max(counts.get(1, 0), 1))).otherwise(min(1.0, per_class / max(counts.get(0, 0), 1)))
    spot = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("part")), F.lit(100)).cast("int")
    chosen = staged(clean.filter(spot < share).select(F.col(id_col).alias("_id"), "label", part.alias("part")))
    if chosen.count() <= 3 * per_class:  # always, but for ids that repeat a hash; bounds what is broadcast
        chosen = F.broadcast(chosen)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return Sample(staged(texts.join(chosen, "_id").select("text", "label", "part")), (counts.get(0, 0), counts.get(1, 0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (bias last) of a logistic regression by Newton steps; all but the bias are shrunk a little."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    shrink = np.full(len(w), ridge * len(y))
    shrink[-1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (y - p) - shrink * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
