"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_even(x: str | Column, places: int) -> Column:
    """Half-even rounding by multiply, round to integer, divide. Values are first settled to nine places,
    so a sum that lands on a tie rounds the same way in whatever order it was added up."""
    x = F.col(x) if isinstance(x, str) else x
    if places <= 6:
        x = F.rint(x * 1e9) / 1e9
    return F.rint(x * float(10**places)) / float(10**places)


def canonical_pair(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Store an undirected pair with the larger id first."""
    return df.withColumns({a: F.greatest(a, b), b: F.least(a, b)})


def canonical_directed(df: DataFrame, a: str = "a", b: str = "b", direction: str = "direction") -> DataFrame:
    """Larger id first; turning a pair round turns A->B (2) into B->A (3) and back."""
    swap = F.col(a) < F.col(b)
    turned = F.when(F.col(direction) == 2, 3).when(F.col(direction) == 3, 2).otherwise(F.col(direction))
    return df.withColumns(
        {a: F.greatest(a, b), b: F.least(a, b), direction: F.when(swap, turned).otherwise(F.col(direction)).cast("int")}
    )


def drop_self(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return df.filter(F.col(a) != F.col(b))


def extract_accession(*cols: str | Column, prefix: str = "uniprotkb:", cut_isoform: bool = False) -> Column:
    """First `prefix`-tagged accession found, looking through the columns in order of priority."""
    pattern = prefix + (r"([^|\-]+)" if cut_isoform else r"([^|]+)")
    return F.coalesce(*[F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")) for c in cols])


def clean_method(col: str | Column) -> Column:
    """`psi-mi:"MI:0018"(two hybrid)` -> `MI:0018`; a missing method becomes the unspecified term."""
    term = F.regexp_replace(F.element_at(F.split(col, r"\("), 1), 'psi-mi:|"', "")
    return F.when(term == "-", F.lit("MI:0000")).otherwise(term)


def last_of_list(col: str | Column, sep: str = r"\|") -> Column:
    return F.element_at(F.split(col, sep), -1)


def polynomial(coefficients: str | Column, x: str | Column, most_degree: int = 3) -> Column:
    """Horner value of a polynomial of at most `most_degree`, coefficients as an array, highest degree first.
    Spelled out per place, so that it stays in generated code."""
    x = F.col(x) if isinstance(x, str) else x
    c = F.col(coefficients) if isinstance(coefficients, str) else coefficients
    value = F.lit(0.0)
    for place in range(most_degree + 1, 0, -1):  # counted from the end: missing high degrees are zero
        value = value * x + F.coalesce(F.try_element_at(c, F.lit(-place)), F.lit(0.0))
    return F.when(c.isNotNull(), value)


def clip(x: str | Column, lo: str | Column, hi: str | Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def logistic(x: Column, a: Column, b: Column, c: Column) -> Column:
    return a / (F.lit(1.0) + F.exp(-b * (x - c)))


def ppv_of_fbs(fbs: Column, a: Column, b: Column, c: Column, lo: float = 0.5) -> Column:
    """Confidence of a score: negatives count as 0, logistic, clipped to [lo, 1], 3 places; no model gives 0."""
    value = half_even(clip(logistic(F.greatest(fbs, F.lit(0.0)), a, b, c), F.lit(lo), F.lit(1.0)), 3)
    # least and greatest skip NULL, so a missing model has to be asked for
    return F.when(a.isNull(), F.lit(0.0)).otherwise(value)


def scientific(col: str | Column) -> Column:
    return F.format_string("%.2e", col)


def genes_of_text(text: str | Column) -> Column:
    """Gene names typed by a user, separated by commas or white space, without empty ones."""
    return F.filter(F.split(F.trim(text), r"[,\s]+"), lambda g: g != "")


def join_flags(flags: Column) -> Column:
    """One digit per gold standard, e.g. `010000`."""
    return F.array_join(F.transform(flags, lambda f: f.cast("string")), "")


def compact_species_name(name: str | Column) -> Column:
    """`Homo sapiens (Human)` -> `H.sapiens`."""
    words = F.split(F.element_at(F.split(name, r" \("), 1), " ")
    return F.concat(F.substring(F.element_at(words, 1), 1, 1), F.lit("."), F.element_at(words, -1))
