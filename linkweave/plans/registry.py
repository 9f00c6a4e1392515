"""Registered queries over the given tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_VIEWS: dict[str, tuple[list[str], str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(name: str, sql: str, needs: str = "") -> None:
    """A named sub-query that oracle SQL may build on."""
    _VIEWS[name] = (needs.split(), sql)


def with_views(needs: str, body: str) -> str:
    """`body` preceded by the WITH clauses it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for n in _VIEWS[name][0]:
            add(n)
        order.append(name)

    for n in needs.split():
        add(n)
    if not order:
        return body
    clauses = ",\n".join(f"{n} AS ({_VIEWS[n][1]})" for n in order)
    body = body.strip()
    for start, head in (("with recursive ", "WITH RECURSIVE "), ("with ", "WITH ")):
        if body.lower().startswith(start):
            return f"{head}{clauses},\n{body[len(start):]}"
    head = "WITH "
    return f"{head}{clauses}\n{body}"


def settle_rounding(sql: str) -> str:
    """Spell out `round_even(x, n)` as the same arithmetic the operators use."""
    out, rest = "", sql
    while "round_even(" in rest:
        at = rest.index("round_even(")
        start, depth, comma, i = at + len("round_even("), 1, None, at + len("round_even(")
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[i], 0) if rest[i] in "()" else 0
            if rest[i] == "," and depth == 1:
                comma = i
            i += 1
        inner, places = settle_rounding(rest[start:comma]), int(rest[comma + 1 : i - 1])
        if places <= 6:
            inner = f"(ROUND_EVEN(({inner}) * 1e9, 0) / 1e9)"
        out += rest[:at] + f"(ROUND_EVEN(({inner}) * 1e{places}, 0) / 1e{places})"
        rest = rest[i:]
    return out + rest


def query(name: str, sql: str | None = None, needs: str = "") -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = settle_rounding(with_views(needs, sql))
        return fn

    return register
