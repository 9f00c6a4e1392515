"""Scored links to network rows, one pair after the other.

`score_to_llr` and the operators that follow it return long tables, a row per (pair, gold standard, dataset). To form groups from
such a table all its rows must be sorted again at every step. Each of these tables therefore remembers (`Steps`) the scored links it
was made of and the steps taken since. The next operator then starts from the links: they are shuffled and sorted by pair once,
before models and directions multiply them, and all steps run over the rows of a pair while they pass. A task holds a batch of pairs.
A table that was filtered or joined in between, or has other columns, remembers nothing and takes the general way of each operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LINK = ["evidence_id", "type", "tax_id", "a", "b", "score", "direction"]
ROWS = 32_768  # links that a task works on at once
MOST_MODELS = 10_000
_NONE = -(2**40)  # stands for a direction that is NULL
_SHARES = "llr_ev map<string,double>, llr_sp map<string,double>"
_DETAIL = f"direction int, gs string, fbs double, {_SHARES}"


@dataclass(frozen=True)
class Steps:
    """What a long table was made of. `models` are (evidence_id, gs, coefficients, x_min, x_max), `ppv` is {gs: (a, b, c)}."""

    links: DataFrame
    models: tuple
    stage: str = "llr"
    directed: tuple = ()
    weighted: tuple = ()
    alpha: float = 1.0
    types: tuple = ()
    species: tuple = ()
    prune: bool = True
    ppv: tuple = ()
    lo: float = 0.0


def remember(df: DataFrame, steps: Steps | None) -> DataFrame:
    if steps is not None:
        df._pair_steps = steps
    return df


def steps_of(df: DataFrame, stage: str) -> Steps | None:
    """The steps behind `df`, if it is what the operator of `stage` returned."""
    steps = df.__dict__.get("_pair_steps")
    return steps if steps is not None and steps.stage == stage else None


def begin(links: DataFrame, models: DataFrame) -> Steps | None:
    """Steps for links and their usable models, where both have the plain form."""
    kind = dict(links.dtypes)
    plain = {"evidence_id": ("int", "bigint"), "type": ("string",), "tax_id": ("string",), "score": ("double",), "direction": ("int",)}
    ids = ("int", "bigint", "string")
    if set(links.columns) != set(LINK) or len(links.columns) != len(LINK):
        return None
    if any(kind[c] not in v for c, v in plain.items()) or kind["a"] not in ids or kind["b"] not in ids:
        return None
    if dict(models.dtypes)["evidence_id"] not in ("int", "bigint"):
        return None
    rows = models.select("evidence_id", "gs", "coefficients", "x_min", "x_max").limit(MOST_MODELS + 1).collect()
    if len(rows) > MOST_MODELS or any(r["x_min"] is None or r["x_max"] is None or r["gs"] is None for r in rows):
        return None
    kept = [(r["evidence_id"], r["gs"], tuple(map(lambda c: 0.0 if c is None else float(c), r["coefficients"]))[-4:], float(r["x_min"]), float(r["x_max"])) for r in rows if r["evidence_id"] is not None]
    finite = all(np.isfinite([*c, lo, hi]).all() for _, _, c, lo, hi in kept)
    return Steps(links.select(*LINK), tuple(kept)) if finite else None


def with_confidence(steps: Steps | None, model: DataFrame, lo: float) -> Steps | None:
    """The step to confidences, if `model` (gs, _a, _b, _c) has one row a gold standard."""
    if steps is None:
        return None
    rows = model.limit(MOST_MODELS + 1).collect()
    named = [r["gs"] for r in rows if r["gs"] is not None]
    if len(rows) > MOST_MODELS or len(set(named)) < len(named):
        return None
    return replace(steps, stage="ppv", ppv=tuple((r["gs"], (r["_a"], r["_b"], r["_c"])) for r in rows if r["gs"] is not None), lo=lo)


def rows_of(steps: Steps, stage: str, columns: list[str]) -> DataFrame:
    """The table that `stage` makes, with its columns in this order."""
    kinds = {f.name: f.dataType for f in steps.links.schema}
    kinds |= {f.name: f.dataType for f in T._parse_datatype_string(f"{_DETAIL}, llr double, wllr double, ppv double, max_ppv double")}
    if stage in ("scored", "best"):
        kinds["gs"] = T._parse_datatype_string(f"array<struct<gs:string,ppv:double,fbs:double,{_SHARES.replace(' map', ':map').replace(', ', ',')}>>")
    ordered = steps.links.repartition("a", "b").sortWithinPartitions("a", "b")
    schema = T.StructType([T.StructField(c, kinds[c]) for c in columns])
    return ordered.mapInArrow(_run(replace(steps, links=None), stage, columns), schema)


def _half_even(x: np.ndarray, places: int) -> np.ndarray:
    return np.rint(np.rint(x * 1e9) / 1e9 * 10.0**places) / 10.0**places


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sums(values: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """Sums from 0 on, one value after the other, of the groups that begin there."""
    group = np.repeat(np.arange(len(begun)), np.diff(np.append(begun, len(values))))
    return np.bincount(group, weights=values, minlength=len(begun))


def _repeated(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the row behind each of its `counts` repeats, and `first` + 0, 1, .. within the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, first[row] + at


def _codes(values: pa.Array) -> tuple[np.ndarray, list]:
    encoded = values.dictionary_encode(null_encoding="encode")
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()


def _run(steps: Steps, stage: str, columns: list[str]) -> Callable:
    gs_names = sorted({m[1] for m in steps.models})
    models = sorted(steps.models, key=lambda m: m[0])
    model_id = np.array([m[0] for m in models], np.int64)
    model_gs = np.array([gs_names.index(m[1]) for m in models], np.int64)
    # from the constant up; missing high degrees are zero
    model_c = np.array([[0.0] * (4 - len(m[2])) + list(m[2]) for m in models], float).reshape(-1, 4)
    model_lo, model_hi = (np.array([m[i] for m in models], float) for i in (3, 4))
    types, species = sorted(steps.types), sorted(steps.species)
    type_of, species_of = ({n: i for i, n in enumerate(names)} for names in (types, species))
    ppv_of = dict(steps.ppv)

    def confidence(fbs: np.ndarray, gs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fbs))
        for i, name in enumerate(gs_names):
            a, b, c = ppv_of.get(name, (None, None, None))
            if a is None:
                continue
            own = gs == i
            if b is None or c is None:
                out[own] = _half_even(np.float64(min(steps.lo, 1.0)), 3)
                continue
            with np.errstate(over="ignore"):
                value = a / (1.0 + np.exp(-b * (np.maximum(fbs[own], 0.0) - c)))
            out[own] = _half_even(np.fmin(np.maximum(value, steps.lo), 1.0), 3)
        return out

    def made(batch: pa.RecordBatch, pair: np.ndarray) -> pa.RecordBatch | None:
        """The rows of `stage` from whole pairs; `pair` numbers them."""
        column = {n: batch.column(n) for n in batch.schema.names}
        tcode, tnames = _codes(column["type"])
        directed = np.array([n in steps.directed for n in tnames], bool)[tcode]
        way = column["direction"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        way = np.where(column["direction"].is_valid().to_numpy(zero_copy_only=False), way, _NONE)
        ways, wcode = np.unique(np.concatenate([way, [0]]), return_inverse=True)
        zero, wcode, n_ways = wcode[-1], wcode[:-1], len(ways)
        evidence = column["evidence_id"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        known = column["evidence_id"].is_valid().to_numpy(zero_copy_only=False)
        first, last = (np.searchsorted(model_id, evidence, side) for side in ("left", "right"))
        n_models = np.where(known, last - first, 0)
        # directions that the directed links of a pair have
        arrows = np.unique((pair * n_ways + wcode)[directed & (n_models > 0) & (way != _NONE)])
        n_arrows = np.bincount(arrows // n_ways, minlength=pair[-1] + 1)
        at_arrow = np.cumsum(n_arrows) - n_arrows
        spread = np.where(directed, 1, np.maximum(n_arrows[pair], 1)) * (n_models > 0)
        link, at = _repeated(np.where(directed, 0, at_arrow[pair]), spread)
        if not len(link):
            return None
        ended = np.append(arrows % n_ways, zero)
        dcode = np.where(directed[link], wcode[link], np.where(n_arrows[pair[link]] > 0, ended[np.minimum(at, len(arrows))], zero))
        row, model = _repeated(first[link], n_models[link])
        link, dcode = link[row], dcode[row]
        score = column["score"].fill_null(float("nan")).to_numpy(zero_copy_only=False)[link]
        none = column["score"].is_null().to_numpy(zero_copy_only=False)[link]
        lo, hi = model_lo[model], model_hi[model]
        x = np.fmin(np.where(none, lo, np.maximum(score, lo)), hi)
        c = model_c[model]
        llr = _half_even(((c[:, 0] * x + c[:, 1]) * x + c[:, 2]) * x + c[:, 3], 3)
        gs, key = model_gs[model], pair[link] * n_ways + dcode
        named = pa.array(gs_names, pa.string())

        def directions(codes: np.ndarray) -> pa.Array:
            values = ways[codes]
            return pa.array(np.where(values == _NONE, 0, values).astype(np.int32), mask=values == _NONE)

        wllr = llr
        if stage != "merged":
            power = np.zeros(len(llr))
            some = np.flatnonzero(np.array([n in steps.weighted for n in tnames], bool)[tcode][link])
            group = (key[some] * len(gs_names) + gs[some]) * len(tnames) + tcode[link[some]]
            order = np.lexsort((evidence[link[some]], -llr[some], group))
            begun = _starts(group[order])
            power[some[order]] = np.arange(len(order)) - np.repeat(begun, np.diff(np.append(begun, len(order))))
            wllr = llr * np.power(steps.alpha, power)
        if stage in ("merged", "integrated"):
            take = pa.array(link)
            out = {n: (lambda n=n: column[n].take(take)) for n in ("evidence_id", "type", "tax_id", "a", "b")}
            out |= {"direction": lambda: directions(dcode), "gs": lambda: named.take(pa.array(gs)), "llr": lambda: pa.array(llr), "wllr": lambda: pa.array(wllr)}
            return pa.RecordBatch.from_arrays([out[n]() for n in columns], columns)

        scode, snames = _codes(column["tax_id"])
        t_at, s_at = np.array([type_of.get(n, -1) for n in tnames]), np.array([species_of.get(n, -1) for n in snames])
        t, s = t_at[tcode[link]], s_at[scode[link]]
        if ((t < 0) | (s < 0)).any():
            i = np.flatnonzero((t < 0) | (s < 0))[0]
            raise ValueError(f"not in the fixed lists: {tnames[tcode[link[i]]]} / {snames[scode[link[i]]]}")
        # sums per (pair, direction, gold standard, type, species), added up in the order in which the long rows would be
        key = (key * len(gs_names) + gs) * len(types) + t
        order = np.lexsort((evidence[link], -llr, key))
        cell, wllr = (key * len(species) + s)[order], wllr[order]
        by_cell = np.argsort(cell, kind="stable")
        begun = _starts(cell[by_cell])
        seen = np.argsort(by_cell[begun])  # cells as they come up
        v, cell = _sums(wllr[by_cell], begun)[seen], cell[by_cell[begun]][seen]
        ev_key = cell // len(species)
        begun = _starts(ev_key)
        ev, ev_key = _half_even(_sums(v, begun), 3), ev_key[begun]
        fbs_key = ev_key // len(types)
        begun = _starts(fbs_key)
        fbs, ev_n, fbs_key = _half_even(_sums(ev, begun), 3), np.diff(np.append(begun, len(ev))), fbs_key[begun]
        sp_key = cell // (len(species) * len(types)) * len(species) + cell % len(species)
        order = np.argsort(sp_key, kind="stable")
        sp_key = sp_key[order]
        begun = _starts(sp_key)
        sp, sp_key = _half_even(_sums(_half_even(v, 3)[order], begun), 3), sp_key[begun]
        sp_n = np.diff(np.append(_starts(sp_key // len(species)), len(sp)))
        at_row = fbs_key // len(gs_names)  # (pair, direction)
        begun = _starts(at_row)
        n_gs = np.diff(np.append(begun, len(at_row)))
        keep = np.ones(len(begun), bool) if not steps.prune else np.maximum.reduceat(fbs, begun) > 0
        gs = fbs_key % len(gs_names)
        ppv = confidence(fbs, gs) if stage in ("ppv", "scored", "best") else np.zeros(len(fbs))
        top = np.maximum.reduceat(ppv, begun)
        row_key = at_row[begun]
        if stage == "best":
            # the highest confidence of a pair, of equal ones the smallest direction
            rank = np.where(ways == _NONE, -np.inf, -ways.astype(float))[row_key % n_ways]
            of_pair = row_key // n_ways
            order = np.lexsort((rank, top, of_pair))
            order = order[keep[order]]
            last_of = np.flatnonzero(np.append(np.diff(of_pair[order]) != 0, True)) if len(order) else order
            keep = np.zeros(len(begun), bool)
            keep[order[last_of]] = True
        chosen = np.repeat(keep, n_gs)
        if not chosen.any():
            return None

        def shares(values: np.ndarray, codes: np.ndarray, n: np.ndarray, names: list[str]) -> pa.Array:
            inside = np.repeat(chosen, n)
            ends = np.concatenate([[0], np.cumsum(n[chosen])]).astype(np.int32)
            return pa.MapArray.from_arrays(pa.array(ends), pa.array(names, pa.string()).take(pa.array(codes[inside])), pa.array(values[inside]))

        first_link = np.zeros(pair[-1] + 1, np.int64)
        first_link[pair[::-1]] = np.arange(len(pair))[::-1]
        detail = {
            "gs": named.take(pa.array(gs[chosen])), "ppv": pa.array(ppv[chosen]), "fbs": pa.array(fbs[chosen]),
            "llr_ev": shares(ev, ev_key % len(types), ev_n, types), "llr_sp": shares(sp, sp_key % len(species), sp_n, species),
        }
        if stage in ("scored", "best"):
            ends = pa.array(np.concatenate([[0], np.cumsum(n_gs[keep])]).astype(np.int32))
            of = row_key[keep]
            out = {"max_ppv": pa.array(top[keep]), "gs": pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(list(detail.values()), list(detail)))}
        else:
            of, out = at_row[chosen], detail
        ids = pa.array(first_link[of // n_ways])
        out |= {"a": column["a"].take(ids), "b": column["b"].take(ids), "direction": directions(of % n_ways)}
        return pa.RecordBatch.from_arrays([out[n] for n in columns], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(rows: pa.Table, whole: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            batch = rows.combine_chunks().to_batches()[0]
            a, b = _codes(batch.column("a"))[0], _codes(batch.column("b"))[0]
            begun = _starts(a, b)
            end = len(a) if whole else int(begun[-1])  # the last pair may go on in the next batch
            pair = np.zeros(len(a), np.int64)
            pair[begun[1:]] = 1
            return (made(batch.slice(0, end), np.cumsum(pair)[:end]) if end and models else None), rows.slice(end)

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                out, rest = finished(pa.Table.from_batches(held), False)
                held, n = rest.to_batches(), 0  # a pair of very many rows is gathered before it is tried again
                if out is not None:
                    yield out
        if held:
            out, _ = finished(pa.Table.from_batches(held), True)
            if out is not None:
                yield out

    return run

