"""Exact quantiles of large columns, several at once.

A percentile aggregate gathers a column's whole distribution in one task. Here every wanted rank is closed in on: approximate
quantiles propose a bracket of values around it, exact counts say which part of the column lies below and inside, and the
bracket shrinks until it holds few rows or a single value. Each step is two aggregations over the table for all columns and ranks
together; what comes to the driver are counts, and in the end the few distinct values around each rank.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows in a bracket from which its values are read; accuracy of the proposals.
FEW, ACCURACY = 50_000, 10_000


def number(c: str) -> Column:
    """A column as doubles, NaN as null: missing values have no rank."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def ranks(n: int, q: float) -> tuple[int, int, float]:
    """The two ranks (from 0) around a quantile and the share of the way from the first to the second."""
    at = (n - 1) * q
    low = min(math.floor(at), n - 1)
    return low, min(low + 1, n - 1), at - low


def quantiles(rows: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[tuple[str, float], float | None]:
    """{(column, q): exact quantile by linear interpolation, None for a column without values}."""
    columns = list(wanted)
    if not columns:
        return {}
    first = rows.agg(*[f(number(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    total = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    # (column, rank) -> [low, high, rows below low, rows inside]
    open_: dict[tuple[str, int], list] = {}
    for i, c in enumerate(columns):
        for q in wanted[c] if total[c] else ():
            for r in ranks(total[c], q)[:2]:
                open_[c, r] = [first[f"a{i}"], first[f"b{i}"], 0, total[c]]
    while wide := [k for k, (low, high, _, inside) in open_.items() if inside > FEW and low < high]:
        near = 2.0 / ACCURACY
        asks = []
        for i, (c, r) in enumerate(wide):
            low, high, below, inside = open_[c, r]
            at, x = (r - below + 0.5) / inside, number(c)
            asks.append(F.percentile_approx(F.when(x.between(low, high), x), [max(0.0, at - near), min(1.0, at + near)], ACCURACY).alias(f"q{i}"))
        proposed = rows.agg(*asks).first()
        counts = []
        for i, (c, _) in enumerate(wide):
            (low, high, _, _), (a, b), x = open_[wide[i]], proposed[f"q{i}"], number(c)
            inside = x.between(low, high)
            counts += [F.count_if(inside & (x < a)).alias(f"u{i}"), F.count_if(inside & (x >= a) & (x <= b)).alias(f"m{i}"), F.max(F.when(inside & (x < a), x)).alias(f"a{i}"), F.min(F.when(inside & (x > b), x)).alias(f"b{i}")]
        got = rows.agg(*counts).first()
        for i, key in enumerate(wide):
            low, high, below, inside = open_[key]
            a, b = proposed[f"q{i}"]
            under, middle = got[f"u{i}"], got[f"m{i}"]
            if key[1] < below + under:
                open_[key] = [low, got[f"a{i}"], below, under]
            elif key[1] < below + under + middle:
                open_[key] = [a, b, below + under, middle]
            else:
                open_[key] = [got[f"b{i}"], high, below + under + middle, inside - under - middle]
    value = {k: v[0] for k, v in open_.items() if v[0] == v[1]}
    rest = sorted({(c, *open_[c, r][:3]) for c, r in open_ if (c, r) not in value})
    if rest:
        some = [F.when(number(c).between(low, high), F.struct(F.lit(i).alias("i"), number(c).alias("x"))) for i, (c, low, high, _) in enumerate(rest)]
        each = rows.select(F.explode(F.array_compact(F.array(*some))).alias("s")).groupBy("s.i", "s.x").agg(F.count("*").alias("n"))
        held: dict[int, list[tuple[float, int]]] = {}
        for r in each.collect():  # at most FEW values a bracket
            held.setdefault(r["i"], []).append((r["x"], r["n"]))
        for i, (c, low, high, below) in enumerate(rest):
            at = below
            for x, n in sorted(held[i]):
                for key in open_:
                    if key[0] == c and open_[key][:2] == [low, high] and at <= key[1] < at + n:
                        value[key] = x
                at += n
    out: dict[tuple[str, float], float | None] = {}
    for c in columns:
        for q in wanted[c]:
            if not total[c]:
                out[c, q] = None
                continue
            a, b, part = ranks(total[c], q)
            out[c, q] = value[c, a] + (value[c, b] - value[c, a]) * part
    return out


def medians(rows: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    got = quantiles(rows, {c: [0.5] for c in columns})
    return {c: got[c, 0.5] for c in columns}
