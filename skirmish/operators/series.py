"""Best-of-N arithmetic: a series from the probabilities of its maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fix(p: Column, slot: int, value: float) -> Column:
    return F.transform(p, lambda x, i: F.when(i == slot, F.lit(value)).otherwise(x))


def states(p: Column) -> Column:
    """After all maps of an array: an array of P(win the series), by the number of wins needed.

    The accumulator holds the probability of each number of wins among the maps so far; a series that is decided early
    has the same winner as one played to the end, so the end alone counts.
    """
    n = F.size(p)
    start = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, 1.0).otherwise(0.0))

    def step(acc: Column, x: Column) -> Column:
        return F.transform(acc, lambda v, i: v * (1 - x) + F.when(i > 0, F.try_element_at(acc, F.greatest(i, F.lit(1)))).otherwise(0.0) * x)

    return F.aggregate(p, start, step)


def win_probability(p: Column) -> Column:
    """P(more than half of the maps are won), for 1, 3 or 5 probabilities in [0, 1]; null otherwise."""
    ok = F.size(p).isin(1, 3, 5) & F.forall(p, lambda x: x.isNotNull() & x.between(0.0, 1.0))
    need = (F.size(p) / 2).cast("int") + 1
    return F.when(ok, F.aggregate(F.slice(states(p), need + 1, F.size(p)), F.lit(0.0), lambda acc, v: acc + v))


def reach_probability(p: Column, slot: int) -> Column:
    """P(map ``slot``, from 0, is played): neither side has won enough of the maps before it."""
    need = (F.size(p) / 2).cast("int") + 1
    before = states(F.slice(p, 1, slot)) if slot else F.array(F.lit(1.0))
    return F.aggregate(F.transform(before, lambda v, i: F.when((i < need) & (F.lit(slot) - i < need), v).otherwise(0.0)), F.lit(0.0), lambda acc, v: acc + v)


def leverage(p: Column, slot: int) -> Column:
    """How much winning map ``slot`` for sure, rather than losing it, is worth."""
    return win_probability(_fix(p, slot, 1.0)) - win_probability(_fix(p, slot, 0.0))
