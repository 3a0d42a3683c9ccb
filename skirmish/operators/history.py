"""Strictly-prior history: what a team had done before a moment, never at it.

Entries with the same time do not see each other: frames are ranges over time that end one microsecond before. Keys may be
hot: totals and lists come from ``prefix``, which cuts a key's rows at common moments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY, days, smoothed
from . import prefix


def prior(*keys: str, since: int | None = None):
    """The frame of all entries of a key before the moment, or of those since so many microseconds before it."""
    w = Window.partitionBy(*keys).orderBy("t")
    return w.rangeBetween(Window.unboundedPreceding if since is None else -since, -1)


def _field(name: str):
    return lambda e: e[name].cast("double")


def last_n(rows: DataFrame, n: Sequence[int], values: Sequence[str], keys: Sequence[str] = ("team",), where: Column | None = None, at: Sequence[float] | None = None, state: DataFrame | None = None) -> DataFrame:
    """``<value>_last_<n>``: mean of the last n entries strictly before each row, null without any. ``state`` (keys, tail): the last
    entries (match_id, values) of each key before all rows, from states.Tails.

    Of all entries of one key and time only the last max(n) by match_id form its batch (Spark drops the others before they
    are shuffled), and a row gathers at most max(n) entries: the lists are bounded however long a history, a moment or a key is.
    """
    most = max(n)
    at = prefix.cuts(rows, keys=keys) if at is None else at
    entry = F.struct("match_id", *values)
    some = rows if where is None else rows.where(where)
    newest = F.row_number().over(Window.partitionBy(*keys, "t").orderBy(F.desc("match_id"), *[F.desc(v) for v in values]))
    batches = some.withColumn("__k", newest).where(F.col("__k") <= most).groupBy(*keys, "t").agg(F.array_sort(F.collect_list(entry)).alias("batch"))
    if where is not None:
        # moments without an entry ask too
        asks = rows.select(*keys, "t", F.array().cast(batches.schema["batch"].dataType).alias("batch"))
        batches = batches.unionByName(asks).groupBy(*keys, "t").agg(F.flatten(F.collect_set("batch")).alias("batch"))
    asked = prefix.tails(batches, keys, most, at=at)
    if state is not None:
        older = F.transform(F.coalesce("tail", F.array().cast(state.schema["tail"].dataType)), lambda e: F.struct(*[e[c].alias(c) for c in ("match_id", *values)]))
        asked = asked.join(state.select(*keys, "tail"), list(keys), "left")
        asked = asked.withColumn("recent", F.slice(F.concat(older, "recent"), F.greatest(F.size(older) + F.size("recent") - most + 1, F.lit(1)), most)).drop("tail")
    cols = []
    for k in n:
        tail = F.slice("recent", F.greatest(F.size("recent") - k + 1, F.lit(1)), k)
        for v in values:
            total = F.aggregate(F.transform(tail, _field(v)), F.lit(0.0), lambda acc, x: acc + x)
            cols.append(F.when(F.size(tail) > 0, total / F.size(tail)).alias(f"{v}_last_{k}"))
    return rows.join(asked.select(*keys, "t", *cols), [*keys, "t"])


def prior_counts(rows: DataFrame, at: Sequence[float] | None = None) -> DataFrame:
    """n, wins, smoothed rate, rate in the same format, matches of the last 30 days and days since the last one."""
    at = prefix.cuts(rows, keys=["team"]) if at is None else at
    one = F.lit(1).cast("long")
    rows = prefix.prior(rows, ["team"], {"n_before": one, "wins_before": F.col("win")}, {"last_t": F.col("t")}, at=at)
    rows = prefix.counted_since(rows, ["team"], 30 * DAY, "n_30d", at=at)
    rows = prefix.prior(rows, ["team", "best_of"], {"format_n": one, "format_wins": F.col("win")}, at=at)
    return rates(rows.fillna(0, ["n_before", "wins_before", "format_n", "format_wins"]))


def rates(rows: DataFrame) -> DataFrame:
    """Smoothed rates and the days since the last entry, from counts."""
    return rows.withColumns(
        {
            "win_rate": smoothed(F.col("wins_before"), F.col("n_before")),
            "format_win_rate": smoothed(F.col("format_wins"), F.col("format_n")),
            "days_since_last": days(F.col("t") - F.col("last_t")),
        }
    )


def decayed(rows: DataFrame, half_life_days: float, values: Sequence[str], keys: Sequence[str] = ("team",), name: str = "tw", where: Column | None = None, at: Sequence[float] | None = None, state: DataFrame | None = None) -> DataFrame:
    """``<name>_mass`` and means ``<name>_<value>`` of prior entries with weight 0.5 ** (age / half-life).

    0.5 ** ((T - t) / h) is 2 ** (t / h) by 2 ** (T / h): prior sums of 2 ** (t / h) need no join. Times count from 2000,
    so doubles hold them for centuries.
    """
    h = half_life_days * DAY
    grow = F.pow(F.lit(2.0), (F.col("t") - 946_684_800_000_000) / h)
    weight = grow if where is None else F.when(where, grow).otherwise(0.0)
    made = prefix.prior(rows, keys, {"__mass": weight, **{f"__{v}": weight * F.col(v) for v in values}}, at=at)
    if state is not None:  # (keys, mass, values): the same sums of all entries before the rows, from states.Decayed
        held = state.select(*keys, *[F.col(c).alias(f"__0{c}") for c in ("mass", *values)])
        made = made.join(held, list(keys), "left").withColumns({f"__{c}": prefix.added(F.col(f"__{c}"), F.col(f"__0{c}")) for c in ("mass", *values)}).drop(*[f"__0{c}" for c in ("mass", *values)])
    mass = F.coalesce("__mass", F.lit(0.0))
    out = {f"{name}_mass": mass / grow}
    out |= {f"{name}_{v}": F.when(mass > 0, F.col(f"__{v}") / mass) for v in values}
    return made.withColumns(out).drop("__mass", *[f"__{v}" for v in values])


SERIES = ["win_rate", "win_last_5", "win_last_10", "format_win_rate", "margin_last_5", "margin_last_10", "n_30d", "days_since_last", "n_before"]

NEUTRAL = {c: 0.5 for c in ("win_last_5", "win_last_10")} | {c: 0.0 for c in ("margin_last_5", "margin_last_10")}


def series_features(rows: DataFrame) -> DataFrame:
    """Per side: everything the series features need but ratings, with neutral values where history lacks."""
    at = prefix.cuts(rows, keys=["team"])
    made = last_n(prior_counts(rows, at), (5, 10), ("win", "margin"), at=at)
    return made.fillna(NEUTRAL)
