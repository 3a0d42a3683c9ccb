"""What engines know at a moment: states that merge, are written, and are gone on from.

A state is a small table by key. ``of`` makes it from entries, ``merge`` adds the entries of a later part without reading the
first again, and going on from it gives what one pass over everything gives. Engines are bundles of such states.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import DAY
from ..sources import publish
from . import history, prefix, resume


@dataclass(frozen=True)
class Totals:
    """Sums and greatest values, of SQL expressions, of a key's entries."""

    keys: tuple[str, ...]
    sums: Mapping[str, str]
    greatest: Mapping[str, str] = field(default_factory=dict)

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(F.expr(c)).alias(n) for n, c in self.sums.items()], *[F.max(F.expr(c)).alias(n) for n, c in self.greatest.items()])

    def merge(self, state: DataFrame, newer: DataFrame) -> DataFrame:
        both = state.unionByName(newer).groupBy(*self.keys)
        return both.agg(*[F.sum(n).alias(n) for n in self.sums], *[F.max(n).alias(n) for n in self.greatest])

    def before(self, state: DataFrame, later: DataFrame) -> DataFrame:
        """``later`` with the totals strictly before each row, the state's among them; null where there is nothing."""
        own = prefix.prior(later, self.keys, {n: F.expr(c) for n, c in self.sums.items()}, {n: F.expr(c) for n, c in self.greatest.items()})
        held = state.select(*self.keys, *[F.col(n).alias(f"__0{n}") for n in (*self.sums, *self.greatest)])
        both = own.join(held, list(self.keys), "left")
        done = {n: prefix.added(F.col(n), F.col(f"__0{n}")) for n in self.sums} | {n: F.greatest(n, f"__0{n}") for n in self.greatest}
        return both.withColumns(done).drop(*[f"__0{n}" for n in (*self.sums, *self.greatest)])


@dataclass(frozen=True)
class Tails:
    """The last ``most`` entries of a key, oldest first: lists of bounded length."""

    keys: tuple[str, ...]
    values: tuple[str, ...]
    most: int
    where: str | None = None

    def of(self, rows: DataFrame) -> DataFrame:
        rows = rows if self.where is None else rows.where(self.where)
        newest = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("t"), F.desc("match_id")))
        some = rows.select(*self.keys, F.struct("t", "match_id", *self.values).alias("e"), newest.alias("k")).where(F.col("k") <= self.most)
        return some.groupBy(*self.keys).agg(F.array_sort(F.collect_list("e")).alias("tail"))

    def merge(self, state: DataFrame, newer: DataFrame) -> DataFrame:
        both = state.unionByName(newer).groupBy(*self.keys).agg(F.array_sort(F.flatten(F.collect_list("tail"))).alias("tail"))
        return both.withColumn("tail", F.slice("tail", F.greatest(F.size("tail") - self.most + 1, F.lit(1)), self.most))

    def before(self, state: DataFrame, later: DataFrame, n: tuple[int, ...]) -> DataFrame:
        return history.last_n(later, n, self.values, self.keys, None if self.where is None else F.expr(self.where), state=state)


@dataclass(frozen=True)
class Decayed:
    """Sums of 2 ** (t / half-life), and of values with that weight; ratios of them are decayed means at any later moment."""

    keys: tuple[str, ...]
    values: tuple[str, ...]
    half_life: float
    where: str | None = None

    def of(self, rows: DataFrame) -> DataFrame:
        rows = rows if self.where is None else rows.where(self.where)
        grow = F.pow(F.lit(2.0), (F.col("t") - 946_684_800_000_000) / (self.half_life * DAY))
        return rows.groupBy(*self.keys).agg(F.sum(grow).alias("mass"), *[F.sum(grow * F.col(v)).alias(v) for v in self.values])

    def merge(self, state: DataFrame, newer: DataFrame) -> DataFrame:
        return state.unionByName(newer).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in ("mass", *self.values)])

    def before(self, state: DataFrame, later: DataFrame, name: str = "tw") -> DataFrame:
        return history.decayed(later, self.half_life, self.values, self.keys, name, None if self.where is None else F.expr(self.where), state=state)


@dataclass(frozen=True)
class Recent:
    """Entries so new that a look-back of ``span`` from the cut-off or later can still see them."""

    columns: tuple[str, ...]
    span: int

    def of(self, rows: DataFrame, cut: int) -> DataFrame:
        return rows.where(F.col("t") >= cut - self.span).select(*self.columns)

    def merge(self, state: DataFrame, newer: DataFrame, cut: int) -> DataFrame:
        return state.unionByName(newer).where(F.col("t") >= cut - self.span)


TEAM = Totals(("team",), {"n_before": "1L", "wins_before": "win"}, {"last_t": "t"})
FORMAT = Totals(("team", "best_of"), {"format_n": "1L", "format_wins": "win"})
LAST = Tails(("team",), ("win", "margin"), 10)
ACTIVE = Recent(("team", "t"), 30 * DAY)
MAPS = Totals(("team", "map_name"), {"n": "1L", "wins": "win", "margins": "norm_margin"}, {"last_t": "t"})
FORM_LAST = Tails(("team",), ("residual", "opp_mid"), 10, "trusted")
FORM = Decayed(("team",), ("residual",), 60, "trusted")
PLAYERS = Decayed(("player",), ("adr", "kast", "kd", "apr"), 60)
SEEN = Recent(("team", "player", "match_id", "t"), 90 * DAY)
GAMES = Tails(("team",), ("players",), 20)


def series_state(rows: DataFrame, cut: int) -> dict[str, DataFrame]:
    """The series engine after the history entries ``rows``, all before ``cut``."""
    return {"team": TEAM.of(rows), "format": FORMAT.of(rows), "last": LAST.of(rows), "active": ACTIVE.of(rows, cut)}


def series_from(state: Mapping[str, DataFrame], later: DataFrame) -> DataFrame:
    """history.series_features() of the later rows."""
    rows = FORMAT.before(state["format"], TEAM.before(state["team"], later))
    asks = later.select("team", "t", F.lit(True).alias("__later")).unionByName(state["active"].withColumn("__later", F.lit(False)))
    counts = prefix.counted_since(asks, ["team"], ACTIVE.span, "n_30d").where("__later").select("team", "t", "n_30d").distinct()
    rows = rows.join(counts, ["team", "t"]).fillna(0, ["n_before", "wins_before", "format_n", "format_wins"])
    rows = history.rates(rows)
    return LAST.before(state["last"], rows, (5, 10)).fillna(history.NEUTRAL)


def map_state(rows: DataFrame) -> dict[str, DataFrame]:
    """The map engine: what each team has done on each map."""
    return {"maps": MAPS.of(rows)}


def form_state(rated: DataFrame) -> dict[str, DataFrame]:
    """The form engine after rated entries with residuals."""
    return {"last": FORM_LAST.of(rated), "decayed": FORM.of(rated)}


def form_from(state: Mapping[str, DataFrame], later: DataFrame) -> DataFrame:
    return FORM.before(state["decayed"], FORM_LAST.before(state["last"], later, (5, 10)))


def games_of(players: DataFrame) -> DataFrame:
    """(team, match_id, t, players) of each game that a team has played."""
    return players.groupBy("team", "match_id").agg(F.min("t").alias("t"), F.sort_array(F.collect_set("player")).alias("players"))


def roster_state(players: DataFrame, cut: int) -> dict[str, DataFrame]:
    """The roster engine: players' form, who has been seen lately, the last games of each team."""
    return {"players": PLAYERS.of(players), "seen": SEEN.of(players.select(*SEEN.columns).distinct(), cut), "games": GAMES.of(games_of(players))}


def rating_state(rated: DataFrame, *keys: str) -> dict[str, DataFrame]:
    """The ratings after ratings.rate(); it goes on from them by its ``snapshot``."""
    return {"ratings": resume.last_ratings(rated, *keys)}


#: How the states of each name merge; those of Recent need the new cut-off.
MERGES = {"team": TEAM, "format": FORMAT, "last": LAST, "active": ACTIVE, "maps": MAPS, "decayed": FORM, "players": PLAYERS, "seen": SEEN, "games": GAMES}


def merged(state: Mapping[str, DataFrame], newer: Mapping[str, DataFrame], cut: int, kinds: Mapping[str, Totals | Tails | Decayed | Recent] = MERGES) -> dict[str, DataFrame]:
    """The state after a later part, from the states before it and of it alone."""
    return {n: kinds[n].merge(state[n], newer[n], cut) if isinstance(kinds[n], Recent) else kinds[n].merge(state[n], newer[n]) for n in state}


def save(state: Mapping[str, DataFrame], path: str) -> None:
    """One table a state, each put in place of an older one at once."""
    for name, df in state.items():
        publish(df, f"{path}/{name}")


def load(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
