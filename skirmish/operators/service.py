"""Predictions on request: requests are rows, answers are rows with a probability or an error code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expected, pair_key
from .series import leverage, reach_probability, win_probability

#: Error codes in the order in which they are tested.
ERRORS = ["unknown_team", "ambiguous_team", "ineligible_team", "same_team", "invalid_best_of", "unknown_map", "before_context", "stale_context"]


def resolve(requests: DataFrame, teams: DataFrame, column: str) -> DataFrame:
    """Adds <column>_team and <column>_error by exact name (trimmed) or alias; ``teams`` has name, team, eligible.

    A name of several teams is ambiguous. Spark broadcasts the names when they are few and shuffles them otherwise.
    """
    names = teams.groupBy(F.trim("name").alias("__name")).agg(F.count_distinct("team").alias("__n"), F.first("team").alias("__team"), F.bool_and("eligible").alias("__ok"))
    out = requests.join(names, F.trim(column) == F.col("__name"), "left")
    error = F.when(F.col("__n").isNull(), "unknown_team").when(F.col("__n") > 1, "ambiguous_team").when(~F.col("__ok"), "ineligible_team")
    return out.withColumns({f"{column}_team": F.when(error.isNull(), F.col("__team")), f"{column}_error": error}).drop("__name", "__n", "__team", "__ok")


def context_error(asked: Column, cutoff, stale_after_days: int | None = None) -> Column:
    """A context knows what came before its cut-off: earlier moments are refused, late ones are stale."""
    late = F.lit(False) if stale_after_days is None else F.unix_micros(asked.cast("timestamp")) > F.unix_micros(F.lit(cutoff).cast("timestamp")) + stale_after_days * 86_400_000_000
    return F.when(asked < F.lit(cutoff), "before_context").when(late, "stale_context")


def predict_series(requests: DataFrame, teams: DataFrame, ratings: DataFrame, cutoff=None, stale_after_days: int | None = None) -> DataFrame:
    """(request_id, team1, team2, best_of, p, error) for requests with names ``team1``, ``team2``, ``best_of``, ``asked``.

    ``ratings`` (team, rating) is the state at the context's cut-off; teams without one start at 1500.
    """
    rows = resolve(resolve(requests, teams, "team1"), teams, "team2")
    for k in ("team1", "team2"):
        state = ratings.select(F.col("team").alias(f"__{k}"), F.col("rating").alias(f"{k}_rating"))
        rows = rows.join(state, F.col(f"{k}_team") == F.col(f"__{k}"), "left").drop(f"__{k}")
    time = context_error(F.col("asked"), cutoff, stale_after_days) if cutoff is not None else F.lit(None).cast("string")
    error = F.coalesce("team1_error", "team2_error", F.when(F.col("team1_team") == F.col("team2_team"), "same_team"), F.when(~F.coalesce(F.col("best_of").isin(1, 3, 5), F.lit(False)), "invalid_best_of"), time)
    p = expected(F.coalesce("team1_rating", F.lit(1500.0)), F.coalesce("team2_rating", F.lit(1500.0)))
    n = F.when(F.col("best_of").isin(1, 3, 5), F.col("best_of")).otherwise(1)
    return rows.select("request_id", "team1", "team2", "best_of", F.when(error.isNull(), win_probability(F.array_repeat(p, n))).alias("p"), error.alias("error"))


def predict_map(requests: DataFrame, teams: DataFrame, ratings: DataFrame, cutoff=None, stale_after_days: int | None = None) -> DataFrame:
    """(request_id, team1, team2, map_name, p, error) for requests with names ``team1``, ``team2``, ``map_name``, ``asked``.

    ``ratings`` (team, map_name, rating) is the state at the context's cut-off; a team that has not played a known map starts
    at 1500 there. A map that nobody has played, or none, is unknown.
    """
    rows = resolve(resolve(requests, teams, "team1"), teams, "team2")
    for k in ("team1", "team2"):
        state = ratings.select(F.col("team").alias(f"__{k}"), F.col("map_name").alias("__map"), F.col("rating").alias(f"{k}_rating"))
        rows = rows.join(state, (F.col(f"{k}_team") == F.col(f"__{k}")) & (F.col("map_name") == F.col("__map")), "left").drop(f"__{k}", "__map")
    maps = ratings.select(F.col("map_name").alias("__map")).distinct()
    rows = rows.join(maps, F.col("map_name") == F.col("__map"), "left")
    time = context_error(F.col("asked"), cutoff, stale_after_days) if cutoff is not None else F.lit(None).cast("string")
    error = F.coalesce("team1_error", "team2_error", F.when(F.col("team1_team") == F.col("team2_team"), "same_team"), F.when(F.col("__map").isNull(), "unknown_map"), time)
    p = expected(F.coalesce("team1_rating", F.lit(1500.0)), F.coalesce("team2_rating", F.lit(1500.0)))
    return rows.select("request_id", "team1", "team2", "map_name", F.when(error.isNull(), p).alias("p"), error.alias("error"))


def predict_known_maps(requests: DataFrame) -> DataFrame:
    """Adds p, and for every map its chance to be played and its leverage, to requests with an array ``maps`` of map
    probabilities; wrong numbers of maps and values outside [0, 1] have null."""
    maps = F.col("maps")
    slots = F.transform(F.sequence(F.lit(0), F.greatest(F.size(maps) - 1, F.lit(0))), lambda i: i)
    p = win_probability(maps)
    reach = F.array(*[F.when(F.size(maps) > k, reach_probability(maps, k)) for k in range(5)])
    worth = F.array(*[F.when(F.size(maps) > k, leverage(maps, k)) for k in range(5)])
    per_map = F.transform(slots, lambda i: F.struct(i.alias("slot"), F.get(reach, i).alias("reach"), F.get(worth, i).alias("leverage")))
    return requests.withColumns({"p": p, "per_map": F.when(p.isNotNull(), per_map)})


def list_maps(states: DataFrame) -> DataFrame:
    """Maps with history and how much."""
    return states.groupBy("map_name").agg(F.max("last_t").alias("last_t"), F.count_distinct("team").alias("teams")).orderBy("map_name")


def validate_overrides(overrides: DataFrame, entrants: DataFrame) -> DataFrame:
    """Adds error to forced results (stage, round, team1, team2, winner): teams that do not take part, a winner that does
    not play, one match forced twice."""
    from pyspark.sql import Window

    rows = overrides.withColumn("pair", pair_key(F.col("team1"), F.col("team2")))
    known = entrants.select(F.col("team").alias("__t")).distinct()
    for k in ("team1", "team2"):
        rows = rows.join(known.withColumn(f"__{k}", F.lit(True)), F.col(k) == F.col("__t"), "left").drop("__t")
    twice = F.count("*").over(Window.partitionBy("stage", "round", "pair")) > 1
    error = F.when(F.col("__team1").isNull() | F.col("__team2").isNull(), "unknown_team").when((F.col("winner") != F.col("team1")) & (F.col("winner") != F.col("team2")), "winner_not_playing").when(twice, "duplicate_override")
    return rows.withColumn("error", error).drop("__team1", "__team2")


def override_usage(validated: DataFrame, played: DataFrame) -> DataFrame:
    """validate_overrides() with ``used`` (a valid forced result whose match, in either order, was played in its stage and round) and
    ``turned`` (it was, and someone else won it in ``played``: stage, round, team1, team2, winner)."""
    own = played.select("stage", "round", pair_key(F.col("team1"), F.col("team2")).alias("pair"), F.col("winner").alias("__won"))
    rows = validated.join(own, ["stage", "round", "pair"], "left")
    used = F.col("error").isNull() & F.col("__won").isNotNull()
    return rows.withColumns({"used": used, "turned": used & (F.col("__won") != F.col("winner"))}).drop("__won")
