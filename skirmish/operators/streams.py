"""Event streams: one row per match, and its two sides as rows.

A match stream has match_id, dt, team1, team2, score1, score2, best_of, map_name, tier, win1, elig1, elig2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import micros, normalized_margin


def sides(matches: DataFrame) -> DataFrame:
    """Two rows a match, one shuffle-free explode. ``t`` is the time in microseconds; trusted: the other side is eligible."""
    one = F.struct(F.lit(1).alias("side"), F.col("team1").alias("team"), F.col("team2").alias("opp"), F.col("win1").alias("win"), F.col("score1").alias("sf"), F.col("score2").alias("sa"), F.col("elig1").alias("elig"), F.col("elig2").alias("trusted"))
    two = F.struct(F.lit(2).alias("side"), F.col("team2").alias("team"), F.col("team1").alias("opp"), (1 - F.col("win1")).alias("win"), F.col("score2").alias("sf"), F.col("score1").alias("sa"), F.col("elig2").alias("elig"), F.col("elig1").alias("trusted"))
    rows = matches.select("match_id", "dt", micros(F.col("dt")).alias("t"), "best_of", "map_name", "tier", F.explode(F.array(one, two)).alias("s"))
    rows = rows.select("match_id", "dt", "t", "best_of", "map_name", "tier", "s.*")
    return rows.withColumns({"margin": (F.col("sf") - F.col("sa")).cast("double"), "norm_margin": normalized_margin(F.col("sf"), F.col("sa"))})


def ledger(rows: DataFrame) -> DataFrame:
    """History entries: sides that are eligible, also against sides that are not (those are not trusted)."""
    return rows.where("elig")


def matchups(features: DataFrame, diff: list[str], low: list[str] = (), total: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Both sides' rows of a match in one: ``x_diff`` (team1 less team2), ``x_min``, ``x_sum``. Matches with one side go."""
    pick = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    wanted = list(dict.fromkeys([*diff, *low, *total]))
    both = features.groupBy("match_id", *keep).agg(F.count("*").alias("n_sides"), *[pick(c, s).alias(f"{c}_{s}") for c in wanted for s in (1, 2)]).where("n_sides = 2")
    cols = [(F.col(f"{c}_1") - F.col(f"{c}_2")).alias(f"{c}_diff") for c in diff]
    cols += [F.when(F.col(f"{c}_1").isNotNull() & F.col(f"{c}_2").isNotNull(), F.least(f"{c}_1", f"{c}_2")).alias(f"{c}_min") for c in low]
    cols += [(F.col(f"{c}_1") + F.col(f"{c}_2")).alias(f"{c}_sum") for c in total]
    return both.select("match_id", *keep, *cols)
