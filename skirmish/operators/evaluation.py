"""Predicted tournaments against what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pair_key
from .metrics import binary, set_comparison
from .prep import clipped

#: What a team reaches, in order, by its last stage and its place.
MILESTONES = ["past_1", "past_2", "playoffs", "semi", "final", "title"]


def reached(stage: Column, place: Column) -> dict[str, Column]:
    p = F.coalesce(place, F.lit(99))
    return {"past_1": stage > 1, "past_2": stage > 2, "playoffs": p <= 8, "semi": p <= 4, "final": p <= 2, "title": p == 1}


def milestones(actual: DataFrame) -> DataFrame:
    """(team, milestone, happened) of an event's outcome (team, stage, place)."""
    each = [F.struct(F.lit(k).alias("milestone"), v.cast("int").alias("happened")) for k, v in reached(F.col("stage"), F.col("place")).items()]
    return actual.select("team", F.explode(F.array(*each)).alias("m")).select("team", "m.*")


def milestone_quality(probabilities: DataFrame, n: int, actual: DataFrame) -> DataFrame:
    """Log-loss, Brier score and accuracy of simulated shares, by milestone; shares are kept off 0 and 1 by half a run."""
    each = [F.struct(F.lit(k).alias("milestone"), clipped(F.col(k) / n, 0.5 / n).alias("p")) for k in MILESTONES]
    rows = probabilities.select("team", F.explode(F.array(*each)).alias("m")).select("team", "m.*")
    return binary(rows.join(milestones(actual), ["team", "milestone"]), "milestone", y="happened").select("milestone", "n", "log_loss", "brier", "accuracy")


def champion(probabilities: DataFrame, team_column: str = "team") -> DataFrame:
    """Each team's rank for the title and the probability of all ranked above it."""
    w = Window.orderBy(F.desc("p_title"), team_column)  # the entrants of one event
    return probabilities.select(team_column, "p_title", F.row_number().over(w).alias("rank"), F.coalesce(F.sum("p_title").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("above"))


def advancement(predicted: DataFrame, actual: DataFrame, k: int, column: str) -> DataFrame:
    """The k teams most likely to reach something against those that did: overlap, precision, recall, Jaccard ratio."""
    top = predicted.orderBy(F.desc(column), "team").limit(k)
    return set_comparison(top, actual, "team")


def shared_matchups(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matches that two traces (stage, round, team1, team2, winner) have in common, in either order, and who won."""
    key = lambda df, name: df.select("stage", "round", pair_key(F.col("team1"), F.col("team2")).alias("pair"), F.col("winner").alias(name))
    return key(a, "winner_a").join(key(b, "winner_b"), ["stage", "round", "pair"]).withColumn("same", F.col("winner_a") == F.col("winner_b"))


def upsets(rows: DataFrame, k: int) -> DataFrame:
    """The k matches whose winner had the least probability."""
    p = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return rows.withColumn("winner_p", p).orderBy("winner_p", "match_id").limit(k)
