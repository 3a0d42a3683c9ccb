"""Requests, overrides and evaluation."""

import datetime as dt

from pyspark.sql import functions as F

from skirmish.operators import evaluation, service
from skirmish.operators import tournament as T


def test_requests(spark):
    teams = spark.createDataFrame([("Alpha", 1, True), ("Beta", 2, True), ("Twin", 3, True), ("Twin", 4, True), ("Bad", 5, False)], "name string, team long, eligible boolean")
    ratings = spark.createDataFrame([(1, 1600.0), (2, 1500.0)], "team long, rating double")
    day = dt.datetime(2024, 5, 1)
    asks = [("Alpha ", "Beta", 1), ("Alpha", "Beta", 3), ("Nobody", "Beta", 1), ("Twin", "Beta", 1), ("Bad", "Beta", 1), ("Alpha", "Alpha", 1), ("Alpha", "Beta", 2)]
    df = spark.createDataFrame([(i, a, b, n, day + dt.timedelta(days=40 * (i == 1))) for i, (a, b, n) in enumerate(asks)], "request_id int, team1 string, team2 string, best_of int, asked timestamp")
    got = {r["request_id"]: (r["p"], r["error"]) for r in service.predict_series(df, teams, ratings, day, 30).collect()}
    assert abs(got[0][0] - 1 / (1 + 10 ** (-0.25))) < 1e-9
    assert [got[i][1] for i in range(7)] == [None, "stale_context", "unknown_team", "ambiguous_team", "ineligible_team", "same_team", "invalid_best_of"]


def test_known_maps(spark):
    df = spark.createDataFrame([(1, [0.6, 0.5, 0.7]), (2, [0.6, 0.5]), (3, [1.2]), (4, [0.3])], "request_id int, maps array<double>")
    got = {r["request_id"]: r for r in service.predict_known_maps(df).collect()}
    assert abs(got[1]["p"] - (0.3 + 0.3 * 0.7 + 0.2 * 0.7)) < 1e-12 and got[2]["p"] is None and got[3]["p"] is None and got[4]["p"] == 0.3
    assert [round(m["reach"], 9) for m in got[1]["per_map"]] == [1.0, 1.0, 0.5] and abs(got[1]["per_map"][2]["leverage"] - 0.5) < 1e-12


def test_overrides_decide(spark):
    who = spark.createDataFrame([(t, 2000.0 - t, 1, t + 1) for t in range(16)], "team long, rating double, stage int, seed0 int")
    forced = spark.createDataFrame([(1, 1, 8, 0, 8), (1, 1, 99, 0, 0), (1, 2, 3, 4, 5)], "stage int, round int, team1 long, team2 long, winner long")
    errors = [r["error"] for r in service.validate_overrides(forced, who).orderBy("round", "team1").collect()]
    assert errors == [None, "unknown_team", "winner_not_playing"]
    state = T.start(who.withColumn("sim", F.lit(0)))
    made = {r["team"]: r["wins"] for r in T.swiss_round(state, T.matrix_of(who), 1, 1, forced=forced).collect()}
    assert made[8] == 1 and made[0] == 0 and made[1] == 1


def test_evaluation(spark):
    probabilities = spark.createDataFrame([(1, 90, 80, 70, 60, 50, 40, 0.4), (2, 50, 40, 30, 20, 10, 5, 0.05)], "team long, past_1 int, past_2 int, playoffs int, semi int, final int, title int, p_title double")
    actual = spark.createDataFrame([(1, 3, 1), (2, 1, None)], "team long, stage int, place int")
    got = {r["milestone"]: r for r in evaluation.milestone_quality(probabilities, 100, actual).collect()}
    assert abs(got["title"]["brier"] - (0.36 + 0.0025) / 2) < 1e-12 and got["past_1"]["accuracy"] == 0.5
    assert [r["rank"] for r in evaluation.champion(probabilities).orderBy("team").collect()] == [1, 2]
    a = spark.createDataFrame([(1, 1, 5, 6, 5)], "stage int, round int, team1 long, team2 long, winner long")
    b = spark.createDataFrame([(1, 1, 6, 5, 6), (1, 2, 6, 5, 6)], "stage int, round int, team1 long, team2 long, winner long")
    assert [r["same"] for r in evaluation.shared_matchups(a, b).collect()] == [False]
