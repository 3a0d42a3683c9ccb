"""Snapshots, map predictions and intervals of the AUC."""

import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skirmish.operators import draws, intervals, metrics, resume, service


def plain_auc(p, y, c):
    """Share of pairs of a positive and a negative that the positive wins; ties count a half."""
    won = sum(c[i] * c[j] * ((p[i] > p[j]) + (p[i] == p[j]) / 2) for i in range(len(p)) for j in range(len(p)) if y[i] == 1 and y[j] == 0)
    pairs = sum(c[y == 1]) * sum(c[y == 0])
    return won / pairs if pairs else None


def test_auc_of_replicates(spark):
    rng = np.random.default_rng(3)
    rows = [(i // 2, int(rng.integers(2)), float(rng.integers(1, 9)) / 10, float(rng.uniform())) for i in range(60)]
    df = spark.createDataFrame(rows, "match_id long, y int, p double, p2 double").repartition(5)
    reps = 12
    u = spark.range(30).select(F.col("id").alias("match_id"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    drawn = {(r["rep"], r["match_id"]): r["u"] for r in u.withColumn("u", metrics.uniform(F.lit(42), F.col("rep"), F.col("match_id"))).collect()}
    cdf = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(8)])
    y = np.array([r[1] for r in rows])
    want = {}
    for arm, at in (("p", 2), ("p2", 3)):
        p = np.array([r[at] for r in rows])
        want[arm] = {rep: plain_auc(p, y, np.array([(drawn[rep, r[0]] >= cdf).sum() for r in rows])) for rep in range(1, reps + 1)}
        got = {r["rep"]: r["auc"] for r in intervals.auc_by_replicate(df, "match_id", reps, p=arm).collect()}
        assert got == pytest.approx(want[arm])
    made = {r["metric"]: r for r in intervals.auc_interval(df, "match_id", reps, other="p2").collect()}
    for metric, values in (("auc", list(want["p"].values())), ("delta_auc", [want["p"][k] - want["p2"][k] for k in want["p"]])):
        assert (made[metric]["low"], made[metric]["high"]) == pytest.approx(tuple(np.percentile(values, [2.5, 97.5])))
        assert (made[metric]["valid"], made[metric]["skipped"]) == (reps, 0)


def test_replicates_of_one_class_are_skipped(spark):
    df = spark.createDataFrame([(1, 1, 0.7), (2, 0, 0.4), (3, None, 0.5), (4, 1, None)], "match_id long, y int, p double")
    row = intervals.auc_interval(df, "match_id", 50).first()
    assert row["valid"] + row["skipped"] == 50 and row["valid"] > 0 and row["skipped"] > 0
    assert (row["low"], row["high"]) == (1.0, 1.0)
    assert intervals.auc_interval(df.limit(0), "match_id", 50).isEmpty()


def test_state_goes_on(spark):
    rows = [(i, 7 if i % 3 else i % 5, i // 4, i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "match_id long, team long, t long, win int")
    early, late = df.where("t < 40"), df.where("t >= 40")
    got = {r["match_id"]: (r["n_before"], r["wins_before"]) for r in resume.counts_from(resume.totals(early, "team"), late, "team").collect()}
    before = lambda r: [x[3] for x in rows if x[1] == r[1] and x[2] < r[2]]
    assert got == {r[0]: (len(before(r)), sum(before(r))) for r in rows if r[2] >= 40}
    whole = sorted(map(tuple, resume.totals(df, "team").collect()))
    assert sorted(map(tuple, resume.merged(resume.totals(early, "team"), resume.totals(late, "team"), "team").collect())) == whole


def test_map_requests(spark):
    teams = spark.createDataFrame([("A", 1, True), ("B", 2, True), ("C", 3, False)], "name string, team long, eligible boolean")
    ratings = spark.createDataFrame([(1, "m", 1600.0), (2, "m", 1500.0), (1, "n", 1400.0)], "team long, map_name string, rating double")
    day = lambda d: datetime.datetime(2020, 1, d)
    asked = [(1, "A", "B", "m", day(5)), (2, "B", "A", "m", day(5)), (3, "A", "B", "n", day(5)), (4, "A", "B", "x", day(5)), (5, "A", "C", "m", day(5)), (6, "A", "Z", "m", day(5)), (7, "A", " A ", "m", day(5)), (8, "A", "B", "m", day(1)), (9, "A", "B", "m", day(30)), (10, None, "B", "m", day(5)), (11, "A", "B", None, day(5))]
    df = spark.createDataFrame(asked, "request_id long, team1 string, team2 string, map_name string, asked timestamp")
    got = {r["request_id"]: (r["p"], r["error"]) for r in service.predict_map(df, teams, ratings, day(2), 10).collect()}
    up = 1 / (1 + 10 ** (-100 / 400))
    assert got[1] == (pytest.approx(up), None) and got[2] == (pytest.approx(1 - up), None) and got[3] == (pytest.approx(1 - up), None)
    assert {k: e for k, (p, e) in got.items() if p is None} == {4: "unknown_map", 5: "ineligible_team", 6: "unknown_team", 7: "same_team", 8: "before_context", 9: "stale_context", 10: "unknown_team", 11: "unknown_map"}


def test_copies_of_blocks_are_those_of_columns(spark):
    many = 300
    ids = [0, 1, -1, 7, 2**31 - 1, -(2**31), *range(1000, 1300)]
    for kind, more in (("bigint", [2**40 + 3, -(2**63)]), ("int", [])):
        df = spark.createDataFrame([(i,) for i in [*ids, *more, None]], f"cluster {kind}")
        drawn = F.transform(F.sequence(F.lit(1), F.lit(many)), lambda rep: metrics.poisson_copies(metrics.uniform(F.lit(42), rep, F.col("cluster"))))
        want = {r["cluster"]: r["c"] for r in df.select("cluster", drawn.alias("c")).collect()}
        got = draws.Copies(42, many, kind).of(pa.array([*ids, *more, None], pa.int64() if kind == "bigint" else pa.int32()))
        assert {i: c.tolist() for i, c in zip([*ids, *more, None], got, strict=True)} == want


def test_draws_do_not_leave_numpy(spark):
    """Draws as columns took some 0.3 microseconds each, 26 thousand million of them at 1 GB."""
    df = spark.createDataFrame([(i, i % 2, i / 9) for i in range(9)], "match_id long, y int, p double")
    plans = [f(df, "match_id", 50)._jdf.queryExecution().toString() for f in (intervals.auc_interval, metrics.bootstrap)]
    assert not any("xxhash64" in p for p in plans)
    # other types of clusters are hashed by Spark, to the same draws as ever
    named = df.withColumn("match_id", F.concat(F.lit("m"), "match_id"))
    u = {(r["rep"], r["i"]): r["u"] for r in spark.range(9).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(50)))).select("rep", F.col("id").alias("i"), metrics.uniform(F.lit(42), F.col("rep"), F.concat(F.lit("m"), "id")).alias("u")).collect()}
    got = {r["rep"]: r["auc"] for r in intervals.auc_by_replicate(named, "match_id", 50).collect()}
    for rep in range(1, 51):
        c = [int((u[rep, i] >= np.array(draws.poisson_steps())).sum()) for i in range(9)]
        pos, neg = [(i, c[i]) for i in range(9) if i % 2], [(i, c[i]) for i in range(9) if not i % 2]
        all_pairs = sum(n for _, n in pos) * sum(n for _, n in neg)
        won = sum(n * m for i, n in pos for j, m in neg if j < i)
        assert (got[rep] is None) if not all_pairs else got[rep] == pytest.approx(won / all_pairs)


def test_draws_are_dealt_to_many_tasks(spark):
    df = spark.createDataFrame([(i, i % 2, i / 9, None if i else 0.5) for i in range(9)], "match_id long, y int, p double, p2 double")
    for make, how in ((metrics.bootstrap, "RoundRobinPartitioning(4)"), (intervals.auc_interval, "REPARTITION_BY_NUM")):
        assert how in make(df, "match_id", 50)._jdf.queryExecution().executedPlan().toString()
    # a replicate without any row of an arm has no value; here all but one row are null
    got = {r["metric"]: r for r in metrics.bootstrap(df, "match_id", 200, p="p2").collect()}
    assert got["brier"]["low"] is not None and got["brier"]["low"] > 0
    none = {r["metric"]: r["low"] for r in metrics.bootstrap(df.where("match_id > 0"), "match_id", 50, other="p2").collect()}
    assert none["brier"] > 0 and none["delta_brier"] is None
