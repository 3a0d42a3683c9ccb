"""The semantics that must hold whatever the data: strictly prior, isolated batches, trust, symmetry."""

import datetime as dt

from pyspark.sql import functions as F

from skirmish.functions import best_of, identity_key, normalized_margin, to_num
from skirmish.operators import asof, history, prep, quality, ratings
from skirmish.operators.streams import ledger, matchups, sides

SCHEMA = "match_id long, dt timestamp, team1 long, team2 long, score1 int, score2 int, best_of int, map_name string, tier string, win1 int, elig1 boolean, elig2 boolean"


def stream(spark, rows):
    """rows: (id, day, team1, team2, team 1 wins[, eligible 1, eligible 2])"""
    out = []
    for r in rows:
        i, day, a, b, w, e1, e2 = (*r, *(True, True)[len(r) - 5 :])
        out.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(days=day), a, b, 2 if w else 1, 1 if w else 2, 3, "m", "t", int(w), e1, e2))
    return sides(spark.createDataFrame(out, SCHEMA))


def by(df, *cols):
    return {(r["match_id"], r["side"]): tuple(r[c] for c in cols) for r in df.collect()}


def test_strictly_prior_and_batches(spark):
    rows = stream(spark, [(1, 0, 1, 2, True), (2, 5, 1, 3, True), (3, 5, 1, 4, False), (4, 9, 2, 1, True)])
    got = by(history.prior_counts(ledger(rows)), "n_before", "wins_before", "days_since_last")
    assert got[1, 1] == (0, 0, None)
    assert got[2, 1] == got[3, 1] == (1, 1, 5.0)
    assert got[4, 2] == (3, 2, 4.0)
    last = by(history.last_n(ledger(rows), (2,), ("win",)), "win_last_2")
    assert last[1, 1] == (None,) and last[4, 2] == (0.5,)


def test_activity_window_is_half_open(spark):
    rows = stream(spark, [(1, 0, 1, 2, True), (2, 30, 1, 2, True), (3, 61, 1, 2, True)])
    got = by(history.prior_counts(ledger(rows)), "n_30d")
    assert got[2, 1] == (1,) and got[3, 1] == (0,)


def fold(rows):
    """Two-phase ratings, one match after the other: {(match, side): (before the moment, just before the match)}."""
    rating, out = {}, {}
    for moment in sorted({r[1] for r in rows}):
        batch = sorted(r for r in rows if r[1] == moment)
        before = dict(rating)
        for i, _, a, b, w, *e in batch:
            ra, rb = rating.get(a, 1500.0), rating.get(b, 1500.0)
            out[i, 1], out[i, 2] = (before.get(a, 1500.0), ra), (before.get(b, 1500.0), rb)
            if all(e):
                d = 32 * (w - 1 / (1 + 10 ** ((rb - ra) / 400)))
                rating[a], rating[b] = ra + d, rb - d
    return out


def test_ratings_equal_the_fold(spark):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(300):
        a, b = rng.sample(range(8), 2)
        rows.append((i, i // 3, a, b, rng.random() < 0.6, a != 7, b != 7))
    got = by(ratings.rate(stream(spark, rows)), "elo_before", "own_mid")
    for k, want in fold(rows).items():
        assert abs(got[k][0] - want[0]) < 1e-6 and abs(got[k][1] - want[1]) < 1e-6


def test_untrusted_opponents(spark):
    rows = stream(spark, [(1, 0, 1, 2, True, True, False), (2, 1, 1, 3, True)])
    kept = by(ledger(rows), "trusted")
    assert (1, 2) not in kept and kept[1, 1] == (False,)
    rated = by(ratings.rate(rows), "elo_before")
    assert rated[2, 1] == (1500.0,)
    assert by(history.prior_counts(ledger(rows)), "n_before")[2, 1] == (1,)


def test_swapped_sides_negate(spark):
    games = [(i, i // 2, i % 4, 4 + i % 3, i % 5 < 3) for i in range(40)]
    a = matchups(history.series_features(ledger(stream(spark, games))), history.SERIES)
    b = matchups(history.series_features(ledger(stream(spark, [(i, d, y, x, not w) for i, d, x, y, w in games]))), history.SERIES)
    both = a.alias("a").join(b.alias("b"), "match_id")
    worst = both.agg(*[F.max(F.abs(F.col(f"a.{c}_diff") + F.col(f"b.{c}_diff"))).alias(c) for c in history.SERIES]).first()
    assert all(v < 1e-9 for v in worst)


def test_asof_and_within(spark):
    entries = spark.createDataFrame([("k", 10, 1), ("k", 20, 2), ("j", 5, 9)], "key string, t long, v int")
    probes = spark.createDataFrame([("k", 10), ("k", 11), ("k", 25), ("x", 5)], "key string, t long")
    got = {(r["key"], r["t"]): r["v"] for r in asof.asof(probes, entries, ["key"], ["v"]).collect()}
    assert got == {("k", 10): None, ("k", 11): 1, ("k", 25): 2, ("x", 5): None}
    near = {(r["t"], r["e_t"]) for r in asof.within(probes, entries, ["key"], 10).collect()}
    assert near == {(11, 10), (25, 20)}


def test_cleaning(spark):
    df = spark.createDataFrame([("1.0", "A b-C"), ("x", "É!"), ("", ""), ("2", None)], "x string, name string")
    got = df.select(to_num(F.col("x")).alias("n"), best_of(F.col("x")).alias("b"), identity_key(F.col("name")).alias("k")).collect()
    assert [r["n"] for r in got] == [1.0, None, None, 2.0]
    assert [r["b"] for r in got] == [1, None, None, None]
    assert [r["k"] for r in got] == ["abc", "é", "", None]
    zero = spark.range(1).select(normalized_margin(F.lit(0), F.lit(0)).alias("m")).first()["m"]
    assert zero == 0.0


def test_slots_and_both_sides(spark):
    rows = [(1, 1, 1, 7, 1.0), (1, 1, 2, 7, 1.0), (1, 1, 3, 8, 1.0), (1, 1, 4, 8, 2.0), (2, 1, 1, 9, 1.0), (2, 2, 1, 9, 1.0)]
    df = spark.createDataFrame(rows, "match_id int, side int, slot int, player int, adr double")
    left = quality.collapse_slots(quality.drop_players_on_both_sides(df), ["adr"])
    assert [(r["player"], r["slot"]) for r in left.collect()] == [(7, 1)]


def test_splits_keep_moments_whole(spark):
    df = spark.range(100).select(F.col("id").alias("match_id"), (F.col("id") / 7).cast("long").alias("t"))
    split = prep.chronological_split(df)
    assert split.groupBy("t").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert {r["split"] for r in split.collect()} == {"train", "validation", "test"}


def test_spec_refuses_leaks(spark):
    df = spark.createDataFrame([(1, 2.0, 1)], "match_id int, score_diff double, win1 int")
    try:
        prep.FeatureSpec(["score_diff"]).check(df)
    except ValueError:
        return
    raise AssertionError("a leaking feature passed")
