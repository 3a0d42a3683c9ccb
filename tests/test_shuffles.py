"""How often large steps read and shuffle their rows."""

import pytest
from pyspark.sql import functions as F

from skirmish.functions import DAY
from skirmish.operators import pool, prefix, ratings, roster
from skirmish.scratch import kept


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def sides(spark):
    """Three matches a day of forty teams, none hot."""
    rows = spark.range(300).select(F.col("id").alias("match_id"), (F.floor(F.col("id") / 3) * DAY).alias("t"), (F.col("id") % 20).alias("a"), (20 + F.col("id") * 7 % 20).alias("b"))
    both = [rows.select("match_id", "t", F.lit(s).alias("side"), F.col(x).alias("team"), F.lit(True).alias("elig"), F.lit(True).alias("trusted"), (F.col("match_id") % 2 == s % 2).cast("int").alias("win"), F.lit("m").alias("map_name"), F.lit(0.1).alias("norm_margin")) for s, x in ((1, "a"), (2, "b"))]
    return both[0].unionByName(both[1])


def test_cells_only_where_a_key_is_hot(sides, monkeypatch):
    monkeypatch.setattr(prefix, "CELL_ROWS", 100)
    assert len(prefix.cuts(sides)) > 3
    assert prefix.cuts(sides, keys=["team"]) == []
    assert len(prefix.cuts(sides.withColumn("team", F.lit(1)), keys=["team"])) > 3


def test_totals_over_cells_read_their_rows_once(sides, monkeypatch):
    monkeypatch.setattr(prefix, "CELL_ROWS", 100)
    at = prefix.cuts(sides)
    made = sides
    for name in ("x", "y", "z"):
        made = prefix.prior(made, ["team"], {name: F.col("win")}, at=at)
    assert plan(made).count("Scan parquet") == 2 and "Range (" not in plan(made)


def test_a_round_of_ratings_is_one_shuffle(sides, monkeypatch):
    plans = []
    keep = ratings.kept
    monkeypatch.setattr(ratings, "kept", lambda df: plans.append((df.columns, plan(df))) or keep(df))
    ratings.rate(sides).count()
    rounds = [p for columns, p in plans if "was" in columns]
    assert rounds and all(p.count("Exchange") == ratings.ROUNDS_AT_ONCE for p in rounds)


def test_a_side_without_its_opponent_changes_nothing(sides):
    got = {(r["match_id"], r["side"]): r for r in ratings.rate(sides.where("match_id <> 5 or side = 1")).collect()}
    assert got[5, 1]["change"] == 0 and got[5, 1]["opp_mid"] is None and got[6, 1]["change"] != 0


def test_pairs_of_a_roster_are_not_shuffled(sides):
    seen = sides.select("team", (F.col("match_id") % 7).alias("player"), "match_id", "t")
    mass = roster.masses(sides, seen)
    for made in (roster.top_five(mass), roster.concentration(mass)):
        assert plan(made).count("Exchange hashpartitioning") == 2
    n = {(r["match_id"], r["side"], r["player"]): r["games"] for r in mass.collect()}
    near = [(p.match_id, p.side, s.player) for p in sides.collect() for s in seen.collect() if p.team == s.team and p.t - roster.LOOK_BACK <= s.t < p.t]
    assert n == {k: near.count(k) for k in set(near)}


def test_advantages_ask_nothing_again(sides):
    states = pool.map_states(sides)
    pools = pool.pools(sides, states)
    assert plan(pool.advantages(pools, sides)).count("Window [last") == plan(pools).count("Window [last") == 1


def test_cells_of_ratings_follow_the_rows_of_a_key(spark, monkeypatch):
    """Many keys with few matches each take few cells, however many rows there are; where the cells lie changes no rating."""
    monkeypatch.setattr(prefix, "CELL_ROWS", 400)
    wins = [(i, (7 * i) % 97 * DAY, i % 160, (i * i + 1) % 160, i % 3 % 2) for i in range(800)]
    rows = [(m, t, s, a if s == 1 else b, float(w if s == 1 else 1 - w), True, True) for m, t, a, b, w in wins if a != b for s in (1, 2)]
    sides = kept(spark.createDataFrame(rows, "match_id long, t long, side int, team long, win double, elig boolean, trusted boolean"))
    made, cell = [], ratings.settled
    monkeypatch.setattr(ratings, "settled", lambda *args: made.append(1) or cell(*args))
    got = {(r["match_id"], r["side"]): r["elo_before"] for r in ratings.rate(sides).collect()}
    assert len(made) == 1
    monkeypatch.setattr(ratings, "KEY_ROWS", 1)
    want = {(r["match_id"], r["side"]): r["elo_before"] for r in ratings.rate(sides).collect()}
    assert len(made) > 5 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
