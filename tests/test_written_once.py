"""What several steps of a query read is made once."""

import os

import pytest
from pyspark.sql import functions as F

from skirmish.functions import DAY
from skirmish.operators import compose, roster
from skirmish.plans.catalog import QUERIES
from skirmish.scratch import at_once

FOLDER = "/root/testdata/sf0.001"


def games(spark):
    """A match a day of two teams, five players each."""
    rows = spark.range(40).select(F.col("id").alias("match_id"), (F.col("id") * DAY).alias("t"), F.explode(F.array(F.lit(1), F.lit(2))).alias("side"))
    rows = rows.select("*", F.col("side").alias("team"), F.lit("m").alias("map_name"), F.lit(True).alias("elig"))
    cols = {v: (F.col("match_id") % 5 + 0.1).cast("double") for v in compose.STATS}
    return rows, rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("p")).where("(match_id + p) % 7 < 5").withColumns({"player": F.col("team") * 10 + F.col("p"), **cols})


def test_pairs_of_rosters_are_made_once(spark):
    probes, players = games(spark)
    r = compose.Rosters(probes, players)
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (compose.roster_family(r), compose.core_on_map(r))]
    assert all("e_player#" not in p for p in plans)
    mass = roster.masses(probes, r.seen)
    want = {(x["match_id"], x["side"]): x["concentration"] for x in roster.concentration(mass).collect()}
    got = {(x["match_id"], x["side"]): x for x in r.five.collect()}
    top = {(x["match_id"], x["side"], x["player"]) for x in roster.top_five(mass).collect()}
    assert {k: x["concentration"] for k, x in got.items()} == want and {(*k, p) for k, x in got.items() for p in x["players"]} == top


def test_recent_side_equals_its_parts(spark):
    probes, players = games(spark)
    r = compose.Rosters(probes, players)
    ten, twenty = (roster.recent_games(probes, r.seen, n) for n in (10, 20))
    got = {(x["match_id"], x["side"]): x for x in roster.recent_side(roster.recent_games(probes, r.seen, 20), r.five.select("match_id", "side", F.col("players").alias("core"))).collect()}
    for name, made in (("u10", roster.unique_players(ten)), ("u20", roster.unique_players(twenty)), ("continuity", roster.continuity(ten, r.core))):
        want = {(x[0], x[1]): x[2] for x in made.collect()}
        assert want and {k: x[name] for k, x in got.items()} == want, name


def test_tables_of_several_threads_keep_their_order(spark):
    assert [d.first()[0] for d in at_once(*[lambda k=k: spark.range(k, k + 1) for k in range(5)])] == list(range(5))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_form_of_players_makes_pairs_once(spark):
    df = QUERIES["player_form_decay"][0](spark, FOLDER)
    assert "e_player#" not in df._jdf.queryExecution().optimizedPlan().toString()
