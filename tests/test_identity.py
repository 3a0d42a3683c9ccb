"""Eras of rosters, close strangers, verdicts and episodes, against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from skirmish.functions import DAY
from skirmish.operators import identity, prefix, quality

SCHEMA = "name string, match_id long, t long, player long"


def rows_of(games):
    """games: (name, match, day, players)"""
    return [(n, m, d * DAY, p) for n, m, d, players in games for p in (players or [None])]


def plain_eras(games, name):
    out = []
    for _, m, d, players in sorted((g for g in games if g[0] == name), key=lambda g: (g[2], g[1])):
        who = sorted(set(players))
        if not who:
            continue
        if out and out[-1][0] == who:
            out[-1][2] = d
        else:
            out.append([who, d, d])
    return out


def plain_review(games, name):
    eras = plain_eras(games, name)
    by = sorted((e[1], e[2]) for e in eras)
    sequential = all(a[1] < b[0] for a, b in zip(by, by[1:]))
    close = 0
    for a, b in itertools.combinations(eras, 2):
        gap = b[1] - a[2] if b[1] >= a[2] else a[1] - b[2]
        close += not set(a[0]) & set(b[0]) and gap <= 60
    return len(eras), sequential, close


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(prefix, "CELL_ROWS", 40)


def test_review_equals_plain_loops(spark, small):
    rng = random.Random(3)
    games = []
    for k, name in enumerate(["a", "b", "c", "mix1", "mix2", "TBD"]):
        for m in range(rng.choice([4, 20, 70])):
            players = rng.choice([[1, 2], [1, 2], [2, 3], [7, 8], [9], []])
            games.append((name, 100 * k + m, rng.randint(0, 700), players))
    df = spark.createDataFrame(rows_of(games), SCHEMA)
    got = {r["name"]: r for r in identity.review(df, "name").collect()}
    assert set(got) == {g[0] for g in games}
    for name, r in got.items():
        eras, sequential, close = plain_review(games, name)
        assert (r["n_eras"], r["sequential"], r["close_events"], r["n_matches"]) == (eras, sequential, close, sum(g[0] == name for g in games)), name
    pairs = identity.close_strangers(identity.roster_eras(identity.appearances(df, "name"), "name"), "name")
    assert pairs.count() == pairs.select("name", "a", "b").distinct().count() == sum(r["close_events"] for r in got.values())


def test_verdicts_and_episodes(spark):
    games = [("steady", i, 10 * i, [1, 2]) for i in range(60)]
    games += [("handed over", 100 + i, 10 * i, [1] if i < 30 else [2]) for i in range(60)]
    games += [("mixed up", 200 + i, i // 2, [1 + i % 2]) for i in range(60)]
    games += [("small", 300 + i, i, [1] if i < 3 else [2]) for i in range(6)]
    games += [("two", 400, 0, [3]), ("two", 401, 1, [3]), ("two", 402, 1, [4]), ("two", 403, 3, [4]), ("two", 404, 4, [3]), ("two", 409, 9, []), ("two", 390, -5, [])]
    games += [("mix7", 500 + i, i, [i]) for i in range(5)] + [("Team 9", 600 + i, i, [5]) for i in range(50)]
    df = spark.createDataFrame(rows_of(games), SCHEMA)
    reviewed = identity.review(df, "name")
    got = {r["name"]: r["verdict"] for r in reviewed.collect()}
    assert got == {
        "steady": "KEEP_AS_SINGLE_TEAM", "handed over": "KEEP_AS_SINGLE_TEAM", "mixed up": "MANUAL_REVIEW", "small": "MANUAL_REVIEW", "two": "NEEDS_EPISODE_SPLIT",
        "mix7": "EXCLUDE_FROM_IDENTITY_DEPENDENT_FEATURES", "Team 9": "KEEP_AS_SINGLE_TEAM",
    }
    played = df.select("name", "match_id", "t").distinct()
    made = {r["match_id"]: r["identity"] for r in identity.episodes(played, df, reviewed, "name").collect()}
    assert made[0] == "steady" and made[500] is None
    assert [made[m] for m in (390, 400, 401, 402, 403, 404, 409)] == ["two#1", "two#1", "two#1", "two#2", "two#2", "two#3", "two#3"]


def test_two_eras_that_interleave_are_not_sequential(spark):
    eras = spark.createDataFrame([("x", 1, [1], 0, 10 * DAY), ("x", 2, [2], 10 * DAY, 20 * DAY), ("y", 1, [1], 0, 10 * DAY), ("y", 2, [2], 71 * DAY, 72 * DAY), ("z", 1, [1], 0, 10 * DAY), ("z", 2, [2], 70 * DAY + DAY - 1, 72 * DAY)], "name string, era int, roster array<int>, first_t long, last_t long")
    got = {r["name"]: r["gap_days"] for r in identity.close_strangers(eras, "name").collect()}
    assert got == {"x": 0, "z": 60}


def test_running_and_previous_cross_cells(spark, small):
    rng = random.Random(8)
    rows = [(i, 1 if i % 2 else rng.randint(2, 4), rng.randint(0, 60), rng.choice([None, "u", "v"]), rng.randint(0, 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "match_id long, team long, t long, v string, win int")
    at = prefix.cuts(df)
    assert len(at) > 5
    got = {r["match_id"]: r for r in prefix.running(prefix.previous(df, ["team"], {"was": "v"}, ["match_id"], at=at), ["team"], {"s": F.col("win")}, ["match_id"], at=at).collect()}
    for team in (1, 2, 3, 4):
        was, total = None, 0
        for i, _, _, v, win in sorted((r for r in rows if r[1] == team), key=lambda r: (r[2], r[0])):
            total += win
            assert (got[i]["was"], got[i]["s"]) == (was, total)
            was = v
    eras = quality.eras(df.where("v is not null"), "team", "v")
    assert eras.agg(F.sum("n")).first()[0] == sum(r[3] is not None for r in rows)
