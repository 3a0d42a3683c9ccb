"""Totals, tails and carried values over cells of time equal those of plain windows, and hot keys are split."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skirmish.functions import DAY
from skirmish.operators import asof, history, prefix, ratings
from tests.test_history import by, stream


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(prefix, "CELL_ROWS", 100)


@pytest.fixture(scope="module")
def hot(spark):
    """Half of all rows are team 1's; some teams and moments are null; many rows share a moment."""
    rng = random.Random(4)
    rows = []
    for i in range(2_000):
        team = 1 if i % 2 else rng.choice([None, 2, 3, 4])
        t = None if rng.random() < 0.01 else rng.randint(0, 300) * DAY
        rows.append((i, rng.randint(1, 2), team, t, rng.randint(0, 1), rng.random(), rng.choice([1, 3])))
    df = spark.createDataFrame(rows, "match_id long, side int, team long, t long, win int, margin double, best_of int")
    df.cache().count()
    return df


def rows_of(df, *cols):
    return {r["match_id"]: tuple(None if r[c] is None else round(float(r[c]), 9) for c in cols) for r in df.collect()}


def test_prior_equals_the_window(hot, small):
    w = Window.partitionBy("team").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    want = hot.withColumns({"n": F.sum(F.lit(1)).over(w), "s": F.sum("margin").over(w), "m": F.max("win").over(w)})
    at = prefix.cuts(hot)
    assert len(at) > 10
    got = prefix.prior(hot, ["team"], {"n": F.lit(1), "s": F.col("margin")}, {"m": F.col("win")})
    assert got.columns == want.columns
    assert rows_of(got, "n", "s", "m") == rows_of(want, "n", "s", "m")


def test_no_task_has_more_than_its_share_of_a_hot_key(hot, small):
    cells = prefix.in_cells(hot, prefix.cuts(hot))
    most = cells.groupBy("team", prefix.CELL).count().agg(F.max("count")).first()[0]
    assert hot.where("team = 1").count() == 1_000 and most < 150


def test_counts_of_a_look_back(hot, small):
    rows = hot.where("t is not null")
    want = rows.withColumn("n", F.count("*").over(Window.partitionBy("team").orderBy("t").rangeBetween(-30 * DAY, -1)))
    assert rows_of(prefix.counted_since(rows, ["team"], 30 * DAY, "n"), "n") == rows_of(want, "n")


def plain_last(rows, k, where=lambda r: True):
    out = {}
    for r in rows:
        old = sorted((e for e in rows if e["team"] == r["team"] and e["t"] < r["t"] and where(e)), key=lambda e: (e["t"], e["match_id"]))[-k:]
        out[r["match_id"]] = (round(sum(e["margin"] for e in old) / len(old), 9) if old else None,)
    return out


@pytest.mark.parametrize("some", [False, True])
def test_last_entries_cross_cells(hot, small, some):
    rows = hot.where("team is not null and t is not null")
    got = history.last_n(rows, (7,), ("margin",), where=F.col("win") == 1 if some else None)
    assert rows_of(got, "margin_last_7") == plain_last(rows.collect(), 7, lambda e: not some or e["win"] == 1)


def test_tails_hold_no_more_than_asked(hot, small):
    rows = hot.where("team = 1 and t is not null").withColumn("t", F.lit(5))
    batches = rows.groupBy("team", "t").agg(F.collect_list("match_id").alias("batch"))
    later = batches.select("team", (F.col("t") + 1).alias("t"), F.array().cast("array<bigint>").alias("batch"))
    got = prefix.tails(batches.unionByName(later), ["team"], 3).orderBy("t").collect()
    assert [len(r["recent"]) for r in got] == [0, 3]
    plan = history.last_n(rows, (5,), ("margin",), at=[])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # older rows of a moment go before the shuffle


def test_decayed_sums_cross_cells(hot, small, monkeypatch):
    rows = hot.where("team is not null and t is not null")
    got = rows_of(history.decayed(rows, 60, ("margin",)), "tw_mass", "tw_margin")
    monkeypatch.setattr(prefix, "CELL_ROWS", 10**6)
    want = rows_of(history.decayed(rows, 60, ("margin",)), "tw_mass", "tw_margin")
    assert all(a == pytest.approx(b, abs=1e-8) for a, b in ((got[k], want[k]) for k in want))


def test_asof_crosses_cells(hot, small, monkeypatch):
    entries = hot.where("match_id % 7 = 0 and team is not null and t is not null")
    probes = hot.where("team is not null and t is not null").select("match_id", "team", "t")
    got = rows_of(asof.asof(probes, entries.select("team", "t", "win", F.col("margin").alias("value")), ["team"], ["value", "win"]), "value", "win")
    held = entries.collect()
    for p in probes.collect():
        old = [(e["t"], e["margin"], e["win"]) for e in held if e["team"] == p["team"] and e["t"] < p["t"]]
        want = tuple(round(float(x), 9) for x in max(old)[1:]) if old else (None, None)
        assert got[p["match_id"]] == want


def test_ratings_cross_cells_and_start_from_a_snapshot(spark, small, monkeypatch):
    rng = random.Random(9)
    played = []
    for i in range(400):
        a = 1 if i % 2 else rng.randint(2, 8)
        b = rng.choice([x for x in range(1, 9) if x != a])
        played.append((i, i // 3, a, b, rng.random() < 0.6, rng.random() < 0.9, True))
    rows = stream(spark, played)
    names = ("elo_before", "own_mid", "opp_mid", "change")
    got = by(ratings.rate(rows), *names)
    assert len(prefix.cuts(rows)) > 3
    monkeypatch.setattr(prefix, "CELL_ROWS", 10**6)
    want = by(ratings.rate(rows), *names)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    early, late = rows.where("match_id < 201"), rows.where("match_id >= 201")
    first = ratings.rate(early)
    after = first.where("elig and trusted").groupBy("team").agg(F.max_by(F.col("own_mid") + F.col("change"), F.struct("t", "match_id")).alias("rating"))
    rest = by(ratings.rate(late, snapshot=after), *names)
    assert all(rest[k] == pytest.approx(want[k], abs=1e-6) for k in rest)
