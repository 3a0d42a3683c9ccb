"""Queries and operators do the whole job, not a part of it."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish import streaming
from skirmish.functions import DAY
from skirmish.operators import metrics, prefix, quality
from skirmish.plans import model_queries
from skirmish.plans.adapter import match_sides
from skirmish.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def before(events, team, t):
    """(n, wins) of a team strictly before a moment, by going through all events."""
    wins = [r["win"] for r in events if r["team"] == team and r["t"] < t]
    return len(wins), sum(wins)


@tables
def test_every_match_asks(spark):
    sides = match_sides(spark, FOLDER).select("match_id", "side", "team", "t", "win", "elig").collect()
    events = [r for r in sides if r["elig"]]
    got = {(r["match_id"], r["side"]): (r["n"], r["wins"]) for r in QUERIES["two_stream_requests_all"][0](spark, FOLDER).collect()}
    assert got == {(r["match_id"], r["side"]): before(events, r["team"], r["t"]) for r in sides}


@tables
def test_streams_leave_no_folders(spark, monkeypatch):
    monkeypatch.setattr(streaming, "MICRO_BATCH", 300)
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    old = set(glob.glob(f"{top}/*"))
    got = {(r["match_id"], r["side"]): (r["n_before"], r["wins_before"]) for r in QUERIES["streaming_prior_counts"][0](spark, FOLDER).collect()}
    sides = match_sides(spark, FOLDER).where("elig").select("match_id", "side", "team", "t", "win").collect()
    assert got == {(r["match_id"], r["side"]): before(sides, r["team"], r["t"]) for r in sides}
    new = set(glob.glob(f"{top}/*")) - old
    assert len(new) == 1 and all("/table-" in f for f in new)  # the table of the result


SIDES = "match_id long, side int, team long, t long, win int"


def arriving(spark, tmp_path, batches):
    """A stream of files, one a batch, in this order."""
    for k, rows in enumerate(batches):
        at = str(tmp_path / "in" / f"{k}.parquet")
        os.makedirs(os.path.dirname(at), exist_ok=True)
        spark.createDataFrame(rows, SIDES).toPandas().to_parquet(at, index=False)
        os.utime(at, (1_600_000_000 + 100 * k,) * 2)
    return spark.readStream.schema(SIDES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_shuffled_arrival_gives_the_batch_result(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, 1, 7 if i % 3 else int(rng.integers(1, 5)), i // 6, int(rng.integers(2))) for i in range(1, 241)]
    mixed = [rows[i] for i in rng.permutation(len(rows))]
    batches = [rows[:60], mixed[:70] + rows[:5], rows[60:120], mixed[70:], [], rows]  # repeats and empty batches among them
    sink = streaming.PriorCounts(spark, str(tmp_path / "tables"))
    sink.run(arriving(spark, tmp_path, [b for b in batches if b]))
    events = [{"team": r[2], "t": r[3], "win": r[4]} for r in rows]
    got = {r["match_id"]: (r["n_before"], r["wins_before"]) for r in sink.result().collect()}
    assert got == {r[0]: before(events, r[2], r[3]) for r in rows}
    seen = front = None
    late, seen = 0, set()
    for b in batches:
        fresh = {r[0]: r for r in b if r[0] not in seen}
        late += sum(front is not None and r[3] <= front for r in fresh.values())
        seen |= set(fresh)
        front = max([r[3] for r in fresh.values()] + ([] if front is None else [front]), default=front)
    assert sink.late().count() == late > 20


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    sink = streaming.PriorCounts(spark, str(tmp_path / "tables"))
    rows = [[(1, 1, 7, 10, 1), (2, 1, 7, 20, 0)], [(3, 1, 7, 15, 1), (4, 1, 7, 30, 1)]]
    for k in (0, 1, 1):
        sink(spark.createDataFrame(rows[k], SIDES), k)
    assert {r["match_id"]: (r["n_before"], r["wins_before"]) for r in sink.result().collect()} == {1: (0, 0), 2: (2, 2), 3: (1, 1), 4: (3, 2)}
    assert [r["match_id"] for r in sink.late().collect()] == [3]
    sink(spark.createDataFrame([(5, 1, 7, 30, 0), (6, 1, 7, 31, 0)], SIDES), 2)  # at the frontier: late, and not before its own moment
    got = {r["match_id"]: (r["n_before"], r["wins_before"]) for r in sink.result().collect()}
    assert got[5] == got[4] == (3, 2) and got[6] == (5, 3)


def test_a_small_batch_asks_for_little(spark, tmp_path, monkeypatch):
    """A batch looks for cells of time only if it could have two, and learns schemas and the frontier from what it has written."""
    sink = streaming.PriorCounts(spark, str(tmp_path / "tables"))
    rows = [[(1, 1, 7, 10, 1), (2, 1, 7, 20, 0)], [(3, 1, 7, 15, 1), (4, 1, 7, 30, 1)]]
    monkeypatch.setattr(prefix, "cuts", None)
    sink(spark.createDataFrame(rows[0], SIDES), 0)
    sc, group = spark.sparkContext, "a small batch"
    sc.setJobGroup(group, group)
    sink(spark.createDataFrame(rows[1], SIDES), 1)
    sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(sc.statusTracker().getJobIdsForGroup(group))
    assert jobs <= 30, jobs
    # another object over the same tables goes on from them
    more = streaming.PriorCounts(spark, str(tmp_path / "tables"))
    more(spark.createDataFrame([(5, 1, 7, 12, 0)], SIDES), 2)
    assert {r["match_id"]: (r["n_before"], r["wins_before"]) for r in more.result().collect()} == {1: (0, 0), 5: (1, 1), 3: (2, 1), 2: (3, 2), 4: (4, 2)}


def test_only_identities_of_one_name_are_compared(spark):
    rows = [("A", 1, 10), ("A", 1, 11), ("A", 2, 10), ("A", 2, 11), ("A", 2, 11), ("A", 3, 12), ("A", 3, None), ("B", 4, 10), ("B", 5, None)]
    df = spark.createDataFrame(rows, "name string, id long, player long")
    assert [tuple(r) for r in quality.overlaps(df, "name", "id").collect()] == [("A", 1, 2, 2)]


def test_spellings_merge_only_with_shared_players(spark):
    games = [
        ("Alpha", 1, [1, 2], "e1", 0), ("Alpha", 2, [1, 2], "e2", 10), ("ALPHA", 3, [2, 3], "e3", 200),  # a shared player
        ("Beta", 4, [11], "e1", 0), ("beta", 5, [12], "e2", 900),  # marks and case alone
        ("Gamma", 6, [21], "e1", 0), ("Gamma", 7, [22], "e2", 60),  # near in time, none shared
        ("Delta", 8, [31], "e1", 0), ("Delta", 9, [32], "e2", 61),  # far apart
        ("Eps", 10, [41], "e9", 0), ("Eps", 11, [42], "e9", 500),  # one event
        ("Zeta", 12, [51], "e1", 0), ("Zeta", 13, [None], "e1", 1),  # roster unknown
        ("mix3", 14, [61], "e1", 0), ("", 15, [71], "e1", 0),
    ]
    rows = [(n, i, p, e, d * DAY) for n, i, players, e, d in games for p in players]
    df = spark.createDataFrame(rows, "name string, id long, player long, event string, t long")
    got = {r["name"]: (r["canonical"], r["resolution"]) for r in quality.resolve_names(df, "name", "id", "event").collect()}
    assert got == {
        "Alpha": ("Alpha", "normalized"), "ALPHA": ("Alpha", "normalized"), "Beta": ("Beta", "unresolved"), "beta": ("beta", "unresolved"), "Gamma": ("Gamma", "unresolved"),
        "Delta": ("Delta", "exact"), "Eps": ("Eps", "unresolved"), "Zeta": ("Zeta", "exact"), "mix3": ("mix3", "unresolved"),
    }


def test_bootstrap_of_two_arms(spark):
    assert model_queries.REPLICATES == 2000
    rng = np.random.default_rng(5)
    rows = [(i // 2, int(rng.integers(2)), float(rng.uniform(0.1, 0.9)), float(rng.uniform(0.1, 0.9))) for i in range(60)]
    df = spark.createDataFrame(rows, "match_id long, y int, p double, p2 double")
    reps = 40
    u = spark.range(30).select(F.col("id").alias("match_id"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    drawn = {(r["rep"], r["match_id"]): r["u"] for r in u.withColumn("u", metrics.uniform(F.lit(42), F.col("rep"), F.col("match_id"))).collect()}
    cdf = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(18)])
    want = {}
    y, m = np.array([r[1] for r in rows]), [r[0] for r in rows]
    for rep in range(1, reps + 1):
        c = np.array([(drawn[rep, k] >= cdf).sum() for k in m])
        arms = []
        for p in (np.array([r[2] for r in rows]), np.array([r[3] for r in rows])):
            arms.append([np.average(v, weights=c) for v in ((p >= 0.5) == (y == 1), -np.log(np.where(y == 1, p, 1 - p)), (p - y) ** 2)])
        for k, name in enumerate(("accuracy", "log_loss", "brier")):
            want.setdefault(name, []).append(arms[0][k])
            want.setdefault(f"delta_{name}", []).append(arms[0][k] - arms[1][k])
    got = {r["metric"]: (r["low"], r["high"]) for r in metrics.bootstrap(df, "match_id", reps, other="p2").collect()}
    assert set(got) == set(want)
    for name, v in want.items():
        assert got[name] == pytest.approx(tuple(np.percentile(v, [2.5, 97.5])), abs=1e-9)
