"""Whole events against a plain, one-team-at-a-time replay."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from skirmish.operators import tournament as T
from skirmish.plans import event_queries as Q

FOLDER = "/root/testdata/sf0.01"
on_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def matched(pool, met, options):
    best = min(range(len(options)), key=lambda k: (sum((pool[b] in met[pool[a]]) for a, b in options[k]), k))
    return [(pool[a], pool[b]) for a, b in options[best]]


def stage(seeds, strength, rounds=5):
    """{team: [wins, losses]}, the final order, the opponents and the games (round, a, b), with every favourite winning."""
    rec, met, log = {t: [0, 0] for t in seeds}, {t: [] for t in seeds}, []

    def order(teams):
        return sorted(teams, key=lambda t: (-rec[t][0], rec[t][1], -sum(rec[o][0] - rec[o][1] for o in met[t]), seeds[t]))

    for r in range(1, rounds + 1):
        ranked = order(list(seeds))
        pools = {}
        for t in ranked:
            if max(rec[t]) < 3:
                pools.setdefault(tuple(rec[t]), []).append(t)
        games = []
        for pool in pools.values():
            n = len(pool)
            if r == 1:
                games += [(pool[i], pool[i + n // 2]) for i in range(n // 2)]
            elif r <= 3:
                games += matched(pool, met, T.matchings(n))
            else:
                games += matched(pool, met, [T.pairs_of(x) for x in T.PRIORITY])
        log += [(r, a, b) for a, b in games]
        for a, b in games:
            win = strength[a] >= strength[b]
            for x, y, w in ((a, b, win), (b, a, not win)):
                rec[x][0 if w else 1] += 1
                met[x].append(y)
    return rec, order(list(seeds)), met, log


def test_matchings():
    assert [len(T.matchings(n)) for n in (2, 4, 6, 8)] == [1, 3, 15, 105]
    assert T.matchings(4)[0] == [(0, 3), (1, 2)]


def event(direct, strength):
    """{team: (stage, wins, losses, place)} of a whole event; ``direct`` holds {team: seed} by stage."""
    seeds, out = direct[1], {}
    for number in (1, 2, 3):
        rec, ranked, *_ = stage(seeds, strength)
        up = [t for t in ranked if rec[t][0] == 3]
        out |= {t: (number, *rec[t], None) for t in ranked if number == 3 or rec[t][1] == 3}
        seeds = direct.get(number + 1, {}) | {t: 9 + k for k, t in enumerate(up)}
    line = [up[i] for i in itertools.chain(*T.pairs_of(T.BRACKET))]
    while len(line) > 1:
        pairs = list(zip(line[::2], line[1::2], strict=True))
        out |= {t: (*out[t][:3], len(line)) for t in line}
        line = [a if strength[a] >= strength[b] else b for a, b in pairs]
    return out | {line[0]: (*out[line[0]][:3], 1)}


def test_favourites(spark):
    strength = {t: (t * 37) % 101 for t in range(32)}
    who = spark.createDataFrame([(t, float(strength[t]), 1 if t < 16 else 2 if t < 24 else 3, t % 16 + 1 if t < 16 else t % 8 + 1) for t in range(32)], "team long, rating double, stage int, seed0 int")
    got = {r["team"]: (r["stage"], r["wins"], r["losses"], r["place"]) for r in T.major(spark.range(1).withColumnRenamed("id", "sim"), who, T.matrix_of(who)).collect()}
    assert got == event({1: {t: t % 16 + 1 for t in range(16)}, 2: {t: t % 8 + 1 for t in range(16, 24)}, 3: {t: t % 8 + 1 for t in range(24, 32)}}, strength)


@pytest.fixture(scope="module")
def entered(spark):
    """{team: seed} by stage and {team: rating} of the entrants of the registered queries."""
    rows = Q.entrants(spark, FOLDER).collect()
    return {k: {r["team"]: r["seed0"] for r in rows if r["stage"] == k} for k in (1, 2, 3)}, {r["team"]: r["rating"] for r in rows}


@on_tables
def test_path_query(spark, entered):
    got = {r["team"]: (r["stage"], r["wins"], r["losses"], r["place"]) for r in Q.tournament_path(spark, FOLDER).collect()}
    assert len(got) == 32 and got == event(*entered)


@on_tables
def test_buchholz_query(spark, entered):
    seeds = entered[0][1]
    rec, ranked, met, _ = stage(seeds, {t: -s for t, s in seeds.items()}, 3)
    want = {(t, *rec[t], sum(rec[o][0] - rec[o][1] for o in met[t]), k) for k, t in enumerate(ranked, 1)}
    assert {tuple(r) for r in Q.buchholz(spark, FOLDER).select("team", "wins", "losses", "difficulty", "seed").collect()} == want


@on_tables
def test_priority_query(spark, entered):
    log = stage(entered[0][1], entered[1])[3]
    got = [(r["round"], r["a"], r["b"]) for r in Q.priority_pairing(spark, FOLDER).collect()]
    assert len(got) == 9 and sorted(got) == sorted(x for x in log if x[0] > 3)


def test_too_many_entrants(spark):
    who = spark.range(33).select(F.col("id").alias("team"), F.lit(1500.0).alias("rating"), F.lit(1).alias("stage"), F.lit(1).alias("seed0"))
    with pytest.raises(ValueError):
        T.matrix_of(who)
    with pytest.raises(ValueError):
        T.major(spark.range(1).withColumnRenamed("id", "sim"), who, who)


def test_simulations_do_not_depend_on_partitions(spark):
    who = spark.createDataFrame([(t, float(1500 + 7 * t), 1 if t < 16 else 2 if t < 24 else 3, t % 16 + 1 if t < 16 else t % 8 + 1) for t in range(32)], "team long, rating double, stage int, seed0 int")
    m = T.matrix_of(who)
    runs = [sorted(map(tuple, T.major(spark.range(0, 6, 1, k).withColumnRenamed("id", "sim"), who, m, seed=3).collect()), key=str) for k in (1, 3)]
    assert runs[0] == runs[1]
    one = spark.createDataFrame([r for r in runs[0]], "sim long, team long, stage int, wins int, losses int, place int")
    assert one.where("place = 1").count() == 6 and one.where("place <= 8").count() == 48
    assert one.groupBy("sim").agg(F.count("*").alias("n")).where("n <> 32").isEmpty()
