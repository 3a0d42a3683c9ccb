"""States that merge, contracts inside a run, content hashes, receipts, protocols opened once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from skirmish.functions import DAY
from skirmish.operators import contracts, history, states
from skirmish.sources import receipts
from tests.test_history import by, stream


def plain(df):
    return sorted(str(r.asDict(recursive=True)) for r in df.collect())


def near(a, b):
    """Rows equal but for the last digits of their numbers."""
    a, b = a.collect(), b.collect()
    key = lambda r: str([r[k] for k in r.asDict() if not isinstance(r[k], float)])
    assert len(a) == len(b)
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        for k, v in x.asDict().items():
            assert y[k] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v)


@pytest.fixture(scope="module")
def ledger(spark):
    rng = random.Random(6)
    rows = [(i, 1, rng.randint(1, 6), rng.randint(0, 400) * DAY, rng.choice([1, 3]), rng.choice("mn"), rng.randint(0, 1), float(rng.randint(-5, 5)), rng.random() < 0.7) for i in range(400)]
    df = spark.createDataFrame(rows, "match_id long, side int, team long, t long, best_of int, map_name string, win int, margin double, trusted boolean")
    df = df.withColumns({"norm_margin": F.col("margin") / 10, "residual": F.col("margin") / 7, "opp_mid": 1500 + F.col("margin")})
    df.cache().count()
    return df


def test_states_merge_in_any_grouping(ledger):
    cut = 401 * DAY
    parts = [ledger.where(c) for c in (F.col("t") < 100 * DAY, F.col("t").between(100 * DAY, 250 * DAY), F.col("t") > 250 * DAY)]
    for make, bundle in ((states.series_state, True), (states.form_state, False), (states.map_state, False)):
        of = (lambda rows: make(rows, cut)) if bundle else make
        kinds = states.MERGES | ({"last": states.FORM_LAST} if make is states.form_state else {})
        a, b, c = map(of, parts)
        left = states.merged(states.merged(a, b, cut, kinds), c, cut, kinds)
        right = states.merged(a, states.merged(b, c, cut, kinds), cut, kinds)
        whole = of(ledger)
        assert set(whole) == set(left) == set(right)
        for n in whole:
            near(left[n], whole[n]) if n in ("decayed", "maps") else None
            near(right[n], whole[n]) if n in ("decayed", "maps") else None
            if n not in ("decayed", "maps"):
                assert plain(left[n]) == plain(right[n]) == plain(whole[n])
    assert all(len(r["tail"]) <= 10 for r in states.series_state(ledger, cut)["last"].collect())


def test_going_on_equals_one_pass(spark, ledger, tmp_path):
    cut = 200 * DAY
    early, late = ledger.where(F.col("t") < cut), ledger.where(F.col("t") >= cut)
    states.save(states.series_state(early, cut), str(tmp_path / "s"))
    state = states.load(spark, str(tmp_path / "s"), "team", "format", "last", "active")
    cols = ["n_before", "win_rate", "format_win_rate", "n_30d", "days_since_last", "win_last_5", "margin_last_10"]
    got, want = by(states.series_from(state, late), *cols), by(history.series_features(ledger), *cols)
    assert len(got) == late.count() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    cols = ["residual_last_5", "opp_mid_last_10", "tw_residual", "tw_mass"]
    one = history.decayed(history.last_n(ledger, (5, 10), ("residual", "opp_mid"), where=F.col("trusted")), 60, ("residual",), where=F.col("trusted"))
    got, want = by(states.form_from(states.form_state(early), late), *cols), by(one, *cols)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_a_state_of_nothing(spark, ledger):
    none = {n: df.limit(0) for n, df in states.series_state(ledger, 0).items()}
    cols = ["n_before", "n_30d", "win_last_5"]
    assert by(states.series_from(none, ledger), *cols) == by(history.series_features(ledger), *cols)


def test_roster_state(spark):
    rows = [(m, t * DAY, team, p, 70.0, 0.5, 0.1, 0.2) for m, t, team, p in [(1, 0, 1, 5), (1, 0, 1, 6), (2, 50, 1, 5), (3, 120, 2, 6), (4, 121, 1, 7)]]
    df = spark.createDataFrame(rows, "match_id long, t long, team long, player long, adr double, kast double, kd double, apr double")
    made = states.roster_state(df, 130 * DAY)
    assert sorted((r["match_id"], r["player"]) for r in made["seen"].collect()) == [(2, 5), (3, 6), (4, 7)]
    games = {r["team"]: [(g["match_id"], g["players"]) for g in r["tail"]] for r in made["games"].collect()}
    assert games == {1: [(1, [5, 6]), (2, [5]), (4, [7])], 2: [(3, [6])]}
    assert states.SEEN.merge(made["seen"], made["seen"].limit(0), 220 * DAY).count() == 0 or states.SEEN.merge(made["seen"], made["seen"].limit(0), 211 * DAY).count() == 1


def test_contracts_are_counted_while_a_table_is_written(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(10).withColumn("v", F.when(F.col("id") > 7, None).otherwise(F.col("id")))
    checks = {"known": F.col("v").isNotNull(), "small": F.col("id") < 10}
    assert contracts.counts(df, checks) == {"rows": 10, "known": 2, "small": 0}
    contracts.publish_checked(df.where("id < 5"), path, checks, rows=5)
    for bad, rows in ((df, None), (df.where("id < 4"), 5)):
        with pytest.raises(contracts.Broken) as e:
            contracts.publish_checked(bad, path, checks, rows)
    assert e.value.counts == {"rows": 4}
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_path) == ["t"]
    assert contracts.required(df.where("id < 8"), checks).count() == 8
    with pytest.raises(Exception, match="contract broken: known"):
        contracts.required(df, checks).write.format("noop").mode("overwrite").save()


def test_joins_by_contract(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, x string")
    right = spark.createDataFrame([(1, "p"), (3, "q")], "k long, y string")
    assert sorted((r["x"], r["y"]) for r in contracts.join_many_to_one(left, right, ["k"]).collect()) == [("a", "p"), ("b", "p"), ("c", None), ("d", None)]
    for join, a, b in ((contracts.join_many_to_one, right, left), (contracts.join_one_to_one, left, right)):
        with pytest.raises(Exception, match="a key stands twice"):
            join(a, b, ["k"]).collect()
    assert contracts.join_one_to_one(right, right.withColumnRenamed("y", "z"), ["k"]).count() == 2


def test_hashes_of_tables(spark):
    rows = [(i, f"t{i % 5}", None if i % 3 else i / 7) for i in range(50)]
    make = lambda r: spark.createDataFrame(r, "a long, b string, c double")
    one = contracts.table_hash(make(rows)).first()
    assert one == contracts.table_hash(make(rows[::-1]).repartition(7).select("c", "b", "a")).first() and one["rows"] == 50
    others = [rows[1:], rows + rows[:1], [*rows[:-1], (49, "t4", 0.5)], [(r[0], r[1] + " ", r[2]) for r in rows], rows[:2] + rows[1:2] + rows[3:]]
    hashes = {contracts.table_hash(make(r)).first()["sha256"] for r in others} | {one["sha256"], contracts.table_hash(make(rows).withColumnRenamed("a", "z")).first()["sha256"]}
    assert len(hashes) == len(others) + 2
    assert contracts.table_hash(make([])).first()["rows"] == 0


def test_receipts_and_protocols(spark, tmp_path):
    (tmp_path / "in.txt").write_text("x")
    df, path, inputs = spark.range(5), str(tmp_path / "receipt.json"), {"raw": str(tmp_path / "in.txt")}
    made = receipts.receipt(df, path, inputs, seed=42)
    assert made["rows"] == 5 and made["facts"] == {"seed": 42} and len(made["inputs"]["raw"]["in.txt"]) == 64
    assert receipts.verify(df.repartition(3), path, inputs) == []
    assert receipts.verify(df.where("id > 0").withColumn("id", F.col("id").cast("int")), path, {}) == ["rows", "sha256", "columns"]
    (tmp_path / "in.txt").write_text("y")
    assert receipts.verify(df, path, inputs) == ["inputs: raw"]
    with pytest.raises(FileExistsError):
        receipts.receipt(df, path)
    where = str(tmp_path / "protocol")
    receipts.freeze(spark, where, {"replicates": 2000, "seed": 42})
    with pytest.raises(FileExistsError):
        receipts.freeze(spark, where, {"replicates": 10})
    assert receipts.open_once(spark, where, "first") == {"replicates": 2000, "seed": 42}
    with pytest.raises(FileExistsError):
        receipts.open_once(spark, where, "second")


def test_ratings_go_on_from_their_state(spark):
    from skirmish.operators import ratings

    rows = stream(spark, [(i, i, 1 + i % 3, 4 + i % 2, i % 4 > 0) for i in range(24)])
    early, late = rows.where("match_id < 12"), rows.where("match_id >= 12")
    state = states.rating_state(ratings.rate(early), "team")["ratings"]
    got, want = by(ratings.rate(late, snapshot=state), "elo_before", "own_mid"), by(ratings.rate(rows), "elo_before", "own_mid")
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)
