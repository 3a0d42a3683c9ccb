"""Report operators on small tables: errors, ties, nulls."""

import pytest
from pyspark.sql import functions as F

from skirmish.operators import reports
from skirmish.sources import publish


def test_trees_round_halves_to_even(spark):
    for best, want in (([116, 118], 118), ([117, 118], 118), ([118, 119], 120), ([5], 6)):
        assert reports.tree_count(spark.createDataFrame([(b,) for b in best], "best int"), "best").first()["trees"] == want


def test_inherited_splits_and_unique_lookups_fail_loudly(spark):
    maps = spark.createDataFrame([(1, 1), (2, 1)], "match_id long, game int")
    split = spark.createDataFrame([(1, "train")], "match_id long, split string")
    assert reports.inherit(maps.where("match_id = 1"), split, "match_id", "split").first()["split"] == "train"
    with pytest.raises(Exception, match="no split for 2"):
        reports.inherit(maps, split, "match_id", "split").collect()
    twice = spark.createDataFrame([(1, 0.2), (1, 0.3)], "match_id long, rate double")
    with pytest.raises(Exception, match="not unique"):
        reports.known_join(maps, twice, ["match_id"], "rate", 0.5).collect()
    got = reports.known_join(maps, twice.limit(1), ["match_id"], "rate", 0.5).orderBy("match_id").collect()
    assert got[1]["rate"] == 0.5 and [r["known"] for r in got] == [1, 0]


def test_groups_and_sentences(spark):
    rows = [(1, n, v) for n, v in (("b", 1.0), ("a", 1.0), ("c", 2.0), ("z", 0.0), ("d", -1.0))] + [(2, "a", -3.0)]
    top = reports.top_groups(spark.createDataFrame(rows, "match_id long, name string, value double"), "match_id", 2)
    got = {r["match_id"]: r["sentence"] for r in reports.sentences(top, "match_id").collect()}
    assert got == {1: "For: c, a. Against: d.", 2: "For: nothing. Against: a."}


def test_canonical_json(spark):
    made = reports.canonical_json(spark.createDataFrame([(1, None, "x")], "id long, b int, a string"), "id").first()
    assert made["json"] == '{"a":"x","b":null,"id":1}' and len(made["sha256"]) == 64


def test_participants_and_conservation(spark):
    who = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (2, 2, 1), (4, 2, 3)], "team long, stage int, seed0 int")
    got = {(r["stage"], r["problem"]) for r in reports.participants_problems(who, {1: 2, 2: 2}).collect()}
    assert got == {(2, "seeds are not 1 to n"), (None, "team entered twice")}
    sums = reports.conservation(spark.createDataFrame([(1.0, 2), (2.0, 3)], "p double, n int"), {"p": 3, "n": 6}).collect()
    assert {r["counter"]: r["holds"] for r in sums} == {"p": True, "n": False}


def test_eras_and_missing(spark):
    eras = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("b", 1, 4), ("b", 4, 5)], "team string, first_t long, last_t long")
    assert {r["team"]: r["sequential"] for r in reports.sequential(eras, "team").collect()} == {"a": True, "b": False}
    kept = reports.keep_missing(spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "x double"), ["x"]).collect()
    assert [r["x"] for r in kept] == [None, None, 2.0]


def test_publish_replaces_whole_tables(spark, tmp_path):
    at = str(tmp_path / "table")
    for n in (3, 5):
        publish(spark.range(n), at)
        assert spark.read.parquet(at).agg(F.count("*")).first()[0] == n
    assert [p.name for p in tmp_path.iterdir()] == ["table"]
