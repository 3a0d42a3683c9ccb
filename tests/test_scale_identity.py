"""Counts of close strangers and witnesses against all pairs."""

import random

from pyspark.sql import functions as F

from skirmish.functions import DAY
from skirmish.operators import identity, prefix, quality


def test_close_counts_equal_pairs(spark, monkeypatch):
    """Rosters of up to twelve players, eras that overlap, touch the limit to the microsecond or repeat; no pairs of small rosters are made."""
    rng = random.Random(5)
    rows = []
    for name in ("a", "b", "c"):
        for era in range(60):
            first = rng.choice([0, 5, 61, 61 * DAY // DAY, 300]) * DAY + rng.choice([-1, 0, 1]) + rng.randint(0, 40) * DAY
            size = 12 if era % 15 == 7 else rng.randint(1, 4)
            rows.append((name, era, sorted(rng.sample(range(14), size)), first, first + rng.choice([0, 0, 3, 90]) * DAY))
    rows += [("d", 1, [1, 2], 0, 0), ("d", 2, [1, 3], 1, 1), ("e", 1, [1], 0, 0), ("e", 2, [2], 61 * DAY - 1, 61 * DAY), ("f", 1, [1], 0, 0), ("f", 2, [2], 61 * DAY, 61 * DAY)]
    eras = spark.createDataFrame(rows, "name string, era long, roster array<long>, first_t long, last_t long")
    want = {r["name"]: r["n"] for r in identity.close_strangers(eras, "name").groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert set(want) == {"a", "b", "c", "e"}
    for cells in (prefix.CELL_ROWS, 50):
        monkeypatch.setattr(prefix, "CELL_ROWS", cells)
        assert {r["name"]: r["close_events"] for r in identity.close_counts(eras, "name").collect()} == want


def test_review_makes_no_pairs(spark, monkeypatch):
    """Of 3000 eras of one name no join has more rows than a few times the eras (close pairs: millions)."""
    plans = []
    monkeypatch.setattr(identity, "close_strangers", lambda eras, name, days=60, beyond=-1: plans.append(beyond) or eras.where("false").select(name, F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("gap_days")))
    games = spark.range(3000).select(F.lit("x").alias("name"), F.col("id").alias("match_id"), (F.col("id") * 1_000_000).alias("t"), F.col("id").alias("player"))
    (row,) = identity.review(games, "name").collect()
    assert row["close_events"] == 3000 * 2999 // 2 and plans == [identity.SUBSETS]


def test_names_settled_by_witnesses(spark, monkeypatch):
    """Names are those of all pairs, in one block or in several; all pairs are asked only for names without a near witness and without
    a player that all have."""
    asked = []
    whole = quality.strangers_in
    monkeypatch.setattr(quality, "strangers_in", lambda known, name, *more: asked.append(sorted(r[0] for r in known.select(name).distinct().collect())) or whole(known, name, *more))
    rng = random.Random(2)
    rows = [("many", i, "e", i * DAY, p) for i in range(40) for p in (i, i + 1)]
    rows += [("one", i, "e", i * DAY, p) for i in range(40) for p in (7, 100 + i)]
    # every two neighbours share a player, the first and the tenth do not; "event": far apart in time, but of one event
    for name, e, gap in (("open", "e{}", 1), ("event", "e", 90), ("apart", "e{}", 90)):
        rows += [(name, i, e.format(i), i * gap * DAY, p) for i in range(10) for p in ([1, 2] if i == 0 else [2, 3] if i < 9 else [3, 4])]
    # no two lack a common player
    rows += [("dense", i, f"e{i}", i * DAY, p) for i in range(30) for p in range(11) if p not in (i % 11, (i * 3) % 11)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, team long, event string, t long, player long")
    for block in (quality.BLOCK, 3):
        monkeypatch.setattr(quality, "BLOCK", block)
        assert {r["name"] for r in quality.close_strangers(df, "name", "team", "event").collect()} == {"many", "open", "event"}
    assert asked == 4 * [["apart", "dense", "event", "open"]]
