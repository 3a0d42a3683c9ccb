"""Dealing of buckets with one large component and a few strays."""

import random

import numpy as np
from pyspark.sql import functions as F

from skirmish.llm.common import components, in_unlike_pairs, links_in_buckets


def test_unlike_rows_meet_and_a_large_component_comes_once(spark):
    rng = random.Random(4)
    rows = [(1, i, 0, 0) for i in range(2000)] + [(1, 5000 + i, 5000 + i, 0) for i in range(5)]
    rows += [(2, i, rng.choice([0, 0, 7, 8, 9]), 0) for i in range(150)] + [(3, i, 0, 0) for i in range(50)]
    dealt = in_unlike_pairs(spark.createDataFrame(rows, "bucket long, id long, component long, top long"), "bucket", 20).cache()
    # before: 2005 rows in 101 blocks of about 20 were dealt 101 times each, 202505 rows; bucket 3 has nothing to compare
    assert dealt.where("bucket = 1").count() < 2000 + 5 * 101 + 10
    assert dealt.where("bucket = 3").isEmpty()
    met = set()
    for key, group in dealt.toPandas().groupby(["bucket", "u", "v"]):
        for a, ca, ma in zip(group["id"], group["component"], group["mine"]):
            met |= {(key[0], a, b) for b, cb, mb in zip(group["id"], group["component"], group["mine"]) if a < b and ca != cb and (key[1] == key[2] or ma != mb)}
    of = {}
    for bucket, i, c, _ in rows:
        of.setdefault(bucket, []).append((i, c))
    assert met == {(k, min(a, b), max(a, b)) for k, m in of.items() for a, ca in m for b, cb in m if a < b and ca != cb}


def test_links_equal_those_of_all_pairs(spark):
    """Points on a line in overlapping buckets, linked when near: chains, strays that only a late member links, strays that none does."""
    rng = random.Random(9)
    value = {i: v for i, v in enumerate([*(rng.randint(0, 60) for _ in range(150)), *(rng.randint(100, 400) for _ in range(100))])}
    buckets = {b: rng.sample(sorted(value), 120) for b in range(6)}
    df = spark.createDataFrame([(b, i) for b, ids in buckets.items() for i in ids], "bucket long, id long")
    items = spark.createDataFrame(list(value.items()), "id long, items long")
    near = lambda t: np.abs(np.subtract.outer(*[np.array(t.column("items"))] * 2)) <= 3
    links = links_in_buckets(df, lambda ids: items.join(ids, items["id"] == ids["doc_id"], "left_semi"), F.abs(F.col("x") - F.col("y")) <= 3, near, 16)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    low = dict(zip(value, value))
    while True:
        new = dict(low)
        for ids in buckets.values():
            for a in ids:
                new[a] = min([new[a], *(new[b] for b in ids if abs(value[a] - value[b]) <= 3)])
        if new == low:
            break
        low = new
    assert {i: got.get(i, i) for i in value} == low
