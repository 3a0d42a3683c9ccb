"""Boosted trees, their Shapley values, paths of forests and the search over candidates, against plain versions."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.operators import boosting, explain, models, tuning
from skirmish.operators.boosting import FIT, NONE, STOP, VALIDATE, Params, Tree

COLUMNS = ["a", "b", "c"]


def matrix(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    z = 1.5 * x[:, 0] - np.abs(x[:, 1]) + rng.normal(size=n)
    x[rng.random(n) < 0.2, 2] = np.nan
    z = z + np.where(np.isnan(x[:, 2]), 1.5, 0.3 * x[:, 2])
    x[rng.random(n) < 0.1, 1] = np.nan
    return x, (z > 0).astype(int)


def frame(spark, x, y, roles):
    rows = [(i, *[None if math.isnan(v) and i % 2 else float(v) for v in r], int(k), [int(v) for v in ro]) for i, (r, k, ro) in enumerate(zip(x, y, roles))]
    return spark.createDataFrame(rows, "match_id long, a double, b double, c double, y int, roles array<int>").repartition(4)


def plain_fit(x, y, role, cuts, p):
    """The same trees by recursion over rows, one node after the other: ([(values of all rows)], losses)."""
    fit, stop = role == FIT, role == STOP
    margin, outs, losses = np.zeros(len(x)), [], []
    for _ in range(p.rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        out = np.zeros(len(x))

        def node(rows, depth):
            G, H = g[rows & fit].sum(), h[rows & fit].sum()
            best = None
            if depth < p.depth:
                for f in range(x.shape[1]):
                    gone = np.isnan(x[:, f])
                    for left, cut in itertools.product((False, True), cuts[f]):
                        go = np.where(gone, left, x[:, f] <= cut) & rows
                        gl, hl = g[go & fit].sum(), h[go & fit].sum()
                        if min(hl, H - hl) < p.least_weight:
                            continue
                        s = lambda a, b: a * a / (b + p.l2)
                        gain = 0.5 * (s(gl, hl) + s(G - gl, H - hl) - s(G, H)) - p.gamma
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, go)
            if best is None:
                out[rows] = -p.rate * G / (H + p.l2)
                return
            node(best[1], depth + 1)
            node(rows & ~best[1], depth + 1)

        node(np.ones(len(x), bool), 0)
        margin = margin + out
        outs.append(out)
        q = 1 / (1 + np.exp(-margin[stop]))
        losses.append(float(np.mean(-np.log(np.where(y[stop] == 1, q, 1 - q)))) if stop.any() else 0.0)
    return outs, losses


def test_trees_equal_a_plain_replay(spark):
    x, y = matrix()
    role = np.where(np.arange(400) < 300, FIT, NONE)
    df = frame(spark, x, y, role[:, None])
    p = Params(depth=3, rate=0.3, rounds=11, least_weight=2.0)  # past one writing of the margins
    model = boosting.fit(df, COLUMNS, "y", p, F.get("roles", F.lit(0)))
    cuts = boosting.cut_points(df, COLUMNS)
    outs, _ = plain_fit(x, y, role, cuts, p)
    assert len(model.trees) == 11
    for t, want in zip(model.trees, outs, strict=True):
        assert np.abs(t.values(x, np.isnan(x)) - want).max() < 1e-9
    got = {r["match_id"]: r["m"] for r in df.select("match_id", model.margin().alias("m")).collect()}
    assert all(abs(got[i] - sum(o[i] for o in outs)) < 1e-9 for i in range(400))
    # missing values of c are good for side 1: some split sends them apart from what the cut alone would say
    assert any(f == 2 and left >= 0 for t in model.trees for f, left in zip(t.feature, t.left))


def test_rows_that_stop_a_fit(spark):
    x, y = matrix(seed=7)
    rng = np.random.default_rng(0)
    y = np.where(rng.random(400) < 0.35, 1 - y, y)  # noise, so that more trees get worse
    role = np.where(np.arange(400) < 200, FIT, STOP)
    p = Params(depth=3, rate=0.8, rounds=25, patience=3, l2=0.1, least_weight=0.1)
    df = frame(spark, x, y, role[:, None])
    fit = boosting.fit_many(df, COLUMNS, "y", [(p, 0)], F.col("roles"))[0]
    _, losses = plain_fit(x, y, role, boosting.cut_points(df, COLUMNS), p)
    n = len(fit.model.history)
    assert n < 25 and np.allclose(fit.model.history, losses[:n], atol=1e-9)
    assert len(fit.model.trees) == fit.best == int(np.argmin(losses[:n])) + 1 and n - fit.best >= 3


def test_many_fits_are_those_of_each_alone(spark):
    x, y = matrix(seed=3)
    i = np.arange(400)
    roles = np.stack([np.where(i < 150, FIT, np.where(i < 200, VALIDATE, NONE)), np.where(i < 250, FIT, np.where(i < 300, STOP, VALIDATE))], 1)
    df = frame(spark, x, y, roles)
    specs = [(Params(rounds=3), 0), (Params(rounds=10, depth=2, patience=2, rows=0.7, share=0.7), 1), (Params(rounds=2, depth=1, only=("b",)), 1)]
    together = boosting.fit_many(df, COLUMNS, "y", specs, F.col("roles"))
    for spec, fit in zip(specs, together, strict=True):
        alone = boosting.fit_many(df, COLUMNS, "y", [spec], F.col("roles"))[0]
        assert np.allclose(alone.model.margin_of(x), fit.model.margin_of(x), atol=1e-9) and fit.model.trees
    assert {f for t in together[2].model.trees for f in t.feature} == {-1, 1}


def test_columns_without_values(spark):
    x, y = np.full((50, 3), np.nan), np.arange(50) % 2
    model = boosting.fit(frame(spark, x, y, [[FIT]] * 50), COLUMNS, "y", Params(rounds=2))
    assert all(len(t.left) == 1 for t in model.trees) and np.allclose(model.margin_of(x), 0)


def known(tree, row, some, node=0):
    """The value of a tree for a row of which only some features are known, the other splits followed both ways by cover."""
    if tree.left[node] < 0:
        return tree.value[node]
    f = tree.feature[node]
    a, b = tree.left[node], tree.right[node]
    if f in some:
        left = tree.missing_left[node] if math.isnan(row[f]) else row[f] <= tree.cut[node]
        return known(tree, row, some, a if left else b)
    return (tree.cover[a] * known(tree, row, some, a) + tree.cover[b] * known(tree, row, some, b)) / tree.cover[node]


def test_shapley_values_equal_enumeration_of_subsets(spark):
    x, y = matrix(seed=5)
    df = frame(spark, x, y, [[FIT]] * 400)
    model = boosting.fit(df, COLUMNS, "y", Params(depth=4, rounds=4, rate=0.5))
    rows = {r["match_id"]: r for r in explain.contributions(df, model).collect()}
    for i in range(0, 400, 9):
        value = {s: sum(known(t, x[i], s) for t in model.trees) for k in range(4) for s in map(frozenset, itertools.combinations(range(3), k))}
        for f, name in enumerate(COLUMNS):
            rest = [g for g in range(3) if g != f]
            want = sum(math.factorial(k) * math.factorial(2 - k) / 6 * (value[frozenset({*s, f})] - value[frozenset(s)]) for k in range(3) for s in itertools.combinations(rest, k))
            assert abs(rows[i][name] - want) < 1e-9
        assert abs(rows[i]["base"] - value[frozenset()]) < 1e-9
        assert abs(rows[i]["base"] + sum(rows[i][c] for c in COLUMNS) - rows[i]["margin"]) < 1e-9


def test_groups_and_sentences(spark):
    rows = [(1, 0.5, 0.5 + 0.3 - 0.3 - 0.9, 0.3, -0.3, -0.9), (2, 0.5, 0.5, 0.0, 0.0, 0.0)]
    parts = spark.createDataFrame(rows, "match_id long, base double, margin double, a double, b double, c double")
    groups = explain.grouped(parts, {"ab": ["a", "b"], "c": ["c"]}, "base", "margin")
    assert [tuple(r) for r in groups.orderBy("match_id", "rank").collect()] == [(1, "c", -0.9, "for_team2", 1), (1, "ab", 0.0, "neutral", 2), (2, "ab", 0.0, "neutral", 1), (2, "c", 0.0, "neutral", 2)]
    said = explain.sentences(groups, {"ab": "form", "c": "maps"}).collect()
    assert [tuple(r) for r in said] == [(1, "maps is the largest factor, for_team2")]
    with pytest.raises(Exception, match="do not add up"):
        explain.grouped(parts.withColumn("margin", F.lit(9.0)), {"ab": ["a", "b"], "c": ["c"]}, "base", "margin").collect()
    with pytest.raises(ValueError):
        explain.grouped(parts, {"x": ["a"], "y": ["a"]}, "base", "margin")


def test_paths_of_many_trees_add_up(spark):
    x, y = matrix(seed=2)
    df = frame(spark, np.nan_to_num(x), y, [[FIT]] * 400)
    fit = models.trees(df, COLUMNS, "y", "forest", 60, 5)
    shares = explain.path_shares(df, fit.stages[-1], COLUMNS)
    p = {r["match_id"]: r["p"] for r in models.tree_probability(fit, df).select("match_id", "p").collect()}
    got = shares.collect()
    assert len(got) == 400 and all(abs(r["bias"] + r["a"] + r["b"] + r["c"] - p[r["match_id"]]) < 1e-9 for r in got)
    tree = fit.stages[-1].trees[0]
    alone = explain.node_arrays(tree)
    assert alone.left.count(-1) * 2 - 1 == len(alone.left) == tree.numNodes


def test_search_over_candidates_and_folds(spark):
    x, y = matrix(n=600, seed=9)
    df = spark.createDataFrame([(i, i // 2, *[None if math.isnan(v) else float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, y))], "match_id long, t long, a double, b double, c double, y int")
    rows = tuning.expanding_roles(df).cache()
    got = {r["match_id"]: r["roles"] for r in rows.collect()}
    assert got[0] == [FIT] * 5 and got[599] == [NONE, NONE, NONE, VALIDATE, FIT] and got[130] == [VALIDATE, FIT, FIT, FIT, FIT] and got[119][0] == STOP
    candidates = [Params(rounds=8, patience=3, depth=1, rate=0.01), Params(rounds=8, patience=3, depth=3, rate=0.4), Params(rounds=8, patience=3, depth=3, rate=0.4, only=("a",))]
    table, oof = tuning.search(rows, COLUMNS, "y", candidates)
    scores = {r["candidate"]: r for r in table.collect()}
    each = oof.collect()
    assert set(scores) == {0, 1, 2} and all(r["folds"] == 4 for r in scores.values())
    assert len(each) == len({(r["candidate"], r["match_id"]) for r in each}) == 3 * sum(VALIDATE in r for r in got.values())
    for c in scores:
        folds = [[-math.log(r["p"] if r["y"] else 1 - r["p"]) for r in each if r["candidate"] == c and r["fold"] == f] for f in (1, 2, 3, 4)]
        means = [np.mean(f) for f in folds]
        assert abs(scores[c]["mean_log_loss"] - np.mean(means)) < 1e-9 and abs(scores[c]["std_log_loss"] - np.std(means)) < 1e-9
    best, params = tuning.chosen(table, candidates)
    assert best == 1 and params.rounds == scores[1]["trees"]
    assert len(tuning.final_fit(rows, COLUMNS, "y", params).trees) == params.rounds
    arms = {r["fold"]: r for r in tuning.compared(oof, 1, 2).collect()}
    assert set(arms) == {1, 2, 3, 4, None} and arms[None]["delta"] < 0 and abs(arms[None]["log_loss_a"] - arms[None]["log_loss_b"] - arms[None]["delta"]) < 1e-12


def test_grid_is_drawn_with_its_seed():
    a = tuning.grid(10)
    assert a == tuning.grid(10) and len(set(a)) == 10 and a != tuning.grid(10, seed=1)
    assert {p.rounds for p in tuning.grid(3, rounds=5)} == {5}
    assert Tree().left == [] and len(tuning.grid(10**6, rows=1.0, share=1.0)) == 36


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_queries_on_whole_tables(spark):
    from skirmish.plans.catalog import QUERIES

    made = {r["split"]: r for r in QUERIES["boosted_missing"][0](spark, FOLDER).collect()}
    said = QUERIES["explain_series"][0](spark, FOLDER).collect()
    n = sum(r["n"] for r in made.values())
    assert set(made) == {"train", "validation", "test"} and len(said) == 3 * n
    assert made["train"]["log_loss"] < math.log(2)
    table = QUERIES["tuning_table"][0](spark, FOLDER).collect()
    assert len(table) == 4 and sum(r["chosen"] for r in table) == 1
    assert {r["fold"] for r in QUERIES["feature_sets"][0](spark, FOLDER).collect()} == {1, 2, 3, 4, None}
