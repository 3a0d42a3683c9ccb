"""Why a model says what it says: Shapley values of boosted trees, shares of a forest's paths, groups of factors, sentences."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boosting import Boosted, Tree, arrays, numbers
from .models import direction

#: How far parts may be from what they add up to.
TOLERANCE = 1e-6


def paths(tree: Tree) -> list[tuple[float, dict[int, list[tuple[int, bool]]], dict[int, float]]]:
    """For each leaf its value, for each feature on its path the (node, left) steps, and the share of cover that they keep."""
    out = []

    def walk(node: int, steps: dict, shares: dict) -> None:
        if tree.left[node] < 0:
            out.append((tree.value[node], steps, shares))
            return
        f = tree.feature[node]
        for child, left in ((tree.left[node], True), (tree.right[node], False)):
            kept = tree.cover[child] / tree.cover[node] if tree.cover[node] > 0 else 0.0
            walk(child, {**steps, f: [*steps.get(f, []), (node, left)]}, {**shares, f: shares.get(f, 1.0) * kept})

    walk(0, {}, {})
    return out


def shapley(model: Boosted, x: np.ndarray) -> tuple[float, np.ndarray]:
    """(base, values): path-dependent Shapley values of the margin. A feature that is not known follows both ways of its splits
    by their cover; base is the value with no feature known, and base plus a row's values is its margin.

    Leaf by leaf: a leaf adds its value times the product, over its path's features, of whether the row takes the steps (known)
    or of the share of cover (unknown). For one feature, the sets of the others count by their size only, so a
    polynomial of the path's length holds all of them; rows of a batch go through together.
    """
    missing = np.isnan(x)
    base, out = 0.0, np.zeros(x.shape)
    for tree in model.trees:
        goes = [np.where(missing[:, f], d, x[:, f] <= c) if left >= 0 else None for f, c, d, left in zip(tree.feature, tree.cut, tree.missing_left, tree.left, strict=True)]
        for value, steps, shares in paths(tree):
            on = {f: np.all([goes[n] == left for n, left in s], axis=0).astype(float) for f, s in steps.items()}
            base += value * float(np.prod(list(shares.values())))
            m = len(on)
            weight = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
            for f in on:
                # coefficient k: sum over sets of k other known features
                sets = [np.ones(len(x))] + [np.zeros(len(x)) for _ in range(m - 1)]
                for j in on:
                    if j != f:
                        for k in range(m - 1, 0, -1):
                            sets[k] = sets[k] * shares[j] + sets[k - 1] * on[j]
                        sets[0] = sets[0] * shares[j]
                out[:, f] += value * (on[f] - shares[f]) * sum(w * s for w, s in zip(weight, sets, strict=True))
    return base, out


def contributions(rows: DataFrame, model: Boosted, key: str = "match_id") -> DataFrame:
    """(key, base, margin, and a column for each of the model's columns) in log-odds."""
    names = list(model.columns)
    kind = rows.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = arrays(batch, "x")
                base, values = shapley(model, x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), base)), pa.array(model.margin_of(x)), *[pa.array(values[:, i]) for i in range(len(names))]], names=[key, "base", "margin", *names])

    return rows.select(key, numbers(names).alias("x")).mapInArrow(run, ", ".join([f"`{key}` {kind}", "base double", "margin double", *[f"`{c}` double" for c in names]]))


def path_shares(rows: DataFrame, forest, columns: Sequence[str], key: str = "match_id") -> DataFrame:
    """(key, bias, a column for each of ``columns``): the tree-path decomposition of a Spark ML forest, in probability.

    Each node's step from its own share of the positive class to the child's is credited to the feature that it splits on; bias
    and parts add up to the probability. The trees go to the tasks as node arrays, so their number does not grow the plan.
    """
    trees = [node_arrays(t) for t in forest.trees]

    @F.pandas_udf("array<double>")
    def of(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, len(columns)))
        out, every = np.zeros((len(m), len(columns) + 1)), np.arange(len(m))
        for t in trees:
            feature, cut, left, right, share = (np.array(v) for v in (t.feature, t.cut, t.left, t.right, t.value))
            at = np.zeros(len(m), np.int64)
            out[:, 0] += share[0]
            while (inner := left[at] >= 0).any():
                f = feature[at]
                then = np.where(inner, np.where(m[every, f] <= cut[at], left[at], right[at]), at)
                np.add.at(out, (every[inner], f[inner] + 1), (share[then] - share[at])[inner])
                at = then
        return pd.Series(list(out / len(trees)))

    made = rows.select(key, of(numbers(columns)).alias("s"))
    return made.select(key, F.col("s")[0].alias("bias"), *[F.col("s")[i + 1].alias(c) for i, c in enumerate(columns)])


def node_arrays(tree) -> Tree:
    """A Spark ML tree as node arrays; ``value`` is a node's share of the positive class."""
    out = Tree()

    def walk(node) -> int:
        stats = list(node.impurityStats().stats())
        at = out.add(stats[1] / max(sum(stats), 1e-300), sum(stats))
        if node.getClass().getSimpleName() != "LeafNode":
            split = node.split()
            out.feature[at], out.cut[at] = split.featureIndex(), split.threshold()
            out.left[at] = walk(node.leftChild())
            out.right[at] = walk(node.rightChild())
        return at

    walk(tree._java_obj.rootNode())
    return out


def grouped(parts: DataFrame, groups: Mapping[str, Sequence[str]], base: str, total: str, key: str = "match_id") -> DataFrame:
    """(key, name, value, direction, rank): contributions by group of factors, by size, ties by name.

    Every column belongs to one group. Base and groups have to add up to the prediction: a row that does not ends the query.
    """
    names = [c for columns in groups.values() for c in columns]
    if len(names) != len(set(names)):
        raise ValueError("a column is in two groups")
    sums = {g: sum((F.col(c) for c in columns), F.lit(0.0)) for g, columns in groups.items()}
    gap = F.abs(F.col(base) + sum(sums.values(), F.lit(0.0)) - F.col(total))
    checked = F.when(gap <= TOLERANCE, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("parts do not add up: "), F.col(key).cast("string"))))
    each = parts.select(checked.alias(key), F.explode(F.array(*[F.struct(F.lit(g).alias("name"), v.alias("value")) for g, v in sums.items()])).alias("g")).select(key, "g.*")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("value")), "name"))
    return each.select(key, "name", "value", direction(F.col("value"), 1e-9).alias("direction"), rank.alias("rank"))


def sentences(groups: DataFrame, labels: Mapping[str, str], key: str = "match_id", n: int = 3) -> DataFrame:
    """(key, summary): the n largest groups in words, e.g. "map form is the largest factor, for_team1"."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("name"))
    place = F.element_at(F.array(*[F.lit(x) for x in ("the largest", "the second-largest", "the third-largest")]), F.least(F.col("rank"), F.lit(3)))
    text = F.concat(label, F.lit(" is "), place, F.lit(" factor, "), F.col("direction"))
    top = groups.where((F.col("rank") <= min(n, 3)) & (F.col("direction") != "neutral"))
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))), lambda x: x["text"]), "; ").alias("summary"))


def explain(rows: DataFrame, model: Boosted, groups: Mapping[str, Sequence[str]], key: str = "match_id") -> tuple[DataFrame, DataFrame]:
    """(contributions, groups) of the rows' predictions."""
    parts = contributions(rows, model, key)
    return parts, grouped(parts, groups, "base", "margin", key)

