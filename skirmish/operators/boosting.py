"""Boosted trees on histograms, with a learned direction for missing values and early stopping; many fits at once.

Rows are binned once. A level of a tree is one aggregation: each task adds up gradients by (fit, node, feature, bin), missing
values in a bin of their own, Spark adds up the tasks' histograms, and the driver, which sees numbers of histograms only, picks
the splits. Fits of several parameters and folds go through the same passes over the same binned table; a fold is a role that
a row has. Margins are written to the table every few rounds, so a pass evaluates a few trees only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, kept

#: Roles of a row in a fold.
NONE, FIT, STOP, VALIDATE = 0, 1, 2, 3
#: Bins of a feature, less the one for missing values; rounds between two writings of the margins.
BINS, REFRESH = 32, 8
#: Gains this close are equal: sums of tasks come in any order.
TIE = 1e-9


@dataclass(frozen=True)
class Params:
    depth: int = 3
    rate: float = 0.1
    l2: float = 1.0
    gamma: float = 0.0
    least_weight: float = 1.0
    rows: float = 1.0
    share: float = 1.0
    rounds: int = 60
    patience: int = 10
    seed: int = 42
    only: tuple[str, ...] = ()


@dataclass
class Tree:
    """Node arrays: left < 0 marks a leaf. A row goes left if its feature is at most ``cut``, or missing and ``missing_left``."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for name, v in (("feature", -1), ("cut", 0.0), ("missing_left", False), ("left", -1), ("right", -1), ("value", value), ("cover", cover)):
            getattr(self, name).append(v)
        return len(self.left) - 1

    def leaves(self, x: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """The leaf (or, in a tree that still grows, the last node) of each row of a matrix."""
        feature, cut, default, left, right = (np.array(v) for v in (self.feature, self.cut, self.missing_left, self.left, self.right))
        at, every = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            inner = left[at] >= 0
            if not inner.any():
                return at
            f = feature[at]
            goes = np.where(missing[every, f], default[at], x[every, f] <= cut[at])
            at = np.where(inner, np.where(goes, left[at], right[at]), at)

    def values(self, x: np.ndarray, missing: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(x, missing)]


@dataclass
class Boosted:
    """A fitted model: trees over ``columns``; ``history``: mean log-loss of the rows that stop it, after each round."""

    columns: list[str]
    trees: list[Tree] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def margin_of(self, x: np.ndarray) -> np.ndarray:
        missing = np.isnan(x)
        return sum((t.values(x, missing) for t in self.trees), np.zeros(len(x)))

    def margin(self) -> Column:
        """The log-odds of a row as a column: Arrow batches through the node arrays."""
        model = self

        @F.pandas_udf("double")
        def of(x: pd.Series) -> pd.Series:
            return pd.Series(model.margin_of(np.stack(x.to_numpy()).astype(float)) if len(x) else np.zeros(0))

        return of(numbers(self.columns))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def numbers(columns: Sequence[str]) -> Column:
    """The columns as one array of doubles; nulls are NaN."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])


def cut_points(rows: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """For each column up to ``bins`` - 1 values at which it is cut, from its distribution without missing values."""
    share = [k / bins for k in range(1, bins)]
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    got = rows.agg(*[F.percentile_approx(c, share, 100 * bins).alias(f"q{i}") for i, c in enumerate(clean)]).first()
    return [np.unique(np.array(got[f"q{i}"] or [], float)) for i in range(len(columns))]


def in_bins(x: np.ndarray, cuts: list[np.ndarray], bins: int) -> np.ndarray:
    """Bin b holds what is at most the b-th cut and over the one before; ``bins`` stands for missing."""
    out = np.empty(x.shape, np.int16)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), bins, np.searchsorted(c, x[:, f], side="left"))
    return out


def arrays(batch: pa.RecordBatch, name: str, kind=float) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return np.asarray(col.flatten()).reshape(batch.num_rows, -1).astype(kind)


def best_split(g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], p: Params, allowed: np.ndarray):
    """(gain, feature, bin, missing left, left sums) of the best split of a node's histograms (features x bins, the last bin for
    missing values), or None. Ties: the first feature, the first cut, missing values to the right."""
    total_g, total_h = g[0].sum(), h[0].sum()
    score = lambda a, b: a * a / (b + p.l2)
    best = None
    for f in np.flatnonzero(allowed):
        n = len(cuts[f])
        if not n:
            continue
        gl, hl = np.cumsum(g[f, :-1])[:n], np.cumsum(h[f, :-1])[:n]
        for left, (a, b) in enumerate(((gl, hl), (gl + g[f, -1], hl + h[f, -1]))):
            gain = 0.5 * (score(a, b) + score(total_g - a, total_h - b) - score(total_g, total_h)) - p.gamma
            gain = np.where((b >= p.least_weight) & (total_h - b >= p.least_weight), gain, -np.inf)
            k = int(np.argmax(gain >= gain.max() - TIE))
            if gain[k] > TIE and (best is None or gain[k] > best[0] + TIE):
                best = (float(gain[k]), int(f), k, bool(left), float(a[k]), float(b[k]))
    return best


@dataclass
class Fit:
    """One of several fits: its parameters, its fold, and how far it has come."""

    params: Params
    fold: int
    model: Boosted
    tree: Tree = field(default_factory=Tree)
    open: list[int] = field(default_factory=list)
    allowed: np.ndarray | None = None
    done: bool = False

    @property
    def best(self) -> int:
        """Rounds until the least loss of the rows that stop it (all rounds without such rows)."""
        return int(np.argmin(self.model.history)) + 1 if self.model.history else len(self.model.trees)


def drawn(key: np.ndarray, seed: int) -> np.ndarray:
    """A uniform number for each row and seed, the same in any task."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + 1) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).astype(float) / 2.0**64


def histograms(table: DataFrame, fits: list[Fit], since: int, bins: int, features: int) -> dict[int, np.ndarray]:
    """For each active fit its sums (2, open nodes, features, bins + 1) of gradients and hessians over its rows to fit, at the first
    level also the loss and number of its rows to stop by, before this round's tree (two numbers at the end)."""
    shape = {i: (2, len(f.open), features, bins + 1) for i, f in enumerate(fits) if not f.done and f.open}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {i: np.zeros(math.prod(s) + 2) for i, s in shape.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, roles, kept_margin = arrays(batch, "bins", np.int64), arrays(batch, "roles", np.int64), arrays(batch, "margins")
            y, key = np.asarray(batch.column(batch.schema.get_field_index("y"))).astype(float), np.asarray(batch.column(batch.schema.get_field_index("key")))
            missing = x == bins
            for i, s in shape.items():
                fit = fits[i]
                margin = kept_margin[:, i] + sum((t.values(x, missing) for t in fit.model.trees[since:]), 0.0)
                p = 1 / (1 + np.exp(-margin))
                role = roles[:, fit.fold]
                if fit.open == [0]:
                    stop = role == STOP
                    q = np.clip(np.where(y[stop] == 1, p[stop], 1 - p[stop]), 1e-15, 1)
                    sums[i][-2:] += (-np.log(q).sum(), stop.sum())
                mine = role == FIT
                if fit.params.rows < 1:
                    mine &= drawn(key, fit.params.seed + 7919 * len(fit.model.trees)) < fit.params.rows
                at = fit.tree.leaves(x[mine], missing[mine])
                local = np.searchsorted(fit.open, at)
                here = (local < len(fit.open)) & (np.array(fit.open)[np.minimum(local, len(fit.open) - 1)] == at)
                rows = np.flatnonzero(mine)[here]
                g, h = (p - y)[rows], (p * (1 - p))[rows]
                slot = ((local[here][:, None] * features + np.arange(features)) * (bins + 1) + x[rows]).ravel()
                size = math.prod(s[1:])
                sums[i][:size] += np.bincount(slot, np.repeat(g, features), size)
                sums[i][size : 2 * size] += np.bincount(slot, np.repeat(h, features), size)
        for i, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["fit", "sums"])

    each = table.mapInArrow(run, "fit int, sums array<double>")
    made = each.select("fit", F.posexplode("sums").alias("at", "v")).where("v <> 0").groupBy("fit", "at").agg(F.sum("v").alias("v")).collect()
    out = {i: np.zeros(math.prod(s) + 2) for i, s in shape.items()}
    for r in made:
        out[r["fit"]][r["at"]] = r["v"]
    return out


def grow(fit: Fit, sums: np.ndarray, cuts: list[np.ndarray], bins: int) -> None:
    """Splits the open nodes of a fit's tree; what they split into is open next."""
    p, n = fit.params, len(fit.open)
    g, h = sums[:-2].reshape(2, n, len(cuts), bins + 1)
    then = []
    for k, node in enumerate(fit.open):
        if node == 0:
            fit.tree.value[0], fit.tree.cover[0] = -p.rate * g[0, 0].sum() / (h[0, 0].sum() + p.l2), h[0, 0].sum()
        found = best_split(g[k], h[k], cuts, p, fit.allowed)
        if found is None:
            continue
        _, f, b, missing_left, gl, hl = found
        gr, hr = g[k, 0].sum() - gl, h[k, 0].sum() - hl
        fit.tree.feature[node], fit.tree.cut[node], fit.tree.missing_left[node] = f, float(b), missing_left
        fit.tree.left[node] = fit.tree.add(-p.rate * gl / (hl + p.l2), hl)
        fit.tree.right[node] = fit.tree.add(-p.rate * gr / (hr + p.l2), hr)
        then += [fit.tree.left[node], fit.tree.right[node]]
    fit.open = then


def binned(rows: DataFrame, columns: Sequence[str], cuts: list[np.ndarray], y: str, roles: Column, key: str, bins: int) -> DataFrame:
    """(key, y, roles, bins), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = in_bins(arrays(batch, "x"), cuts, bins)
                cells = pa.ListArray.from_arrays(np.arange(0, made.size + 1, max(1, made.shape[1]), dtype=np.int32), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), cells], names=["key", "y", "roles", "bins"])

    some = rows.select(F.xxhash64(key).alias("key"), F.col(y).cast("int").alias("y"), roles.alias("roles"), numbers(columns).alias("x"))
    return some.mapInArrow(run, "key long, y int, roles array<int>, bins array<smallint>")


def fit_many(rows: DataFrame, columns: Sequence[str], y: str, specs: Sequence[tuple[Params, int]], roles: Column, key: str = "match_id", bins: int = BINS) -> list[Fit]:
    """Fits (parameters, fold) together. ``roles``: an array with each fold's role of a row (FIT, STOP, VALIDATE or NONE).

    A fit ends after ``rounds`` trees, or when the log-loss of its rows to stop by has not improved for ``patience`` rounds; its
    model then keeps the trees up to the best round. A node is split only where the loss falls and both sides keep a hessian of
    ``least_weight``. ``rows`` < 1: a share of the rows for each tree, by a hash; ``share`` < 1: of the columns; ``only``: the columns that it
    may use. Null and NaN are missing. What comes to the driver are histograms: fits x nodes x features x bins numbers.
    """
    cuts = cut_points(rows, columns, bins)
    fits = [Fit(p, fold, Boosted(list(columns))) for p, fold in specs]
    none = F.array(*[F.lit(0.0)] * len(fits))
    table, since = kept(binned(rows, columns, cuts, y, roles, key, bins).withColumn("margins", none)), 0
    while not all(f.done for f in fits):
        active = [f for f in fits if not f.done]
        for f in active:
            f.tree, f.open = Tree(), [0]
            f.tree.add(0.0, 0.0)
            may = np.array([not f.params.only or c in f.params.only for c in columns])
            if f.params.share < 1:
                rng = np.random.default_rng([f.params.seed, len(f.model.trees)])
                some = rng.permutation(np.flatnonzero(may))[: max(1, round(f.params.share * may.sum()))]
                may = np.isin(np.arange(len(columns)), some)
            f.allowed = may
        for level in range(max(f.params.depth for f in active)):
            for f in active:
                if level >= f.params.depth:
                    f.open = []
            if not any(f.open for f in active if not f.done):
                break
            sums = histograms(table, fits, since, bins, len(columns))
            for i, f in enumerate(fits):
                if f.done or not f.open:
                    continue
                if level == 0 and f.model.trees and sums[i][-1]:
                    f.model.history.append(float(sums[i][-2] / sums[i][-1]))
                    if len(f.model.history) - f.best >= f.params.patience:
                        f.done = True
                        continue
                grow(f, sums[i], cuts, bins)
        for f in active:
            if not f.done:
                f.model.trees.append(f.tree)
        rounds = max(len(f.model.trees) for f in fits)
        for f in active:
            # one round more than asked gives the loss after the last one
            if not f.done and len(f.model.trees) > f.params.rounds:
                f.model.trees.pop()
                f.done = True
        if not all(f.done for f in fits) and rounds - since >= REFRESH:
            older, table = table, kept(with_margins(table, fits, since, bins))
            drop(older)
            since = rounds
    drop(table)
    for f in fits:
        f.model.trees = [in_values(t, cuts) for t in f.model.trees[: f.best]]
    return fits


def with_margins(table: DataFrame, fits: list[Fit], since: int, bins: int) -> DataFrame:
    """The table with the trees since round ``since`` added to its margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, margins = arrays(batch, "bins", np.int64), arrays(batch, "margins")
                missing = x == bins
                for i, f in enumerate(fits):
                    for t in f.model.trees[since:]:
                        margins[:, i] += t.values(x, missing)
                at = batch.schema.get_field_index("margins")
                yield batch.set_column(at, "margins", pa.array(margins.tolist(), pa.list_(pa.float64())))

    return table.mapInArrow(run, table.schema)


def in_values(tree: Tree, cuts: list[np.ndarray]) -> Tree:
    """A tree whose cuts are values in place of bins."""
    cut = [float(cuts[f][int(c)]) if left >= 0 else 0.0 for f, c, left in zip(tree.feature, tree.cut, tree.left, strict=True)]
    return Tree(tree.feature, cut, tree.missing_left, tree.left, tree.right, tree.value, tree.cover)


def fit(rows: DataFrame, columns: Sequence[str], y: str, params: Params, role: Column | None = None, key: str = "match_id", bins: int = BINS) -> Boosted:
    """One model; ``role`` says which rows fit it and which stop it (all fit without it)."""
    return fit_many(rows, columns, y, [(params, 0)], F.array(F.lit(FIT) if role is None else role), key, bins)[0].model
