"""Search over candidates and folds, and comparison of feature sets, on one binned table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, metrics, prep, reports
from .boosting import FIT, NONE, STOP, VALIDATE, Boosted, Params

#: What a grid draws from: fixed values.
GRID = {"depth": [2, 3, 4], "rate": [0.05, 0.1, 0.2], "l2": [1.0, 5.0], "least_weight": [1.0, 5.0], "rows": [0.8, 1.0], "share": [0.6, 1.0]}


def grid(n: int, seed: int = 42, **given) -> list[Params]:
    """``n`` different candidates, drawn with a seed; ``given`` parameters are the same in all."""
    rng, out = np.random.default_rng(seed), {}
    most = int(np.prod([len(v) for k, v in GRID.items() if k not in given]))
    while len(out) < min(n, most):
        pick = {k: v[int(rng.integers(len(v)))] for k, v in GRID.items()} | given
        out.setdefault(Params(seed=seed, **pick))
    return list(out)


def expanding_roles(rows: DataFrame, blocks: int = 5, stop: float = 0.15, time: str = "t") -> DataFrame:
    """``rows`` with ``roles``: of expanding fold f (1 to blocks - 1) rows of blocks 1 to f fit, the latest of them, a share of
    ``stop`` by whole times, stop, and block f + 1 validates. The last role is the final fit's: all rows fit it."""
    rows = prep.blocks(rows, blocks, time)
    roles = []
    for f in range(1, blocks):
        counts = prep.cumulative_times(rows.where(F.col("block") <= f), time)
        total = counts.agg(F.max("upto")).first()[0] or 0
        cut = prep.boundary(counts, total * (1 - stop), time)
        inner = F.when(F.col(time) <= cut, FIT).otherwise(STOP)
        roles.append(F.when(F.col("block") <= f, inner).when(F.col("block") == f + 1, VALIDATE).otherwise(NONE))
    return rows.withColumn("roles", F.array(*roles, F.lit(FIT)))


def validated(rows: DataFrame, fits: list[boosting.Fit], names: Sequence[str], y: str, key: str = "match_id") -> DataFrame:
    """(candidate, fold, key, y, p) of each row that a fit validates: out-of-fold predictions, from one pass over the rows."""
    each = [F.struct(F.lit(n).alias("candidate"), F.lit(f.fold + 1).alias("fold"), f.model.probability().alias("p")) for n, f in zip(names, fits, strict=True)]
    made = rows.select(key, F.col(y).alias("y"), "roles", F.array(*each).alias("each"))
    return made.select(key, "y", "roles", F.explode("each").alias("e")).where(F.get("roles", F.col("e.fold") - 1) == VALIDATE).select("e.candidate", "e.fold", key, "y", "e.p")


def search(rows: DataFrame, columns: Sequence[str], y: str, candidates: Sequence[Params], key: str = "match_id") -> tuple[DataFrame, DataFrame]:
    """(table, out_of_fold) of candidates over the folds of ``roles`` (expanding_roles): table has candidate, folds, mean and deviation of
    the log-loss over folds, and trees, the number for a final fit (median of the folds' best, halves to even).

    All candidates and folds are fitted together, on one binned table and one aggregation for each level of a round.
    """
    folds = len(rows.select("roles").first()["roles"]) - 1
    specs = [(c, p, f) for c, p in enumerate(candidates) for f in range(folds)]
    fits = boosting.fit_many(rows, columns, y, [(p, f) for _, p, f in specs], F.col("roles"), key)
    oof = validated(rows, fits, [c for c, _, _ in specs], y, key)
    best = rows.sparkSession.createDataFrame([(c, f.best - 1) for (c, _, _), f in zip(specs, fits, strict=True)], "candidate int, best int")
    scores = reports.candidate_scores(oof, "candidate")
    trees = best.groupBy("candidate").agg(F.bround(F.median(F.col("best") + 1), 0).cast("long").alias("trees"))
    return scores.join(trees, "candidate"), oof


def chosen(table: DataFrame, candidates: Sequence[Params], epsilon: float = 0.001) -> tuple[int, Params]:
    """Of the candidates within epsilon of the least mean log-loss the steadiest, then the one with fewest trees: (number, the
    parameters of its final fit)."""
    best = metrics.select_with_epsilon(table.withColumnRenamed("mean_log_loss", "log_loss"), epsilon, "std_log_loss", "trees", "candidate").first()
    p = candidates[best["candidate"]]
    return best["candidate"], Params(**{**p.__dict__, "rounds": int(best["trees"])})


def final_fit(rows: DataFrame, columns: Sequence[str], y: str, params: Params, key: str = "match_id") -> Boosted:
    """All rows, as many trees as chosen() says, nothing to stop it."""
    return boosting.fit(rows, columns, y, params, key=key)


def compared(oof: DataFrame, a: int, b: int, key: str = "match_id") -> DataFrame:
    """Two arms, e.g. two sets of columns, on the rows that both predict: by fold and over all of them, both log-losses, their difference and
    the share of rows on which the first is nearer."""
    arm = lambda c: oof.where(F.col("candidate") == c).select("fold", key, "y", F.col("p").alias(f"p_{c}"))
    both = arm(a).join(arm(b).drop("y"), ["fold", key])
    loss = lambda p: -F.when(F.col("y") == 1, F.log(prep.clipped(F.col(p)))).otherwise(F.log(1 - prep.clipped(F.col(p))))
    both = both.withColumns({"a": loss(f"p_{a}"), "b": loss(f"p_{b}")})
    return both.rollup("fold").agg(F.count("*").alias("n"), F.avg("a").alias("log_loss_a"), F.avg("b").alias("log_loss_b"), F.avg(F.col("a") - F.col("b")).alias("delta"), F.avg((F.col("a") < F.col("b")).cast("double")).alias("a_nearer"))
