"""Metrics of predicted probabilities: exact, by slice, with bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import WIDTHS, Copies, copies_of, poisson_steps, weighted
from .prep import clipped
from .quantiles import quantiles


def binary(rows: DataFrame, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """accuracy, precision, recall, F1 (0 where undefined), log-loss, Brier score and the confusion counts, by slice."""
    hit, pos = F.col(p) >= 0.5, F.col(y) == 1
    q = clipped(F.col(p))
    base = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.avg(-F.when(pos, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"),
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    return base.withColumns(
        {
            "accuracy": (c("tp") + c("tn")) / c("n"),
            "precision": ratio(c("tp"), c("tp") + c("fp")),
            "recall": ratio(c("tp"), c("tp") + c("fn")),
            "f1": ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
            "majority": F.greatest(c("tp") + c("fn"), c("fp") + c("tn")) / c("n"),
            "small_sample": c("n") < 30,
        }
    )


def auc(rows: DataFrame, *by: str, y: str = "y", p: str = "p", cells: int = 1024) -> DataFrame:
    """Exact ROC-AUC with average ranks for ties, null with one class.

    Equal scores are counted first. The pairs a positive wins are summed by score cell: cells in parallel, the cells'
    totals apart, so no task sorts all scores.
    """
    each = rows.groupBy(*by, F.col(p).alias("p")).agg(F.sum(F.col(y)).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))
    each = each.withColumn("cell", F.floor(F.col("p") * cells))
    w = Window.partitionBy(*by, "cell").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    inside = each.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
    parts = inside.groupBy(*by, "cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("won"))
    v = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most ``cells`` rows a slice
    parts = parts.withColumn("won", F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(v), F.lit(0.0)))
    total = parts.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return total.select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos") * F.col("neg"))).alias("auc"))


def slices(rows: DataFrame, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """Metrics of the whole and of each slice by one column at a time, in one pass (grouping sets)."""
    sets = rows.groupingSets([[], *[[c] for c in by]], *by)
    return sets.agg(F.count("*").alias("n"), F.avg(F.when((F.col(p) >= 0.5) == (F.col(y) == 1), 1.0).otherwise(0.0)).alias("accuracy"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def calibration(rows: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Fixed bins, the last one closed: n, mean probability, share of wins."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def macro(rows: DataFrame, group: str, y: str = "y", p: str = "p") -> DataFrame:
    """Means over groups of the mean log-loss and Brier score within each."""
    q = clipped(F.col(p))
    each = rows.groupBy(group).agg(F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("ll"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("br"))
    return each.agg(F.count("*").alias("groups"), F.avg("ll").alias("macro_log_loss"), F.avg("br").alias("macro_brier"))


def blend_weights(rows: DataFrame, weights: list[float], a: str = "p1", b: str = "p2", y: str = "y") -> DataFrame:
    """Log-loss and Brier score of w * a + (1 - w) * b for each weight."""
    each = rows.withColumn("w", F.explode(F.array(*[F.lit(w) for w in weights])))
    q = clipped(F.col("w") * F.col(a) + (1 - F.col("w")) * F.col(b))
    return each.groupBy("w").agg(F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"), F.avg(F.pow(q - F.col(y), 2)).alias("brier"))


def select_with_epsilon(candidates: DataFrame, epsilon: float, *tie_break) -> DataFrame:
    """The candidate that the tie-break puts first among those within epsilon of the best log-loss."""
    best = candidates.agg(F.min("log_loss").alias("__best"))
    return candidates.join(F.broadcast(best)).where(F.col("log_loss") <= F.col("__best") + epsilon).drop("__best").orderBy(*tie_break).limit(1)


def top_k(rows: DataFrame, k: int, *order) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def set_comparison(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Overlap, precision, recall and Jaccard ratio of two sets of keys."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    row = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("overlap"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count("*").alias("n_union"))
    return row.select("overlap", (F.col("overlap") / F.col("n_a")).alias("precision"), (F.col("overlap") / F.col("n_b")).alias("recall"), (F.col("overlap") / F.col("n_union")).alias("jaccard"))


def symmetry(rows: DataFrame, p: str = "p", mirrored: str = "p_mirror") -> DataFrame:
    """|p - (1 - p of the mirrored match)|: mean, median, 95th percentile and largest."""
    errors = rows.select(F.abs(F.col(p) + F.col(mirrored) - 1).alias("e"))
    got = quantiles(errors, {"e": [0.5, 0.95]})
    return errors.agg(F.avg("e").alias("mean"), F.lit(got["e", 0.5]).cast("double").alias("median"), F.lit(got["e", 0.95]).cast("double").alias("p95"), F.max("e").alias("max"))


def uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) that a seed and keys fix, the same on any cluster."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def poisson_copies(u: Column) -> Column:
    """How many copies a uniform number draws: Poisson(1) by its cumulative probabilities, as far as doubles tell them from 1."""
    return sum(((u >= cum).cast("int") for cum in poisson_steps()), F.lit(0))


def tasks(rows: DataFrame) -> int:
    """Tasks that narrow rows with many draws each are dealt to: by their size alone Spark would make a few of them, about one a core."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def drawing(rows: DataFrame, cluster: str, replicates: int, seed: int) -> tuple[DataFrame, Copies | None]:
    """Rows for a task to draw copies from by draws.copies_of(): as they are, with what draws, where the cluster is a whole number; of any other type
    the cluster gives way to the list of its copies."""
    kind = rows.schema[cluster].dataType.simpleString()
    if kind in WIDTHS:
        return rows, Copies(seed, replicates, kind)
    drawn = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda rep: poisson_copies(uniform(F.lit(seed), rep, F.col(cluster))).cast("tinyint"))
    return rows.withColumn(cluster, drawn), None


def bootstrap(rows: DataFrame, cluster: str, replicates: int, seed: int = 42, y: str = "y", p: str = "p", other: str | None = None) -> DataFrame:
    """Cluster bootstrap: (metric, low, high) percentile intervals of accuracy, log-loss and Brier score, and with the
    probabilities of another arm of the paired deltas p - other (delta_accuracy, ...) on the same draws.

    Every cluster gets in every replicate a Poisson(1) number of copies, drawn from a hash of (seed, replicate, cluster):
    draws need no order and no second pass, all arms see the same ones. A task draws for blocks of clusters and all replicates at once and adds up
    as it goes, so no draw becomes a row and the shuffle moves ``replicates`` rows a task.
    """
    names = ("accuracy", "log_loss", "brier")
    sums_of = {}
    for k, arm in enumerate([p, other] if other else [p]):
        q = clipped(F.col(arm))
        sums_of[f"accuracy{k}"] = F.sum(F.when((F.col(arm) >= 0.5) == (F.col(y) == 1), 1.0).otherwise(0.0))
        sums_of[f"log_loss{k}"] = F.sum(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q)))
        sums_of[f"brier{k}"] = F.sum(F.pow(F.col(arm) - F.col(y), 2))
    each = rows.groupBy(cluster).agg(F.count("*").alias("n"), *[v.alias(m) for m, v in sums_of.items()])
    dealt, copies = drawing(each.repartition(tasks(each)), cluster, replicates, seed)
    arms = list(sums_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gaps = np.zeros((1 + len(arms), replicates)), np.zeros((len(arms), replicates))
        for batch in batches:
            for part in (batch.slice(i, 1_000) for i in range(0, batch.num_rows, 1_000)):
                drawn = copies_of(part, cluster, copies, replicates)
                values = [part.column(part.schema.get_field_index(m)) for m in ("n", *arms)]
                total += weighted(drawn, [np.asarray(v.fill_null(0)).astype(float) for v in values])
                for k, v in enumerate(values[1:]):
                    if v.null_count:
                        gaps[k] += weighted(drawn, [np.where(np.asarray(v.is_null()), np.asarray(values[0]), 0).astype(float)])[0]
        # a sum of nothing is null
        sums = [pa.array(t, mask=g == total[0]) for t, g in zip(total[1:], gaps, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1, dtype=np.int32)), pa.array(total[0]), *sums], names=["rep", "n", *arms])

    parts = dealt.mapInArrow(run, ", ".join(["rep int", "n double", *[f"{m} double" for m in sums_of]]))
    sums = parts.groupBy("rep").agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in sums_of]).where("n > 0")
    values = {m: F.col(f"{m}0") / F.col("n") for m in names}
    if other:
        values |= {f"delta_{m}": (F.col(f"{m}0") - F.col(f"{m}1")) / F.col("n") for m in names}
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])).alias("m")
    return sums.select(named).groupBy("m.metric").agg(F.percentile("m.value", 0.025).alias("low"), F.percentile("m.value", 0.975).alias("high"))
