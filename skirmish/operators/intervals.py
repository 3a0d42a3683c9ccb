"""Bootstrap intervals of ROC-AUC over clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .draws import Copies, copies_of
from .metrics import drawing, tasks

#: Rows whose copies are a matrix at once: a replicate's sum over them fits in 16 bits.
BLOCK = 1_000
SWEPT = "first double, pos array<double>, neg array<double>, won array<double>"


def _sweep(copies: Copies | None, replicates: int) -> Callable[[Iterator], Iterator]:
    """Goes through rows in order of the score, then of the outcome. A batch's copies are a matrix (rows x replicates), equal rows are added up, and
    the last score of a batch, which may go on, waits for the next one."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        first = tie = None
        pos, neg, won, tie_pos, tie_neg = (np.zeros(replicates) for _ in range(5))

        def settle() -> None:
            nonlocal pos, neg, won
            won += tie_pos * (neg + tie_neg / 2)
            pos += tie_pos
            neg += tie_neg

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                p, plus = np.asarray(part.column(0)), np.asarray(part.column(1)) == 1
                drawn = copies_of(part, "cluster", copies, replicates)
                edge = [0, *(np.flatnonzero((p[1:] != p[:-1]) | (plus[1:] != plus[:-1])) + 1), len(p)]
                for a, b in zip(edge, edge[1:], strict=False):
                    if first is None:
                        first = tie = p[a]
                    elif p[a] != tie:
                        settle()
                        tie, tie_pos, tie_neg = p[a], np.zeros(replicates), np.zeros(replicates)
                    same = tie_pos if plus[a] else tie_neg
                    same += np.add.reduce(drawn[a:b], axis=0, dtype=np.uint16)
        if first is not None:
            settle()
            lists = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (pos, neg, won)]
            yield pa.RecordBatch.from_arrays([pa.array([float(first)]), *lists], names=["first", "pos", "neg", "won"])

    return run


def auc_by_replicate(rows: DataFrame, cluster: str, replicates: int, seed: int = 42, y: str = "y", p: str = "p") -> DataFrame:
    """(rep, auc): exact ROC-AUC of each replicate with average ranks for ties, null where it drew one class only.

    Draws are those of metrics.bootstrap(). Rows are shuffled once, by ranges of the score, and get their copies after that;
    a task goes through its range in order with one sum a replicate in hand, whatever the number of rows or ties. Ranges
    meet in their sums alone. Rows without a score or an outcome are left out; an empty table gives no replicates.
    """
    some = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(F.col(p).cast("double").alias("p"), F.col(y).cast("int").alias("y"), F.col(cluster).alias("cluster"))
    ranges, copies = drawing(some.repartitionByRange(tasks(some), "p").sortWithinPartitions("p", "y"), "cluster", replicates, seed)
    ranges = ranges.mapInArrow(_sweep(copies, replicates), SWEPT)
    each = ranges.select("first", F.posexplode(F.arrays_zip("pos", "neg", "won")).alias("k", "z")).select("first", (F.col("k") + 1).alias("rep"), "z.*")
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("rep").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = each.withColumn("won", F.col("won") + F.col("pos") * below).groupBy("rep").agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return total.select("rep", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos") * F.col("neg"))).alias("auc"))


def auc_interval(rows: DataFrame, cluster: str, replicates: int, seed: int = 42, y: str = "y", p: str = "p", other: str | None = None) -> DataFrame:
    """(metric, low, high, valid, skipped): percentile interval of the AUC, and with another arm of the delta p - other on
    the same draws. Replicates of one class are skipped and counted."""
    values = auc_by_replicate(rows, cluster, replicates, seed, y, p)
    named = [F.struct(F.lit("auc").alias("metric"), F.col("auc").alias("value"))]
    if other:
        values = values.join(auc_by_replicate(rows, cluster, replicates, seed, y, other).withColumnRenamed("auc", "other"), "rep")
        named.append(F.struct(F.lit("delta_auc").alias("metric"), (F.col("auc") - F.col("other")).alias("value")))
    each = values.select(F.explode(F.array(*named)).alias("m")).select("m.*")
    return each.groupBy("metric").agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.count("value").alias("valid"), (F.count("*") - F.count("value")).alias("skipped"))
