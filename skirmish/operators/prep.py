"""Feature tables for training: mirroring, imputing, encoding, splitting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefix
from .quantiles import medians


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns of a feature table are what. Directional ones change sign when the sides are swapped."""

    directional: list[str]
    symmetric: list[str] = field(default_factory=list)
    categorical: dict[str, list[str]] = field(default_factory=dict)
    target: str = "win1"
    forbidden: tuple[str, ...] = ("score", "winner")

    @property
    def numeric(self) -> list[str]:
        return [*self.directional, *self.symmetric]

    def check(self, df: DataFrame) -> None:
        """All columns are there, and none that gives the result away is among the features."""
        lacking = {*self.numeric, *self.categorical, self.target} - {*df.columns}
        leaks = [c for c in self.numeric if c == self.target or any(f in c for f in self.forbidden)]
        if lacking or leaks:
            raise ValueError(f"missing columns: {sorted(lacking)}; leaking features: {leaks}")


def mirror(rows: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The same matches seen from the other side."""
    return rows.withColumns({c: -F.col(c) for c in spec.directional} | {spec.target: 1 - F.col(spec.target)})


def augment(rows: DataFrame, spec: FeatureSpec) -> DataFrame:
    return rows.withColumn("mirrored", F.lit(0)).unionByName(mirror(rows, spec).withColumn("mirrored", F.lit(1)))


def symmetry_error(augmented: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Means of the directional features and of the target less a half: all are 0 up to rounding."""
    return augmented.agg(*[F.avg(c).alias(c) for c in spec.directional], (F.avg(spec.target) - 0.5).alias(spec.target))


def fit_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: exact median, mean and sample deviation (1 if 0) of each column, the latter two after imputing."""
    med = medians(train, columns)
    parts = []
    for c in columns:
        middle = F.lit(med[c]).cast("double")
        x = F.coalesce(c, middle)
        parts += [F.first(middle).alias(f"{c}__med"), F.avg(x).alias(f"{c}__mean"), F.coalesce(F.nullif(F.stddev_samp(x), F.lit(0.0)), F.lit(1.0)).alias(f"{c}__std")]
    return train.agg(*parts)


def scale(rows: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """Median for null, then z-scores. ``fitted`` is one row, so broadcasting it is bounded."""
    out = rows.join(F.broadcast(fitted))
    made = {c: (F.coalesce(c, f"{c}__med") - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in columns}
    return out.withColumns(made).select(*rows.columns)


def one_hot(rows: DataFrame, column: str, vocabulary: list[str], reference: str) -> DataFrame:
    """0/1 columns for all values but the reference; values outside the vocabulary have a column of their own."""
    known = F.coalesce(F.col(column).isin(vocabulary), F.lit(False))
    cols = {f"{column}={v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in vocabulary if v != reference}
    return rows.withColumns(cols | {f"{column}=unknown": (~known).cast("int")})


def cumulative_times(rows: DataFrame, time: str = "t") -> DataFrame:
    """(time, before, upto): how many rows come before and up to each distinct time.

    A running sum over all times would need one task. Times are cut into cells of about equal numbers of times, however far apart they
    lie; counts within a cell run in parallel, and the cells' totals, few numbers, are summed apart and joined back.
    """
    each = rows.groupBy(time).agg(F.count("*").alias("n"))
    made = prefix.running(each, [], {"upto": F.col("n")}, [], time, prefix.cuts(each, time))
    return made.select(time, (F.col("upto") - F.col("n")).alias("before"), "upto")


def boundary(counts: DataFrame, target: float, time: str = "t"):
    """The time whose count up to it is nearest to the target (the first of two)."""
    row = counts.agg(F.min_by(time, F.struct(F.abs(F.col("upto") - F.lit(target)), F.col(time))).alias("b")).first()
    return row["b"]


def chronological_split(rows: DataFrame, shares: tuple[float, float] = (0.70, 0.15), time: str = "t") -> DataFrame:
    """train, validation or test by time; rows of one time are never parted."""
    counts = cumulative_times(rows, time)
    total = counts.agg(F.max("upto")).first()[0] or 0
    first, second = boundary(counts, total * shares[0], time), boundary(counts, total * (shares[0] + shares[1]), time)
    return rows.withColumn("split", F.when(F.col(time) <= first, "train").when(F.col(time) <= second, "validation").otherwise("test"))


def blocks(rows: DataFrame, n: int = 5, time: str = "t") -> DataFrame:
    """Adds block 1..n, of about equal size, by time; rows of one time share a block."""
    counts = cumulative_times(rows, time)
    total = counts.agg(F.max("upto")).first()[0] or 0
    cuts = [boundary(counts, total * k / n, time) for k in range(1, n)]
    block = F.lit(1)
    for c in cuts:
        block = block + (F.col(time) > c).cast("int")
    return rows.withColumn("block", block)


def expanding_folds(blocked: DataFrame, n: int = 5) -> DataFrame:
    """(fold, part, ...): fold f trains on blocks 1..f and validates on f + 1."""
    folds = F.explode(F.sequence(F.lit(1), F.lit(n - 1)))
    out = blocked.withColumn("fold", folds).where(F.col("block") <= F.col("fold") + 1)
    return out.withColumn("part", F.when(F.col("block") <= F.col("fold"), "train").otherwise("validation"))


def early_stop_split(train: DataFrame, share: float = 0.15, time: str = "t") -> DataFrame:
    """Marks the latest share of the rows, by whole times, for early stopping."""
    counts = cumulative_times(train, time)
    total = counts.agg(F.max("upto")).first()[0] or 0
    cut = boundary(counts, total * (1 - share), time)
    return train.withColumn("inner", F.when(F.col(time) <= cut, "fit").otherwise("stop"))


def clipped(p: Column, eps: float = 1e-15) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
