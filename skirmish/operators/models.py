"""Models: logistic regression by gradient descent, forests and boosted trees, blends, attributions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prep import clipped


@dataclass
class Linear:
    columns: list[str]
    weights: list[float]
    bias: float
    steps: int = 0
    cost: float = 0.0

    def logit(self) -> Column:
        z = F.lit(self.bias)
        for c, w in zip(self.columns, self.weights, strict=True):
            z = z + F.col(c) * w
        return z

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.logit()))


def gradient_descent(train: DataFrame, columns: list[str], y: str, rate: float = 0.5, l2: float = 0.0, steps: int = 500, plateau: float = 1e-7, flat: float = 1e-5) -> Linear:
    """Batch gradient descent on the mean cross-entropy; the bias is not penalised.

    Each step is one aggregation: a row of sums comes to the driver. It stops when the cost has moved by less than
    ``plateau`` three times in a row or the gradient is shorter than ``flat``, and fails if the cost runs away.
    """
    data = train.select(*columns, y).persist()
    n = data.count()
    model, calm, last = Linear(columns, [0.0] * len(columns), 0.0), 0, None
    try:
        for step in range(1, steps + 1):
            p = model.probability()
            q = clipped(p, 1e-12)
            err = p - F.col(y)
            row = data.agg(F.sum(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("c"), F.sum(err).alias("b"), *[F.sum(err * F.col(c)).alias(f"g{i}") for i, c in enumerate(columns)]).first()
            grad = [row[f"g{i}"] / n + l2 / n * w for i, w in enumerate(model.weights)]
            bias = row["b"] / n
            cost = row["c"] / n + l2 / (2 * n) * sum(w * w for w in model.weights)
            if last is not None and cost > 10 * last + 1:
                raise ArithmeticError("the cost runs away; lower the rate")
            calm = calm + 1 if last is not None and abs(last - cost) < plateau else 0
            model = Linear(columns, [w - rate * g for w, g in zip(model.weights, grad, strict=True)], model.bias - rate * bias, step, cost)
            if calm >= 3 or (sum(g * g for g in grad) + bias * bias) ** 0.5 < flat:
                break
            last = cost
    finally:
        data.unpersist()
    return model


def trees(train: DataFrame, columns: list[str], y: str, kind: str = "forest", count: int = 20, depth: int = 5, seed: int = 42):
    """A forest or boosted trees of Spark ML on imputed columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    of = RandomForestClassifier(numTrees=count, maxDepth=depth, seed=seed, labelCol=y) if kind == "forest" else GBTClassifier(maxIter=count, maxDepth=depth, seed=seed, labelCol=y)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), of]).fit(train)


def tree_probability(model, rows: DataFrame, column: str = "p") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn(column, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def permutation_importance(rows: DataFrame, groups: dict[str, list[str]], probability: Column, y: str, cells: int | None = None, seed: int = 42) -> DataFrame:
    """(name, drop): how much the log-loss grows when a group's columns are exchanged between rows, together.

    Rows are dealt to cells by one hash and take the values of the next row of their cell in the order of another: every
    value is used once, all columns of a group move together, and no global order is needed. Without a number of cells there
    are 64, and on larger tables so many that a cell has about 50,000 rows.
    """
    cells = cells or max(64, rows.count() // 50_000)
    w = Window.partitionBy("__cell").orderBy("__key")
    base = rows.withColumns({"__cell": F.pmod(F.xxhash64(F.lit(seed), "match_id"), F.lit(cells)), "__key": F.xxhash64("match_id", F.lit(seed + 1))})
    loss = lambda p: F.avg(-F.when(F.col(y) == 1, F.log(clipped(p))).otherwise(F.log(1 - clipped(p))))
    out = base.agg(loss(probability).alias("loss")).withColumn("name", F.lit("(none)"))
    for name, columns in groups.items():
        moved = base.withColumns({c: F.coalesce(F.lead(c).over(w), F.first(c).over(w)) for c in columns})
        out = out.unionByName(moved.agg(loss(probability).alias("loss")).withColumn("name", F.lit(name)))
    return out


def linear_attribution(rows: DataFrame, model: Linear, groups: dict[str, list[str]]) -> DataFrame:
    """(match_id, name, value, rank): a group's share of the logit, by size; with the bias they sum to the logit."""
    weight = dict(zip(model.columns, model.weights, strict=True))
    parts = [F.struct(F.lit(name).alias("name"), sum((F.col(c) * weight[c] for c in columns), F.lit(0.0)).alias("value")) for name, columns in groups.items()]
    each = rows.select("match_id", F.explode(F.array(*parts)).alias("g")).select("match_id", "g.*")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc(F.abs("value")), "name")))


def direction(value: Column, eps: float = 1e-6) -> Column:
    return F.when(value > eps, "for_team1").when(value < -eps, "for_team2").otherwise("neutral")
