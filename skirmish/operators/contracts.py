"""Contracts inside the plan: what is counted or refused while a table is written, not by jobs of its own."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..scratch import delete
from ..sources import publish


class Broken(ValueError):
    """A contract does not hold; ``counts`` says how many rows break each."""

    def __init__(self, counts: Mapping[str, int]):
        super().__init__(", ".join(f"{n}: {k} rows" for n, k in counts.items()))
        self.counts = dict(counts)


def observed(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``df``, and what its next run counts on the way: all rows, and the rows for which a check is not true."""
    seen = Observation(f"contract-{uuid.uuid4().hex}")
    broken = [F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()]
    return df.observe(seen, F.count("*").alias("rows"), *broken), seen


def counts(df: DataFrame, checks: Mapping[str, Column]) -> dict[str, int]:
    """Rows, and rows that break each check, from one run that writes nothing."""
    watched, seen = observed(df, checks)
    watched.write.format("noop").mode("overwrite").save()
    return seen.get


def publish_checked(df: DataFrame, path: str, checks: Mapping[str, Column], rows: int | None = None) -> dict[str, int]:
    """Writes a table beside ``path``, counting on the way, and publishes it only if all checks hold (and it has ``rows`` rows):
    otherwise what was written goes, an older table stays, and Broken says why."""
    spark = df.sparkSession
    staged = f"{path}.checked-{uuid.uuid4().hex}"
    watched, seen = observed(df, checks)
    watched.write.parquet(staged)
    got = seen.get
    broken = {n: got[n] for n in checks if got[n]} | ({"rows": got["rows"]} if rows is not None and got["rows"] != rows else {})
    try:
        if broken:
            raise Broken(broken)
        publish(spark.read.schema(df.schema).parquet(staged), path)
    finally:
        delete(spark, staged)
    return got


def required(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``df``, whose run fails at the first row for which a check is not true."""
    bad = F.lit(None).cast("string")
    for n, c in reversed(list(checks.items())):
        bad = F.when(~F.coalesce(c, F.lit(False)), n).otherwise(bad)
    return df.where(F.when(bad.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("contract broken: "), bad)).cast("boolean")))


def unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df``, which must have one row for each key: a run that meets two fails. One aggregation, whose rows are ``df``'s."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("__r") if rest else F.lit(0).alias("__r"))
    held = F.when(F.col("__n") == 1, F.col("__n")).otherwise(F.raise_error(F.lit(f"{what}: a key stands twice")).cast("long"))
    return one.withColumn("__n", held).where("__n = 1").select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join that gives no left row twice: keys of ``right`` must be unique, or the run fails."""
    return left.join(unique(right, keys, "right side"), list(keys), how)


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return unique(left, keys, "left side").join(unique(right, keys, "right side"), list(keys), how)


def table_hash(df: DataFrame) -> DataFrame:
    """(rows, sha256) of a table as a multiset of rows: the same whatever the order of rows and columns and the partitions, another
    one after any change of a value, a row, a column's name or how often a row stands.

    Each row's sha256 (of its JSON, nulls written, columns by name) is added up in four parts, so tasks combine and nothing is
    sorted; the sums, with their number, are hashed again.
    """
    names = sorted(df.columns)
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    row = F.sha2(F.encode(text, "UTF-8"), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 16 * k + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}")
    sums = df.agg(F.count("*").alias("rows"), *[part(k) for k in range(4)])
    joined = F.concat_ws(":", F.lit(",".join(names)), F.col("rows").cast("string"), *[F.coalesce(F.col(f"s{k}").cast("string"), F.lit("0")) for k in range(4)])
    return sums.select("rows", F.sha2(F.encode(joined, "UTF-8"), 256).alias("sha256"))
