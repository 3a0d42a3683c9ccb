"""Readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, all columns as text, blanks as empty text: the file of all tiers, lookups of players, teams, tournaments."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).options(header=True, nullValue="\u0000", emptyValue="").csv(path).fillna("")


def read_tiers(spark: SparkSession, paths: dict[str, str], columns: list[str]) -> DataFrame:
    """One CSV for each tier, as read_text(), with the tier as a column."""
    out = None
    for tier, path in paths.items():
        one = read_text(spark, path, columns).withColumn("tier", F.lit(tier))
        out = one if out is None else out.unionByName(one)
    return out


def write_text(rows: DataFrame, path: str) -> None:
    """A CSV of text columns with a header, e.g. of rejected rows with their reasons; nulls and blanks are blank."""
    rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns]).write.csv(path, header=True, emptyValue="")


def read_tables(spark: SparkSession, folder: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(spark.read.parquet(f"{folder}/{n}.parquet") for n in names)


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, to prove that inputs have not changed."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def publish(df: DataFrame, path: str) -> None:
    """Writes to a staging folder first; then the old table is renamed aside, the new one takes its name, and the old one is
    deleted. If the new one cannot take the name, the old one gets it back."""
    spark = df.sparkSession
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    jvm = spark.sparkContext._jvm
    place, made = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staging)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(place)
    if had and not fs.rename(place, old):
        raise OSError(f"cannot rename {path} aside")
    if not fs.rename(made, place):
        if had:
            fs.rename(old, place)
        raise OSError(f"cannot rename {staging} to {path}")
    if had:
        fs.delete(old, True)


def snapshot(ledger: DataFrame, as_of, time: str = "dt") -> DataFrame:
    """What a ledger held strictly before a moment; written as Parquet it is a snapshot, from which replay goes on."""
    return ledger.where(F.col(time) < F.lit(as_of))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def remaining(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The part of a work plan that no checkpoint has yet."""
    return plan.join(done, keys, "left_anti")
