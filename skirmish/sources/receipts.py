"""Receipts of published tables, and protocols that can be opened once."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.contracts import table_hash
from . import content_hashes


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Creates a small file; FileExistsError if it is there. The file system decides who comes first."""
    place, fs = _at(spark, path)
    try:
        out = fs.create(place, False)
    except Exception as e:
        if fs.exists(place):
            raise FileExistsError(path) from e
        raise
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def receipt(df: DataFrame, path: str, inputs: Mapping[str, str] = {}, **facts) -> dict:
    """Writes what proves a table later, as JSON of sorted keys, and returns it: rows and hash of the table, its columns, the hashes of the input
    files by name (a path each), and given facts such as a seed. A receipt is never written over."""
    spark, made = df.sparkSession, table_hash(df).first()
    files = {n: {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in content_hashes(spark, p).collect()} for n, p in inputs.items()}
    out = {"rows": made["rows"], "sha256": made["sha256"], "columns": dict(sorted(df.dtypes)), "inputs": files, "facts": facts}
    write_new(spark, path, json.dumps(out, sort_keys=True, separators=(",", ":")))
    return out


def verify(df: DataFrame, path: str, inputs: Mapping[str, str] = {}) -> list[str]:
    """What of a receipt does not hold any more: names of rows, sha256, columns, inputs; empty if all holds."""
    spark, was = df.sparkSession, json.loads(read_text(df.sparkSession, path))
    made = table_hash(df).first()
    wrong = [n for n in ("rows", "sha256") if made[n] != was[n]]
    wrong += ["columns"] * (dict(sorted(df.dtypes)) != was["columns"])
    for n, p in inputs.items():
        if {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in content_hashes(spark, p).collect()} != was["inputs"].get(n):
            wrong.append(f"inputs: {n}")
    return wrong


def freeze(spark: SparkSession, path: str, protocol: Mapping) -> None:
    """Writes a protocol (what will be measured, with which seeds and limits) that cannot be changed afterwards."""
    write_new(spark, f"{path}/protocol.json", json.dumps(dict(protocol), sort_keys=True))


def open_once(spark: SparkSession, path: str, who: str) -> dict:
    """The frozen protocol, for one run only: a second opening, by anyone, is a FileExistsError, and so a test set is looked at once."""
    protocol = json.loads(read_text(spark, f"{path}/protocol.json"))
    write_new(spark, f"{path}/opened.json", json.dumps({"by": who}))
    return protocol
