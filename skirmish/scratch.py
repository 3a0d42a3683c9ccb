"""Tables between steps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session on this one machine, as in tests, may do without: it
    gets a temporary folder. On a cluster executors could not see that, so there it is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = os.path.join(tempfile.gettempdir(), "skirmish-shared")
    return top.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _at(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a shared file system, if it is there."""
    place, fs = _at(spark, path)
    fs.delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables of kept() that no later step reads. Any other DataFrame is left alone."""
    for df in tables:
        at = getattr(df, "_kept_at", None)
        if at:
            delete(df.sparkSession, at)


def at_once(*makers: Callable[[], DataFrame]) -> list[DataFrame]:
    """kept() of what each of ``makers`` gives, in their order. Their jobs run side by side: many small ones do not wait for each other."""
    own = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(makers)) as pool:
        return [f.result() for f in [pool.submit(own(lambda make=make: kept(make()))) for make in makers]]
