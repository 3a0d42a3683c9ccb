"""Readers, publishing, streams and the entry module."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from skirmish import sources, streaming


def test_tiers_keep_blanks(spark, tmp_path):
    for tier, text in (("one", "a,b\n1,\n,x\n"), ("two", "a,b\n2,y\n")):
        (tmp_path / f"{tier}.csv").write_text(text)
    df = sources.read_tiers(spark, {t: str(tmp_path / f"{t}.csv") for t in ("one", "two")}, ["a", "b"])
    assert sorted(tuple(r) for r in df.collect()) == [("", "x", "one"), ("1", "", "one"), ("2", "y", "two")]


def test_publish_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        sources.publish(spark.range(n), path)
    assert spark.read.parquet(path).count() == 5
    assert sources.content_hashes(spark, f"{path}/*.parquet").where(F.length("sha256") != 64).isEmpty()


def test_stream_of_late_and_repeated_rows(spark, tmp_path):
    rows = [(1, 1, 7, 10, 1), (2, 1, 7, 20, 0), (3, 2, 7, 20, 1), (4, 1, 7, 30, 1)]
    df = spark.createDataFrame(rows, "match_id long, side int, team long, t long, win int")
    for part in (df.where("match_id <= 2"), df.where("match_id > 2")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["match_id"]: (r["n_before"], r["wins_before"]) for r in streaming.PriorCounts(spark, str(tmp_path / "tables")).run(stream).result().collect()}
    assert got[2] == got[3] == (1, 1) and got[4] == (3, 2)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
