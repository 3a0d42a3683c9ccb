"""The test tables as streams of matches and of player observations, in DataFrames and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import micros
from ..operators.streams import sides
from ..scratch import kept
from ..sources import read_tables

LINE_ORDER = ["l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with two lines at least is a match of the suppliers of its first two lines."""
    lines, orders, part = read_tables(spark, sf_dir, "lineitem", "orders", "part")
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    two = lines.select(*dict.fromkeys(["l_orderkey", *LINE_ORDER])).withColumn("rn", rn).where("rn <= 2")
    pick = lambda c, k: F.max(F.when(F.col("rn") == k, F.col(c)))
    pairs = two.groupBy("l_orderkey").agg(F.max("rn").alias("n"), pick("l_suppkey", 1).alias("team1"), pick("l_suppkey", 2).alias("team2"), pick("l_quantity", 1).cast("int").alias("score1"), pick("l_quantity", 2).cast("int").alias("score2"), pick("l_partkey", 1).alias("partkey")).where("n = 2")
    urgent = F.substring("o_orderpriority", 1, 1)
    joined = pairs.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part.select("p_partkey", F.split("p_type", " ")[0].alias("map_name")), F.col("partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("o_orderkey").alias("match_id"),
        F.col("o_orderdate").alias("dt"),
        "team1",
        "team2",
        "score1",
        "score2",
        F.when(urgent.isin("1", "2"), 1).when(urgent == "5", 5).otherwise(3).alias("best_of"),
        "map_name",
        F.concat(F.lit("tier"), (F.col("team1") % 3 + 1).cast("string")).alias("tier"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of two teams with a winner. Every tenth team is not eligible."""
    raw = raw_matches(spark, sf_dir).where("team1 <> team2 and score1 <> score2")
    return raw.withColumns({"win1": (F.col("score1") > F.col("score2")).cast("int"), "elig1": F.col("team1") % 10 != 7, "elig2": F.col("team2") % 10 != 7})


def kept_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """matches() as a table, for queries that read it more than once: lines are ranked and joined once only."""
    return kept(matches(spark, sf_dir))


def match_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides for what reads them once or keeps them itself: nothing is written."""
    return sides(matches(spark, sf_dir))


def kept_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(kept_matches(spark, sf_dir))


def player_rows(spark: SparkSession, sf_dir: str, games: DataFrame | None = None) -> DataFrame:
    """Lines of an order as players' observations: odd lines play for team 1, even ones for team 2. ``games``: matches(), if at hand."""
    (lines,) = read_tables(spark, sf_dir, "lineitem")
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    lines = lines.select(*dict.fromkeys(["l_orderkey", *LINE_ORDER])).withColumn("rn", rn)
    games = (matches(spark, sf_dir) if games is None else games).select("match_id", "dt", "team1", "team2", "elig1", "elig2", "map_name")
    rows = lines.join(games, F.col("l_orderkey") == F.col("match_id"))
    first = F.col("rn") % 2 == 1
    return rows.select(
        "match_id",
        "dt",
        micros(F.col("dt")).alias("t"),
        "map_name",
        F.when(first, 1).otherwise(2).alias("side"),
        ((F.col("rn") + 1) / 2).cast("int").alias("slot"),
        F.when(first, F.col("team1")).otherwise(F.col("team2")).alias("team"),
        F.when(first, F.col("elig1")).otherwise(F.col("elig2")).alias("elig"),
        (F.col("l_partkey") % 200).alias("player"),
        (F.col("l_quantity") + 50).alias("adr"),
        (F.col("l_discount") * 10).alias("kast"),
        (F.col("l_tax") - 0.04).alias("kd"),
        (F.col("l_quantity") % 7 / 10).alias("apr"),
    )


#: The same rows for DuckDB: raw, series, sides and players.
SQL = """
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS rn FROM lineitem),
raw AS (
  SELECT o_orderkey AS match_id, o_orderdate AS dt, a.l_suppkey AS team1, b.l_suppkey AS team2,
    CAST(a.l_quantity AS INTEGER) AS score1, CAST(b.l_quantity AS INTEGER) AS score2,
    CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 1 WHEN o_orderpriority[1] = '5' THEN 5 ELSE 3 END AS best_of,
    split_part(p_type, ' ', 1) AS map_name, 'tier' || CAST(a.l_suppkey % 3 + 1 AS VARCHAR) AS tier
  FROM orders JOIN lines a ON a.l_orderkey = o_orderkey AND a.rn = 1 JOIN lines b ON b.l_orderkey = o_orderkey AND b.rn = 2
  JOIN part ON p_partkey = a.l_partkey),
series AS (SELECT *, CAST(score1 > score2 AS INTEGER) AS win1, team1 % 10 <> 7 AS elig1, team2 % 10 <> 7 AS elig2 FROM raw WHERE team1 <> team2 AND score1 <> score2),
sides AS (
  SELECT match_id, dt, epoch_us(dt) AS t, best_of, map_name, tier, 1 AS side, team1 AS team, team2 AS opp, win1 AS win, score1 AS sf, score2 AS sa, elig1 AS elig, elig2 AS trusted,
    CAST(score1 - score2 AS DOUBLE) AS margin, CASE WHEN score1 + score2 > 0 THEN (score1 - score2) / CAST(score1 + score2 AS DOUBLE) ELSE 0 END AS norm_margin FROM series
  UNION ALL
  SELECT match_id, dt, epoch_us(dt), best_of, map_name, tier, 2, team2, team1, 1 - win1, score2, score1, elig2, elig1,
    CAST(score2 - score1 AS DOUBLE), CASE WHEN score1 + score2 > 0 THEN (score2 - score1) / CAST(score1 + score2 AS DOUBLE) ELSE 0 END FROM series),
ledger AS (SELECT * FROM sides WHERE elig),
players AS (
  SELECT match_id, dt, epoch_us(dt) AS t, map_name, CASE WHEN rn % 2 = 1 THEN 1 ELSE 2 END AS side, CAST((rn + 1) // 2 AS INTEGER) AS slot,
    CASE WHEN rn % 2 = 1 THEN team1 ELSE team2 END AS team, CASE WHEN rn % 2 = 1 THEN elig1 ELSE elig2 END AS elig,
    l_partkey % 200 AS player, l_quantity + 50 AS adr, l_discount * 10 AS kast, l_tax - 0.04 AS kd, l_quantity % 7 / 10 AS apr
  FROM lines JOIN series ON l_orderkey = match_id)
"""


def sql(query: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([SQL.strip(), *[c.strip() for c in ctes]]) + "\n" + query.strip()
