"""Queries of the raw files: written as CSV as the sources deliver them, read back as text, audited."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation, raw_games, service
from ..scratch import delete, kept, shared_dir
from ..sources import read_tables, read_text, read_tiers, write_text
from .adapter import LINE_ORDER, matches, sql
from .history_queries import WINDOWS
from .model_queries import FEATURES, SCORED, scored

RAW = ["match_id", "game_id", "is_total", "bestOf", "team1_id", "team2_id", "score1_match", "score2_match", "map_id", "team1_win", "games_played"]
TIERS = ("tier1", "tier2", "tier3")


def raw_rows(spark, sf_dir):
    """A row for each match and one for each of its first three lines, as text, with the faults that real files have: blank, negative and
    repeated game ids, blank maps, wrong flags and wrong numbers of games."""
    (lines,) = read_tables(spark, sf_dir, "lineitem")
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    maps = lines.select(*dict.fromkeys(["l_orderkey", *LINE_ORDER])).withColumn("rn", rn).where("rn <= 3").select("l_orderkey", "rn", "l_partkey")
    series = matches(spark, sf_dir)
    m, text = F.col("match_id"), lambda c: c.cast("string")
    count = maps.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    one = series.join(count, m == F.col("l_orderkey")).select(
        "tier",
        text(m).alias("match_id"),
        F.when(m % 5 == 0, "").when(m % 5 == 1, F.concat(F.lit("-"), text(m), F.lit("1"))).otherwise(F.concat(F.lit("-"), text(m), F.lit("9"))).alias("game_id"),
        F.lit("True").alias("is_total"),
        text(F.col("best_of")).alias("bestOf"),
        text(F.col("team1")).alias("team1_id"),
        text(F.col("team2")).alias("team2_id"),
        text(F.col("score1")).alias("score1_match"),
        text(F.col("score2")).alias("score2_match"),
        F.lit("").alias("map_id"),
        text(F.when(m % 11 == 0, 0).otherwise(F.col("win1"))).alias("team1_win"),
        F.when(m % 7 == 0, "").when(m % 7 == 1, text(F.col("n") + 1)).otherwise(text(F.col("n"))).alias("games_played"),
    )
    own = maps.join(series.select("match_id", "tier"), m == F.col("l_orderkey"))
    place = F.when((F.col("rn") == 3) & (m % 4 == 0), 1).otherwise(F.col("rn"))
    each = own.select("tier", text(m).alias("match_id"), F.concat(text(m), text(place)).alias("game_id"), F.lit("False").alias("is_total"), F.when(F.col("l_partkey") % 5 == 0, "").otherwise(text(F.col("l_partkey") % 7)).alias("map_id"))
    return one.unionByName(each, allowMissingColumns=True).fillna("").select("tier", *RAW)


def delivered(spark, sf_dir):
    """(rows of the tiers' files, rows of the file of all tiers), read back as text; that file lacks every hundredth match."""
    top = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    rows = kept(raw_rows(spark, sf_dir))
    for t in TIERS:
        write_text(rows.where(F.col("tier") == t).drop("tier"), f"{top}/{t}")
    write_text(rows.where("cast(match_id AS bigint) % 100 <> 1").drop("tier"), f"{top}/all")
    made = kept(read_tiers(spark, {t: f"{top}/{t}" for t in TIERS}, RAW)), kept(read_text(spark, f"{top}/all", RAW))
    delete(spark, top)
    return made


RAW_SQL = """
nl AS (SELECT l_orderkey, count(*) AS n FROM lines WHERE rn <= 3 GROUP BY 1),
files AS (
  SELECT tier, match_id, CASE match_id % 5 WHEN 0 THEN '' WHEN 1 THEN '-' || match_id || '1' ELSE '-' || match_id || '9' END AS game_id, true AS total, best_of, team1, team2, score1, score2, '' AS map_id,
    CASE WHEN match_id % 11 = 0 THEN 0 ELSE win1 END AS flag, CASE match_id % 7 WHEN 0 THEN NULL WHEN 1 THEN n + 1 ELSE n END AS said FROM series JOIN nl ON l_orderkey = match_id
  UNION ALL
  SELECT tier, match_id, match_id || CASE WHEN rn = 3 AND match_id % 4 = 0 THEN '1' ELSE rn::VARCHAR END, false, NULL, NULL, NULL, NULL, NULL, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE (l_partkey % 7)::VARCHAR END, NULL, NULL
  FROM series JOIN lines ON l_orderkey = match_id WHERE rn <= 3)"""


def on_tiers(audit):
    return lambda spark, sf_dir: audit(delivered(spark, sf_dir)[0])


def audit_lookup(spark, sf_dir):
    """Team ids of the files against a lookup file that lacks every seventh team."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    (teams,) = read_tables(spark, sf_dir, "supplier")
    write_text(teams.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("name")), path)
    lookup = kept(read_text(spark, path, ["team_id", "name"]))
    delete(spark, path)
    return raw_games.audit_lookup(delivered(spark, sf_dir)[0], ["team1_id", "team2_id"], lookup, "team_id")


def upsets(spark, sf_dir):
    """The fifty matches whose winner had the least probability."""
    return evaluation.upsets(scored(spark, sf_dir), 50).select("match_id", "y", "p", F.round("winner_p", 6).alias("winner_p"))


def override_usage(spark, sf_dir):
    """Forced results against the matches played: every ninth match forced to side 2, some of them wrongly."""
    played = matches(spark, sf_dir).select(F.col("tier").alias("stage"), F.col("match_id").alias("round"), "team1", "team2", F.when(F.col("win1") == 1, F.col("team1")).otherwise(F.col("team2")).alias("winner"))
    forced = played.where("round % 9 = 0").withColumn("winner", F.when(F.col("round") % 5 == 0, -1).otherwise(F.col("team2"))).withColumn("round", F.when(F.col("round") % 4 == 0, -F.col("round")).otherwise(F.col("round")))
    entrants = played.select(F.col("team1").alias("team")).union(played.select("team2")).distinct()
    used = service.override_usage(service.validate_overrides(forced, entrants), played)
    return used.groupBy("error", "used", "turned").agg(F.count("*").alias("n"))


QUERIES = {
    "audit_tiers": (
        lambda spark, sf_dir: raw_games.audit_tiers(*delivered(spark, sf_dir)),
        sql("SELECT tier AS tiers, match_id % 100 <> 1 AS in_all, count(DISTINCT match_id) AS matches FROM files GROUP BY 1, 2", RAW_SQL),
    ),
    "audit_totals": (
        on_tiers(raw_games.audit_totals),
        sql(
            """SELECT tier, count(*) AS matches, CAST(sum(t) AS BIGINT) AS series_rows, CAST(sum(m) AS BIGINT) AS map_rows, CAST(sum(b) AS BIGINT) AS blank_map_rows, count(*) FILTER (t = 0) AS without, count(*) FILTER (t = 1) AS one, count(*) FILTER (t > 1) AS several
FROM (SELECT tier, match_id, count(*) FILTER (total) AS t, count(*) FILTER (NOT total) AS m, count(*) FILTER (NOT total AND map_id = '') AS b FROM files GROUP BY ALL) GROUP BY ROLLUP (tier)""",
            RAW_SQL,
        ),
    ),
    "audit_game_ids": (
        on_tiers(raw_games.audit_game_ids),
        sql(
            """SELECT (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM files WHERE NOT total AND game_id <> '' GROUP BY game_id)) AS map_duplicates, count(*) FILTER (NOT total AND game_id = '') AS map_blank,
  count(*) FILTER (total AND game_id = '') AS series_blank, count(*) FILTER (total AND game_id LIKE '-%') AS series_negative,
  count(*) FILTER (total AND game_id LIKE '-%' AND game_id[2:] IN (SELECT game_id FROM files WHERE game_id NOT LIKE '-%')) AS negative_with_positive FROM files""",
            RAW_SQL,
        ),
    ),
    "audit_games_played": (
        on_tiers(raw_games.audit_games_played),
        sql("SELECT CAST(best_of AS DOUBLE) AS bo, count(*) AS series, count(said) AS checked, count(*) FILTER (said <> n) AS mismatch FROM files JOIN nl ON l_orderkey = match_id WHERE total GROUP BY 1", RAW_SQL),
    ),
    "audit_blanks": (
        on_tiers(lambda raw: raw_games.audit_blanks(raw, ["map_id", "games_played"])),
        sql("SELECT CASE WHEN total THEN 'True' ELSE 'False' END AS is_total, round(100.0 * count(*) FILTER (map_id = '') / count(*), 1) AS map_id, round(100.0 * count(*) FILTER (said IS NULL) / count(*), 1) AS games_played FROM files GROUP BY 1", RAW_SQL),
    ),
    "audit_win_flag": (
        on_tiers(raw_games.audit_win_flag),
        sql("SELECT CASE WHEN score1 > score2 THEN 'team1' ELSE 'team2' END AS winner, CAST(flag AS DOUBLE) AS flag, count(*) AS n FROM files WHERE total GROUP BY 1, 2", RAW_SQL),
    ),
    "audit_lookup": (audit_lookup, sql("SELECT count(*) AS ids, count(*) FILTER (team % 7 <> 0) AS known, count(*) FILTER (team % 7 = 0) AS missing FROM (SELECT team1 AS team FROM series UNION SELECT team2 FROM series)")),
    "upsets": (upsets, sql("SELECT match_id, y, p, round(CASE WHEN y = 1 THEN p ELSE 1 - p END, 6) AS winner_p FROM sc ORDER BY CASE WHEN y = 1 THEN p ELSE 1 - p END, match_id LIMIT 50", WINDOWS, FEATURES, SCORED)),
    "override_usage": (
        override_usage,
        sql(
            """SELECT CASE WHEN match_id % 5 = 0 THEN 'winner_not_playing' END AS error, match_id % 5 <> 0 AND match_id % 4 <> 0 AS used, match_id % 5 <> 0 AND match_id % 4 <> 0 AND win1 = 1 AS turned, count(*) AS n
FROM series WHERE match_id % 9 = 0 GROUP BY ALL"""
        ),
    ),
}
