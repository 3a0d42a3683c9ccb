"""Queries of cleaning, identity and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import best_of, identity_key, to_num
from ..operators import identity, quality
from ..operators.streams import ledger
from ..sources import read_tables
from .adapter import kept_sides, matches, player_rows, raw_matches, sql


def rejects(spark, sf_dir):
    raw = quality.reject_reasons(raw_matches(spark, sf_dir), quality.series_rules())
    return raw.select("match_id", "reject_reason")


REJECTS = sql(
    """
SELECT match_id, concat_ws(';', CASE WHEN score1 IS NULL OR score2 IS NULL THEN 'missing_score' END, CASE WHEN score1 = score2 THEN 'tie' END,
  CASE WHEN best_of IS NULL THEN 'missing_bestOf' END, CASE WHEN team1 = team2 THEN 'same_team' END) AS reject_reason FROM raw"""
)


def clean_cast(spark, sf_dir):
    """Lenient numbers out of text: the digits in events' props, also blank and unparseable ones."""
    (events,) = read_tables(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 7 == 0, "x1").otherwise(F.get_json_object("props", "$.k"))
    small = F.when(F.col("event_id") % 4 == 0, "3.0").otherwise((F.col("event_id") % 6).cast("string"))
    return events.select("event_id", to_num(raw).alias("k"), best_of(small).alias("best_of"))


CLEAN = """
SELECT event_id, try_cast(nullif(trim(CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'x1' ELSE props ->> '$.k' END), '') AS DOUBLE) AS k,
  CASE WHEN event_id % 4 = 0 THEN 3 WHEN event_id % 6 IN (1, 3, 5) THEN CAST(event_id % 6 AS INTEGER) END AS best_of FROM events"""


def alias_canonicalise(spark, sf_dir):
    """Suppliers of one nation and parity go by their smallest key."""
    (s,) = read_tables(spark, sf_dir, "supplier")
    names = s.groupBy("s_nationkey", (F.col("s_suppkey") % 2).alias("p")).agg(F.min("s_suppkey").alias("canonical"))
    alias = s.join(names, (s["s_nationkey"] == names["s_nationkey"]) & (F.col("s_suppkey") % 2 == F.col("p"))).where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("alias"), "canonical")
    return quality.canonical(matches(spark, sf_dir).select("match_id", "team1"), alias, "team1")


ALIAS = sql(
    """
SELECT match_id, team1, coalesce(canonical, team1) AS team1_canonical FROM series
LEFT JOIN (SELECT s_suppkey AS alias, min(s_suppkey) OVER (PARTITION BY s_nationkey, s_suppkey % 2) AS canonical FROM supplier) ON alias = team1 AND alias % 5 <> 0"""
)


def manifest_groups(spark, sf_dir):
    rows = matches(spark, sf_dir)
    event = (F.col("map_name") == "PROMO") & F.col("dt").between("1998-01-01", "1998-03-31")
    return quality.evaluation_groups(rows, F.coalesce(event, F.lit(False))).groupBy("evaluation_group").agg(F.count("*").alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


MANIFEST = sql(
    """
SELECT CASE WHEN ev THEN 'event' WHEN dt > (SELECT max(dt) FROM series WHERE map_name = 'PROMO' AND dt BETWEEN '1998-01-01' AND '1998-03-31') THEN 'after_event' ELSE 'development' END AS evaluation_group,
  count(*) AS n, min(dt) AS first_dt, max(dt) AS last_dt
FROM (SELECT *, map_name = 'PROMO' AND dt BETWEEN '1998-01-01' AND '1998-03-31' AS ev FROM series) GROUP BY 1"""
)


def dedupe_slots(spark, sf_dir):
    rows = quality.drop_players_on_both_sides(player_rows(spark, sf_dir))
    return quality.collapse_slots(rows, ["adr", "kast", "kd"]).select("match_id", "side", "slot", "player")


DEDUPE = sql(
    """
SELECT match_id, side, slot, player FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id, side, player ORDER BY slot) AS rn,
    min((adr, kast, kd)) OVER (PARTITION BY match_id, side, player) = max((adr, kast, kd)) OVER (PARTITION BY match_id, side, player) AS same
  FROM players WHERE match_id NOT IN (SELECT match_id FROM players GROUP BY match_id, player HAVING count(DISTINCT side) > 1)) WHERE rn = 1 AND same"""
)


def player_unpivot(spark, sf_dir):
    return player_rows(spark, sf_dir).groupBy("match_id", "side").agg(F.count("*").alias("n"), F.round(F.sum("adr"), 6).alias("adr"), F.round(F.avg("kd"), 6).alias("kd"))


def audit_distinct_ids(spark, sf_dir):
    rows = player_rows(spark, sf_dir)
    return rows.groupBy("team").agg(F.count_distinct("player").alias("players"), F.count_distinct("match_id").alias("games"))


def audit_distribution(spark, sf_dir):
    return quality.distribution(matches(spark, sf_dir), "best_of", "win1")


def side_bias_by_slice(spark, sf_dir):
    return quality.side_bias(matches(spark, sf_dir), "tier", "map_name")


def crosstab_bestof(spark, sf_dir):
    made = matches(spark, sf_dir).groupBy("tier").pivot("best_of", [1, 3, 5]).count()
    return made.select("tier", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"bo{k}") for k in (1, 3, 5)])


def win_flags(spark, sf_dir):
    return quality.win_flag_check(matches(spark, sf_dir))


def pairwise_overlap(spark, sf_dir):
    """Appearances of one team on one map that share players."""
    return quality.overlaps(player_rows(spark, sf_dir), "team", "match_id", "map_name")


OVERLAP = sql(
    """
SELECT x.team, x.map_name, x.match_id AS a, y.match_id AS b, count(*) AS shared FROM (SELECT DISTINCT team, map_name, match_id, player FROM players) x
JOIN (SELECT DISTINCT team, map_name, match_id, player FROM players) y ON x.team = y.team AND x.map_name = y.map_name AND x.player = y.player AND x.match_id < y.match_id GROUP BY ALL"""
)


def pairwise_overlap_all(spark, sf_dir):
    """Appearances of one team, on all maps, that share players."""
    return quality.overlaps(player_rows(spark, sf_dir), "team", "match_id")


OVERLAP_ALL = sql(
    """
SELECT x.team, x.match_id AS a, y.match_id AS b, count(*) AS shared FROM (SELECT DISTINCT team, match_id, player FROM players) x
JOIN (SELECT DISTINCT team, match_id, player FROM players) y ON x.team = y.team AND x.player = y.player AND x.match_id < y.match_id GROUP BY 1, 2, 3"""
)


def spelling(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "conversations")
    names = events.select(F.col("text").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return quality.spelling_groups(names.where(identity_key(F.col("name")) != ""), "name", "n").groupBy("key").agg(F.first("canonical").alias("canonical"), F.sum("n").alias("n"))


SPELLING = r"""
WITH names AS (SELECT text AS name, count(*) AS n FROM conversations GROUP BY 1), k AS (SELECT *, regexp_replace(lower(name), '[^\p{L}\p{N}_]', '', 'g') AS key FROM names)
SELECT key, arg_min(name, (-n, name)) AS canonical, CAST(sum(n) AS BIGINT) AS n FROM k WHERE key <> '' GROUP BY key"""


def crews(spark, sf_dir):
    """Players' rows under names with spellings: team 17 is "Crew 17", "crew-17" or "CREW 17", by its opponent's number; every
    twentieth team is a "mix"."""
    rows = player_rows(spark, sf_dir)
    n = (F.col("team") % 40).cast("string")
    kind = F.col("match_id") % 3
    name = F.when(F.col("team") % 20 == 3, F.concat(F.lit("mix"), n)).when(kind == 0, F.concat(F.lit("Crew "), n)).when(kind == 1, F.concat(F.lit("crew-"), n)).otherwise(F.concat(F.lit("CREW "), n))
    return rows.withColumns({"name": name, "event": F.concat(F.col("map_name"), F.date_format("dt", "yyyyMM"))})


CREWS = """
crews AS (SELECT *, map_name || strftime(dt, '%Y%m') AS event, CASE WHEN team % 20 = 3 THEN 'mix' WHEN match_id % 3 = 0 THEN 'Crew ' WHEN match_id % 3 = 1 THEN 'crew-' ELSE 'CREW ' END || CAST(team % 40 AS VARCHAR) AS name FROM players)"""


def name_resolution(spark, sf_dir):
    """What becomes of each name: merged with its spellings, left alone or unresolved."""
    return quality.resolve_names(crews(spark, sf_dir), "name", "team", "event")


RESOLVED = sql(
    r"""
SELECT name, key, n, CASE WHEN spellings > 1 AND key IN (SELECT key FROM shared) THEN canonical ELSE name END AS canonical,
  CASE WHEN spellings > 1 AND key IN (SELECT key FROM shared) THEN 'normalized'
    WHEN spellings > 1 OR name IN (SELECT name FROM strange) OR regexp_matches(name, '^(mix\d*|tbd|team \d+[a-z]*|unknown|amateur team|qualifier)$', 'i') THEN 'unresolved' ELSE 'exact' END AS resolution
FROM (SELECT *, count(*) OVER (PARTITION BY key) AS spellings, first(name) OVER (PARTITION BY key ORDER BY n DESC, name) AS canonical FROM names)""",
    CREWS,
    r"keyed AS (SELECT *, regexp_replace(lower(name), '[^\p{L}\p{N}_]', '', 'g') AS key FROM crews)",
    "names AS (SELECT key, name, count(DISTINCT team) AS n FROM keyed GROUP BY ALL)",
    "shared AS (SELECT key FROM keyed WHERE player IS NOT NULL GROUP BY key, player HAVING count(DISTINCT name) > 1)",
    "idents AS (SELECT name, team, min(event) AS e, min(t) AS t FROM keyed WHERE player IS NOT NULL GROUP BY ALL)",
    "strange AS (SELECT a.name FROM idents a JOIN idents b ON a.name = b.name AND a.team < b.team AND (a.e = b.e OR abs(floor((a.t - b.t) / 86400000000)) <= 60) "
    "WHERE NOT EXISTS (SELECT 1 FROM keyed p JOIN keyed q ON p.player = q.player WHERE p.name = a.name AND p.team = a.team AND q.name = b.name AND q.team = b.team))",
)


def identity_review(spark, sf_dir):
    """Whether each name is one team, by its eras of equal rosters."""
    return identity.review(crews(spark, sf_dir), "name")


REVIEW = sql(
    r"""
SELECT name, n_matches, coalesce(n_eras, 0) AS n_eras, coalesce(seq, true) AS sequential, coalesce(close_events, 0) AS close_events, generic,
  CASE WHEN generic AND n_matches >= 50 AND coalesce(close_events, 0) = 0 THEN 'KEEP_AS_SINGLE_TEAM' WHEN generic AND n_matches < 15 THEN 'EXCLUDE_FROM_IDENTITY_DEPENDENT_FEATURES'
    WHEN coalesce(close_events, 0) = 0 THEN 'KEEP_AS_SINGLE_TEAM' WHEN n_matches >= 50 AND coalesce(seq, true) THEN 'KEEP_AS_SINGLE_TEAM'
    WHEN n_matches >= 50 OR coalesce(seq, true) THEN 'MANUAL_REVIEW' ELSE 'NEEDS_EPISODE_SPLIT' END AS verdict
FROM (SELECT name, count(*) AS n_matches, regexp_matches(name, '^(mix\d*|tbd|team \d+[a-z]*|unknown|amateur team|qualifier)$', 'i') AS generic FROM seen GROUP BY name)
LEFT JOIN (SELECT name, count(*) AS n_eras, bool_and(NOT coalesce(l >= after, false)) AS seq FROM (SELECT name, l, lead(f) OVER (PARTITION BY name ORDER BY f, l) AS after FROM eras) GROUP BY name) USING (name)
LEFT JOIN (SELECT a.name, count(*) AS close_events FROM eras a JOIN eras b ON a.name = b.name AND a.era < b.era AND NOT list_has_any(a.roster, b.roster)
    AND floor((CASE WHEN b.f >= a.l THEN b.f - a.l ELSE a.f - b.l END) / 86400000000.0) <= 60 GROUP BY a.name) USING (name)""",
    CREWS,
    "seen AS (SELECT name, match_id, min(t) AS t, list(DISTINCT player ORDER BY player) AS roster FROM crews GROUP BY ALL)",
    "runs AS (SELECT *, sum(new) OVER (PARTITION BY name ORDER BY t, match_id) AS era FROM (SELECT *, CASE WHEN roster = lag(roster) OVER (PARTITION BY name ORDER BY t, match_id) THEN 0 ELSE 1 END AS new FROM seen))",
    "eras AS (SELECT name, era, any_value(roster) AS roster, min(t) AS f, max(t) AS l FROM runs GROUP BY ALL)",
)


def era_islands(spark, sf_dir):
    rows = ledger(kept_sides(spark, sf_dir))
    return quality.eras(rows, "team", "map_name").drop("begin", "end")


ERAS = sql(
    """
SELECT team, era, any_value(map_name) AS map_name, count(*) AS n FROM (
  SELECT *, CAST(sum(new) OVER (PARTITION BY team ORDER BY t, match_id) AS BIGINT) AS era FROM (
    SELECT *, CASE WHEN map_name = lag(map_name) OVER (PARTITION BY team ORDER BY t, match_id) THEN 0 ELSE 1 END AS new FROM ledger))
GROUP BY team, era"""
)


def round_replay(spark, sf_dir):
    rows = quality.running_record(ledger(kept_sides(spark, sf_dir)), ["team", "map_name"])
    return rows.select("match_id", "side", "round", "wins", "losses")


ROUNDS = sql(
    """
SELECT match_id, side, row_number() OVER w AS round, CAST(coalesce(sum(win) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS wins,
  CAST(coalesce(sum(1 - win) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS losses
FROM ledger WINDOW w AS (PARTITION BY team, map_name ORDER BY t, match_id)"""
)


def team_search(spark, sf_dir):
    (s,) = read_tables(spark, sf_dir, "supplier")
    return quality.search(s.select(F.col("s_name").alias("name"), "s_suppkey"), "#00000000", 20)


def team_pairs(spark, sf_dir):
    """Matches between the same two teams in either order."""
    rows = matches(spark, sf_dir).groupBy(F.least("team1", "team2").alias("a"), F.greatest("team1", "team2").alias("b"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.when(F.col("team1") < F.col("team2"), F.col("win1")).otherwise(1 - F.col("win1"))).alias("a_wins"))


QUERIES = {
    "reject_reasons": (rejects, REJECTS),
    "try_cast_clean": (clean_cast, CLEAN),
    "alias_canonicalise": (alias_canonicalise, ALIAS),
    "manifest_groups": (manifest_groups, MANIFEST),
    "dedupe_slots": (dedupe_slots, DEDUPE),
    "player_unpivot": (player_unpivot, sql("SELECT match_id, side, count(*) AS n, round(sum(adr), 6) AS adr, round(avg(kd), 6) AS kd FROM players GROUP BY 1, 2")),
    "audit_distinct_ids": (audit_distinct_ids, sql("SELECT team, count(DISTINCT player) AS players, count(DISTINCT match_id) AS games FROM players GROUP BY 1")),
    "audit_distribution": (audit_distribution, sql("SELECT best_of, win1, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM series)::DOUBLE, 6) AS pct FROM series GROUP BY 1, 2")),
    "side_bias_by_slice": (side_bias_by_slice, sql("SELECT tier, map_name, count(*) AS n, round(avg(win1), 6) AS rate FROM series GROUP BY 1, 2")),
    "crosstab_bestof": (crosstab_bestof, sql("SELECT tier, count(*) FILTER (best_of = 1) AS bo1, count(*) FILTER (best_of = 3) AS bo3, count(*) FILTER (best_of = 5) AS bo5 FROM series GROUP BY 1")),
    "win_flag_check": (win_flags, sql("SELECT CASE WHEN score1 > score2 THEN 'team1' WHEN score1 < score2 THEN 'team2' ELSE 'tie' END AS implied, CASE WHEN win1 = 1 THEN 'team1' ELSE 'team2' END AS recorded, count(*) AS n FROM series GROUP BY 1, 2")),
    "pairwise_overlap": (pairwise_overlap, OVERLAP),
    "pairwise_overlap_all": (pairwise_overlap_all, OVERLAP_ALL),
    "spelling_groups": (spelling, SPELLING),
    "name_resolution": (name_resolution, RESOLVED),
    "identity_review": (identity_review, REVIEW),
    "era_islands": (era_islands, ERAS),
    "round_replay": (round_replay, ROUNDS),
    "team_search": (team_search, "SELECT s_name AS name, s_suppkey FROM supplier WHERE lower(s_name) LIKE '%#00000000%' ORDER BY 1 LIMIT 20"),
    "team_pairs": (team_pairs, sql("SELECT least(team1, team2) AS a, greatest(team1, team2) AS b, count(*) AS n, CAST(sum(CASE WHEN team1 < team2 THEN win1 ELSE 1 - win1 END) AS BIGINT) AS a_wins FROM series GROUP BY 1, 2")),
}
