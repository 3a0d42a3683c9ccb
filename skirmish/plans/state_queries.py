"""Queries of scans, snapshots, rating baselines and map predictions."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from ..functions import expected
from ..operators import history, intervals, pool, ratings, resume, service, states
from ..operators.streams import ledger
from ..scratch import delete, kept, shared_dir
from ..sources import read_tables, read_tiers
from .adapter import kept_sides, match_sides, matches, player_rows, sql
from .history_queries import FORM, LASTS, WINDOWS, elo_fold, rounded
from .model_queries import REPLICATES, scored

CUT = datetime.datetime(1996, 1, 1)
SCANNED = ["match_id", "team1", "team2", "score1", "best_of"]


def scan_union_tier(spark, sf_dir):
    """Matches written as one CSV folder a tier, read back as text, united and typed."""
    top = f"{shared_dir(spark)}/tiers-{uuid.uuid4().hex}"
    matches(spark, sf_dir).select(*SCANNED, "tier").write.partitionBy("tier").csv(top, header=True)
    back = read_tiers(spark, {t: f"{top}/tier={t}" for t in ("tier1", "tier2", "tier3")}, SCANNED)
    made = kept(back.select("tier", *[F.col(c).cast("long" if c in SCANNED[:3] else "int").alias(c) for c in SCANNED]))
    delete(spark, top)
    return made


def snapshot_resume(spark, sf_dir):
    """Prior counts of all rows: those before the cut-off from nothing, those after it from a written snapshot."""
    rows = ledger(kept_sides(spark, sf_dir))
    early, late = rows.where(F.col("dt") < F.lit(CUT)), rows.where(F.col("dt") >= F.lit(CUT))
    snapshot = kept(resume.totals(early, "team"))
    parts = [resume.counts_from(state, part, "team").select("match_id", "side", "n_before", "wins_before") for state, part in ((snapshot.limit(0), early), (snapshot, late))]
    return parts[0].unionByName(parts[1])


RESUMED = sql(
    """
SELECT match_id, side, count(*) OVER w AS n_before, CAST(coalesce(sum(win) OVER w, 0) AS BIGINT) AS wins_before
FROM ledger WINDOW w AS (PARTITION BY team ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)


def snapshot_summary(spark, sf_dir):
    """Two snapshots merged are the snapshot of all rows."""
    rows = ledger(kept_sides(spark, sf_dir))
    first = kept(resume.totals(rows.where(F.col("dt") < F.lit(CUT)), "team"))
    return resume.merged(first, resume.totals(rows.where(F.col("dt") >= F.lit(CUT)), "team"), "team")


def rating_baseline(spark, sf_dir):
    """Expected score of side 1 from the ratings before the match."""
    rated = ratings.rate(kept_sides(spark, sf_dir)).where("side = 1")
    return rated.select("match_id", F.round(expected(F.col("elo_before"), F.col("opp_elo_before")), 6).alias("p"))


def cut_in_two(spark, sf_dir):
    """(cut-off in microseconds, history entries before it, those from it on)."""
    rows = kept(ledger(match_sides(spark, sf_dir)))
    return int(CUT.replace(tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000, rows.where(F.col("dt") < F.lit(CUT)), rows.where(F.col("dt") >= F.lit(CUT))


def written(spark, state):
    """A state that has been saved and loaded."""
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    states.save(state, path)
    return states.load(spark, path, *state)


def series_resume(spark, sf_dir):
    """The series features of all rows: those before the cut-off from nothing, those after it from a written state."""
    cut, early, late = cut_in_two(spark, sf_dir)
    made = history.series_features(early).unionByName(states.series_from(written(spark, states.series_state(early, cut)), late), allowMissingColumns=True)
    cols = ["win_rate", "format_win_rate", "n_30d", "days_since_last", "win_last_5", "win_last_10", "margin_last_5", "margin_last_10"]
    return rounded(made.select("match_id", "side", "n_before", *cols), *[c for c in cols if c != "n_30d"])


SERIES_RESUMED = sql(
    """
SELECT s.match_id, s.side, n_before, round(win_rate, 6) AS win_rate, round(format_win_rate, 6) AS format_win_rate, n_30d, round(days_since_last, 6) AS days_since_last, round(coalesce(w5, 0.5), 6) AS win_last_5,
  round(coalesce(w10, 0.5), 6) AS win_last_10, round(coalesce(m5, 0), 6) AS margin_last_5, round(coalesce(m10, 0), 6) AS margin_last_10 FROM s LEFT JOIN lasts USING (match_id, side)""",
    WINDOWS,
    LASTS,
)


def map_resume(spark, sf_dir):
    """What each team had done on the map before each row, from a written state after the cut-off."""
    _, early, late = cut_in_two(spark, sf_dir)
    parts = [states.MAPS.before(s, rows) for s, rows in ((written(spark, states.map_state(early))["maps"], late), (states.MAPS.of(early.limit(0)), early))]
    return rounded(parts[0].unionByName(parts[1]).select("match_id", "side", "n", "wins", "margins", "last_t"), "margins")


MAP_RESUMED = sql(
    """
SELECT match_id, side, nullif(count(*) OVER w, 0) AS n, CAST(sum(win) OVER w AS BIGINT) AS wins, round(sum(norm_margin) OVER w, 6) AS margins, max(t) OVER w AS last_t
FROM ledger WINDOW w AS (PARTITION BY team, map_name ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)


def form_resume(spark, sf_dir):
    """The form features, ratings and residuals included, gone on from written states after the cut-off."""
    sides = kept(match_sides(spark, sf_dir))
    early, late = sides.where(F.col("dt") < F.lit(CUT)), sides.where(F.col("dt") >= F.lit(CUT))
    first = kept(ratings.residuals(ratings.rate(early)).where("elig"))
    state = written(spark, states.form_state(first) | states.rating_state(first, "team"))
    rest = kept(ratings.residuals(ratings.rate(late, snapshot=state["ratings"])).where("elig"))
    none = {n: df.limit(0) for n, df in states.form_state(first).items()}
    made = states.form_from(none, first).unionByName(states.form_from(state, rest))
    cols = ["residual_last_5", "residual_last_10", "opp_mid_last_5", "opp_mid_last_10", "tw_residual", "tw_mass"]
    return rounded(made.select("match_id", "side", *cols), *cols, places=5)


def player_resume(spark, sf_dir):
    """Players' decayed means at the end: the state before the cut-off, merged with that of the rest."""
    rows = kept(player_rows(spark, sf_dir).where("elig"))
    parts = [states.PLAYERS.of(rows.where(cond)) for cond in (F.col("dt") < F.lit(CUT), F.col("dt") >= F.lit(CUT))]
    made = states.PLAYERS.merge(kept(parts[0]), parts[1])
    return rounded(made.select("player", *[(F.col(v) / F.col("mass")).alias(v) for v in states.PLAYERS.values]), *states.PLAYERS.values)


PLAYERS_RESUMED = sql(
    """
SELECT player, round(sum(w * adr) / sum(w), 6) AS adr, round(sum(w * kast) / sum(w), 6) AS kast, round(sum(w * kd) / sum(w), 6) AS kd, round(sum(w * apr) / sum(w), 6) AS apr
FROM (SELECT *, power(2, (t - 946684800000000) / (60 * 86400000000.0)) AS w FROM players WHERE elig) GROUP BY player"""
)


def last_games_resume(spark, sf_dir):
    """The last twenty games of each team, merged from both sides of the cut-off, and how many players they had."""
    rows = kept(player_rows(spark, sf_dir).where("elig"))
    parts = [states.GAMES.of(states.games_of(rows.where(cond))) for cond in (F.col("dt") < F.lit(CUT), F.col("dt") >= F.lit(CUT))]
    made = states.GAMES.merge(kept(parts[0]), parts[1])
    everyone = F.array_distinct(F.flatten(F.col("tail.players")))
    return made.select("team", F.size("tail").cast("long").alias("games"), F.size(everyone).cast("long").alias("players"), F.array_min("tail.t").alias("first_t"))


LAST_GAMES = sql(
    """
SELECT team, count(DISTINCT match_id) AS games, count(DISTINCT player) AS players, min(t) AS first_t FROM (
  SELECT p.*, dense_rank() OVER (PARTITION BY team ORDER BY t DESC, match_id DESC) AS k FROM players p WHERE elig) WHERE k <= 20 GROUP BY team"""
)


def recursive(query: str) -> str:
    return query.replace("WITH ", "WITH RECURSIVE ", 1)


BASELINE = recursive(sql("SELECT match_id, round(1 / (1 + power(10, (e2 - e1) / 400)), 6) AS p FROM fold WHERE k > 0", elo_fold("{}")))


def predict_map(spark, sf_dir):
    """Every match asks for its map; the context holds the map ratings at the cut-off, so matches before it are refused."""
    rows = matches(spark, sf_dir)
    (suppliers,) = read_tables(spark, sf_dir, "supplier")
    teams = suppliers.select(F.col("s_suppkey").cast("string").alias("name"), F.col("s_suppkey").alias("team"), (F.col("s_suppkey") % 10 != 7).alias("eligible"))
    rated = ratings.rate(kept_sides(spark, sf_dir).where(F.col("dt") < F.lit(CUT)), ("team", "map_name"))
    asked = rows.select(F.col("match_id").alias("request_id"), F.col("team1").cast("string").alias("team1"), F.col("team2").cast("string").alias("team2"), "map_name", F.col("dt").alias("asked"))
    made = service.predict_map(asked, teams, kept(resume.last_ratings(rated, "team", "map_name")), CUT)
    return rounded(made.select("request_id", "p", "error"), "p")


MAP = recursive(
    sql(
        """
SELECT match_id AS request_id, CASE WHEN elig1 AND elig2 AND dt >= TIMESTAMP '1996-01-01' THEN round(1 / (1 + power(10, (coalesce(last.r[y.i], 1500) - coalesce(last.r[x.i], 1500)) / 400)), 6) END AS p,
  CASE WHEN NOT (elig1 AND elig2) THEN 'ineligible_team' WHEN dt < TIMESTAMP '1996-01-01' THEN 'before_context' END AS error
FROM series LEFT JOIN names x ON x.name = team1 || '|' || map_name LEFT JOIN names y ON y.name = team2 || '|' || map_name, (SELECT r FROM fold ORDER BY k DESC LIMIT 1) last""",
        "early AS (SELECT * FROM series WHERE dt < TIMESTAMP '1996-01-01')",
        elo_fold("{} || '|' || map_name", "early"),
    )
)


def predict_series(spark, sf_dir):
    """Every match asks for its series; the context holds the ratings at the cut-off."""
    (suppliers,) = read_tables(spark, sf_dir, "supplier")
    teams = suppliers.select(F.col("s_suppkey").cast("string").alias("name"), F.col("s_suppkey").alias("team"), (F.col("s_suppkey") % 10 != 7).alias("eligible"))
    rated = ratings.rate(kept_sides(spark, sf_dir).where(F.col("dt") < F.lit(CUT)))
    asked = matches(spark, sf_dir).select(F.col("match_id").alias("request_id"), F.col("team1").cast("string").alias("team1"), F.col("team2").cast("string").alias("team2"), "best_of", F.col("dt").alias("asked"))
    made = service.predict_series(asked, teams, kept(resume.last_ratings(rated, "team")), CUT)
    return rounded(made.select("request_id", "p", "error"), "p")


SERIES = recursive(
    sql(
        """
SELECT match_id AS request_id, CASE WHEN elig1 AND elig2 AND dt >= TIMESTAMP '1996-01-01' THEN round(CASE best_of WHEN 1 THEN q WHEN 3 THEN q * q * (3 - 2 * q) ELSE q ** 3 * (10 - 15 * q + 6 * q * q) END, 6) END AS p,
  CASE WHEN NOT (elig1 AND elig2) THEN 'ineligible_team' WHEN dt < TIMESTAMP '1996-01-01' THEN 'before_context' END AS error
FROM (SELECT series.*, 1 / (1 + power(10, (coalesce(last.r[y.i], 1500) - coalesce(last.r[x.i], 1500)) / 400)) AS q
  FROM series LEFT JOIN names x ON x.name = team1 LEFT JOIN names y ON y.name = team2, (SELECT r FROM fold ORDER BY k DESC LIMIT 1) last)""",
        "early AS (SELECT * FROM series WHERE dt < TIMESTAMP '1996-01-01')",
        elo_fold("{}", "early"),
    )
)


def list_maps(spark, sf_dir):
    return service.list_maps(pool.map_states(ledger(kept_sides(spark, sf_dir))))


def bootstrap_auc(spark, sf_dir):
    return rounded(intervals.auc_interval(scored(spark, sf_dir), "match_id", REPLICATES, other="p2"), "low", "high")


QUERIES = {
    "scan_union_tier": (scan_union_tier, sql("SELECT match_id, team1, team2, score1, best_of, tier FROM series")),
    "snapshot_resume": (snapshot_resume, RESUMED),
    "snapshot_summary": (snapshot_summary, sql("SELECT team, count(*) AS n, CAST(sum(win) AS BIGINT) AS wins, max(t) AS last_t FROM ledger GROUP BY 1")),
    "rating_baseline": (rating_baseline, BASELINE),
    "predict_map": (predict_map, MAP),
    "bootstrap_auc": (bootstrap_auc, None),
    "predict_series": (predict_series, SERIES),
    "list_maps": (list_maps, sql("SELECT map_name, max(t) AS last_t, count(DISTINCT team) AS teams FROM ledger GROUP BY 1")),
    "series_resume": (series_resume, SERIES_RESUMED),
    "map_resume": (map_resume, MAP_RESUMED),
    "form_resume": (form_resume, FORM),
    "player_resume": (player_resume, PLAYERS_RESUMED),
    "last_games_resume": (last_games_resume, LAST_GAMES),
}
