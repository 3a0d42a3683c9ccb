"""Queries of strictly-prior history and of ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, prefix, ratings
from ..operators.streams import ledger, matchups
from ..scratch import kept
from .adapter import kept_sides, sql


def rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def prior_win_rate(spark, sf_dir):
    rows = history.prior_counts(ledger(kept_sides(spark, sf_dir)))
    return rounded(matchups(rows, ["win_rate", "n_before"], ["n_before"], ["n_before"]), "win_rate_diff")


WINDOWS = """
h AS (SELECT *, count(*) OVER a AS n_before, coalesce(sum(win) OVER a, 0) AS wins_before, max(t) OVER a AS last_t, count(*) OVER d30 AS n_30d,
    count(*) OVER f AS format_n, coalesce(sum(win) OVER f, 0) AS format_wins
  FROM ledger WINDOW a AS (PARTITION BY team ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    d30 AS (PARTITION BY team ORDER BY t RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING),
    f AS (PARTITION BY team, best_of ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, (wins_before + 2) / CAST(n_before + 4 AS DOUBLE) AS win_rate, (format_wins + 2) / CAST(format_n + 4 AS DOUBLE) AS format_win_rate,
    (t - last_t) / 86400000000.0 AS days_since_last FROM h)
"""
LASTS = """
numbered AS (SELECT p.match_id, p.side, l.win, l.margin, row_number() OVER (PARTITION BY p.match_id, p.side ORDER BY l.t DESC, l.match_id DESC) AS k
  FROM ledger p JOIN ledger l ON p.team = l.team AND l.t < p.t),
lasts AS (SELECT match_id, side, avg(win) FILTER (k <= 5) AS w5, avg(win) FILTER (k <= 10) AS w10, avg(margin) FILTER (k <= 5) AS m5, avg(margin) FILTER (k <= 10) AS m10
  FROM numbered WHERE k <= 10 GROUP BY ALL)
"""

PRIOR_WIN_RATE = sql(
    """
SELECT a.match_id, round(a.win_rate - b.win_rate, 6) AS win_rate_diff, a.n_before - b.n_before AS n_before_diff, least(a.n_before, b.n_before) AS n_before_min, a.n_before + b.n_before AS n_before_sum
FROM s a JOIN s b ON a.match_id = b.match_id AND a.side = 1 AND b.side = 2""",
    WINDOWS,
)


def last5_last10_form(spark, sf_dir):
    rows = history.last_n(ledger(kept_sides(spark, sf_dir)), (5, 10), ("win", "margin"))
    return rounded(rows.select("match_id", "side", "win_last_5", "win_last_10", "margin_last_5", "margin_last_10"), "win_last_5", "win_last_10", "margin_last_5", "margin_last_10")


LAST5 = sql(
    """
SELECT match_id, side, round(w5, 6) AS win_last_5, round(w10, 6) AS win_last_10, round(m5, 6) AS margin_last_5, round(m10, 6) AS margin_last_10
FROM ledger LEFT JOIN lasts USING (match_id, side)""",
    LASTS,
)


def same_format_rate(spark, sf_dir):
    rows = history.prior_counts(ledger(kept_sides(spark, sf_dir)))
    return rounded(rows.select("match_id", "side", "format_n", "format_win_rate"), "format_win_rate")


def activity_30d(spark, sf_dir):
    rows = history.prior_counts(ledger(kept_sides(spark, sf_dir)))
    return rows.select("match_id", "side", "n_30d", F.round("days_since_last", 6).alias("days_since_last"))


def series_features_v1(spark, sf_dir):
    rows = history.series_features(ledger(kept_sides(spark, sf_dir)))
    made = matchups(rows, history.SERIES, ["n_before"], ["n_before"])
    flags = {f"both_{k}": (F.col("n_before_min") >= k).cast("int") for k in (1, 5, 10)}
    return rounded(made.withColumns(flags), *[f"{c}_diff" for c in history.SERIES if c not in ("n_30d", "n_before")])


SERIES_V1 = sql(
    """
SELECT a.match_id, round(a.win_rate - b.win_rate, 6) AS win_rate_diff, round(a.win_last_5 - b.win_last_5, 6) AS win_last_5_diff, round(a.win_last_10 - b.win_last_10, 6) AS win_last_10_diff,
  round(a.format_win_rate - b.format_win_rate, 6) AS format_win_rate_diff, round(a.margin_last_5 - b.margin_last_5, 6) AS margin_last_5_diff, round(a.margin_last_10 - b.margin_last_10, 6) AS margin_last_10_diff,
  a.n_30d - b.n_30d AS n_30d_diff, round(a.days_since_last - b.days_since_last, 6) AS days_since_last_diff, a.n_before - b.n_before AS n_before_diff,
  least(a.n_before, b.n_before) AS n_before_min, a.n_before + b.n_before AS n_before_sum,
  CAST(least(a.n_before, b.n_before) >= 1 AS INTEGER) AS both_1, CAST(least(a.n_before, b.n_before) >= 5 AS INTEGER) AS both_5, CAST(least(a.n_before, b.n_before) >= 10 AS INTEGER) AS both_10
FROM f1 a JOIN f1 b ON a.match_id = b.match_id AND a.side = 1 AND b.side = 2""",
    WINDOWS,
    LASTS,
    "f1 AS (SELECT s.*, coalesce(w5, 0.5) AS win_last_5, coalesce(w10, 0.5) AS win_last_10, coalesce(m5, 0) AS margin_last_5, coalesce(m10, 0) AS margin_last_10 FROM s LEFT JOIN lasts USING (match_id, side))",
)


def decayed_win_rate(spark, sf_dir):
    rows = history.decayed(ledger(kept_sides(spark, sf_dir)), 60, ("win", "margin"))
    return rounded(rows.select("match_id", "side", "tw_mass", "tw_win", "tw_margin"), "tw_mass", "tw_win", "tw_margin")


DECAYED = sql(
    """
SELECT p.match_id, p.side, round(coalesce(sum(w), 0), 6) AS tw_mass, round(sum(w * l.win) / sum(w), 6) AS tw_win, round(sum(w * l.margin) / sum(w), 6) AS tw_margin
FROM ledger p LEFT JOIN LATERAL (SELECT win, margin, power(0.5, (p.t - q.t) / 86400000000.0 / 60) AS w FROM ledger q WHERE q.team = p.team AND q.t < p.t) l ON true
GROUP BY p.match_id, p.side"""
)


def elo_series(spark, sf_dir):
    rated = ratings.rate(kept_sides(spark, sf_dir))
    return rounded(rated.select("match_id", "side", "elo_before", "own_mid"), "elo_before", "own_mid")


def elo_fold(keys: str, start: str = "series") -> str:
    """DuckDB's ordered fold: maps of current ratings and of those before the moment, one step a match."""
    return f"""
ordered AS (SELECT row_number() OVER (ORDER BY t, match_id) AS k, match_id, epoch_us(dt) AS t, {keys.format('team1')} AS a, {keys.format('team2')} AS b, win1, elig1 AND elig2 AS ok FROM (SELECT *, epoch_us(dt) AS t FROM {start})),
names AS (SELECT name, row_number() OVER (ORDER BY name) AS i FROM (SELECT a AS name FROM ordered UNION SELECT b FROM ordered)),
steps AS (SELECT k, match_id, t, x.i AS i, y.i AS j, win1, ok FROM ordered JOIN names x ON x.name = a JOIN names y ON y.name = b),
fold AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS match_id, CAST(NULL AS BIGINT) AS t, [CAST(1500.0 AS DOUBLE) FOR _ IN range((SELECT count(*) FROM names))] AS r, [CAST(1500.0 AS DOUBLE) FOR _ IN range((SELECT count(*) FROM names))] AS r0,
    CAST(NULL AS DOUBLE) AS e1, CAST(NULL AS DOUBLE) AS e2, CAST(NULL AS DOUBLE) AS m1, CAST(NULL AS DOUBLE) AS m2
  UNION ALL
  SELECT k, match_id, t, CASE WHEN ok THEN list_transform(r, lambda v, n: CASE WHEN n = i THEN v + d WHEN n = j THEN v - d ELSE v END) ELSE r END, r0, r0[i], r0[j], r[i], r[j]
  FROM (SELECT s.k, s.match_id, s.t, f.r, CASE WHEN f.t IS DISTINCT FROM s.t THEN f.r ELSE f.r0 END AS r0, s.i, s.j, s.ok, 32 * (s.win1 - 1 / (1 + power(10, (f.r[s.j] - f.r[s.i]) / 400))) AS d
        FROM fold f JOIN steps s ON s.k = f.k + 1))
"""


ELO = sql(
    """
SELECT match_id, 1 AS side, round(e1, 6) AS elo_before, round(m1, 6) AS own_mid FROM fold WHERE k > 0
UNION ALL SELECT match_id, 2, round(e2, 6), round(m2, 6) FROM fold WHERE k > 0""",
    elo_fold("{}"),
).replace("WITH ", "WITH RECURSIVE ", 1)


def elo_map(spark, sf_dir):
    rated = ratings.rate(kept_sides(spark, sf_dir), ("team", "map_name"))
    return rounded(rated.select("match_id", "side", "elo_before", "own_mid"), "elo_before", "own_mid")


ELO_MAP = sql(
    """
SELECT match_id, 1 AS side, round(e1, 6) AS elo_before, round(m1, 6) AS own_mid FROM fold WHERE k > 0
UNION ALL SELECT match_id, 2, round(e2, 6), round(m2, 6) FROM fold WHERE k > 0""",
    elo_fold("{} || '|' || map_name"),
).replace("WITH ", "WITH RECURSIVE ", 1)


def form_residual(spark, sf_dir):
    """Mean residual and opponents' rating of the last five and ten trusted entries, and the decayed residual."""
    rated = kept(ratings.residuals(ratings.rate(kept_sides(spark, sf_dir))).where("elig").select("match_id", "side", "team", "t", "trusted", "residual", "opp_mid"))
    trusted = F.col("trusted")
    at = prefix.cuts(rated, keys=["team"])
    rows = history.last_n(rated, (5, 10), ("residual", "opp_mid"), where=trusted, at=at)
    rows = history.decayed(rows, 60, ("residual",), where=trusted, at=at)
    cols = ["residual_last_5", "residual_last_10", "opp_mid_last_5", "opp_mid_last_10", "tw_residual", "tw_mass"]
    return rounded(rows.select("match_id", "side", *cols), *cols, places=5)


FORM = sql(
    """
SELECT p.match_id, p.side, round(avg(l.residual) FILTER (k <= 5), 5) AS residual_last_5, round(avg(l.residual) FILTER (k <= 10), 5) AS residual_last_10,
  round(avg(l.om) FILTER (k <= 5), 5) AS opp_mid_last_5, round(avg(l.om) FILTER (k <= 10), 5) AS opp_mid_last_10,
  round(sum(l.residual * w) / sum(w), 5) AS tw_residual, round(coalesce(sum(w), 0), 5) AS tw_mass
FROM ledger p LEFT JOIN (
  SELECT a.match_id, a.side, r.residual, r.om, power(0.5, (a.t - r.t) / 86400000000.0 / 60) AS w, row_number() OVER (PARTITION BY a.match_id, a.side ORDER BY r.t DESC, r.match_id DESC) AS k
  FROM ledger a JOIN res r ON r.team = a.team AND r.t < a.t) l ON l.match_id = p.match_id AND l.side = p.side
GROUP BY p.match_id, p.side""",
    elo_fold("{}"),
    """
res AS (SELECT l.match_id, l.side, l.team, l.t, CASE WHEN l.side = 1 THEN m2 ELSE m1 END AS om,
    l.win - 1 / (1 + power(10, (CASE WHEN l.side = 1 THEN m2 - m1 ELSE m1 - m2 END) / 400)) AS residual
  FROM ledger l JOIN fold f ON f.match_id = l.match_id WHERE l.trusted)""",
).replace("WITH ", "WITH RECURSIVE ", 1)

QUERIES = {
    "prior_win_rate": (prior_win_rate, PRIOR_WIN_RATE),
    "last5_last10_form": (last5_last10_form, LAST5),
    "same_format_rate": (same_format_rate, sql("SELECT match_id, side, format_n, round(format_win_rate, 6) AS format_win_rate FROM s", WINDOWS)),
    "activity_30d": (activity_30d, sql("SELECT match_id, side, n_30d, round(days_since_last, 6) AS days_since_last FROM s", WINDOWS)),
    "series_features_v1": (series_features_v1, SERIES_V1),
    "decayed_win_rate": (decayed_win_rate, DECAYED),
    "elo_series": (elo_series, ELO),
    "elo_map": (elo_map, ELO_MAP),
    "form_residual": (form_residual, FORM),
}
