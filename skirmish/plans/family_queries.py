"""The families of side features that make up the composed tables, each with all its columns."""

from __future__ import annotations

from ..operators import compose, ratings
from ..scratch import kept
from .adapter import kept_sides, sql
from .history_queries import LASTS, WINDOWS, elo_fold, rounded


def recursive(query: str) -> str:
    return query.replace("WITH ", "WITH RECURSIVE ", 1)


def numbers(df, places: int = 6):
    return rounded(df, *[n for n, t in df.dtypes if t == "double"], places=places)


def family_series(spark, sf_dir):
    return numbers(compose.series_family(kept(ratings.rate(kept_sides(spark, sf_dir)))))


SERIES = recursive(
    sql(
        """
SELECT s.match_id, s.side, round(CASE s.side WHEN 1 THEN e1 ELSE e2 END, 6) AS elo, round(win_rate, 6) AS overall_win_rate, round(coalesce(w5, 0.5), 6) AS win_rate_last_5, round(coalesce(w10, 0.5), 6) AS win_rate_last_10,
  round(format_win_rate, 6) AS format_win_rate, round(coalesce(m5, 0), 6) AS avg_series_margin_last_5, round(coalesce(m10, 0), 6) AS avg_series_margin_last_10, n_30d AS matches_last_30_days,
  round(days_since_last, 6) AS days_since_last_match, n_before AS total_matches_before
FROM s LEFT JOIN lasts USING (match_id, side) JOIN fold ON fold.match_id = s.match_id""",
        WINDOWS,
        LASTS,
        elo_fold("{}"),
    )
)


def family_form(spark, sf_dir):
    return numbers(compose.form_family(kept(ratings.rate(kept_sides(spark, sf_dir)))), 5)


FORM = recursive(
    sql(
        """
SELECT p.match_id, p.side, round(coalesce(avg(om) FILTER (k <= 5), 1500), 5) AS avg_opponent_elo_last_5, round(coalesce(avg(om) FILTER (k <= 10), 1500), 5) AS avg_opponent_elo_last_10,
  round(coalesce(avg(residual) FILTER (k <= 5), 0), 5) AS performance_residual_last_5, round(coalesce(avg(residual) FILTER (k <= 10), 0), 5) AS performance_residual_last_10,
  round(coalesce(avg(residual), 0), 5) AS performance_residual_all, round(coalesce(any_value(tw), 0.5), 5) AS time_weighted_win_rate, round(coalesce(any_value(tm), 0), 5) AS time_weighted_series_margin,
  round(coalesce(sum(residual * w) / sum(w), 0), 5) AS time_weighted_performance_residual, count(residual) AS opponent_adjusted_history, round(coalesce(any_value(mass), 0), 5) AS time_weighted_history_mass
FROM ledger p JOIN everything USING (match_id, side) LEFT JOIN (
  SELECT a.match_id, a.side, r.residual, r.om, power(0.5, (a.t - r.t) / 86400000000.0 / 60) AS w, row_number() OVER (PARTITION BY a.match_id, a.side ORDER BY r.t DESC, r.match_id DESC) AS k
  FROM ledger a JOIN res r ON r.team = a.team AND r.t < a.t) l ON l.match_id = p.match_id AND l.side = p.side
GROUP BY p.match_id, p.side""",
        elo_fold("{}"),
        """
res AS (SELECT l.match_id, l.side, l.team, l.t, CASE WHEN l.side = 1 THEN m2 ELSE m1 END AS om,
    l.win - 1 / (1 + power(10, (CASE WHEN l.side = 1 THEN m2 - m1 ELSE m1 - m2 END) / 400)) AS residual
  FROM ledger l JOIN fold f ON f.match_id = l.match_id WHERE l.trusted)""",
        """
everything AS (SELECT p.match_id, p.side, sum(w) AS mass, sum(w * q.win) / sum(w) AS tw, sum(w * q.norm_margin) / sum(w) AS tm
  FROM ledger p LEFT JOIN LATERAL (SELECT win, norm_margin, power(0.5, (p.t - x.t) / 86400000000.0 / 60) AS w FROM ledger x WHERE x.team = p.team AND x.t < p.t) q ON true GROUP BY p.match_id, p.side)""",
    )
)


def family_map(spark, sf_dir):
    # only what the family reads is worked out: no sides' ratings meet again after the rounds
    rated = ratings.rate(kept_sides(spark, sf_dir), ("team", "map_name")).select(*compose.MAP_READS)
    return numbers(compose.map_family(kept(rated)))


MAP = recursive(
    sql(
        """
SELECT p.match_id, p.side, round(CASE p.side WHEN 1 THEN any_value(e1) ELSE any_value(e2) END, 6) AS map_elo, round((coalesce(sum(l.win), 0) + 2) / CAST(count(l.win) + 4 AS DOUBLE), 6) AS map_smoothed_win_rate,
  round(coalesce(avg(l.win) FILTER (l.k <= 5), 0.5), 6) AS map_win_rate_last_5, round(coalesce(avg(l.win) FILTER (l.k <= 10), 0.5), 6) AS map_win_rate_last_10, round(coalesce(avg(l.norm_margin), 0), 6) AS map_normalized_margin_all,
  round(coalesce(avg(l.norm_margin) FILTER (l.k <= 5), 0), 6) AS map_normalized_margin_last_5, round(coalesce(avg(l.norm_margin) FILTER (l.k <= 10), 0), 6) AS map_normalized_margin_last_10, count(l.win) AS map_matches_before,
  round((p.t - max(l.t)) / 86400000000.0, 6) AS days_since_map_played
FROM ledger p JOIN fold f ON f.match_id = p.match_id LEFT JOIN (
  SELECT a.match_id AS pm, a.side AS ps, q.t, q.win, q.norm_margin, row_number() OVER (PARTITION BY a.match_id, a.side ORDER BY q.t DESC, q.match_id DESC) AS k
  FROM ledger a JOIN ledger q ON q.team = a.team AND q.map_name = a.map_name AND q.t < a.t) l ON l.pm = p.match_id AND l.ps = p.side
GROUP BY p.match_id, p.side, p.t""",
        elo_fold("{} || '|' || map_name"),
    )
)

QUERIES = {
    "family_series": (family_series, SERIES),
    "family_form": (family_form, FORM),
    "family_map": (family_map, MAP),
}
