"""Queries of map pools, selected maps and rosters."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import history, pool, prefix, ratings, roster
from ..operators.asof import asof
from ..operators.streams import ledger, matchups, sides
from ..scratch import kept
from .adapter import kept_matches, kept_sides, matches, player_rows, sql
from .history_queries import elo_fold, rounded

# Probes are the eligible sides; states on maps come from the same rows.
AS_OF = """
st AS (SELECT p.match_id, p.side, p.t, p.map_name AS own_map, l.map_name, count(*) AS n, sum(l.win) AS wins, avg(l.norm_margin) AS margin, max(l.t) AS last_t,
    (sum(l.win) + 2) / CAST(count(*) + 4 AS DOUBLE) AS rate
  FROM ledger p JOIN ledger l ON p.team = l.team AND l.t < p.t GROUP BY ALL),
pl AS (SELECT * FROM st WHERE last_t >= t - 15552000000000)
"""


def _pools(spark, sf_dir):
    rows = ledger(kept_sides(spark, sf_dir))
    states = kept(pool.map_states(rows))
    return rows, states, pool.pools(rows, states)


def pool_order_stats(spark, sf_dir):
    made = pool.profiles(_pools(spark, sf_dir)[2])
    cols = ["mean_rate", "mean_margin", "best_rate", "second_rate", "third_rate", "worst_rate"]
    return rounded(made.select("match_id", "side", "size", "matches", "experienced", *cols), *cols)


POOL = sql(
    """
SELECT match_id, side, count(*) AS size, CAST(sum(n) AS BIGINT) AS matches, count(*) FILTER (n >= 5) AS experienced, round(avg(rate), 6) AS mean_rate, round(avg(margin), 6) AS mean_margin,
  round(max(rate), 6) AS best_rate, round(coalesce(list_reverse_sort(list(rate))[2], 0.5), 6) AS second_rate, round(coalesce(list_reverse_sort(list(rate))[3], 0.5), 6) AS third_rate, round(min(rate), 6) AS worst_rate
FROM pl GROUP BY match_id, side""",
    AS_OF,
)


def pool_advantage(spark, sf_dir):
    rows, _, pools = _pools(spark, sf_dir)
    made = pool.advantages(pools, rows)
    cols = ["mean_rate_advantage", "median_rate_advantage", "coverage"]
    return rounded(made.select("match_id", "union_maps", "shared_maps", "shared_experienced", *cols), *cols)


ADVANTAGE = sql(
    """
SELECT match_id, count(*) AS union_maps, count(*) FILTER (shared) AS shared_maps, count(*) FILTER (shared_old) AS shared_experienced,
  round(avg(d), 6) AS mean_rate_advantage, round(median(d), 6) AS median_rate_advantage, round(count(*) FILTER (shared) / CAST(count(*) AS DOUBLE), 6) AS coverage
FROM (SELECT u.match_id, u.map_name, coalesce(a.rate, 0.5) - coalesce(b.rate, 0.5) AS d,
    coalesce(a.last_t >= a.t - 15552000000000, false) AND coalesce(b.last_t >= b.t - 15552000000000, false) AS shared,
    coalesce(a.last_t >= a.t - 15552000000000 AND a.n >= 5, false) AND coalesce(b.last_t >= b.t - 15552000000000 AND b.n >= 5, false) AS shared_old
  FROM (SELECT DISTINCT match_id, map_name FROM pl WHERE match_id IN (SELECT match_id FROM series WHERE elig1 AND elig2)) u
  LEFT JOIN st a ON a.match_id = u.match_id AND a.map_name = u.map_name AND a.side = 1
  LEFT JOIN st b ON b.match_id = u.match_id AND b.map_name = u.map_name AND b.side = 2)
GROUP BY match_id""",
    AS_OF,
)


def rank_percentile(spark, sf_dir):
    pools = _pools(spark, sf_dir)[2].withColumn("elo", F.round("rate", 9))
    made = pool.rank_percentile(pools)
    return made.select("match_id", "side", "map_name", F.round("percentile", 6).alias("percentile"))


RANKS = sql(
    """
SELECT match_id, side, map_name, CASE WHEN c = 1 THEN 1.0::DOUBLE ELSE round(1 - (rn - 1) / CAST(c - 1 AS DOUBLE), 6) END AS percentile
FROM (SELECT *, row_number() OVER (PARTITION BY match_id, side ORDER BY round(rate, 9) DESC, map_name) AS rn, count(*) OVER (PARTITION BY match_id, side) AS c FROM pl)""",
    AS_OF,
)


def pool_elo(spark, sf_dir):
    """Rating order statistics of the pool, from the fold by map."""
    rated = ratings.rate(kept_sides(spark, sf_dir), ("team", "map_name")).where("elig")
    rated = kept(rated.select("match_id", "side", "team", "map_name", "t", "win", "norm_margin", "change"))
    states = kept(pool.map_states(rated))
    made = pool.profiles(pool.pools(rated, states))
    cols = ["mean_elo", "best_elo", "second_elo", "third_elo", "worst_elo"]
    return rounded(made.select("match_id", "side", *cols), *cols, places=5)


POOL_ELO = sql(
    """
SELECT match_id, side, round(avg(elo), 5) AS mean_elo, round(max(elo), 5) AS best_elo, round(coalesce(list_reverse_sort(list(elo))[2], 1500), 5) AS second_elo,
  round(coalesce(list_reverse_sort(list(elo))[3], 1500), 5) AS third_elo, round(min(elo), 5) AS worst_elo
FROM (SELECT p.match_id, p.side, l.map_name, 1500 + sum(l.d) AS elo, max(l.t) AS last_t, any_value(p.t) AS t FROM ledger p JOIN ch l ON p.team = l.team AND l.t < p.t GROUP BY p.match_id, p.side, l.map_name)
WHERE last_t >= t - 15552000000000 GROUP BY match_id, side""",
    elo_fold("{} || '|' || map_name"),
    """
ch AS (SELECT l.team, l.t, l.map_name, CASE WHEN l.trusted THEN 32 * (l.win - 1 / (1 + power(10, (CASE WHEN l.side = 1 THEN m2 - m1 ELSE m1 - m2 END) / 400))) ELSE 0 END AS d
  FROM ledger l JOIN fold f ON f.match_id = l.match_id)""",
).replace("WITH ", "WITH RECURSIVE ", 1)


def map_form(spark, sf_dir):
    """On the match's own map: prior matches, smoothed rate, last five, margins, days since."""
    rows = ledger(kept_sides(spark, sf_dir))
    rows = prefix.prior(rows, ["team", "map_name"], {"n": F.lit(1).cast("long"), "wins": F.col("win"), "m": F.col("norm_margin")}).fillna(0, ["n", "wins"])
    rows = rows.withColumn("margin_all", F.col("m") / F.nullif("n", F.lit(0)))
    rows = history.last_n(rows, (5, 10), ("win", "norm_margin"), ("team", "map_name"))
    rows = rows.select("match_id", "side", "n", ((F.col("wins") + 2) / (F.col("n") + 4)).alias("rate"), F.coalesce("win_last_5", F.lit(0.5)).alias("last5"), F.coalesce("norm_margin_last_10", F.lit(0.0)).alias("margin10"), F.coalesce("margin_all", F.lit(0.0)).alias("margin_all"))
    made = matchups(rows, ["rate", "last5", "margin10", "margin_all", "n"], ["n"], ["n"])
    return rounded(made, "rate_diff", "last5_diff", "margin10_diff", "margin_all_diff")


MAP_FORM = sql(
    """
SELECT a.match_id, round(a.rate - b.rate, 6) AS rate_diff, round(a.last5 - b.last5, 6) AS last5_diff, round(a.margin10 - b.margin10, 6) AS margin10_diff, round(a.margin_all - b.margin_all, 6) AS margin_all_diff,
  a.n - b.n AS n_diff, least(a.n, b.n) AS n_min, a.n + b.n AS n_sum
FROM mf a JOIN mf b ON a.match_id = b.match_id AND a.side = 1 AND b.side = 2""",
    """
mf AS (SELECT p.match_id, p.side, count(l.match_id) AS n, (coalesce(sum(l.win), 0) + 2) / CAST(count(l.match_id) + 4 AS DOUBLE) AS rate, coalesce(avg(l.win) FILTER (k <= 5), 0.5) AS last5,
    coalesce(avg(l.norm_margin) FILTER (k <= 10), 0) AS margin10, coalesce(avg(l.norm_margin), 0) AS margin_all
  FROM ledger p LEFT JOIN (SELECT a.match_id AS pm, a.side AS ps, q.match_id, q.win, q.norm_margin, row_number() OVER (PARTITION BY a.match_id, a.side ORDER BY q.t DESC, q.match_id DESC) AS k
    FROM ledger a JOIN ledger q ON q.team = a.team AND q.map_name = a.map_name AND q.t < a.t) l ON l.pm = p.match_id AND l.ps = p.side
  GROUP BY p.match_id, p.side)""",
)


def asof_probe(spark, sf_dir):
    """Read-only probes at the start of each month for every team: its last state strictly before."""
    rows = ledger(kept_sides(spark, sf_dir))
    states = rows.groupBy("team", "t").agg(F.count("*").alias("c"), F.sum("win").alias("w"))
    from pyspark.sql import Window

    run = Window.partitionBy("team").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    states = states.select("team", "t", F.sum("c").over(run).alias("n"), F.sum("w").over(run).alias("wins"), F.col("t").alias("last_t"))
    months = rows.select(F.unix_micros(F.date_trunc("month", F.timestamp_micros("t"))).alias("t")).distinct()
    probes = rows.select("team").distinct().join(months)
    return asof(probes, states, ["team"], ["n", "wins", "last_t"])


ASOF = sql(
    """
SELECT team, m.t, n, wins, last_t FROM (SELECT DISTINCT team FROM ledger) CROSS JOIN (SELECT DISTINCT epoch_us(date_trunc('month', dt)) AS t FROM ledger) m
LEFT JOIN LATERAL (SELECT nullif(count(*), 0) AS n, CAST(sum(win) AS BIGINT) AS wins, max(l.t) AS last_t FROM ledger l WHERE l.team = team AND l.t < m.t) ON true"""
).replace("FROM ledger l WHERE l.team = team AND", "FROM ledger l WHERE l.team = x.team AND").replace("(SELECT DISTINCT team FROM ledger) CROSS", "(SELECT DISTINCT team FROM ledger) x CROSS").replace("SELECT team, m.t", "SELECT x.team, m.t")


def requests_of(spark, sf_dir, asked):
    """Requests that change nothing on one time axis with the events: a request sees what came before it alone."""
    rows = ledger(kept_sides(spark, sf_dir))
    requests = asked.select("match_id", F.unix_micros(F.col("dt").cast("timestamp")).alias("t"), F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("team1").alias("team")), F.struct(F.lit(2).alias("side"), F.col("team2").alias("team")))).alias("s")).select("match_id", "t", "s.*")
    both = rows.select("team", "t", "win", F.lit(None).cast("struct<match_id:bigint,side:int>").alias("ask")).unionByName(requests.select("team", "t", F.lit(None).cast("int").alias("win"), F.struct("match_id", "side").alias("ask")))
    made = prefix.prior(both, ["team"], {"n": F.when(F.col("win").isNotNull(), F.lit(1).cast("long")), "wins": F.col("win")}).where("ask is not null").fillna(0, ["n", "wins"])
    return made.select("ask.match_id", "ask.side", "n", "wins")


def two_stream_requests(spark, sf_dir):
    """Every match asks a day later, when it and all others of its day have happened."""
    return requests_of(spark, sf_dir, matches(spark, sf_dir).withColumn("dt", F.col("dt") + F.expr("INTERVAL 1 DAY")))


def two_stream_requests_all(spark, sf_dir):
    """Every match asks."""
    return requests_of(spark, sf_dir, matches(spark, sf_dir))


REQUESTS = sql(
    """
SELECT s.match_id, s.side, count(l.match_id) AS n, CAST(coalesce(sum(l.win), 0) AS BIGINT) AS wins FROM sides s LEFT JOIN ledger l ON l.team = s.team AND l.t < s.t + 86400000000
GROUP BY 1, 2"""
)

REQUESTS_ALL = sql(
    """
SELECT s.match_id, s.side, count(l.match_id) AS n, CAST(coalesce(sum(l.win), 0) AS BIGINT) AS wins FROM sides s LEFT JOIN ledger l ON l.team = s.team AND l.t < s.t
GROUP BY 1, 2"""
)


def selected_map_decay(spark, sf_dir):
    """Decayed, smoothed rate and margin on the match's map, half-life 90 days."""
    rows = history.decayed(ledger(kept_sides(spark, sf_dir)), 90, ("win", "norm_margin"), ("team", "map_name"))
    rate = (F.coalesce(F.col("tw_win") * F.col("tw_mass"), F.lit(0.0)) + 2) / (F.col("tw_mass") + 4)
    made = matchups(rows.withColumns({"rate": rate, "m": F.coalesce("tw_norm_margin", F.lit(0.0)), "mass": F.col("tw_mass")}), ["rate", "m", "mass"], ["mass"])
    return rounded(made, "rate_diff", "m_diff", "mass_diff", "mass_min")


SELECTED = sql(
    """
SELECT a.match_id, round(a.rate - b.rate, 6) AS rate_diff, round(a.m - b.m, 6) AS m_diff, round(a.mass - b.mass, 6) AS mass_diff, round(least(a.mass, b.mass), 6) AS mass_min
FROM d a JOIN d b ON a.match_id = b.match_id AND a.side = 1 AND b.side = 2""",
    """
d AS (SELECT p.match_id, p.side, coalesce(sum(w), 0) AS mass, (coalesce(sum(w * l.win), 0) + 2) / (coalesce(sum(w), 0) + 4) AS rate, coalesce(sum(w * l.norm_margin) / sum(w), 0) AS m
  FROM ledger p LEFT JOIN LATERAL (SELECT win, norm_margin, power(0.5, (p.t - q.t) / 86400000000.0 / 90) AS w FROM ledger q WHERE q.team = p.team AND q.map_name = p.map_name AND q.t < p.t) l ON true
  GROUP BY p.match_id, p.side)""",
)


def _roster(spark, sf_dir):
    played = kept_matches(spark, sf_dir)
    probes = ledger(sides(played))
    players = kept(player_rows(spark, sf_dir, played).where("elig"))
    seen = kept(roster.appearances(players))
    mass = roster.masses(probes, seen)
    return probes, players, seen, mass, roster.top_five(mass)


def roster_top5(spark, sf_dir):
    core = _roster(spark, sf_dir)[4]
    return core.select("match_id", "side", "player", "rank", F.round("mass", 6).alias("mass"))


CORE = """
seen AS (SELECT DISTINCT team, player, match_id, t FROM players WHERE elig),
mass AS (SELECT p.match_id, p.side, p.t, s.player, sum(power(0.5, (p.t - s.t) / 5184000000000.0)) AS mass, max(s.t) AS last_t
  FROM ledger p JOIN seen s ON s.team = p.team AND s.t < p.t AND s.t >= p.t - 7776000000000 GROUP BY ALL),
core AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, side ORDER BY round(mass, 9) DESC, last_t DESC, player) AS rank FROM mass) WHERE rank <= 5),
games AS (SELECT * FROM (SELECT p.match_id, p.side, g.match_id AS game, g.t, row_number() OVER (PARTITION BY p.match_id, p.side ORDER BY g.t DESC, g.match_id DESC) AS k
    FROM ledger p JOIN (SELECT DISTINCT team, match_id, t FROM seen) g ON g.team = p.team AND g.t < p.t) WHERE k <= 10)
"""


def core_concentration(spark, sf_dir):
    mass = _roster(spark, sf_dir)[3]
    return rounded(roster.concentration(mass).select("match_id", "side", "roster_size", "concentration"), "concentration")


def roster_unique_players(spark, sf_dir):
    probes, _, seen, _, _ = _roster(spark, sf_dir)
    return roster.unique_players(roster.recent_games(probes, seen, 10))


def core_continuity(spark, sf_dir):
    probes, _, seen, _, core = _roster(spark, sf_dir)
    return rounded(roster.continuity(roster.recent_games(probes, seen, 10), core), "continuity")


VALUES = ["adr", "kast", "kd"]


def player_form_decay(spark, sf_dir):
    """Decayed form of the inferred roster: mean, best and worst player."""
    _, players, _, _, core = _roster(spark, sf_dir)
    # written once: the form counts its cells, finds who is asked for, and answers, and each would make all pairs again
    asked = kept(core.select("match_id", "side", "player", "t"))
    form = roster.player_form(asked, roster.player_states(players, VALUES), VALUES)
    made = roster.roster_form(form, VALUES)
    cols = ["mean_mass", "min_mass", *[f"{n}_{v}" for v in VALUES for n in ("mean", "top", "bottom")]]
    return rounded(made, *cols, places=5)


FORM = sql(
    """
SELECT match_id, side, count(*) AS roster_size, count(adr) AS form_players, round(avg(m), 5) AS mean_mass, round(min(m), 5) AS min_mass,
  round(avg(adr), 5) AS mean_adr, round(max(adr), 5) AS top_adr, round(min(adr), 5) AS bottom_adr, round(avg(kast), 5) AS mean_kast, round(max(kast), 5) AS top_kast, round(min(kast), 5) AS bottom_kast,
  round(avg(kd), 5) AS mean_kd, round(max(kd), 5) AS top_kd, round(min(kd), 5) AS bottom_kd
FROM (SELECT c.match_id, c.side, c.player, coalesce(sum(w), 0) AS m, sum(w * adr) / sum(w) AS adr, sum(w * kast) / sum(w) AS kast, sum(w * kd) / sum(w) AS kd
  FROM core c LEFT JOIN LATERAL (SELECT adr, kast, kd, power(0.5, (c.t - p.t) / 5184000000000.0) AS w FROM players p WHERE p.elig AND p.player = c.player AND p.t < c.t) ON true
  GROUP BY c.match_id, c.side, c.player) GROUP BY match_id, side""",
    CORE,
)

QUERIES = {
    "pool_180d_order_stats": (pool_order_stats, POOL),
    "pool_same_map_advantage": (pool_advantage, ADVANTAGE),
    "rank_percentile": (rank_percentile, RANKS),
    "pool_elo_order_stats": (pool_elo, POOL_ELO),
    "map_form_smoothed": (map_form, MAP_FORM),
    "asof_probe": (asof_probe, ASOF),
    "two_stream_requests": (two_stream_requests, REQUESTS),
    "two_stream_requests_all": (two_stream_requests_all, REQUESTS_ALL),
    "selected_map_decay": (selected_map_decay, SELECTED),
    "roster_top5": (roster_top5, sql("SELECT match_id, side, player, rank, round(mass, 6) AS mass FROM core", CORE)),
    "core_concentration": (core_concentration, sql("SELECT match_id, side, (SELECT count(*) FROM core c WHERE c.match_id = m.match_id AND c.side = m.side) AS roster_size, round(sum(mass) FILTER (rank <= 5) / sum(mass), 6) AS concentration FROM (SELECT *, row_number() OVER (PARTITION BY match_id, side ORDER BY round(mass, 9) DESC, last_t DESC, player) AS rank FROM mass) m GROUP BY match_id, side", CORE)),
    "roster_unique_players": (roster_unique_players, sql("SELECT g.match_id, g.side, count(DISTINCT s.player) AS unique_players FROM games g JOIN ledger p ON p.match_id = g.match_id AND p.side = g.side JOIN seen s ON s.match_id = g.game AND s.team = p.team GROUP BY 1, 2", CORE)),
    "core_continuity": (core_continuity, sql("SELECT match_id, side, round(avg(share), 6) AS continuity FROM (SELECT g.match_id, g.side, g.game, count(s.player) / CAST(any_value(size) AS DOUBLE) AS share FROM games g JOIN ledger p ON p.match_id = g.match_id AND p.side = g.side JOIN (SELECT match_id, side, list(player) AS pl, count(*) AS size FROM core GROUP BY 1, 2) c ON c.match_id = g.match_id AND c.side = g.side LEFT JOIN seen s ON s.match_id = g.game AND s.team = p.team AND list_contains(c.pl, s.player) GROUP BY 1, 2, 3) GROUP BY 1, 2", CORE)),
    "player_form_decay": (player_form_decay, FORM),
}
