"""Queries of tournaments, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..functions import DAY
from ..operators import compose, explain, metrics, models, prep, reports, tournament
from ..operators.streams import sides
from ..scratch import kept
from .adapter import kept_matches, kept_sides, match_sides, player_rows, sql
from .history_queries import rounded
from .model_queries import features


def strength(spark, sf_dir):
    """Smoothed win rates as ratings, of all teams."""
    rows = kept_sides(spark, sf_dir).groupBy("team").agg(F.sum("win").alias("w"), F.count("*").alias("n"))
    return rows.select("team", (F.lit(1500.0) + ((F.col("w") + 2) / (F.col("n") + 4) - 0.5) * 800).alias("rating"), "w", "n")


def entrants(spark, sf_dir):
    """The 32 teams with most wins: eight for stage 3, eight for stage 2, sixteen for stage 1."""
    top = kept(metrics.top_k(strength(spark, sf_dir), 32, F.desc("w"), F.asc("n"), F.asc("team")))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("w"), "n", "team"))  # 32 rows
    ranked = top.withColumn("k", rank)
    stage = F.when(F.col("k") <= 8, 3).when(F.col("k") <= 16, 2).otherwise(1)
    return kept(ranked.select("team", "rating", stage.alias("stage"), F.when(F.col("k") <= 16, (F.col("k") - 1) % 8 + 1).otherwise(F.col("k") - 16).alias("seed0")))


def pair_matrix(spark, sf_dir):
    return rounded(tournament.matrix_of(entrants(spark, sf_dir)), "p", places=9)


MATRIX = sql(
    """
SELECT x.team AS a, y.team AS b, best_of, round(CASE best_of WHEN 1 THEN p WHEN 3 THEN p * p * (3 - 2 * p) ELSE p ** 3 * (10 - 15 * p + 6 * p * p) END, 9) AS p
FROM top x JOIN top y ON x.team <> y.team, LATERAL (SELECT 1 / (1 + power(10, (y.rating - x.rating) / 400)) AS p), (SELECT unnest([1, 3, 5]) AS best_of)""",
    "top AS (SELECT team, 1500 + ((sum(win) + 2) / CAST(count(*) + 4 AS DOUBLE) - 0.5) * 800 AS rating FROM sides GROUP BY team ORDER BY sum(win) DESC, count(*), team LIMIT 32)",
)


def tournament_path(spark, sf_dir):
    """The event in which every favourite wins."""
    who = entrants(spark, sf_dir)
    return tournament.major(spark.range(1).withColumnRenamed("id", "sim"), who, tournament.matrix_of(who)).select("team", "stage", "wins", "losses", "place")


def monte_carlo(spark, sf_dir):
    who = entrants(spark, sf_dir)
    n = 500
    runs = tournament.major(spark.range(n).withColumnRenamed("id", "sim"), who, kept(tournament.matrix_of(who)), seed=42)
    return tournament.probabilities(runs, n)


def conservation(spark, sf_dir):
    """Sums over all teams of what the simulated events count: one title an event, two finalists, four, eight."""
    n = 50
    who = entrants(spark, sf_dir)
    runs = kept(tournament.major(spark.range(n).withColumnRenamed("id", "sim"), who, kept(tournament.matrix_of(who)), seed=7))
    return reports.conservation(tournament.probabilities(runs, n), {"title": n, "final": 2 * n, "semi": 4 * n, "playoffs": 8 * n, "past_2": 16 * n, "past_1": 24 * n, "p_title": 1})


def participants(spark, sf_dir):
    """The 32 entrants against the rules (no rows: valid), and the same with one team moved to another stage."""
    who, counts = entrants(spark, sf_dir), {1: 16, 2: 8, 3: 8}
    moved = who.withColumn("stage", F.when((F.col("stage") == 3) & (F.col("seed0") == 8), 2).otherwise(F.col("stage")))
    return reports.participants_problems(who, counts).withColumn("entrants", F.lit("as they are")).unionByName(reports.participants_problems(moved, counts).withColumn("entrants", F.lit("one moved")))


PARTICIPANTS = sql(
    """
SELECT entrants, stage, 'wrong number of teams' AS problem FROM (SELECT unnest(['as they are', 'one moved']) AS entrants) CROSS JOIN (SELECT unnest([1, 2, 3]) AS stage) LEFT JOIN stages USING (entrants, stage)
WHERE coalesce(n, 0) <> CASE stage WHEN 1 THEN 16 ELSE 8 END
UNION ALL SELECT entrants, stage, 'seeds are not 1 to n' FROM stages WHERE seeds <> range(1, n + 1)""",
    "top AS (SELECT team, row_number() OVER (ORDER BY sum(win) DESC, count(*), team) AS k FROM sides GROUP BY team ORDER BY k LIMIT 32)",
    "entered AS (SELECT CASE WHEN k <= 8 THEN 3 WHEN k <= 16 THEN 2 ELSE 1 END AS stage, CASE WHEN k <= 16 THEN (k - 1) % 8 + 1 ELSE k - 16 END AS seed FROM top)",
    "both_ways AS (SELECT entrants, CASE WHEN entrants = 'one moved' AND stage = 3 AND seed = 8 THEN 2 ELSE stage END AS stage, seed FROM entered, (SELECT unnest(['as they are', 'one moved']) AS entrants))",
    "stages AS (SELECT entrants, stage, count(*) AS n, list(seed ORDER BY seed) AS seeds FROM both_ways GROUP BY ALL)",
)


def round1_pairs(spark, sf_dir):
    who = entrants(spark, sf_dir).where("stage = 1").withColumn("sim", F.lit(0))
    return tournament.pairings(tournament.start(who), 1).select(F.col("a.team").alias("a"), F.col("b.team").alias("b"))


def buchholz(spark, sf_dir):
    """Difficulty after three rounds in which the better seed always wins."""
    who = entrants(spark, sf_dir).where("stage = 1")
    even = tournament.matrix_of(who.withColumn("rating", -F.col("seed0").cast("double")))
    state = tournament.start(who.withColumn("sim", F.lit(0)))
    for k in (1, 2, 3):
        state = kept(tournament.swiss_round(state, even, 1, k))
    return tournament.seeded(state).select("team", "wins", "losses", "difficulty", "seed")


def priority_pairing(spark, sf_dir):
    """Pairs of rounds four and five of stage 1, taken from the table of priorities, when every favourite wins."""
    who = entrants(spark, sf_dir).where("stage = 1")
    even, out = kept(tournament.matrix_of(who)), None
    state = tournament.start(who.withColumn("sim", F.lit(0)))
    for k in (1, 2, 3, 4, 5):
        if k > 3:
            rows = tournament.pairings(state, k).select(F.lit(k).alias("round"), "wins", "losses", F.col("a.team").alias("a"), F.col("b.team").alias("b"))
            out = rows if out is None else out.unionByName(rows)
        if k < 5:
            state = kept(tournament.swiss_round(state, even, 1, k))
    return out


COLUMNS = ["win_rate_diff", "format_win_rate_diff", "n_before_diff"]


def _prepared(spark, sf_dir):
    rows = prep.chronological_split(features(spark, sf_dir))
    train = rows.where("split = 'train'")
    return kept(prep.scale(rows, prep.fit_scaler(train, COLUMNS), COLUMNS))


def lr_gradient_descent(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    fit = models.gradient_descent(rows.where("split = 'train'"), COLUMNS, "win1", steps=40)
    scored = rows.withColumns({"p": fit.probability(), "y": F.col("win1")})
    return rounded(metrics.binary(scored, "split").select("split", "n", "log_loss", "brier", "accuracy"), "log_loss", "brier", "accuracy")


def _trees(kind):
    def query(spark, sf_dir):
        rows = _prepared(spark, sf_dir)
        fit = models.trees(rows.where("split = 'train'"), COLUMNS, "win1", kind, 10, 4)
        scored = models.tree_probability(fit, rows).withColumn("y", F.col("win1"))
        return rounded(metrics.binary(scored, "split").select("split", "n", "log_loss", "brier", "accuracy"), "log_loss", "brier", "accuracy")

    return query


def path_attribution(spark, sf_dir):
    """Parts of a forest's probabilities and their sum against the prediction."""
    rows = _prepared(spark, sf_dir)
    fit = models.trees(rows.where("split = 'train'"), COLUMNS, "win1", "forest", 5, 3)
    parts = explain.path_shares(rows, fit.stages[-1], COLUMNS)
    p = models.tree_probability(fit, rows).select("match_id", "p")
    total = F.col("bias") + sum((F.col(c) for c in COLUMNS), F.lit(0.0))
    return parts.join(p, "match_id").select("match_id", F.round("p", 6).alias("p"), F.round(total - F.col("p"), 6).alias("gap"), *[F.round(c, 6).alias(c) for c in COLUMNS])


def permutation_importance(spark, sf_dir):
    rows = _prepared(spark, sf_dir)
    fit = models.gradient_descent(rows.where("split = 'train'"), COLUMNS, "win1", steps=20)
    groups = {"rates": COLUMNS[:2], "experience": COLUMNS[2:]}
    return rounded(models.permutation_importance(rows.where("split = 'validation'"), groups, fit.probability(), "win1"), "loss")


def streaming_windows(spark, sf_dir):
    """Hourly counts by type of the event stream; every fiftieth event arrives a week late and still counts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    late = F.when(F.col("event_id") % 50 == 7, F.col("ts") + F.expr("INTERVAL 7 DAYS")).otherwise(F.col("ts"))
    made = streaming.fed(events.withColumn("arrival", late), streaming.WindowTotals, "arrival")
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def streaming_prior_counts(spark, sf_dir):
    """All sides as a stream in which one match of fifty arrives three months late: the same counts as the batch frames."""
    rows = match_sides(spark, sf_dir).where("elig").select("match_id", "side", "team", "t", "win")
    late = F.when(F.col("match_id") % 50 == 7, F.col("t") + 90 * DAY).otherwise(F.col("t"))
    return streaming.fed(rows.withColumn("arrival", late), streaming.PriorCounts, "arrival")


def rich_map_features(spark, sf_dir):
    """62 directional, 30 symmetric and 3 categorical features of every match."""
    games = kept_matches(spark, sf_dir)
    return compose.rich(sides(games), player_rows(spark, sf_dir, games))


def modern_map_features(spark, sf_dir):
    """The same with the selected-map family: 80, 37 and 3."""
    games = kept_matches(spark, sf_dir)
    return compose.rich(sides(games), player_rows(spark, sf_dir, games), modern=True)


QUERIES = {
    "rich_map_features": (rich_map_features, None),
    "modern_map_features": (modern_map_features, None),
    "pair_matrix": (pair_matrix, MATRIX),
    "tournament_path": (tournament_path, None),
    "monte_carlo": (monte_carlo, None),
    "monte_carlo_conservation": (conservation, None),
    "participants_validation": (participants, PARTICIPANTS),
    "round1_pairs": (round1_pairs, sql("SELECT x.team AS a, y.team AS b FROM top x JOIN top y ON y.k = x.k + 8 AND x.k BETWEEN 17 AND 24", "top AS (SELECT team, row_number() OVER (ORDER BY sum(win) DESC, count(*), team) AS k FROM sides GROUP BY team)")),
    "buchholz": (buchholz, None),
    "priority_pairing": (priority_pairing, None),
    "lr_gradient_descent": (lr_gradient_descent, None),
    "forest_fit": (_trees("forest"), None),
    "gbt_fit": (_trees("boosted"), None),
    "path_attribution": (path_attribution, None),
    "permutation_importance": (permutation_importance, None),
    "streaming_windows": (streaming_windows, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "streaming_prior_counts": (streaming_prior_counts, sql("SELECT match_id, side, count(*) OVER w AS n_before, CAST(coalesce(sum(win) OVER w, 0) AS BIGINT) AS wins_before FROM ledger WINDOW w AS (PARTITION BY team ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")),
}
