"""Queries of preparation, splits, metrics and series arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expected, micros
from ..operators import history, metrics, prep, series
from ..operators.streams import ledger, matchups, sides
from ..scratch import drop, kept
from .adapter import kept_matches, matches, sql
from .history_queries import WINDOWS, rounded

SPEC = prep.FeatureSpec(["win_rate_diff", "format_win_rate_diff", "days_since_last_diff", "n_before_diff"], ["n_before_min"], {"map_name": []})


def features(spark, sf_dir):
    """Kept: splits, folds, quantiles and fits go over it many times."""
    played = kept_matches(spark, sf_dir)
    rows = matchups(history.prior_counts(ledger(sides(played))), ["win_rate", "format_win_rate", "days_since_last", "n_before"], ["n_before"])
    made = kept(rows.join(played.select("match_id", "dt", "win1", "map_name", "tier", "best_of"), "match_id").withColumn("t", micros(F.col("dt"))))
    drop(played)
    return made


FEATURES = """
fe AS (SELECT a.match_id, a.t, a.win AS win1, a.map_name, a.tier, a.best_of, a.win_rate - b.win_rate AS win_rate_diff, a.format_win_rate - b.format_win_rate AS format_win_rate_diff,
    a.days_since_last - b.days_since_last AS days_since_last_diff, a.n_before - b.n_before AS n_before_diff, least(a.n_before, b.n_before) AS n_before_min
  FROM s a JOIN s b ON a.match_id = b.match_id AND a.side = 1 AND b.side = 2),
cum AS (SELECT t, sum(count(*)) OVER (ORDER BY t) AS upto FROM fe GROUP BY t),
tot AS (SELECT max(upto) AS n FROM cum)
"""


def cut(share: str) -> str:
    return f"(SELECT arg_min(t, (abs(upto - n * {share}), t)) FROM cum, tot)"


def mirror_augment(spark, sf_dir):
    rows = prep.augment(features(spark, sf_dir).select("match_id", "win1", *SPEC.numeric), SPEC)
    return rounded(rows, "win_rate_diff", "format_win_rate_diff", "days_since_last_diff").withColumns({c: F.col(c) + 0.0 for c in ("win_rate_diff", "format_win_rate_diff", "days_since_last_diff")})


MIRROR = sql(
    """
SELECT match_id, CASE WHEN m = 0 THEN win1 ELSE 1 - win1 END AS win1, m AS mirrored, round(k * win_rate_diff, 6) + 0.0 AS win_rate_diff, round(k * format_win_rate_diff, 6) + 0.0 AS format_win_rate_diff,
  round(k * days_since_last_diff, 6) + 0.0 AS days_since_last_diff, k * n_before_diff AS n_before_diff, n_before_min
FROM fe CROSS JOIN (VALUES (0, 1), (1, -1)) v(m, k)""",
    WINDOWS,
    FEATURES,
)


def impute_zscore(spark, sf_dir):
    rows = features(spark, sf_dir)
    cols = ["win_rate_diff", "days_since_last_diff"]
    return rounded(prep.scale(rows, prep.fit_scaler(rows, cols), cols).select("match_id", *cols), *cols)


ZSCORE = sql(
    """
SELECT match_id, round((win_rate_diff - m1) / s1, 6) AS win_rate_diff, round((coalesce(days_since_last_diff, med) - m2) / s2, 6) AS days_since_last_diff
FROM fe, (SELECT avg(win_rate_diff) AS m1, stddev_samp(win_rate_diff) AS s1, avg(coalesce(days_since_last_diff, med)) AS m2, stddev_samp(coalesce(days_since_last_diff, med)) AS s2, any_value(med) AS med
  FROM fe, (SELECT median(days_since_last_diff) AS med FROM fe))""",
    WINDOWS,
    FEATURES,
)


def one_hot_unknown(spark, sf_dir):
    rows = prep.one_hot(matches(spark, sf_dir), "map_name", ["ECONOMY", "PROMO", "STANDARD"], "PROMO")
    return rows.select("match_id", F.col("map_name=ECONOMY").alias("economy"), F.col("map_name=STANDARD").alias("standard"), F.col("map_name=unknown").alias("unknown"))


def chrono_split(spark, sf_dir):
    return prep.chronological_split(features(spark, sf_dir)).select("match_id", "split")


def expanding_folds(spark, sf_dir):
    return prep.expanding_folds(prep.blocks(features(spark, sf_dir))).groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


FOLDS = sql(
    f"""
SELECT fold, CASE WHEN block <= fold THEN 'train' ELSE 'validation' END AS part, count(*) AS n, min(t) AS first_t, max(t) AS last_t
FROM (SELECT t, 1 + CAST(t > {cut('0.2')} AS INTEGER) + CAST(t > {cut('0.4')} AS INTEGER) + CAST(t > {cut('0.6')} AS INTEGER) + CAST(t > {cut('0.8')} AS INTEGER) AS block FROM fe), (SELECT unnest([1, 2, 3, 4]) AS fold)
WHERE block <= fold + 1 GROUP BY 1, 2""",
    WINDOWS,
    FEATURES,
)


def inner_early_stop(spark, sf_dir):
    return prep.early_stop_split(features(spark, sf_dir)).groupBy("inner").agg(F.count("*").alias("n"), F.max("t").alias("last_t"))


def scored(spark, sf_dir):
    """Predictions from the smoothed rates: y, p and a second arm p2."""
    rows = features(spark, sf_dir)
    p = F.round(1 / (1 + F.exp(F.col("win_rate_diff") * -6)), 4)
    p2 = F.round(1 / (1 + F.exp(F.col("format_win_rate_diff") * -4)), 4)
    return rows.select("match_id", "map_name", "tier", "best_of", F.col("win1").alias("y"), p.alias("p"), p2.alias("p2"))


SCORED = "sc AS (SELECT match_id, map_name, tier, best_of, win1 AS y, round(1 / (1 + exp(win_rate_diff * -6)), 4) AS p, round(1 / (1 + exp(format_win_rate_diff * -4)), 4) AS p2 FROM fe)"


def binary_metrics(spark, sf_dir):
    cols = ["log_loss", "brier", "accuracy", "precision", "recall", "f1", "majority"]
    return rounded(metrics.binary(scored(spark, sf_dir), "tier"), *cols)


BINARY = sql(
    """
SELECT tier, n, tp, fp, fn, tn, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round((tp + tn) / n::DOUBLE, 6) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 6) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 6) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) ELSE 0 END AS f1,
  round(greatest(tp + fn, fp + tn) / n::DOUBLE, 6) AS majority, n < 30 AS small_sample
FROM (SELECT tier, count(*) AS n, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn,
  avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss, avg((p - y) ** 2) AS brier FROM sc GROUP BY tier)""",
    WINDOWS,
    FEATURES,
    SCORED,
)


def auc_rank(spark, sf_dir):
    return rounded(metrics.auc(scored(spark, sf_dir), "map_name"), "auc")


AUC = sql(
    """
SELECT map_name, round((sum(r) FILTER (y = 1) - np * (np + 1) / 2) / (np * nn), 6) AS auc FROM (
  SELECT map_name, y, rank() OVER (PARTITION BY map_name ORDER BY p) + (count(*) OVER (PARTITION BY map_name, p) - 1) / 2.0 AS r,
    count(*) FILTER (y = 1) OVER (PARTITION BY map_name)::DOUBLE AS np, count(*) FILTER (y = 0) OVER (PARTITION BY map_name)::DOUBLE AS nn FROM sc) GROUP BY map_name, np, nn""",
    WINDOWS,
    FEATURES,
    SCORED,
)


def slice_metrics(spark, sf_dir):
    return rounded(metrics.slices(scored(spark, sf_dir), "map_name", "tier", "best_of"), "accuracy", "brier")


SLICES = sql(
    "SELECT map_name, tier, best_of, count(*) AS n, round(avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)), 6) AS accuracy, round(avg((p - y) ** 2), 6) AS brier FROM sc GROUP BY GROUPING SETS ((), (map_name), (tier), (best_of))",
    WINDOWS,
    FEATURES,
    SCORED,
)


def calibration_bins(spark, sf_dir):
    return rounded(metrics.calibration(scored(spark, sf_dir)), "mean_p", "rate")


def series_macro(spark, sf_dir):
    return rounded(metrics.macro(scored(spark, sf_dir), "map_name"), "macro_log_loss", "macro_brier")


MACRO = sql(
    "SELECT count(*) AS groups, round(avg(ll), 6) AS macro_log_loss, round(avg(br), 6) AS macro_brier FROM (SELECT avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll, avg((p - y) ** 2) AS br FROM sc GROUP BY map_name)",
    WINDOWS,
    FEATURES,
    SCORED,
)

WEIGHTS = [0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0]


def blend_weight_select(spark, sf_dir):
    return rounded(metrics.blend_weights(scored(spark, sf_dir).withColumnRenamed("p", "p1"), WEIGHTS), "log_loss", "brier")


def epsilon_select(spark, sf_dir):
    each = metrics.blend_weights(scored(spark, sf_dir).withColumnRenamed("p", "p1"), WEIGHTS)
    return metrics.select_with_epsilon(each.withColumn("log_loss", F.round("log_loss", 6)), 0.002, F.col("w")).select("w", "log_loss")


BLEND = "bl AS (SELECT w, round(avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS log_loss, round(avg((q - y) ** 2), 6) AS brier FROM (SELECT w, y, w * p + (1 - w) * p2 AS q FROM sc, (SELECT unnest([0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0]::DOUBLE[]) AS w)) GROUP BY w)"


def elo_baseline_prob(spark, sf_dir):
    """A rating baseline: expected score between ratings made of the smoothed rates."""
    rows = features(spark, sf_dir)
    return rows.select("match_id", F.round(expected(F.lit(1500.0) + F.col("win_rate_diff") * 400, F.lit(1500.0)), 6).alias("p"))


def set_jaccard(spark, sf_dir):
    rows = matches(spark, sf_dir)
    made = metrics.set_comparison(rows.where("best_of = 1").select(F.col("team1").alias("team")), rows.where("score1 > 45").select(F.col("team2").alias("team")), "team")
    return rounded(made, "precision", "recall", "jaccard")


JACCARD = sql(
    """
SELECT overlap, round(overlap / na::DOUBLE, 6) AS precision, round(overlap / nb::DOUBLE, 6) AS recall, round(overlap / (na + nb - overlap)::DOUBLE, 6) AS jaccard
FROM (SELECT (SELECT count(*) FROM (SELECT team1 FROM series WHERE best_of = 1 INTERSECT SELECT team2 FROM series WHERE score1 > 45)) AS overlap,
  (SELECT count(DISTINCT team1) FROM series WHERE best_of = 1) AS na, (SELECT count(DISTINCT team2) FROM series WHERE score1 > 45) AS nb)"""
)


def topk_sets(spark, sf_dir):
    rows = matches(spark, sf_dir).groupBy(F.col("team1").alias("team")).agg(F.sum("win1").alias("wins"), F.count("*").alias("n"))
    return metrics.top_k(rows, 16, F.desc("wins"), F.asc("n"), F.asc("team"))


def series_dp(spark, sf_dir):
    """Best-of-three and best-of-five from the smoothed rates as map probabilities."""
    rows = scored(spark, sf_dir).withColumns({"p": F.col("p") * 0.98765 + 0.00617, "p2": F.col("p2") * 0.97531 + 0.01357})
    p = F.col("p")
    rows = rows.withColumns({"p3": F.array(p, F.col("p2"), F.lit(0.4321)), "p5": F.array(p, F.col("p2"), F.lit(0.4321), 1 - p, p)})
    return rows.select("match_id", F.round(series.win_probability(F.col("p3")), 7).alias("bo3"), F.round(series.win_probability(F.col("p5")), 7).alias("bo5"))


DP = sql(
    """
SELECT match_id, round(p * p2 + p * (1 - p2) * 0.4321 + (1 - p) * p2 * 0.4321, 7) AS bo3,
  round((SELECT sum(CASE WHEN a + b + c + d + e >= 3 THEN (CASE a WHEN 1 THEN p ELSE 1 - p END) * (CASE b WHEN 1 THEN p2 ELSE 1 - p2 END) * (CASE c WHEN 1 THEN 0.4321 ELSE 0.5679 END) * (CASE d WHEN 1 THEN 1 - p ELSE p END) * (CASE e WHEN 1 THEN p ELSE 1 - p END) ELSE 0 END)
    FROM (SELECT i % 2 AS a, i // 2 % 2 AS b, i // 4 % 2 AS c, i // 8 % 2 AS d, i // 16 % 2 AS e FROM range(32) r(i))), 7) AS bo5
FROM (SELECT match_id, p * 0.98765 + 0.00617 AS p, p2 * 0.97531 + 0.01357 AS p2 FROM sc)""",
    WINDOWS,
    FEATURES,
    SCORED,
)


def reach_leverage(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("ps", F.array("p", "p2", F.lit(0.5)))
    return rows.select("match_id", F.round(series.reach_probability(F.col("ps"), 2), 9).alias("reach3"), F.round(series.leverage(F.col("ps"), 0), 9).alias("leverage1"))


def linear_groups(spark, sf_dir):
    """Linear attribution by group of features, largest first, and its sum."""
    rows = features(spark, sf_dir)
    parts = {"rates": F.col("win_rate_diff") * 2 + F.col("format_win_rate_diff"), "activity": F.coalesce(F.col("days_since_last_diff"), F.lit(0.0)) * -0.01, "experience": F.col("n_before_diff") * 0.001}
    each = rows.select("match_id", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.round(v, 6).alias("value")) for k, v in parts.items()])).alias("g")).select("match_id", "g.*")
    from pyspark.sql import Window

    return each.withColumn("rank", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc(F.abs("value")), "name"))).withColumn("value", F.col("value") + 0.0)


LINEAR = sql(
    """
SELECT match_id, name, value + 0.0 AS value, row_number() OVER (PARTITION BY match_id ORDER BY abs(value) DESC, name) AS rank FROM (
  SELECT match_id, unnest(['rates', 'activity', 'experience']) AS name, unnest([round(win_rate_diff * 2 + format_win_rate_diff, 6), round(coalesce(days_since_last_diff, 0) * -0.01, 6), round(n_before_diff * 0.001, 6)]) AS value FROM fe)""",
    WINDOWS,
    FEATURES,
)


#: SURVEY 2.27.
REPLICATES = 2000


def bootstrap_ci(spark, sf_dir):
    return rounded(metrics.bootstrap(scored(spark, sf_dir), "match_id", REPLICATES, other="p2"), "low", "high")


def split_symmetry(spark, sf_dir):
    rows = features(spark, sf_dir)
    return prep.symmetry_error(prep.augment(rows, SPEC), SPEC).select(*[F.round(c, 9).alias(c) for c in (*SPEC.directional, "win1")]).select(*[(F.col(c) + 0.0).alias(c) for c in (*SPEC.directional, "win1")])


F_ = (WINDOWS, FEATURES)
QUERIES = {
    "mirror_augment": (mirror_augment, MIRROR),
    "augmented_symmetry": (split_symmetry, "SELECT 0::DOUBLE AS win_rate_diff, 0::DOUBLE AS format_win_rate_diff, 0::DOUBLE AS days_since_last_diff, 0::DOUBLE AS n_before_diff, 0::DOUBLE AS win1"),
    "impute_zscore": (impute_zscore, ZSCORE),
    "one_hot_unknown": (one_hot_unknown, sql("SELECT match_id, CAST(map_name = 'ECONOMY' AS INTEGER) AS economy, CAST(map_name = 'STANDARD' AS INTEGER) AS standard, CAST(map_name NOT IN ('ECONOMY', 'PROMO', 'STANDARD') AS INTEGER) AS unknown FROM series")),
    "chrono_split": (chrono_split, sql(f"SELECT match_id, CASE WHEN t <= {cut('0.70')} THEN 'train' WHEN t <= {cut('0.85')} THEN 'validation' ELSE 'test' END AS split FROM fe", *F_)),
    "expanding_folds": (expanding_folds, FOLDS),
    "inner_early_stop": (inner_early_stop, sql(f"SELECT CASE WHEN t <= {cut('0.85')} THEN 'fit' ELSE 'stop' END AS \"inner\", count(*) AS n, max(t) AS last_t FROM fe GROUP BY 1", *F_)),
    "binary_metrics": (binary_metrics, BINARY),
    "auc_rank": (auc_rank, AUC),
    "slice_metrics": (slice_metrics, SLICES),
    "calibration_bins": (calibration_bins, sql("SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM sc GROUP BY 1", *F_, SCORED)),
    "series_macro": (series_macro, MACRO),
    "blend_weight_select": (blend_weight_select, sql("SELECT w, log_loss, brier FROM bl", *F_, SCORED, BLEND)),
    "epsilon_select": (epsilon_select, sql("SELECT w, log_loss FROM bl WHERE log_loss <= (SELECT min(log_loss) FROM bl) + 0.002 ORDER BY w LIMIT 1", *F_, SCORED, BLEND)),
    "elo_baseline_prob": (elo_baseline_prob, sql("SELECT match_id, round(1 / (1 + power(10, -win_rate_diff)), 6) AS p FROM fe", *F_)),
    "set_jaccard": (set_jaccard, JACCARD),
    "topk_sets": (topk_sets, sql("SELECT team1 AS team, CAST(sum(win1) AS BIGINT) AS wins, count(*) AS n FROM series GROUP BY 1 ORDER BY wins DESC, n, team LIMIT 16")),
    "series_dp_bo3_bo5": (series_dp, DP),
    "reach_leverage": (reach_leverage, sql("SELECT match_id, round(p * (1 - p2) + (1 - p) * p2, 9) AS reach3, round((p2 + (1 - p2) * 0.5) - (p2 * 0.5), 9) AS leverage1 FROM sc", *F_, SCORED)),
    "attribution_linear_groups": (linear_groups, LINEAR),
    "bootstrap_ci": (bootstrap_ci, None),
}
