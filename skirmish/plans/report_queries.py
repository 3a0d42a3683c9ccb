"""Queries of reports: subgroups, exclusions, summaries, folds, attribution texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep, quality, reports
from ..operators.streams import sides
from .adapter import kept_sides, matches, sql
from .history_queries import WINDOWS, rounded
from .model_queries import FEATURES, SCORED, SPEC, WEIGHTS, cut, features, linear_groups, scored

F_ = (WINDOWS, FEATURES)
BLOCKS = f"bk AS (SELECT *, 1 + CAST(t > {cut('0.2')} AS INTEGER) + CAST(t > {cut('0.4')} AS INTEGER) + CAST(t > {cut('0.6')} AS INTEGER) + CAST(t > {cut('0.8')} AS INTEGER) AS block FROM fe)"
LINEAR = """lg AS (SELECT match_id, unnest(['rates', 'activity', 'experience']) AS name,
  unnest([round(win_rate_diff * 2 + format_win_rate_diff, 6), round(coalesce(days_since_last_diff, 0) * -0.01, 6), round(n_before_diff * 0.001, 6)]) AS value FROM fe)"""


def evidence(spark, sf_dir):
    """The eight subgroups over evidence that the matches' features give."""
    rows = features(spark, sf_dir)
    p = F.round(1 / (1 + F.exp(F.col("win_rate_diff") * -6)), 4)
    made = rows.select(
        F.col("win1").alias("y"),
        p.alias("p"),
        (F.col("n_before_min") >= 3).cast("int").alias("both_recent"),
        (F.col("n_before_min") - F.abs("n_before_diff")).alias("adjusted_mass_min"),
        F.least("n_before_min", F.lit(6)).alias("roster_players_min"),
        (F.col("n_before_min") % 4).alias("core_continuity_min"),
    )
    return rounded(reports.subgroups(made, reports.EVIDENCE), "share", "accuracy", "brier")


EVIDENCE = sql(
    "SELECT subgroup, count(*) FILTER (hit) AS n, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS share, round(avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)) FILTER (hit), 6) AS accuracy, round(avg((p - y) ** 2) FILTER (hit), 6) AS brier FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS subgroup, {v.replace(' and ', ' AND ')} AS hit, y, p FROM ev" for k, v in reports.EVIDENCE.items())
    + ") GROUP BY 1",
    *F_,
    "ev AS (SELECT win1 AS y, round(1 / (1 + exp(win_rate_diff * -6)), 4) AS p, CAST(n_before_min >= 3 AS INTEGER) AS both_recent, n_before_min - abs(n_before_diff) AS adjusted_mass_min, least(n_before_min, 6) AS roster_players_min, n_before_min % 4 AS core_continuity_min FROM fe)",
)


def exclusion_reasons(spark, sf_dir):
    return reports.exclusions(matches(spark, sf_dir)).select("match_id", "reason")


def eligible_always(spark, sf_dir):
    return kept_sides(spark, sf_dir).groupBy("team").agg(F.bool_and("elig").alias("elig"), F.bool_and("trusted").alias("trusted"))


def flat_summary(spark, sf_dir):
    return reports.flat_summary(kept_sides(spark, sf_dir))


def std_corr(spark, sf_dir):
    rows = scored(spark, sf_dir).groupBy("map_name").agg(F.stddev_pop("p").alias("std"), F.corr("p", "p2").alias("corr"), F.covar_pop("p", "y").alias("cov"))
    return rounded(rows, "std", "corr", "cov")


def group_minimum(spark, sf_dir):
    """Rows of groups with more than one member and the smallest score of their group."""
    from pyspark.sql import Window

    w = Window.partitionBy("team1", "best_of")
    rows = matches(spark, sf_dir).withColumns({"low": F.min("score1").over(w), "size": F.count("*").over(w)})
    return rows.where("size > 1").select("match_id", "low", "size")


def conditional_percent(spark, sf_dir):
    one = F.col("best_of") == 1
    rows = matches(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.count_if(one).alias("n_bo1"), (F.count_if(one & (F.col("win1") == 1)) * 100 / F.nullif(F.count_if(one), F.lit(0))).alias("pct_won"))
    return rounded(rows, "pct_won")


def set_operations(spark, sf_dir):
    """Teams by the sides they played on: intersection, difference and multiset difference."""
    rows = matches(spark, sf_dir)
    a, b = rows.select(F.col("team1").alias("team")), rows.select(F.col("team2").alias("team"))
    made = [a.intersect(b).withColumn("kind", F.lit("both")), a.where("team % 2 = 0").subtract(b.where("team % 3 = 0")).withColumn("kind", F.lit("less")), a.exceptAll(b).withColumn("kind", F.lit("more often"))]
    return made[0].unionByName(made[1]).unionByName(made[2]).groupBy("kind").agg(F.count("*").alias("n"), F.sum("team").alias("total"))


def impute_only(spark, sf_dir):
    rows = features(spark, sf_dir)
    train = prep.chronological_split(rows).where("split = 'train'")
    return rounded(reports.impute(rows, train, ["days_since_last_diff"]).select("match_id", "days_since_last_diff"), "days_since_last_diff")


def missing_kept(spark, sf_dir):
    rows = features(spark, sf_dir).withColumn("x", F.when(F.col("match_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("days_since_last_diff")))
    return rounded(reports.keep_missing(rows, ["x", "n_before_diff"]).select("match_id", "x", "n_before_diff"), "x")


def map_split_inherits(spark, sf_dir):
    """Two maps a series, each with the split and the block of its series."""
    rows = features(spark, sf_dir)
    maps = rows.select("match_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("game"))
    split = prep.blocks(prep.chronological_split(rows)).select("match_id", "split", "block")
    return reports.inherit(maps, split, "match_id", "split", "block").select("match_id", "game", "split", "block")


def candidate_folds(spark, sf_dir):
    """Blend weights as candidates, scored on the validation part of each fold."""
    rows = prep.expanding_folds(prep.blocks(features(spark, sf_dir).select("match_id", "t"))).where("part = 'validation'").select("match_id", "fold")
    each = rows.join(scored(spark, sf_dir), "match_id").withColumn("w", F.explode(F.array(*[F.lit(w) for w in WEIGHTS])))
    each = each.withColumn("q", F.col("w") * F.col("p") + (1 - F.col("w")) * F.col("p2"))
    return rounded(reports.candidate_scores(each, "w", p="q"), "mean_log_loss", "std_log_loss")


CANDIDATES = sql(
    """
SELECT w, count(*) AS folds, round(avg(ll), 6) AS mean_log_loss, round(stddev_pop(ll), 6) AS std_log_loss FROM (
  SELECT w, block - 1 AS fold, avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END) AS ll FROM (SELECT w, block, y, w * p + (1 - w) * p2 AS q FROM bk JOIN sc USING (match_id), (SELECT unnest([0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0]::DOUBLE[]) AS w) WHERE block > 1) GROUP BY 1, 2) GROUP BY 1""",
    *F_,
    SCORED,
    BLOCKS,
)


def final_tree_count(spark, sf_dir):
    """Fold sizes in place of best iterations: 4 folds, so the median may end in a half."""
    folds = prep.expanding_folds(prep.blocks(features(spark, sf_dir))).where("part = 'validation'").groupBy("fold").agg(F.count("*").alias("best"))
    return reports.tree_count(folds, "best")


def out_of_fold(spark, sf_dir):
    folds = prep.expanding_folds(prep.blocks(features(spark, sf_dir).select("match_id", "t", "map_name", F.col("win1").alias("y"))))
    return rounded(reports.out_of_fold(folds, "map_name"), "p")


OOF = sql(
    """
SELECT v.match_id, v.block - 1 AS fold, v.win1 AS y, round(coalesce((SELECT (sum(win1) + 2) / (count(*) + 4)::DOUBLE FROM bk u WHERE u.block < v.block AND u.map_name = v.map_name HAVING count(*) > 0), 0.5), 6) AS p
FROM bk v WHERE v.block > 1""",
    *F_,
    BLOCKS,
)


def top_groups(spark, sf_dir):
    return reports.top_groups(linear_groups(spark, sf_dir).drop("rank"), "match_id", 2).select("match_id", "name", "value", "sign", "place")


TOP = "tg AS (SELECT * FROM (SELECT match_id, name, value + 0.0 AS value, CASE WHEN value > 0 THEN 'positive' ELSE 'negative' END AS sign, row_number() OVER (PARTITION BY match_id, value > 0 ORDER BY abs(value) DESC, name) AS place FROM lg WHERE value <> 0) WHERE place <= 2)"


def explanation_sentences(spark, sf_dir):
    return reports.sentences(top_groups(spark, sf_dir), "match_id")


SENTENCES = sql(
    """
SELECT match_id, 'For: ' || coalesce(string_agg(name, ', ' ORDER BY place) FILTER (sign = 'positive'), 'nothing') || '. Against: ' || coalesce(string_agg(name, ', ' ORDER BY place) FILTER (sign = 'negative'), 'nothing') || '.' AS sentence FROM tg GROUP BY 1""",
    *F_,
    LINEAR,
    TOP,
)


def canonical_trace(spark, sf_dir):
    rows = matches(spark, sf_dir).select("match_id", "team1", "team2", "win1", "map_name")
    return reports.canonical_json(rows, "match_id")


TRACE = sql("""
SELECT match_id, json, sha256(json) AS sha256 FROM (SELECT match_id, '{"map_name":"' || map_name || '","match_id":' || match_id || ',"team1":' || team1 || ',"team2":' || team2 || ',"win1":' || win1 || '}' AS json FROM series)""")


def roster_eras_sequential(spark, sf_dir):
    """Whether the maps of a team follow each other without overlap, as eras do that hand over."""
    eras = kept_sides(spark, sf_dir).groupBy("team", "map_name").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return reports.sequential(eras, "team")


SEQUENTIAL = sql("""
SELECT team, count(*) AS n_eras, NOT bool_or(coalesce(last_t >= next_t, false)) AS sequential FROM (
  SELECT *, lead(first_t) OVER (PARTITION BY team ORDER BY first_t, last_t) AS next_t FROM (SELECT team, map_name, min(t) AS first_t, max(t) AS last_t FROM sides GROUP BY ALL)) GROUP BY 1""")


def stage_windows(spark, sf_dir):
    stages = {"stage_1": ("1995-01-01", "1995-06-30"), "stage_2": ("1995-07-01", "1995-12-31"), "playoffs": ("1996-01-01", "1996-03-31")}
    rows = matches(spark, sf_dir).withColumn("stage", reports.stage_of(F.col("dt").cast("timestamp"), stages))
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.min("dt").alias("first_dt"))


def known_ratings(spark, sf_dir):
    """Rates of teams that played a hundred matches, or 0.5 and no mark for the others."""
    rows = matches(spark, sf_dir)
    rates = sides(rows).groupBy("team").agg(F.count("*").alias("n"), F.avg("win").alias("rate")).where("n >= 100").select(F.col("team").alias("team1"), "rate")
    return rounded(reports.known_join(rows.select("match_id", "team1"), rates, ["team1"], "rate", 0.5), "rate")


def integrity(spark, sf_dir):
    """How many rows break each rule of the target and the keys."""
    rows = matches(spark, sf_dir)
    broken = quality.expect(rows, target=F.col("win1") == (F.col("score1") > F.col("score2")).cast("int"), binary=F.col("win1").isin(0, 1), sides=F.col("team1") != F.col("team2"), best_of=F.col("best_of").isin(1, 3, 5))
    twice = rows.groupBy("match_id").agg(F.count("*").alias("n")).where("n > 1").count()
    return spark.createDataFrame([(k, int(v)) for k, v in {**broken, "unique": twice}.items()], "rule string, broken long")


INTEGRITY = sql("""
SELECT unnest(['target', 'binary', 'sides', 'best_of', 'unique']) AS rule, unnest([count(*) FILTER (win1 <> CAST(score1 > score2 AS INTEGER)), count(*) FILTER (win1 NOT IN (0, 1)), count(*) FILTER (team1 = team2), count(*) FILTER (best_of NOT IN (1, 3, 5)), (SELECT count(*) FROM (SELECT match_id FROM series GROUP BY 1 HAVING count(*) > 1))]) AS broken FROM series""")


def mirror_means(spark, sf_dir):
    """Means of both halves of a mirrored table: each directional one is the other's negative."""
    both = prep.augment(features(spark, sf_dir), SPEC)
    cols = ["win_rate_diff", "n_before_diff", "n_before_min", "win1"]
    return rounded(both.groupBy("mirrored").agg(*[F.avg(c).alias(c) for c in cols]), *cols).withColumns({c: F.col(c) + 0.0 for c in cols})


MIRROR_MEANS = sql(
    """
SELECT 0 AS mirrored, round(avg(win_rate_diff), 6) + 0.0 AS win_rate_diff, round(avg(n_before_diff), 6) + 0.0 AS n_before_diff, round(avg(n_before_min), 6) AS n_before_min, round(avg(win1), 6) AS win1 FROM fe
UNION ALL SELECT 1, round(avg(-win_rate_diff), 6) + 0.0, round(avg(-n_before_diff), 6) + 0.0, round(avg(n_before_min), 6), round(avg(1 - win1), 6) FROM fe""",
    *F_,
)

QUERIES = {
    "evidence_subgroups": (evidence, EVIDENCE),
    "exclusion_reasons": (exclusion_reasons, sql("SELECT match_id, concat_ws(';', CASE WHEN NOT elig1 THEN 'team1_not_identity_eligible:' || team1 END, CASE WHEN NOT elig2 THEN 'team2_not_identity_eligible:' || team2 END) AS reason FROM series WHERE NOT (elig1 AND elig2)")),
    "eligible_always": (eligible_always, sql("SELECT team, bool_and(elig) AS elig, bool_and(trusted) AS trusted FROM sides GROUP BY 1")),
    "flat_summary": (flat_summary, sql("SELECT team, count(*) AS n, CAST(sum(win) AS BIGINT) AS wins, min(dt) AS first_dt, max(dt) AS last_dt, count(*) FILTER (best_of = 1) AS format_bo1_n, count(*) FILTER (best_of = 3) AS format_bo3_n, count(*) FILTER (best_of = 5) AS format_bo5_n FROM sides GROUP BY 1")),
    "std_pop_corr": (std_corr, sql("SELECT map_name, round(stddev_pop(p), 6) AS std, round(corr(p, p2), 6) AS corr, round(covar_pop(p, y), 6) AS cov FROM sc GROUP BY 1", *F_, SCORED)),
    "group_minimum": (group_minimum, sql("SELECT match_id, low, size FROM (SELECT match_id, min(score1) OVER w AS low, count(*) OVER w AS size FROM series WINDOW w AS (PARTITION BY team1, best_of)) WHERE size > 1")),
    "conditional_percent": (conditional_percent, sql("SELECT tier, count(*) AS n, count(*) FILTER (best_of = 1) AS n_bo1, round(count(*) FILTER (best_of = 1 AND win1 = 1) * 100 / nullif(count(*) FILTER (best_of = 1), 0)::DOUBLE, 6) AS pct_won FROM series GROUP BY 1")),
    "set_operations": (set_operations, sql("SELECT kind, count(*) AS n, CAST(sum(team) AS BIGINT) AS total FROM (SELECT 'both' AS kind, * FROM (SELECT team1 AS team FROM series INTERSECT SELECT team2 FROM series) UNION ALL SELECT 'less', * FROM (SELECT team1 FROM series WHERE team1 % 2 = 0 EXCEPT SELECT team2 FROM series WHERE team2 % 3 = 0) UNION ALL SELECT 'more often', * FROM (SELECT team1 FROM series EXCEPT ALL SELECT team2 FROM series)) GROUP BY 1")),
    "impute_only": (impute_only, sql(f"SELECT match_id, round(coalesce(days_since_last_diff, (SELECT median(days_since_last_diff) FROM fe WHERE t <= {cut('0.70')})), 6) AS days_since_last_diff FROM fe", *F_)),
    "missing_kept": (missing_kept, sql("SELECT match_id, CASE WHEN match_id % 5 <> 0 THEN round(days_since_last_diff, 6) END AS x, CAST(n_before_diff AS DOUBLE) AS n_before_diff FROM fe", *F_)),
    "map_split_inherits": (map_split_inherits, sql(f"SELECT match_id, game, CASE WHEN t <= {cut('0.70')} THEN 'train' WHEN t <= {cut('0.85')} THEN 'validation' ELSE 'test' END AS split, block FROM bk, (SELECT unnest([1, 2]) AS game)", *F_, BLOCKS)),
    "candidate_folds": (candidate_folds, CANDIDATES),
    "final_tree_count": (final_tree_count, sql("SELECT CAST(round_even(median(n + 1), 0) AS BIGINT) AS trees FROM (SELECT block, count(*) AS n FROM bk WHERE block > 1 GROUP BY 1)", *F_, BLOCKS)),
    "out_of_fold": (out_of_fold, OOF),
    "top_factor_groups": (top_groups, sql("SELECT match_id, name, value, sign, place FROM tg", *F_, LINEAR, TOP)),
    "explanation_sentences": (explanation_sentences, SENTENCES),
    "canonical_trace": (canonical_trace, TRACE),
    "eras_sequential": (roster_eras_sequential, SEQUENTIAL),
    "stage_windows": (stage_windows, sql("SELECT CASE WHEN dt >= '1995-01-01' AND dt < '1995-07-01' THEN 'stage_1' WHEN dt >= '1995-07-01' AND dt < '1996-01-01' THEN 'stage_2' WHEN dt >= '1996-01-01' AND dt < '1996-04-01' THEN 'playoffs' END AS stage, count(*) AS n, min(dt) AS first_dt FROM series GROUP BY 1")),
    "known_ratings": (known_ratings, sql("SELECT match_id, team1, round(coalesce(rate, 0.5), 6) AS rate, CAST(rate IS NOT NULL AS INTEGER) AS known FROM series LEFT JOIN (SELECT team, avg(win) AS rate FROM sides GROUP BY 1 HAVING count(*) >= 100) r ON r.team = team1")),
    "target_integrity": (integrity, INTEGRITY),
    "mirror_means": (mirror_means, MIRROR_MEANS),
}
