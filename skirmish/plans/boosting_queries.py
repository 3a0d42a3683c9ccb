"""Queries of boosted trees, their tuning and their explanations. SQL cannot fit trees: tests compare with plain replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, explain, metrics, prep, reports, tuning
from ..operators.boosting import FIT, NONE, STOP, Params
from ..scratch import kept
from .history_queries import rounded
from .model_queries import features

GROUPS = {"results": ["win_rate_diff", "format_win_rate_diff"], "activity": ["days_since_last_diff"], "experience": ["n_before_diff", "n_before_min"]}
LABELS = {"results": "past results", "activity": "time since the last match", "experience": "experience"}
COLUMNS = [c for columns in GROUPS.values() for c in columns]
PARAMS = Params(depth=3, rate=0.15, rounds=24, patience=6)


def split_rows(spark, sf_dir):
    """Matches with their chronological split; the latest of the training rows stop the fit."""
    rows = kept(prep.chronological_split(features(spark, sf_dir)))
    inner = prep.early_stop_split(rows.where("split = 'train'")).select("match_id", "inner")
    return rows.join(inner, "match_id", "left").withColumn("role", F.when(F.col("inner") == "fit", FIT).when(F.col("inner") == "stop", STOP).otherwise(NONE))


def fitted(rows):
    return boosting.fit(reports.keep_missing(rows, COLUMNS), COLUMNS, "win1", PARAMS, F.col("role"))


def boosted_missing(spark, sf_dir):
    """Metrics by split; missing values (teams without a past) go the way that the trees learned."""
    rows = kept(split_rows(spark, sf_dir))
    scored = rows.select("split", F.col("win1").alias("y"), fitted(rows).probability().alias("p"))
    return rounded(metrics.binary(scored, "split").select("split", "n", "log_loss", "brier", "accuracy"), "log_loss", "brier", "accuracy")


def tuning_table(spark, sf_dir):
    """Candidates over expanding folds, and which one is taken for the final fit."""
    rows = kept(tuning.expanding_roles(features(spark, sf_dir)))
    candidates = tuning.grid(4, rounds=12, patience=4)
    table, _ = tuning.search(rows, COLUMNS, "win1", candidates)
    table = kept(table)
    best, _ = tuning.chosen(table, candidates)
    return rounded(table.withColumn("chosen", F.col("candidate") == best), "mean_log_loss", "std_log_loss")


def feature_sets(spark, sf_dir):
    """All columns against results alone, by fold and over all folds."""
    rows = kept(tuning.expanding_roles(features(spark, sf_dir)))
    arms = [Params(rounds=12, patience=4), Params(rounds=12, patience=4, only=tuple(GROUPS["results"]))]
    _, oof = tuning.search(rows, COLUMNS, "win1", arms)
    return rounded(tuning.compared(oof, 0, 1), "log_loss_a", "log_loss_b", "delta", "a_nearer")


def explain_series(spark, sf_dir):
    """Groups of factors behind each prediction of a fitted model, in log-odds, with a sentence for each match."""
    rows = kept(split_rows(spark, sf_dir))
    _, groups = explain.explain(rows, fitted(rows), GROUPS)
    groups = kept(groups)
    return rounded(groups.join(explain.sentences(groups, LABELS), "match_id", "left"), "value")


QUERIES = {
    "boosted_missing": (boosted_missing, None),
    "tuning_table": (tuning_table, None),
    "feature_sets": (feature_sets, None),
    "explain_series": (explain_series, None),
}
