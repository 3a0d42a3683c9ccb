"""Reports on streams, predictions and attributions: subgroups, exclusions, folds, summaries, texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import medians

#: The eight named evidence subgroups of a table with these four columns.
EVIDENCE = {
    "A_recent_map_evidence": "both_recent = 1",
    "B_trusted_adjusted_evidence": "adjusted_mass_min > 0",
    "C_roster_map_evidence_ge3": "roster_players_min >= 3",
    "D_strong_roster_map_evidence_ge5": "roster_players_min >= 5",
    "E_roster_map_cold_start": "roster_players_min = 0",
    "F_team_map_cold_start": "both_recent = 0",
    "G_current_core_evidence": "core_continuity_min > 0",
    "H_high_evidence": "both_recent = 1 and adjusted_mass_min > 0 and roster_players_min >= 3",
}


def subgroups(rows: DataFrame, predicates: Mapping[str, str], y: str = "y", p: str = "p") -> DataFrame:
    """(subgroup, n, share, accuracy, brier) of named, overlapping subgroups, all in one pass; rows in none count in the share."""
    made = []
    for name, test in predicates.items():
        inside = F.expr(test)
        hit = F.when((F.col(p) >= 0.5) == (F.col(y) == 1), 1.0).otherwise(0.0)
        made.append(F.struct(F.lit(name).alias("subgroup"), F.count_if(inside).alias("n"), (F.count_if(inside) / F.count("*")).alias("share"), F.avg(F.when(inside, hit)).alias("accuracy"), F.avg(F.when(inside, F.pow(F.col(p) - F.col(y), 2))).alias("brier")))
    return rows.agg(F.array(*made).alias("all")).select(F.explode("all").alias("g")).select("g.*")


def exclusions(matches: DataFrame) -> DataFrame:
    """Matches that features leave out, with the reasons: sides that are not eligible, joined by semicolons."""
    why = [F.when(~F.coalesce(F.col(f"elig{k}"), F.lit(False)), F.concat(F.lit(f"team{k}_not_identity_eligible:"), F.col(f"team{k}").cast("string"))) for k in (1, 2)]
    return matches.withColumn("reason", F.concat_ws(";", *why)).where("reason <> ''")


def flat_summary(sides: DataFrame) -> DataFrame:
    """One row of scalars for each team: what a snapshot says about it."""
    form = [F.count_if(F.col("best_of") == k).alias(f"format_bo{k}_n") for k in (1, 3, 5)]
    return sides.groupBy("team").agg(F.count("*").alias("n"), F.sum("win").cast("long").alias("wins"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), *form)


def impute(rows: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Medians of the training rows for nulls, nothing scaled: what forests take."""
    med = medians(train, columns)
    return rows.withColumns({c: F.coalesce(c, F.lit(med[c]).cast("double")) for c in columns})


def keep_missing(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers as doubles, NaN and null both as null: boosted trees send missing values their own way."""
    return rows.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns})


def inherit(rows: DataFrame, split: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of maps with the split (or fold) of their series; maps of unknown series are an error."""
    joined = rows.join(split.select(key, *columns), key, "left")
    return joined.withColumns({c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit("no split for "), F.col(key).cast("string")))).otherwise(F.col(c)) for c in columns})


def candidate_scores(scored: DataFrame, *candidate: str, y: str = "y", p: str = "p") -> DataFrame:
    """(candidate, folds, mean, deviation of the population) of the log-loss over folds, from rows (candidate, fold, y, p)."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    each = scored.groupBy(*candidate, "fold").agg(F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("ll"))
    return each.groupBy(*candidate).agg(F.count("*").alias("folds"), F.avg("ll").alias("mean_log_loss"), F.stddev_pop("ll").alias("std_log_loss"))


def tree_count(best: DataFrame, column: str) -> DataFrame:
    """How many trees the final fit gets: the median over folds of the best iteration plus one, halves to even."""
    return best.agg(F.bround(F.median(F.col(column) + 1), 0).cast("long").alias("trees"))


def out_of_fold(folds: DataFrame, group: str, y: str = "y") -> DataFrame:
    """Each validation row of expanding folds with the smoothed rate of its group among the fold's training rows: (match_id,
    fold, y, p). A row is validated in one fold only, so the union of the folds is an out-of-fold table."""
    fit = folds.where("part = 'train'").groupBy("fold", group).agg(((F.sum(y) + 2) / (F.count("*") + 4)).alias("p"))
    return folds.where("part = 'validation'").join(fit, ["fold", group], "left").select("match_id", "fold", y, F.coalesce("p", F.lit(0.5)).alias("p"))


def top_groups(groups: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The n largest positive and the n largest negative contributions of each key (ties: by name), with sign and rank."""
    sign = F.when(F.col("value") > 0, "positive").when(F.col("value") < 0, "negative")
    rank = F.row_number().over(Window.partitionBy(key, "sign").orderBy(F.desc(F.abs("value")), "name"))
    return groups.withColumn("sign", sign).where("sign is not null").withColumn("place", rank).where(F.col("place") <= n)


def sentences(top: DataFrame, key: str) -> DataFrame:
    """A sentence for each key: what speaks most for and against the first side."""
    named = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("sign") == s, F.struct("place", "name")))), lambda x: x["name"]), ", ")
    made = top.groupBy(key).agg(named("positive").alias("a"), named("negative").alias("b"))
    text = F.concat(F.lit("For: "), F.when(F.col("a") == "", "nothing").otherwise(F.col("a")), F.lit(". Against: "), F.when(F.col("b") == "", "nothing").otherwise(F.col("b")), F.lit("."))
    return made.select(key, text.alias("sentence"))


def canonical_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, json, sha256) of each row: keys in alphabetical order, no blanks, nulls written, so equal rows hash alike."""
    names = sorted(rows.columns)
    made = rows.select(key, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("json"))
    return made.withColumn("sha256", F.sha2(F.encode("json", "UTF-8"), 256))


def sequential(eras: DataFrame, key: str) -> DataFrame:
    """(key, n_eras, sequential): whether each era of a key ends before the next one begins. ``eras``: key, first_t, last_t."""
    after = F.lead("first_t").over(Window.partitionBy(key).orderBy("first_t", "last_t"))
    marked = eras.withColumn("clash", F.coalesce(F.col("last_t") >= after, F.lit(False)))
    return marked.groupBy(key).agg(F.count("*").alias("n_eras"), (F.count_if("clash") == 0).alias("sequential"))


def stage_of(moment: Column, stages: Mapping[str, tuple[str, str]]) -> Column:
    """The stage whose days, both included, hold a moment; null outside all."""
    out = F.lit(None).cast("string")
    for name, (first, last) in reversed(list(stages.items())):
        out = F.when((moment >= F.to_timestamp(F.lit(first))) & (moment < F.date_add(F.to_date(F.lit(last)), 1)), name).otherwise(out)
    return out


def known_join(rows: DataFrame, lookup: DataFrame, keys: list[str], column: str, fallback: float) -> DataFrame:
    """A left join on unique keys with a fallback for what is not there, and a column that says so."""
    twice = lookup.groupBy(*keys).agg(F.count("*").alias("n"), F.first(column).alias(column))
    checked = twice.select(*keys, F.when(F.col("n") > 1, F.raise_error(F.lit("keys are not unique"))).otherwise(F.col(column)).alias(column), F.lit(1).alias("known"))
    return rows.join(checked, keys, "left").withColumns({column: F.coalesce(column, F.lit(fallback)), "known": F.coalesce("known", F.lit(0))})


def participants_problems(entrants: DataFrame, counts: Mapping[int, int]) -> DataFrame:
    """(stage, problem): stages with a wrong number of teams or none, seeds that are not 1 to n once each, and teams entered twice
    (stage null). No rows: the entrants are valid."""
    by = entrants.groupBy("stage").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("seed0")).alias("seeds"))  # some tens of teams
    want = entrants.sparkSession.createDataFrame(list(counts.items()), "stage int, want int")
    wrong = by.join(want, "stage", "full").select("stage", F.when(~F.col("n").eqNullSafe(F.col("want")), "wrong number of teams").alias("problem"))
    seeds = by.select("stage", F.when(F.col("seeds") != F.sequence(F.lit(1), F.col("n").cast("int")), "seeds are not 1 to n").alias("problem"))
    twice = entrants.groupBy("team").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(None).cast("int").alias("stage"), F.lit("team entered twice").alias("problem")).distinct()
    return wrong.unionByName(seeds).where("problem is not null").unionByName(twice)


def conservation(places: DataFrame, totals: Mapping[str, float]) -> DataFrame:
    """(counter, total, expected, holds): sums of columns of probabilities over all teams against what they have to be."""
    made = F.array(*[F.struct(F.lit(c).alias("counter"), F.sum(c).cast("double").alias("total"), F.lit(float(v)).alias("expected")) for c, v in totals.items()])
    return places.agg(made.alias("all")).select(F.explode("all").alias("g")).select("g.*").withColumn("holds", F.abs(F.col("total") - F.col("expected")) < 1e-6)
