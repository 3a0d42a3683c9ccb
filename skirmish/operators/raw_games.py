"""Raw game tables, all text: series and map rows to typed tables, rejects with reasons, players as rows, audits.

A series row has is_total "True", its map rows "False"; blanks are empty strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import best_of, sign_winner, to_num
from . import quality

#: The columns of raw rows, those of each player slot apart.
COLUMNS = ["match_id", "game_id", "is_total", "tournament", "datetime", "bestOf", "team1", "team1_id", "team2", "team2_id", "score1_match", "score2_match", "score1_game", "score2_game", "map_id", "map_name", "team1_win", "games_played"]
STATS = ["kills", "deaths", "assists", "adr", "kast", "kddiff"]
SIDES, SLOTS = (1, 2), (1, 2, 3, 4, 5)
MIN_ROUNDS = 5


def slot(side: int, number: int, what: str = "") -> str:
    return f"team{side}_player{number}{'_' + what if what else ''}"


ALL_COLUMNS = COLUMNS + [slot(s, n, w) for s in SIDES for n in SLOTS for w in ("", "id", *STATS)]


def whole(c: str) -> Column:
    return to_num(F.col(c)).cast("long")


def moment(c: str) -> Column:
    return F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss"))


def _common(rows: DataFrame) -> dict[str, Column]:
    return {"match_id": whole("match_id"), "tournament": F.col("tournament"), "tier": F.col("tier"), "datetime": moment("datetime"), "bestOf": best_of(F.col("bestOf"))}


def _teams(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    return quality.canonical(quality.canonical(rows, aliases, "team1"), aliases, "team2")


def series_base(raw: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed series, rejected rows): no score, a tie or no best-of rejects a series."""
    rows = raw.where("is_total = 'True'").withColumns({"__a": to_num(F.col("score1_match")), "__b": to_num(F.col("score2_match"))})
    missing = F.col("__a").isNull() | F.col("__b").isNull()
    rules = {"missing_score": missing, "tie": ~missing & (F.col("__a") == F.col("__b")), "missing_bestOf": best_of(F.col("bestOf")).isNull()}
    good, bad = quality.quarantine(quality.reject_reasons(rows, rules))
    good = _teams(good, aliases)
    cols = _common(good) | {f"team{k}": F.col(f"team{k}") for k in SIDES} | {f"team{k}_canonical": F.col(f"team{k}_canonical") for k in SIDES} | {f"team{k}_id": whole(f"team{k}_id") for k in SIDES}
    cols |= {"score1_match": F.col("__a").cast("long"), "score2_match": F.col("__b").cast("long"), "team1_series_win": (F.col("__a") > F.col("__b")).cast("int")}
    return good.select(*[v.alias(k) for k, v in cols.items()]), bad.drop("__a", "__b")


def map_base(raw: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed maps, rejected rows): no map, no score or a tie rejects a map; its best-of never does.

    The ten players of a map are an array of structs (side, slot, player, name, stats).
    """
    rows = raw.where("is_total = 'False'").withColumns({"__a": to_num(F.col("score1_game")), "__b": to_num(F.col("score2_game"))})
    no_map = (F.col("map_id") == "") | (F.col("map_name") == "")
    no_score = F.col("__a").isNull() | F.col("__b").isNull()
    rules = {"blank_map_row": no_score & no_map, "missing_map_name": ~no_score & no_map, "tie": ~no_map & ~no_score & (F.col("__a") == F.col("__b")), "other": ~no_map & no_score}
    good, bad = quality.quarantine(quality.reject_reasons(rows, rules))
    good = _teams(good, aliases)
    players = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(n).alias("slot"), whole(slot(s, n, "id")).alias("player"), F.col(slot(s, n)).alias("name"), *[to_num(F.col(slot(s, n, w))).alias(w) for w in STATS]) for s in SIDES for n in SLOTS])
    cols = _common(good) | {"game_id": whole("game_id"), "map_id": whole("map_id"), "map_name": F.col("map_name")} | {f"team{k}": F.col(f"team{k}") for k in SIDES} | {f"team{k}_canonical": F.col(f"team{k}_canonical") for k in SIDES} | {f"team{k}_id": whole(f"team{k}_id") for k in SIDES}
    cols |= {"players": players, "score1_game": F.col("__a").cast("long"), "score2_game": F.col("__b").cast("long"), "team1_map_win": (F.col("__a") > F.col("__b")).cast("int")}
    return good.select(*[v.alias(k) for k, v in cols.items()]), bad.drop("__a", "__b")


def observations(maps: DataFrame) -> DataFrame:
    """One row for each player of a map, cleaned, with kd_balance, assists_per_round and whether the stats are usable.

    Slots without a player go. A player on both sides takes the whole map out; one in two slots of a side is kept once
    if the stats agree and not at all if they differ.
    """
    rows = maps.select("match_id", "game_id", "map_name", "datetime", "team1_canonical", "team2_canonical", (F.col("score1_game") + F.col("score2_game")).alias("rounds"), F.explode(F.filter("players", lambda p: p["player"].isNotNull())).alias("p")).select("*", "p.*").drop("p")
    rows = rows.withColumn("team", F.when(F.col("side") == 1, F.col("team1_canonical")).otherwise(F.col("team2_canonical"))).drop("team1_canonical", "team2_canonical")
    used = ["kills", "deaths", "assists", "adr", "kast"]
    rows = quality.collapse_slots(quality.drop_players_on_both_sides(rows, "game_id"), used, "game_id")
    present = F.lit(True)
    for c in used:
        present = present & F.col(c).isNotNull()
    return rows.withColumns(
        {
            "kd_balance": (F.col("kills") - F.col("deaths")) / F.greatest(F.col("kills") + F.col("deaths"), F.lit(1.0)),
            "assists_per_round": F.col("assists") / F.greatest(F.col("rounds"), F.lit(1)),
            "has_usable_stats": present & (F.col("rounds") >= MIN_ROUNDS),
        }
    )


def audit_tiers(tiered: DataFrame, everything: DataFrame) -> DataFrame:
    """Matches by set of tiers that hold them, and whether the file of all tiers has them: overlaps and gaps show."""
    own = tiered.groupBy("match_id").agg(F.sort_array(F.collect_set("tier")).alias("tiers"))
    both = own.join(everything.select("match_id").distinct().withColumn("__all", F.lit(True)), "match_id", "full")
    return both.groupBy(F.concat_ws("&", "tiers").alias("tiers"), F.col("__all").isNotNull().alias("in_all")).agg(F.count("*").alias("matches"))


def audit_totals(raw: DataFrame) -> DataFrame:
    """By tier and overall (null): series and map rows, and matches with no, one or several series rows."""
    each = raw.groupBy("tier", "match_id").agg(F.count_if(F.col("is_total") == "True").alias("totals"), F.count_if(F.col("is_total") == "False").alias("maps"), F.count_if((F.col("is_total") == "False") & (F.col("map_id") == "")).alias("blank"))
    return each.rollup("tier").agg(F.count("*").alias("matches"), F.sum("totals").alias("series_rows"), F.sum("maps").alias("map_rows"), F.sum("blank").alias("blank_map_rows"), F.count_if(F.col("totals") == 0).alias("without"), F.count_if(F.col("totals") == 1).alias("one"), F.count_if(F.col("totals") > 1).alias("several"))


def audit_game_ids(raw: DataFrame) -> DataFrame:
    """One row: blank and repeated ids of map rows; blank and negative ids of series rows, and those whose positive
    counterpart exists."""
    maps, series = raw.where("is_total = 'False'"), raw.where("is_total = 'True'")
    named = maps.where("game_id <> ''").groupBy("game_id").agg(F.count("*").alias("n"))
    a = named.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("map_duplicates"))
    b = raw.agg(F.count_if((F.col("is_total") == "False") & (F.col("game_id") == "")).alias("map_blank"), F.count_if((F.col("is_total") == "True") & (F.col("game_id") == "")).alias("series_blank"), F.count_if((F.col("is_total") == "True") & F.col("game_id").startswith("-")).alias("series_negative"))
    positive = raw.where("game_id <> '' and not startswith(game_id, '-')").select(F.col("game_id").alias("__g")).distinct()
    c = series.where("startswith(game_id, '-')").join(positive, F.ltrim("game_id", F.lit("-")) == F.col("__g"), "left_semi").agg(F.count("*").alias("negative_with_positive"))
    return a.join(b).join(c)


def audit_games_played(raw: DataFrame) -> DataFrame:
    """By best-of: series, those that say how many games were played, and those that say it wrongly."""
    actual = raw.where("is_total = 'False'").groupBy("match_id").agg(F.count("*").alias("maps"))
    rows = raw.where("is_total = 'True'").join(actual, "match_id", "left").withColumns({"said": to_num(F.col("games_played")), "bo": to_num(F.col("bestOf"))})
    return rows.groupBy("bo").agg(F.count("*").alias("series"), F.count("said").alias("checked"), F.count_if(F.col("said").isNotNull() & ~F.col("said").eqNullSafe(F.col("maps").cast("double"))).alias("mismatch"))


def audit_blanks(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Percent of blanks of columns, on series rows and on map rows."""
    return raw.groupBy("is_total").agg(*[F.round(F.avg(F.when(F.col(c) == "", 100.0).otherwise(0.0)), 1).alias(c) for c in columns])


def audit_win_flag(raw: DataFrame) -> DataFrame:
    """The recorded flag against the winner that the scores imply, on series rows."""
    rows = raw.where("is_total = 'True'")
    implied = sign_winner(to_num(F.col("score1_match")), to_num(F.col("score2_match")))
    return rows.groupBy(implied.alias("winner"), to_num(F.col("team1_win")).alias("flag")).agg(F.count("*").alias("n"))


def audit_lookup(raw: DataFrame, ids: list[str], lookup: DataFrame, key: str) -> DataFrame:
    """How many distinct ids of some columns a lookup table has, and how many it lacks."""
    seen = raw.select(F.explode(F.array(*[F.col(c) for c in ids])).alias("id")).where("id <> ''").distinct()
    known = lookup.select(F.col(key).cast("string").alias("id")).distinct().withColumn("known", F.lit(True))
    return seen.join(known, "id", "left").agg(F.count("*").alias("ids"), F.count("known").alias("known"), (F.count("*") - F.count("known")).alias("missing"))
