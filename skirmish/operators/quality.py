"""Cleaning, quarantine, identity and audits of raw results."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY, identity_key, sign_winner
from ..scratch import kept
from . import prefix


def reject_reasons(raw: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """reject_reason: the names of all rules that a row breaks, in order, joined by semicolons; empty for good rows."""
    return raw.withColumn("reject_reason", F.concat_ws(";", *[F.when(cond, name) for name, cond in rules.items()]))


def series_rules() -> dict[str, Column]:
    missing = F.col("score1").isNull() | F.col("score2").isNull()
    return {"missing_score": missing, "tie": ~missing & (F.col("score1") == F.col("score2")), "missing_bestOf": F.col("best_of").isNull(), "same_team": F.col("team1") == F.col("team2")}


def quarantine(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows) of reject_reasons()."""
    return judged.where("reject_reason = ''").drop("reject_reason"), judged.where("reject_reason <> ''")


def canonical(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Adds <column>_canonical by an alias table (alias, canonical), falling back to the name itself.

    Spark broadcasts the alias table if it is small enough; a large one is joined by shuffle.
    """
    names = aliases.select(F.col("alias").alias("__alias"), F.col("canonical").alias("__canonical"))
    out = rows.join(names, F.col(column) == F.col("__alias"), "left")
    return out.withColumn(f"{column}_canonical", F.coalesce("__canonical", column)).drop("__alias", "__canonical")


def canonical_eligibility(policy: DataFrame) -> DataFrame:
    """A canonical identity is eligible if all of its aliases are."""
    return policy.groupBy("canonical").agg(F.bool_and("eligible").alias("eligible"))


def evaluation_groups(rows: DataFrame, is_event: Column, time: str = "dt") -> DataFrame:
    """development, event or after_event: rows after the last row of the event come after it."""
    end = rows.where(is_event).agg(F.max(time).alias("__end"))
    group = F.when(is_event, "event").when(F.col(time) > F.col("__end"), "after_event").otherwise("development")
    return rows.join(end).withColumn("evaluation_group", group).drop("__end")


def drop_players_on_both_sides(players: DataFrame, game: str = "match_id") -> DataFrame:
    """Games in which a player stands on both sides go as wholes."""
    bad = players.groupBy(game, "player").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a <> b").select(game).distinct()
    return players.join(bad, game, "left_anti")


def collapse_slots(players: DataFrame, stats: list[str], game: str = "match_id") -> DataFrame:
    """A player listed twice on a side: with equal stats the lowest slot stays, with different ones the player goes."""
    w = Window.partitionBy(game, "side", "player")
    kinds = F.size(F.collect_set(F.to_json(F.struct(*stats))).over(w))
    rn = F.row_number().over(w.orderBy("slot"))
    return players.withColumns({"__kinds": kinds, "__rn": rn}).where("__kinds = 1 and __rn = 1").drop("__kinds", "__rn")


def distribution(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and percent of the whole."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("__total"))
    return counts.join(total).select(*by, "n", F.round(F.col("n") * 100 / F.col("__total"), 6).alias("pct"))


def side_bias(rows: DataFrame, *by: str) -> DataFrame:
    """How often team 1 wins, by slice."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("win1"), 6).alias("rate"))


def win_flag_check(rows: DataFrame) -> DataFrame:
    """How the winner that scores imply agrees with the recorded one."""
    implied = sign_winner(F.col("score1"), F.col("score2"))
    recorded = F.when(F.col("win1") == 1, "team1").otherwise("team2")
    return rows.groupBy(implied.alias("implied"), recorded.alias("recorded")).agg(F.count("*").alias("n"))


def overlaps(rosters: DataFrame, name: str, ident: str, *within: str) -> DataFrame:
    """(name, a, b, shared) for identities under one name (and equal ``within``) that share players; others never meet."""
    keys = [name, *within]
    pairs = rosters.where(F.col("player").isNotNull()).select(*keys, "player", ident).distinct()
    left, right = pairs.withColumnRenamed(ident, "a"), pairs.withColumnRenamed(ident, "b")
    return left.join(right, [*keys, "player"]).where("a < b").groupBy(*keys, "a", "b").agg(F.count("*").alias("shared"))


def spelling_groups(names: DataFrame, name: str, count: str) -> DataFrame:
    """Spellings with one identity key; the most frequent, then the first by name, is canonical. That they are one
    identity is not shown by this: resolve_names() asks for shared players."""
    w = Window.partitionBy("key").orderBy(F.desc(count), name)
    return names.withColumn("key", identity_key(F.col(name))).withColumn("canonical", F.first(name).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


#: Names that stand for no team, and how near in days two rosters are close.
GENERIC = r"(?i)^(mix\d*|tbd|team \d+[a-z]*|unknown|amateur team|qualifier)$"
CLOSE_DAYS = 60
#: Identities that come next in time or in an event and that each is held against before all pairs are.
WITNESSES = 8
#: Identities in a block, of which a task holds two at most.
BLOCK = 1024


def strangers_in(known: DataFrame, name: str, ident: str, keys: list[str], days: int | None) -> DataFrame:
    """(name) of identities (name, ident, t, players) of which two with equal ``keys`` share no player and, if ``days`` is given, lie so near.

    All pairs of a key are asked, as such sets force: in blocks inside tasks, by products of incidence matrices. No pair becomes a row, a
    key with many identities is many tasks' work, and none holds more than two blocks.
    """
    sizes = known.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys, F.ceil(F.col("__n") / BLOCK).cast("int").alias("__blocks"))
    dealt = known.join(sizes, keys).withColumn("__mine", F.pmod(F.xxhash64(ident), F.col("__blocks")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    groups = dealt.groupBy(*keys, F.least("__mine", "__other").alias("__u"), F.greatest("__mine", "__other").alias("__v"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(ident)
        t, lists = np.array(table.column("t")).astype(np.int64), table.column("players").combine_chunks()
        row = np.repeat(np.arange(len(t)), np.array(lists.value_lengths()).astype(np.int64))
        players, at = np.unique(np.array(lists.flatten()), return_inverse=True)
        shared = np.zeros((len(t), len(t)), bool)
        for low in range(0, len(players), 4096):
            here = (at >= low) & (at < low + 4096)
            has = np.zeros((len(t), min(4096, len(players) - low)), np.float32)
            has[row[here], at[here] - low] = 1
            shared |= has @ has.T > 0
        strange = np.triu(~shared, 1)
        if days is not None:
            strange &= np.abs((t[:, None] - t[None, :]) // DAY) <= days
        return table.select([name]).slice(0, 1 if strange.any() else 0)

    return groups.applyInArrow(run, known.select(name).schema)


def _days_between(first: Column, second: Column) -> Column:
    """Whole days from ``second`` to ``first``, rounded down as the reference does, without their sign."""
    return F.abs(F.floor((first - second) / DAY))


def close_strangers(rosters: DataFrame, name: str, ident: str, event: str, time: str = "t") -> DataFrame:
    """Names with two identities of known rosters, in one event or at most CLOSE_DAYS apart, that share no player.

    One such pair settles a name, and so does a player that all of its identities have. Most names have either, and neither needs all
    pairs: each identity is held against the next few of its name in time, and of its event. Only names that this leaves open
    have their pairs compared.
    """
    seen = rosters.where(F.col("player").isNotNull())
    known = kept(seen.groupBy(name, ident).agg(F.min(event).alias("e"), F.min(time).alias("t"), F.collect_set("player").alias("players")))
    everywhere = known.select(name, F.explode("players").alias("player")).groupBy(name, "player").agg(F.count("*").alias("has")).groupBy(name).agg(F.max("has").alias("has"))
    counts = known.groupBy(name).agg(F.count("*").alias("n"))
    in_time, in_event = Window.partitionBy(name).orderBy("t", ident), Window.partitionBy(name, "e").orderBy("t", ident)
    apart = lambda other: ~F.arrays_overlap("players", other["players"])
    ask = lambda w, test: reduce(lambda x, y: x | y, [F.coalesce(test(F.lead(F.struct(ident, "t", "players"), k).over(w)), F.lit(False)) for k in range(1, WITNESSES + 1)])
    close = lambda o: F.when(F.col(ident) < o[ident], _days_between(F.col("t"), o["t"])).otherwise(_days_between(o["t"], F.col("t"))) <= CLOSE_DAYS
    found = known.select(name, (ask(in_time, lambda o: apart(o) & close(o)) | ask(in_event, apart)).alias("found")).where("found").select(name).distinct()
    found = kept(found)
    open_ = counts.join(everywhere, name).where("has < n").select(name).join(found, name, "left_anti")
    rest = kept(known.join(open_, name, "left_semi"))
    cell = F.floor(F.col("t") / ((CLOSE_DAYS + 1) * DAY))
    near = strangers_in(rest.withColumn("cell", F.explode(F.array(cell, cell + 1))), name, ident, [name, "cell"], CLOSE_DAYS)
    return found.unionByName(strangers_in(rest, name, ident, [name, "e"], None)).unionByName(near).distinct()


def resolve_names(rosters: DataFrame, name: str, ident: str, event: str, time: str = "t") -> DataFrame:
    """(name, key, n, canonical, resolution) of every name that is not blank.

    ``rosters`` has a row for each player of an identity (null where the roster is unknown). Spellings with one key merge
    (normalized) only if two of them share a player; otherwise they stay apart, unresolved. So do generic names and those
    of close_strangers(); all others are exact.
    """
    rows = rosters.where(F.trim(name) != "").withColumn("key", identity_key(F.col(name)))
    rows = kept(rows.groupBy("key", name, ident, "player").agg(F.min(event).alias(event), F.min(time).alias(time)))
    names = rows.groupBy("key", name).agg(F.count_distinct(ident).alias("n"))
    spellings = names.groupBy("key").agg(F.count("*").alias("spellings"))
    shared = rows.where(F.col("player").isNotNull()).groupBy("key", "player").agg(F.min(name).alias("x"), F.max(name).alias("y")).where("x <> y").select("key").distinct().withColumn("verified", F.lit(True))
    strangers = close_strangers(rows, name, ident, event, time).withColumn("strange", F.lit(True))
    made = spelling_groups(names, name, "n").join(spellings, "key").join(shared, "key", "left").join(strangers, name, "left")
    open_ = (F.col("spellings") > 1) | F.col("strange").isNotNull() | F.rlike(F.col(name), F.lit(GENERIC))
    merged = (F.col("spellings") > 1) & F.col("verified").isNotNull()
    return made.select(name, "key", "n", F.when(merged, F.col("canonical")).otherwise(F.col(name)).alias("canonical"), F.when(merged, "normalized").when(open_, "unresolved").otherwise("exact").alias("resolution"))


def eras(rows: DataFrame, key: str, value: str, time: str = "t", game: str = "match_id") -> DataFrame:
    """Runs of equal values in time order (gaps and islands): key, era, value, n, begin, end."""
    at = prefix.cuts(rows, time, [key])
    marked = prefix.previous(rows, [key], {"__was": value}, [game], time, at)
    marked = prefix.running(marked, [key], {"era": F.when(F.col(value) == F.col("__was"), 0).otherwise(1)}, [game], time, at)
    return marked.groupBy(key, "era").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(time).alias("begin"), F.max(time).alias("end"))


def running_record(rows: DataFrame, key: list[str]) -> DataFrame:
    """Round number of each side and its wins and losses before it."""
    one = F.lit(1).cast("long")
    made = prefix.running(rows, key, {"round": one, "__w": F.col("win"), "__l": 1 - F.col("win")}, ["match_id"], at=prefix.cuts(rows, keys=key))
    return made.withColumns({"wins": F.col("__w") - F.col("win"), "losses": F.col("__l") - (1 - F.col("win"))}).drop("__w", "__l")


def search(teams: DataFrame, text: str, limit: int, column: str = "name") -> DataFrame:
    """Teams whose name holds the text, in any case, in order, at most ``limit``."""
    return teams.where(F.lower(column).contains(text.lower())).orderBy(column).limit(limit)


def expect(df: DataFrame, **checks: Column) -> dict[str, int]:
    """How many rows break each expectation (a true column is fine)."""
    row = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()]).first()
    return row.asDict()


def unique(df: DataFrame, *keys: str) -> bool:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
