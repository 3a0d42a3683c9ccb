"""Tournaments as DataFrames: Swiss stages and a bracket, for any number of simulations at once.

The state has a row for each simulation and team: sim, team, seed0 (seed in the stage), wins, losses, opps. One shuffle by
``sim`` serves all rounds: seeds are windows and pools are groups within a simulation. A pairing is the first of an
ordered list of perfect matchings with the fewest rematches, found by array functions. Results come from a probability
table and from hashes of (seed, simulation, stage, round, match), so they do not depend on how the work is dealt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept
from .metrics import uniform

# Fixed values of the rules: pairs of ranks in a pool of six, best row first.
PRIORITY = [
    "1v6 2v5 3v4",
    "1v6 2v4 3v5",
    "1v5 2v6 3v4",
    "1v5 2v4 3v6",
    "1v4 2v6 3v5",
    "1v4 2v5 3v6",
    "1v6 2v3 4v5",
    "1v5 2v3 4v6",
    "1v3 2v6 4v5",
    "1v3 2v5 4v6",
    "1v4 2v3 5v6",
    "1v3 2v4 5v6",
    "1v2 3v6 4v5",
    "1v2 3v5 4v6",
    "1v2 3v4 5v6",
]
BRACKET = "1v8 4v5 2v7 3v6"


#: An event's entrants and matches: what is broadcast for each of them is bounded by these.
ENTRANTS, MATCHES = 32, 106


def at_most(rows: DataFrame, most: int, what: str) -> DataFrame:
    """``rows``, once it is known that there are no more than ``most``; more are an error."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return rows


@dataclass(frozen=True)
class Rules:
    """Wins to advance, losses to go, the usual best-of of each stage (deciders are best of three), and the final's."""

    wins: int = 3
    losses: int = 3
    best_of: tuple[int, int, int] = (1, 1, 3)
    final: int = 5


def pairs_of(text: str) -> list[tuple[int, int]]:
    """0-based places of "1v6 2v5 3v4"."""
    return [tuple(int(x) - 1 for x in p.split("v")) for p in text.split()]


def matchings(n: int) -> list[list[tuple[int, int]]]:
    """All perfect matchings of n places: the best place meets the worst first, and so on for those left."""

    def of(rest: list[int]) -> list[list[tuple[int, int]]]:
        if not rest:
            return [[]]
        return [[(rest[0], x), *more] for x in reversed(rest[1:]) for more in of([r for r in rest[1:] if r != x])]

    return of(list(range(n)))


def _literal(rows: list[list[tuple[int, int]]]) -> Column:
    return F.array(*[F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in row]) for row in rows])


def first_fewest_rematches(pool: Column, options: Column) -> Column:
    """The first option with the fewest pairs that have met; pool holds (team, opps) by rank."""

    def cost(row: Column) -> Column:
        met = F.transform(row, lambda p: F.array_contains(F.get(pool, p["b"])["opps"], F.get(pool, p["a"])["team"]).cast("int"))
        return F.aggregate(met, F.lit(0), lambda acc, x: acc + x)

    best = F.array_min(F.transform(options, lambda row, i: F.struct(cost(row).alias("cost"), i.alias("i"))))
    return F.get(options, best["i"])


def seeded(state: DataFrame) -> DataFrame:
    """Adds difficulty (sum of opponents' wins less losses, as they stand) and seed: wins, losses, difficulty, seed0."""
    w = Window.partitionBy("sim")
    table = F.map_from_entries(F.collect_list(F.struct("team", (F.col("wins") - F.col("losses")).alias("d"))).over(w))
    state = state.withColumn("table", table)
    state = state.withColumn("difficulty", F.aggregate(F.transform("opps", lambda o: F.element_at("table", o)), F.lit(0), lambda acc, x: acc + x)).drop("table")
    return state.withColumn("seed", F.row_number().over(w.orderBy(F.desc("wins"), "losses", F.desc("difficulty"), "seed0")))


def pairings(state: DataFrame, number: int, rules: Rules = Rules()) -> DataFrame:
    """(sim, wins, losses, a, b) for a round: pools of one record are paired; a is the better seed's state."""
    live = seeded(state).where((F.col("wins") < rules.wins) & (F.col("losses") < rules.losses))
    entry = F.struct("seed", "team", "opps", "seed0")
    pools = live.groupBy("sim", "wins", "losses").agg(F.array_sort(F.collect_list(entry)).alias("pool"))
    if number == 1:
        half = F.size("pool") / 2
        chosen = F.transform(F.slice("pool", F.lit(1), half.cast("int")), lambda x, i: F.struct(i.alias("a"), (i + half.cast("int")).alias("b")))
    elif number <= 3:
        sizes = F.size("pool")
        chosen = F.when(sizes == 8, first_fewest_rematches(F.col("pool"), _literal(matchings(8)))).when(sizes == 4, first_fewest_rematches(F.col("pool"), _literal(matchings(4)))).otherwise(first_fewest_rematches(F.col("pool"), _literal(matchings(2))))
    else:
        chosen = first_fewest_rematches(F.col("pool"), _literal([pairs_of(r) for r in PRIORITY]))
    rows = pools.select("sim", "wins", "losses", "pool", F.explode(chosen).alias("p"))
    return rows.select("sim", "wins", "losses", F.get("pool", F.col("p.a")).alias("a"), F.get("pool", F.col("p.b")).alias("b"))


def results(played: DataFrame, matrix: DataFrame, best_of: Column, stage: int, number: int, seed: int | None, forced: DataFrame | None = None) -> DataFrame:
    """Adds best_of, p (that a wins) and a_wins; without a seed the favourite wins. ``matrix`` (a, b, best_of, p) has a row
    for every two of at most 32 entrants and each best-of, so it may be broadcast; so may ``forced`` (stage, round, team1,
    team2, winner), results given beforehand, one at most for each of an event's 106 matches."""
    m = F.broadcast(matrix.select(F.col("a").alias("ma"), F.col("b").alias("mb"), F.col("best_of").alias("mbo"), "p"))
    rows = played.withColumn("best_of", best_of)
    rows = rows.join(m, (F.col("a.team") == F.col("ma")) & (F.col("b.team") == F.col("mb")) & (F.col("best_of") == F.col("mbo")), "left").drop("ma", "mb", "mbo")
    if seed is None:
        rows = rows.withColumn("a_wins", F.col("p") >= 0.5)
    else:
        # one draw decides the match whichever side comes first
        first = F.col("a.team") < F.col("b.team")
        u = uniform(F.lit(seed), F.col("sim"), F.lit(stage), F.lit(number), F.least("a.team", "b.team"), F.greatest("a.team", "b.team"))
        rows = rows.withColumn("a_wins", F.when(first, u < F.col("p")).otherwise(u >= 1 - F.col("p")))
    if forced is None:
        return rows
    given = forced.where((F.col("stage") == stage) & (F.col("round") == number)).select(F.least("team1", "team2").alias("__x"), F.greatest("team1", "team2").alias("__y"), "winner")
    rows = rows.join(F.broadcast(given), (F.least("a.team", "b.team") == F.col("__x")) & (F.greatest("a.team", "b.team") == F.col("__y")), "left")
    return rows.withColumn("a_wins", F.when(F.col("winner").isNotNull(), F.col("winner") == F.col("a.team")).otherwise(F.col("a_wins"))).drop("__x", "__y", "winner")


def swiss_round(state: DataFrame, matrix: DataFrame, stage: int, number: int, rules: Rules = Rules(), seed: int | None = None, forced: DataFrame | None = None) -> DataFrame:
    decider = (F.col("wins") + 1 == rules.wins) | (F.col("losses") + 1 == rules.losses)
    usual = rules.best_of[stage - 1]
    played = results(pairings(state, number, rules), matrix, F.when(decider, max(3, usual)).otherwise(usual), stage, number, seed, forced)

    def after(x: str, y: str, won: Column) -> Column:
        return F.struct(F.col(f"{x}.team").alias("team"), F.col(f"{x}.seed0").alias("seed0"), (F.col("wins") + won.cast("int")).alias("wins"), (F.col("losses") + (~won).cast("int")).alias("losses"), F.concat(F.col(f"{x}.opps"), F.array(F.col(f"{y}.team"))).alias("opps"))

    both = played.select("sim", F.explode(F.array(after("a", "b", F.col("a_wins")), after("b", "a", ~F.col("a_wins")))).alias("s")).select("sim", "s.*")
    done = state.where((F.col("wins") >= rules.wins) | (F.col("losses") >= rules.losses))
    return done.select("sim", "team", "seed0", "wins", "losses", "opps").unionByName(both)


def start(entrants: DataFrame) -> DataFrame:
    """Stage entrants (sim, team, seed0) without a record."""
    return entrants.select("sim", "team", "seed0", F.lit(0).alias("wins"), F.lit(0).alias("losses"), F.array().cast("array<bigint>").alias("opps"))


def swiss_stage(entrants: DataFrame, matrix: DataFrame, stage: int, rules: Rules = Rules(), seed: int | None = None, forced: DataFrame | None = None) -> DataFrame:
    """Five rounds: every team ends with three wins or three losses. Adds the final seed."""
    state = start(entrants).repartition("sim")
    for number in range(1, rules.wins + rules.losses):
        state = swiss_round(state, matrix, stage, number, rules, seed, forced)
        if number == 3:
            state = kept(state).repartition("sim")
    return kept(seeded(state))


def next_entrants(finished: DataFrame, direct: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Direct entrants keep seeds 1 to 8; those that advanced follow in the order of their final seeds."""
    w = Window.partitionBy("sim").orderBy("seed")
    up = finished.where(F.col("wins") >= rules.wins).select("sim", "team", (F.row_number().over(w) + 8).alias("seed0"))
    return finished.select("sim").distinct().join(F.broadcast(direct.select("team", "seed0"))).unionByName(up)


def playoffs(finished: DataFrame, matrix: DataFrame, rules: Rules = Rules(), seed: int | None = None, forced: DataFrame | None = None) -> DataFrame:
    """(sim, team, place): 8, 4, 2 or 1 for how far each of the best eight came."""
    w = Window.partitionBy("sim").orderBy("seed")
    eight = finished.where(F.col("wins") >= rules.wins).withColumn("k", F.row_number().over(w))
    teams = eight.groupBy("sim").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "team"))), lambda x: F.struct(x["team"].alias("team"))).alias("t"))
    order = [x for p in pairs_of(BRACKET) for x in p]
    line = teams.select("sim", F.array(*[F.get("t", F.lit(i)) for i in order]).alias("line"))
    out = None
    for number, (left, best_of) in enumerate(((4, 3), (2, 3), (1, rules.final)), 1):
        games = line.select("sim", F.posexplode(F.sequence(F.lit(0), F.lit(left - 1))).alias("slot", "i"), "line")
        games = games.select("sim", "slot", F.get("line", F.col("i") * 2).alias("a"), F.get("line", F.col("i") * 2 + 1).alias("b"))
        games = kept(results(games, matrix, F.lit(best_of), 4, number, seed, forced))
        loser = games.select("sim", F.when(F.col("a_wins"), F.col("b.team")).otherwise(F.col("a.team")).alias("team"), F.lit(left * 2).alias("place"))
        out = loser if out is None else out.unionByName(loser)
        winner = games.withColumn("w", F.when(F.col("a_wins"), F.col("a")).otherwise(F.col("b")))
        line = winner.groupBy("sim").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "w"))), lambda x: x["w"]).alias("line"))
    return out.unionByName(line.select("sim", F.get("line", F.lit(0))["team"].alias("team"), F.lit(1).alias("place")))


def major(sims: DataFrame, entrants: DataFrame, matrix: DataFrame, rules: Rules = Rules(), seed: int | None = None, forced: DataFrame | None = None) -> DataFrame:
    """Whole events: (sim, team, stage, wins, losses, place) for every team's last stage.

    ``sims`` has a column sim; ``entrants`` (team, stage, seed0): 16 teams for stage 1, 8 each for stages 2 and 3.
    """
    entrants = at_most(entrants, ENTRANTS, "entrants")
    forced = forced if forced is None else at_most(forced, MATCHES, "results given beforehand")
    now = sims.select("sim").join(F.broadcast(entrants.where("stage = 1").select("team", "seed0")))
    out = None
    for stage in (1, 2, 3):
        finished = swiss_stage(now, matrix, stage, rules, seed, forced)
        left = finished if stage == 3 else finished.where(F.col("losses") >= rules.losses)
        rows = left.select("sim", "team", F.lit(stage).alias("stage"), "wins", "losses")
        out = rows if out is None else out.unionByName(rows)
        if stage < 3:
            now = next_entrants(finished, entrants.where(F.col("stage") == stage + 1), rules)
    return out.join(playoffs(finished, matrix, rules, seed, forced), ["sim", "team"], "left")


def matrix_of(strength: DataFrame) -> DataFrame:
    """(a, b, best_of, p) for all ordered pairs of entrants (team, rating): a map's expected score, composed to a series.

    More entrants than an event has are an error, which bounds the pairs.
    """
    from ..functions import expected
    from .series import win_probability

    strength = at_most(strength, ENTRANTS, "entrants")
    a, b = strength.select(F.col("team").alias("a"), F.col("rating").alias("ra")), strength.select(F.col("team").alias("b"), F.col("rating").alias("rb"))
    rows = a.join(F.broadcast(b), F.col("a") != F.col("b")).withColumn("best_of", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    p = expected(F.col("ra"), F.col("rb"))
    return rows.select("a", "b", "best_of", win_probability(F.array_repeat(p, F.col("best_of"))).alias("p"))


def probabilities(outcomes: DataFrame, n: int) -> DataFrame:
    """Per team: share of simulations that reach each milestone, with standard error and 95 % interval of the title."""
    place = F.coalesce("place", F.lit(99))
    each = outcomes.groupBy("team").agg(
        F.count_if((F.col("stage") > 1)).alias("past_1"),
        F.count_if(F.col("stage") > 2).alias("past_2"),
        F.count_if(place <= 8).alias("playoffs"),
        F.count_if(place <= 4).alias("semi"),
        F.count_if(place <= 2).alias("final"),
        F.count_if(place == 1).alias("title"),
    )
    p = F.col("title") / n
    se = F.sqrt(p * (1 - p) / n)
    return each.withColumns({"p_title": p, "se": se, "low": F.greatest(p - 1.96 * se, F.lit(0.0)), "high": F.least(p + 1.96 * se, F.lit(1.0))})
