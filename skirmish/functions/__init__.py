"""Scalar column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the analytics.
START, K, SCALE = 1500.0, 32.0, 400.0
PRIOR_WINS, PRIOR_GAMES = 2.0, 4.0
DAY = 86_400 * 1_000_000


def to_num(c: Column) -> Column:
    """Blank and unparseable text becomes null."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("double")


def best_of(c: Column) -> Column:
    """1, 3 or 5 (also written 1.0, 3.0, 5.0); anything else is null."""
    n = to_num(c)
    return F.when(n.isin(1.0, 3.0, 5.0), n.cast("int"))


def smoothed(wins: Column, games: Column) -> Column:
    """Win rate with a Beta(2, 2) prior."""
    return (wins + PRIOR_WINS) / (games + PRIOR_GAMES)


def expected(own: Column, other: Column) -> Column:
    """Expected score of a rating against another."""
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / SCALE))


def normalized_margin(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 without any score."""
    return F.when(a + b > 0, (a - b) / (a + b)).otherwise(0.0)


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp without or with a zone (UTC)."""
    return F.unix_micros(t.cast("timestamp"))


def days(us: Column) -> Column:
    return us / float(DAY)


def sign_winner(a: Column, b: Column) -> Column:
    """team1, team2, tie or missing."""
    return F.when(a.isNull() | b.isNull(), "missing").when(a > b, "team1").when(a < b, "team2").otherwise("tie")


def identity_key(c: Column) -> Column:
    """Lower case without anything but letters, digits and underscores."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", "")


def pair_key(a: Column, b: Column) -> Column:
    """The same key for both orders of two names."""
    return F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
