"""Personal data by boosted trees over candidate spans, in DataFrame functions only.

High-recall patterns propose spans of each kind, which may overlap. Each span has format features (size, digits, groups)
and context features (words before it, characters around it). Boosted trees, fitted to the
counts of all distinct feature rows of all documents, become one SQL expression; a threshold for each kind, calibrated on candidates that the trees have
not seen, decides which spans are accepted, and of those that overlap the choice with the greatest sum of chances is taken. Spans of the base patterns that pass their checks always stay; a match of a
base pattern that fails its check is a negative example and is never redacted as that kind.

No table marks personal data, so the labels are weak: a check digit, a range, a keyword before a span or a known key
format speaks for it. The evidence that labels a kind is hidden from the trees for that kind (``HELD``): they learn from
the other features what such spans look like, and so judge spans without that evidence too. Candidates of which nothing
can be said (a phone number without a country code and without a keyword) are judged but not learned from.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, id_text, materialize

#: Kinds in the order that breaks ties of spans with the same start.
KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = KINDS[:4]
#: Distinct feature rows up to which the trees are grown on the driver; places of scores in a unit; gains this close, in parts, are equal.
LOCAL_ROWS, GRID, TIE = 20_000, 10_000, 1e-9
PRECISION = 0.98

# Possessive quantifiers and look-behinds keep each pattern linear in the text: the first try at a run decides for all
# of it, because what the run lacks its tails lack too. \G lets a match begin where the one before ended.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
PATTERNS = {
    "email": rf"{_LOCAL}@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall forms beyond the base patterns. None limits the length of what it matches.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++| ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]++(?:[\[(]\.[\])][0-9]++){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]))",
    "card": r"(?<![0-9])[0-9]{4}(?:[.\x20-][0-9]{4}){2}[.\x20-][0-9]{3,4}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+",
}
#: Cheap tests of a whole text: what a kind's patterns match always holds its guard too.
_GUARD = {"email": r"[@\[(]", "ip": r"\.[0-9]", "card": r"[0-9][.\x20-]?[0-9]", "phone": r"[0-9]", "secret": r"[0-9]"}
_MORE_GUARD = _GUARD | {"ip": r"\.[\])]|[0-9A-Fa-f]:[0-9A-Fa-f]"}

FEATURES = ["kind", "size", "digits", "upper", "marks", "groups", "tld", "luhn", "octets", "plus", "keyword", "known", "before", "after"]
#: The features that decide a kind's label: the trees see 0 there for that kind.
HELD = {"email": ["tld"], "ip": ["octets"], "card": ["luhn"], "phone": ["digits", "plus", "keyword"], "secret": ["keyword", "known"]}

_MATCHES = "array<struct<gap:string,m:string>>"
#: Code points in a block of text from which pieces are cut.
BLOCK = 4096


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """What ``step`` gives for each item in order: (state, item) -> (next state, result of type ``out``).

    Lists that grow by one are copied each time, so results gather in blocks of as many items as there are blocks: the work is
    nearly linear. ``items`` should be a column, not an expression: each block refers to it.
    """
    n = F.size(items)
    width = F.ceil(F.sqrt(n)).cast("int")
    none = F.array().cast(f"array<{out}>")

    def block(acc: Column, b: Column) -> Column:
        def one(inner: Column, x: Column) -> Column:
            then, made = step(inner["state"], x)
            return F.struct(then.alias("state"), F.concat(inner["out"], F.array(made.cast(out))).alias("out"))

        begin = F.struct(acc["state"].alias("state"), none.alias("out"))
        return F.aggregate(F.slice(items, b * width + 1, width), begin, one, lambda inner: F.struct(inner["state"].alias("state"), F.concat(acc["out"], inner["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))
    return F.when(n > 0, F.aggregate(blocks, F.struct(state.alias("state"), none.alias("out")), block, lambda acc: acc["out"])).otherwise(none)


def matches(text: Column, guard: str, pattern: str) -> Column:
    """array<struct<gap, m>>: a pattern's matches, each with the text between it and the one before; at the end the text behind
    the last one, without a match. Empty where the text lacks the guard or a match."""
    both = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast(_MATCHES)
    return F.when(F.regexp_like(text, F.lit(guard)) & F.regexp_like(text, F.lit(pattern)), both).otherwise(F.array().cast(_MATCHES))


def with_spans(docs: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """``docs`` with a column of spans for each name in ``patterns`` (guard, pattern): array<struct<start, end, m, before, after>>,
    places in code points, what stands up to 24 characters before a match (as far back as the match before it) and the character
    behind it. Lengths are added up and neighbours looked at, so no step searches or cuts the whole text for one match."""
    own = docs.columns
    rest = list(patterns)
    found = docs.select("*", *[matches(F.col("text"), guard, p).alias(f"z_{name}") for name, (guard, p) in patterns.items()])

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        return F.coalesce(start + F.length(x["m"]), start), start

    found = found.select("*", *[scan(F.col(f"z_{name}"), F.lit(0), step, "int").alias(f"at_{name}") for name in rest])

    def spans(name: str) -> Column:
        z, at = F.col(f"z_{name}"), F.col(f"at_{name}")

        def span(x: Column, i: Column) -> Column:
            start, was, then = F.get(at, i), F.get(z, i - 1), F.get(z, i + 1)
            before = F.right(F.concat(F.coalesce(was["m"], F.lit("")), x["gap"]), F.lit(24))
            after = F.left(F.concat(then["gap"], F.coalesce(then["m"], F.lit(""))), F.lit(1))
            return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"), before.alias("before"), after.alias("after"))

        return F.filter(F.transform(z, span), lambda s: s["m"].isNotNull())

    return found.select(*own, *[spans(name).alias(name) for name in rest])


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether digits pass the Luhn check."""
    at = F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1)))

    def step(acc: Column, i: Column) -> Column:
        x = F.coalesce(F.substring(d, i, F.lit(1)).try_cast("int"), F.lit(0))
        twice = x * 2
        return acc + F.when((F.length(d) - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

    return F.aggregate(at, F.lit(0), step) % 10 == 0


def octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))


def passes(kind: str, m: Column) -> Column:
    """The check of a base pattern's match."""
    d = digits_of(m)
    return {"email": F.lit(True), "ip": octets(m), "card": F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False), "phone": F.length(d).between(10, 15)}[kind]


def checked(kind: str) -> Column:
    """The spans of a base pattern that pass its check. (A lambda's second argument would be the index: the kind is bound here.)"""
    return F.filter(f"b_{kind}", lambda s: passes(kind, s["m"]))


def count_of(m: Column, chars: str) -> Column:
    return F.length(m) - F.length(F.regexp_replace(m, f"[{chars}]", ""))


def described(kind: str, s: Column, base: bool, label: bool) -> Column:
    """A span with its features, whole numbers of a few values each, and, where asked for, its weak label (1, 0 or null)."""
    m, d = s["m"], digits_of(s["m"])
    before = F.lower(s["before"])
    keyword = F.regexp_like(before, F.lit({"secret": r"(password|passwd|token|secret|api.?key|key)[^a-z]{0,6}$", "phone": r"(tel|phone|call|fax)[^a-z]{0,4}$", "card": r"(card|visa|pay)[^a-z]{0,4}$", "email": r"(mail|contact)[^a-z]{0,4}$", "ip": r"(ip|host|addr)[^a-z]{0,4}$"}[kind]))
    known = F.regexp_like(m, F.lit(r"^(AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|[0-9a-f]{40}|sk_live_[A-Za-z0-9]{16,})$"))
    bit = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    seen = {
        "kind": F.lit(KINDS.index(kind)),
        "size": F.least(F.length(m), F.lit(48)),
        "digits": F.least(F.length(d), F.lit(20)),
        "upper": F.least(count_of(m, "A-Z"), F.lit(8)),
        "marks": F.least(count_of(m, "^A-Za-z0-9"), F.lit(8)),
        "groups": F.least(F.size(F.split(m, r"[^A-Za-z0-9]+")), F.lit(8)),
        "tld": bit(F.regexp_like(m, F.lit(r"[.)\] ][A-Za-z]{2,12}$"))),
        "luhn": bit(F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)),
        "octets": bit(octets(F.regexp_replace(m, r"[\[\](){}]", ""))) if kind == "ip" else F.lit(0),
        "plus": bit(m.startswith("+")),
        "keyword": bit(keyword),
        "known": bit(known),
        "before": bit(F.regexp_like(F.right(before, F.lit(1)), F.lit("[a-z0-9_./-]"))),
        "after": bit(F.regexp_like(s["after"], F.lit("[A-Za-z0-9_/-]"))),
    }
    out = [F.lit(0).alias(k) if k in HELD[kind] else v.cast("int").alias(k) for k, v in seen.items()]
    if label:
        unknown = F.lit(None).cast("int")
        phone = F.length(d).between(10, 15) if base else F.when(keyword, True)
        strong = {"email": seen["tld"] == 1, "ip": seen["octets"] == 1, "card": seen["luhn"] == 1, "phone": phone, "secret": keyword | known}[kind]
        out.append(F.when(strong.isNull(), unknown).otherwise(strong.cast("int")).alias("label"))
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), *out)


def generators() -> dict[str, tuple[str, str]]:
    """(guard, pattern) by column: b_ for the base patterns, m_ for the other forms, each with its kind."""
    return {f"b_{k}": (_GUARD[k], PATTERNS[k]) for k in BASE} | {f"m_{k}": (_MORE_GUARD[k], MORE[k]) for k in KINDS}


def examples(docs: DataFrame) -> DataFrame:
    """A row for each labelled candidate of (half, text): what base patterns match, passed or failed, and the other forms."""
    found = with_spans(docs.select("half", "text"), generators())
    kind = lambda name, k: F.transform(name, lambda s: described(k, s, name.startswith("b_"), True))
    every = [kind(name, name[2:]) for name in generators()]
    return found.select("half", F.explode(F.concat(*every)).alias("c")).select("half", "c.*").where("label is not null")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text, b_email .. b_phone: spans of the base patterns, c: candidates of the other forms with features)."""
    found = with_spans(docs.select("doc_id", "text"), generators())
    kind = lambda k: F.transform(f"m_{k}", lambda s: described(k, s, False, False))
    return found.select("doc_id", "text", *[checked(k).alias(f"b_{k}") for k in BASE], F.concat(*[kind(k) for k in KINDS]).alias("c"))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, cut, left, right) or a leaf's value. Ties go to the first split."""
    value = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 2:
        return value
    best = (1e-6, None)
    score = lambda a, b: a * a / (b + 1.0)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            gain = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())
            if gain > best[0] * (1 + TIE):
                best = (gain, (f, int(cut), left))
    if best[1] is None:
        return value
    f, cut, left = best[1]
    return f, cut, grow(x[left], g[left], h[left], depth - 1), grow(x[~left], g[~left], h[~left], depth - 1)


def tree_values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    left = x[:, tree[0]] <= tree[1]
    return np.where(left, tree_values(tree[2], x), tree_values(tree[3], x))


class Model:
    """Boosted trees and a threshold for each kind; without candidates of both labels nothing is added to the base."""

    def __init__(self, trees: list, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, c: Column) -> Column:
        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            return F.when(c[FEATURES[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        out = F.lit(0.0)
        for tree in self.trees:
            out = out + of(tree)
        return out

    def accepts(self, c: Column) -> Column:
        """Whether a span (rank of its kind, score) reaches its kind's threshold."""
        limit = F.lit(float("inf"))
        for k, v in self.thresholds.items():
            limit = F.when(c["rank"] == KINDS.index(k), F.lit(v)).otherwise(limit)
        return c["score"] >= limit


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 12, depth: int = 3, rate: float = 0.5) -> list:
    trees, s = [], np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-s))
        tree = grow(x, w * (p - y), w * p * (1 - p), depth)
        scaled = scale(tree, rate)
        trees.append(scaled)
        s += tree_values(scaled, x)
    return trees


def scale(tree, rate: float):
    return (tree[0], tree[1], scale(tree[2], rate), scale(tree[3], rate)) if isinstance(tree, tuple) else tree * rate


def grow_counted(rows: DataFrame, depth: int):
    """grow() on rows (features, g, h) that stay in Spark: each level is one sum by (node, feature, value), which comes to the driver."""
    splits: dict[int, tuple[int, int]] = {}
    value: dict[int, float] = {}

    def at(node: int) -> Column:
        if node not in splits:
            return F.lit(node)
        f, cut = splits[node]
        return F.when(F.col(FEATURES[f]) <= cut, at(2 * node)).otherwise(at(2 * node + 1))

    score = lambda a, b: a * a / (b + 1.0)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).alias("v")) for k, f in enumerate(FEATURES)]))
    for level in range(depth):
        sums = rows.select(at(1).alias("node"), "g", "h", cells.alias("c")).groupBy("node", "c.f", "c.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        by: dict[int, dict[int, list]] = {}
        for r in sums.where(F.col("node") >= 1 << level).orderBy("node", "f", "v").collect():
            by.setdefault(r["node"], {}).setdefault(r["f"], []).append((r["v"], r["g"], r["h"]))
        for node, features in by.items():
            best, found = 1e-6, None
            for f, cells_ in features.items():
                v, g, h = (np.array(c) for c in zip(*cells_, strict=True))
                gl, hl = np.cumsum(g), np.cumsum(h)
                value.setdefault(node, float(-gl[-1] / (hl[-1] + 1.0)))
                for k in range(len(v) - 1):
                    gain = score(gl[k], hl[k]) + score(gl[-1] - gl[k], hl[-1] - hl[k]) - score(gl[-1], hl[-1])
                    if gain > best * (1 + TIE):
                        best, found = gain, (f, int(v[k]), gl[k], hl[k], gl[-1] - gl[k], hl[-1] - hl[k])
            if found:
                splits[node] = found[:2]
                value[2 * node], value[2 * node + 1] = float(-found[2] / (found[3] + 1.0)), float(-found[4] / (found[5] + 1.0))

    def tree(node: int):
        return (*splits[node], tree(2 * node), tree(2 * node + 1)) if node in splits else value.get(node, 0.0)

    return tree(1)


def boost_counted(rows: DataFrame, rounds: int = 12, depth: int = 3, rate: float = 0.5) -> list:
    """boost() on rows (features, label, n) that stay in Spark."""
    trees: list = []
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-Model(trees, {}).score(F.struct(*FEATURES))))
        state = rows.select(*FEATURES, (F.col("n") * (p - F.col("label"))).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        trees.append(scale(grow_counted(state, depth), rate))
    return trees


def limits(rows: list) -> dict[str, float]:
    """The threshold of each kind from rows (kind, place of the score on a grid of GRID a unit, number, number of the right ones): the lowest
    score from which on enough of what is accepted is right, never one that the trees call unlikely."""
    out = {}
    for i, kind in enumerate(KINDS):
        up = all_ = 0.0
        for _, at, n, right in sorted((r for r in rows if r[0] == i and r[1] > 0), key=lambda r: -r[1]):
            up, all_ = up + right, all_ + n
            if up >= PRECISION * all_:
                out[kind] = at / GRID - 1e-9
    return out


def fit(docs: DataFrame, local_rows: int = LOCAL_ROWS) -> Model:
    """Fits the trees to the labelled candidates of all documents: half of the documents, the other half for the thresholds.

    Spark counts equal feature rows. If there are at most ``local_rows`` of them, all come to the driver, where the trees are grown; else
    they stay in Spark and only sums by node and value of a feature, and by score, come. Both see every candidate."""
    half = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2))
    keys = ["half", *FEATURES, "label"]
    counted = materialize(examples(docs.select(half.alias("half"), "text")).groupBy(*keys).agg(F.count("*").alias("n")))
    seen = {(r["half"], r["label"]): r["n"] for r in counted.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    if not (seen.get((0, 0)) and seen.get((0, 1))):
        drop(counted)
        return Model([], {})
    if sum(seen.values()) <= local_rows:
        rows = counted.where("half = 0").orderBy(*keys).collect()
        x = np.array([[r[f] for f in FEATURES] for r in rows], np.int64)
        y, w = (np.array([r[k] for r in rows], float) for k in ("label", "n"))
        trees = boost(x, y, w)
    else:
        trees = boost_counted(counted.where("half = 0"))
    at = F.floor(Model(trees, {}).score(F.struct(*FEATURES)) * GRID).alias("at")
    scored = counted.where("half = 1").select("kind", at, "n", (F.col("n") * F.col("label")).alias("right"))
    found = limits([tuple(r) for r in scored.groupBy("kind", "at").agg(F.sum("n"), F.sum("right")).collect()])
    drop(counted)
    return Model(trees, found)


_PLAIN = "struct<start:int,rank:int,end:int>"
_EVENT = "struct<at:int,opens:int,base:boolean,id:int>"
_OPEN = "array<struct<id:int,value:double,then:int>>"


def chosen(docs: DataFrame) -> DataFrame:
    """``docs`` with ``picked``, the added spans that stay: none overlaps a base span, no two overlap, and the sum of their
    chances is the greatest that can be had (ties: what ends first).

    One sweep over the places where spans begin and end. ``best`` is the greatest sum up to here, ``last`` the span that ends
    it; a span that begins notes the best up to there with its own chance added. A base span that begins ends all that are
    open. As matches of one pattern do not overlap, only a few are open at once. A second sweep goes back from the last span.
    """
    def events(name: str, base: bool) -> Column:
        def ends(s: Column, i: Column) -> Column:
            end = lambda at, opens: F.struct(at.alias("at"), F.lit(opens).alias("opens"), F.lit(base).alias("base"), i.cast("int").alias("id"))
            return F.array(end(s["start"], 1), end(s["end"], 0))

        return F.flatten(F.transform(name, ends))

    start = F.struct(F.lit(0.0).alias("best"), F.lit(-1).alias("last"), F.lit(0).alias("bases"), F.array().cast(_OPEN).alias("open"))

    def sweep(st: Column, x: Column) -> tuple[Column, Column]:
        begins = x["opens"] == 1
        mine = F.get(F.filter(st["open"], lambda o: o["id"] == x["id"]), F.lit(0))
        new = F.struct(x["id"].alias("id"), (st["best"] + F.get("added", x["id"])["chance"]).alias("value"), st["last"].alias("then"))
        better = ~begins & ~x["base"] & F.coalesce(mine["value"] > st["best"], F.lit(False))
        open_ = F.when(x["base"], F.when(begins, F.array().cast(_OPEN)).otherwise(st["open"])).when(
            begins, F.when(st["bases"] == 0, F.concat(st["open"], F.array(new))).otherwise(st["open"])
        ).otherwise(F.filter(st["open"], lambda o: o["id"] != x["id"]))
        then = F.struct(
            F.when(better, mine["value"]).otherwise(st["best"]).alias("best"),
            F.when(better, x["id"]).otherwise(st["last"]).alias("last"),
            (st["bases"] + F.when(x["base"], F.when(begins, 1).otherwise(-1)).otherwise(0)).alias("bases"),
            open_.alias("open"),
        )
        return then, F.when(better, F.struct(x["id"].alias("id"), mine["then"].alias("then")))

    back = lambda want, x: (F.when(x["id"] == want, x["then"]).otherwise(want), F.when(x["id"] == want, x["id"]))
    some = F.size("added") > 0
    made = docs.withColumn("events", F.when(some, F.array_sort(F.concat(events("base", True), events("added", False)).cast(f"array<{_EVENT}>"))).otherwise(F.array().cast(f"array<{_EVENT}>")))
    made = made.withColumn("steps", scan(F.col("events"), start, sweep, "struct<id:int,then:int>"))
    made = made.withColumn("steps", F.reverse(F.filter("steps", lambda x: x.isNotNull())))
    made = made.withColumn("path", scan(F.col("steps"), F.get("steps", F.lit(0))["id"], back, "int"))
    picked = F.transform(F.filter("path", lambda i: i.isNotNull()), lambda i: F.get("added", i))
    return made.withColumn("picked", picked).drop("events", "steps", "path")


def found_in(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, base, spans): arrays of (start, rank of the kind, end), sorted; spans has those that the model adds. Base
    spans stay as they are; of added ones that overlap, the choice with the greatest sum of chances stays."""
    made = candidates(docs)
    plain = lambda name, k: F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), s["end"].alias("end")))
    base = F.array_sort(F.concat(*[plain(f"b_{k}", k) for k in BASE]))
    scored = F.transform("c", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("rank"), c["end"].alias("end"), model.score(c).alias("score")))
    made = made.select("doc_id", "text", base.alias("base"), scored.alias("scored"))
    added = F.transform(F.filter("scored", model.accepts), lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), (1 / (1 + F.exp(-c["score"]))).alias("chance")))
    made = chosen(made.select("doc_id", "text", "base", F.array_sort(added).alias("added")))
    both = F.array_sort(F.concat("base", F.transform("picked", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))))
    return made.select("doc_id", "text", "base", F.when(F.size("picked") > 0, both).otherwise(F.col("base")).alias("spans"))


def joined(spans_: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1), s["start"], s["end"])))


def number(spans_: str, kind: str) -> Column:
    """How many spans are of a kind. (A lambda's second argument would be the index: the rank is bound here.)"""
    rank = KINDS.index(kind)
    return F.size(F.filter(spans_, lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of every row: counts and spans of the base patterns, all spans.

    Places are code points, ends exclusive. Null and empty texts have no spans; rows that repeat are all returned; spans
    of any length count; an empty table gives no rows and fits no model. Other columns of ``docs`` are not read.
    """
    rows = id_text(docs, id_col, text_col)
    made = found_in(rows, model or fit(rows))
    return made.select("doc_id", *[number("base", k) for k in BASE], joined(F.col("base")).alias("base"), joined(F.col("spans")).alias("spans"))


def piece(blocks: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of a text in blocks of BLOCK: only the blocks they lie in are touched."""
    first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
    one = F.substring(F.get(blocks, first), a - first * BLOCK + 1, b - a)
    head = F.substring(F.get(blocks, first), a - first * BLOCK + 1, F.lit(BLOCK))
    more = F.concat(head, F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(F.get(blocks, last), F.lit(1), b - last * BLOCK))
    return F.when(b <= a, F.lit("")).when(first == last, one).otherwise(more)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` (text, spans) with every span of the text replaced by [KIND]; overlapping spans become one, named after the
    first. The parts between spans and the names are joined at once."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    some = F.size("spans") > 0
    made = docs.withColumn("blocks", F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        part = F.concat(piece(F.col("blocks"), at, s["start"]), F.get(names, s["rank"]))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, part).otherwise(F.lit(""))

    made = made.withColumn("parts", scan(F.col("spans"), F.lit(0), step, "string"))
    tail = piece(F.col("blocks"), F.array_max(F.transform("spans", lambda s: s["end"])), F.length("text"))
    return made.withColumn("text", F.when(some, F.concat(F.array_join("parts", ""), tail)).otherwise(F.col("text"))).drop("blocks", "parts")


def redact(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, personal data in ``text_col`` replaced by the name of its kind.

    Null texts stay null, empty ones empty; texts and numbers of spans of any size; rows that repeat all stay, null ids too;
    an empty table gives no rows and fits no model; other columns come through whatever their names.
    """
    rows = id_text(docs, id_col, text_col)
    model = model or fit(rows)
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id")
    # found_in() reads doc_id and text alone; the row rides along in place of the id
    made = redacted(found_in(docs.select(kept, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")), model))
    text = F.when(F.col("doc_id")[text_col].isNull(), F.lit(None).cast("string")).otherwise(F.col("text"))
    return made.select(*[text.alias(c) if c == text_col else F.col("doc_id")[c].alias(c) for c in docs.columns])
