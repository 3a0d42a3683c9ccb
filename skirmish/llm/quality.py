"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of labelled target documents and one of all raw documents, give each
document the weight p_target / p_raw, the product over its n-grams. Gumbel noise is added to the log weights, and the
largest k stay: a sample without replacement in proportion to the weights. The caller chooses k; where they do not, it is
the number of good documents to expect, the sum over all documents of the probability that labelled ones of such a weight
are good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, id_text, map_texts, materialize, slices
from .wordhash import GOLDEN, Words, mix

BUCKETS = 1 << 16
#: At most so many labelled documents (by a hash of their ids) fit the target model and calibrate k.
LABELLED = 50_000
SMOOTH = 20.0


class Tokens(Words):
    """Runs of letters, digits and all beyond ASCII, and runs of punctuation, as tokens; case is kept."""

    KIND = np.array([2 if 0x21 <= b < 0x7F and not chr(b).isalnum() else 0 if b <= 0x20 or b == 0x7F else 1 for b in range(256)], np.int8)

    def __init__(self, texts: list[str]):
        parts = [t.encode() for t in texts]
        self.raw = b"\n".join(parts) + b"\n" * 9
        kind = self.KIND[np.frombuffer(self.raw, np.uint8)]
        edge = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]))
        some = np.flatnonzero(kind[edge[:-1]])
        self.start, self.end = edge[some], edge[some + 1]
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.first = np.searchsorted(self.start, begins)
        self.texts = len(texts)
        self.doc = np.repeat(np.arange(self.texts), np.diff(self.first))


def features(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every token and every pair of neighbours; a token that repeats the one before or the one two
    before it falls into a bucket of its own kind, as pairs of equal tokens say more together than each by itself."""
    t = Tokens(texts)
    h = t.hashes()
    left = t.left()
    pair = left >= 2
    two = mix(h[:-1] * GOLDEN + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
    two = np.where(h[:-1] == h[1:], np.uint64(1), two)[pair[:-1]]
    skip = (left[:-2] >= 3) & (h[:-2] == h[2:]) if len(h) > 2 else np.zeros(0, bool)
    doc = np.concatenate((t.doc, t.doc[:-1][pair[:-1]], t.doc[:-2][skip] if len(h) > 2 else np.zeros(0, np.int64)))
    h = np.concatenate((h, two, np.full(int(skip.sum()), 2, np.uint64)))
    return doc, (mix(h) % np.uint64(buckets)).astype(np.int64)


def ngram_counts(docs: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in all texts, and in those whose ``role`` is 1 (the target).

    Each task sums its texts to dense vectors, Spark sums those; ``buckets`` rows at most come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 4_000_000):
                doc, at = features(part.column("text").to_pylist(), buckets)
                raw += np.bincount(at, minlength=buckets)
                wanted = np.array(part.column("role").to_pylist()) == 1
                target += np.bincount(at[wanted[doc]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": some, "raw": raw[some], "target": target[some]})

    raw, target = np.zeros(buckets), np.zeros(buckets)
    summed = docs.select("text", "role").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    for row in summed.collect():  # at most ``buckets`` rows
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    return raw, target


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """log p_target / p_raw by bucket. ``smooth`` is added to each raw count and its share to each target count, so that
    buckets seldom seen say little; then the ratio moves towards 0 by its standard error, or what is mere chance in each
    n-gram would add up in long texts."""
    share = target.sum() / max(raw.sum(), 1)
    seen = target + smooth * share
    plain = np.log(seen / share) - np.log(raw + smooth)
    return np.sign(plain) * np.maximum(np.abs(plain) - 1 / np.sqrt(seen), 0)


def gumbel(ids: list) -> np.ndarray:
    """Gumbel noise fixed by the id, so that a lost task makes the same again."""
    seed = np.array([-1 if x is None else x for x in ids], np.int64).view(np.uint64)
    u = ((mix(seed * GOLDEN + np.uint64(3)) >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52
    return -np.log(-np.log(u))


def scores(ids: list, texts: list[str], ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n_grams, log weight, key) of texts; the key is the log weight and the id's Gumbel noise."""
    doc, at = features(texts, len(ratio))
    weight = np.bincount(doc, ratio[at], len(texts))
    return np.bincount(doc, minlength=len(texts)), weight, weight + gumbel(ids)


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, log_weight, key) of every row; a text without tokens has a log weight of 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def run(cols: dict) -> dict:
        n, weight, key = scores(cols["doc_id"], cols["text"], shared.value)
        return {"doc_id": cols["doc_id"], "n_grams": n, "log_weight": weight, "key": key}

    return map_texts(docs, run, "doc_id long, n_grams long, log_weight double, key double")


def roles(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, role, good): labelled documents, half of them (good ones) as the target, half to calibrate k.

    About ``most`` rows at most, chosen by a hash of their ids, so the result may be broadcast.
    """
    each = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    share = min(1.0, most / max(1, each.count()))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    return each.where(u < int(share * (1 << 20))).select("doc_id", F.when(u % 2 == 1, 2).when(F.col("quality") == 1, 1).otherwise(0).alias("role"), (F.col("quality") == 1).alias("good"))


class Chance:
    """The probability that a document of a log weight is good: the shares of good ones among labelled documents, pooled
    until they rise with the weight (isotonic regression). Without labels of both kinds all are taken for good."""

    def __init__(self, weight: np.ndarray, good: np.ndarray):
        self.edge, self.share = np.zeros(0), np.ones(1)
        if not good.any() or good.all():
            return
        x, at = np.unique(weight, return_inverse=True)
        pools: list[list[float]] = []  # good ones, all, largest weight
        for w, g, n in zip(x, np.bincount(at, good), np.bincount(at), strict=True):
            pools.append([g, n, w])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                g, n, w = pools.pop()
                pools[-1] = [pools[-1][0] + g, pools[-1][1] + n, w]
        tops = np.array([p[2] for p in pools])
        after = x[np.minimum(np.searchsorted(x, tops[:-1], "right"), len(x) - 1)]
        self.edge = (tops[:-1] + after) / 2  # halfway to the next pool
        self.share = np.array([p[0] / p[1] for p in pools])

    def of(self, weight: np.ndarray) -> np.ndarray:
        return self.share[np.searchsorted(self.edge, weight)]


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = LABELLED) -> tuple[np.ndarray, Chance]:
    """(log ratio by bucket, chance of being good). The raw model counts all documents, the target model at most ``most``
    labelled good ones; labelled documents that the target lacks calibrate the chance."""
    known = materialize(roles(labels, most))
    wide = F.broadcast(known)  # at most ``most`` rows
    raw, target = ngram_counts(docs.join(wide.drop("good"), "doc_id", "left").select("text", F.coalesce("role", F.lit(0)).alias("role")), buckets)
    ratio = log_ratio(target, raw) if target.any() else np.zeros(buckets)
    held = log_weights(docs.join(wide.where("role = 2"), "doc_id", "left_semi"), ratio).join(wide, "doc_id").groupBy("log_weight", "good").count().orderBy("log_weight", "good").limit(2 * most).collect()
    drop(known)
    n = np.array([r["count"] for r in held], np.int64)
    return ratio, Chance(np.repeat([r["log_weight"] for r in held], n), np.repeat(np.array([r["good"] for r in held], bool), n))


def expected_good(scored: DataFrame, chance: Chance) -> int:
    """The sum of the chances of all rows, as a whole number. Each pool is a range of weights: Spark counts the rows of each."""
    if not len(chance.edge):
        return scored.count()
    at = F.array_size(F.filter(F.array(*[F.lit(float(e)) for e in chance.edge]), lambda e: e < F.col("log_weight")))
    n = {r["at"]: r["n"] for r in scored.groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect()}  # a row for each pool
    return round(sum(k * float(chance.share[i]) for i, k in n.items()))


def nth_largest(rows: DataFrame, name: str, n: int, bins: int = 4096, few: int = 10_000) -> tuple[object, int]:
    """(value, rank): the n-th largest of a column's values and the rank it has among equal ones; n is at most the rows.

    Counts by range narrow the range that holds it until ``few`` rows are left; only those are ordered.
    """
    lo, hi, left = *rows.agg(F.min(name), F.max(name)).first(), n
    while True:
        inside = rows.where(F.col(name).between(lo, hi))
        if lo == hi:
            return lo, left
        width = (float(hi) - float(lo)) / bins
        if not width > 0:  # values so close that doubles do not tell them apart: there are few
            r = {"lo": lo, "hi": hi, "n": 0}
            break
        place = F.least(F.lit(bins - 1), F.floor((F.col(name).cast("double") - F.lit(float(lo))) / F.lit(width)).cast("int"))
        ranges = inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi"))
        for r in sorted(ranges.collect(), key=lambda r: -r["b"]):  # at most ``bins`` rows
            if left <= r["n"]:
                break
            left -= r["n"]
        lo, hi = r["lo"], r["hi"]
        if r["n"] <= few:
            break
    for v in rows.where(F.col(name).between(r["lo"], r["hi"])).groupBy(name).count().orderBy(F.desc(name)).toLocalIterator():
        if left <= v["count"]:
            return v[name], left
        left -= v["count"]
    raise ValueError("n exceeds the number of rows")


def among_top(scored: DataFrame, k: int, bins: int = 4096) -> Column:
    """Whether a row of ``scored`` is among the k largest keys; of equal keys the smaller doc_ids are. Found exactly, without
    a global sort. Rows that repeat both share their fate, so with such rows at the edge there may be more than k."""
    n = scored.count()
    if k >= n or k <= 0:
        return F.lit(k > 0)
    key, rest = nth_largest(scored, "key", k, bins)
    back = F.bitwise_not(F.coalesce("doc_id", F.lit((1 << 63) - 1)))  # falls as the id grows; null ids come last
    least, _ = nth_largest(scored.where(F.col("key") == F.lit(key)).select(back.alias("back")), "back", rest, bins)
    return (F.col("key") > F.lit(key)) | ((F.col("key") == F.lit(key)) & (back >= F.lit(least)))


def resample(scored: DataFrame, k: int, bins: int = 4096) -> DataFrame:
    """The rows of the k largest keys (ties: the smaller doc_id); an empty table gives no rows, a large k all."""
    return scored.where(among_top(scored, k, bins))


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, buckets: int = BUCKETS, most: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_grams, log_weight, key, kept) of every row: kept are the rows of resample(), the k largest keys.

    ``k`` None: the number of good documents to expect. ``labels`` has doc_id and quality (1 good); null labels say
    nothing, of two the lower counts. Null and empty texts weigh 0, as much as what the model knows nothing of. Without
    labels of both kinds all are kept. Rows that repeat a doc_id share its noise. An empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    rows = id_text(docs, id_col, text_col)
    ratio, chance = fit(rows, labels, buckets, most)
    scored = materialize(log_weights(rows, ratio))
    return scored.withColumn("kept", among_top(scored, expected_good(scored, chance) if k is None else k))


def keep_good(docs: DataFrame, labels: DataFrame, k: int | None = None, buckets: int = BUCKETS, most: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, that classify() keeps. Texts are not shuffled: they
    are weighed again where they lie and compared with the k-th key. Null and empty texts, long ones (weighed whole), ties (the smaller
    doc_id), null ids, missing labels: as classify(). Rows that repeat share their key and stay or go together, unless
    the k-th place lies between equal ids. No rows give no rows."""
    rows = id_text(docs, id_col, text_col)
    ratio, chance = fit(rows, labels, buckets, most)
    scored = materialize(log_weights(rows, ratio).select("doc_id", "log_weight", "key"))
    top = among_top(scored, expected_good(scored, chance) if k is None else k)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.arrow_udf("double")
    def key_of(ids: pa.Array, texts: pa.Array) -> pa.Array:
        got, at = [pa.array([], pa.float64())], 0
        for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), 4_000_000):
            got.append(pa.array(scores(ids.slice(at, part.num_rows).to_pylist(), part.column(0).to_pylist(), shared.value)[2]))
            at += part.num_rows
        return pa.concat_arrays(got)

    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    again = docs.select(own, F.col(id_col).cast("long").alias("doc_id"), key_of(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"))
    return again.where(top).select(*[F.col("row")[c].alias(c) for c in docs.columns])
