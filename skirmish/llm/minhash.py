"""Near-duplicates by BagMinHash signatures, bands and an exact check of multiset overlap.

A document is a bag of five-word shingles. The weights of a shingle, whole numbers, are cut into the intervals [0,1),
[1,2), [2,4), [4,8) ...; each interval has Poisson processes shared by all documents, and a document sees of an interval's
points those below its weight. A register keeps its first point, so two documents agree in a register with the
probability of their weighted Jaccard similarity. Points come in order of time, so few points of each shingle are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, id_text, links_in_buckets, map_texts, materialize
from .wordhash import GOLDEN, Words, digest, grams, mix

WIDTH = 5
BANDS, ROWS = 25, 5
SIMILARITY = 0.8
#: Members of a bucket that meet in one task: two blocks at most, so a task stays small and its matrices too.
BLOCK = 256


def shingles(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle; a text with fewer words has one, of all its words, and a text without words none."""
    h = words.hashes()
    whole = words.left() >= width
    g = grams(h, width)
    doc, out = words.doc[: len(g)][whole[: len(g)]], g[whole[: len(g)]]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.array([grams(np.append(h[words.first[d] : words.first[d + 1]], np.uint64(7)), count[d] + 1)[0] for d in short], np.uint64)
        doc, out = np.append(doc, short), np.append(out, extra)
    return doc, out


def bags(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in order, with their numbers."""
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """BagMinHash: for each text m arrival times, each the first of the Poisson points that its bag sees (inf: no words)."""
    # an item for each interval of weights that a shingle reaches: [0,1), then [2^j, 2^(j+1))
    d, s, rate, low, top = [doc], [mix(h + GOLDEN)], [np.ones(len(h))], [np.zeros(len(h))], [weight.astype(float)]
    j = 0
    while len(live := np.flatnonzero(weight > (1 << j))):
        d.append(doc[live])
        s.append(mix(h[live] + mix(np.array([j + 2], np.uint64))))
        rate.append(np.full(len(live), float(1 << j)))
        low.append(np.full(len(live), float(1 << j)))
        top.append(weight[live].astype(float))
        j += 1
    d, s, rate, low, top = (np.concatenate(x) for x in (d, s, rate, low, top))
    part = low + rate > top  # only a part of the interval lies below the weight: its points are thinned
    sig = np.full(texts * m, np.inf)
    total = np.bincount(doc, weight, texts)
    full = total > 0
    limit = np.where(full, (np.log(m) + 3) / np.maximum(total, 1), -1.0)
    time = np.zeros(len(d))
    step = lambda i: -np.log1p(-((mix(s[i]) >> np.uint64(12)).astype(float) * 2.0**-52)) / (rate[i] * m)
    time[:] = step(slice(None))
    rest = np.arange(len(d))
    while len(rest):
        act = rest[time[rest] <= limit[d[rest]]]
        while len(act):
            z = mix(s[act] ^ np.uint64(0xD6E8FEB86659FD93))
            at = d[act] * m + ((z & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
            seen = time[act]
            if (thin := part[act]).any():
                level = low[act] + rate[act] * ((z >> np.uint64(24)).astype(float) * 2.0**-40)
                keep = ~thin | (np.floor(level) < top[act])
                np.minimum.at(sig, at[keep], seen[keep])
            else:
                np.minimum.at(sig, at, seen)
            s[act] += GOLDEN
            time[act] += step(act)
            act = act[time[act] <= limit[d[act]]]
        # a text with an empty register, or one filled too late, looks further
        worst = sig.reshape(texts, m).max(axis=1)
        more = full & (worst > limit)
        if not more.any():
            break
        limit[more] *= 2
        rest = np.flatnonzero(more[d])
    return sig.reshape(texts, m)


def banded(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each text and band."""
    bits = mix(np.ascontiguousarray(sig).view(np.uint64)).reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN), (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key * GOLDEN + bits[:, :, r])
    return key.view(np.int64)


def bag_signatures(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, bands): key stands for the normalised words of a text, null without words; so do its band keys."""

    def run(cols: dict) -> dict:
        words = Words(cols["text"], lower=True)
        doc, h, weight = bags(*shingles(words, width))
        keys = banded(signatures(doc, h, weight, words.texts, bands * rows), bands, rows)
        count = np.diff(words.first)
        wh = words.hashes().tobytes()
        return {
            "doc_id": cols["doc_id"],
            "key": [digest(wh[8 * a : 8 * b]) if b > a else None for a, b in zip(words.first[:-1], words.first[1:], strict=True)],
            "bands": [k if n else None for k, n in zip(keys.tolist(), count, strict=True)],
        }

    return map_texts(docs, run, "doc_id long, key binary, bands array<long>")


def item_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, items): the bag as a set, the k-th copy of a shingle an item of its own; set overlap is multiset overlap."""

    def run(cols: dict) -> dict:
        words = Words(cols["text"], lower=True)
        doc, h, weight = bags(*shingles(words, width))
        again = np.repeat(np.arange(len(h)), weight)
        nth = np.arange(len(again)) - np.repeat(np.cumsum(weight) - weight, weight)
        items = mix(h[again] + nth.astype(np.uint64) * GOLDEN).view(np.int64)
        ends = np.searchsorted(doc[again], np.arange(words.texts + 1))
        return {"doc_id": cols["doc_id"], "items": [items[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]}

    return map_texts(docs, run, "doc_id long, items array<long>")


def bag_items(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, items) of the documents with those ids."""
    return item_sets(docs.join(ids, "doc_id"), width).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "id")


def overlaps(table: pa.Table, similarity: float, width: int = 4096) -> np.ndarray:
    """Which rows of a group overlap enough, by products of their incidence matrices over the items that rows share."""
    column = table.column("items").combine_chunks()
    sizes = np.array(column.value_lengths()).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, at, count = np.unique(np.array(column.flatten()), return_inverse=True, return_counts=True)
    shared = np.full(len(count), -1)
    shared[count > 1] = np.arange(int((count > 1).sum()))
    at = shared[at]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    common = np.zeros((len(sizes), len(sizes)))
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, (start, start + width))
        has = np.zeros((len(sizes), width), np.float32)
        has[row[a:b], at[a:b] - start] = 1
        common += has @ has.T
    return common / np.maximum(sizes[:, None] + sizes[None, :] - common, 1) >= similarity


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, kept): classes of documents joined by links of weighted Jaccard ``similarity`` or more.

    Words are runs of letters and digits in lower case. Texts with the same words meet first, in a groupBy; the smallest
    doc_id stands for them. class_id is the smallest doc_id of the class; kept holds where it is the document's own.
    Documents without words (null and empty texts among them) are classes of their own; short texts are one shingle;
    texts of any length are read whole; rows that repeat a doc_id count as one document, and all come out; rows with a null
    doc_id take no part (class_id null, kept); other columns of ``docs`` are not read; an empty table gives no rows.
    """
    rows_ = id_text(docs, id_col, text_col)
    made = materialize(bag_signatures(rows_, width, bands, rows).withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("key"))))
    reps = materialize(made.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep")))
    alone = made.join(reps.select(F.col("rep").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi")
    buckets = alone.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    n = F.size(F.array_intersect("x", "y"))
    links = links_in_buckets(buckets, lambda ids: bag_items(rows_, ids, width), n / (F.size("x") + F.size("y") - n) >= similarity, lambda t: overlaps(t, similarity), BLOCK)
    classes = components(links)
    drop(links)
    of_key = reps.join(classes, reps["rep"] == classes["node"], "left").select("key", F.coalesce("component", "rep").alias("class"))
    out = made.select("doc_id", "key").join(of_key, "key", "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
