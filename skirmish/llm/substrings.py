"""Substring dedup by seed and extend.

Seeds are winnowed anchors: among the places of each window of words, the anchor is the least hash of its short runs, so
equal windows have equal anchors at equal places. An anchor that only one document has cannot lie in a repeat and is
dropped before anything is compared. Documents join on the anchors they share, and from an anchor the match is extended
both ways, as far as the windows reach that chose it: first as a whole, so that a passage that thousands share is settled
by one comparison for each place in it; where the surroundings differ, as at the ends of a passage, window by window. What
results are intervals; those that touch join to maximal repeats of at least the window's length.

Words are compared by hashes: 64 bits a word, 64 bits a run of them. Two windows are only ever compared under one anchor, so they
are taken for equal wrongly with a chance of 2^-64 for each pair of unlike windows that share 20 words: for 10^12 such
pairs 5e-8 in all. Whole copies are told by 128 bits.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, drop, id_text, map_texts, marked, materialize
from .wordhash import Words, digest, grams

WINDOW = 50
SEED = 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def least_place(h: np.ndarray, width: int) -> np.ndarray:
    """For each place the place of the least of ``width`` values from it on; the rightmost of equals."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(h)), 1

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(h[b] <= h[a], b, a)

    while span * 2 <= width:
        at = least(at[:-span], at[span:])
        span *= 2
    return least(at[:n], at[width - span : width - span + n])


def tied(docs: DataFrame) -> DataFrame:
    """``docs`` with a hash of the text: rows that share a doc_id but not a text are told apart by it."""
    return docs.withColumn("tie", F.xxhash64("text"))


def anchors(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(doc_id, tie, key, anchors): the distinct anchors of each text and a digest of its words."""

    def run(cols: dict) -> dict:
        words = Words(cols["text"], lower=False)
        raw = words.hashes().tobytes()
        g = grams(words.hashes(), seed, 0xC2B2AE3D27D4EB4F)
        starts = np.flatnonzero(words.left() >= window)
        anchor = g[least_place(g, window - seed + 1)[starts]].view(np.int64) if len(starts) else np.zeros(0, np.int64)
        ends = np.searchsorted(starts, words.first)
        return {
            "doc_id": cols["doc_id"],
            "tie": cols["tie"],
            "key": [digest(raw[8 * a : 8 * b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)],
            "anchors": [np.unique(anchor[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)],
        }

    return map_texts(docs, run, "doc_id long, tie long, key binary, anchors array<long>")


def extents(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(doc_id, tie, anchor, first, n, whole, windows): a row for each place of an anchor among the row's ``anchors``. The windows
    from place ``first`` on, ``n`` of them, chose it; ``whole`` stands for all words that they span and the anchor's place
    among them, ``windows`` for each window."""

    def run(cols: dict) -> dict:
        words = Words(cols["text"], lower=False)
        h = words.hashes()
        g = grams(h, seed, 0xC2B2AE3D27D4EB4F)
        starts = np.flatnonzero(words.left() >= window)
        at = least_place(g, window - seed + 1)[starts] if len(starts) else starts
        own = grams(h, window, 0xD6E8FEB86659FD93)
        # windows that follow each other in a text and chose the same place
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)))) if len(starts) else starts
        count = np.diff(np.append(new, len(starts)))
        doc = words.doc[starts[new]] if len(new) else new
        anchor = g[at[new]].view(np.int64) if len(new) else np.zeros(0, np.int64)
        ends = np.searchsorted(doc, np.arange(words.texts + 1))
        out: dict[str, list] = {k: [] for k in ("doc_id", "tie", "anchor", "first", "n", "whole", "windows")}
        for d, wanted in enumerate(cols["anchors"]):
            for i in ends[d] + np.flatnonzero(np.isin(anchor[ends[d] : ends[d + 1]], np.array(wanted, np.int64))):
                a, n = int(starts[new[i]]), int(count[i])
                mine = own[a : a + n]
                # the first and the last window say all words between them unless they part by more than a window
                ends_ = mine[[*range(0, n, window), n - 1]].tobytes()
                out["doc_id"].append(cols["doc_id"][d])
                out["tie"].append(cols["tie"][d])
                out["anchor"].append(int(anchor[i]))
                out["first"].append(a - int(words.first[d]))
                out["n"].append(n)
                out["whole"].append(int.from_bytes(digest(ends_ + bytes([n % 256, n // 256, int(at[new[i]]) - a]))[:8], "little", signed=True))
                out["windows"].append(mine.view(np.int64))
        return out

    return map_texts(docs, run, "doc_id long, tie long, anchor long, first int, n int, whole long, windows array<long>", 2_000_000)


def extended(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, tie, start, end): words of each document that stand in a smaller one too, as far as windows around one anchor
    reach. Equal surroundings are settled whole: their smallest document has them first. Where one anchor has unlike
    surroundings, only those first documents are left to compare, window by window."""
    least = found.groupBy("anchor", "whole").agg(F.min("doc_id").alias("lo"))
    judged_ = found.drop("windows").join(apart(least, "anchor", "whole"), ["anchor", "whole"])
    wide = judged_.where("doc_id > lo").select("doc_id", "tie", F.col("first").alias("start"), (F.col("first") + F.col("n") + window - 1).alias("end"))
    several = least.groupBy("anchor").agg(F.min("whole").alias("a"), F.max("whole").alias("b"), F.min("lo").alias("x"), F.max("lo").alias("y")).where("a < b and x < y").select("anchor")
    open_ = least.join(apart(several, "anchor"), "anchor").select("anchor", "whole", F.col("lo").alias("doc_id"))
    each = found.join(open_, ["anchor", "whole", "doc_id"]).select("doc_id", "tie", "anchor", "first", F.posexplode("windows").alias("i", "window"))
    each = materialize(each.select("doc_id", "tie", "anchor", "window", (F.col("first") + F.col("i")).alias("place")))
    first = each.groupBy("anchor", "window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    narrow = each.join(apart(first.drop("hi"), "anchor", "window"), ["anchor", "window"]).where("doc_id > lo").select("doc_id", "tie", F.col("place").alias("start"), (F.col("place") + window).alias("end"))
    return wide.unionByName(narrow)


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, tie, first, starts, ends) for rows of tied(): for a document whose words all stand in a smaller one, ``first``
    is that doc_id; else intervals of words that smaller documents have too. Documents without either lack. One row for
    each doc_id and text."""
    own = ["doc_id", "tie"]
    made = materialize(anchors(docs, window, seed))
    firsts = materialize(made.groupBy("key").agg(F.min("doc_id").alias("first")))
    copies = materialize(made.select(*own, "key").join(firsts, "key").where("doc_id > first").select(*own, "first").distinct())
    # copies repeat what their first document has: they go as wholes and ask for nothing
    rest = made.select(*own, "anchors").join(copies.select(*own), own, "left_anti")
    each = rest.select(*own, F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    wanted = materialize(each.join(apart(shared, "anchor"), "anchor").groupBy(*own).agg(F.collect_set("anchor").alias("anchors")))
    asked = marked(docs, wanted, "doc_id").where("maybe").drop("maybe")
    found = materialize(extents(asked.join(wanted, own), window, seed))
    drop(made, firsts, wanted)
    spans = extended(found, window).groupBy(*own).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("at"))
    spans = spans.select(*own, F.lit(None).cast("long").alias("first"), F.col("at.start").alias("starts"), F.col("at.end").alias("ends"))
    whole = copies.withColumns({k: F.lit(None).cast("array<int>") for k in ("starts", "ends")})
    out = materialize(whole.unionByName(spans))
    drop(found, copies)
    return out


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n words lie in an interval."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(starts, n), 1)
    np.add.at(step, np.minimum(ends, n), -1)
    return np.cumsum(step[:n]) > 0


def judged(text: str, first: int | None, starts: list[int] | None, ends: list[int] | None, window: int) -> tuple[list[str], np.ndarray]:
    """(words, which of them go) of a text, given what repeats() found for it."""
    words = _WORD.findall(text)
    if first is not None:
        return words, np.full(len(words), len(words) >= window)
    if not starts:
        return words, np.zeros(len(words), bool)
    return words, covered(len(words), np.array(starts), np.array(ends))


def kept(words: list[str], gone: np.ndarray) -> str:
    return " ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x)


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text) of every row; a word goes if a window of ``window`` words over it
    starts in a document with a smaller doc_id too.

    spans are the maximal runs of removed words (first word, end). Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; kept
    ones are joined by single spaces. Null and empty texts have no words; texts shorter than the window lose none, longer
    ones are read whole; rows with the same doc_id do not count as smaller than each other; rows with a null doc_id neither
    lose words nor cost others any; other columns of ``docs`` are not read; an empty table gives no rows.
    """
    rows = tied(id_text(docs, id_col, text_col))
    joined = rows.join(repeats(rows, window, seed), ["doc_id", "tie"], "left").select("doc_id", "text", "first", "starts", "ends")

    def run(cols: dict) -> dict:
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_words": [], "n_removed": [], "spans": [], "kept_text": []}
        for text, first, starts, ends in zip(cols["text"], cols["first"], cols["starts"], cols["ends"], strict=True):
            words, gone = judged(text, first, starts, ends, window)
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            out["spans"].append([{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2], strict=True)])
            out["kept_text"].append(kept(words, gone))
        return out

    return map_texts(joined, run, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, whatever their names, repeated words taken out of ``text_col``; texts that lose no word, and
    null ones, stay as they are. Ids, short, empty and repeated rows: as substring_dedup(). No rows give no rows."""
    found = repeats(tied(id_text(docs, id_col, text_col)), window, seed).select("doc_id", "tie", F.struct("first", "starts", "ends").alias("found"))
    text = F.col(f"`{text_col}`")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("tie"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2).to_pylist()
            for k, (text, hit) in enumerate(zip(texts, batch.column(3).to_pylist(), strict=True)):
                if text is not None and hit is not None:
                    words, gone = judged(text, hit["first"], hit["starts"], hit["ends"], window)
                    if gone.any():
                        texts[k] = kept(words, gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, batch.column(2).type)], names=["row", "text"])

    # only texts that may lose words go to what was found for them, and through Python
    near = marked(own, found, "doc_id")
    hit = near.where("maybe").join(found, ["doc_id", "tie"], "left").select("row", "doc_id", "text", "found")
    made = hit.mapInArrow(run, hit.select("row", "text").schema).unionByName(near.where("not maybe").select("row", "text"))
    return made.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
