"""Document fingerprints by a randomised edit embedding.

All texts take the same random walks: at step j the character under the cursor is emitted, and a random bit that depends
on j and the character alone decides whether the cursor moves on. Texts a few edits apart fall into step again after an
edit, so edit distance becomes Hamming distance between the emitted strings. A fingerprint keeps the emitted characters
at every 2^level-th step, four bits each; the level grows with the length, so a walk has 85 to 256 samples or so
(all steps of a short text), and the samples of a coarse level are among those of a fine one. Bands of a few samples each,
drawn from the whole walk, propose pairs; the likeness of the two fingerprints verifies them.

After an edit a walk may stay out of step for long: what comes before the edit always agrees, what comes after it agrees once
the walks have met again. So every text is walked twice, from its beginning and, reversed, from its end, and the likeness of two
fingerprints is that of the walk that agrees more: both rarely lose their way, and each keeps its own side of an edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, id_text, links_in_buckets, map_texts, materialize
from .wordhash import GOLDEN, mix

SAMPLES = 256
PERIOD = 8192
#: Likeness from which fingerprints link, and the share of pairs at this likeness that no band may find.
THRESHOLD, MISSED = 0.8, 0.005
_state: dict = {}


def coins() -> tuple[np.ndarray, np.ndarray]:
    """The walk's bits by (step, character) and the four bits that stand for each of 256 kinds of characters."""
    if "coins" not in _state:
        steps = mix(np.arange(PERIOD * 4, dtype=np.uint64) * GOLDEN + np.uint64(11))
        bits = np.unpackbits(steps.view(np.uint8)).reshape(PERIOD, 256)
        _state["coins"] = np.ascontiguousarray(bits.astype(np.int32)), (mix(np.arange(257, dtype=np.uint64)) >> np.uint64(60)).astype(np.uint8)
    return _state["coins"]


def level_of(n: np.ndarray) -> np.ndarray:
    """The least level at which 3 n steps give fewer than SAMPLES samples."""
    return np.maximum(0, np.floor(np.log2(np.maximum(3 * n, 1) / SAMPLES)).astype(np.int64) + 1) * (3 * n >= SAMPLES)


#: A fingerprint: the level, the samples of the walk from the beginning, those of the walk from the end.
Print = tuple[int, np.ndarray, np.ndarray]


def embed(texts: list[str]) -> list[Print]:
    """The prints of some texts. Both directions are steps of one walk: a step costs the same few calls for all that walk."""
    both = walk([*texts, *(t[::-1] for t in texts)])
    return [(level, a, b) for (level, a), (_, b) in zip(both[: len(texts)], both[len(texts) :], strict=True)]


def walk(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """(level, samples) of each text. All texts walk at once, the longest first; those that are done drop out."""
    bits, nibble = coins()
    codes = []
    for t in texts:
        cp = np.frombuffer(t.encode("utf-32-le"), "<u4")
        codes.append(((cp ^ (cp >> 8)) & 255).astype(np.uint8))
    size = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-size, kind="stable")
    n = size[order]
    x = np.concatenate([codes[i] for i in order] + [np.zeros(64, np.uint8)])
    begin = np.cumsum(n) - n
    level = level_of(n)
    slots = (3 * n >> level) + 1
    out_at = np.cumsum(slots) - slots
    out = np.zeros(int(slots.sum()), np.uint8)
    made = np.zeros(len(n), np.int64)
    # order is by falling length, so by falling level: the texts that a step samples are a tail of the live ones
    tail = {v: int(np.searchsorted(-level, -v)) for v in range(int(level.max(initial=0)) + 1)}
    pos, end = begin.copy(), begin + n
    live = np.arange(int((n > 0).sum()))
    j = 0
    while len(live):
        p, e, most = pos[live], end[live], 3 * n[live]
        c = np.empty(len(p), np.uint8)
        move = np.empty(len(p), np.int32)
        for step in range(j, j + 64):
            x.take(p, out=c, mode="clip")
            ctz = (step & -step).bit_length() - 1 if step else 64
            first = tail.get(min(ctz, len(tail) - 1), 0)
            k = int(np.searchsorted(live, first)) if first else 0
            if k < len(live):
                here = np.flatnonzero((p[k:] < e[k:]) & (step < most[k:])) + k
                if len(here):
                    who = live[here]
                    out[out_at[who] + (step >> level[who])] = nibble[c[here]]
                    made[who] = (step >> level[who]) + 1
            bits[step % PERIOD].take(c, out=move, mode="clip")
            p += move
        j += 64
        pos[live] = p
        # the walk may run to three times the length
        live = live[(p < e) & (j < most)]
    got: list = [None] * len(texts)
    for k, i in enumerate(order):
        got[i] = (int(level[k]), out[out_at[k] : out_at[k] + made[k]])
    return got


def written(print_: Print) -> str:
    """level:samples:samples, one hexadecimal digit a sample."""
    level, *walks = print_
    return ":".join([str(level), *("".join("0123456789abcdef"[v] for v in w.tolist()) for w in walks)])


def read(fingerprint: str) -> Print:
    level, *walks = fingerprint.split(":")
    raw = [np.frombuffer(w.encode(), np.uint8) for w in walks]
    a, b = (np.where(r < 97, r - 48, r - 87) for r in raw)
    return int(level), a, b


def walks_alike(top: int, a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Share of a walk's samples that agree at level ``top``, less what chance gives (one in 16)."""
    x, y = a[1][:: 1 << (top - a[0])], b[1][:: 1 << (top - b[0])]
    m, n = min(len(x), len(y)), max(len(x), len(y))
    if n == 0:
        return 1.0
    return max(0.0, (float((x[:m] == y[:m]).sum()) / n - 1 / 16) * 16 / 15)


def likeness(a: Print, b: Print) -> float:
    """That of the walk that agrees more, at the coarser level of the two; empty texts are alike."""
    top = max(a[0], b[0])
    return max(walks_alike(top, (a[0], a[k]), (b[0], b[k])) for k in (1, 2))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; equal texts have equal fingerprints; null and empty texts "0::"."""

    def run(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], "n_chars": [len(t) for t in cols["text"]], "fingerprint": [written(f) for f in embed(cols["text"])]}

    return map_texts(id_text(docs, id_col, text_col), run, "doc_id long, n_chars long, fingerprint string", 12_000_000)


def banding(prints: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bands, samples a band) for so many fingerprints. Samples of unlike texts agree about one time in eight, so a sample
    more for each factor of eight keeps the number of unlike pairs that a text meets the same at every size of the table;
    bands are then as many as pairs at the threshold need."""
    bits = max(6, round(np.log2(max(prints, 1)) / 3) + 2)
    agree = threshold * 15 / 16 + 1 / 16
    return int(np.ceil(np.log(MISSED) / np.log(1 - agree**bits))), bits


def band_picks(size: int, bands: int, bits: int) -> np.ndarray:
    """Places (band, sample) for a fingerprint of ``size`` samples. Each band has all places in a random order, and takes the
    first ``bits`` that the fingerprint has: bands draw from the whole of it, and fingerprints of about the same size take
    the same places."""
    key = (size, bands, bits)
    if key not in _state:
        draw = mix(np.arange(bands * SAMPLES, dtype=np.uint64) * GOLDEN + np.uint64(5)).reshape(bands, SAMPLES)
        order = np.argsort(draw, axis=1)
        _state[key] = np.stack([o[o < size][:bits] for o in order])
    return _state[key]


def band_keys(prints: list[Print], bands: int, bits: int, threshold: float = THRESHOLD) -> list[np.ndarray]:
    """Keys of the bit-sampled bands of both walks of fingerprints."""
    each = [walk_keys([(p[0], p[k]) for p in prints], k, bands, bits, threshold) for k in (1, 2)]
    return [np.concatenate(k) for k in zip(*each, strict=True)]


def walk_keys(prints: list[tuple[int, np.ndarray]], which: int, bands: int, bits: int, threshold: float) -> list[np.ndarray]:
    """Keys of the bands of one walk at its own level. Those near the upper end of their level have keys of
    the next level too, so that they meet texts of that level whose size they may be alike to."""
    same: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for i, (level, s) in enumerate(prints):
        # a walk of the next level has 2/3 of SAMPLES / 2 samples at least, and walks that link differ in size by the threshold at
        # most; half the steps move on, so a walk is by three deviations of its length shorter than that almost never
        steps = max(1, len(s)) << level
        near = len(s) >= (threshold * 15 + 1) / 16 * 2 / 3 * SAMPLES * (1 - 3 / steps**0.5)
        for up in (0, 1) if near else (0,):
            part = s[:: 1 << up]
            same.setdefault((level + up, len(part)), []).append((i, part))
    out: list[list[np.ndarray]] = [[] for _ in prints]
    for (level, size), members in same.items():
        got = np.stack([m[1] for m in members])[:, band_picks(size, bands, bits)].astype(np.uint64)
        h = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) * GOLDEN + np.uint64((level * 64 + got.shape[2]) * 4 + which)), got.shape[:2]).copy()
        for c in range(got.shape[2]):
            h = mix(h * GOLDEN + got[:, :, c])
        for (i, _), keys in zip(members, h.view(np.int64), strict=True):
            out[i].append(keys)
    return [np.concatenate(k) for k in out]


def all_alike(prints: list[Print], threshold: float) -> np.ndarray:
    """Which of some fingerprints are alike by either walk, all against all."""
    return np.logical_or(*[walks_all_alike([(p[0], p[k]) for p in prints], threshold) for k in (1, 2)])


def walks_all_alike(prints: list[tuple[int, np.ndarray]], threshold: float) -> np.ndarray:
    """Which of some walks are alike, all against all, level by level."""
    levels = np.array([p[0] for p in prints])
    hit = np.zeros((len(prints), len(prints)), bool)
    for top in np.unique(levels):
        own, upto = np.flatnonzero(levels == top), np.flatnonzero(levels <= top)
        parts = [prints[i][1][:: 1 << int(top - levels[i])] for i in upto]
        size = np.array([len(p) for p in parts])
        wide = np.full((len(upto), int(size.max(initial=1))), 255, np.uint8)
        for k, p in enumerate(parts):
            wide[k, : len(p)] = p
        at = np.searchsorted(upto, own)
        for i, k in zip(own, at, strict=True):
            agree = ((wide == wide[k]) & (wide != 255)).sum(axis=1)
            alike = (agree / np.maximum(np.maximum(size, size[k]), 1) - 1 / 16) * 16 / 15 >= threshold
            hit[i, upto] = alike
            hit[upto, i] |= alike
    return hit


def print_classes(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(fingerprint, class_id) of every distinct fingerprint but those of empty texts: bands propose, likeness of
    ``threshold`` or more links; class_id is the smallest doc_id of the class."""
    rows = prints.select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint").where("length(fingerprint) > 3")
    # distinct fingerprints are the nodes: the first doc_id stands for each; null ids come last
    reps = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")).where("rep is not null"))

    bands, bits = banding(reps.count(), threshold)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = band_keys([read(f) for f in b.column("fingerprint").to_pylist()], bands, bits, threshold)
            yield pa.RecordBatch.from_pydict({"id": b.column("rep"), "buckets": pa.array(made, pa.list_(pa.int64()))})

    buckets = reps.mapInArrow(keys, "id long, buckets array<long>").select("id", F.explode("buckets").alias("bucket"))

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(read(p), read(q)) >= threshold for p, q in zip(x, y, strict=True)])

    def hits(table: pa.Table) -> np.ndarray:
        return all_alike([read(f) for f in table.column("items").to_pylist()], threshold)

    # unlike texts under one doc_id have several fingerprints: each is a node of its own, known by its hash
    items = reps.select(F.col("rep").alias("id"), F.col("fingerprint").alias("items")).groupBy("id").agg(F.min("items").alias("items"))
    links = links_in_buckets(buckets, lambda ids: items.join(ids, items["id"] == ids["doc_id"], "left_semi"), alike("x", "y"), hits, 128)
    classes = components(links)
    drop(links)
    return reps.join(classes, reps["rep"] == classes["node"], "left").select("fingerprint", F.coalesce("component", "rep").alias("class_id"))


def near_duplicates(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``prints`` (doc_id, fingerprint and any other columns) with class_id: links are pairs of fingerprints
    whose likeness is ``threshold`` or more, found in the bands they share; class_id is the smallest doc_id that links reach.

    Unrelated texts stay below about 0.25; of texts with 1, 3 and 10 random edits (300 to 8,000 characters) 0.99, 0.99 and 0.91 keep
    0.8 or more. The links are those of the fingerprints, not of exact edit distances. Texts of any length
    count whole. Equal fingerprints meet first, in a groupBy. Null fingerprints and those of empty texts are classes of
    their own, as are rows with a null doc_id unless a row with an id has the same fingerprint. Rows that repeat all come
    out; where one doc_id has unlike texts, the class of its least fingerprint is that of all of them. No rows give no rows.
    """
    of_print = print_classes(prints, threshold).withColumnRenamed("fingerprint", "its_print").withColumnRenamed("class_id", "its_class")
    joined = prints.join(of_print, F.col("fingerprint") == F.col("its_print"), "left")
    return joined.withColumn("class_id", F.coalesce("its_class", F.col("doc_id").cast("long"))).drop("its_print", "its_class")


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the text gives way to the first as many characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is made with the next document in descending doc_id; rows with equal ids follow by a hash of their
    texts, null ids come last; the first document follows the last, and a table of one row follows itself. Null texts are
    empty; other columns of ``docs`` are not read. No rows give no rows.

    One range shuffle of the texts puts them in order, however many rows share an id. Each range leaves its last document
    open and hands on its first text; both are written, and the few open documents, one a range, get theirs in a join.
    """
    rows = id_text(docs, id_col, text_col)
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.desc_nulls_last("doc_id"), F.asc("tie"), F.asc("row")]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = docs.sparkSession.createDataFrame([], schema + ", part int, head string, text string").schema
    plain = out.names[:7]

    def finish(held: list[tuple[int, str, str]]) -> pa.RecordBatch:
        """Rows (doc_id, text, next text); a next text that is the following row's own is embedded once."""
        from pyspark.sql.pandas.types import to_arrow_schema

        texts, new = [h[1] for h in held], [edited(h[1], h[2]) for h in held]
        shared = [k + 1 < len(held) and held[k][2] is texts[k + 1] for k in range(len(held))]
        prints = embed(texts + new + [h[2] for h, s in zip(held, shared, strict=True) if not s])
        own, other, rest = prints[: len(held)], prints[len(held) : 2 * len(held)], iter(prints[2 * len(held) :])
        after = [own[k + 1] if s else next(rest) for k, s in enumerate(shared)]
        none = [None] * len(held)
        cols = {
            "doc_id": [h[0] for h in held],
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
            "fingerprint": [written(f) for f in own],
            "edited_fingerprint": [written(f) for f in other],
            "near_edited": [likeness(a, b) for a, b in zip(own, other, strict=True)],
            "near_next": [likeness(a, b) for a, b in zip(own, after, strict=True)],
        }
        return pa.RecordBatch.from_pydict(cols | {"part": none, "head": none, "text": none}, schema=to_arrow_schema(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple[int, str, str]] = []
        size, head, waits = 0, None, None  # waits: the row whose next one is not known yet
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if waits is None:
                    head = text
                else:
                    held.append((waits[0], waits[1], text))
                    size += len(waits[1])
                waits = (doc, text)
                if size > 6_000_000:
                    yield finish(held)
                    held, size = [], 0
        if held:
            yield finish(held)
        if waits is not None:
            edge = dict.fromkeys(plain) | {"doc_id": waits[0], "part": TaskContext.get().partitionId(), "head": head, "text": waits[1]}
            yield pa.RecordBatch.from_pylist([edge], schema=finish([]).schema)

    made = materialize(sorted_.mapInArrow(run, out))
    edges = made.where("part is not null").select("part", "head", "doc_id", "text")
    parts = sorted(r["part"] for r in edges.select("part").collect())  # whole numbers, one a range
    after = {p: parts[(k + 1) % len(parts)] for k, p in enumerate(parts)}
    pairs = docs.sparkSession.createDataFrame(list(after.items()), "part int, later int")
    met = edges.drop("head").join(pairs, "part").join(edges.select(F.col("part").alias("later"), "head"), "later")

    def close(cols: dict) -> dict:
        got = finish(list(zip(cols["doc_id"], cols["text"], cols["head"], strict=True)))
        return {n: got.column(n).to_pylist() for n in plain}

    return made.where("part is null").select(*plain).unionByName(map_texts(met.select("doc_id", "text", "head"), close, schema))


def likeness_and_classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """edit_likeness() with the class of each row's fingerprint (near_duplicates())."""
    return near_duplicates(edit_likeness(docs, id_col, text_col), threshold)
