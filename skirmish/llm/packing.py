"""Best-fit packing of token sequences by swap-based local search.

Pieces are dealt to groups by a hash, so every group is a fair sample of the lengths; a group is packed best-fit
decreasing and then improved: documents move, or are exchanged one for one and two for one, between underfull bins so
that the sum of squared fills grows until bins run empty. A group has a bounded number of pieces whatever the input.
"""

from __future__ import annotations

import bisect
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_texts, materialize

CAPACITY = 1024
GROUP = 8_192
_state: dict = {}


def byte_bpe(path: str):
    """token ids of a text by the byte-level BPE of a tokenizers file, special strings inside texts as its default.

    tiktoken runs the same merges (ids are ranks) about five times faster; texts with very long runs go to tokenizers.
    """
    got = _state.get(path)
    if got is None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        spec = json.loads(slow.to_str())
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # the printable stand-ins of bytes in byte-level vocabularies
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        stand = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(stand[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        long_run = re.compile(r"\S{5000}|\s{5000}")

        def encode(text: str) -> np.ndarray:
            if len(text) > 5000 and long_run.search(text):
                return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
            return fast.encode_to_numpy(text, allowed_special="all").astype("<u4")

        _state[path] = got = encode
    return got


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first holds what is left over, all others are full."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; ``end_id`` closes each document, also an empty one."""

    def run(cols: dict) -> dict:
        encode = byte_bpe(tokenizer)
        out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for doc, text in zip(cols["doc_id"], cols["text"], strict=True):
            ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
            for i, (start, n) in enumerate(cut(len(ids), capacity)):
                for name, x in zip(out, (doc, i, start, n, zlib.crc32(ids[start : start + n].tobytes())), strict=True):
                    out[name].append(x)
        return out

    return map_texts(id_text(docs, id_col, text_col), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of indices. Free space is looked up in lists by amount, so a step costs a bisection."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # amounts of free space that some bin has, ascending
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        k = bisect.bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        if left := room - n:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def exchange(into: list[int], out_of: list[int], room: int) -> tuple[int, tuple, tuple]:
    """The move, one-for-one or two-for-one exchange that adds most to the fuller bin within its room: (gain, lengths that
    go in, lengths that come back). Both bins are lists of lengths with each at most twice, which is as often as an exchange
    can take it, so a bin of 1024 tokens has 88 entries at most, and all pairs of them are tried."""
    best, step = 0, ((), ())
    gives = {n: (n,) for n in out_of}
    for k, x in enumerate(out_of):
        for y in out_of[k + 1 :]:
            gives.setdefault(x + y, (x, y))
    backs = {0: ()} | {n: (n,) for n in into}
    for got, give in gives.items():
        for lost, back in backs.items():
            if best < got - lost <= room:
                best, step = got - lost, (give, back)
                if best == room:
                    return best, *step
    return best, *step


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, seed: int, effort: int = 150) -> list[list[int]]:
    """Moves and exchanges between underfull bins while the sum of squared fills grows; bins that run empty go.

    A step takes a random underfull bin and one of the emptiest, and fills the fuller of the two as far as one move, one
    exchange of one for one or of two for one can. Every step taken raises the squared fill, so the search ends; it ends
    early when the underfull bins hold more than one bin less could. ``effort`` bounds the tries for each underfull bin: on the test
documents best fit comes out one bin over the lower bound, and sixteen times the effort finds no bin less.
    """
    rng = random.Random(seed)
    fill = [sum(lengths[i] for i in b) for b in bins]
    held: list[dict[int, list[int]]] = []  # by length the pieces of each bin
    for b in bins:
        own: dict[int, list[int]] = {}
        for i in b:
            own.setdefault(lengths[i], []).append(i)
        held.append(own)
    under = sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: fill[k])
    free = sum(capacity - fill[k] for k in under)
    tries = effort * len(under)

    def flat(own: dict[int, list[int]]) -> list[int]:
        return [n for n, who in own.items() for _ in who[:2]]

    def shift(n: int, a: int, b: int) -> None:
        """One piece of length n goes from bin a to bin b."""
        i = held[a][n].pop()
        if not held[a][n]:
            del held[a][n]
        held[b].setdefault(n, []).append(i)

    while tries > 0 and len(under) > 1 and free >= capacity:
        tries -= 1
        b = under[rng.randrange(min(3, len(under)))]
        a = under[rng.randrange(len(under))]
        if a == b:
            continue
        if fill[a] < fill[b]:
            a, b = b, a
        gain, give, back = exchange(flat(held[a]), flat(held[b]), capacity - fill[a])
        if not gain:
            continue
        for n in give:
            shift(n, b, a)
        for n in back:
            shift(n, a, b)
        fill[a] += gain
        fill[b] -= gain
        if fill[b] == 0:
            free -= capacity
        under = [k for k in under if 0 < fill[k] < capacity]
        under.sort(key=lambda k: fill[k])
    return [[i for who in own.values() for i in who] for own in held if own]


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces of ``length`` up to ``capacity``: gapless from 0 within a sequence.

    Full pieces are sequences of their own and are not shuffled; the others meet in groups of about ``group`` pieces, dealt
    by a hash of the piece and its row, so equal pieces spread too. Other columns come through. No rows give no rows.
    """
    pieces = materialize(pieces)
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "descending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        lengths, g = table.column("length").to_pylist(), table.column("g")[0].as_py()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity, seed=g)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                seq[i], off[i] = (g << 24) + k, at
                at += lengths[i]
        return table.drop_columns(["g"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    dealt = rest.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    packed = dealt.groupBy("g").applyInArrow(run, schema)
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": F.lit(1 << 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences: one row per piece (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null texts are empty (one end token), equal rows and null ids stay apart, texts of any length are cut and kept whole,
    other columns of ``docs`` are not read. No rows give no rows."""
    return pack(pieces(docs, tokenizer, capacity, id_col=id_col, text_col=text_col), capacity)
