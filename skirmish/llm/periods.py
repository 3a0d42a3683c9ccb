"""Runs of repeating words: for each period p the longest common extensions, forward and backward, of every two
neighbouring places of the grid 0, p, 2p, ...

A run of exponent two or more covers two neighbouring grid places of its period, and the two extensions from there give
its whole stretch. The number of grid places over all periods is harmonic, n ln n. Extensions come from a suffix array,
its common prefixes and range minima, backward ones from the same of the reversed array. Everything happens text by text
inside tasks: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import id_text, map_texts

#: Grid places whose extensions are asked for at once (more where the text itself is longer).
ASKED = 1 << 20


class Extensions:
    """Longest common extensions of two suffixes of ``x``, whole numbers in which every text ends with a number of its own."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        sa = np.argsort(x, kind="stable")
        head = np.concatenate(([True], x[sa][1:] != x[sa][:-1]))
        rank = np.empty(n, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        # levels[k] ranks the suffixes by their first 2^k numbers; only those that still share a rank are sorted again
        levels, h = [rank.astype(np.int32)], 1
        while True:
            tied = np.flatnonzero(~head | ~np.append(head[1:], True))
            if not len(tied):
                break
            at = sa[tied]
            key = rank[at] * n + rank[at + h]
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            head[tied] = np.concatenate(([True], key[1:] != key[:-1]))
            sa[tied] = at
            rank[at] = np.maximum.accumulate(np.where(head[tied], tied, 0))
            levels.append(rank.astype(np.int32))
            h *= 2
        i, j = sa[:-1].copy(), sa[1:].copy()
        common = np.zeros(n, np.int32)
        for k in range(len(levels) - 2, -1, -1):
            same = levels[k][i] == levels[k][j]
            i[same] += 1 << k
            j[same] += 1 << k
            common[1:] += same.astype(np.int32) << k
        self.rank, self.common = levels[-1], common

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The least common prefix between the ranks of each pair. Range minima are kept for one width at a time: 1, 2, 4, ..."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b).astype(np.int64) + 1, np.maximum(a, b).astype(np.int64)
        width = np.frexp(high - low + 1)[1] - 1
        order = np.argsort(width, kind="stable")
        edge = np.searchsorted(width[order], np.arange(int(width.max(initial=0)) + 2))
        out, least = np.empty(len(i), np.int64), self.common
        for k in range(len(edge) - 1):
            if k:
                half = 1 << (k - 1)
                least = np.minimum(least[:-half], least[half:])
            some = order[edge[k] : edge[k + 1]]
            out[some] = np.minimum(least[low[some]], least[high[some] - (1 << k) + 1])
        return out


def grid(x: np.ndarray, longest: int, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grid places that equal the next one, in pieces. The others have a forward extension of 0."""
    held, n = [], 0
    for p in range(1, longest + 1):
        y = x[::p]
        hit = np.flatnonzero(y[:-1] == y[1:])
        if len(hit):
            held.append((hit * p, p))
            n += len(hit)
        if held and (n >= at_once or p == longest):
            yield np.concatenate([h for h, _ in held]), np.repeat([p for _, p in held], [len(h) for h, _ in held])
            held, n = [], 0
    if held:
        yield np.concatenate([h for h, _ in held]), np.repeat([p for _, p in held], [len(h) for h, _ in held])


def runs_of(texts: list[list[int]], exponent: int, shortest: int) -> list[np.ndarray]:
    """For each text (words as numbers) its runs, rows of (start, length, period), by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum([1, *(sizes + 1)])
    n = int(first[-1])
    # words of different texts never agree; a number of its own stands before, between and behind the texts
    x = np.empty(n, np.int64)
    x[first - 1] = -1 - np.arange(len(first))
    words = max((max(t) for t in texts if t), default=0) + 1
    for d, t in enumerate(texts):
        x[first[d] : first[d] + len(t)] = np.array(t, np.int64) + d * words
    ahead = back = None
    found = [np.zeros((0, 3), np.int64)]
    for at, p in grid(x, int(sizes.max(initial=0)) // exponent, max(ASKED, 2 * n)):
        if ahead is None:
            ahead, back = Extensions(x), Extensions(x[::-1].copy())
        start = at + 1 - back.of(n - 1 - at, n - 1 - at - p)
        length = at + p + ahead.of(at, at + p) - start
        good = length >= np.maximum(shortest, exponent * p)
        found.append(np.unique(np.stack([start[good], length[good], p[good]], 1), axis=0))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # a stretch found at several periods has the smallest one
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    cut = np.searchsorted(runs[:, 0], first)
    return [runs[cut[d] : cut[d + 1]] - [first[d], 0, 0] for d in range(len(texts))]


def strongest(runs: np.ndarray) -> np.ndarray:
    """The run of greatest length / period, compared exactly; ties: smallest start, then period."""
    best = runs[0]
    for r in runs[1:]:  # in order of start, period
        if int(r[1]) * int(best[2]) > int(best[1]) * int(r[2]):
            best = r
    return best


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run repeats after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words).decode()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([w for w, gone in zip(words, np.cumsum(edge).tolist()[:-1], strict=True) if not gone]).decode()


def periodic_runs(docs: DataFrame, exponent: int = 4, shortest: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed) of every row.

    ``runs``: array of (start, length, period), in words, of all stretches with smallest period ``period`` and a length of
    at least ``shortest`` and ``exponent`` (2 or more) periods that no neighbouring word extends; by start, then period.
    ``strongest``: the one of greatest length / period, ties by start, then period; null without runs. ``collapsed``: the
    text's words less those that a run repeats after its first period, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text, and one of white space, has no words, no runs and an empty
    collapsed text. Rows that repeat are all returned, null ids too; an empty table gives no rows; other columns of
    ``docs`` are not read. One text is the work of one task: its memory grows with that text alone.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period twice at least")

    def of(batch: dict) -> dict:
        number: dict[bytes, int] = {}
        words = [t.encode().split() for t in batch["text"]]
        runs = runs_of([[number.setdefault(w, len(number)) for w in ws] for ws in words], exponent, shortest)
        row = lambda r: dict(zip(("start", "length", "period"), map(int, r), strict=True))
        return {
            "doc_id": batch["doc_id"],
            "n_words": [len(w) for w in words],
            "runs": [[row(r) for r in rs] for rs in runs],
            "strongest": [row(strongest(rs)) if len(rs) else None for rs in runs],
            "collapsed": [collapsed(w, rs) for w, rs in zip(words, runs, strict=True)],
        }

    run = "struct<start:long,length:long,period:long>"
    return map_texts(id_text(docs, id_col, text_col), of, f"doc_id long, n_words long, runs array<{run}>, strongest {run}, collapsed string", max_bytes=2_000_000)
