"""How many copies of a cluster a replicate draws, for whole blocks of clusters and all replicates at once.

The numbers are those of metrics.uniform() and metrics.poisson_copies(): Spark's xxhash64 of (seed, replicate, cluster), whose state after the
first two is one number a replicate. A block is a matrix (clusters x replicates) that stays in a core's cache.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

_ALL = (1 << 64) - 1
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
#: Draws in hand at once.
BLOCK = 1 << 15
#: Types of clusters that are hashed here, and bytes that the hash takes of them.
WIDTHS = {"tinyint": 4, "smallint": 4, "int": 4, "bigint": 8}


def poisson_steps() -> list[float]:
    """Cumulative probabilities of Poisson(1), as far as doubles tell them from 1."""
    out, cum, term = [], 0.0, 0.36787944117144233
    for k in range(1, 19):
        cum += term
        out.append(cum)
        term /= k
    return out


def _rotated(x: int, by: int) -> int:
    return (x << by | x >> (64 - by)) & _ALL


def _mixed(h: int) -> int:
    h = (h ^ h >> 33) * _P2 & _ALL
    h = (h ^ h >> 29) * _P3 & _ALL
    return h ^ h >> 32


def _hash_int(v: int, h: int) -> int:
    h = (h + _P5 + 4 & _ALL) ^ ((v & 0xFFFFFFFF) * _P1 & _ALL)
    return _mixed((_rotated(h, 23) * _P2 + _P3) & _ALL)


def _hash_long(v: int, h: int) -> int:
    h = (h + _P5 + 8 & _ALL) ^ (_rotated(v * _P2 & _ALL, 31) * _P1 & _ALL)
    return _mixed((_rotated(h, 27) * _P1 + _P4) & _ALL)


class Copies:
    """The copies of clusters of one whole-number type in replicates 1, 2, ..."""

    def __init__(self, seed: int, replicates: int, kind: str):
        first = (_hash_int if -(1 << 31) <= seed < 1 << 31 else _hash_long)(seed, 42)
        self.states = np.array([_hash_int(rep, first) for rep in range(1, replicates + 1)], np.uint64)
        self.width, self.steps = WIDTHS[kind], np.array(poisson_steps())
        # by the first 16 bits; 255 where a step lies inside what they leave open
        edge = np.arange((1 << 16) + 1) / (1 << 16)
        low, high = np.searchsorted(self.steps, edge[:-1], "right"), np.searchsorted(self.steps, edge[1:], "left")
        self.table = np.where(low == high, low, 255).astype(np.uint8)

    def _counted(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.steps, (hashes >> np.uint64(11)).astype(float) * 2.0**-53, "right")

    def of(self, clusters: pa.Array) -> np.ndarray:
        """(clusters x replicates), one byte each."""
        u = np.uint64
        many = len(self.states)
        out = np.empty((len(clusters), many), np.uint8)
        v = np.asarray(clusters.fill_null(0)).astype(np.int64).view(u)
        if self.width == 8:
            v = v * u(_P2)
            keys, turn, by, plus = (v << u(31) | v >> u(33)) * u(_P1), 27, _P1, _P4
        else:
            keys, turn, by, plus = (v & u(0xFFFFFFFF)) * u(_P1), 23, _P2, _P3
        begun = self.states + u(_P5 + self.width)
        step = max(1, BLOCK // many)
        held, other = np.empty((step, many), u), np.empty((step, many), u)
        for a in range(0, len(keys), step):
            rows = keys[a : a + step, None]
            h, t, made = held[: len(rows)], other[: len(rows)], out[a : a + step]
            np.bitwise_xor(begun, rows, out=h)
            np.left_shift(h, u(turn), out=t)
            np.right_shift(h, u(64 - turn), out=h)
            np.bitwise_or(h, t, out=h)
            np.multiply(h, u(by), out=h)
            np.add(h, u(plus), out=h)
            for shift, times in ((33, _P2), (29, _P3)):
                np.right_shift(h, u(shift), out=t)
                np.bitwise_xor(h, t, out=h)
                np.multiply(h, u(times), out=h)
            np.right_shift(h, u(48), out=t)  # the last step of the hash leaves the first 32 bits as they are
            np.take(self.table, t.view(np.int64), out=made, mode="clip")
            open_ = np.flatnonzero(made.reshape(-1) == 255)
            last = h.reshape(-1)[open_]
            made.reshape(-1)[open_] = self._counted(last ^ last >> u(32))
        if clusters.null_count:
            out[np.asarray(clusters.is_null())] = self._counted(self.states)  # a null leaves the hash as it is
        return out


def copies_of(batch: pa.RecordBatch, column: str, copies: Copies | None, replicates: int) -> np.ndarray:
    """The copies of a batch's clusters, or the matrix that the column already holds as lists."""
    at = batch.column(batch.schema.get_field_index(column))
    return copies.of(at) if copies else np.asarray(at.flatten()).reshape(batch.num_rows, replicates).astype(np.uint8)


def weighted(copies: np.ndarray, values: Sequence[np.ndarray]) -> np.ndarray:
    """(values x replicates): sums of finite values by copies; of others only where they are drawn."""
    x = np.stack(values)
    odd = np.flatnonzero(~np.isfinite(x).all(axis=0))
    plain = x.copy() if len(odd) else x
    plain[:, odd] = 0.0
    out = np.zeros((len(x), copies.shape[1]))
    step = max(1, BLOCK // copies.shape[1])
    for a in range(0, len(copies), step):
        out += plain[:, a : a + step] @ copies[a : a + step].astype(float)
    for i in odd:
        some = copies[i] > 0
        out[:, some] += x[:, i, None] * copies[i, some]
    return out
