"""Vectorised 64-bit hashes of words and of runs of words, for use inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np

#: ``[^\x20\x09-\x0D]+``: bytes that part words, for words taken unchanged.
SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and all beyond ASCII: bytes of normalised words (lower case is applied before).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

K1, K2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * K1
    x = (x ^ (x >> np.uint64(27))) * K2
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of several texts: ``start`` and ``end`` in ``raw``, ``first[d]:first[d+1]`` are the words of text d."""

    def __init__(self, texts: list[str], lower: bool):
        parts = [(t.lower() if lower else t).encode() for t in texts]
        self.raw = b"\n".join(parts) + b"\n" * 9
        buf = np.frombuffer(self.raw, np.uint8)
        inside = (ALNUM if lower else SPACES)[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.first = np.searchsorted(self.start, begins)
        self.texts = len(texts)
        self.doc = np.repeat(np.arange(self.texts), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """One hash per word, eight bytes at a time."""
        eight = np.ndarray(shape=(len(self.raw) - 7,), dtype="<u8", buffer=self.raw, strides=(1,))
        size = self.end - self.start
        h = mix(size.astype(np.uint64) + GOLDEN)
        live, at = None, self.start
        while True:
            rest = size if live is None else size[live]
            chunk = eight[at] & _MASK[np.minimum(rest, 8)]
            if live is None:
                h = mix((h ^ chunk) * K1 + GOLDEN)
                live = np.flatnonzero(size > 8)
            else:
                h[live] = mix((h[live] ^ chunk) * K1 + GOLDEN)
                live = live[rest > 8]
            if not len(live):
                return h
            size = size.copy() if size.base is not None else size
            size[live] -= 8
            at = self.start[live] + ((self.end - self.start)[live] - size[live])

    def left(self) -> np.ndarray:
        """For each word the number of words from it to the end of its text."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.start))


def grams(h: np.ndarray, n: int, base: int = 0x9E6C63D0876A9A47) -> np.ndarray:
    """Hashes of the n consecutive hashes from each place on (by doubling); the last n - 1 places are left out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    b, out, done, part, width = base | 1, None, 0, h, 1
    rest = n
    while rest:
        if rest & 1:
            shifted = part[done:]
            if out is None:
                out = shifted
            else:
                m = min(len(out), len(shifted))
                out = out[:m] * np.uint64(pow(b, width, 1 << 64)) + shifted[:m]
            done += width
        rest >>= 1
        if rest:
            part = part[: len(part) - width] * np.uint64(pow(b, width, 1 << 64)) + part[width:]
            width *= 2
    return mix(out[: len(h) - n + 1])


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()
