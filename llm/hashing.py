"""Hashes of byte ranges, for tasks that work on many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C55


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digest(data: bytes | memoryview) -> int:
    """64 bits of a cryptographic digest, for deciding that bytes are equal."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


class Digests(dict):
    """Digests by word; fills itself, and starts anew when it holds ``most`` words."""

    def __init__(self, most: int = 500_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = digest(word)
        return found


class Hashes:
    """Hashes of any ranges of some bytes, from running sums.

    They serve to choose places and groups alike wherever the same bytes stand. They wrap around, so
    different bytes of regular structure can share one: equality isn't decided by them.
    """

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.full(len(data) + 1, _BASE, dtype=np.uint64)
            back = np.full(len(data) + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            power[0] = back[0] = 1
            self.back = np.cumprod(back)
            self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            size = (stop - start).astype(np.uint64)
            return mixed((self.sums[stop] - self.sums[start]) * self.back[start] + size * np.uint64(0xD6E8FEB86659FD93))


def raw(column: pa.Array) -> list[memoryview]:
    """The bytes of each text or binary value; null is empty."""
    return [memoryview(t.as_buffer()) if t.is_valid else memoryview(b"") for t in column]
