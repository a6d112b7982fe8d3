"""Vectorised words, lines and hashes over the bytes of an Arrow text column."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

from graphloom.llm.shared import text_buffer

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that part words where only letters and digits count: all of ASCII but 0-9, A-Z and a-z.
_PLAIN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 of ranges of a sequence, from its prefix sums and an odd, invertible base."""

    def __init__(self, seed: int):
        self.byte = mix(np.arange(1, 257, dtype=U) + U(seed) * U(0x9E3779B97F4A7C15 % (1 << 32)))
        self.base = int(mix(np.array([seed + 77], U))[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = np.ones(size, U), np.ones(size, U)
            self.up[1:], self.down[1:] = U(self.base), U(self.inverse)
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of a sequence of 64-bit values; bytes go through ``self.byte`` first."""
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, U)
        if values.dtype == np.uint8:
            values = self.byte[values]
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash for each range; equal content, equal hash, wherever it stands."""
        return mix((prefix[ends] - prefix[starts]) * self.down[starts] + (ends - starts).astype(U))


FIRST = Rolling(11)
#: Bytes up to which a rolling hash stands for a word or line; longer ones, where sums modulo a power of two can agree by the
#: pattern of the text (Thue-Morse words), are digested whole.
SHORT = 32


def range_hashes(rolling: Rolling, buf: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes: the rolling one of short ranges, 64 bits of BLAKE2b of long ones."""
    out = rolling.ranges(prefix, starts, ends)
    long = np.flatnonzero(ends - starts > SHORT)
    for k, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist()):
        out[k] = int.from_bytes(blake2b(buf[a:b], digest_size=8).digest(), "little")
    return out


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text (``plain``: runs of letters, digits and what is beyond ASCII); a text's words are ``word_off[i]`` to ``word_off[i + 1]``."""

    def __init__(self, column: pa.Array, rolling: Rolling = FIRST, lower: bool = False, plain: bool = False):
        self.buf, self.off = text_buffer(column)
        if lower:
            self.buf = np.where((self.buf >= 65) & (self.buf <= 90), self.buf + 32, self.buf).astype(np.uint8)
        self.n = len(self.off) - 1
        solid = ~(_PLAIN if plain else _SPACE)[self.buf]
        edge = np.zeros(len(self.buf) + 1, bool)  # a text begins here
        edge[self.off] = True
        before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1] if len(solid) else solid
        after = np.concatenate([solid[1:], [False]]) & ~edge[1:] if len(solid) else solid
        self.solid = solid
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.word_off = np.searchsorted(self.starts, self.off)
        self.counts = np.diff(self.word_off)
        self.doc = np.repeat(np.arange(self.n), self.counts)
        self.rolling = rolling
        self.prefix = rolling.prefix(self.buf)
        self.hash = range_hashes(rolling, self.buf, self.prefix, self.starts, self.ends)

    def windows(self, size: int, rolling: Rolling = FIRST) -> tuple[np.ndarray, np.ndarray]:
        """First word of every window of ``size`` words within a text, and the windows' hashes."""
        at = np.arange(max(0, len(self.hash) - size + 1))
        at = at[self.doc[at] == self.doc[at + size - 1]] if len(at) else at
        return at, rolling.ranges(rolling.prefix(self.hash), at, at + size)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums over each text of a value for each byte."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]


def repeated(groups: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its hash occurs again in its group, and whether it is not the first there."""
    key = mix(hashes ^ mix(groups.astype(U) + U(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return again, later


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in one of the ranges [at, at + size)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + size, n), -1)
    return np.cumsum(edge[:-1]) > 0
