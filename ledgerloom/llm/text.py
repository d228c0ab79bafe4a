"""Words of many texts at once, by numpy over Arrow's own buffers.

Texts are UTF-8. Only ASCII bytes separate words in the two word definitions used
here and only A-Z are lower-cased, so bytes decide everything and no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_BASE = U64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits over 64 bits, one to one."""
    x = x ^ (x >> U64(33))
    x = x * _M1
    x ^= x >> U64(33)
    x *= _M2
    x ^= x >> U64(33)
    return x


def inverse(x: int) -> int:
    """Of an odd number, modulo 2**64."""
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % 2**64
    return y


class _Powers:
    """Powers of the base and of its inverse, as far as a text has needed them."""

    up = down = np.ones(1, U64)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) <= n:
            n = max(n + 1, 1 << 20)
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, b, U64)])) for b in (_BASE, U64(inverse(int(_BASE)))))


@dataclass
class Words:
    """Words of a slice of texts: byte positions in ``data``, the text's number, a 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first[i]: index of text i's first word; one more entry than texts
    prefix: dict[int, tuple[np.ndarray, np.ndarray]]  # by length in bytes: (words that are longer, hashes of their beginnings)


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of rows of about ``most`` bytes; a longer text comes alone. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, buf = column.buffers()
    n = len(column)
    at = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(raw: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray, chunk: int = 1 << 20, prefixes: tuple[int, ...] = ()) -> Words:
    """All words of the texts, and on request hashes of their first so many bytes. Long inputs go through in chunks that end between words, so memory stays bounded."""
    n = len(raw)
    inside = alphabet[raw]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    out = np.empty(len(start), U64)
    begins: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in prefixes}
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + chunk, "right")))
        a, b = int(start[i]), int(end[j - 1])
        _Powers.upto(b - a)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(_BYTE[LOWER[raw[a:b]]] * _Powers.up[: b - a], out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * _Powers.down[s])
        for n in prefixes:
            k = np.flatnonzero(e - s > n)
            t = s[k]
            begins[n].append((k + i, mix((sums[t + n] - sums[t]) * _Powers.down[t] ^ _BYTE[n])))
        i = j
    first = np.searchsorted(start, offsets)
    return Words(start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), out, first, {n: tuple(map(np.concatenate, zip((np.zeros(0, np.int64), np.zeros(0, U64)), *b, strict=True))) for n, b in begins.items()})


def word_hash(word: bytes) -> int:
    raw = np.frombuffer(word, np.uint8)
    return int(words(raw, np.array([0, len(raw)]), np.ones(256, bool)).hash[0])


class Vocabulary:
    """Numbers of given word hashes; a small bit table turns most other words away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self._maybe = np.zeros(1 << 16, bool)
        self._maybe[self.hashes & U64(0xFFFF)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes`` of known words, their numbers)."""
        at = np.flatnonzero(self._maybe[hashes & U64(0xFFFF)])
        if not len(self.hashes) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        good = self.hashes[k] == hashes[at]
        return at[good], k[good]
