"""Array forms of word and byte n-gram hashing, used inside Spark tasks.

A batch of texts becomes one byte buffer.  Words are maximal runs outside
``[\\x20\\x09-\\x0D]`` after lower-casing ``A-Z``; each gets a 64-bit hash.
A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SLICE = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _SLICE + 4096), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 8 * _SLICE:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Tokens:
    """Words of a batch: ``first[d]:first[d + 1]`` are the words of text d."""

    buf: np.ndarray
    offsets: np.ndarray  # byte offset of each text, one more at the end
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def tokens(texts: Iterable[str | None], hashed: bool = True, lower: bool = True, gaps: np.ndarray = _SPACE) -> Tokens:
    """``gaps`` holds the 256 bytes that are between words; the space must be one of them."""
    parts = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    raw = b" ".join(parts) + b" "
    buf = np.frombuffer(raw.translate(_LOWER) if lower else raw, np.uint8)
    space = gaps[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    first = np.searchsorted(starts, offsets)
    hashes = word_hashes(buf, starts, ends) if hashed else np.empty(0, np.uint64)
    return Tokens(buf, offsets, starts, ends, first, hashes)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[s:e] for sorted, disjoint spans, by differences of a running polynomial."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + _SLICE)))
        b = int(ends[j - 1])
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_VALUES[buf[a:b]] * _powers_of(_BASE, b - a)[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * _powers_of(_BASE_INV, b - a)[s])
        i = j
    return out


def joined(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k hashes that follow one another."""
    size = len(h) - k + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + h[i : size + i]
    return mix(out)


def batches(frames: Iterator, column: str, most: int = 4 << 20) -> Iterator:
    """Cut pandas frames into runs of rows of about ``most`` characters, so that memory stays bounded."""
    for frame in frames:
        if not len(frame):
            continue
        size = frame[column].map(lambda t: len(t) if t else 0).to_numpy(np.int64)
        group = np.cumsum(size) // most
        cut = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cut], [*cut, len(frame)]):
            yield frame.iloc[a:b].reset_index(drop=True)
