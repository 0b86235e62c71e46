"""Words of whole texts as arrays: boundaries and 64-bit hashes of many words at once, in numpy.

Texts are scanned in pieces of about ``PIECE`` bytes; a longer text is cut at white space, so memory doesn't follow the
longest text (only a single longer word makes a longer piece).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from .common import SPACE

PIECE = 1 << 20
#: Runs longer than this are hashed by the library: sums of powers modulo 2^64 meet for some patterns of a thousand letters and more.
LONG = 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_MARK = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)  # a random number for each byte
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash's base."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 64) * 2, _BASE, np.uint64))])
    return _powers[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of runs that cover the bytes of an array one after the other."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    local = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    value = _MARK[data] * powers(LONG)[np.minimum(local, LONG - 1)]
    out = mixed(np.add.reduceat(value, starts) + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return out


def pieces(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[list[bytes], list[int]]]:
    """Groups of texts (or of parts of long ones, cut at white space) and the number of each one's text."""
    group: list[bytes] = []
    owner: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > most:
            cut = max(text.rfind(bytes([s]), at + 1, at + most) for s in (32, 10))
            if cut < 0:
                cut = next((j for j in range(at + most, len(text)) if text[j] in SPACE), len(text))
            if group:
                yield group, owner
                group, owner, size = [], [], 0
            yield [text[at:cut]], [i]
            at = cut
        if size and size + len(text) - at > most:
            yield group, owner
            group, owner, size = [], [], 0
        group.append(text[at:] if at else text)
        owner.append(i)
        size += len(group[-1]) + 1
    if group:
        yield group, owner


class Words:
    """Words of one piece. data: their bytes one after the other; start, length: of each word in them; text: the number of
    each word's text; hash: of each word."""

    def __init__(self, group: list[bytes], owner: list[int], lower: bool = False):
        raw = b"\n".join(group)
        buf = np.frombuffer(raw, np.uint8)
        if lower:
            buf = _LOWER[buf]
        inside = _IS_WORD[buf]
        at = np.flatnonzero(inside)
        first = np.ones(len(at), bool)
        first[1:] = np.diff(at) > 1
        self.start = np.flatnonzero(first)
        self.length = np.diff(np.append(self.start, len(at)))
        self.data = buf[at]
        self.hash = run_hashes(self.data, self.start, self.length)
        ends = np.cumsum([len(x) + 1 for x in group])
        self.text = np.array(owner, np.int64)[np.searchsorted(ends, at[self.start], "right")] if len(at) else np.zeros(0, np.int64)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, words of each text)."""
    parts, counts = [], np.zeros(len(texts), np.int64)
    for group, owner in pieces(texts):
        words = Words(group, owner, lower)
        parts.append(words.hash)
        counts += np.bincount(words.text, minlength=len(texts))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), counts


class HashIndex:
    """64-bit keys to small numbers, for whole arrays at once; grows as needed."""

    def __init__(self, room: int = 1 << 12):
        self.n = 0
        self._allocate(max(4, int(np.ceil(np.log2(2 * max(room, 1))))))

    def _allocate(self, bits: int) -> None:
        self.bits = bits
        self.key = np.zeros(1 << bits, np.uint64)
        self.value = np.full(1 << bits, -1, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        key = np.where(key == 0, np.uint64(1), key)
        at = self._slot(key)
        here = self.key[at]
        lost = np.flatnonzero((here != key) & (here != 0))
        while len(lost):
            at[lost] = (at[lost] + 1) & (len(self.key) - 1)
            here = self.key[at[lost]]
            lost = lost[(here != key[lost]) & (here != 0)]
        return np.where(self.key[at] == key, self.value[at], -1)

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        """Adds distinct keys that aren't in it yet."""
        if 2 * (self.n + len(key)) > len(self.key):
            old = self.key != 0
            keys, values = self.key[old], self.value[old]
            self._allocate(int(np.ceil(np.log2(4 * (self.n + len(key))))))
            self._put(keys, values)
        self._put(np.where(key == 0, np.uint64(1), key), value.astype(np.int32))
        self.n += len(key)

    def _put(self, key: np.ndarray, value: np.ndarray) -> None:
        at = self._slot(key)
        while len(key):
            free = self.key[at] == 0
            _, lead = np.unique(at, return_index=True)
            won = np.zeros(len(key), bool)
            won[lead] = True
            won &= free
            self.key[at[won]] = key[won]
            self.value[at[won]] = value[won]
            key, value, at = key[~won], value[~won], at[~won]
            at = np.where(self.key[at] != 0, (at + 1) & (len(self.key) - 1), at)
