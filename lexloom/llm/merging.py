"""Merge-type (BPE) encoding: a score-ordered agenda of adjacent symbol pairs.

Two forms with the same result. :func:`agenda` keeps the pairs of one word in a heap, best score first and leftmost among
equals, and drops entries whose symbols have been merged meanwhile. :func:`lockstep` holds the agendas of many short words
as one matrix of pair ranks and takes each word's best pair in turn, so that numpy merges all of them together.
:class:`UnitStore` keeps the ids of words already seen by a worker.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

from .wordscan import HashIndex

NONE = np.int32(1 << 30)


class MergeTable:
    """(left symbol, right symbol) -> (rank, merged symbol), as a dict and as a hash table for whole arrays."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.pairs = merges
        self.index = HashIndex(2 * len(merges))
        value = np.array(list(merges.values()), np.int32).reshape(-1, 2)
        self.rank, self.made = np.append(value[:, 0], NONE), np.append(value[:, 1], np.int32(-1))
        self.index.add(np.array([(a << 32) | b for a, b in merges], np.uint64), np.arange(len(merges)))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged) of pairs of arrays; NONE and -1 where there is no merge."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        found = self.index.find(key.ravel()).reshape(left.shape)
        return self.rank[found], self.made[found]


def agenda(symbols: list[int], table: MergeTable) -> list[int]:
    """Merges one word with a heap of (rank, position)."""
    pairs = table.pairs
    n = len(symbols)
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if hit := pairs.get((symbols[i], symbols[i + 1])):
            heap.append((hit[0], i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j] = pairs[left, right][1], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if hit := pairs.get((symbols[i], symbols[k])):
                heapq.heappush(heap, (hit[0], i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (hit := pairs.get((symbols[h], symbols[i]))):
            heapq.heappush(heap, (hit[0], h, symbols[h], symbols[i]))
    return [s for s in symbols if s >= 0]


def _together(sym: np.ndarray, table: MergeTable) -> np.ndarray:
    """Merges the rows of a matrix; the ends of rows are filled with -1."""
    out = sym.copy()
    if sym.shape[1] < 2:
        return out
    rows = np.arange(len(sym))
    rank, made = table.find(sym[:, :-1], sym[:, 1:])
    bad = (sym[:, :-1] < 0) | (sym[:, 1:] < 0)
    rank[bad] = NONE
    while True:
        best = rank.argmin(axis=1)
        here = np.arange(len(rank))
        live = rank[here, best] < NONE
        if not live.all():
            done = ~live
            out[rows[done], : sym.shape[1]] = sym[done]
            out[rows[done], sym.shape[1] :] = -1
            rows, sym, rank, made, best = rows[live], sym[live], rank[live], made[live], best[live]
            here = np.arange(len(rank))
        if not len(rows):
            return out
        width = sym.shape[1]
        new = made[here, best]
        column = np.arange(width - 1)
        sym = np.take_along_axis(sym, column + (column > best[:, None]), axis=1)
        sym[here, best] = new
        column = np.arange(width - 2)
        move = column + (column >= best[:, None])
        rank, made = np.take_along_axis(rank, move, axis=1), np.take_along_axis(made, move, axis=1)
        if width == 2:
            out[rows, :1] = sym
            out[rows, 1:] = -1
            return out
        for side in (best - 1, best):
            ok = (side >= 0) & (side < width - 2)
            at, row = side[ok], here[ok]
            a, b = sym[row, at], sym[row, at + 1]
            r, m = table.find(a, b)
            r[(a < 0) | (b < 0)] = NONE
            rank[row, at], made[row, at] = r, m


def lockstep(flat: np.ndarray, lengths: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges many words given one after the other. Returns (symbols one after the other, symbols of each word)."""
    start = np.concatenate([[0], np.cumsum(lengths)])
    counts = np.zeros(len(lengths), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for length in np.unique(lengths):
        if not length:
            continue
        rows = np.flatnonzero(lengths == length)
        made = _together(flat[start[rows][:, None] + np.arange(length)].astype(np.int32), table)
        counts[rows] = (made >= 0).sum(axis=1)
        parts.append((rows, made))
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(first[-1]), np.int32)
    for rows, made in parts:
        valid = made >= 0
        out[(first[rows][:, None] + np.arange(made.shape[1]))[valid]] = made[valid]
    return out, counts


class UnitStore:
    """Ids of units (words, or parts of them) already seen, under their hashes; bounded, the store starts anew when it is full."""

    KEEP = 400_000

    def __init__(self, keep: int = KEEP):
        self.keep = keep
        self.clear()

    def clear(self) -> None:
        self.index = HashIndex(1 << 16)
        self.start = np.zeros(1, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def gather(self, key: np.ndarray, learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after the other, ids of each unit). ``learn`` gets the positions of new units."""
        at = self.index.find(key)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, first = np.unique(key[new], return_index=True)
            if self.index.n + len(fresh) > self.keep and self.index.n:
                self.clear()
                fresh, new = np.unique(key, return_index=True)
                first = np.arange(len(new))
            ids, count = learn(new[first])
            self.index.add(fresh, np.arange(len(self.count), len(self.count) + len(fresh)))
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.start = np.concatenate([[0], np.cumsum(self.count)])
            at = self.index.find(key)
        count = self.count[at]
        running = np.concatenate([[0], np.cumsum(count)])
        return self.ids[np.repeat(self.start[at] - running[:-1], count) + np.arange(running[-1])], count
