"""Pair merging of many pieces at once, for byte-level vocabularies."""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int64(1) << 40
EMPTY = np.int64(-1)
MIX = np.uint64(0x9E3779B97F4A7C15)
LONG = 96  # bytes beyond which a piece is merged by itself


class PairTable:
    """pair of ids -> (rank, id of the joined token), by open addressing; a rank names one token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = left.astype(np.int64) << 20 | right
        self.bits = int(4 * len(keys)).bit_length()
        self.key = np.full(1 << self.bits, EMPTY)
        self.rank = np.full(1 << self.bits, NONE)
        slot, rank = self._slot(keys), rank.astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.key[slot] == EMPTY)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key[slot[put]], self.rank[slot[put]] = keys[put], rank[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, rank, slot = keys[rest], rank[rest], (slot[rest] + 1) & (len(self.key) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def items(self) -> dict[int, int]:
        """All of it as left << 20 | right -> rank."""
        full = self.key != EMPTY
        return dict(zip(self.key[full].tolist(), self.rank[full].tolist()))

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE for pairs that make no token."""
        keys = left << 20 | right
        slot = self._slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.rank[slot], NONE)
        wait = np.flatnonzero((found != keys) & (found != EMPTY))
        while len(wait):
            slot[wait] = (slot[wait] + 1) & (len(self.key) - 1)
            found = self.key[slot[wait]]
            hit = found == keys[wait]
            out[wait[hit]] = self.rank[slot[wait[hit]]]
            wait = wait[~hit & (found != EMPTY)]
        return out


class Merger:
    """Joins the best pair of each piece until none is left, the first one of equals. ids[rank] is a joined token's id."""

    def __init__(self, table: PairTable, ids: np.ndarray):
        self.table, self.made = table, ids

    def slowly(self, ids: list[int]) -> list[int]:
        """One long piece: a heap of its pairs instead of rounds over all of it."""
        first = self.table.ranked(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.made[rank]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := int(self.table.ranked(np.array([ids[x]], np.int64), np.array([ids[y]], np.int64))[0])) < NONE:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def merged(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces with `size` first ids each: their final ids, and how many each has."""
        n = len(size)
        done_ids, done_own = [], []
        own, big = np.repeat(np.arange(n), size), np.repeat(size > LONG, size)
        if big.any():
            at = np.append(0, np.cumsum(size))
            for i in np.flatnonzero(size > LONG).tolist():
                out = self.slowly(ids[at[i] : at[i + 1]].tolist())
                done_ids.append(np.array(out, np.int64))
                done_own.append(np.full(len(out), i))
            ids, own = ids[~big], own[~big]
        ids = ids.astype(np.int64)
        rank = np.full(len(ids), NONE)
        if len(ids) > 1:
            inner = np.flatnonzero(own[1:] == own[:-1])
            rank[inner] = self.table.ranked(ids[inner], ids[inner + 1])
        while len(ids):
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(ids))))
            idle = best == NONE
            if idle.any():
                done_ids.append(ids[idle])
                done_own.append(own[idle])
                ids, own, rank, best = ids[~idle], own[~idle], rank[~idle], best[~idle]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.append(True, own[at[1:]] != own[at[:-1]])]
            ids[at] = self.made[best[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # where they stand after the others have gone
            ids, own, rank = ids[keep], own[keep], rank[keep]
            for x in (at, at[at > 0] - 1):
                y = np.minimum(x + 1, len(ids) - 1)
                rank[x] = np.where((own[x] == own[y]) & (x != y), self.table.ranked(ids[x], ids[y]), NONE)
        own = np.concatenate(done_own) if done_own else np.zeros(0, np.int64)
        out = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        return out[np.argsort(own, kind="stable")], np.bincount(own, minlength=n)
