"""Karmarkar-Karp multiway differencing of bounded lists of weights."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import numpy as np


def difference(weights: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each weight. Two partial partitions with the largest spreads are merged, the heaviest bin of
    the one with the lightest of the other, until one is left; ties go to the earlier weight. Empty input gives no bins.
    """
    n = len(weights)
    of = np.zeros(n, np.int64)
    if n == 0 or bins <= 1:
        return of
    following = np.full(n, -1, np.int64)
    heap = [(-int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def part(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if i in parts:
            return parts.pop(i)
        load, head, tail = np.zeros(bins, np.int64), np.full(bins, -1, np.int64), np.full(bins, -1, np.int64)
        load[0], head[0], tail[0] = weights[i], i, i
        return load, head, tail

    new = n
    while len(heap) > 1:
        a, b = part(heapq.heappop(heap)[1]), part(heapq.heappop(heap)[1])
        load = a[0] + b[0][::-1]
        head_b, tail_b = b[1][::-1], b[2][::-1]
        both = (a[1] >= 0) & (head_b >= 0)
        following[a[2][both]] = head_b[both]
        head = np.where(a[1] >= 0, a[1], head_b)
        tail = np.where(tail_b >= 0, tail_b, a[2])
        order = np.argsort(-load, kind="stable")
        load = load[order]
        load -= load[-1]
        parts[new] = (load, head[order], tail[order])
        heapq.heappush(heap, (-int(load[0]), new))
        new += 1
    _, head, _ = part(heap[0][1])
    for b, i in enumerate(head.tolist()):
        while i >= 0:
            of[i] = b
            i = int(following[i])
    return of


def relieve(weights: np.ndarray, of: np.ndarray, bins: int, capacity: int) -> bool:
    """Moves or swaps single weights out of bins over capacity, in place; whether all bins then fit. Each step takes, of all moves and swaps of a bin that is over, the one
    that lessens the weight over capacity most, so it ends."""
    load = np.bincount(of, weights, bins).astype(np.int64)
    while (load > capacity).any():
        over = np.flatnonzero(load > capacity)
        for b in over[np.argsort(-load[over], kind="stable")].tolist():
            need, best = int(load[b]) - capacity, None
            others = np.flatnonzero(of != b)
            back = np.concatenate((weights[others], np.zeros(bins, np.int64)))
            to = np.concatenate((of[others], np.arange(bins)))
            room = capacity - load[to]
            for x in np.flatnonzero(of == b).tolist():
                gain = weights[x] - back
                less = np.where((to != b) & (gain > 0), np.minimum(gain, need) - np.maximum(0, gain - np.maximum(room, 0)), 0)
                most = int(less.max())
                if most > 0 and (best is None or most > best[0]):
                    same = np.flatnonzero(less == most)
                    best = (most, x, int(same[np.abs(room[same] - gain[same]).argmin()]))
            if best is not None:
                break
        else:
            return False
        _, x, i = best
        gain = int(weights[x] - back[i])
        of[x] = to[i]
        if i < len(others):
            of[others[i]] = b
        load[b] -= gain
        load[to[i]] += gain
    return True


#: Shares of the weight, in the smallest pieces, that are held back to close gaps, tried one after the other: none as long as moves and swaps suffice.
CLOSING = (0.0, 0.05, 0.15, 0.3)


def _close_gaps(weights: np.ndarray, small: np.ndarray, of: np.ndarray, load: np.ndarray, capacity: int) -> bool:
    """Puts each small weight, the heaviest first, into the bin it leaves least room in; whether all found one."""
    room = sorted((capacity - int(x), b) for b, x in enumerate(load))
    for i in small.tolist():
        w = int(weights[i])
        at = bisect_left(room, (w, -1))
        if at == len(room):
            return False
        free, b = room.pop(at)
        of[i] = b
        insort(room, (free - w, b))
    return True


def pack(weights: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each weight (none over capacity) in as few bins of the capacity as found. All weights are differenced into near-equal bins and moves and swaps relieve the ones
    over capacity; where they cannot, the smallest pieces are held back (CLOSING) and close the gaps by best fit. The count of bins starts at the least possible and
    rises by one whenever the capacity is exceeded."""
    n = len(weights)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(-weights, kind="stable")
    upwards = np.cumsum(weights[order[::-1]])
    bins = max(1, -(-int(weights.sum()) // capacity))
    while True:
        for share in CLOSING:
            held = int(np.searchsorted(upwards, share * weights.sum()))
            large, small = order[: n - held], order[n - held :]
            of = np.zeros(n, np.int64)
            part = difference(weights[large], bins)
            if relieve(weights[large], part, bins, capacity):
                of[large] = part
                if _close_gaps(weights, small, of, np.bincount(part, weights[large], bins), capacity):
                    return of
        bins += 1
