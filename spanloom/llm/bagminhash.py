"""BagMinHash signatures of weighted sets, for a whole batch of sets at once.

Every element has a Poisson process over its discretised weight range. The range is a hierarchy of blocks
[0, 1), [1, 2), [2, 4), [4, 8) ... in units of the discretisation, each with a process of its own whose rate is the block's width; an
element of weight w takes part with the points of its blocks that lie below w. Each point hits a random component of the signature,
which keeps the earliest. Two bags agree in a component with the probability of their weighted Jaccard similarity. Points come in
order of time, so a bag is done with a block as soon as its next point is later than the bag's latest component.
"""

from __future__ import annotations

import numpy as np

from ._chars import U64, mix

GOLDEN = U64(0x9E3779B97F4A7C15)


def _blocks(element: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the element, state, width, units of the block that count) of all blocks below the weights."""
    index, state, width, count = [], [], [], []
    low, size, level = 0, 1, 0
    at = np.flatnonzero(units > 0)
    while len(at):
        index.append(at)
        state.append(mix(element[at] + U64((int(GOLDEN) * (level + 1)) % (1 << 64))))
        width.append(np.full(len(at), float(size)))
        count.append(np.minimum(units[at] - low, size).astype(float))
        low, size, level = low + size, max(1, low + size), level + 1
        at = at[units[at] > low]
    return tuple(np.concatenate(x) for x in (index, state, width, count))


def signatures(of: np.ndarray, element: np.ndarray, units: np.ndarray | None, bags: int, size: int) -> np.ndarray:
    """(bags, size) of 64-bit values. of: bag of each element, ascending; element: its hash; units: its weight in whole units, None for sets.

    A bag without elements has the largest value everywhere."""
    best = np.full((bags, size), np.inf)
    if len(of):
        if units is None:
            bag, state, width, count = of, mix(element + GOLDEN), None, None
        else:
            index, state, width, count = _blocks(element, units)
            order = np.argsort(index, kind="stable")
            bag, state, width, count = of[index[order]], state[order], width[order], count[order]
        time = np.zeros(len(bag))
        flat = best.reshape(-1)
        worst = np.full(bags, np.inf)
        turn, upto = 0, 4
        while len(bag):
            state = state + GOLDEN
            x = mix(state)
            gap = -np.log(((x >> U64(11)).astype(float) + 0.5) * 2.0**-53)
            time = time + (gap if width is None else gap / width)
            y = mix(x ^ U64(0xA0761D6478BD642F))
            component = ((y >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)
            hit = bag * size + component
            late = time < flat[hit]
            if width is not None:
                late &= (y & U64(0xFFFFFFFF)).astype(float) * width < count * 2.0**32
            np.minimum.at(flat, hit[late], time[late])
            turn += 1
            if turn >= upto:
                upto = turn + max(2, turn // 6)
                live = np.flatnonzero(np.bincount(bag, minlength=bags))
                worst[live] = best[live].max(axis=1)
            stay = time < worst[bag]
            if not stay.all():
                bag, state, time = bag[stay], state[stay], time[stay]
                if width is not None:
                    width, count = width[stay], count[stay]
    return best.view(U64)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """(bags, bands) of 64-bit keys, different from band to band."""
    bags, size = signature.shape
    bands = size // rows
    parts = signature.reshape(bags, bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), (bags, bands))
    for i in range(rows):
        key = mix(key * GOLDEN + parts[:, :, i])
    return key
