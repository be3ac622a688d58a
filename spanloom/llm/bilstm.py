"""Character-level bidirectional LSTM with CRF transitions, in numpy.

Gates are piecewise linear (clipped), so a step is a table look-up, one product and a few clips. All lanes of a batch, and both directions, go in lockstep.
Symbol 0, the end of a text, closes every gate: state and cell are zero behind it in both directions, so what a text gets does not depend on its neighbours.
"""

from __future__ import annotations

import multiprocessing
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from ._chars import TABLE_END

KINDS = ("email", "phone", "id_number", "address", "name")
#: Tag 0 is outside; of kind i, 1 + 2 i begins a mention and 2 + 2 i goes on with it.
TAGS = 1 + 2 * len(KINDS)
#: Steps whose states become scores together.
BLOCK = 16
#: What symbol 0 adds to the gates for input, memory and output: they are shut whatever the state was.
SHUT = -100.0
#: Symbols: 0 padding and text ends, 1 line ends, 2..96 ASCII from the blank on, then classes of the rest.
OTHERS = {"Ll": 97, "Lu": 98, "Lo": 99, "Lm": 99, "Lt": 98, "Nd": 100, "Pd": 101, "Zs": 2, "Mn": 102, "Mc": 102, "Cf": 103, "Pi": 105, "Pf": 105}
SYMBOLS = 106


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    table = np.full(0x110000, 104, np.uint8)
    table[:TABLE_END] = [OTHERS.get(unicodedata.category(chr(c)), 104) for c in range(TABLE_END)]
    table[:128] = 104
    table[32:127] = np.arange(2, 97)
    table[[9, 10, 13]] = 1
    table[0] = 0
    return table


class Model:
    """x: symbols to gates, of both directions (2, SYMBOLS, 4 H); u: state to gates; o, b: states to tags; t: transitions (from, to)."""

    NAMES = ("x", "u", "o", "b", "t")

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update({k: np.array(parts[k], np.float32, order="C") for k in self.NAMES})
        self.size = self.u.shape[1]
        self.x[:, 0, : 3 * self.size] = SHUT

    @classmethod
    def new(cls, size: int, seed: int) -> Model:
        r = np.random.default_rng(seed)
        x = r.normal(0, 0.25, (2, SYMBOLS, 4 * size))
        x[:, :, : 3 * size] += 0.5
        x[:, :, size : 2 * size] += 0.25
        u = r.normal(0, 0.5 / np.sqrt(size), (2, size, 4 * size))
        t = np.where(allowed(), 0.0, -30.0)
        return cls(x=x, u=u, o=r.normal(0, 0.3, (2 * size, TAGS)), b=np.zeros(TAGS), t=t)

    @classmethod
    def load(cls, path: str) -> Model:
        with np.load(path) as parts:
            return cls(**{k: parts[k].astype(np.float32) for k in cls.NAMES})

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: getattr(self, k).astype(np.float16) for k in self.NAMES})

    def states(self, symbols: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(steps, windows, 2 H) of symbols (windows, steps). keep: gets what the way back needs."""
        n, steps = symbols.shape
        h = self.size
        out = np.empty((steps, n, 2 * h), np.float32)
        for s, state in enumerate(self._run(symbols, keep)):
            out[s, :, :h] = state[0]
            out[steps - 1 - s, :, h:] = state[1]
        return out

    def _run(self, symbols: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """States of both directions (2, windows, H), step by step, in one buffer unless they are kept; the second direction begins at the end."""
        n, steps = symbols.shape
        h = self.size
        there = np.ascontiguousarray(symbols.T).astype(np.intp)
        both = np.stack((there, there[::-1] + SYMBOLS), 1)
        table = self.x.reshape(-1, 4 * h)
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        gates, told = np.empty((2, n, 4 * h), np.float32), np.empty((2, n, 4 * h), np.float32)
        # bounds as whole arrays: one pass over contiguous memory each
        low, high, one, minus = np.zeros_like(gates), np.ones_like(gates), np.ones_like(state), -np.ones_like(state)
        low[:, :, 3 * h :] = -1
        for s in range(steps):
            if keep is not None:
                gates = np.empty_like(gates)
            np.matmul(state, self.u, out=gates)
            np.take(table, both[s], axis=0, out=told, mode="clip")
            gates += told
            i, f, o, g = (gates[:, :, k * h : (k + 1) * h] for k in range(4))
            np.maximum(gates, low, out=gates)
            np.minimum(gates, high, out=gates)
            if keep is not None:
                keep.append((gates, cell, state))
                cell = f * cell + i * g
                state = np.clip(cell, -1, 1) * o
            else:
                cell *= f
                g *= i
                cell += g
                np.maximum(cell, minus, out=state)
                np.minimum(state, one, out=state)
                state *= o
            yield state

    def emissions(self, symbols: np.ndarray) -> np.ndarray:
        """(windows, steps, tags). States become scores block by block."""
        n, steps = symbols.shape
        h = self.size
        out = np.empty((n, steps, TAGS), np.float32)
        out[:] = self.b
        block = np.empty((2, min(BLOCK, steps), n, h), np.float32)
        to = np.stack((self.o[:h], self.o[h:]))
        at = 0
        for s, state in enumerate(self._run(symbols)):
            block[:, at] = state
            at += 1
            if at == block.shape[1] or s == steps - 1:
                there, back = (np.matmul(block[d, :at].reshape(-1, h), to[d]).reshape(at, n, TAGS).transpose(1, 0, 2) for d in (0, 1))
                out[:, s + 1 - at : s + 1] += there
                out[:, steps - 1 - s : steps - 1 - s + at] += back[:, ::-1]
                at = 0
        return out


def allowed() -> np.ndarray:
    """Which tag may follow which: a mention goes on only with its own kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[1 + 2 * k, inside], inside] = True
    return ok


def clear_margins(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margin, entry) of the tags (outside has none): where "outside" scores higher than each tag by more than the tag's margin, the best path goes outside there, unless
    it goes on inside a mention at the next position.

    Whatever came before, a tag's best path to a position exceeds that of "outside" by at most its score over that of "outside" and the most that a step into
    the tag is better than a step outside from the same tag (entry). What follows, outside or a new mention, adds at most the greatest difference of the steps to it."""
    ok = allowed()
    entry = np.where(ok, t - t[:, :1], -np.inf).max(0)
    after = (t - t[:1])[:, [0, *range(1, TAGS, 2)]].max(1)
    return (entry + after)[1:], entry[1:]


def viterbi(emissions: np.ndarray, lengths: np.ndarray, t: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (windows, steps) of sequences that end outside, and the tag each comes from. first: scores (windows, tags) of the tags before, 0 for outside; without it all come from outside."""
    order = np.argsort(lengths, kind="stable")
    emissions, lengths = emissions[order], lengths[order]
    n, steps, tags = emissions.shape
    back = np.empty((steps, n, tags), np.int8)
    if first is None:
        score = emissions[:, 0] + t[0]
        score[:, 2::2] -= 30
        back[0] = 0
    else:
        every = first[order][:, :, None] + t
        back[0] = every.argmax(1)
        score = every.max(1) + emissions[:, 0]
    # shorter sequences come first, so those still going on at a step are the last ones
    going = np.searchsorted(lengths, np.arange(steps + 1), side="right")
    final = np.empty((n, tags), np.float32)
    for s in range(1, steps + 1):
        done = going[s] - going[s - 1]
        if done:
            final[going[s - 1] : going[s]] = score[:done]
            score = score[done:]
        if going[s] == n:
            break
        every = score[:, :, None] + t
        back[s, going[s] :] = every.argmax(1)
        score = every.max(1)
        score += emissions[going[s] :, s]
    tag = (final + t[:, 0]).argmax(1)
    out = np.zeros((n, steps), np.int8)
    row = np.arange(n)
    for s in range(int(lengths[-1]) - 1 if n else -1, -1, -1):
        k = going[s]
        out[k:, s] = tag[k:]
        tag[k:] = back[s, row[k:], tag[k:]]
    undo = np.empty(n, np.int64)
    undo[order] = row
    return out[undo], tag[undo]


def gradients(m: Model, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss a character of windows with their true tags, and its gradients: the negative log likelihood of the path, and that of each position's tag
    by its scores alone, which keeps scores outside of mentions clear by themselves."""
    n, steps = symbols.shape
    h = m.size
    keep: list = []
    out = m.states(symbols, keep)
    e = (out.reshape(-1, 2 * h) @ m.o + m.b).reshape(steps, n, TAGS).astype(np.float64)
    t = m.t.astype(np.float64)
    alpha, beta = np.empty_like(e), np.zeros_like(e)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

    alpha[0] = e[0]
    for s in range(1, steps):
        alpha[s] = lse(alpha[s - 1][:, :, None] + t, 1) + e[s]
    for s in range(steps - 2, -1, -1):
        beta[s] = lse(t + (e[s + 1] + beta[s + 1])[:, None, :], 2)
    z = lse(alpha[-1], 1)
    y = tags.T
    w, ss = np.arange(n), np.arange(steps)
    gold = e[ss[:, None], w, y].sum(0) + t[y[:-1], y[1:]].sum(0)
    total = n * steps
    alone = e - lse(e, 2)[:, :, None]
    loss = float(((z - gold).sum() - alone[ss[:, None], w, y].sum()) / total)
    de = np.exp(alpha + beta - z[None, :, None]) + np.exp(alone)
    de[ss[:, None], w, y] -= 2
    dt = np.zeros_like(t)
    for s in range(1, steps):
        dt += np.exp(alpha[s - 1][:, :, None] + t + (e[s] + beta[s])[:, None, :] - z[:, None, None]).sum(0)
    np.subtract.at(dt, (y[:-1].ravel(), y[1:].ravel()), 1)
    de = (de / total).astype(np.float32)
    flat = de.reshape(-1, TAGS)
    grads = {"o": out.reshape(-1, 2 * h).T @ flat, "b": flat.sum(0), "t": (dt / total * allowed()).astype(np.float32)}
    dout = (flat @ m.o.T).reshape(steps, n, 2 * h)
    dx, du = np.zeros_like(m.x), np.zeros_like(m.u)
    dstate, dcell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
    both = np.stack((symbols.T, symbols.T[::-1]))
    onehot = np.arange(SYMBOLS)[:, None]
    for s in range(steps - 1, -1, -1):
        act, before, state = keep[s]
        i, f, o, g = (act[:, :, k * h : (k + 1) * h] for k in range(4))
        cell = f * before + i * g
        dh = dstate + np.stack((dout[s, :, :h], dout[steps - 1 - s, :, h:]))
        clipped = np.clip(cell, -1, 1)
        dc = dcell + dh * o * (np.abs(cell) < 1)
        d = np.concatenate((dc * g, dc * before, dh * clipped, dc * i), 2)
        open_ = (act > 0) & (act < 1)
        open_[:, :, 3 * h :] = np.abs(g) < 1
        d *= np.where(open_, 1, 0.02)
        d *= (both[:, s] != 0)[:, :, None]
        for k in (0, 1):
            du[k] += state[k].T @ d[k]
            dx[k] += (both[k, s] == onehot).astype(np.float32) @ d[k]
        dstate = np.matmul(d, m.u.transpose(0, 2, 1))
        dcell = dc * f
    dx[:, 0] = 0
    grads["x"], grads["u"] = dx, du
    return loss, grads


_shared: list = []


def _part(task: tuple[dict, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    parts, pick = task
    return gradients(Model(**parts), _shared[0][pick], _shared[1][pick])


def train(m: Model, symbols: np.ndarray, tags: np.ndarray, epochs: int, rate: float = 6e-3, batch: int = 448, workers: int = 7, seed: int = 0, tell=print) -> None:
    """Adam over shuffled windows, in place; the rate falls to a twentieth. Batches are shared out among forked workers."""
    r = np.random.default_rng(seed)
    first = {k: np.zeros_like(getattr(m, k)) for k in m.NAMES}
    second = {k: np.zeros_like(getattr(m, k)) for k in m.NAMES}
    done, total = 0, epochs * (len(symbols) // batch)
    _shared[:] = [symbols, tags]
    with multiprocessing.get_context("fork").Pool(workers) as pool:
        for epoch in range(epochs):
            order, losses = r.permutation(len(symbols)), []
            for at in range(0, len(order) - batch + 1, batch):
                parts = {k: getattr(m, k) for k in m.NAMES}
                each = pool.map(_part, [(parts, p) for p in np.array_split(order[at : at + batch], workers)], chunksize=1)
                losses.append(float(np.mean([x for x, _ in each])))
                grads = {k: sum(g[k] for _, g in each) / workers for k in m.NAMES}
                done += 1
                step = rate * (1 - 0.95 * done / total)
                scale = min(1.0, 1.0 / max(np.sqrt(sum(float((g**2).sum()) for g in grads.values())), 1e-9))
                for k, g in grads.items():
                    g = g * scale
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    value = getattr(m, k)
                    value -= step * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-8)
            tell(f"epoch {epoch}: loss {np.mean(losses):.5f}")
