"""Greatest sequence ratio (Ratcliff-Obershelp) of texts among many others, without leaving out any pair that could have it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Depth to which the states of a text are kept for the next one, which begins alike; words of 64 bits of all tables of a chunk.
DEEP, WORDS = 16, 4_000_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Chunk:
    """Texts whose longest common subsequences with one other text are found all at once: a bit a character, a column a text (Hyyrö 2004)."""

    def __init__(self, names: list[str | None], texts: list[str]) -> None:
        self.names, self.texts = names, texts
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.words = max(1, -(-int(self.sizes.max()) // 64))
        chars, code = np.unique(_codes("".join(texts)), return_inverse=True)
        row = np.repeat(np.arange(len(texts)), self.sizes)
        at = np.arange(len(code)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        masks = np.zeros((len(chars), self.words, len(texts)), np.uint64)
        np.bitwise_or.at(masks, (code, at >> 6, row), np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)))
        self.masks = {chr(c): m for c, m in zip(chars.tolist(), masks, strict=True)}
        self.rows: dict[str | None, list[int]] = {}
        for i, n in enumerate(names):
            self.rows.setdefault(n, []).append(i)
        self.states = [np.full((self.words, len(texts)), ~np.uint64(0))]
        self.space: list[np.ndarray] = []
        self.u, self.v = np.empty_like(self.states[0]), np.empty_like(self.states[0])

    def _step(self, have: np.ndarray, mask: np.ndarray, out: np.ndarray) -> None:
        """One more character of the other text."""
        np.bitwise_and(have, mask, out=self.u)
        np.add(have, self.u, out=self.v)
        if self.words > 1:
            over = self.v < self.u
            for w in range(1, self.words):
                self.v[w] += over[w - 1]
                over[w] |= over[w - 1] & (self.v[w] == 0)
        np.subtract(have, self.u, out=self.u)
        np.bitwise_or(self.u, self.v, out=out)

    def common(self, text: str, known: int) -> np.ndarray:
        """Characters of the longest common subsequence of text with each. known: characters at its beginning that the text before had too."""
        s = self.states
        del s[min(known, DEEP) + 1 :]
        for d in range(len(s) - 1, len(text)):
            have, mask = s[-1], self.masks.get(text[d])
            if mask is not None:
                k = min(d, DEEP)
                while len(self.space) <= k:
                    self.space.append(np.empty_like(self.u))
                self._step(have, mask, self.space[k])
                have = self.space[k]
            if len(s) > DEEP + 1:
                s[-1] = have
            else:
                s.append(have)
        ones = np.bitwise_count(s[-1])
        return 64 * self.words - (ones[0].astype(np.int64) if self.words == 1 else ones.sum(0, dtype=np.int64))


def chunks(names: list[str | None], texts: list[str], block: int, deepest: int) -> Iterator[Chunk]:
    """Cut so that no chunk has more than block texts, and few where texts or alphabets are large. deepest: characters of the longest other text."""
    at = 0
    while at < len(texts):
        n = min(block, len(texts) - at)
        while n > 1 and (len(set("".join(texts[at : at + n]))) + min(deepest, DEEP) + 4) * -(-max(map(len, texts[at : at + n])) // 64) * n > WORDS:
            n //= 2
        yield Chunk(names[at : at + n], texts[at : at + n])
        at += n


class Search:
    """The best of what each text has met so far, (ratio, name), first name on ties."""

    def __init__(self, names: list[str | None], texts: list[str]) -> None:
        order = sorted(range(len(texts)), key=texts.__getitem__)
        self.names, self.texts = [names[i] for i in order], [texts[i] for i in order]
        self.best: list[tuple[float, str] | None] = [None] * len(order)
        self.shared = [0] * len(order)
        for i in range(1, len(order)):
            x, y = self.texts[i - 1][:DEEP], self.texts[i][:DEEP]
            self.shared[i] = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        self.deepest = max(map(len, texts), default=0)

    def meet(self, c: Chunk) -> None:
        """The matched blocks are a common subsequence, so its greatest length bounds the ratio: pairs are compared by falling bound until no other can reach the best."""
        for i, text in enumerate(self.texts):
            common = c.common(text, self.shared[i] if i else 0)
            common[c.rows.get(self.names[i], [])] = -1
            total = c.sizes + len(text)
            if self.best[i] is None:
                k = int(np.argmax(common / np.maximum(total, 1)))
                if common[k] < 0:
                    continue
                self._compare(i, c, k)
            hit = np.flatnonzero((common >= total * (self.best[i][0] / 2) - 1e-6) & (common >= 0))
            bound = np.where(total[hit] > 0, 2.0 * common[hit] / np.maximum(total[hit], 1), 1.0)
            for k in np.argsort(-bound, kind="stable").tolist():
                least, first = self.best[i]
                if bound[k] < least:
                    break
                if bound[k] > least or c.names[hit[k]] < first:
                    self._compare(i, c, int(hit[k]))

    def _compare(self, i: int, c: Chunk, k: int) -> None:
        from difflib import SequenceMatcher

        got, now = SequenceMatcher(None, self.texts[i], c.texts[k], autojunk=False).ratio(), self.best[i]
        if not now or got > now[0] or (got == now[0] and c.names[k] < now[1]):
            self.best[i] = (got, c.names[k])

    def rows(self) -> pa.RecordBatch:
        found = [(n, b[1], b[0]) for n, b in zip(self.names, self.best, strict=True) if b]
        name, other, ratio = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(other, pa.string()), pa.array(ratio, pa.float64())], names=["name", "other", "ratio"])


def best_ratios(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """(name, other, ratio) of a partition of rows (whether it is of the other side, name, template): first the texts in question, then all that they meet."""
    own: tuple[list, list] = ([], [])
    search, names, texts = None, [], []
    for batch in batches:
        for side, name, text in zip(*(x.to_pylist() for x in batch.columns[:3]), strict=True):
            if not side:
                own[0].append(name)
                own[1].append(text or "")
                continue
            names.append(name)
            texts.append(text or "")
            if len(names) == block:
                search = search or Search(*own)
                for c in chunks(names, texts, block, search.deepest):
                    search.meet(c)
                names, texts = [], []
    search = search or Search(*own)
    for c in chunks(names, texts, block, search.deepest):
        search.meet(c)
    yield search.rows()
