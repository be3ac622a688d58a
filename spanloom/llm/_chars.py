"""Vectorised character work shared by the text operators.

Texts of an Arrow batch are laid end to end as one array of code points, one separator
after each text, so that a whole batch is handled by a fixed number of numpy passes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, SEP = 0, 1, 2, 3, 4
U64 = np.uint64
#: Odd base of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Base and addend of a second rolling hash, independent of the first: both together have 128 bits.
BASE_2, ADD_1, ADD_2 = 0xC2B2AE3D27D4EB4F, 0x632BE59BD9B4E019, 0xA24BAED4963EE407
BASE_2_INV = pow(BASE_2, -1, 1 << 64)
#: Characters that are handled together; bounds the memory of one step, never what is read.
STEP_CHARS = 1 << 20
#: White space of the Unicode property White_Space (fixed values).
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


#: No letter, number or cased character stands at or above.
TABLE_END = 0x34000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point: letter (L*), number (N*), white space or other."""
    table = np.zeros(0x110000, np.uint8)
    kinds = np.array([x[0] for x in map(unicodedata.category, map(chr, range(TABLE_END)))])
    table[:TABLE_END][kinds == "L"] = LETTER
    table[:TABLE_END][kinds == "N"] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower case of every code point; the ones whose lower case is longer stay."""
    table = np.arange(0x110000, dtype=np.uint32)
    low = [x.lower() for x in map(chr, range(TABLE_END))]
    table[:TABLE_END] = [ord(x) if len(x) == 1 else c for c, x in enumerate(low)]
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base, U64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps, dtype=U64)
    return have[:n]


class Joined:
    """Texts laid end to end. codes: code points, SEP_CODE after each text; starts, ends: of each text."""

    def __init__(self, texts: Sequence[str]):
        self.text = "\x00".join(texts) + "\x00"
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def classes(self) -> np.ndarray:
        k = class_table()[self.codes]
        k[self.ends] = SEP
        return k


class Hashed:
    """Prefix sums from which the hash of any window of codes comes in constant time."""

    def __init__(self, codes: np.ndarray, second: bool = False):
        n = len(codes)
        base, self.inverse = (BASE_2, BASE_2_INV) if second else (BASE, BASE_INV)
        x = mix(codes.astype(U64) + U64(ADD_2 if second else ADD_1))
        x *= powers(n, base)
        self.sums = np.empty(n + 1, U64)
        self.sums[0] = 0
        np.cumsum(x, dtype=U64, out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), the same wherever the same codes stand."""
        h = self.sums[ends] - self.sums[starts]
        h *= powers(len(self.sums), self.inverse)[starts]
        return h

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all windows of a size, in order of their starts."""
        h = self.sums[size:] - self.sums[: len(self.sums) - size]
        h *= powers(len(h), self.inverse)
        return h


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values; the last value must be false."""
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
    return edge[0::2], edge[1::2]


def steps(lengths: np.ndarray, most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of together about `most` characters (one text at least)."""
    at, n = 0, len(lengths)
    total = np.cumsum(lengths + 1)
    while at < n:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield at, to
        at = to


def by_steps(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    yield from steps(np.fromiter(map(len, texts), np.int64, len(texts)))


#: Bits of a shingle's hash that are sorted together with the text's position in its step.
SORTED_BITS = 44


def _distinct(of: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct 64-bit runs of each text with their counts. of must ascend."""
    low = U64(64 - SORTED_BITS)
    key = (of.astype(U64) << U64(SORTED_BITS)) | (run >> low)
    order = np.argsort(key)
    key, run, of = key[order], run[order], of[order]
    if ((key[1:] == key[:-1]) & (run[1:] != run[:-1])).any():
        order = np.lexsort((run, of))
        of, run = of[order], run[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return of[at], run[at], np.diff(at, append=len(run))


def word_shingles(texts: Sequence[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of successive words of each text: the text's position, the run's hash and its count there, ordered by the first two.

    Words are the maximal runs of letters and digits, in simple lower case. Texts with fewer words have no run.
    """
    joined = Joined(texts)
    k = joined.classes()
    starts, ends = runs((k == LETTER) | (k == NUMBER))
    m = len(starts) - words + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(U64), none
    hashes = mix(Hashed(lower_table()[joined.codes]).spans(starts, ends))
    of = np.searchsorted(joined.ends, starts)
    run = np.zeros(m, U64)
    for i in range(words):
        run = mix(run * U64(0xD6E8FEB86659FD93) + hashes[i : i + m])
    whole = of[:m] == of[words - 1 :]
    return _distinct(of[:m][whole], run[whole])


def char_shingles(texts: Sequence[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pieces of `size` characters of each text, as word_shingles gives runs of words."""
    joined = Joined(texts)
    many = np.maximum(joined.ends - joined.starts - size + 1, 0)
    of = np.repeat(np.arange(len(texts)), many)
    if not len(of):
        return of, of.astype(U64), of
    first = np.repeat(joined.starts - (np.cumsum(many) - many), many)
    return _distinct(of, mix(Hashed(joined.codes).windows(size)[np.arange(len(of)) + first]))


def words_of(texts: Sequence[str]) -> list[list[str]]:
    """The words of each text, as word_shingles takes them."""
    joined = Joined(texts)
    k = joined.classes()
    starts, ends = runs((k == LETTER) | (k == NUMBER))
    low = lower_table()[joined.codes].tobytes().decode("utf-32-le", "surrogatepass")
    words = [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    edge = np.searchsorted(starts, joined.ends).tolist()
    return [words[a:b] for a, b in zip([0, *edge], edge, strict=False)]


def word_runs(texts: Sequence[str], size: int) -> list[list[tuple[str, ...]]]:
    """All runs of successive words of each text, as words."""
    return [list(zip(*(w[i:] for i in range(size)), strict=False)) for w in words_of(texts)]


def char_runs(texts: Sequence[str], size: int) -> list[list[str]]:
    """All pieces of `size` characters of each text, as characters."""
    return [[t[i : i + size] for i in range(len(t) - size + 1)] for t in texts]
