"""Encoding of texts with a public byte-level BPE.

The pre-tokenisation is that of the pattern
``'(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
without a regex: each code point has a class, each class a transition function of the automaton that
follows the pattern, and the composition of these functions is scanned. The functions of this automaton
forget all but the class (and for a blank, whether it is U+0020) of the symbol before and need the class
of the symbol after, so the associative scan is closed after one composition to either side: a shifted
comparison of the whole batch. Contractions need no state either: an apostrophe opens a token just where
the run before has ended. The slices go through cached pair merging.

Null and empty texts have no ids. What looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import spread
from ._chars import LETTER, NUMBER, SEP, SPACE, Joined, by_steps

#: Vocabulary as ranks; a parameter of every function here.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: No rank; bytes up to which a slice is merged in a list rather than a heap.
NEVER, SHORT = 1 << 62, 48
#: Slices whose ids are kept by a worker; beyond it the store is emptied and filled anew.
CACHE_SLICES = 400_000


def pre_tokens(joined: Joined) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the slices of all texts."""
    c, k = joined.codes, joined.classes()
    n = len(c)
    before = np.full(n, SEP, np.uint8)
    before[1:] = k[:-1]
    after = np.full(n, SEP, np.uint8)
    after[:-1] = k[1:]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (c[:-1] == 32) & (k[:-1] == SPACE)
    space = k == SPACE
    start = (k != before) & ~(blank_before & ~space)
    start |= space & (after <= NUMBER)
    quote = np.flatnonzero((c == 39) & ((before == LETTER) | (before == NUMBER) | (before == SEP) | ((before == SPACE) & ~blank_before)))
    if len(quote):
        padded = np.concatenate((c, np.zeros(3, c.dtype)))
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(x) for x in "sdmt"])
        long = np.zeros(len(quote), bool)
        for pair in ("ll", "ve", "re"):
            long |= (one == ord(pair[0])) & (two == ord(pair[1]))
        for hit, size in ((quote[short], 2), (quote[long], 3)):
            start[hit + 1] = False
            start[hit + size] = True
    start[joined.ends] = True
    at = np.flatnonzero(start)
    inside = k[at] != SEP
    return at[inside], at[1:][inside[:-1]]


class PairMerger(dict):
    """Ids of a slice; misses are merged and kept."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "replace")
        one = self.ranks.get(raw)
        ids = (one,) if one is not None else tuple(self._short(raw) if len(raw) <= SHORT else self._long(raw))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def _short(self, raw: bytes) -> list[int]:
        """The pair of least rank is merged, the first on ties, until no pair has a rank."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        rank = [self.ranks.get(raw[i : i + 2], NEVER) for i in range(len(raw) - 1)]
        while rank and (least := min(rank)) < NEVER:
            i = rank.index(least)
            parts[i] += parts.pop(i + 1)
            rank.pop(i)
            if i < len(rank):
                rank[i] = self.ranks.get(parts[i] + parts[i + 1], NEVER)
            if i:
                rank[i - 1] = self.ranks.get(parts[i - 1] + parts[i], NEVER)
        return [self.ranks[x] for x in parts]

    def _long(self, raw: bytes) -> list[int]:
        """As _short with a heap of pairs and linked parts, for slices of any length."""
        n = len(raw)
        parts: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (r := self.ranks.get(parts[i] + parts[right[i]])) is not None:
                heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[right[i]])))

        while heap:
            r, i, size = heapq.heappop(heap)
            if parts[i] is None or (j := right[i]) < 0 or len(parts[i]) + len(parts[j]) != size or self.ranks.get(parts[i] + parts[j]) != r:
                continue
            parts[i] += parts[j]
            parts[j] = None
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(i)
            offer(left[i])
        return [self.ranks[x] for x in parts if x is not None]


@lru_cache(maxsize=2)
def merger(ranks_path: str) -> PairMerger:
    return PairMerger(ranks_path)


def encode_texts(texts: list[str], ranks_path: str) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For consecutive groups of texts: all ids, the ids of each text as offsets into them, and of each slice its text, where it begins there and how many ids it has."""
    merge = merger(ranks_path)
    for at, to in by_steps(texts):
        if len(merge) > CACHE_SLICES:
            merge.clear()
        joined = Joined(texts[at:to])
        starts, ends = pre_tokens(joined)
        text = joined.text
        pieces = [merge[text[s:e]] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.fromiter(chain.from_iterable(pieces), np.int32, int(sizes.sum()))
        upto = np.concatenate(([0], np.cumsum(sizes)))
        of = np.searchsorted(joined.ends, starts)
        yield ids, upto[np.searchsorted(starts, np.concatenate((joined.starts, [len(text)])))], (of, starts - joined.starts[of], sizes)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids): the ids of each row's text, empty for a null or an empty one. Rows stay as they are, equal keys too; other columns are not read. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, offsets, _ in encode_texts([x or "" for x in batch.column(1).to_pylist()], ranks_path):
                n = len(offsets) - 1
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), lists], names=[key, "ids"])
                at += n

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def encode_slices(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids, slices): ids as of encode; slices, an array of (char_start, n_ids), tells of each slice of the pre-tokenisation where it begins in the text and how many ids it has, so a place in
    the ids is a place in the text. The ids of a null or an empty text have no slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, offsets, (of, begin, sizes) in encode_texts([x or "" for x in batch.column(1).to_pylist()], ranks_path):
                n = len(offsets) - 1
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                each = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(sizes.astype(np.int32))], names=["char_start", "n_ids"])
                slices = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), each)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), lists, slices], names=[key, "ids", "slices"])
                at += n

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>, slices array<struct<char_start:int,n_ids:int>>")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, n_tokens): the number of ids that encode gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(offsets) for _, offsets, _ in encode_texts([x or "" for x in batch.column(1).to_pylist()], ranks_path)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64))], names=[key, "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")


def decode(ids: DataFrame, key: str = "doc_id", ranks_path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, text): the text of a list of ids; the way back of encode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = {i: x for x, i in merger(ranks_path).ranks.items()}
        for batch in batches:
            texts = [b"".join(map(raw.__getitem__, x or ())).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = ids.schema[key].dataType.simpleString()
    return ids.select(key, F.col("ids")).mapInArrow(run, f"`{key}` {kind}, text string")
