"""Edit-distance segment join of evaluation texts with training texts.

A text within k edits of another holds at least one of the other's k + 1 segments letter for letter, at a place that is off by no more than the edits before and after it
allow. Evaluation texts are cut into k + 1 segments; of a training text the substrings at the allowed places are looked up, for each length an evaluation text may have. Segments
and substrings meet as hashes of (length, segment, characters) in an equi-join; candidates are verified by dynamic programming in a band of k to either side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import cut, spread
from ._chars import U64, Hashed, Joined, by_steps, mix

EDITS = 3


def distance_within(a: str, b: str, most: int) -> int | None:
    """Edit distance (insertion, deletion, replacement), None if more than `most`."""
    if abs(len(a) - len(b)) > most:
        return None
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    back = 0
    while back < high - low and a[len(a) - 1 - back] == b[len(b) - 1 - back]:
        back += 1
    a, b = a[low : len(a) - back], b[low : len(b) - back]
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if j == 0 else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
        if min(new.values()) > most:
            return None
        row = new
    found = row.get(len(b), far)
    return found if found <= most else None


def _key(length: np.ndarray, segment: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(h + mix(length.astype(U64) * U64(1024) + segment.astype(U64)))


def _bounds(length: np.ndarray, segment: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of a segment: the lengths of all parts differ by one at most."""
    return length * segment // parts, length * (segment + 1) // parts


def _cut(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    part = np.arange(edits + 1)
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for lo, hi in by_steps(texts):
            j = Joined(texts[lo:hi])
            n = (j.ends - j.starts)[:, None] + 0 * part
            s, e = _bounds(n, part[None, :], edits + 1)
            h = Hashed(j.codes).spans((s + j.starts[:, None]).ravel(), (e + j.starts[:, None]).ravel())
            key = _key(n.ravel(), np.tile(part, hi - lo), h)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(ids[lo:hi], edits + 1))], names=["key", "id"])


def _look_up(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    # (length difference, segment, shift) of all places that the edits before and after a segment allow
    grid = np.array([(d, i, s) for d in range(-edits, edits + 1) for i in range(edits + 1) for s in range(-edits, edits + 1) if abs(s) <= i and abs(s - d) <= edits - i], np.int64)
    d, part, shift = grid.T
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for lo, hi in by_steps(texts):
            j = Joined(texts[lo:hi])
            hashed = Hashed(j.codes)
            size = (j.ends - j.starts)[:, None]
            length = size - d[None, :]
            s, e = _bounds(np.maximum(length, 0), part[None, :], edits + 1)
            s, e = s + shift, e + shift
            fits = (length >= 0) & (s >= 0) & (e <= size)
            whose = np.broadcast_to(np.arange(hi - lo)[:, None], fits.shape)[fits]
            h = hashed.spans(s[fits] + j.starts[whose], e[fits] + j.starts[whose])
            key = _key(length[fits], np.broadcast_to(part, fits.shape)[fits], h)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[lo:hi][whose])], names=["key", "id"])


def _verify(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [distance_within(a, b, edits) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        at = pa.array([i for i, x in enumerate(found) if x is not None], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([x for x in found if x is not None], pa.int32())], names=["evaluation", "training", "distance"])


def edit_join(evaluation: DataFrame, training: DataFrame, text: str = "text", edits: int = EDITS) -> DataFrame:
    """(evaluation, training, distance): hashes of the distinct texts of both sides that are at most `edits` edits apart, equal ones (0) too. Null texts are left out.

    Copies count once: hash the texts of rows with xxhash64 to join them to a pair. A text of up to `edits` characters has empty segments and meets all of its length."""
    one, two = (d.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("id"), F.col(text).alias("t")).dropDuplicates(["id"]) for d in (evaluation, training))
    one, two = spread(one), spread(two)
    left = one.mapInArrow(partial(_cut, edits=edits), "key bigint, id bigint").toDF("key", "evaluation")
    right = two.mapInArrow(partial(_look_up, edits=edits), "key bigint, id bigint").toDF("key", "training")
    pairs = cut(left.join(right, "key").select("evaluation", "training").distinct())
    both = pairs.join(one.toDF("evaluation", "a"), "evaluation").join(two.toDF("training", "b"), "training").select("evaluation", "training", "a", "b")
    return both.mapInArrow(partial(_verify, edits=edits), "evaluation bigint, training bigint, distance int")
