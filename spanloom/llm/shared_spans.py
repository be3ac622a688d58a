"""Long stretches that stand letter for letter in more than one document.

Level-wise doubling of windows, from a quarter of the wanted length to half of it to the whole. At the first level windows are picked by content
(the smallest hash among the windows in each stretch of the wanted length), so each such stretch has a pick, the same one wherever the stretch
stands. Only picks that another document repeats are extended to twice the length, to either side, and only those that are repeated on one
side at least go on to the whole length: there each position is a window of its own. Longer windows cover nothing that the windows of the wanted
length don't cover together, so no candidate is left then. Neighbouring positions with one pick form a run. A run that another document
repeats as a whole is a hit as a whole; positions are only looked at alone where runs with one pick differ, as at the ends of a shared stretch.
A rolling hash of 64 bits only chooses candidates: what counts as equal at last, runs and positions, is told by two independent ones, of 128 bits together.

A window that stands in a third of all documents is one row a step of texts, and where rows are joined with what is known of their hash, the few hot hashes meet
them where they lie (join_hot). Texts are only read again in documents that have candidates left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import cut, join_hot, spread
from ._chars import U64, Hashed, Joined, by_steps, mix
from ._hot import grouped, shared_rows

MIN_CHARS = 160
#: Documents with candidates up to which their ids (8 bytes each) may be sent to all tasks; beyond, both sides are shuffled.
BROADCAST_IDS = 500_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of `width` successive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Picks:
    """Of a step of texts, the picked windows of the first level. at: their starts; low, high: first and last start of the wanted length they stand for; of: text."""

    def __init__(self, texts: list[str], wanted: int):
        self.joined = j = Joined(texts)
        self.hashed = Hashed(j.codes)
        first = wanted // 4
        n = len(j.codes)
        self.at = self.low = self.high = self.of = np.zeros(0, np.int64)
        self.hash = np.zeros(0, U64)
        if n < wanted:
            return
        h = mix(self.hashed.windows(first))
        low_bits = U64((1 << max(20, n.bit_length())) - 1)
        pick = (_sliding_min((h & ~low_bits) | np.arange(len(h), dtype=U64), wanted - first + 1) & low_bits).astype(np.int64)
        many = np.maximum(j.ends - j.starts - wanted + 1, 0)
        of = np.repeat(np.arange(len(texts)), many)
        start = np.arange(len(of)) + np.repeat(j.starts - (np.cumsum(many) - many), many)
        pick = pick[start]
        new = np.ones(len(start), bool)
        new[1:] = (pick[1:] != pick[:-1]) | (of[1:] != of[:-1])
        edge = np.flatnonzero(new)
        if len(edge):
            self.at, self.of, self.low = pick[edge], of[edge], start[edge]
            self.high = start[np.append(edge[1:], len(start)) - 1]
            self.hash = h[self.at]

    def keep(self, mask: np.ndarray) -> None:
        self.at, self.of, self.low, self.high, self.hash = (x[mask] for x in (self.at, self.of, self.low, self.high, self.hash))

    def sides(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the picks extended to half the wanted length, to the left and to the right, 0 where the text ends before."""
        first, half = wanted // 4, wanted // 2
        out = []
        for a in (self.at + first - half, self.at):
            inside = (a >= self.joined.starts[self.of]) & (a + half <= self.joined.ends[self.of])
            h = np.zeros(len(a), U64)
            h[inside] = mix(self.hashed.spans(a[inside], a[inside] + half))
            out.append(h)
        return out[0], out[1]


def _listed(of: np.ndarray, values: np.ndarray, lists: list) -> np.ndarray:
    """Whether each value stands, by its upper 61 bits, in the list of its text; of must ascend."""
    mask = np.zeros(len(of), bool)
    edge = np.searchsorted(of, np.arange(len(lists) + 1))
    for i, have in enumerate(lists):
        if edge[i] < edge[i + 1]:
            mask[edge[i] : edge[i + 1]] = np.isin(values[edge[i] : edge[i + 1]].view(np.int64) >> 3, np.array(have, np.int64))
    return mask


def _rows(doc: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return grouped(h[new].view(np.int64), doc[new], None)


def _quarter(batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, texts = batch.column(0).to_numpy(), [x or "" for x in batch.column(1).to_pylist()]
        for lo, hi in by_steps(texts):
            p = Picks(texts[lo:hi], wanted)
            yield _rows(doc[lo:hi][p.of], p.hash)


def _half(batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, texts, marks = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for lo, hi in by_steps(texts):
            p = Picks(texts[lo:hi], wanted)
            p.keep(_listed(p.of, p.hash, marks[lo:hi]))
            left, right = p.sides(wanted)
            whose, h = np.concatenate((p.of, p.of)), np.concatenate((left, right))
            yield _rows(doc[lo:hi][whose[h != 0]], h[h != 0])


def _whole(batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, texts, marks = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for lo, hi in by_steps(texts):
            p = Picks(texts[lo:hi], wanted)
            left, right = p.sides(wanted)
            p.keep(_listed(p.of, left, marks[lo:hi]) | _listed(p.of, right, marks[lo:hi]))
            base = p.joined.starts[p.of]
            run, again = (mix(h.spans(p.low, p.high + wanted) + (p.high - p.low).astype(U64)).view(np.int64) for h in (p.hashed, Hashed(p.joined.codes, second=True)))
            columns = [doc[lo:hi][p.of], p.low - base, p.high - base, p.hash.view(np.int64), run, again]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["doc", "low", "high", "pick", "run", "again"])


def _positions(batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, texts, marks = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for lo, hi in by_steps(texts):
            joined = Joined(texts[lo:hi])
            spans = [(i, r["low"], r["high"]) for i, m in enumerate(marks[lo:hi]) for r in m]
            of, low, high = np.array(spans, np.int64).reshape(-1, 3).T
            many = high - low + 1
            whose = np.repeat(of, many)
            at = np.arange(len(whose)) + np.repeat(low - (np.cumsum(many) - many), many)
            start = at + joined.starts[whose]
            h, again = (mix(Hashed(joined.codes, second).spans(start, start + wanted)).view(np.int64) for second in (False, True))
            yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi][whose]), pa.array(at), pa.array(h), pa.array(again)], names=["doc", "at", "h", "again"])


def _marks(sent: DataFrame) -> DataFrame:
    """(doc, mark): the hashes of each document that another one has too."""
    return shared_rows(sent).groupBy(F.col("sid").alias("doc")).agg(F.collect_set("key").alias("mark"))


def _with_texts(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc, text, mark) of the documents that have marks; others are dropped before the shuffle while their ids are few enough to be sent."""
    marks = cut(marks)
    ids = marks.select("doc")
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "doc", "left_semi")
    return texts.join(marks, "doc").select("doc", "text", "mark")


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: int = MIN_CHARS) -> DataFrame:
    """(key, span_start, span_end): the maximal stretches of each text in which every character lies in a span of `wanted` code points or more that also stands in
    the text of another key. Overlapping and touching stretches are one.

    Repeats within a document do not count, nor do those between rows of one key. Null, empty and shorter texts, and rows with a null key, have none. Whole texts are used.
    """
    if wanted < 8:
        raise ValueError("at least 8 characters")
    texts = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where((F.length(text) >= wanted) & F.col(key).isNotNull())
    marks = _marks(spread(texts).mapInArrow(partial(_quarter, wanted=wanted), "key bigint, sid bigint"))
    marks = _marks(_with_texts(texts, marks).mapInArrow(partial(_half, wanted=wanted), "key bigint, sid bigint"))
    runs = cut(_with_texts(texts, marks).mapInArrow(partial(_whole, wanted=wanted), "doc bigint, low bigint, high bigint, pick bigint, run bigint, again bigint"))

    count = F.count(F.lit(1)).alias("n")
    by_run = cut(runs.groupBy("pick", "run", "again").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), count))
    picks = cut(by_run.groupBy("pick").agg((F.min("run") != F.max("run")).alias("several"), F.min("a").alias("x"), F.max("b").alias("y"), count).selectExpr("pick", "several and x < y as mixed", "n"))
    by_run = cut(join_hot(by_run.withColumnRenamed("n", "rows"), picks, ["pick"]).withColumnRenamed("rows", "n"))
    told = cut(join_hot(runs, by_run, ["pick", "run", "again"]))
    hits = told.where("a < b").select("doc", F.col("low").alias("s"), (F.col("high") + wanted).alias("e"))
    alone = told.where("mixed and (a = b or doc = a or doc = b)").groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("mark"))
    spots = cut(_with_texts(texts, alone).mapInArrow(partial(_positions, wanted=wanted), "doc bigint, at bigint, h bigint, again bigint"))
    at = cut(spots.groupBy("h", "again").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), count).where("a < b").drop("a", "b"))
    spots = join_hot(spots, at, ["h", "again"]).select("doc", F.col("at").alias("s"), (F.col("at") + wanted).alias("e"))

    order = Window.partitionBy("doc").orderBy("s", "e")
    spans = hits.unionByName(spots).withColumn("upto", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("new", F.when(F.col("s") <= F.col("upto"), 0).otherwise(1)).withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc", "n").agg(F.min("s").cast("int").alias("span_start"), F.max("e").cast("int").alias("span_end")).select(F.col("doc").alias(key), "span_start", "span_end")


def shared_share(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: int = MIN_CHARS) -> DataFrame:
    """(key, n_chars, stretches, shared_chars, share): for every row how much of its text is shared; 0 for null and empty texts."""
    found = shared_spans(docs, key, text, wanted).groupBy(key).agg(F.count(F.lit(1)).alias("stretches"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = docs.select(F.col(key).cast("bigint").alias(key), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"))
    zero = F.lit(0).cast("bigint")
    out = sizes.join(found, key, "left").select(key, "n_chars", F.coalesce("stretches", zero).alias("stretches"), F.coalesce("shared_chars", zero).alias("shared_chars"))
    return out.withColumn("share", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)))
