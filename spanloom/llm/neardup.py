"""Near-duplicate records: BagMinHash signatures, bands, and a check of the overlap by the words themselves.

Equal texts are one class. Classes that share a band are candidates; the texts of a candidate pair are compared by their shingles as they stand, not by hashes.
A band key that many classes of a step of texts share leaves the task as one row, and candidates of a key are made in blocks of bounded size, so a key that a third
of all rows have is neither one task's work nor one task's memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import cut, join_hot, spread
from ._chars import by_steps, char_runs, char_shingles, word_runs, word_shingles
from ._hot import grouped, shared_rows
from .bagminhash import band_keys, signatures
from .groups import components

#: Classes that one task remembers so as not to send the bands of copies again; beyond it, it forgets them and sends some again.
REMEMBERED = 200_000
#: Classes of a block of candidates.
BLOCK = 1000


def _some_words(size: int) -> Callable[[Column], Column]:
    # anchored and possessive: one pass over a text of whatever length
    return lambda text: text.rlike(r"^[^\p{L}\p{N}]*+(?:[\p{L}\p{N}]++[^\p{L}\p{N}]++){%d}[\p{L}\p{N}]" % (size - 1))


@dataclass(frozen=True)
class Likeness:
    """What is compared and how. shingle: from texts, size -> (text, hash, count); runs: from texts, size -> all shingles as they stand; weighted: counts matter.

    A pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands: 0.984 at the threshold of TEXT, above 0.998 from
    s = 0.55 on; 0.994 at that of NAME, above 0.9999 from s = 0.7 on."""

    shingle: Callable
    runs: Callable
    size: int
    threshold: float
    rows: int
    bands: int
    weighted: bool = False

    def enough(self, text: Column) -> Column:
        """Whether a text has a shingle."""
        return (F.length(text) >= self.size) if self.runs is char_runs else _some_words(self.size)(text)


#: Distinct runs of three words, half of them in common; distinct pieces of three characters, 0.6 in common; the general default.
TEXT = Likeness(word_shingles, word_runs, 3, 0.5, 4, 64)
NAME = Likeness(char_shingles, char_runs, 3, 0.6, 5, 64)
WORDS5 = Likeness(word_shingles, word_runs, 5, 0.8, 8, 32, weighted=True)


def _banded(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for batch in batches:
        every = batch.column(0).to_numpy()
        sides = np.array(batch.column(2).to_pylist(), bool) if batch.num_columns > 2 else None
        texts = batch.column(1).to_pylist()
        for lo, hi in by_steps(texts):
            if len(seen) > REMEMBERED:
                seen.clear()
            pick = []
            for i in range(lo, hi):
                s = (int(every[i]), None if sides is None else bool(sides[i]))
                if s not in seen:
                    seen.add(s)
                    pick.append(i)
            of, run, count = like.shingle([texts[i] for i in pick], like.size)
            some = np.bincount(of, minlength=len(pick)) > 0
            own = np.array(pick, np.int64)[some]
            if not len(own):
                continue
            keys = band_keys(signatures((np.cumsum(some) - 1)[of], run, count if like.weighted else None, len(own), like.rows * like.bands), like.rows)
            yield grouped(keys.reshape(-1).view(np.int64), np.repeat(every[own], like.bands), None if sides is None else np.repeat(sides[own], like.bands))


def _alike(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose texts overlap enough, by their shingles as they stand."""
    bag = Counter if like.weighted else frozenset
    for batch in batches:
        left, right = (batch.column(i).dictionary_encode() for i in (2, 3))
        one, two = ([bag(x) for x in like.runs(c.dictionary.to_pylist(), like.size)] for c in (left, right))
        total = (lambda x: sum(x.values())) if like.weighted else len
        size_one, size_two = [total(x) for x in one], [total(x) for x in two]
        kept, found = [], []
        for i, (x, y) in enumerate(zip(left.indices.to_pylist(), right.indices.to_pylist(), strict=True)):
            m, n = size_one[x], size_two[y]
            if min(m, n) >= like.threshold * max(m, n) - 1e-9:
                both = total(one[x] & two[y])
                if (s := both / (m + n - both)) >= like.threshold - 1e-12:
                    kept.append(i)
                    found.append(s)
        at = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.float64())], names=["a", "b", "similarity"])


def classed(rows: DataFrame, text: str, like: Likeness, *others: str) -> DataFrame:
    """(*others, sid, text) of the rows whose text has a shingle. sid: the class, which equal texts share."""
    return rows.select(*others, F.xxhash64(text).alias("sid"), F.col(text).alias("text")).where(like.enough(F.col("text")))


def shared_bands(classes: DataFrame, like: Likeness, side: str | None = None) -> DataFrame:
    """(key, sid[, side]): the classes of each band key that more than one class has; with side, of each that classes of both sides have. Computed once."""
    bands = spread(classes.select("sid", "text", *([side] if side else []))).mapInArrow(partial(_banded, like=like), "key bigint, sid bigint")
    return shared_rows(bands, side is not None)


def block_join(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """left(key, x) join right(key, y) on key, a group of m and n rows in blocks of about block x block, so a hot key is spread over many tasks."""
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    m, n = left.groupBy("key").agg(F.count(F.lit(1)).alias("m")), right.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sizes = m.join(n, "key").select("key", parts("m").alias("p"), parts("n").alias("q"))
    one = left.join(sizes, "key").select("key", "x", F.pmod(F.xxhash64("x"), "p").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"))
    two = right.join(sizes, "key").select("key", "y", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), F.pmod(F.xxhash64("y"), "q").cast("int").alias("j"))
    return one.join(two, ["key", "i", "j"]).select("key", "x", "y")


def texts_of(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, text): one text of each wanted class, computed once."""
    return cut(classes.select("sid", "text").join(wanted.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"]))


def verified(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """(a, b, similarity) of the pairs(a, b) whose texts are similar enough."""
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(partial(_alike, like=like), "a bigint, b bigint, similarity double")


def similar_classes(classes: DataFrame, like: Likeness) -> DataFrame:
    """(a, b, similarity), a < b: pairs of different classes whose similarity reaches the threshold."""
    shared = shared_bands(classes, like)
    pairs = block_join(shared.toDF("key", "x"), shared.toDF("key", "y")).where("x < y")
    pairs = cut(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    texts = texts_of(classes, pairs.select(F.explode(F.array("a", "b")).alias("sid")))
    return verified(pairs, texts, like)


def near_duplicate_pairs(rows: DataFrame, key: str, text: str, like: Likeness) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all pairs of rows whose texts are at least as similar as the threshold, equal ones too.

    Null and blank texts, and those too short for a shingle, are in no pair. Rows with equal keys are one."""
    classes = classed(rows.select(F.col(key).alias("k"), F.col(text).alias("t")), "t", like, "k")
    member = cut(classes.select("k", "sid").distinct())
    links = similar_classes(classes, like)
    one, two = member.toDF("key_a", "a"), member.toDF("key_b", "b")
    within = block_join(member.toDF("x", "key"), member.toDF("y", "key")).where("x < y").select(F.col("x").alias("key_a"), F.col("y").alias("key_b"))
    across = links.join(one, "a").join(two, "b").select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
    return within.unionByName(across.where("key_a < key_b"))


def near_duplicate_groups(rows: DataFrame, key: str, text: str, like: Likeness) -> DataFrame:
    """(key, group_id, class_rows, links): for each row with shingles its group through links (the smallest key in it), how many rows have its very
    text, and with how many other texts it is linked. Copies are never paired."""
    classes = classed(rows.select(F.col(key).alias("k"), F.col(text).alias("t")), "t", like, "k")
    member = cut(classes.select("k", "sid").distinct())
    links = cut(similar_classes(classes, like).select("a", "b"))
    ends = links.union(links.select("b", "a")).groupBy(F.col("a").alias("sid")).agg(F.count(F.lit(1)).alias("links"))
    edge = F.xxhash64("a", "b")
    nodes = links.select(F.col("a").alias("node"), edge.alias("key")).union(links.select(F.col("b"), edge))
    group = components(nodes).toDF("sid", "component")
    own = member.groupBy("sid").agg(F.count(F.lit(1)).alias("class_rows"), F.min("k").alias("least")).join(ends, "sid", "left").join(group, "sid", "left")
    own = cut(own.select("sid", F.coalesce("component", "sid").alias("component"), "class_rows", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), "least"))
    first = cut(own.groupBy("component").agg(F.min("least").alias("group_id"), F.count(F.lit(1)).alias("n")))
    told = cut(join_hot(own, first, ["component"]).select("sid", "group_id", "class_rows", "links", F.col("class_rows").alias("n")))
    return join_hot(member, told, ["sid"]).select(F.col("k").alias(key), "group_id", "class_rows", "links")


def across_classes(classes: DataFrame, ids: DataFrame, like: Likeness, side: str) -> DataFrame:
    """(sid): the classes of true rows of `side` that are similar enough to a class of false ones. ids: sid and side of the classes.

    A class needs one partner only, so not all pairs of a key are compared: first each true class meets the smallest and the greatest false class of its keys; only
    the ones without a partner among these meet all others, in blocks."""
    both = ids.groupBy("sid").agg(F.max(side).alias("e"), F.min(side).alias("t"))
    equal = cut(both.where("e and not t").select("sid"))
    shared = shared_bands(classes, like, side)
    true = shared.where("side").select("key", F.col("sid").alias("x")).distinct().join(equal.toDF("x"), "x", "left_anti").select("key", "x")
    false = shared.where("not side").select("key", F.col("sid").alias("y")).distinct()
    ends = false.groupBy("key").agg(F.array_distinct(F.array(F.min("y"), F.max("y"))).alias("some"))
    first = cut(true.join(ends, "key").select(F.col("x").alias("a"), F.explode("some").alias("b")).distinct())
    texts = texts_of(classes, shared.join(true.select(F.col("key")).distinct(), "key", "left_semi"))
    met = cut(verified(first, texts, like).select(F.col("a").alias("sid")).distinct())
    left = true.join(met.toDF("x"), "x", "left_anti").select("key", "x")
    rest = block_join(left, false).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    return equal.union(met).union(verified(rest, texts, like).select(F.col("a").alias("sid")).distinct())
