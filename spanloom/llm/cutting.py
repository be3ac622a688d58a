"""Cutting of oversized texts and token windows at natural boundaries, with overlap."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chars import SEP, SPACE, Joined, by_steps

MAX_CHARS, OVERLAP_CHARS = 1200, 120
MAX_TOKENS, OVERLAP_TOKENS = 384, 128
#: Rows of window keys up to which the join with the texts may send them to all tasks (8 bytes each); beyond, both sides are shuffled.
BROADCAST_KEYS = 500_000
#: Characters that end a sentence before white space, and those that end it anywhere (fixed values).
ENDS, WIDE_ENDS = ".!?…;", "。！？"
NEW_LINES = "\n\r\x0b\x0c\x85\u2028\u2029"
KINDS = ("hard", "word", "sentence", "line")


def boundary_ranks(joined: Joined) -> np.ndarray:
    """For each position, how good a cut before it is: 0 none, 1 word end, 2 sentence end, 3 line end."""
    c, k = joined.codes, joined.classes()
    rank = np.zeros(len(c) + 1, np.uint8)
    line = np.isin(c, [ord(x) for x in NEW_LINES])
    line[:-1] &= ~((c[:-1] == 13) & (c[1:] == 10))
    space = k == SPACE
    after = np.ones(len(c), bool)
    after[:-1] = ~space[1:] & (k[1:] != SEP)
    end = np.isin(c, [ord(x) for x in ENDS])
    sentence = np.zeros(len(c), bool)
    sentence[1:] = space[1:] & end[:-1]
    wide = np.isin(c, [ord(x) for x in WIDE_ENDS])
    word = space & after
    rank[1:][word] = 1
    rank[1:][sentence | wide] = 2
    rank[1:][line] = 3
    return rank


def cuts(ranks: list[np.ndarray], n: int, most: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, rank of the end) of the pieces of 0..n. ranks: sorted positions of sentence or line ends, then of word ends.

    The end of a piece is the last of the better boundaries in the second half of what it may hold, else the last word end that
    leaves more than the overlap, else the limit. The next piece starts `overlap` before it.
    """
    at = 0
    while n - at > most:
        end, kind = at + most, 0
        for positions, least, name in ((ranks[0], at + max(most // 2, overlap), 2), (ranks[1], at + overlap, 1)):
            i = bisect_right(positions, at + most) - 1
            if i >= 0 and positions[i] > least:
                end, kind = positions[i], name
                break
        yield at, end, kind
        at = end - overlap
    yield at, n, 3


def cut_texts(records: DataFrame, key: str = "record_idx", text: str = "text", most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(key, piece_index, piece_start, piece_end, end_kind, piece): the pieces of every text of more than `most` code points.

    Neighbours share exactly `overlap` code points; without them the pieces give back the text. Shorter, empty and null texts
    give no row; equal keys are cut each. Short texts never reach Python, nothing is shuffled.
    """
    if not 0 <= overlap < most:
        raise ValueError("overlap must be less than the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in by_steps(texts):
                joined = Joined(texts[lo:hi])
                rank = boundary_ranks(joined)
                rows: list[tuple] = []
                for i, (s, e) in enumerate(zip(joined.starts.tolist(), joined.ends.tolist(), strict=True)):
                    own = rank[s : e + 1]
                    good, word = np.flatnonzero(own >= 2), np.flatnonzero(own == 1)
                    for j, (a, b, kind) in enumerate(cuts([good.tolist(), word.tolist()], e - s, most, overlap)):
                        kind = "end" if b == e - s else KINDS[int(own[b]) if kind else 0]
                        rows.append((lo + i, j, a, b, kind, texts[lo + i][a:b]))
                of, j, a, b, kind, piece = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(j, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(kind), pa.array(piece)], names=[key, "piece_index", "piece_start", "piece_end", "end_kind", "piece"])

    kind = records.schema[key].dataType.simpleString()
    long = records.where(F.length(text) > most).select(key, text)
    return long.mapInArrow(run, f"`{key}` {kind}, piece_index int, piece_start int, piece_end int, end_kind string, piece string")


def cut_windows(windows: DataFrame, records: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(record_idx, window_index, piece_index, token_start, token_end, char_start, char_end, end_kind): the pieces of every window whose
    offset_mapping has more than `most` entries.

    Of rows with equal (record_idx, window_index) the one aligned last counts, ties going to the longer mapping. n_tokens, which may
    be wrong, is not used. Boundaries are read from the record's text; where it is missing or an offset is null or outside
    of it, only the gaps between tokens count. Texts are joined to long windows only.
    """
    if not 0 <= overlap < most:
        raise ValueError("overlap must be less than the limit")
    long = windows.where(F.size("offset_mapping") > most).select("record_idx", "window_index", "offset_mapping", "aligned_at")
    long = long.groupBy("record_idx", "window_index").agg(F.max_by("offset_mapping", F.struct("aligned_at", F.size("offset_mapping"))).alias("offset_mapping"))
    keys = windows.where(F.size("offset_mapping") > most).select("record_idx").distinct()
    texts = records.select("record_idx", "text").where(F.col("record_idx").isNotNull())
    if keys.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(keys), "record_idx", "left_semi")
    else:
        texts = texts.join(keys, "record_idx", "left_semi")
    texts = texts.groupBy("record_idx").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            mapping, shared = batch.column(2), batch.column(3).dictionary_encode()
            known = shared.dictionary.to_pylist()
            texts = [None if x is None else known[x] for x in shared.indices.to_pylist()]
            upto = mapping.offsets.to_numpy()
            fields = [mapping.values.field(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)]
            last, rank, size = None, None, 0
            for i, (record, window, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True)):
                begin, end = (f[upto[i] : upto[i + 1]] for f in fields)
                n = len(begin)
                if rank is None or text is not last:
                    joined = Joined([text or ""])
                    last, rank, size = text, boundary_ranks(joined), int(joined.ends[0])
                best = np.zeros(n + 1, np.uint8)
                a, b = end[:-1], begin[1:]
                best[1:n][b > a] = 1
                within = (a >= 0) & (b <= size) & (a <= b)
                at = np.flatnonzero(within)
                if len(at):
                    between = np.maximum.reduceat(rank, np.stack((a[at], b[at] + 1), 1).ravel())[::2]
                    best[at + 1] = np.maximum(best[at + 1], between)
                good, word = np.flatnonzero(best >= 2), np.flatnonzero(best == 1)
                for j, (s, e, kind) in enumerate(cuts([good.tolist(), word.tolist()], n, most, overlap)):
                    rows.append((record, window, j, s, e, int(begin[s]), int(end[e - 1]), "end" if e == n else KINDS[int(best[e]) if kind else 0]))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([("record_idx", pa.int64()), ("window_index", pa.int32()), ("piece_index", pa.int32()), ("token_start", pa.int32()), ("token_end", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("end_kind", pa.string())])
    joined = long.join(texts, "record_idx", "left").select("record_idx", "window_index", "offset_mapping", "text")
    return joined.mapInArrow(run, "record_idx bigint, window_index int, piece_index int, token_start int, token_end int, char_start int, char_end int, end_kind string")


def cut_items(records: DataFrame, windows: DataFrame) -> DataFrame:
    """(item_kind, record_idx, window_index): the items that were cut, once each, taken from their first pieces."""
    a = cut_texts(records).where("piece_index = 0").select(F.lit("record").alias("item_kind"), "record_idx", F.lit(-1).alias("window_index"))
    b = cut_windows(windows, records).where("piece_index = 0").select(F.lit("window").alias("item_kind"), "record_idx", "window_index")
    return a.unionByName(b)
