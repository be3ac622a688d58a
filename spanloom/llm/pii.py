"""Personal information in free text: mentions by a character-level BiLSTM-CRF, and typed placeholders.

Every text is cut into overlapping windows of its own, from its beginning on; windows are laid into lanes that the network runs through in lockstep, with a
symbol between them that resets its state. Of each position the scores of the window in which it lies farthest from the edges count, so the scores of a text
depend on that text alone. The tags are the best path of the whole text: zones between places that are outside for sure (see bilstm.clear_margins) are decoded
with upper bounds for all that may come before, and where such a bound could win the text is decoded as a whole. Nothing but the network tells what is a
mention; quotes, brackets and blanks at its ends are trimmed.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import spread
from ._chars import Joined, by_steps
from .bilstm import KINDS, TAGS, Model, clear_margins, symbol_table, viterbi

MODEL = os.path.join(os.path.dirname(__file__), "pii_model.npz")
WINDOW, OVERLAP = 1024, 128
#: Characters of a lane about, and lanes at most.
LANE, LANES = 2048, 192
#: How far outside is held back, for recall; chosen on held-out rows by train_pii.
BIAS = 0.0
#: Added to the margins against rounding.
SURE = 0.01
#: Marks that do not belong to a value at its begin and end.
OPENING, CLOSING = " \t\r\n\u00a0\"'`«»„“”‘‚<>{[|", " \t\r\n\u00a0\"'`«»„“”‘<>}]|"


@lru_cache(maxsize=4)
def _model(path: str) -> Model:
    return Model.load(path)


def _windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end, use from, use to) of the windows of texts: each position of a text is used of one window."""
    step, edge = WINDOW - OVERLAP, OVERLAP // 2
    many = np.maximum(1, -(-(lengths - OVERLAP) // step))
    many[lengths == 0] = 0
    of = np.repeat(np.arange(len(lengths)), many)
    begin = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * step
    size = lengths[of]
    end = np.minimum(begin + WINDOW, size)
    last = end == size
    return of, begin, end, np.where(begin == 0, 0, begin + edge), np.where(last, size, begin + WINDOW - edge)


def _scores(m: Model, symbols: np.ndarray, joined: Joined) -> np.ndarray:
    """Scores of all tags at each position of the texts; at text ends those of nothing but "outside"."""
    lengths = joined.ends - joined.starts
    of, begin, end, use, till = _windows(lengths)
    out = np.zeros((len(symbols), TAGS), np.float32)
    if not len(of):
        return out
    size = end - begin + 1
    lanes = int(min(LANES, max(1, int(size.sum()) // LANE)))
    load = [(0, i) for i in range(lanes)]
    lane, at = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
    for w in np.argsort(-size, kind="stable").tolist():
        have, i = load[0]
        lane[w], at[w] = i, have
        heapq.heapreplace(load, (have + int(size[w]), i))
    steps = max(x for x, _ in load)
    laid = np.zeros((lanes, steps), np.uint8)
    base = joined.starts[of]
    rows = lane.tolist()
    for i, spot, a, b in zip(rows, at.tolist(), (base + begin).tolist(), (base + end).tolist(), strict=True):
        laid[i, spot : spot + b - a] = symbols[a:b]
    e = m.emissions(laid)
    for i, spot, a, b in zip(rows, (at + use - begin).tolist(), (base + use).tolist(), (base + till).tolist(), strict=True):
        out[a:b] = e[i, spot : spot + b - a]
    return out


def _zones(e: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(picked zones, their tags, the tag that each comes from) of zones [start, end), those of near lengths together."""
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        size = max(1, min(2048, 200_000 // int(lengths[order[min(len(order) - 1, at + 255)]] + 1)))
        pick = order[at : at + size]
        at += len(pick)
        most = int(lengths[pick].max())
        spot = starts[pick][:, None] + np.arange(most)
        tags, origin = viterbi(e[np.minimum(spot, len(e) - 1)], lengths[pick], t, first[pick])
        tags[np.arange(most) >= lengths[pick][:, None]] = 0
        yield pick, tags, origin


def best_path(e: np.ndarray, joined: Joined, t: np.ndarray, whole: bool = False) -> np.ndarray:
    """The tag of each position on the best path of its text, which comes from and ends outside. whole: without the short cut by zones (the same path)."""
    tags = np.zeros(len(e), np.int8)
    none = np.full(TAGS, -1e9, np.float32)
    none[0] = 0

    def put(starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        came = np.zeros(len(starts), np.int64)
        for pick, own, origin in _zones(e, starts, ends, first, t):
            came[pick] = origin
            w, s = np.nonzero(own)
            tags[starts[pick][w] + s] = own[w, s]
        return came

    if whole:
        some = joined.ends > joined.starts
        put(joined.starts[some], joined.ends[some], np.broadcast_to(none, (int(some.sum()), TAGS)))
        return tags
    margin, entry = clear_margins(t)
    open_ = np.zeros(len(e), bool)
    for k, least in enumerate((margin + SURE).tolist(), 1):
        open_ |= e[:, k] > e[:, 0] - np.float32(least)
    open_[joined.ends] = False
    edges = np.flatnonzero(np.diff(np.concatenate(([0], open_.view(np.int8), [0]))))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return tags
    first = np.tile(none, (len(starts), 1))
    text = np.searchsorted(joined.ends, starts)
    inner = starts > joined.starts[text]
    first[inner, 1:] = e[starts[inner] - 1, 1:] - e[starts[inner] - 1, :1] + entry + SURE
    came = put(starts, ends, first)
    again = np.unique(text[came != 0])
    if len(again):
        for i in again.tolist():
            tags[joined.starts[i] : joined.ends[i]] = 0
        put(joined.starts[again], joined.ends[again], np.broadcast_to(none, (len(again), TAGS)))
    return tags


def decode(m: Model, joined: Joined, bias: float = 0.0, whole: bool = False) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the mentions in the stream, in order and without overlap."""
    symbols = symbol_table()[joined.codes]
    symbols[joined.ends] = 0
    e = _scores(m, symbols, joined)
    e[:, 0] -= bias
    tags = best_path(e, joined, m.t, whole)
    begin = np.flatnonzero(tags % 2 == 1)
    goes_on = (tags > 0) & (tags % 2 == 0)
    stop = np.flatnonzero(~goes_on)
    end = stop[np.searchsorted(stop, begin, side="right")]
    return list(zip(begin.tolist(), end.tolist(), ((tags[begin] - 1) // 2).tolist(), strict=True))


def find(texts: list[str], m: Model, bias: float = BIAS) -> list[list[tuple[int, int, str]]]:
    """Mentions (start, end, kind) of each text, in order, without overlap."""
    out: list[list[tuple[int, int, str]]] = []
    for lo, hi in by_steps(texts):
        joined = Joined(texts[lo:hi])
        own: list[list] = [[] for _ in range(hi - lo)]
        found = decode(m, joined, bias)
        whose = np.searchsorted(joined.ends, np.array([a for a, _, _ in found], np.int64)).tolist()
        for i, (a, b, k) in zip(whose, found, strict=True):
            base = int(joined.starts[i])
            value = joined.text[a:b]
            a += len(value) - len(value.lstrip(OPENING))
            b -= len(value) - len(value.rstrip(CLOSING))
            if a < b:
                own[i].append((a - base, b - base, KINDS[k]))
        out += own
    return out


def _found(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = _model(path)
    for batch in batches:
        keys, at = batch.column(0), 0
        rows = find([x or "" for x in batch.column(1).to_pylist()], m)
        flat = [(i, *x) for i, own in enumerate(rows) for x in own]
        i, a, b, k = zip(*flat, strict=True) if flat else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(i, pa.int64())), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(k, pa.string())], names=[batch.schema.names[0], "span_start", "span_end", "pii_kind"])


def mentions(records: DataFrame, key: str = "record_idx", text: str = "text", model: str = MODEL) -> DataFrame:
    """(key, span_start, span_end, pii_kind): each mention of an e-mail address, phone number, identity number, street address or personal name, in code points.

    Null and empty texts have none; rows with equal keys are searched each. Whole texts are read; nothing is shuffled. The mentions of a text depend on it alone, not on
    the rows beside it. A text unlike those of the training (9,000 times one letter, say) may be given a mention that is none.
    """
    kind = records.schema[key].dataType.simpleString()
    return spread(records.select(key, text)).mapInArrow(partial(_found, path=model), f"`{key}` {kind}, span_start int, span_end int, pii_kind string")


def _masked(batches: Iterator[pa.RecordBatch], path: str, placeholders: dict[str, str]) -> Iterator[pa.RecordBatch]:
    m = _model(path)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        out, many = [], []
        for text, own in zip(texts, find([x or "" for x in texts], m), strict=True):
            parts, at = [], 0
            for a, b, k in own:
                parts += [text[at:a], placeholders[k]]
                at = b
            out.append(None if text is None else "".join(parts) + text[at:])
            many.append(len(own))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(many, pa.int32())], names=[batch.schema.names[0], "masked", "replaced"])


def mask(records: DataFrame, labels: DataFrame, key: str = "record_idx", text: str = "text", model: str = MODEL) -> DataFrame:
    """(key, masked, replaced): each text with every mention replaced by its kind's placeholder of `labels` (pii_kind, placeholder), all else unchanged.

    A null text stays null. A kind without placeholder becomes its name in brackets.
    """
    told = {r.pii_kind: r.placeholder for r in labels.where("pii_kind is not null").groupBy("pii_kind").agg(F.min("placeholder").alias("placeholder")).collect()}  # one row a kind
    placeholders = {k: told.get(k) or f"<{k.upper()}>" for k in KINDS}
    kind = records.schema[key].dataType.simpleString()
    return spread(records.select(key, text)).mapInArrow(partial(_masked, path=model, placeholders=placeholders), f"`{key}` {kind}, masked string, replaced int")
