"""python -m spanloom.llm.train_pii SPLIT_RECORD_PARQUET OUT: trains the model of pii.py from labelled spans, from nothing.

Three rounds over at most MOST_RECORDS rows, of which the last HELD_OUT teach nothing and serve for measuring. The delivered annotation is partly wrong and
incomplete. Spans that cut words, and labels that few spans in the same surroundings have, teach nothing; spans of other labels are hard negatives. Each model
then searches the texts: what it finds besides in surroundings that are mostly labelled with that kind is learned too, what it finds elsewhere and what it
contradicts teaches nothing in the next round. No written form of any kind is given.
"""

from __future__ import annotations

import os
import sys
from collections import Counter

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import numpy as np

from . import pii
from ._chars import Joined
from .bilstm import KINDS, Model, symbol_table, train

MOST_RECORDS, HELD_OUT = 40_000, 4_000
WIDTH, SIZE, WORKERS = 112, 32, 8
#: Epochs of the rounds, and the bias of the search behind each.
ROUNDS = ((6, 1.0), (5, 0.5), (9, 0.0))
#: Characters before and after a mention that tell its surroundings; how many labelled spans must share them, and the share that must agree.
BEFORE, AFTER, OFTEN, SHARE = 6, 7, 25, 0.5
#: The longest labelled span that is learned from.
LONGEST = 90
#: Labels of each kind (fixed values).
KIND_OF = {"EMAIL": "email", "PHONE": "phone", "SSN": "id_number", "ITIN": "id_number", "TAX_ID": "id_number", "PASSPORT_NUMBER": "id_number", "DRIVER_LICENSE": "id_number", "STREET_ADDRESS": "address", "PERSON_NAME": "name"}

Span = tuple[int, int, str | None]


def whole(text: str, a: int, b: int) -> bool:
    """Whether a span begins and ends with whole words, and with no blank or mark that is trimmed."""
    value = text[a:b]
    cut = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return value.lstrip(pii.OPENING) == value == value.rstrip(pii.CLOSING) and not cut(a) and not cut(b)


def labelled(text: str, entities: list | None) -> tuple[list[Span], list[Span]]:
    """(spans of whole words with their kind, None for other labels; the other spans)."""
    good, doubt = set(), []
    for e in entities or []:
        a, b = e["span_start"], e["span_end"]
        if a is None or b is None or not 0 <= a < b <= len(text):
            continue
        kind = KIND_OF.get((e["label"] or "").strip().upper().replace("-", "_").replace(" ", "_"))
        if b - a <= LONGEST and whole(text, a, b):
            good.add((a, b, kind))
        else:
            doubt.append((a, b, kind))
    return sorted(good, key=lambda x: (x[0], x[1], x[2] or "")), doubt


class Surroundings:
    """How often each kind is labelled behind and before the same characters."""

    def __init__(self, texts: list[str], spans: list[list[Span]]):
        self.before, self.after, self.any_before, self.any_after = Counter(), Counter(), Counter(), Counter()
        for text, own in zip(texts, spans, strict=True):
            for a, b, k in own:
                x, y = text[max(0, a - BEFORE) : a], text[b : b + AFTER]
                self.before[k, x] += 1
                self.any_before[x] += 1
                self.after[k, y] += 1
                self.any_after[y] += 1

    def share(self, text: str, a: int, b: int, k: str | None) -> tuple[float | None, float | None]:
        """Share of the kind among the spans behind the same characters, and before the same; None where there are few."""
        x, y = text[max(0, a - BEFORE) : a], text[b : b + AFTER]
        return (
            self.before[k, x] / self.any_before[x] if self.any_before[x] >= OFTEN else None,
            self.after[k, y] / self.any_after[y] if self.any_after[y] >= OFTEN else None,
        )

    def agrees(self, text: str, a: int, b: int, k: str | None) -> bool:
        shares = [x for x in self.share(text, a, b, k) if x is not None]
        return bool(shares) and max(shares) >= SHARE

    def contradicts(self, text: str, a: int, b: int, k: str | None) -> bool:
        first = self.share(text, a, b, k)[0]
        return first is not None and first < SHARE / 2


def meets(x: Span, spans: list[Span]) -> bool:
    return any(x[0] < y[1] and x[1] > y[0] for y in spans)


def windows(texts: list[str], spans: list[list[Span]], others: list[list[Span]], doubts: list[list[Span]], free: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the stream of all texts: one around each span and each span of another label, and `free` others a text; none with a place of doubt, none that begins within a mention."""
    r = np.random.default_rng(seed)
    joined = Joined(texts)
    symbols = symbol_table()[joined.codes]
    symbols[joined.ends] = 0
    tags = np.zeros(len(symbols), np.int8)
    bad = np.zeros(len(symbols) + 1, np.int32)
    starts = []
    for base, own, other, doubt in zip(joined.starts.tolist(), spans, others, doubts, strict=True):
        for a, b, k in own:
            i = KINDS.index(k)
            tags[base + a] = 1 + 2 * i
            tags[base + a + 1 : base + b] = 2 + 2 * i
        starts += [base + a - int(r.integers(4, WIDTH - 20)) for a, _, _ in (*own, *other)]
        for a, b, _ in doubt:
            bad[base + a : base + b] = 1
    starts = np.concatenate((np.array(starts, np.int64), r.integers(0, len(symbols) - WIDTH, int(free * len(texts)))))
    starts = starts[(starts >= 0) & (starts < len(symbols) - WIDTH)]
    upto = np.concatenate(([0], np.cumsum(bad)))
    inside = (tags > 0) & (tags % 2 == 0)
    starts = starts[(upto[starts + WIDTH] == upto[starts]) & ~inside[starts]]
    at = starts[:, None] + np.arange(WIDTH)
    return symbols[at], tags[at].astype(np.int64)


def apart(spans: list[Span]) -> list[Span]:
    kept: list[Span] = []
    for x in spans:
        if not meets(x, kept):
            kept.append(x)
    return kept


def lesson(text: str, good: list[Span], bad: list[Span], found: list[Span] | None, near: Surroundings) -> tuple[list[Span], list[Span], list[Span]]:
    """(mentions to learn, spans of other labels, places of doubt) of a text; found: what the model before found, None in the first round."""
    doubt = list(bad)
    own, others = [], []
    for x in good:
        if near.contradicts(text, *x):
            doubt.append(x)
        elif x[2] is None:
            others.append(x)
        else:
            own.append(x)
    own = apart(own)
    if found is None:
        return own, [x for x in others if not meets(x, own)], [x for x in doubt if not meets(x, own)]
    sure = [x for x in own if x in found or near.agrees(text, *x)]
    doubt += [x for x in own if x not in sure]
    for x in found:
        if x in sure or meets(x, sure):
            continue
        if near.agrees(text, *x) and whole(text, *x[:2]):
            sure.append(x)
        elif not meets(x, others):
            doubt.append(x)
    return sure, [x for x in others if not meets(x, sure)], [x for x in doubt if not meets(x, sure)]


def _search(task: tuple[Model, list[str], float]) -> list:
    m, texts, bias = task
    return pii.find(texts, m, bias=bias)


def search(m: Model, texts: list[str], bias: float) -> list[list[Span]]:
    import multiprocessing

    with multiprocessing.get_context("fork").Pool(WORKERS) as pool:
        return [x for part in pool.map(_search, [(m, texts[i : i + 1000], bias) for i in range(0, len(texts), 1000)], chunksize=1) for x in part]


def measure(texts: list[str], spans: list[list[Span]], found: list[list[Span]], near: Surroundings) -> str:
    """Of each kind: labelled spans found exactly / labelled spans (whole words, not contradicted); what else is found: in agreeing surroundings, on spans of other labels, elsewhere."""
    hit, all_, extra = Counter(), Counter(), Counter()
    for text, own, got in zip(texts, spans, found, strict=True):
        for x in own:
            if x[2] and not near.contradicts(text, *x):
                all_[x[2]] += 1
                hit[x[2]] += x in got
        for x in got:
            if x not in own:
                extra[x[2], "agrees" if near.agrees(text, *x) else "other" if meets(x, [y for y in own if y[2] is None]) else "else"] += 1
    return ", ".join(f"{k} {hit[k]}/{all_[k]} +{extra[k, 'agrees']} !{extra[k, 'other']} ?{extra[k, 'else']}" for k in KINDS)


def read(source: str, most: int = MOST_RECORDS) -> tuple[list[str], list[list[Span]], list[list[Span]]]:
    import pyarrow.parquet as pq

    rows = [r for r in pq.read_table(source, columns=["text", "entities"]).slice(0, most).to_pylist() if r["text"] and r["text"].strip()]
    each = [labelled(r["text"], r["entities"]) for r in rows]
    return [r["text"] for r in rows], [x[0] for x in each], [x[1] for x in each]


def main(source: str, out: str) -> None:
    tell = lambda s: print(s, flush=True)
    texts, good, bad = read(source)
    held = max(0, len(texts) - HELD_OUT)
    near = Surroundings(texts[:held], good[:held])
    m, found = Model.new(SIZE, 1), [None] * held
    for turn, (epochs, bias) in enumerate(ROUNDS, 1):
        own, others, doubts = (list(x) for x in zip(*(lesson(*x, near) for x in zip(texts[:held], good[:held], bad[:held], found, strict=True)), strict=True))
        tell(f"round {turn}: {sum(map(len, own))} mentions, {sum(map(len, others))} others, {sum(map(len, doubts))} places of doubt")
        train(m, *windows(texts[:held], own, others, doubts, 0.6 if turn == 1 else 1.0, turn), epochs, rate=6e-3 if turn == 1 else 5e-3, workers=WORKERS, seed=turn, tell=tell)
        m.save(f"{out}.round{turn}.npz" if turn < len(ROUNDS) else out)
        if turn < len(ROUNDS):
            found = search(m, texts[:held], bias)
    for bias in (0.0, 0.5, 1.0, 1.5):
        tell(f"held out, bias {bias}: {measure(texts[held:], good[held:], search(m, texts[held:], bias), near)}")


if __name__ == "__main__":
    main(*sys.argv[1:3])
