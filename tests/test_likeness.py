"""The search for the greatest sequence ratio against all pairs, and how few pairs it compares."""

from __future__ import annotations

import difflib
import random

import pyarrow as pa

from spanloom.operators import likeness

PARTS = ["bas", "lit", "co", "cost", "quod", "ust", "just", "or", "plod", "rund", "stof", "and", "thic", "reck"]


def families(n: int, seed: int) -> dict[str, str]:
    r = random.Random(seed)
    word = lambda: r.choice(PARTS) + r.choice(PARTS)
    return {f"f{i:04}": " ".join([r.choice(["account", "phone", "ip"]), *(word() for _ in range(5)), f"v{r.randint(1, 3)}"]) for i in range(n)}


def greatest(name: str, text: str, others: dict[str, str]) -> tuple[float, str] | None:
    found = min(((-difflib.SequenceMatcher(None, text, x, autojunk=False).ratio(), o) for o, x in others.items() if o != name), default=None)
    return found and (-found[0], found[1])


def searched(left: dict[str, str | None], right: dict[str, str | None], block: int) -> dict[str, tuple[float, str]]:
    rows = [(False, *x) for x in left.items()] + [(True, *x) for x in right.items()]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["other", "name", "template"])
    return {r["name"]: (r["ratio"], r["other"]) for b in likeness.best_ratios(iter([batch]), block) for r in b.to_pylist()}


def test_few_of_all_pairs_are_compared(monkeypatch):
    names, plain, compared = families(150, 3), difflib.SequenceMatcher, []

    class Counted(plain):
        def __init__(self, *args, **kw):
            compared.append(1)
            super().__init__(*args, **kw)

    want = {k: greatest(k, v, names) for k, v in names.items()}
    monkeypatch.setattr(difflib, "SequenceMatcher", Counted)
    assert searched(names, names, 1000) == want
    assert len(compared) < 12 * len(names)


def test_any_texts_and_steps():
    r = random.Random(8)
    text = lambda: "".join(r.choice("ab c\U0001f600"[: r.randint(1, 5)]) for _ in range(r.choice([0, 1, 3, 15, 16, 17, 63, 64, 65, 128, 129, 200])))
    left, right = {f"n{i:02}": text() for i in range(50)}, {f"n{i:02}": text() for i in range(20, 70)}
    want = {k: greatest(k, v, right) for k, v in left.items()}
    for block in (1, 7, 50, 1000):
        assert searched(left, right, block) == want
    assert searched({"a": None}, {"a": "x", "b": None}, 5) == {"a": (1.0, "b")}
    assert searched({"a": "x"}, {"a": "x"}, 5) == {}


def test_small_tables_where_texts_are_long(monkeypatch):
    names = {f"n{i}": t * (1 + i % 3) for i, t in enumerate(families(30, 4).values())}
    want = {k: greatest(k, v, names) for k, v in names.items()}
    monkeypatch.setattr(likeness, "WORDS", 300)
    assert searched(names, names, 30) == want
