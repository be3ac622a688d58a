"""Queries without SQL against plain Python over the smallest tables."""

from __future__ import annotations

import hashlib
import re

import pyarrow.parquet as pq
import pytest

from spanloom.plans.catalogue import QUERIES, SQL
from spanloom.schema import LABELS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def records():
    return pq.read_table(f"{FOLDER}/split_record.parquet").to_pylist()


@pytest.fixture(scope="module")
def windows():
    """(record, window) -> tokens with characters, of the row aligned last."""
    last: dict = {}
    for r in pq.read_table(f"{FOLDER}/align_window.parquet").to_pylist():
        k, m = (r["record_idx"], r["window_index"]), r["offset_mapping"] or []
        rank = (r["aligned_at"] is not None, r["aligned_at"], len(m))
        if k not in last or rank > last[k][0]:
            last[k] = (rank, m)
    return {k: [(t["tok_start"], t["tok_end"]) for t in m if t["tok_end"] > t["tok_start"]] for k, (_, m) in last.items()}


def gold(record):
    n = len(record["text"] or "")
    return [(i, x["span_start"], x["span_end"], x["label"]) for i, x in enumerate(record["entities"] or []) if record["text"] is not None and x["span_start"] is not None and x["span_end"] is not None and 0 <= x["span_start"] < x["span_end"] <= n and x["label"] in LABELS]


def test_every_query_without_sql_has_a_twin():
    assert set(QUERIES) - set(SQL) == {"converted_records", "template_skeletons", "family_most_similar", "synthetic_records", "synthetic_negatives", "synthetic_pairs"}


def test_span_token_alignment(spark, records, windows):
    want: dict = {}
    for r in records:
        own = {w: t for (k, w), t in windows.items() if k == r["record_idx"]}
        if not any(k == r["record_idx"] for k, _ in windows):
            continue
        spans = gold(r)
        for i, s, e, _ in spans:
            states = []
            for toks in own.values():
                hit = [t for t in toks if t[0] < e and s < t[1]]
                if not hit:
                    continue
                whole = all(r["text"][c].isspace() or any(a <= c < b for a, b in hit) for c in range(s, e))
                shared = any(sum(1 for _, x, y, _ in spans if t[0] < y and x < t[1]) > 1 for t in hit)
                off = abs(min(a for a, _ in hit) - s) + abs(max(b for _, b in hit) - e)
                states.append(2 if not whole else 4 if shared else 3 if off > 3 else 5 if off else 6)
            name = {6: "aligned", 5: "boundary_adjusted", 4: "collision", 3: "excessive", 2: "truncated"}[max(states)] if states else "failed"
            want[name] = want.get(name, 0) + 1
    assert {r.status: r.spans for r in QUERIES["span_token_alignment"](spark, FOLDER).collect()} == want


def test_overflow_windows(spark, records, windows):
    spans = {r["record_idx"]: gold(r) for r in records}
    tokens: dict = {}
    for (k, _), t in windows.items():
        tokens.setdefault(k, set()).update(t)
    want = {}
    for k, t in tokens.items():
        t, at, w = sorted(t), 0, 0
        while t:
            part = t[at : at + 384]
            tags = []
            for a, b in part:
                own = [x for x in spans.get(k, []) if x[1] < b and a < x[2]]
                first = own and next(j for j, y in enumerate(part) if y[0] < own[0][2] and own[0][1] < y[1])
                tags.append("O" if not own else "IGNORE" if len(own) > 1 else "B" if part[first] == (a, b) else "I")
            want[k, w] = (len(part), tags.count("B"), tags.count("IGNORE"))
            if at + 384 >= len(t):
                break
            at, w = at + 256, w + 1
    assert {(r.record_idx, r.window_index): (r.tokens, r.begins, r.ignored) for r in QUERIES["overflow_windows"](spark, FOLDER).collect()} == want


def test_template_skeletons(spark, records):
    found: dict = {}
    for r in records:
        if r["text"] is None:
            continue
        text, low = r["text"], len(r["text"])
        for x in sorted(r["entities"] or [], key=lambda x: -(x["span_start"] if x["span_start"] is not None else -1)):
            s, e = x["span_start"], x["span_end"]
            if s is not None and e is not None and 0 <= s < e <= low:
                text, low = text[:s] + "<placeholder>" + text[e:], s
        for form in (r"<<[^<>]+>>", r"\[\[[^\[\]]+\]\]", r"\{\{[^{}]+\}\}", r"(?<!\{)\{[^{}]+\}(?!\})"):
            text = re.sub(form, "<placeholder>", text)
        text = re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower()).strip()
        found.setdefault(hashlib.sha256(text.encode()).hexdigest(), []).append(r["record_idx"])
    want = {k: (len(v), min(v)) for k, v in found.items() if len(v) > 1}
    assert {r.skeleton: (r.records, r.first_idx) for r in QUERIES["template_skeletons"](spark, FOLDER).collect()} == want


def test_every_converted_span_ends_in_one_place(spark, records):
    raw = {r["record_idx"]: r for r in records}
    out = QUERIES["converted_records"](spark, FOLDER).collect()
    assert {r.record_idx for r in out} == {k for k, r in raw.items() if (r["text"] or "").strip()}
    for r in out:
        told = [x for x in raw[r.record_idx]["entities"] or [] if any(x[c] is not None for c in ("span_start", "span_end", "label"))]
        assert len(r.provenance or []) + len(r.excluded or []) == len(told)
        kept = sorted((x.span_start, x.span_end) for x in r.entities or [])
        assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:], strict=False))
        assert {(x.span_start, x.span_end, x.label) for x in r.provenance or []} == {tuple(x) for x in r.entities or []}


def test_synthesis_is_told_by_its_seed(spark):
    for name in ("synthetic_records", "synthetic_negatives", "synthetic_pairs"):
        a, b = (sorted(map(str, QUERIES[name](spark, FOLDER).collect())) for _ in range(2))
        assert a == b and len(a) > 0
    assert not any(r.entities for r in QUERIES["synthetic_negatives"](spark, FOLDER).collect())
    for r in QUERIES["synthetic_records"](spark, FOLDER).collect():
        assert all(0 <= x.span_start < x.span_end <= len(r.text) and x.label in LABELS for x in r.entities)
