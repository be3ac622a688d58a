"""The queries with SQL give the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from spanloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, FOLDER).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def rows_of(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def table(name, *columns):
    import pyarrow.parquet as pq

    return pq.read_table(f"{FOLDER}/{name}.parquet", columns=list(columns)).to_pylist()


def test_p1_masked_is_p1_found_in_place(spark):
    found = {}
    for r in rows_of(spark, "p1_found"):
        found.setdefault(r.record_idx, []).append((r.span_start, r.span_end, r.pii_kind))
    holders = {r["pii_kind"]: r["placeholder"] for r in table("label_spec", "pii_kind", "placeholder") if r["pii_kind"]}
    texts = {r["record_idx"]: r["text"] for r in table("split_record", "record_idx", "text")}
    masked = rows_of(spark, "p1_masked")
    assert len(masked) == len(texts) and found
    for r in masked:
        text = texts[r.record_idx]
        for a, b, k in sorted(found.get(r.record_idx, []), reverse=True):
            text = text[:a] + holders[k] + text[b:]
        assert r.masked == text and r.replaced == len(found.get(r.record_idx, []))


def test_p2_groups_are_the_components_of_p2_found(spark):
    pairs = [(r.key_a, r.key_b) for r in rows_of(spark, "p2_found") if r.field_name == "text"]
    texts = {r["record_idx"]: r["text"] for r in table("split_record", "record_idx", "text")}
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    groups = {r.record_idx: r for r in rows_of(spark, "p2_groups")}
    by = {}
    for k, r in groups.items():
        by.setdefault(r.group_id, set()).add(k)
    want = {}
    for k in groups:
        want.setdefault(root(k), set()).add(k)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))
    for k, r in groups.items():
        same = [x for x, t in texts.items() if t == texts[k]]
        near = {texts[b if a == k else a] for a, b in pairs if k in (a, b)} - {texts[k]}
        assert r.class_rows == len(same) and r.links == len(near)


def test_p2_weighted(spark):
    from collections import Counter

    from spanloom.llm._chars import word_runs

    texts = {r["record_idx"]: r["text"] for r in table("split_record", "record_idx", "text") if r["text"]}
    bags = {k: Counter(x) for k, x in zip(texts, word_runs(list(texts.values()), 5), strict=True) if x}
    got = {r.record_idx: r for r in rows_of(spark, "p2_weighted")}
    assert set(got) == set(bags)
    for a in bags:
        near = {texts[b] for b in bags if texts[b] != texts[a] and (both := sum((bags[a] & bags[b]).values())) >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both)}
        assert got[a].links == len(near)


def test_p3_pieces_give_back_the_texts(spark):
    texts = {r["record_idx"]: r["text"] for r in table("split_record", "record_idx", "text") if r["text"] and len(r["text"]) > 1200}
    pieces = {}
    for r in rows_of(spark, "p3_pieces"):
        pieces.setdefault(r.record_idx, []).append((r.piece_index, r.piece_start, r.piece_end, r.piece))
    assert set(pieces) == set(texts)
    for k, own in pieces.items():
        own.sort()
        assert "".join(p if i == 0 else p[120:] for i, _, _, p in own) == texts[k] and all(texts[k][a:b] == p and b - a <= 1200 for _, a, b, p in own)


def test_p3_windows_give_back_the_windows(spark):
    sizes = {}
    for r in table("align_window", "record_idx", "window_index", "offset_mapping", "aligned_at"):
        n = len(r["offset_mapping"] or [])
        if n > 384:
            sizes.setdefault((r["record_idx"], r["window_index"]), []).append((r["aligned_at"], n))
    pieces = {}
    for r in rows_of(spark, "p3_windows"):
        pieces.setdefault((r.record_idx, r.window_index), []).append((r.piece_index, r.token_start, r.token_end))
    assert set(pieces) == set(sizes)
    for k, own in pieces.items():
        own.sort()
        assert own[0][1] == 0 and own[-1][2] == max(sizes[k], key=lambda x: (x[0] is not None, x[0], x[1]))[1]
        assert all(0 < b - a <= 384 for _, a, b in own) and all(x[2] - y[1] == 128 for x, y in zip(own, own[1:], strict=False))


def test_p4_assigned_keeps_groups_and_proportions(spark):
    rows = rows_of(spark, "p4_assigned")
    of, weight = {}, {}
    for r in rows:
        of.setdefault(r.group_id, set()).add(r.assigned_split)
        weight[r.group_id] = (r.assigned_split, r.group_records)
    assert all(len(x) == 1 for x in of.values())
    total = sum(n for _, n in weight.values())
    have = {s: sum(n for x, n in weight.values() if x == s) / total for s in ("train", "dev", "test")}
    most = max(n for _, n in weight.values()) / total
    assert all(abs(have[s] - t) <= max(0.02, most) for s, t in (("train", 0.8), ("dev", 0.1), ("test", 0.1)))
    assert {(r.spec_id, r.group_id) for r in rows if r.broken} == {tuple(r) for r in rows_of(spark, "p4_found")}


def test_p5_report_counts_p5_found(spark):
    meta = {r["record_idx"]: (r["split"].strip().lower(), r["meta"]["source"]) for r in table("split_record", "record_idx", "split", "meta") if r["split"]}
    want = {}
    for k, kind in {tuple(r) for r in rows_of(spark, "p5_found")}:
        want[*meta[k], kind] = want.get((*meta[k], kind), 0) + 1
    assert {(r.split, r.source, r.overlap_kind): r.overlapping for r in rows_of(spark, "p5_report")} == want


def test_p5_edited_by_brute_force(spark):
    from spanloom.llm.segments import distance_within

    rows = [(r["record_idx"], r["text"], r["split"].strip().lower()) for r in table("split_record", "record_idx", "text", "split") if r["split"] and r["text"] and r["text"].strip()]
    train = [t for _, t, s in rows if s == "train"]
    want = {}
    for k, t, s in rows:
        if s in ("dev", "test"):
            near = [d for x in train if abs(len(x) - len(t)) <= 3 and (d := distance_within(t, x, 3)) is not None]
            if near:
                want[k] = min(near)
    assert {r.record_idx: r.distance for r in rows_of(spark, "p5_edited")} == want


def test_p6_as_the_library(spark):
    import tiktoken

    from spanloom.llm import tokens

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    e = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=tokens.merger(tokens.BYTE_BPE_50K).ranks, special_tokens={})
    want = {r["doc_id"]: e.encode_ordinary(r["text"] or "") for r in table("documents", "doc_id", "text")}
    assert {r.doc_id: list(r.ids) for r in rows_of(spark, "p6_ids")} == want
    for r in rows_of(spark, "p6_slices"):
        assert list(r.ids) == want[r.doc_id] and sum(s.n_ids for s in r.slices) == len(r.ids)


def test_p7_fills_containers(spark):
    sizes = {r.doc_id: len(r.ids) for r in rows_of(spark, "p6_ids")}
    load, covered = {}, {}
    for r in rows_of(spark, "p7_packed"):
        n = r.token_end - r.token_start
        covered.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
        if n:
            load[r.container_id] = load.get(r.container_id, 0) + n
    assert max(load.values()) <= 2048 and set(covered) == set(sizes)
    for k, spans in covered.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == sizes[k] and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert len(spans) == max(1, -(-sizes[k] // 2048))
    assert len(load) <= -(-sum(sizes.values()) // 2048) + 1


def test_p8_by_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in table("documents", "doc_id", "text") if r["text"] and len(r["text"]) >= 160}
    first, several = {}, set()
    for k, t in texts.items():
        for i in range(len(t) - 159):
            h = hash(t[i : i + 160])
            if first.setdefault(h, k) != k:
                several.add(h)
    want = {}
    for k, t in texts.items():
        for i in range(len(t) - 159):
            if hash(t[i : i + 160]) in several:
                own = want.setdefault(k, [])
                if own and i <= own[-1][1]:
                    own[-1][1] = i + 160
                else:
                    own.append([i, i + 160])
    assert {tuple(r) for r in rows_of(spark, "p8_found")} == {(k, a, b) for k, own in want.items() for a, b in own}
    share = {r.doc_id: r.shared_chars for r in rows_of(spark, "p8_share")}
    assert all(share[k] == sum(b - a for a, b in want.get(k, [])) for k in texts)


def test_every_query_is_tested(spark):
    tested = {n.split("_", 1)[0] for n in SQL} | {"p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8"}
    assert {n.split("_", 1)[0] for n in QUERIES} == tested
