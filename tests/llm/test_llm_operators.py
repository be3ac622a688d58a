"""Each operator against brute force, round trips and the odd cases of its docstring."""

from __future__ import annotations

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spanloom.llm import _hot, bagminhash, crosssplit, cutting, differencing, groups, neardup, packing, segments, shared_spans, tokens
from spanloom.llm._chars import Joined, char_shingles, word_shingles

SLOW = settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
ODD = ["", " ", "a", "\n\r\n", "don't we'll  I've\t'S ''x", "漢字 かな 🙂👍🏽", "é ​\x00", "<|endoftext|>", "x" * 5000, "1234567890 " * 300]


# ---- tokens


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=tokens.merger(tokens.BYTE_BPE_50K).ranks, special_tokens={})


def ids_of(texts):
    out = []
    for ids, offsets, _ in tokens.encode_texts(texts, tokens.BYTE_BPE_50K):
        out += [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(len(offsets) - 1)]
    return out


@SLOW
@given(st.lists(st.text(alphabet=" \t\n'sdmtlvreaZé9٣_-.!漢🙂 ́\x1c\x85", max_size=40), max_size=6))
def test_tokens_as_the_library(encoding, texts):
    assert ids_of(texts) == [encoding.encode_ordinary(t) for t in texts]


def test_tokens_of_tables(spark, encoding):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])] + [(0, "again")], "doc_id bigint, text string")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode(df.withColumn("ids", df.doc_id)).collect())
    assert got == sorted([(i, encoding.encode_ordinary(t)) for i, t in enumerate(ODD)] + [(len(ODD), []), (0, encoding.encode_ordinary("again"))])
    back = {(r.doc_id, r.text) for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {(i, t) for i, t in enumerate(ODD)} | {(len(ODD), ""), (0, "again")}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df.limit(3)).collect()} == {0: 0, 1: 1, 2: 1}
    assert tokens.encode(df.limit(0)).count() == 0


@SLOW
@given(st.text(alphabet="abcdeé漢 12", min_size=1, max_size=120))
def test_merging_by_list_and_by_heap(text):
    import tiktoken

    m = tokens.merger(tokens.BYTE_BPE_50K)
    want = tiktoken.Encoding("slices", pat_str=r"[\s\S]+", mergeable_ranks=m.ranks, special_tokens={}).encode_ordinary(text)
    assert m._short(text.encode()) == m._long(text.encode()) == want


def test_slices(spark):
    texts = [*ODD, None, "Don't stop  now"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    ids = {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()}
    raw = {i: x for x, i in tokens.merger(tokens.BYTE_BPE_50K).ranks.items()}
    for r in tokens.encode_slices(df).collect():
        assert list(r.ids) == ids[r.doc_id] and sum(s.n_ids for s in r.slices) == len(r.ids)
        text, at = texts[r.doc_id] or "", 0
        edges = [s.char_start for s in r.slices] + [len(text)]
        for s, a, b in zip(r.slices, edges, edges[1:], strict=False):
            assert b"".join(raw[i] for i in r.ids[at : at + s.n_ids]).decode() == text[a:b]
            at += s.n_ids


# ---- packing


@SLOW
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40), st.integers(1, 12))
def test_relieve_never_adds_weight_over_capacity(weights, bins):
    w = np.array(weights, np.int64)
    of = differencing.difference(w, bins)
    before = np.maximum(np.bincount(of, w, bins) - 100, 0).sum()
    fits = differencing.relieve(w, of, bins, 100)
    after = np.maximum(np.bincount(of, w, bins) - 100, 0).sum()
    assert after <= before and fits == (after == 0)


@SLOW
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 9))
def test_difference_uses_every_weight(weights, bins):
    of = differencing.difference(np.array(weights, np.int64), bins)
    assert len(of) == len(weights) and (len(of) == 0 or (0 <= of.min() and of.max() < bins))


@SLOW
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_pack_fits(weights):
    w = np.array(weights, np.int64)
    of = differencing.pack(w, 100)
    assert np.bincount(of, w).max() <= 100
    assert len(set(of.tolist())) <= 2 * -(-int(w.sum()) // 100)


def test_packing_table(spark):
    sizes = [(1, 5000), (2, 0), (3, None), (4, 2048), (5, 100), (5, 100), (6, 2049)] + [(i, random.Random(i).randint(1, 2000)) for i in range(10, 300)]
    out = packing.pack_sizes(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"), group_pieces=100).collect()
    load = {}
    for r in out:
        n = r.token_end - r.token_start
        assert n <= 2048 and (r.container_id is None) == (n == 0)
        if n:
            load[r.container_id] = load.get(r.container_id, 0) + n
    total = sum(n or 0 for _, n in sizes)
    assert sum(load.values()) == total and max(load.values()) <= 2048
    assert len(load) <= 1.1 * total / 2048 + 4
    assert sorted((r.token_start, r.token_end) for r in out if r.doc_id == 1) == [(0, 2048), (2048, 4096), (4096, 5000)]
    assert packing.pack_sizes(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0


# ---- cutting


@SLOW
@given(st.text(alphabet="ab. \n。", min_size=1, max_size=400), st.integers(12, 60), st.integers(0, 11))
def test_cuts_cover(text, most, overlap):
    rank = cutting.boundary_ranks(Joined([text]))
    pieces = list(cutting.cuts([np.flatnonzero(rank[: len(text) + 1] >= 2).tolist(), np.flatnonzero(rank[: len(text) + 1] == 1).tolist()], len(text), most, overlap))
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < b - a <= most for a, b, _ in pieces)
    assert all(p[1] - q[0] == overlap for p, q in zip(pieces, pieces[1:], strict=False))
    assert text[: pieces[0][1]] + "".join(text[a + overlap : b] for a, b, _ in pieces[1:]) == text


def test_cut_texts(spark):
    long = ("Some words here. And more of them!\n" * 60) + "x" * 1500
    df = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, "y" * 1200), (5, "y" * 1201), (5, "🙂 " * 800)], "record_idx bigint, text string")
    out = {}
    for r in cutting.cut_texts(df).collect():
        out.setdefault((r.record_idx, "y" in r.piece), []).append(r)
    assert set(k for k, _ in out) == {1, 5}
    for (k, plain), rows in out.items():
        rows.sort(key=lambda r: r.piece_index)
        want = long if k == 1 else ("y" * 1201 if plain else "🙂 " * 800)
        assert rows[0].piece + "".join(r.piece[120:] for r in rows[1:]) == want and all(len(r.piece) <= 1200 for r in rows)
    assert sorted(r.end_kind for r in cutting.cut_texts(df.where("record_idx = 1")).collect()) [:2] == ["end", "hard"]


def test_cut_windows(spark):
    text = "word " * 500
    mapping = [(5 * i, 5 * i + 4) for i in range(500)]
    rows = [(1, 0, 9, mapping, 1), (1, 0, 9, mapping, 2), (2, 0, None, mapping[:385], 1), (3, 0, 384, mapping[:384], 1), (4, 0, 1, None, 1), (5, 1, 1, [], 1)]
    w = spark.createDataFrame(rows, "record_idx bigint, window_index int, n_tokens int, offset_mapping array<struct<tok_start:int,tok_end:int>>, aligned_at int")
    t = spark.createDataFrame([(1, text), (3, text)], "record_idx bigint, text string")
    out = sorted((r.record_idx, r.piece_index, r.token_start, r.token_end) for r in cutting.cut_windows(w, t).collect())
    assert out == [(1, 0, 0, 384), (1, 1, 256, 500), (2, 0, 0, 384), (2, 1, 256, 385)]
    assert sorted((r.item_kind, r.record_idx, r.window_index) for r in cutting.cut_items(t, w).collect()) == [("record", 1, -1), ("record", 3, -1), ("window", 1, 0), ("window", 2, 0)]


# ---- groups


def related_twin(rows):
    def key(x, name=False):
        x = None if x is None else x.strip().lower()
        bad = lambda v: v in (None, "", "unknown", "n/a", "none", "-") or re.fullmatch("0+", v)
        if bad(x):
            return None
        if name:
            x = re.sub(r"[_\-.\s]+", "", x)
            return None if bad(x) else x
        return x

    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for i, f, s, v in rows:
        for k in (("f", key(f, True)), ("s", key(s)), ("v", key(v))):
            if k[1] is not None:
                if k in seen:
                    a, b = sorted((find(seen[k]), find(i)))
                    parent[b] = a
                seen[k] = i
    return {i: find(i) for i in parent}


def test_related_families(spark):
    r = random.Random(3)
    values = [None, "", " ", "unknown", "N/A", "-", "000", *[f"s{i}" for i in range(40)], "S1 ", " s2"]
    rows = [(i, r.choice([None, f"fam_{r.randint(0, 60)}_v1", f"Fam-{r.randint(0, 60)}.V1 "]), r.choice(values), r.choice(values)) for i in range(120)]
    df = spark.createDataFrame(rows, "spec_id bigint, template_family string, semantic_signature string, seed_value_hash string")
    assert {x.spec_id: x.group_id for x in groups.related_families(df).collect()} == related_twin(rows)
    assert groups.related_families(df.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, k) for i in range(60) for k in (f"k{i}", f"k{i + 1}")] + [(99, None), (None, "k1")], "node bigint, key string")
    assert {(r.node, r.component) for r in groups.components(links).collect()} == {(i, 0) for i in range(60)} | {(99, 99)}


def test_broken_and_assigned(spark):
    rows = [(1, "a_x", "g", "h1", "train"), (2, "A-X", None, "0000", " Test "), (3, "b", "g2", None, "dev"), (4, "c", "G2 ", None, "DEV"), (5, "d", None, None, None), (6, "e", "g2", None, None)]
    df = spark.createDataFrame(rows, "spec_id bigint, template_family string, semantic_signature string, seed_value_hash string, intended_split string")
    records = spark.createDataFrame([((f,),) for f in ["a_x"] * 70 + ["b"] * 20 + ["c"] * 5 + ["d"] * 5], "meta struct<template_family:string>")
    assert sorted(map(tuple, groups.broken_groups(df, records).collect())) == [(1, 1), (2, 1)]
    assert groups.broken_groups(df.limit(0), records).count() == 0 and sorted(map(tuple, groups.broken_groups(df, records.limit(0)).collect())) == [(1, 1), (2, 1)]
    out = {r.spec_id: r for r in groups.assign_splits(df, records).collect()}
    assert out[1].assigned_split == out[2].assigned_split == "train" and out[3].assigned_split == out[4].assigned_split == out[6].assigned_split
    assert out[1].group_records == 70 and out[3].group_records == 25 and out[2].keeps_intent is False and out[5].keeps_intent is None


def test_balance_is_near_the_targets(spark):
    r = random.Random(1)
    weights = [(i, r.randint(0, 30)) for i in range(5000)] + [(9000, 900)]
    out = groups.balance(spark.createDataFrame(weights, "item bigint, weight bigint")).collect()
    assert len(out) == 5001
    w, total, have = dict(weights), sum(x for _, x in weights), {}
    for x in out:
        have[x.split] = have.get(x.split, 0) + w[x.item]
    assert all(abs(have[s] / total - t) < 0.02 for s, t in groups.SPLITS.items())


# ---- near duplicates


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def shingles(text, n=3):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@SLOW
@given(st.lists(st.text(alphabet="aB é9_-.\n漢", max_size=30), max_size=5))
def test_word_shingles(texts):
    of, _, count = word_shingles(texts, 3)
    for i, t in enumerate(texts):
        clean = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t)
        assert (of == i).sum() == len(shingles(clean)) and count[of == i].sum() == max(0, len(words(clean)) - 2)


def test_char_shingles():
    of, h, count = char_shingles(["abcabc", "ab", "", "xabc"], 3)
    assert [(of == i).sum() for i in range(4)] == [3, 0, 0, 2] and count[of == 0].sum() == 4
    assert len(set(h[of == 0]) & set(h[of == 3])) == 1


def test_bagminhash_estimates_weighted_jaccard():
    r = np.random.default_rng(1)
    element = np.sort(r.integers(1, 1 << 60, 60).astype(np.uint64))
    a, b = r.integers(0, 9, 60), r.integers(0, 9, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    of = np.repeat([0, 1], 60)
    s = bagminhash.signatures(of, np.concatenate((element, element)), np.concatenate((a, b)), 2, 4096)
    assert abs((s[0] == s[1]).mean() - want) < 0.03
    s = bagminhash.signatures(of[20:100], np.concatenate((element, element))[20:100], None, 2, 4096)
    assert abs((s[0] == s[1]).mean() - 20 / 60) < 0.03


def edited(r):
    base = [r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(40)]
    out = [" ".join(base)]
    for _ in range(r.randint(0, 3)):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        out.append(" ".join(w).upper() if r.random() < 0.3 else ", ".join(w))
    return out


def test_near_duplicate_pairs(spark):
    r = random.Random(7)
    texts = [t for _ in range(60) for t in edited(r)] + ["one two three", "One, two: THREE", "one two", "", None, "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    want = set()
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            x, y = shingles(a or ""), shingles(texts[j] or "")
            if x and y and 2 * len(x & y) >= len(x | y):
                want.add((i, j))
    assert {tuple(p) for p in neardup.near_duplicate_pairs(df, "k", "t", neardup.TEXT).collect()} == want
    g = {x.k: x for x in neardup.near_duplicate_groups(df, "k", "t", neardup.TEXT).collect()}
    assert all(g[i].group_id == g[j].group_id for i, j in want)
    assert (g[len(texts) - 6].class_rows, g[len(texts) - 6].links) == (1, 1) and len(texts) - 4 not in g
    assert neardup.near_duplicate_pairs(df.limit(0), "k", "t", neardup.TEXT).count() == 0


def test_long_texts_without_a_common_run(spark):
    """Two texts of 150,000 words with no word in common have no overlap, and are compared by their words whatever the hashes say."""
    a, b = (" ".join(f"{x}{i}" for i in range(150_000)) for x in "pq")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a bigint, b bigint")
    texts = spark.createDataFrame([(1, a), (2, b), (3, a + " tail")], "sid bigint, text string")
    assert [(r.a, r.b) for r in neardup.verified(pairs, texts, neardup.TEXT).collect()] == [(1, 3)]
    of, run, _ = word_shingles([a, b], 3)
    assert len(run) == 2 * 149_998 and len(set(run.tolist())) == len(run)


def test_block_join(spark):
    rows = [(1, i) for i in range(57)] + [(2, 7)] + [(3, i) for i in range(9)]
    left = spark.createDataFrame(rows, "key bigint, x bigint")
    right = left.withColumnRenamed("x", "y").where("key <> 3 or y < 4")
    got = [tuple(r) for r in neardup.block_join(left, right, block=10).collect()]
    want = {(k, x, y) for k, x in rows for j, y in rows if j == k and (k != 3 or y < 4)}
    assert len(got) == len(want) and set(got) == want


def hot_rows():
    """A third of all rows share a band key for sure (and are pairwise similar), another third are copies of one text."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    near = [" ".join(w if i != k else f"z{k}" for i, w in enumerate(base)) for k in range(60)]
    other = [" ".join(r.choice(WORDS) + str(r.randint(0, 900)) for _ in range(30)) for _ in range(60)]
    return near + ["one text that is there again and again"] * 60 + other


def test_hot_keys(spark):
    texts = hot_rows()
    df = spark.createDataFrame([(i, t, i % 4 == 0) for i, t in enumerate(texts)], "k bigint, t string, side boolean").repartition(7)
    bags = [shingles(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if 2 * len(bags[i] & bags[j]) >= len(bags[i] | bags[j])}
    assert {tuple(p) for p in neardup.near_duplicate_pairs(df, "k", "t", neardup.TEXT).collect()} == want
    classes = neardup.classed(df, "t", neardup.TEXT, "k", "side")
    met = {r.sid for r in neardup.across_classes(classes, classes.select("sid", "side"), neardup.TEXT, "side").collect()}
    got = {r.k for r in classes.where("side").select("k", "sid").collect() if r.sid in met}
    assert got == {i for i in range(0, len(texts), 4) if any((min(i, j), max(i, j)) in want for j in range(len(texts)) if j % 4)}
    # what a step sends of a hot key is one row; its members go by the group's own number
    rows = _hot.grouped(np.array([80] * 900 + [88, 96]), np.arange(902), None).to_pylist()
    assert sum(x["key"] >> 3 in (10, 11, 12) for x in rows) == 3 and len(rows) == 903 and len({x["key"] for x in rows}) == 4


def test_shared_rows_in_any_batches():
    """Keys that two classes (of both sides) have, whatever the batches."""
    import pyarrow as pa

    r = random.Random(4)
    for sides in (False, True):
        rows = sorted((r.randrange(40) * 8 + (r.randrange(2) if sides else 0), r.randrange(6)) for _ in range(120))
        for size in (1, 3, 50, 500):
            batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[at : at + size]], pa.int64()) for i in (0, 1)], names=["key", "sid"]) for at in range(0, len(rows), size)]
            got = [(x["key"], x["sid"]) for b in _hot._shared(iter(batches), sides) for x in b.to_pylist()]
            by = {}
            for k, s in rows:
                by.setdefault(k >> 3, set()).add((k & 1) if sides else s)
            assert got == sorted({x for x in rows if len(by[x[0] >> 3]) > 1})


def test_hot_keys_of_shared_spans(spark):
    """A third of all documents share one stretch, as a whole and in part."""
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("cdefg hij") for _ in range(n))
    hot = "".join(r.choice("abkl ") for _ in range(60))
    docs = [(k, noise(30) + (hot if k % 3 else hot[5:40]) + noise(30)) for k in range(40)] + [(100 + k, noise(120)) for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {tuple(x) for x in shared_spans.shared_spans(df, wanted=20).collect()} == shared_twin(docs, 20)


def test_weighted_likeness(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, base), (2, base.replace("w30", "x")), (3, base + " " + base), (4, base)], "k bigint, t string")
    assert {tuple(p) for p in neardup.near_duplicate_pairs(df, "k", "t", neardup.WORDS5).collect()} == {(1, 2), (1, 4), (2, 4)}


# ---- overlap across splits


def test_overlaps(spark):
    long = " ".join(f"word{i}" for i in range(30))
    meta = lambda s, i, f, v: (s, i, f, [(v, "companion"), (v, "focus")] if v else None)
    rows = [
        (1, long, "train", meta("src", "ID-1", "fam_a", "AB")), (2, long + " tail", "dev", meta("src", " id-1 ", "other", None)), (3, "nothing like it at all", "test", meta("src2", "ID-1", "Fam-A", "ab ")),
        (4, long, None, meta("src", "ID-1", "fam_a", "AB")), (5, None, "Dev ", meta(None, "unknown", "n/a", "000")), (6, long, "test", meta("src", None, None, None)), (7, None, "train", meta(None, "unknown", "N/A", "000")),
    ]
    df = spark.createDataFrame(rows, "record_idx bigint, text string, split string, meta struct<source:string,source_record_id:string,template_family:string,contrast_targets:array<struct<value_sha256:string,target_role:string>>>")
    assert {tuple(r) for r in crosssplit.overlaps(df).collect()} == {(2, "text"), (2, "source_id"), (3, "family"), (3, "value_hash"), (6, "text")}
    assert {(r.split, r.source, r.overlap_kind): (r.records, r.overlapping) for r in crosssplit.report(df).collect()}[("test", "src2", "family")] == (1, 1)
    assert crosssplit.overlaps(df.limit(0)).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@SLOW
@given(st.text("ab", max_size=12), st.text("ab", max_size=12), st.integers(0, 4))
def test_banded_distance(a, b, most):
    want = levenshtein(a, b)
    assert segments.distance_within(a, b, most) == (want if want <= most else None)


def test_segment_join(spark):
    r = random.Random(5)

    def edit(t):
        t = list(t)
        for _ in range(r.randint(0, 4)):
            i = r.randrange(len(t) + 1)
            t[i : i + r.randint(0, 1)] = r.choice(["", "x", "y"])
        return "".join(t)

    base = ["".join(r.choice("abcd🙂") for _ in range(r.randint(3, 40))) for _ in range(40)]
    train, test = [edit(t) for t in base] + [None, ""], [edit(t) for t in base] + [base[0], None]
    a, b = (spark.createDataFrame([(t,) for t in x], "text string") for x in (test, train))
    from pyspark.sql import functions as F

    h = {t: k for t, k in spark.createDataFrame([(t,) for t in {*train, *test} - {None}], "text string").select("text", F.xxhash64("text")).collect()}
    want = {(h[x], h[y], levenshtein(x, y)) for x in test for y in train if x is not None and y is not None and levenshtein(x, y) <= 3}
    assert {tuple(p) for p in segments.edit_join(a, b).collect()} == want


# ---- shared spans


def shared_twin(docs, n):
    where = {}
    for k, t in docs:
        for i in range(len(t or "") - n + 1):
            where.setdefault(t[i : i + n], set()).add(k)
    out = {}
    for k, t in docs:
        for i in range(len(t or "") - n + 1):
            if len(where[t[i : i + n]]) > 1:
                spans = out.setdefault(k, [])
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], i + n)
                else:
                    spans.append([i, i + n])
    return {(k, a, b) for k, s in out.items() for a, b in s}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_spans(spark, seed):
    r = random.Random(seed)
    some = ["".join(r.choice("ab ") for _ in range(r.randint(18, 70))) for _ in range(6)]
    docs = []
    for k in range(40):
        t = "".join(r.choice("cdefg 漢🙂") for _ in range(r.randint(0, 60)))
        for _ in range(r.randint(0, 3)):
            s = r.choice(some)
            a = r.randint(0, 10)
            t += s[a : a + r.randint(10, 60)] + "".join(r.choice("cdefg") for _ in range(r.randint(0, 9)))
        docs.append((k, t))
    docs += [(100, docs[3][1]), (101, "q" * 400), (102, "q" * 300), (103, "r" * 300), (104, None), (105, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {tuple(x) for x in shared_spans.shared_spans(df, wanted=20).collect()} == shared_twin(docs, 20)
    share = {x.doc_id: x for x in shared_spans.shared_share(df, wanted=20).collect()}
    assert share[101].share == 1.0 and share[103].share == 0.0 and share[104].n_chars == 0 and len(share) == len(docs)


def test_shared_spans_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert shared_spans.shared_spans(df).count() == 0


def test_clashing_and_extra_columns(spark):
    text = " ".join(WORDS * 4)
    extra = "sid bigint, t string, n bigint, key bigint, doc bigint, h bigint, side boolean, mark bigint, ids bigint, text bigint, item_key bigint"
    df = spark.createDataFrame([(i, text, 5, None, 1, 1, True, 1, None, 1, 1) for i in (1, 2)], extra)
    assert [tuple(r) for r in neardup.near_duplicate_pairs(df, "sid", "t", neardup.TEXT).collect()] == [(1, 2)]
    assert {r.sid: r.class_rows for r in neardup.near_duplicate_groups(df, "sid", "t", neardup.TEXT).collect()} == {1: 2, 2: 2}
    assert packing.pack_sizes(df, "sid", "n").select("sid").count() == 2 and packing.pack_sizes(df, "item_key", "n").columns[0] == "item_key"
    assert sorted(tuple(r) for r in shared_spans.shared_spans(df, "sid", "t").collect()) == [(1, 0, len(text)), (2, 0, len(text))]
    assert tokens.encode(df, "sid", "t").count() == 2 and cutting.cut_texts(df, "sid", "t").count() == 0
