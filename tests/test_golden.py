"""Known small cases, and brute-force twins of what SQL cannot express."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.functions.metrics import harmonic_mean
from spanloom.operators import conversion, corpus, decoding, evidence, gates, matching, outcomes, spans
from spanloom.plans import catalogue
from spanloom.schema import bio_dim, label_dim

GOLD = "record_idx bigint, gold_idx int, s int, e int, label string"
PRED = "record_idx bigint, pred_idx int, s int, e int, label string, confidence double"
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def both(spark, gold, pred):
    return spark.createDataFrame(gold, GOLD), spark.createDataFrame([(*p, 0.9) for p in pred], PRED)


def test_ontology(spark):
    assert label_dim(spark).count() == 25
    ids = {r.id: r.tag for r in bio_dim(spark).collect()}
    assert len(ids) == 51 and ids[0] == "O" and ids[50] == "I-API_KEY"


def test_bio_valid_and_orphans(spark):
    rows = [(1, i, tag, c) for i, (tag, c) in enumerate([("B-EMAIL", 0.8), ("I-EMAIL", 0.6), ("O", 0.99), ("B-SSN", 0.75)])]
    rows += [(2, i, tag, 0.5) for i, tag in enumerate(["I-EMAIL", "I-EMAIL", "I-SSN", "B-EMAIL", "O"])]
    out = decoding.bio_spans(spark.createDataFrame(rows, "r bigint, i int, tag string, confidence double"), "r", ["i"]).orderBy("r", "span_no").collect()
    assert [(x.r, x.label, x.first_token, x.last_token, x.opened_badly) for x in out] == [(1, "EMAIL", 1, 2, False), (1, "SSN", 4, 4, False), (2, "EMAIL", 1, 2, True), (2, "SSN", 3, 3, True), (2, "EMAIL", 4, 4, False)]
    assert (out[0].mean_confidence, out[0].least_confidence) == (0.7, 0.6)


def test_exact_scores(spark):
    gold, pred = both(spark, [(0, 0, 0, 3, "SSN"), (0, 1, 4, 7, "EMAIL"), (1, 0, 0, 4, "CITY")], [(0, 0, 0, 3, "SSN"), (0, 1, 4, 7, "EMAIL"), (2, 0, 0, 3, "EMAIL")])
    o = {r.scope: r for r in matching.overall(matching.label_counts(gold, pred, label_dim(spark))).collect()}
    assert (o["micro"].precision, o["micro"].recall, o["micro"].f1) == (0.666667, 0.666667, 0.666667)
    assert (o["macro"].precision, o["macro"].recall) == (0.06, 0.08)


@pytest.mark.parametrize(("span", "category"), [((3, 8, "EMAIL"), "too_short"), ((1, 9, "EMAIL"), "too_long"), ((3, 9, "EMAIL"), "shifted"), ((2, 8, "SSN"), "wrong_class"), ((2, 8, "EMAIL"), "exact")])
def test_taxonomy(spark, span, category):
    gold, pred = both(spark, [(0, 0, 2, 8, "EMAIL")], [(0, 0, *span)])
    assert [r.category for r in matching.taxonomy(gold, pred).collect()] == [category]


def greedy_twin(gold, pred):
    left, right = list(gold), list(pred)
    out = Counter()
    for g in list(left):
        for p in right:
            if p[1:] == g[1:]:
                out["exact"] += 1
                left.remove(g)
                right.remove(p)
                break
    cands = []
    for g in left:
        for p in right:
            over = min(g[2], p[2]) - max(g[1], p[1])
            if over > 0:
                cands.append((over / (max(g[2], p[2]) - min(g[1], p[1])), g, p))
    for _, g, p in sorted(cands, key=lambda c: (c[0], c[1][0], c[2][0]), reverse=True):
        if g in left and p in right:
            left.remove(g)
            right.remove(p)
            out["paired"] += 1
    return out["exact"], out["paired"], len(left), len(right)


@SLOW
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 5), st.sampled_from("AB")), max_size=6), st.lists(st.tuples(st.integers(0, 9), st.integers(1, 5), st.sampled_from("AB")), max_size=6))
def test_greedy_matching_against_twin(spark, a, b):
    gold = [(i, s, s + n, x) for i, (s, n, x) in enumerate(a)]
    pred = [(i, s, s + n, x) for i, (s, n, x) in enumerate(b)]
    got = Counter(r.category for r in matching.taxonomy(*both(spark, [(0, *g) for g in gold], [(0, *p) for p in pred])).collect())
    paired = sum(got[c] for c in ("wrong_class", "too_short", "too_long", "shifted"))
    assert (got["exact"], paired, got["false_negative"], got["false_positive"]) == greedy_twin(gold, pred)


def test_security_outcomes(spark):
    gold, pred = both(
        spark,
        [(0, 0, 2, 8, "SSN"), (1, 0, 2, 8, "SSN"), (2, 0, 2, 8, "SSN"), (3, 0, 2, 8, "SSN"), (4, 0, 2, 8, "SSN")],
        [(0, 0, 2, 8, "SSN"), (1, 0, 1, 9, "SSN"), (2, 0, 1, 9, "PHONE"), (3, 0, 3, 9, "SSN"), (3, 1, 0, 3, "SSN"), (5, 0, 0, 2, "AGE")],
    )
    out = {(r.record_idx, r.pred_idx): r.outcome for r in outcomes.security_outcomes(gold, pred).collect()}
    assert out == {(0, 0): "exact", (1, 0): "boundary_long", (2, 0): "safe_wrong_class", (3, 0): "partial", (4, None): "miss", (5, 0): "overmasking"}


def test_gates(spark):
    kind = "name string, threshold double, metric string, operator string, flag boolean"
    rows = [("macro_f1_MINIMUM", 0.9, "macro_f1", None, None), ("record_error_rate_maximum", 0.05, None, None, None), ("revision", 1.0, None, "==", None), ("minimum_individual_label_recall", 0.5, None, None, None), ("strict", 0.9, "macro_f1", ">", None), ("frozen", None, None, "==", True)]
    m = spark.createDataFrame([("macro_f1", 0.91, None), ("record_error_rate", 0.08, None), ("revision", 1.0, None), ("minimum_individual_label_recall", 0.6, None), ("frozen", None, True)], "metric string, actual double, flag boolean")
    got = {r.name: r.passed for r in gates.evaluate_gates(spark.createDataFrame(rows, kind), m).collect()}
    assert got == {"macro_f1_MINIMUM": True, "record_error_rate_maximum": False, "revision": True, "minimum_individual_label_recall": True, "strict": True, "frozen": True}
    for bad in (("odd_min_max", 1.0, None, None, None), ("macro_f1", 1.0, None, None, None), ("absent_min", 1.0, None, None, None), ("macro_f1_min", 1.0, None, "~", None), ("macro_f1_min", float("nan"), None, None, None), ("frozen_min", None, "frozen", None, True)):
        with pytest.raises(Exception, match="gate|actual value|unsupported|finite"):
            gates.evaluate_gates(spark.createDataFrame([bad], kind), m).collect()
    assert not gates.evaluate_gates(spark.createDataFrame([("absent_min", 1.0)], "name string, threshold double"), m, lenient=True).first().passed


def test_best_step_needs_the_margin(spark):
    s = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.9005), ("a", 3, 0.9012), ("a", 4, 0.902)], "k string, step int, score double")
    assert gates.best_step(s, "k", "step", "score").first().best == 3
    assert gates.choose_model({"misses": 3, "partials": 1, "high_risk_recall": 0.9, "micro_f1": 0.9}, {"misses": 9, "partials": 1, "high_risk_recall": 0.9, "micro_f1": 0.95}) == "a"


def test_overlap_resolution(spark):
    c = spark.createDataFrame([(0, 0, 0, 5, "AGE"), (0, 1, 0, 9, "SSN"), (0, 2, 8, 12, "DOB"), (0, 3, 0, 9, "SSN"), (0, 4, 12, 14, "CITY")], GOLD)
    out = {(r.s, r.e): (r.kept, r.members, r.conflict and r.conflict.label) for r in conversion.resolve_overlaps(c).collect()}
    assert out == {(0, 9): (True, 2, None), (0, 5): (False, 1, "SSN"), (8, 12): (False, 1, "SSN"), (12, 14): (True, 1, None)}


def test_parse_spans(spark):
    rows = [(1, '[{"start":1,"end":2,"label":"A"},[3,4,"B"]]'), (2, '{"spans":[[5,6,"C"]]}'), (3, '{"D":[[7,8]],"E":[[9,10],[11,12]]}'), (4, "no json"), (5, None), (6, '{"start":0,"end":1,"label":"F"}'), (7, "[]")]
    got = sorted((r.k, r.span_index, r.start, r.end, r.label) for r in conversion.parse_spans(spark.createDataFrame(rows, "k bigint, raw string"), "k", "raw").where("label is not null").collect())
    assert got == [(1, 0, "1", "2", "A"), (1, 1, "3", "4", "B"), (2, 0, "5", "6", "C"), (3, 0, "7", "8", "D"), (3, 0, "9", "10", "E"), (3, 1, "11", "12", "E"), (6, 0, "0", "1", "F")]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.taxonomy_name(F.lit(" credit-card / number."))) == "CREDIT_CARD_NUMBER"
    assert one(X.skeleton(F.lit("Hi {{Name}},  <<ID>> [[x]] {y}"))) == "hi <placeholder>, <placeholder> <placeholder> <placeholder>"
    assert one(X.luhn_valid(F.lit("4539 1488 0343 6467"))) and not one(X.luhn_valid(F.lit("4539148803436468"))) and not one(X.luhn_valid(F.lit("")))
    assert one(X.luhn_check_digit(F.lit("453914880343646"))) == 7
    assert one(X.routing_valid(F.lit("021000021"))) and not one(X.routing_valid(F.lit("021000022")))
    assert one(X.iban_valid(F.lit("GB82 WEST 1234 5698 7654 32"))) and not one(X.iban_valid(F.lit("GB83WEST12345698765432")))
    assert one(X.jaccard(X.token_trigrams(F.lit("a b")), X.token_trigrams(F.lit("")))) == 1.0
    assert one(X.stable_seed(F.lit(42), F.lit("x"))) == int.from_bytes(hashlib.sha256(b"42\0x\0").digest()[:8], "big")
    assert one(X.sequence_ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75
    assert one(X.blank_spans(F.lit("ab cd ef"), F.expr("array(struct(3 as span_start, 5 as span_end, 'X' as label))"))) == "ab <placeholder> ef"
    assert X.closed_aliases({"a": "b", "b": "c", "x": "y", "y": "x"}) == {"a": "c", "b": "c", "x": "y", "y": "x"}
    assert one(harmonic_mean(F.lit(0.5), F.lit(1.0))) == pytest.approx(2 / 3)


@SLOW
@given(st.lists(st.integers(1, 60), min_size=1, max_size=6))
def test_allocation_against_twin(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    got = {r.stratum: (r.train, r.dev, r.test) for r in corpus.allocation(spark.createDataFrame(rows, "stratum string, groups bigint")).collect()}
    for name, n in rows:
        x = [n * r for r in (0.8, 0.1, 0.1)]
        base = [int(v + 1e-9) for v in x]
        for i in sorted(range(3), key=lambda i: (-round(x[i] - base[i], 9), i))[: n - sum(base)]:
            base[i] += 1
        for i in range(3):
            if n >= 3 and base[i] == 0:
                j = max(range(3), key=lambda k: base[k])
                if base[j] > 1:
                    base[i], base[j] = 1, base[j] - 1
        assert got[name] == tuple(base)


def test_span_faults(spark):
    rows = [(1, "hello world", [(0, 5, "SSN"), (0, 5, "SSN"), (3, 8, "AGE"), (9, 99, "AGE"), (1, 4, "nope"), (None, 3, "AGE")], "train"), (2, None, [(0, 1, "AGE")], None), (3, "x", None, "dev"), (4, "", [], "dev")]
    r = spark.createDataFrame(rows, "record_idx bigint, text string, entities array<struct<span_start:int,span_end:int,label:string>>, split string")
    got = defaultdict(list)
    for x in spans.span_faults(r).collect():
        got[x.record_idx].append((x.gold_idx, x.fault))
    assert dict(got[1]) == {0: None, 1: "duplicate", 2: "overlap", 3: "out_of_bounds", 4: "unknown_label", 5: "missing_field"}
    assert got[2] == [(0, "out_of_bounds")] and 3 not in got and 4 not in got


def test_alignment(spark):
    text = "abcdef gh"
    r = spark.createDataFrame([(1, text)], "record_idx bigint, text string")
    w = spark.createDataFrame([(1, 0, [(0, 3), (3, 6), (7, 9)], 1)], "record_idx bigint, window_index int, offset_mapping array<struct<tok_start:int,tok_end:int>>, aligned_at int")
    g = spark.createDataFrame([(1, 0, 0, 6, "A"), (1, 1, 7, 8, "A")], GOLD)
    assert {x.gold_idx: x.status for x in decoding.align_spans(g, w, r).collect()} == {0: "aligned", 1: "boundary_adjusted"}
    g = spark.createDataFrame([(1, 0, 0, 2, "A"), (1, 1, 2, 3, "A"), (1, 2, 6, 7, "A")], GOLD)
    assert {x.gold_idx: x.status for x in decoding.align_spans(g, w, r).collect()} == {0: "collision", 1: "collision", 2: "failed"}


def test_evidence(spark, tmp_path):
    a = tmp_path / "a.json"
    evidence.atomic_json(str(a), {"b": 1})
    assert evidence.read_side_car(str(a) + ".sha256", "a.json") == evidence.side_car(str(a)) if evidence.side_car(str(a)) else False
    with pytest.raises(FileExistsError):
        evidence.guard_absent(str(a))
    evidence.receipt(str(tmp_path / "r.json"), {})
    with pytest.raises(FileExistsError):
        evidence.receipt(str(tmp_path / "r.json"), {})
    have = evidence.artifacts(spark, str(tmp_path))
    want = have.withColumn("bytes", F.when(F.col("path").endswith("r.json"), 0).otherwise(F.col("bytes")).cast("bigint"))
    assert sorted(r.state for r in evidence.verify(want, have).collect()) == ["changed", "same", "same"]
    assert evidence.jsonl_sha256(spark.createDataFrame([(2, "b"), (1, "a")], "k int, t string"), "k", "t") == hashlib.sha256(b"a\nb\n").hexdigest()
    assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in have.collect()}["a.json"] == hashlib.sha256(a.read_bytes()).hexdigest()
    rows = [(i, f"line {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "k int, t string")
    same = evidence.lines_sha256(df, "k", "t")
    assert same == evidence.lines_sha256(spark.createDataFrame(rows[::-1], "k int, t string").repartition(7), "k", "t")
    assert len({same, evidence.lines_sha256(df.where("k > 0"), "k", "t"), evidence.lines_sha256(df.withColumn("t", F.upper("t")), "k", "t"), evidence.lines_sha256(df.unionByName(df.where("k = 0")), "k", "t"), evidence.lines_sha256(df.limit(0), "k", "t")}) == 5


def test_overflow_windows_cut_the_whole_record(spark, tmp_path):
    """A record delivered in two overlapping windows, the later one aligned twice: its whole token list is cut, and the span in its tail gets its tag."""
    at = lambda lo, hi: [(i * 2, i * 2 + 2) for i in range(lo, hi)]
    w = spark.createDataFrame([(1, 0, [*at(0, 384), (0, 0)], 1), (1, 1, at(256, 500), 2), (1, 1, at(256, 300), 1), (2, 0, at(0, 3), 1)], "record_idx bigint, window_index int, offset_mapping array<struct<tok_start:int,tok_end:int>>, aligned_at int")
    assert [(r.record_idx, r.n, r.last, r.te) for r in decoding.record_tokens(w).groupBy("record_idx").agg(F.count("ts").alias("n"), F.max("tok_idx").alias("last"), F.max("te").alias("te")).orderBy("record_idx").collect()] == [(1, 500, 499, 1000), (2, 3, 2, 6)]
    w.write.parquet(str(tmp_path / "align_window.parquet"))
    r = spark.createDataFrame([(1, "x" * 1000, [(980, 984, "SSN")], "dev"), (2, "abcdef", [], "dev")], "record_idx bigint, text string, entities array<struct<span_start:int,span_end:int,label:string>>, split string")
    r.write.parquet(str(tmp_path / "split_record.parquet"))
    got = sorted(map(tuple, catalogue.QUERIES["overflow_windows"](spark, str(tmp_path)).collect()))
    assert got == [(1, 0, 384, 0, 0), (1, 1, 244, 1, 0), (2, 0, 3, 0, 0)]


def test_join_hot(spark, monkeypatch):
    from pyspark.sql import functions as F

    from spanloom.operators import staging

    monkeypatch.setattr(staging, "LEAST_HOT", 5)
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(k, k) for k in range(2, 30)] + [(None, 7)], "k bigint, x bigint")
    per = rows.where("k <> 9").groupBy("k").agg(F.max("x").alias("m"), F.count(F.lit(1)).alias("n"))
    want = sorted((r.k, r.x, 49 if r.k == 1 else r.k) for r in rows.collect() if r.k is not None and r.k != 9)
    assert sorted((r.k, r.x, r.m) for r in staging.join_hot(rows, per, ["k"]).collect()) == want
