"""Audits whose results SQL does not give, against known cases and brute force."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from spanloom.operators import audits
from spanloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def test_greatest_similarities_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(audits, "BLOCK", 7)
    r = random.Random(5)
    names = {f"n{i:02d}": " ".join(r.choice(["card", "cards", "key", "ip", "log", "login"]) for _ in range(r.randint(1, 5))) for i in range(40)} | {"z": "qqq www zzz"}
    t = spark.createDataFrame(list(names.items()), "name string, template string")
    got = {x.name: x for x in audits.greatest_similarities(t, t).collect()}
    assert set(got) == set(names)
    grams = {k: {tuple(v.split()[i : i + 3]) for i in range(len(v.split()) - 2)} for k, v in names.items()}
    for k, v in names.items():
        ratio = {o: SequenceMatcher(None, v, w, autojunk=False).ratio() for o, w in names.items() if o != k}
        share = {o: len(grams[k] & grams[o]) / len(grams[k] | grams[o]) if grams[k] | grams[o] else 1.0 for o in names if o != k}
        best, most = max(ratio.values()), max(share.values())
        assert (got[k].ratio, got[k].ratio_other) == (pytest.approx(best, abs=1e-6), min(o for o in ratio if ratio[o] == best))
        assert got[k].trigram == pytest.approx(most, abs=1e-6)
        assert got[k].other == (min(o for o in share if share[o] == most) if most else None)


def test_error_tags_of_missed_spans_and_gold_sides(spark):
    errors = [(1, 0, 4, None, None, "SSN", None), (1, 20, 30, 26, 34, "SSN", "BUSINESS_ID"), (1, None, None, 50, 54, None, "SSN"), (1, 60, 64, None, None, "SSN", None)]
    e = spark.createDataFrame(errors, "record_idx bigint, gs int, ge int, ps int, pe int, gold_label string, pred_label string")
    target = spark.createDataFrame([(1, 2, 6, "BUSINESS_ID", "ssn", "case_id"), (1, 18, 22, "SSN", "ssn", None), (1, 50, 54, "O", "ssn", None)], "record_idx bigint, s int, e int, expected_label string, category string, subtype string")
    m = spark.createDataFrame([(1, ("json", "abbreviated_key", None))], "record_idx bigint, meta struct<text_format:string,surface_style:string,entity_provenance:array<struct<source_label:string>>>")
    got = {(x.gs, x.ps): x.tags for x in audits.error_tags(e, m, target, {"ssn": "SSN"}).collect()}
    both = ["ambiguous-key", "structured-field-confusion"]
    assert got == {(0, None): ["ambiguous-key", "unseen-business-subtype", "structured-field-confusion"], (20, 26): ["context-over-morphology", *both], (None, 50): ["morphology-over-context", *both], (60, None): []}


def test_error_tags_has_every_error(spark):
    from spanloom.operators import matching

    t = catalogue.Tables(spark, FOLDER)
    tax = matching.taxonomy(t.scored_gold, t.pred).where("category <> 'exact'").groupBy("category").count().collect()
    got = catalogue.QUERIES["error_tags"](spark, FOLDER).groupBy("category").count().collect()
    assert "false_negative" in {r.category for r in got} and sorted(map(tuple, got)) == sorted(map(tuple, tax))


def test_dataset_gates_by_brute_force(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pq.read_table(f"{FOLDER}/split_record.parquet")
    pq.write_table(pa.concat_tables([table, table.slice(0, 5)]), tmp_path / "split_record.parquet")
    rows = pq.read_table(tmp_path / "split_record.parquet").to_pylist()
    want = dict.fromkeys(("provenance_differs", "target_offsets", "target_hashes", "target_labels", "repeated_ids"), 0)
    ids: dict = {}
    import hashlib

    for r in rows:
        m, text = r["meta"] or {}, r["text"]
        spans = {(x["span_start"], x["span_end"], x["label"]) for x in r["entities"] or []}
        want["provenance_differs"] += spans != {(x["span_start"], x["span_end"], x["label"]) for x in m.get("entity_provenance") or []}
        if m.get("source_record_id") is not None:
            k = (m.get("source") or "", m["source_record_id"])
            ids[k] = ids.get(k, 0) + 1
        for x in m.get("contrast_targets") or []:
            s, e = x["span_start"], x["span_end"]
            fits = text is not None and s is not None and e is not None and 0 <= s < e <= len(text)
            want["target_offsets"] += not fits
            if fits:
                want["target_hashes"] += x["value_sha256"] is None or hashlib.sha256(text[s:e].encode()).hexdigest() != x["value_sha256"].lower()
                if x["expected_label"] == "O":
                    ok = r["entities"] is not None and not any(y["span_start"] < e and y["span_end"] > s for y in r["entities"] if y["span_start"] is not None and y["span_end"] is not None)
                else:
                    ok = (s, e, x["expected_label"]) in spans
                want["target_labels"] += not ok
    want["repeated_ids"] = sum(n > 1 for n in ids.values())
    got = {r.gate: r.actual for r in catalogue.QUERIES["dataset_gates"](spark, str(tmp_path)).collect()}
    assert len(got) == 11 and want["repeated_ids"] > 0
    assert {k: got[k] for k in want} == want
