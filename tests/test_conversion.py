from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import conversion, corpus, decoding
from spanloom.sources import contracts, discovery


def test_convert(spark):
    rows = [
        (1, "John Doe, born 1990", json.dumps([{"start": 0, "end": 8, "label": "first-name"}, {"start": 0, "end": 4, "label": "PERSON_NAME"}, {"start": 15, "end": 19, "label": "DOB"}, {"start": 5, "end": 99, "label": "AGE"}, {"start": True, "end": 3, "label": "AGE"}])),
        (2, "nothing", None), (3, "  ", "[]"), (4, None, "[]"), (5, "abc", '[{"start":0,"end":1,"label":""}]'),
    ]
    out = {r.record_idx: r for r in conversion.convert(spark.createDataFrame(rows, "record_idx bigint, text string, raw_spans string"), {"FIRST_NAME": "PERSON_NAME"}, deferred=("DOB",)).collect()}
    assert set(out) == {1, 2, 5}
    assert [tuple(e) for e in out[1].entities] == [(0, 8, "PERSON_NAME")] and out[1].provenance[0].source_label == "first-name"
    assert sorted(x.reason for x in out[1].excluded) == ["deferred", "missing_offsets", "offsets_outside_text", "overlap_conflict"] and out[1].training_exclusion
    assert out[2].entities is None and not out[2].training_exclusion and out[5].excluded[0].reason == "missing_label"


def test_merge(spark):
    rows = [(1, "a", [(0, 1, "AGE")], "s", True, False), (2, "a", [], "t", True, False), (3, "a", [(0, 1, "AGE")], "t", True, False), (4, "b", None, "t", False, False), (5, "c", None, None, True, True)]
    df = spark.createDataFrame(rows, "record_idx bigint, text string, entities array<struct<span_start:int,span_end:int,label:string>>, source string, valid boolean, training_exclusion boolean").withColumn("excluded", F.array().cast("array<struct<blocks:boolean>>"))
    merged, stats = corpus.merge(df.drop("source").join(df.select("record_idx", F.col("source").alias("src")), "record_idx"), F.col("src"))
    assert [r.record_idx for r in merged.collect()] == [1]
    assert {r.source: (r.read, r.invalid, r.excluded, r.duplicates, r.conflicts, r.merged) for r in stats.collect()} == {"s": (1, 0, 0, 0, 0, 1), "t": (3, 1, 0, 2, 1, 0), "<unattributed>": (1, 0, 1, 0, 0, 0)}


def test_overflow_windows(spark):
    t = spark.createDataFrame([(1, i, i, i + 1) for i in range(10)] + [(2, 0, 0, 1)], "record_idx bigint, tok_idx int, ts int, te int")
    out = {}
    for r in decoding.overflow_windows(t, 4, 1).collect():
        out.setdefault((r.record_idx, r.window_index), []).append(r.ts)
    assert {k: sorted(v) for k, v in out.items()} == {(1, 0): [0, 1, 2, 3], (1, 1): [3, 4, 5, 6], (1, 2): [6, 7, 8, 9], (2, 0): [0]}
    spans = spark.createDataFrame([(1, 0, 2, 5, "AGE"), (1, 1, 4, 6, "SSN")], "record_idx bigint, gold_idx int, s int, e int, label string")
    tags = {(r.window_index, r.ts): r.tag for r in decoding.bio_tags(decoding.overflow_windows(t, 4, 1), spans).where("record_idx = 1").collect()}
    assert tags[(0, 2)] == "B-AGE" and tags[(0, 3)] == "I-AGE" and tags[(1, 3)] == "B-AGE" and tags[(1, 4)] == "IGNORE" and tags[(1, 5)] == "I-SSN" and tags[(2, 9)] == "O"
    assert decoding.weighted_loss(spark.createDataFrame([(1.0, 1), (4.0, 2)], "loss double, tokens int")).first().loss == 3.0


def test_discovery(spark, tmp_path):
    df = spark.createDataFrame([(7, "text a", "[]", "EN_us"), (8, "text b", "[]", "Spanish")], "`Record ID` int, `Generated-Text` string, `pii spans` string, Language string")
    df.write.parquet(str(tmp_path / "x.parquet"))
    told = {r.part: r.column for r in discovery.inspect(df).collect()}
    assert told == {"text": "Generated-Text", "spans": "pii spans", "language": "Language", "record_id": "Record ID"}
    assert [r.text for r in discovery.load(spark, str(tmp_path / "x.parquet"), ("es",), 5).collect()] == ["text b"]
    with pytest.raises(ValueError, match="Parquet"):
        discovery.load(spark, "x.csv")
    assert discovery.value_types(df).count() == 4


def test_contracts(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"entities": ["AGE", "SSN"], "id_to_label": {"0": "O", "1": "B-AGE", "2": "I-AGE", "3": "B-SSN", "4": "I-SSN"}, "bio_labels": ["O", "B-AGE", "I-AGE", "B-SSN", "I-SSN"], "label_to_id": {"O": 0, "B-AGE": 1, "I-AGE": 2, "B-SSN": 3, "I-SSN": 4}}))
    assert contracts.load_ontology(str(path)) == ["AGE", "SSN"] and len(contracts.contract_gaps(["AGE", "X"])["missing"]) == 24
    path.write_text(json.dumps({"entities": ["AGE", "AGE", "B-X"]}))
    with pytest.raises(ValueError, match="tags among the labels; a label twice"):
        contracts.load_ontology(str(path))
    path.write_text(json.dumps({"entities": ["AGE", "SSN"], "label_to_id": {"O": 0, "B-SSN": 1}}))
    with pytest.raises(ValueError, match="label_to_id does not follow"):
        contracts.load_ontology(str(path))
    told = {"mappings": {"first": {"mapping": {"phone number": "telephone", "note": None}}}, "normalization_aliases": {"telephone": "tel", "tel": "PHONE"}, "source_label_aliases": {"home-phone": "telephone"}, "deferred_labels": ["a pin"]}
    path.write_text(json.dumps(told))
    yaml = tmp_path / "p.yaml"
    yaml.write_text(json.dumps(told))
    p = contracts.load_policy(str(path))
    assert p == contracts.load_policy(str(yaml)) and p["deferred"] == ("A_PIN",) and p["healthcare"] == contracts.HEALTHCARE_LABELS and p["aliases"] == {"TELEPHONE": "PHONE", "TEL": "PHONE"}
    assert [contracts.resolve_label(x, p) for x in ("Phone.Number", "note", "home phone", "ssn", "colour")] == [("PHONE", True), (None, True), ("PHONE", False), ("SSN", False), (None, False)]
    assert contracts.policy({"x": "AGE"})["benign"] == contracts.BENIGN_LABELS
    with pytest.raises(ValueError, match="two values for A_B"):
        contracts.policy({"a b": "AGE", "A-B": "SSN"})


def test_spans_of_any_shape(spark):
    from spanloom.operators.conversion import parse_spans

    rows = [
        (1, '[{"begin": 1, "stop": 4, "type": "A", "value": "abc"}, [5, 6, "B"]]'), (2, '{"annotations": [{"start_idx": 0, "end_idx": 2, "pii_type": "C"}]}'), (3, '{"offset_start": 3, "offset_end": 9, "entity": "D"}'),
        (4, '{"E": [[0, 1], {"start": 2, "end": 3, "span_text": "z"}]}'), (5, "no json"), (6, "[]"), (7, None), (8, '{"items": [{"label": "F"}]}'),
    ]
    got = {(r.k, r.span_index): (r.start, r.end, r.label, r.value) for r in parse_spans(spark.createDataFrame(rows, "k bigint, raw string"), "k", "raw").collect() if r.start or r.end or r.label}
    assert got == {(1, 0): ("1", "4", "A", "abc"), (1, 1): ("5", "6", "B", None), (2, 0): ("0", "2", "C", None), (3, 0): ("3", "9", "D", None), (4, 0): ("0", "1", "E", None), (4, 1): ("2", "3", "E", "z"), (8, 0): (None, None, "F", None)}


def test_rest_of_contracts(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"split": "dev", "predictions": [[{"start": 1, "end": 2, "label": "AGE", "confidence": 0.5}], [], [{"start": 0, "end": 2, "label": "SSN"}]]}')
    assert [(r.record_idx, r.span_start, r.label) for r in contracts.read_predictions(spark, str(path)).orderBy("record_idx").collect()] == [(0, 1, "AGE"), (2, 0, "SSN")]
    got = spark.createDataFrame([("[3, 9)",), ("3-9",)], "r string").select(*contracts.parse_range("r")).collect()
    assert [tuple(r) for r in got] == [(3, 9), (None, None)]
