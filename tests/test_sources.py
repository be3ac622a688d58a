from __future__ import annotations

import shutil

import pytest

from spanloom.sources import jsonl, reports
from spanloom.streaming import records as stream


def test_lenient_and_strict(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('﻿{"record_idx":1,"text":"a","entities":[{"span_start":0,"span_end":1,"label":"AGE"}]}\n\nnot json\n{"record_idx":2,"text":null}\n', encoding="utf-8")
    lines = jsonl.read_lines(spark, str(tmp_path))
    assert lines.count() == 3 and lines.where("bad").count() == 1 and jsonl.rejects(lines).count() == 1
    assert sorted(r.record_idx for r in jsonl.read_records(spark, str(tmp_path)).collect()) == [1, 2]
    with pytest.raises(Exception, match="bad line"):
        jsonl.read_records(spark, str(tmp_path), strict=True).collect()


def test_round_trip(spark, tmp_path):
    rows = [(1, 'a"\n😀', [(0, 1, "AGE")], None), (2, None, None, "dev")]
    df = spark.createDataFrame(rows, jsonl.RECORD)
    jsonl.write_records(df, str(tmp_path / "out"))
    assert sorted(map(str, jsonl.read_records(spark, str(tmp_path / "out")).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(Exception, match="exists"):
        jsonl.write_records(df, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="no rows"):
        jsonl.write_records(df.limit(0), str(tmp_path / "none"))


def test_markdown(spark):
    df = spark.createDataFrame([(i, "a|b\nc") for i in range(4)], "k int, v string")
    out = reports.markdown_table(df, ["k"], most=2)
    assert "a\\|b c" in out and "2 more" in out


def test_stream_matches_batch(spark, tmp_path):
    folder = str(tmp_path)
    shutil.copy("/root/testdata/sf0.001/split_record.parquet", folder)
    q = stream.valid_spans(stream.record_stream(spark, folder)).writeStream.format("memory").queryName("valid_spans_test").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("valid_spans_test").count() == stream.valid_spans(spark.read.parquet(folder)).count() > 0
    q = stream.first_texts(stream.record_stream(spark, folder)).writeStream.format("memory").queryName("first_texts_test").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("first_texts_test").count() == spark.read.parquet(folder).where("text is not null").select("text").distinct().count()


def test_named_reports(spark, tmp_path):
    from spanloom.plans import catalogue, named_reports

    asked = {q for _, sections in named_reports.REPORTS.values() for _, q, _, _ in sections}
    assert asked <= set(catalogue.QUERIES)
    text = named_reports.render(spark, "/root/testdata/sf0.001", "readiness")
    assert text.startswith("# Readiness for training\n") and "## Labels without a span" in text and "| label | train | dev | test | ready |" in text
    matrix = named_reports.policy_matrix(spark)
    assert matrix.count() == 625 and matrix.where("gold_label = pred_label and not safe").count() == 0
    named_reports.export(spark, "/root/testdata/sf0.001", str(tmp_path / "out"))
    grid = spark.read.option("header", True).csv(str(tmp_path / "out" / "confusion"))
    assert grid.count() == 26 and grid.columns[-2:] == ["<BOUNDARY>", "<MISSED>"]
