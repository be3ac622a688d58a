from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import audits, synthesis
from spanloom.schema import LABELS


def templates(spark):
    return spark.createDataFrame([(f"t{i:02}", f"a {{{x}}} b {{NONE_SUCH}} {{{x}}}", s) for i, (x, s) in enumerate(zip(LABELS, ["json", "kv", "syslog", "bracketed", "csv", "plain"] * 5, strict=False))], "template_family string, template string, style string")


def test_offsets_hold_and_partitions_do_not_matter(spark):
    a = synthesis.generate(spark, templates(spark), 100)
    rows = a.orderBy("record_idx").collect()
    assert len(rows) == 100
    for r in rows:
        assert len(r.entities) == 2 and "{NONE_SUCH}" in r.text
        values = {r.text[e.span_start : e.span_end] for e in r.entities}
        assert len(values) == 1 and all(values) and {e.label for e in r.entities} == {LABELS[r.record_idx % 25]}
    assert rows == synthesis.generate(spark, templates(spark), 100).repartition(7).orderBy("record_idx").collect()


def test_check_digits(spark):
    ids = spark.range(40).select(F.col("id").alias("k"))
    v = lambda label: synthesis.value_for(F.lit(label), F.col("k"), 7)
    got = ids.select(X.luhn_valid(v("CREDIT_CARD_NUMBER")), X.iban_valid(v("IBAN")), X.routing_valid(v("ROUTING_NUMBER"))).collect()
    assert all(all(r) for r in got)


def test_contrast_pairs(spark):
    f = spark.createDataFrame([("fam", "SSN", 3, "ssn {FOCUS}", "order {FOCUS} sent")], "family string, label string, pairs int, sensitive string, harmless string")
    rows = synthesis.contrast_pairs(spark, f).collect()
    assert len(rows) == 6
    for r in rows:
        import hashlib

        value = r.text[r.target.span_start : r.target.span_end]
        assert hashlib.sha256(value.encode()).hexdigest() == r.target.value_sha256
        assert (r.target.expected_label == "O") == (r.context_role == "harmless") == (not r.entities)


def test_audits(spark):
    t = spark.createDataFrame([("a", "one two three four"), ("b", "one two three five"), ("c", "x y z")], "name string, template string")
    assert [(r.name, r.other, r.trigram) for r in audits.most_similar(t, t).orderBy("name").collect()] == [("a", "b", 0.333333), ("b", "a", 0.333333)]
    s = spark.createDataFrame([("p", "k"), ("q", "k"), ("p", "l")], "partition string, skeleton string")
    assert [r.skeleton for r in audits.shared_skeletons(s).collect()] == ["k"]
    gold = spark.createDataFrame([(1, 0, 0, 6), (1, 1, 20, 22)], "record_idx bigint, gold_idx int, s int, e int")
    scores = spark.createDataFrame([(1, 0, 3, 0.8, 0.1), (1, 3, 6, 0.1, 0.6)], "record_idx bigint, ts int, te int, begin double, inside double")
    assert {r.gold_idx: r.confidence for r in audits.span_confidence(gold, scores).collect()} == {0: 0.7, 1: None}
    assert [r.status for r in audits.alignment_problems(spark.createDataFrame([("aligned",), ("failed",), ("collision",)], "status string")).collect()] == ["collision"]


def test_catalog_and_forms(spark):
    c = synthesis.catalog(spark)
    assert c.count() == len(LABELS) * 8 + 8 * 8 + 4 and c.select("template_family").distinct().count() == c.count()
    rows = {r.template_family: r for r in synthesis.generate(spark, c.drop("kind"), c.count()).collect()}
    ssn = rows["positive_ssn_json_nested"]
    e = ssn.entities[0]
    assert e.label == "SSN" and ssn.text[e.span_start - 1] == ssn.text[e.span_end] == '"' and len(ssn.entities) == 1
    assert not rows["negative_order_key_equals"].entities and "order_ref=" in rows["negative_order_key_equals"].text and "{" not in rows["negative_order_key_equals"].text.replace('{"ts"', "")
    one = spark.range(1).select(F.lit("123-45-6789").alias("v"))
    got = one.select(*[synthesis.formed("SSN", F.col("v"), m).alias(m) for m in synthesis.MORPHOLOGIES["SSN"]]).first()
    assert got.asDict() == {"dashed": "123-45-6789", "spaced": "123 45 6789", "dotted": "123.45.6789", "plain": "123456789"}
    negatives = synthesis.unlabeled(spark, 10)
    assert sorted(r.record_idx for r in negatives.collect()) == list(range(1_000_000, 1_000_010))
