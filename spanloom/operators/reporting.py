"""Tables that reports show and gates compare: scores of segments, and all actual values by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import prf, r6, ratio
from . import matching


def segments(segment: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(segment, records, gold, precision, recall, f1, supported_macro_f1) of segment(record_idx, segment): each segment and `overall`, scored once."""
    one = matching.exact_matches(gold, pred).select("record_idx", "label", F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("g"))
    two = pred.select("record_idx", "label", F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("g"))
    three = gold.select("record_idx", "label", F.lit(0).alias("t"), F.lit(0).alias("p"), F.lit(1).alias("g"))
    sums = one.unionAll(two).unionAll(three).join(segment, "record_idx").rollup("label", "segment").agg(F.sum("t").alias("tp"), F.sum("p").alias("predicted"), F.sum("g").alias("support"))
    each = sums.where("label is not null").withColumn("segment", F.coalesce("segment", F.lit("overall")))
    f = prf(F.col("tp"), F.col("predicted"), F.col("support"))[2]
    macro = F.coalesce(F.avg(F.when(F.col("support") > 0, f)), F.lit(0.0))
    scored = each.groupBy("segment").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"), macro.alias("m"))
    p, r, f = prf(F.col("tp"), F.col("predicted"), F.col("support"))
    records = segment.rollup("segment").agg(F.count(F.lit(1)).alias("records")).withColumn("segment", F.coalesce("segment", F.lit("overall")))
    return scored.join(records, "segment").select("segment", "records", F.col("support").alias("gold"), r6(p).alias("precision"), r6(r).alias("recall"), r6(f).alias("f1"), r6(F.col("m")).alias("supported_macro_f1"))


def gate_actuals(counts: DataFrame, rates: DataFrame, errors: DataFrame, directions: DataFrame, alignment: DataFrame | None = None, labels: tuple[str, ...] = ("BUSINESS_ID", "SSN", "IP_ADDRESS"), confused: tuple[tuple[str, str], ...] = (("SSN", "ITIN"), ("CREDIT_CARD_NUMBER", "BUSINESS_ID"), ("BUSINESS_ID", "SSN"))) -> DataFrame:
    """(metric, actual): what named gates compare, from matching.label_counts, outcomes.target_rates, matching.error_rates, outcomes.directions and, where given, decoding.align_spans.

    Scores over all labels and of some, the least recall of a label with support, record and context error rates, the worst category, spans of one label taken for another, and
    spans that tokens fail (but for `failed`, which is told apart) or cut off."""
    scope = matching.overall(counts)
    told = {"micro_f1": ("micro", "f1"), "macro_f1": ("macro", "f1"), "supported_macro_f1": ("macro_supported", "f1"), "high_risk_recall": ("high_risk", "recall")}
    pick = lambda rows, values: rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("actual")) for k, v in values.items()])).alias("x")).select("x.*")
    one = lambda where, value, default=0.0: F.coalesce(F.max(F.when(where, value)), F.lit(default))
    overall = scope.agg(*[one(F.col("scope") == s, F.col(c)).alias(k) for k, (s, c) in told.items()])
    parts = [pick(overall, {k: F.col(k) for k in told})]
    p, r, f = prf(F.col("tp"), F.col("predicted"), F.col("support"))
    each: dict[str, Column] = {f"{x.lower()}_{n}": one(F.col("label") == x, r6(v)) for x in labels for n, v in (("precision", p), ("recall", r), ("f1", f))}
    each["minimum_individual_label_recall"] = F.coalesce(F.min(F.when(F.col("support") > 0, r6(r))), F.lit(0.0))
    parts.append(pick(counts.agg(*[v.alias(k) for k, v in each.items()]), {k: F.col(k) for k in each}))
    parts.append(pick(errors, {k: F.coalesce(F.col(k), F.lit(0.0)) for k in ("record_error_rate", "record_false_positive_rate")}))
    worst = rates.agg(one(F.col("category").isNull(), F.col("rate")).alias("context_target_error_rate"), one(F.col("category").isNotNull(), F.col("rate")).alias("maximum_category_error_rate"))
    parts.append(pick(worst, {k: F.col(k) for k in worst.columns}))
    between = {f"{a.lower()}_to_{b.lower()}_count": F.coalesce(F.sum(F.when((F.col("gold_label") == a) & (F.col("pred_label") == b), F.col("spans"))), F.lit(0)) for a, b in confused}
    parts.append(pick(directions.agg(*[v.alias(k) for k, v in between.items()]), {k: F.col(k) for k in between}))
    if alignment is not None:
        n = alignment.agg(F.count_if(F.col("status").isin("collision", "excessive")).alias("unexplained_alignment_failures"), F.count_if(F.col("status") == "truncated").alias("truncated_entity_spans"))
        parts.append(pick(n, {k: F.col(k) for k in n.columns}))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def alignment_report(alignment: DataFrame) -> DataFrame:
    """(status, spans, share) of decoding.align_spans, most frequent first."""
    total = alignment.agg(F.count(F.lit(1)).alias("n")).scalar()
    return alignment.groupBy("status").agg(F.count(F.lit(1)).alias("spans")).select("status", "spans", r6(ratio(F.col("spans"), total)).alias("share")).orderBy(F.desc("spans"), "status")
