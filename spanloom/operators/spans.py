"""Span tables from records, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LABELS, REVIEW_STATES


def gold_spans(records: DataFrame) -> DataFrame:
    """(record_idx, gold_idx, s, e, label, split, text_length): one row a delivered span, in its order; null and empty lists give none."""
    return records.select("record_idx", "split", F.length("text").alias("text_length"), F.posexplode("entities").alias("gold_idx", "x")).select(
        "record_idx", "gold_idx", F.col("x.span_start").alias("s"), F.col("x.span_end").alias("e"), F.col("x.label").alias("label"), "split", "text_length"
    )


def predicted_spans(predictions: DataFrame) -> DataFrame:
    """(record_idx, pred_idx, s, e, label, confidence): exact duplicates once."""
    return predictions.select("record_idx", "pred_idx", F.col("span_start").alias("s"), F.col("span_end").alias("e"), "label", "confidence").distinct()


def in_bounds(s: Column, e: Column, length: Column) -> Column:
    return F.coalesce((s >= 0) & (s < e) & (e <= length), F.lit(False))


def span_faults(records: DataFrame) -> DataFrame:
    """gold_spans with `fault`: the first rule a span breaks, null for a valid one. missing_field, out_of_bounds, unknown_label, duplicate, overlap (with the
    span before, in order of start, end and label)."""
    g = gold_spans(records)
    order = Window.partitionBy("record_idx").orderBy(F.asc_nulls_last("s"), F.asc_nulls_last("e"), F.asc_nulls_last("label"), "gold_idx")
    same = Window.partitionBy("record_idx", "s", "e", "label").orderBy("gold_idx")
    g = g.withColumn("nth", F.row_number().over(same)).withColumn("last_end", F.lag("e").over(order))
    fault = (
        F.when(F.col("s").isNull() | F.col("e").isNull() | F.col("label").isNull(), "missing_field")
        .when(F.col("text_length").isNull() | ~in_bounds(F.col("s"), F.col("e"), F.col("text_length")), "out_of_bounds")
        .when(~F.col("label").isin(*LABELS), "unknown_label")
        .when(F.col("nth") > 1, "duplicate")
        .when(F.col("last_end") > F.col("s"), "overlap")
    )
    return g.select("record_idx", "gold_idx", "s", "e", "label", "split", fault.alias("fault"))


def valid_gold(records: DataFrame) -> DataFrame:
    """gold_spans within the text with a label of the ontology, duplicates kept."""
    g = gold_spans(records)
    return g.where(in_bounds(F.col("s"), F.col("e"), F.col("text_length")) & F.col("label").isin(*LABELS))


def record_faults(records: DataFrame) -> DataFrame:
    """(record_idx, faults): the sorted codes of the rules a record breaks, empty for a valid one."""
    meta = F.array_compact(
        F.array(
            F.when(F.col("text").isNull(), "text_missing").when(~F.coalesce(F.length(F.regexp_replace("text", r"[\s\p{Z}]+", "")) > 0, F.lit(False)), "text_blank"),
            F.when(F.col("entities").isNull(), "entities_missing"),
            F.when(F.col("meta.source").isNull(), "source_missing"),
            F.when(F.col("meta.review_status").isNull(), "review_missing").when(~F.col("meta.review_status").isin(*REVIEW_STATES), "review_unknown"),
            F.when(F.col("meta.template_family").rlike(r"\s"), "family_with_blank"),
        )
    )
    spans = span_faults(records).where("fault is not null").groupBy("record_idx").agg(F.collect_set("fault").alias("span_codes"))
    return records.select("record_idx", meta.alias("m")).join(spans, "record_idx", "left").select("record_idx", F.array_sort(F.concat("m", F.coalesce("span_codes", F.array().cast("array<string>")))).alias("faults"))


def adjacent_overlaps(spans: DataFrame) -> DataFrame:
    """(record_idx, overlaps): spans that begin before the end of the one before, in order of start, end, label."""
    order = Window.partitionBy("record_idx").orderBy("s", "e", "label", "gold_idx")
    return spans.withColumn("p", F.lag("e").over(order)).where("p > s").groupBy("record_idx").agg(F.count(F.lit(1)).alias("overlaps"))


def running_overlaps(spans: DataFrame) -> DataFrame:
    """(record_idx, overlaps): spans, in the order given, that begin before the greatest end so far."""
    before = Window.partitionBy("record_idx").orderBy("gold_idx").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("m", F.max("e").over(before)).where("s < m").groupBy("record_idx").agg(F.count(F.lit(1)).alias("overlaps"))


def label_distribution(spans: DataFrame, labels: DataFrame) -> DataFrame:
    """(label_ord, label, spans, share): every label of the ontology, with 0 where there is none."""
    counts = spans.groupBy("label").agg(F.count(F.lit(1)).alias("spans"))
    all_ = labels.select(F.col("label_ord").cast("bigint").alias("label_ord"), "label").join(counts, "label", "left").select("label_ord", "label", F.coalesce("spans", F.lit(0)).cast("bigint").alias("spans"))
    total = spans.agg(F.count(F.lit(1)).alias("total")).scalar()
    return all_.select("label_ord", "label", "spans", F.round(F.coalesce(F.try_divide(F.col("spans").cast("double"), total), F.lit(0.0)), 6).alias("share"))


def provenance_agreement(records: DataFrame) -> DataFrame:
    """(record_idx, same_set, same_bag): whether the spans of entity_provenance are those of entities, as a set and with repeats; null lists count as empty."""
    cast = "array<struct<span_start:int,span_end:int,label:string>>"
    a = F.coalesce(F.col("entities").cast(cast), F.array().cast(cast))
    b = F.coalesce(F.transform("meta.entity_provenance", lambda x: F.struct(x["span_start"].alias("span_start"), x["span_end"].alias("span_end"), x["label"].alias("label"))), F.array().cast(cast))
    same_set = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return records.select("record_idx", same_set.alias("same_set"), (F.array_sort(a) == F.array_sort(b)).alias("same_bag"))


def target_faults(records: DataFrame) -> DataFrame:
    """(record_idx, target_idx, target_role, in_bounds, hash_ok, label_ok): checks of the contrast targets: offsets, SHA-256 of the value, and that an
    O target touches no span while another equals one."""
    t = records.select("record_idx", "text", "entities", F.posexplode("meta.contrast_targets").alias("target_idx", "t"))
    s, e = F.col("t.span_start"), F.col("t.span_end")
    fits = in_bounds(s, e, F.length("text"))
    touches = F.exists("entities", lambda x: (x["span_start"] < e) & (x["span_end"] > s))
    equals = F.exists("entities", lambda x: (x["span_start"] == s) & (x["span_end"] == e) & (x["label"] == F.col("t.expected_label")))
    value = F.substring("text", s + 1, e - s)
    return t.select(
        "record_idx", F.col("target_idx").cast("bigint").alias("target_idx"), F.col("t.target_role").alias("target_role"), fits.alias("in_bounds"),
        F.coalesce(fits & (F.sha2(value, 256) == F.lower("t.value_sha256")), F.lit(False)).alias("hash_ok"),
        F.coalesce(F.when(F.col("t.expected_label") == "O", ~touches).otherwise(equals), F.lit(False)).alias("label_ok"),
    )
