"""Rules of records, told as rows of codes: provenance, excluded spans, metadata and contrast targets.

A rule that makes the rest of an item meaningless ends its checks, so such an item has one code; the other rules are told side by side. Null stands for a missing field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled
from ..schema import LABELS, LEGACY_REVIEW_STATES, REVIEW_STATES
from .spans import in_bounds, span_faults

# The category of an excluded span whose offsets may be wrong.
INVALID_SOURCE = "invalid_source_span"


def _codes(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in rules]))


def _first(rules: tuple[tuple[Column, str], ...], others: Column) -> Column:
    """The first of the ending rules that is broken, alone; else the codes of the others."""
    out = others
    for broken, name in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), F.array(F.lit(name))).otherwise(out)
    return out


def _retained(s: Column, e: Column, label: Column) -> Column:
    return F.coalesce(F.exists("entities", lambda x: (x["span_start"] == s) & (x["span_end"] == e) & (x["label"] == label)), F.lit(False))


def _earlier(items: str, at: Column, same: tuple[str, ...]) -> Column:
    """Whether an item before this one has the same fields."""
    return F.exists(F.slice(items, F.lit(1), at), lambda y: _same(y, same))


def _same(y: Column, fields: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & y[f].eqNullSafe(F.col(f"x.{f}"))
    return out


def provenance_faults(records: DataFrame) -> DataFrame:
    """(record_idx, item, codes) of every entry of meta.entity_provenance. Ending: missing_field, outside_text, unknown_label, blank_source_label; then not_retained, negative_source_index,
    duplicate (of an entry before)."""
    r = records.select("record_idx", "text", "entities", F.col("meta.entity_provenance").alias("items"), F.posexplode("meta.entity_provenance").alias("item", "x"))
    s, e, label = F.col("x.span_start"), F.col("x.span_end"), F.col("x.label")
    ending = (
        (s.isNull() | e.isNull() | label.isNull() | F.col("x.source_label").isNull(), "missing_field"), (~in_bounds(s, e, F.length("text")), "outside_text"),
        (~label.isin(*LABELS), "unknown_label"), (~filled(F.col("x.source_label")), "blank_source_label"),
    )
    others = _codes(
        (~_retained(s, e, label), "not_retained"), (F.col("x.source_span_index") < 0, "negative_source_index"),
        (_earlier("items", F.col("item"), ("span_start", "span_end", "label", "source_label", "source_span_index")), "duplicate"),
    )
    return r.select("record_idx", F.col("item").cast("bigint").alias("item"), _first(ending, others).alias("codes"))


def excluded_faults(records: DataFrame) -> DataFrame:
    """(record_idx, item, codes) of every entry of `excluded`, an array of (span_start, span_end, source_label, reason, category, mapped_label, blocks) of records(record_idx, text, entities, excluded).

    Ending: blank_source_label, blank_reason, missing_flag, offsets_missing and outside_text (both allowed to an entry of category invalid_source_span that blocks); then unknown_mapped_label,
    also_retained, duplicate (of an entry before)."""
    r = records.select("record_idx", "text", "entities", F.col("excluded").alias("items"), F.posexplode("excluded").alias("item", "x"))
    s, e = F.col("x.span_start"), F.col("x.span_end")
    trace = F.coalesce((F.col("x.category") == INVALID_SOURCE) & F.col("x.blocks"), F.lit(False))
    whole, mapped = in_bounds(s, e, F.length("text")), F.col("x.mapped_label")
    ending = (
        (~filled(F.col("x.source_label")), "blank_source_label"), (~filled(F.col("x.reason")), "blank_reason"), (F.col("x.blocks").isNull(), "missing_flag"),
        (~trace & (s.isNull() | e.isNull()), "offsets_missing"), (~trace & ~whole, "outside_text"),
    )
    known = mapped.isin(*LABELS)
    others = _codes((~known, "unknown_mapped_label"), (known & whole & _retained(s, e, mapped), "also_retained"), (_earlier("items", F.col("item"), ("span_start", "span_end", "source_label")), "duplicate"))
    return r.select("record_idx", F.col("item").cast("bigint").alias("item"), _first(ending, others).alias("codes"))


def meta_faults(records: DataFrame) -> DataFrame:
    """(record_idx, codes, warnings) of the metadata: source, review state (a legacy one is a warning), license flag, and the family, which a synthetic record must have and which has no blank."""
    status, family = F.col("meta.review_status"), F.col("meta.template_family")
    codes = _codes(
        (~filled(F.col("meta.source")), "source_missing"), (~filled(status), "review_missing"), (filled(status) & ~status.isin(*REVIEW_STATES, *LEGACY_REVIEW_STATES), "review_unknown"),
        (F.col("meta.license_reviewed").isNull(), "license_missing"), (family.isNotNull() & ~filled(family), "family_blank"), (filled(family) & family.rlike(r"[\s\p{Z}]"), "family_with_blank"),
        ((status == "synthetic_generated") & family.isNull(), "family_missing"),
    )
    warnings = _codes((status.isin(*LEGACY_REVIEW_STATES), "review_legacy"), (status.isin(*LEGACY_REVIEW_STATES) & family.isNull(), "family_missing"))
    return records.select("record_idx", codes.alias("codes"), warnings.alias("warnings"))


def target_rules(records: DataFrame, focus_labels: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(record_idx, item, target_role, code) of every contrast target, the first rule it breaks, null for none: offsets, unknown_label, hash_format, hash_differs, o_touches_span, no_equal_span,
    focus_label (not one of its category's, focus_labels), companion_is_nothing."""
    r = records.select("record_idx", "text", "entities", F.col("meta.contrast_category").alias("category"), F.posexplode("meta.contrast_targets").alias("item", "x"))
    s, e, label, digest = F.col("x.span_start"), F.col("x.span_end"), F.col("x.expected_label"), F.col("x.value_sha256")
    touches = F.coalesce(F.exists("entities", lambda y: (y["span_start"] < e) & (y["span_end"] > s)), F.lit(False))
    allowed = F.lit(None).cast("array<string>")
    for category, labels in (focus_labels or {}).items():
        allowed = F.when(F.col("category") == category, F.array(*map(F.lit, labels))).otherwise(allowed)
    rules = (
        (~in_bounds(s, e, F.length("text")), "offsets"), (label.isNull() | ~label.isin("O", *LABELS), "unknown_label"), (digest.isNull() | ~digest.rlike("^[0-9a-f]{64}$"), "hash_format"),
        (F.sha2(F.substring("text", s + 1, e - s), 256) != digest, "hash_differs"), ((label == "O") & touches, "o_touches_span"), ((label != "O") & ~_retained(s, e, label), "no_equal_span"),
        ((F.col("x.target_role") == "focus") & ~F.array_contains(allowed, label), "focus_label"), ((F.col("x.target_role") == "companion") & (label == "O"), "companion_is_nothing"),
    )
    code = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        code = F.when(F.coalesce(broken, F.lit(False)), F.lit(name)).otherwise(code)
    return r.select("record_idx", F.col("item").cast("bigint").alias("item"), F.col("x.target_role").alias("target_role"), code.alias("code"))


def validity(records: DataFrame) -> DataFrame:
    """(record_idx, text_code, span_codes, meta_codes, provenance_codes, valid): all rules of a record; valid where none is broken."""
    text = F.when(F.col("text").isNull(), "text_missing").when(~filled(F.col("text")), "text_blank").when(F.col("entities").isNull(), "entities_missing")
    count = lambda d, c: d.groupBy("record_idx").agg(F.count(F.lit(1)).alias(c))
    spans = count(span_faults(records).where("fault is not null"), "span_codes")
    provenance = count(provenance_faults(records).where("size(codes) > 0"), "provenance_codes")
    meta = meta_faults(records).select("record_idx", F.size("codes").cast("bigint").alias("meta_codes"))
    zero = F.lit(0).cast("bigint")
    out = records.select("record_idx", text.alias("text_code")).join(meta, "record_idx").join(spans, "record_idx", "left").join(provenance, "record_idx", "left")
    out = out.select("record_idx", "text_code", F.coalesce("span_codes", zero).alias("span_codes"), "meta_codes", F.coalesce("provenance_codes", zero).alias("provenance_codes"))
    return out.withColumn("valid", F.col("text_code").isNull() & (F.col("span_codes") + F.col("meta_codes") + F.col("provenance_codes") == 0))


def messages(flags: DataFrame) -> DataFrame:
    """(record_idx, valid, message) of validity: its codes in one line."""
    part = lambda c: F.when(F.col(c) > 0, F.concat(F.lit(f"{c}: "), F.col(c).cast("string")))
    return flags.select("record_idx", "valid", F.concat_ws("; ", "text_code", part("span_codes"), part("meta_codes"), part("provenance_codes")).alias("message"))


def missing(required: DataFrame, actual: DataFrame, *by: str) -> DataFrame:
    """The rows of required that actual lacks: required is covered where there is none."""
    return required.select(*by).distinct().join(actual.select(*by).distinct(), list(by), "left_anti")
