"""What predictions mean for masking, for contexts and for confusions between labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import r6, ratio
from ..schema import HIGH_RISK, LABELS


def _pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    g = gold.select("record_idx", "gold_idx", F.col("s").alias("gs"), F.col("e").alias("ge"), F.col("label").alias("gold_label"))
    p = pred.select("record_idx", "pred_idx", F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("label").alias("pred_label"))
    return g.join(p, "record_idx").where("gs < pe and ps < ge")


def security_outcomes(gold: DataFrame, pred: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(record_idx, gold_idx, pred_idx, gold_label, pred_label, outcome). Only labels of the ontology are masked, so spans of others have no outcome (a prediction that overlaps such a gold span is no overmasking). Of the predictions that cover a
    gold span the first in order decides: exact, boundary_long (same label) or safe_wrong_class; else the first that overlaps: partial; else miss. Predictions that overlap no gold span are overmasking.

    One full outer join gives pairs and lone spans; the one aggregation behind it has their keys."""
    g = gold.select("record_idx", "gold_idx", F.col("s").alias("gs"), F.col("e").alias("ge"), F.col("label").alias("gold_label"))
    p = pred.where(F.col("label").isin(*labels)).select(F.col("record_idx").alias("r"), "pred_idx", F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("label").alias("pred_label"))
    both = g.join(p, (g["record_idx"] == p["r"]) & (F.col("gs") < F.col("pe")) & (F.col("ps") < F.col("ge")), "full")
    covers = (F.col("ps") <= F.col("gs")) & (F.col("pe") >= F.col("ge"))
    pick = F.when(F.col("pred_idx").isNotNull(), F.struct("pred_idx", "ps", "pe", "pred_label"))
    lone = F.when(F.col("gold_idx").isNull(), F.struct("pred_idx", "ps", "pe", "pred_label"))
    best = both.groupBy(F.coalesce("record_idx", "r").alias("record_idx"), "gold_idx", "gs", "ge", "gold_label", lone.alias("lone")).agg(F.min(F.when(covers, pick)).alias("c"), F.min(pick).alias("o"))
    outcome = (
        F.when(F.col("lone").isNotNull(), "overmasking").when(F.col("c").isNotNull() & (F.col("c.pred_label") != F.col("gold_label")), "safe_wrong_class")
        .when((F.col("c.ps") == F.col("gs")) & (F.col("c.pe") == F.col("ge")), "exact").when(F.col("c").isNotNull(), "boundary_long").when(F.col("o").isNotNull(), "partial").otherwise("miss")
    )
    chosen = F.coalesce("lone", "c", "o")
    best = best.where(F.col("lone").isNotNull() | F.col("gold_label").isin(*labels))
    return best.select("record_idx", "gold_idx", chosen["pred_idx"].alias("pred_idx"), "gold_label", chosen["pred_label"].alias("pred_label"), outcome.alias("outcome"))


def masking_rates(outcomes: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, gold, misses, partials, wrong_class, overmasked, full_mask_recall, any_cover_recall, high_risk_gold, high_risk_full_mask, high_risk_misses, high_risk_partials, high_risk_full_mask_recall)
    by split and, with a null split, over all; recall of nothing is 1."""
    o = outcomes.join(splits.select("record_idx", "split"), "record_idx").withColumn("risk", F.coalesce(F.col("gold_label").isin(*HIGH_RISK), F.lit(False)))
    is_ = lambda *x: F.count_if(F.col("outcome").isin(*x))
    risky = lambda *x: F.count_if(F.col("risk") & F.col("outcome").isin(*x))
    masked = ("exact", "boundary_long", "safe_wrong_class")
    gold, risk = F.count("gold_idx"), F.count_if("risk")
    return o.rollup("split").agg(
        gold.alias("gold"), is_("miss").alias("misses"), is_("partial").alias("partials"), is_("safe_wrong_class").alias("wrong_class"), is_("overmasking").alias("overmasked"),
        r6(ratio(is_(*masked), gold, 1.0)).alias("full_mask_recall"), r6(ratio(is_(*masked, "partial"), gold, 1.0)).alias("any_cover_recall"),
        risk.alias("high_risk_gold"), risky(*masked).alias("high_risk_full_mask"), risky("miss").alias("high_risk_misses"), risky("partial").alias("high_risk_partials"), r6(ratio(risky(*masked), risk, 1.0)).alias("high_risk_full_mask_recall"),
    )


def directions(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(gold_label, pred_label, spans, records): gold spans that some prediction of another label overlaps."""
    each = _pairs(gold, pred).where("gold_label <> pred_label").select("record_idx", "gold_idx", "gold_label", "pred_label").distinct()
    return each.groupBy("gold_label", "pred_label").agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("record_idx").alias("records"))


def targets(records: DataFrame) -> DataFrame:
    """(record_idx, target_idx, s, e, expected_label, role, category) of the well-formed contrast targets."""
    t = records.select("record_idx", F.coalesce("meta.contrast_category", F.lit("<UNSPECIFIED>")).alias("category"), F.posexplode("meta.contrast_targets").alias("target_idx", "t"))
    t = t.select("record_idx", "target_idx", F.col("t.span_start").alias("s"), F.col("t.span_end").alias("e"), F.col("t.expected_label").alias("expected_label"), F.col("t.target_role").alias("role"), "category")
    return t.where("s >= 0 and e > s and expected_label is not null and trim(expected_label) <> ''")


def target_outcomes(target: DataFrame, pred: DataFrame) -> DataFrame:
    """target with overlaps, exact and error: an O target wants no overlapping prediction, another exactly one, with its offsets and label."""
    p = pred.select("record_idx", F.col("s").alias("ps"), F.col("e").alias("pe"), "label")
    hit = target.join(p, "record_idx").where("s < pe and ps < e").groupBy("record_idx", "target_idx")
    hit = hit.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("ps = s and pe = e and label = expected_label")).alias("x"))
    out = target.join(hit, ["record_idx", "target_idx"], "left").withColumns({"overlaps": F.coalesce("n", F.lit(0)).cast("bigint"), "exact": F.coalesce("x", F.lit(0)).cast("bigint")})
    good = F.when(F.col("expected_label") == "O", F.col("overlaps") == 0).otherwise((F.col("overlaps") == 1) & (F.col("exact") == 1))
    return out.select(*target.columns, "overlaps", "exact", (~good).alias("error"))


def target_rates(outcomes: DataFrame) -> DataFrame:
    """(category, targets, errors, rate) by category and over all (null)."""
    n, bad = F.count(F.lit(1)), F.count_if("error")
    return outcomes.rollup("category").agg(n.alias("targets"), bad.alias("errors"), r6(ratio(bad, n)).alias("rate"))


def worst_category(rates: DataFrame) -> DataFrame:
    return rates.where("category is not null").orderBy(F.desc("rate"), "category").limit(1)


def o_target_predictions(target: DataFrame, pred: DataFrame) -> DataFrame:
    """(pred_label, o_targets, records): predictions that overlap a target which should be nothing."""
    o = target.where("expected_label = 'O'").select("record_idx", "target_idx", "s", "e")
    p = pred.select("record_idx", F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("label").alias("pred_label"))
    each = o.join(p, "record_idx").where("s < pe and ps < e").select("record_idx", "target_idx", "pred_label").distinct()
    return each.groupBy("pred_label").agg(F.count(F.lit(1)).alias("o_targets"), F.countDistinct("record_idx").alias("records"))


def label_in_context(gold: DataFrame, pred: DataFrame, label: str, other: str) -> DataFrame:
    """(support, recognized, others_as_label, nothing_as_label, label_as_other, boundary_errors), one row: how a label fares beside another that looks alike. Predictions of the label that touch
    none of its spans are told by whether they touch a span of the other; its spans by an equal prediction, one of the other label over them, one of its own with other offsets."""
    both = F.col("label").isin(label, other)
    g = gold.where(both).select("record_idx", F.struct("s", "e", "label").alias("x")).groupBy("record_idx").agg(F.collect_list("x").alias("gs"))
    p = pred.where(both).select("record_idx", F.struct("s", "e", "label").alias("x")).groupBy("record_idx").agg(F.collect_list("x").alias("ps"))
    r = g.join(p, "record_idx", "full").select(*[F.coalesce(c, F.array().cast("array<struct<s:int,e:int,label:string>>")).alias(c) for c in ("gs", "ps")])
    of = lambda c, name: F.filter(c, lambda x: x["label"] == name)
    touch = lambda x, y: (x["s"] < y["e"]) & (y["s"] < x["e"])
    equal = lambda x, y: (x["s"] == y["s"]) & (x["e"] == y["e"])
    r = r.select(of("gs", label).alias("a"), of("gs", other).alias("b"), of("ps", label).alias("p"), of("ps", other).alias("q"))
    lone = F.filter("p", lambda x: ~F.exists("a", lambda y: touch(x, y)))
    r = r.withColumn("lone", lone)
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("bigint")
    return r.agg(
        n(F.col("a")).alias("support"), n(F.filter("a", lambda x: F.exists("p", lambda y: equal(x, y)))).alias("recognized"),
        n(F.filter("lone", lambda x: F.exists("b", lambda y: touch(x, y)))).alias("others_as_label"), n(F.filter("lone", lambda x: ~F.exists("b", lambda y: touch(x, y)))).alias("nothing_as_label"),
        n(F.filter("a", lambda x: F.exists("q", lambda y: touch(x, y)))).alias("label_as_other"), n(F.filter("a", lambda x: F.exists("p", lambda y: touch(x, y) & ~equal(x, y)))).alias("boundary_errors"),
    )


def subtype_recall(records: DataFrame, pred: DataFrame) -> DataFrame:
    """(source_label, support, found, recall): provenance spans with an equal prediction, by source label; recall is null without support."""
    v = records.select("record_idx", F.explode("meta.entity_provenance").alias("v")).select("record_idx", F.col("v.span_start").alias("s"), F.col("v.span_end").alias("e"), F.col("v.label").alias("label"), F.upper("v.source_label").alias("source_label"))
    hit = pred.select("record_idx", "s", "e", "label").distinct().withColumn("hit", F.lit(1))
    out = v.join(hit, ["record_idx", "s", "e", "label"], "left").groupBy("source_label")
    return out.agg(F.count(F.lit(1)).alias("support"), F.count("hit").alias("found")).withColumn("recall", r6(ratio(F.col("found"), F.col("support"), None)))


def top_contexts(pairs: DataFrame, context: Column, records: DataFrame, k: int = 3) -> DataFrame:
    """(gold_label, pred_label, context, n, place): the k most frequent contexts of each confusion, ties by their first record."""
    told = pairs.where("gold_label <> pred_label").select("record_idx", "gold_label", "pred_label").join(records.select("record_idx", context.alias("context")), "record_idx")
    counts = told.groupBy("gold_label", "pred_label", "context").agg(F.count(F.lit(1)).alias("n"), F.min("record_idx").alias("first"))
    place = F.row_number().over(Window.partitionBy("gold_label", "pred_label").orderBy(F.desc("n"), "first", "context"))
    return counts.withColumn("place", place.cast("bigint")).where(F.col("place") <= k).select("gold_label", "pred_label", "context", "n", "place")
