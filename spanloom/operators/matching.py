"""Predicted against delivered spans: exact and greedy matching, scores, confusions, confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import prf, r6, ratio

SIGN = ["record_idx", "s", "e", "label"]


def numbered(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with rn, the position among equal spans of a record, so that each is used once."""
    g = gold.select(*SIGN, "gold_idx").withColumn("rn", F.row_number().over(Window.partitionBy(*SIGN).orderBy("gold_idx")))
    p = pred.select(*SIGN, "pred_idx", "confidence").withColumn("rn", F.row_number().over(Window.partitionBy(*SIGN).orderBy("pred_idx")))
    return g, p


def exact_matches(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(record_idx, gold_idx, pred_idx, s, e, label, confidence): pairs with equal offsets and label, each span used once."""
    g, p = numbered(gold, pred)
    return g.join(p, [*SIGN, "rn"]).select("record_idx", "gold_idx", "pred_idx", "s", "e", "label", "confidence")


def unmatched(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of either side without an exact match."""
    g, p = numbered(gold, pred)
    keys = [*SIGN, "rn"]
    return g.join(p.select(keys), keys, "left_anti").drop("rn"), p.join(g.select(keys), keys, "left_anti").drop("rn")


def overlap_candidates(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(record_idx, gold_idx, pred_idx, ..., iou): overlapping unmatched pairs of a record; the ratio is to the hull of both."""
    g, p = unmatched(gold, pred)
    g = g.select("record_idx", "gold_idx", F.col("s").alias("gs"), F.col("e").alias("ge"), F.col("label").alias("gold_label"))
    p = p.select("record_idx", "pred_idx", F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("label").alias("pred_label"), "confidence")
    both = g.join(p, "record_idx").where("gs < pe and ps < ge")
    iou = (F.least("ge", "pe") - F.greatest("gs", "ps")) / (F.greatest("ge", "pe") - F.least("gs", "ps"))
    return both.withColumn("iou", iou)


#: Of the array c in order, each pair unless one of its spans is taken.
TAKE = "aggregate(c, slice(c, 1, 0), (a, x) -> if(exists(a, y -> y.gold_idx = x.gold_idx or y.pred_idx = x.pred_idx), a, concat(a, array(x))))"


def greedy_pairs(candidates: DataFrame) -> DataFrame:
    """candidates taken one to one in each record: by falling ratio, then falling gold_idx, then falling pred_idx, each unless one of its spans is taken."""
    pair = F.struct("iou", "gold_idx", "pred_idx", "gs", "ge", "gold_label", "ps", "pe", "pred_label", "confidence")
    ordered = F.sort_array(F.collect_list(pair), asc=False)
    per = candidates.groupBy("record_idx").agg(ordered.alias("c"))
    return per.select("record_idx", F.explode(F.expr(TAKE)).alias("m")).select("record_idx", "m.*")


def taxonomy(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(record_idx, category, gold_idx, pred_idx, gold_label, pred_label, confidence): a row for each exact pair, each greedy pair, and each span left over.

    One full outer join tells exact pairs and what is left of either side; the rest is done within a record, whose spans are few."""
    g, p = numbered(gold, pred)
    one, two = g.withColumn("g", F.lit(True)), p.withColumn("p", F.lit(True))
    both = one.join(two, [*SIGN, "rn"], "full")
    left = F.struct("gold_idx", F.col("s").alias("gs"), F.col("e").alias("ge"), F.col("label").alias("gold_label"))
    right = F.struct("pred_idx", F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("label").alias("pred_label"), "confidence")
    each = F.struct("gold_idx", "pred_idx", "label", "confidence")
    per = both.groupBy("record_idx").agg(
        F.collect_list(F.when(F.col("g") & F.col("p"), each)).alias("exact"), F.collect_list(F.when(F.col("p").isNull(), left)).alias("missed"), F.collect_list(F.when(F.col("g").isNull(), right)).alias("more"),
    )

    def pair(x: Column, y: Column) -> Column:
        iou = (F.least(x["ge"], y["pe"]) - F.greatest(x["gs"], y["ps"])) / (F.greatest(x["ge"], y["pe"]) - F.least(x["gs"], y["ps"]))
        return F.struct(iou.alias("iou"), *[x[c].alias(c) for c in ("gold_idx",)], y["pred_idx"].alias("pred_idx"), *[x[c].alias(c) for c in ("gs", "ge", "gold_label")], *[y[c].alias(c) for c in ("ps", "pe", "pred_label", "confidence")])

    overlap = lambda x: F.filter("more", lambda y: (x["gs"] < y["pe"]) & (y["ps"] < x["ge"]))
    per = per.withColumn("c", F.sort_array(F.flatten(F.transform("missed", lambda x: F.transform(overlap(x), lambda y: pair(x, y)))), asc=False))
    per = per.withColumn("c", F.expr(TAKE))
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda category, gold_idx, pred_idx, gold_label, pred_label, confidence: F.struct(category.alias("category"), gold_idx.alias("gold_idx"), pred_idx.alias("pred_idx"), gold_label.alias("gold_label"), pred_label.alias("pred_label"), confidence.alias("confidence"))
    kind = lambda x: (
        F.when(x["gold_label"] != x["pred_label"], "wrong_class").when((x["ps"] >= x["gs"]) & (x["pe"] <= x["ge"]), "too_short")
        .when((x["gs"] >= x["ps"]) & (x["ge"] <= x["pe"]), "too_long").otherwise("shifted")
    )
    rows = F.concat(
        F.transform("exact", lambda x: row(F.lit("exact"), x["gold_idx"], x["pred_idx"], x["label"], x["label"], x["confidence"])),
        F.transform("c", lambda x: row(kind(x), x["gold_idx"], x["pred_idx"], x["gold_label"], x["pred_label"], x["confidence"])),
        F.transform(F.filter("missed", lambda x: ~F.exists("c", lambda y: y["gold_idx"] == x["gold_idx"])), lambda x: row(F.lit("false_negative"), x["gold_idx"], none("int"), x["gold_label"], none("string"), none("double"))),
        F.transform(F.filter("more", lambda x: ~F.exists("c", lambda y: y["pred_idx"] == x["pred_idx"])), lambda x: row(F.lit("false_positive"), none("int"), x["pred_idx"], none("string"), x["pred_label"], x["confidence"])),
    )
    return per.select("record_idx", F.explode(rows).alias("m")).select("record_idx", "m.*")


def confusion(tax: DataFrame) -> DataFrame:
    """(gold_label, pred_label, n), with <BOUNDARY>, <MISSED> and <SPURIOUS> for what is no label."""
    gold = F.when(F.col("category") == "false_positive", "<SPURIOUS>").otherwise(F.col("gold_label"))
    pred = F.when(F.col("category") == "false_negative", "<MISSED>").when(F.col("category").isin("too_short", "too_long", "shifted"), "<BOUNDARY>").otherwise(F.col("pred_label"))
    return tax.select(gold.alias("gold_label"), pred.alias("pred_label")).groupBy("gold_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))


def label_counts(gold: DataFrame, pred: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, high_risk, tp, predicted, support) of all labels. The three measures are one union before the shuffle."""
    one = exact_matches(gold, pred).select("label", F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("g"))
    two = pred.select("label", F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("g"))
    three = gold.select("label", F.lit(0).alias("t"), F.lit(0).alias("p"), F.lit(1).alias("g"))
    sums = one.unionAll(two).unionAll(three).groupBy("label").agg(F.sum("t").alias("tp"), F.sum("p").alias("predicted"), F.sum("g").alias("support"))
    zero = F.lit(0).cast("bigint")
    return labels.select("label", "high_risk").join(sums, "label", "left").select("label", "high_risk", *[F.coalesce(c, zero).alias(c) for c in ("tp", "predicted", "support")])


def per_label(counts: DataFrame) -> DataFrame:
    p, r, f = prf(F.col("tp"), F.col("predicted"), F.col("support"))
    return counts.select("label", "tp", "predicted", "support", r6(p).alias("precision"), r6(r).alias("recall"), r6(f).alias("f1"))


def overall(counts: DataFrame) -> DataFrame:
    """(scope, precision, recall, f1): micro over all labels, macro over all, macro over those with support, micro over the high-risk ones."""
    p, r, f = prf(F.col("tp"), F.col("predicted"), F.col("support"))

    def micro(scope: str, where: str) -> DataFrame:
        sums = counts.where(where).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "predicted", "support")])
        return sums.select(F.lit(scope).alias("scope"), r6(p).alias("precision"), r6(r).alias("recall"), r6(f).alias("f1"))

    def macro(scope: str, where: str) -> DataFrame:
        each = counts.where(where).select(p.alias("p"), r.alias("r"), f.alias("f")).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in "prf"])
        return each.select(F.lit(scope).alias("scope"), r6(F.col("p")).alias("precision"), r6(F.col("r")).alias("recall"), r6(F.col("f")).alias("f1"))

    return micro("micro", "true").unionByName(macro("macro", "true")).unionByName(macro("macro_supported", "support > 0")).unionByName(micro("high_risk", "high_risk"))


def record_errors(records: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(record_idx, differs, spurious): whether the bags of spans differ, and whether some prediction is not exact, for all given records."""
    g, p = unmatched(gold, pred)
    miss = g.groupBy("record_idx").agg(F.count(F.lit(1)).alias("m"))
    more = p.groupBy("record_idx").agg(F.count(F.lit(1)).alias("x"))
    joined = records.select("record_idx").join(miss, "record_idx", "left").join(more, "record_idx", "left")
    return joined.select("record_idx", (F.coalesce("m", F.lit(0)) + F.coalesce("x", F.lit(0)) > 0).alias("differs"), (F.coalesce("x", F.lit(0)) > 0).alias("spurious"))


def error_rates(flags: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return flags.agg(n.alias("records"), r6(ratio(F.count_if("differs"), n)).alias("record_error_rate"), r6(ratio(F.count_if("spurious"), n)).alias("record_false_positive_rate"))


def confidence_summary(matched: DataFrame) -> DataFrame:
    """(label, n, mean, median, p25, p75, least, most) of confidence, exact percentiles."""
    q = F.percentile("confidence", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    agg = matched.groupBy("label").agg(F.count("confidence").alias("n"), F.avg("confidence").alias("m"), q.alias("q"), F.min("confidence").alias("a"), F.max("confidence").alias("b"))
    return agg.select("label", "n", r6(F.col("m")).alias("mean"), r6(F.col("q")[1]).alias("median"), r6(F.col("q")[0]).alias("p25"), r6(F.col("q")[2]).alias("p75"), r6(F.col("a")).alias("least"), r6(F.col("b")).alias("most"))
