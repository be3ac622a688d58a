"""Named thresholds, decisions and choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Operators that a gate may name.
OPERATORS = (">=", "<=", ">", "<", "==")


def gate_operator(name: Column) -> Column:
    """>= where the name, in lower case, has the word minimum or min, <= with maximum or max; with neither or both the gate must tell its operator, so that is an error."""
    words = F.split(F.lower(name), "_")
    low, high = F.array_contains(words, "minimum") | F.array_contains(words, "min"), F.array_contains(words, "maximum") | F.array_contains(words, "max")
    return F.when(low == high, F.raise_error(F.concat(F.lit("gate must tell minimum, maximum or an operator: "), name))).when(low, ">=").otherwise("<=")


def gate_metric(name: Column) -> Column:
    """The name without its suffix; a prefix stays."""
    return F.regexp_replace(name, "_(minimum|maximum|min|max)$", "")


def evaluate_gates(gates: DataFrame, metrics: DataFrame, lenient: bool = False) -> DataFrame:
    """(name, metric, operator, threshold, actual, passed) from gates(name, threshold[, metric, operator, flag]) and metrics(metric, actual[, flag]).

    metric and operator, where told, come before what the name tells. A metric of the gate's whole name comes before that of its metric. flag, a boolean on both sides, is compared instead of
    numbers, with == only. A missing metric, an unknown operator and a number that is not finite are errors; lenient: a missing or not finite metric fails its gate instead."""
    told = lambda c, kind: F.col(c).cast(kind) if c in gates.columns else F.lit(None).cast(kind)
    known = lambda c, kind: F.col(c).cast(kind) if c in metrics.columns else F.lit(None).cast(kind)
    wrong = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.col("name")))
    g = gates.select("name", F.col("threshold").cast("double").alias("threshold"), told("flag", "boolean").alias("want"), F.coalesce(told("operator", "string"), gate_operator(F.col("name"))).alias("operator"), F.coalesce(told("metric", "string"), gate_metric(F.col("name"))).alias("short"))
    m = metrics.select("metric", F.col("actual").cast("double").alias("actual"), known("flag", "boolean").alias("have"))
    j = g.join(m.toDF("name", "x", "f"), "name", "left").join(m.toDF("short", "y", "h"), "short", "left")
    whole, part = F.col("x").isNotNull() | F.col("f").isNotNull(), F.col("y").isNotNull() | F.col("h").isNotNull()
    j = j.withColumns({"metric": F.when(whole, F.col("name")).otherwise(F.col("short")), "actual": F.when(whole, F.col("x")).otherwise(F.col("y")), "have": F.when(whole, F.col("f")).otherwise(F.col("h")), "there": whole | part})
    flags = F.col("have").isNotNull() | F.col("want").isNotNull()
    a, t = F.col("actual"), F.col("threshold")
    finite = F.coalesce(~F.isnan(a) & (F.abs(a) < float("inf")), F.lit(False)) & F.coalesce(~F.isnan(t) & (F.abs(t) < float("inf")), F.lit(False))
    passed = F.when(F.col("operator") == ">=", a >= t).when(F.col("operator") == "<=", a <= t).when(F.col("operator") == ">", a > t).when(F.col("operator") == "<", a < t).otherwise(a == t)
    bad = F.lit(False) if lenient else None
    out = (
        F.when(~F.col("operator").isin(*OPERATORS), wrong("unsupported operator")).when(~F.col("there"), bad if lenient else wrong("no actual value"))
        .when(flags & (F.col("operator") != "=="), wrong("boolean gates need =="))
        .when(flags, F.coalesce(F.col("have") == F.col("want"), F.lit(False))).when(~finite, bad if lenient else wrong("values must be finite")).otherwise(passed)
    )
    return j.select("name", "metric", "operator", "threshold", "actual", out.cast("boolean").alias("passed"))


def compare_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, delta) of the metrics both have."""
    return a.select("metric", F.col("actual").alias("a")).join(b.select("metric", F.col("actual").alias("b")), "metric").withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


def best_step(steps: DataFrame, by: str, order: str, score: str, margin: float = 0.001) -> DataFrame:
    """(by, best, best_score): the step that replaced the one before it, in order, each only if better by more than the margin than the best so far."""
    per = steps.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, score))).alias("c"))
    fold = F.expr(f"aggregate(c, cast(null as struct<o:bigint,s:double>), (a, x) -> if(a is null or x.{score} > a.s + {margin}, struct(cast(x.{order} as bigint) as o, cast(x.{score} as double) as s), a))")
    return per.select(by, fold.alias("b")).select(by, F.col("b.o").alias("best"), F.col("b.s").alias("best_score"))


def choose_model(a: dict[str, float], b: dict[str, float], critical_margin: int = 5, recall_margin: float = 0.005) -> str:
    """'a' or 'b': fewer critical misses and partials by the margin, else better high-risk recall by its margin, else better micro F1, else a."""
    critical = {k: m["misses"] + m["partials"] for k, m in (("a", a), ("b", b))}
    if abs(critical["a"] - critical["b"]) >= critical_margin:
        return min(critical, key=critical.get)
    if abs(a["high_risk_recall"] - b["high_risk_recall"]) > recall_margin:
        return "a" if a["high_risk_recall"] > b["high_risk_recall"] else "b"
    return "b" if b["micro_f1"] > a["micro_f1"] else "a"
