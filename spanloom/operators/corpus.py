"""Whole collections of records: duplicates, lineage, splits, leakage, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_seed

SPLITS = {"train": 0.8, "dev": 0.1, "test": 0.1}


def signature(entities: Column) -> Column:
    """Hash of the sorted spans; null and empty are alike."""
    return F.xxhash64(F.to_json(F.array_sort(F.coalesce(entities, F.array().cast("array<struct<span_start:int,span_end:int,label:string>>")))))


def duplicate_texts(records: DataFrame) -> DataFrame:
    """(first_idx, copies, conflicts) of texts that stand in more than one record; conflicts differ from the first in their spans. Texts are grouped by SHA-256."""
    r = records.where("text is not null").select("record_idx", F.sha2("text", 256).alias("h"), signature(F.col("entities")).alias("sig"))
    # by text and spans first: a text that a third of all rows have costs a row a task and a row for each way in which it is annotated
    ways = r.groupBy("h", "sig").agg(F.min("record_idx").alias("i"), F.count(F.lit(1)).alias("n"))
    first = ways.groupBy("h").agg(F.min_by("sig", "i").alias("fs"), F.min("i").alias("first_idx"), F.sum("n").alias("copies"), F.collect_list(F.struct("sig", "n")).alias("w")).where("copies > 1")
    return first.select("first_idx", "copies", F.expr("aggregate(w, 0L, (a, x) -> a + if(x.sig <> fs, x.n, 0L))").alias("conflicts"))


def first_seen(records: DataFrame) -> DataFrame:
    """records without later copies of a text; records without text stay. A hot text costs a row a task before the shuffle."""
    keep = records.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("record_idx").alias("record_idx")).where("h is not null").select("record_idx")
    return records.join(keep, "record_idx", "left_semi").unionByName(records.where("text is null"))


def is_synthetic(meta: str = "meta") -> Column:
    return F.coalesce(F.col(f"{meta}.review_status").isin("synthetic_generated", "generated"), F.lit(False)) | F.col(f"{meta}.template_family").isNotNull() | F.coalesce(F.col(f"{meta}.source") == "custom_logs", F.lit(False))


def lineage(records: DataFrame) -> DataFrame:
    """Measures by source, <unattributed> where there is none."""
    spans = F.coalesce(F.size("entities"), F.lit(0))
    r = records.select(F.coalesce("meta.source", F.lit("<unattributed>")).alias("source"), "text", F.greatest(spans, F.lit(0)).cast("bigint").alias("spans"), is_synthetic().alias("synthetic"), "meta.license_reviewed")
    return r.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.sum("spans").alias("spans"), F.count_if(F.col("spans") == 0).alias("negatives"), F.count_if(F.col("text").isNull()).alias("without_text"),
        F.count_if("synthetic").alias("synthetic"), F.count_if(F.col("license_reviewed").eqNullSafe(F.lit(True))).alias("licensed"),
    )


def group_id(records: DataFrame) -> DataFrame:
    """records with group_id and stratum: synthetic records group by family, others by source and id (the text's hash without one)."""
    family, source = F.col("meta.template_family"), F.coalesce("meta.source", F.lit("<unattributed>"))
    group = F.when(is_synthetic() & family.isNotNull(), F.concat(F.lit("synthetic:"), family)).otherwise(F.concat(F.lit("external:"), source, F.lit(":"), F.coalesce("meta.source_record_id", F.sha2(F.coalesce("text", F.lit("")), 256))))
    primary = F.coalesce("meta.primary_entity", F.lit("O"))
    return records.withColumns({"group_id": group, "stratum": F.concat_ws("|", F.when(is_synthetic(), "synthetic").otherwise("external"), primary)})


def allocation(sizes: DataFrame, ratios: dict[str, float] = SPLITS) -> DataFrame:
    """sizes(stratum, groups) with a count for each split: largest remainders, ties in the order of the splits; then, where there are groups enough, every split that has a share
    and got none takes one from the largest."""
    names = list(ratios)
    n = F.col("groups")
    parts = [F.struct((n * r).alias("x"), F.lit(i).alias("i")) for i, r in enumerate(ratios.values())]
    sized = sizes.withColumn("parts", F.array(*parts)).withColumn("base", F.expr("transform(parts, p -> cast(floor(p.x + 1e-9) as bigint))"))
    sized = sized.withColumn("left", F.expr("groups - aggregate(base, 0L, (a, v) -> a + v)"))
    sized = sized.withColumn("order", F.expr("transform(array_sort(transform(parts, p -> struct(-round(p.x - floor(p.x + 1e-9), 9) as f, p.i as i))), q -> q.i)"))
    sized = sized.withColumn("counts", F.expr("transform(base, (v, i) -> v + if(array_position(order, i) <= left, 1L, 0L))"))
    positive = sum(r > 0 for r in ratios.values())
    for i, r in enumerate(ratios.values()):
        if r > 0:
            largest = "cast(array_position(counts, array_max(counts)) - 1 as int)"
            take = f"groups >= {positive} and counts[{i}] = 0 and array_max(counts) > 1"
            sized = sized.withColumn("counts", F.expr(f"if({take}, transform(counts, (v, i) -> v + if(i = {i}, 1L, 0L) - if(i = {largest}, 1L, 0L)), counts)"))
    return sized.select("stratum", "groups", *[F.col("counts")[i].alias(s) for i, s in enumerate(names)])


def assign_groups(records: DataFrame, seed: int = 42, ratios: dict[str, float] = SPLITS) -> DataFrame:
    """(group_id, stratum, split): the groups of each stratum in the order of their seeded hash, cut by `allocation`. A group is of its smallest stratum."""
    groups = group_id(records).groupBy("group_id").agg(F.min("stratum").alias("stratum"))
    counts = allocation(groups.groupBy("stratum").agg(F.count(F.lit(1)).alias("groups")), ratios)
    # the rank in a stratum, without gathering the stratum: ranks in 4,096 ranges of the hash, and how many groups the ranges before hold
    groups = groups.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}\0"), "stratum", F.lit("\0"), "group_id"), 256)).withColumn("bucket", F.substring("h", 1, 3))
    sizes = groups.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("h", "group_id"))
    ranked = groups.withColumn("within", within).join(sizes.withColumn("before", before), ["stratum", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    joined = ranked.join(counts, "stratum")
    split, upto = None, F.lit(0)
    for s in ratios:
        upto = upto + F.col(s)
        split = F.when(F.col("rank") <= upto, s) if split is None else split.when(F.col("rank") <= upto, s)
    return joined.select("group_id", "stratum", split.alias("split"))


def facts(records: DataFrame) -> DataFrame:
    """(kind, value, split) distinct: what splits should not share: text and value hashes, source ids and families."""
    focus = F.get(F.filter("meta.contrast_targets", lambda t: t["target_role"] == "focus"), 0)["value_sha256"]
    tall = F.array(
        F.struct(F.lit("text").alias("kind"), F.sha2("text", 256).alias("value")), F.struct(F.lit("source_record_id").alias("kind"), F.col("meta.source_record_id").alias("value")),
        F.struct(F.lit("template_family").alias("kind"), F.col("meta.template_family").alias("value")), F.struct(F.lit("value_sha256").alias("kind"), focus.alias("value")),
    )
    return records.where("split is not null").select("split", F.explode(tall).alias("f")).select("f.kind", "f.value", "split").where("value is not null").distinct()


def pairwise_overlaps(fact: DataFrame) -> DataFrame:
    """(kind, split_a, split_b, shared) for each pair of splits that share a value, from one aggregation by value."""
    by = fact.groupBy("kind", "value").agg(F.array_sort(F.collect_set("split")).alias("x")).where("size(x) > 1")
    pair = F.expr("flatten(transform(x, (a, i) -> transform(slice(x, i + 2, size(x)), b -> struct(a as split_a, b as split_b))))")
    return by.select("kind", F.explode(pair).alias("p")).groupBy("kind", "p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("shared"))


def readiness(spans: DataFrame, labels: DataFrame, minima: dict[str, int]) -> DataFrame:
    """(label, <split>..., ready): spans of each label by split against the minima."""
    counts = spans.groupBy("label").pivot("split", list(minima)).agg(F.count(F.lit(1)))
    out = labels.select("label").join(counts, "label", "left").select("label", *[F.coalesce(s, F.lit(0)).cast("bigint").alias(s) for s in minima])
    ok = F.lit(True)
    for s, least in minima.items():
        ok = ok & (F.col(s) >= least)
    return out.withColumn("ready", ok)


def diversity(records: DataFrame) -> DataFrame:
    """(split, label, families): distinct families of synthetic records by split and label."""
    r = records.where(is_synthetic() & F.col("meta.template_family").isNotNull() & F.col("split").isNotNull()).select("split", "meta.template_family", F.explode("entities").alias("x"))
    return r.where("x.label is not null").groupBy("split", F.col("x.label").alias("label")).agg(F.countDistinct("template_family").alias("families"))


def group_faults(items: DataFrame) -> DataFrame:
    """(contrast_group_id, items, faults): groups that are not exactly two distinct rows with one family, category, morphology and value and two roles."""
    i = items.select("record_idx", "contrast_group_id", "family", "category", "morphology", "context_role", "item_value", "value_hash").distinct().where("contrast_group_id is not null")
    one = lambda c: F.countDistinct(c) > 1
    g = i.groupBy("contrast_group_id").agg(
        F.countDistinct("record_idx").alias("items"), one("family").alias("f"), one("category").alias("c"), one("morphology").alias("m"), one("item_value").alias("v"), one("value_hash").alias("h"), F.countDistinct("context_role").alias("r")
    )
    names = {"size": F.col("items") != 2, "family": F.col("f"), "category": F.col("c"), "morphology": F.col("m"), "value": F.col("v"), "hash": F.col("h"), "roles": F.col("r") != 2}
    told = F.concat_ws(",", *[F.when(x, k) for k, x in names.items()])
    return g.select("contrast_group_id", "items", told.alias("faults")).where("faults <> ''")


def lengths(values: DataFrame, by: str, column: str) -> DataFrame:
    """(by, n, median, p90, p95, p99, most, over_128, ...) of a whole-number column."""
    q = F.percentile(column, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    over = {f"over_{x}": F.count_if(F.col(column) > x) for x in (128, 256, 384, 512)}
    out = values.groupBy(by).agg(F.count(column).alias("n"), q.alias("q"), F.max(column).cast("bigint").alias("most"), *[v.alias(k) for k, v in over.items()])
    return out.select(by, "n", *[F.round(F.col("q")[i], 6).alias(x) for i, x in enumerate(("median", "p90", "p95", "p99"))], "most", *over)


def profile(records: DataFrame) -> DataFrame:
    """(split, records, spans, negatives, families, groups, ids, styles, formats, multi_entity) by split."""
    n = F.greatest(F.coalesce(F.size("entities"), F.lit(0)), F.lit(0)).cast("bigint")
    r = records.select("split", "record_idx", n.alias("n"), *[F.col(f"meta.{c}").alias(c) for c in ("template_family", "contrast_group_id", "source_record_id", "surface_style", "text_format")])
    d = F.countDistinct
    return r.groupBy("split").agg(
        F.count(F.lit(1)).alias("records"), F.sum("n").alias("spans"), F.count_if(F.expr("n = 0")).alias("negatives"), F.count_if(F.expr("n > 1")).alias("multi_entity"), d("template_family").alias("families"), d("contrast_group_id").alias("contrast_groups"),
        d("source_record_id").alias("ids"), d("surface_style").alias("styles"), d("text_format").alias("formats"),
    )


def representatives(rows: DataFrame, key: str, features: dict[str, Column]) -> DataFrame:
    """(key): the smallest row of each feature, once: what a first-come greedy cover keeps."""
    firsts = rows.agg(*[F.min(F.when(c, F.col(key))).alias(k) for k, c in features.items()])
    return firsts.select(F.explode(F.array(*features)).alias(key)).where(F.col(key).isNotNull()).distinct()


def seeded_order(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return rows.withColumn("place_key", stable_seed(F.lit(seed), F.col(key)))


def is_kind(category: Column, disposition: Column, reason: Column, word: str, categories: tuple[str, ...]) -> Column:
    """Whether an excluded span is of a kind (deferred, health care): its category is one of the kind's, its disposition begins with the word or its reason has it."""
    low = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    return low(category).isin(*categories) | low(disposition).startswith(word) | low(reason).contains(word)


# Categories of excluded spans that are left for later, and of those that belong to health care.
DEFERRED, HEALTHCARE = ("deferred", "deferred_ml_v1"), ("healthcare", "healthcare_extension")


def is_deferred(category: Column, disposition: Column, reason: Column) -> Column:
    return is_kind(category, disposition, reason, "defer", DEFERRED)


def is_healthcare(category: Column, disposition: Column, reason: Column) -> Column:
    return is_kind(category, disposition, reason, "healthcare", HEALTHCARE)


def training_excluded(flag: Column, excluded: Column) -> Column:
    """Whether a record is kept from training: its flag, or that of any of its excluded spans (field `blocks`)."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.exists(excluded, lambda x: F.coalesce(x["blocks"], F.lit(False))), F.lit(False))


def merge(records: DataFrame, source: Column) -> tuple[DataFrame, DataFrame]:
    """(merged, stats) from records(record_idx, text, entities, excluded, training_exclusion, valid): invalid records go first, then excluded ones, then later copies of a text among what is left.

    stats by source: read, invalid, excluded, duplicates, conflicts (a copy whose spans differ from the first), merged."""
    r = records.withColumn("source", F.coalesce(source, F.lit("<unattributed>"))).withColumn("out", ~F.col("valid") | training_excluded(F.col("training_exclusion"), F.col("excluded")))
    r = r.withColumn("h", F.sha2("text", 256)).withColumn("sig", signature(F.col("entities")))
    first = r.where("not out").groupBy("h").agg(F.min(F.struct("record_idx", "sig")).alias("f"))
    j = r.join(first, "h", "left").withColumn("copy", ~F.col("out") & (F.col("record_idx") != F.col("f.record_idx")))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    stats = j.groupBy("source").agg(
        F.count(F.lit(1)).alias("read"), n(~F.col("valid")).alias("invalid"), n(F.col("valid") & F.col("out")).alias("excluded"), n(F.col("copy")).alias("duplicates"), n(F.col("copy") & (F.col("sig") != F.col("f.sig"))).alias("conflicts"),
        n(~F.col("out") & ~F.col("copy")).alias("merged"),
    )
    return j.where("not out and not copy").select(*records.columns), stats


def hard_negatives(records: DataFrame) -> DataFrame:
    """(template_family, records, formats, styles, <split>...): families of records that look like what they are not."""
    h = records.where("meta.scenario_kind = 'hard_negative' and meta.template_family is not null").select("split", *[F.col(f"meta.{c}").alias(c) for c in ("template_family", "text_format", "surface_style")])
    by = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    return h.groupBy("template_family").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("text_format").alias("formats"), F.countDistinct("surface_style").alias("styles"), *by)


def excluded_counts(excluded: DataFrame) -> DataFrame:
    """(source_label, reason, spans, blocking) of excluded spans (source_label, reason, blocks), most frequent first."""
    return excluded.groupBy("source_label", "reason").agg(F.count(F.lit(1)).alias("spans"), F.count_if("blocks").alias("blocking")).orderBy(F.desc("spans"), "source_label", "reason")
