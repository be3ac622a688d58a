"""Composite audits: dataset gates, error tags, template similarity, alignment problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import r6, ratio
from ..functions.text import jaccard, sequence_ratio, token_trigrams
from . import corpus, likeness, outcomes, spans

# The order in which tags of an error are told; subtypes of business ids that were not seen in training; formats and styles that are structured.
TAGS = ("morphology-over-context", "context-over-morphology", "ambiguous-key", "unseen-business-subtype", "structured-field-confusion")
UNSEEN = ("ORDER_ID", "CASE_ID", "TICKET_ID", "INVOICE_ID", "REFERENCE_ID", "REQUEST_ID", "WORKFLOW_ID")
STRUCTURED = ("json", "key_value")
STRUCTURED_STYLES = ("abbreviated_key", "json_flat", "json_nested", "key_colon", "key_equals", "structured_audit")


def gate(name: str, rows: DataFrame, expected: int = 0) -> DataFrame:
    """(gate, actual, expected, passed): how many rows there are against how many there should be."""
    return rows.agg(F.count(F.lit(1)).alias("actual")).select(F.lit(name).alias("gate"), "actual", F.lit(expected).cast("bigint").alias("expected"), (F.col("actual") == expected).alias("passed"))


def dataset_gates(records: DataFrame) -> DataFrame:
    """One row a gate: valid spans, provenance, targets, unique texts and ids, and nothing shared between splits."""
    faults = spans.span_faults(records).where("fault is not null")
    target = spans.target_faults(records)
    shared = corpus.pairwise_overlaps(corpus.facts(records))
    repeated = lambda c: records.where(c.isNotNull()).groupBy(F.sha2(c, 256)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    gates = [
        gate("span_faults", faults), gate("provenance_differs", spans.provenance_agreement(records).where("not same_set")), gate("target_offsets", target.where("not in_bounds")), gate("target_hashes", target.where("in_bounds and not hash_ok")),
        gate("target_labels", target.where("in_bounds and not label_ok")), gate("repeated_texts", repeated(F.col("text"))), gate("repeated_ids", repeated(F.concat(F.coalesce("meta.source", F.lit("")), F.lit("\0"), "meta.source_record_id"))),
        *[gate(f"cross_split_{k}", shared.where(F.col("kind") == k)) for k in ("text", "source_record_id", "template_family", "value_sha256")],
    ]
    out = gates[0]
    for g in gates[1:]:
        out = out.unionAll(g)
    return out


def error_tags(errors: DataFrame, records: DataFrame, target: DataFrame, morphology: dict[str, str]) -> DataFrame:
    """errors(record_idx, gs, ge, ps, pe, gold_label, pred_label) with tags, in the order of TAGS: what about the targets that overlap an error, by its gold or its predicted span, may have led to it.

    target has category and, where known, subtype (of a business id); morphology: the label that a category's values look like. Missed spans have no predicted span, spurious ones no gold span;
    an error that no target overlaps has no tags. The field ambiguous_key of meta counts where there is one."""
    t = target if "subtype" in target.columns else target.withColumn("subtype", F.lit(None).cast("string"))
    t = t.groupBy("record_idx").agg(F.collect_list(F.struct("s", "e", "expected_label", "category", "subtype")).alias("targets"))
    looks = F.create_map(*[F.lit(x) for kv in morphology.items() for x in kv]) if morphology else F.create_map().cast("map<string,string>")
    told = F.coalesce(F.col("meta.ambiguous_key"), F.lit(False)) if "ambiguous_key" in records.schema["meta"].dataType.fieldNames() else F.lit(False)
    m = records.select("record_idx", F.col("meta.text_format").alias("format"), F.col("meta.surface_style").alias("style"), told.alias("told"))
    touches = lambda x, s, e: F.coalesce((F.col(s) < x["e"]) & (F.col(e) > x["s"]), F.lit(False))
    near = F.filter("targets", lambda x: touches(x, "gs", "ge") | touches(x, "ps", "pe"))
    j = errors.join(t, "record_idx", "left").join(m, "record_idx", "left").withColumn("near", near)
    look = lambda x: F.try_element_at(looks, x["category"])
    some = lambda f: F.exists("near", lambda x: F.coalesce(f(x), F.lit(False)))
    any_ = F.size("near") > 0
    yes = (
        some(lambda x: x["expected_label"].isin("O", "BUSINESS_ID") & (F.col("pred_label") == look(x))),
        some(lambda x: (x["expected_label"] == look(x)) & (F.col("pred_label") == "BUSINESS_ID")),
        any_ & (F.col("told") | F.coalesce(F.col("style") == "abbreviated_key", F.lit(False))),
        some(lambda x: (x["expected_label"] == "BUSINESS_ID") & F.upper(x["subtype"]).isin(*UNSEEN)),
        any_ & (F.coalesce(F.col("format").isin(*STRUCTURED), F.lit(False)) | F.coalesce(F.col("style").isin(*STRUCTURED_STYLES), F.lit(False))),
    )
    tags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for t, c in zip(TAGS, yes, strict=True)]))
    return j.select(*errors.columns, tags.alias("tags"))


def overmasked(pred: DataFrame, gold: DataFrame, records: DataFrame, label: str, where: Column) -> DataFrame:
    """Predictions of a label in records of a kind that overlap no gold span."""
    p = pred.where(F.col("label") == label).join(records.where(where).select("record_idx"), "record_idx", "left_semi")
    hit = outcomes._pairs(gold, p).select("record_idx", "pred_idx")
    return p.join(hit, ["record_idx", "pred_idx"], "left_anti")


def span_confidence(gold: DataFrame, token_scores: DataFrame) -> DataFrame:
    """(record_idx, gold_idx, confidence): mean probability of a span's begin tag at its first token and its inside tag after, from token_scores(record_idx, ts, te, begin, inside); null without tokens."""
    hit = gold.select("record_idx", "gold_idx", "s", "e").join(token_scores, "record_idx").where("ts < e and s < te")
    first = F.row_number().over(Window.partitionBy("record_idx", "gold_idx").orderBy("ts", "te")) == 1
    mean = hit.withColumn("p", F.when(first, F.col("begin")).otherwise(F.col("inside"))).groupBy("record_idx", "gold_idx").agg(r6(F.avg("p")).alias("confidence"))
    return gold.select("record_idx", "gold_idx").join(mean, ["record_idx", "gold_idx"], "left")


def most_similar(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, other, trigram, ratio): for each name of left(name, template) the template of right that shares most token trigrams, first name on ties, with its sequence ratio.

    Candidates come from an equi-join on trigrams, so templates are never paired with all others; those that share none have no row. Python sees one pair a name."""
    g = lambda d: d.select("name", "template", token_trigrams(F.col("template")).alias("g"))
    a, b = g(left).toDF("name", "ta", "ga"), g(right).toDF("other", "tb", "gb")
    pairs = a.select("name", F.explode("ga").alias("x")).join(b.select("other", F.explode("gb").alias("x")), "x").where("name <> other").select("name", "other").distinct()
    scored = pairs.join(a, "name").join(b, "other").select("name", "other", "ta", "tb", r6(jaccard(F.col("ga"), F.col("gb"))).alias("trigram"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("trigram"), "other"))
    best = scored.withColumn("place", place).where("place = 1")
    return best.select("name", "other", "trigram", F.round(sequence_ratio("ta", "tb"), 6).alias("ratio"))


#: Templates that one step of the search for the greatest ratio meets.
BLOCK = 8192


def greatest_ratios(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, other, ratio): for each name of left(name, template) the greatest sequence ratio with any template of right of another name, first name on ties. By definition all pairs are in question: each task has a share of left,
    and all of right in steps of BLOCK."""
    tasks, block = 2 * left.sparkSession.sparkContext.defaultParallelism, BLOCK
    side = lambda d, other, task: d.where("name is not null").select(F.lit(other).alias("other"), "name", "template", task.alias("task"))
    rows = side(left, False, F.pmod(F.xxhash64("name", "template"), F.lit(tasks)).cast("int")).unionByName(side(right, True, F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))))
    # long templates apart, so that few steps need several words; else in no order, so that the best is soon high
    words = F.when(F.col("other"), F.ceil(F.length("template") / 64))
    rows = rows.repartitionById(tasks, "task").sortWithinPartitions("other", words, F.xxhash64("template", "name"))
    best = rows.select("other", "name", "template").mapInArrow(lambda batches: likeness.best_ratios(batches, block), "name string, other string, ratio double")
    return best.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("less"), "other")).alias("x")).select("name", F.col("x.other").alias("other"), F.round(-F.col("x.less"), 6).alias("ratio"))


def greatest_similarities(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, other, trigram, ratio_other, ratio): for every name of left the greatest share of token trigrams and, apart from it, the greatest sequence ratio over all templates of right of another name, each with the first name that has it.
    Where no trigram is shared the share is 0 and other null; two templates without trigrams share all."""
    by_grams = most_similar(left, right).select("name", "other", "trigram")
    none = F.size(token_trigrams(F.col("template"))) == 0
    least = right.where(none).groupBy("name").agg(F.lit(1)).select("name").orderBy("name").limit(2).agg(F.sort_array(F.collect_list("name")).alias("l"))
    bare = left.where(none).select("name").distinct().crossJoin(least).select("name", F.filter("l", lambda x: x != F.col("name")).alias("l")).where("size(l) > 0")
    by_grams = by_grams.unionByName(bare.select("name", F.element_at("l", 1).alias("other"), F.lit(1.0).alias("trigram")))
    by_grams = by_grams.groupBy("name").agg(F.min(F.struct((-F.col("trigram")).alias("less"), "other")).alias("x")).select("name", F.col("x.other").alias("other"), (-F.col("x.less")).alias("trigram"))
    by_order = greatest_ratios(left, right).select("name", F.col("other").alias("ratio_other"), "ratio")
    out = left.select("name").distinct().join(by_grams, "name", "left").join(by_order, "name", "left")
    return out.select("name", "other", F.coalesce("trigram", F.lit(0.0)).alias("trigram"), "ratio_other", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def shared_skeletons(templates: DataFrame) -> DataFrame:
    """(skeleton, partitions): skeletons of templates(partition, skeleton) in more than one partition."""
    return templates.groupBy("skeleton").agg(F.countDistinct("partition").alias("partitions")).where("partitions > 1")


def composition(records: DataFrame, by: Column) -> DataFrame:
    """(part, records, share) by a column."""
    total = records.agg(F.count(F.lit(1)).alias("total")).scalar()
    return records.groupBy(by.alias("part")).agg(F.count(F.lit(1)).alias("records")).select("part", "records", r6(ratio(F.col("records"), total)).alias("share"))


def alignment_problems(status: DataFrame, allowed: tuple[str, ...] = ("failed",)) -> DataFrame:
    """(status, spans): statuses that stand in the way of training."""
    return status.where(~F.col("status").isin("aligned", "boundary_adjusted", *allowed)).groupBy("status").agg(F.count(F.lit(1)).alias("spans"))
