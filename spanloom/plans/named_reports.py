"""Named reports: each a title and sections of registered queries, rendered as Markdown, and the tables that go out as CSV.

Every section is an aggregated table; more rows than its limit are told as a number. Reports are told as data, so a report of one's own is one more entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LABELS, MASK_ACTIONS
from ..sources.reports import confusion_grid, markdown_table, write_csv
from . import catalogue

#: name: (title, [(heading, query, order, rows listed at most)]).
REPORTS: dict[str, tuple[str, list[tuple[str, str, list[str], int]]]] = {
    "dataset_quality": ("Quality of the records", [
        ("Profile by split", "dataset_profile", ["split"], 10), ("Spans by fault", "span_validation_faults", ["fault"], 10), ("Records that break a rule", "record_validity", ["record_idx"], 50), ("Repeated texts", "exact_duplicate_texts", ["first_idx"], 50),
        ("Excluded spans", "span_dispositions", ["disposition"], 20), ("Labels", "label_distribution_zero_filled", ["label_ord"], 25),
    ]),
    "data_lineage": ("Lineage of the records", [("By source", "source_lineage_stats", ["source"], 50), ("Merging", "merge_statistics", ["source"], 50), ("Synthetic and external", "source_mix", ["synthetic"], 2)]),
    "split_summary": ("Splits", [("Profile by split", "dataset_profile", ["split"], 10), ("Composition by source", "corpus_composition", ["part"], 50), ("Allocation by stratum", "split_allocation_counts", ["stratum"], 100)]),
    "template_leakage": ("Leakage between splits", [("Shared facts", "pairwise_intersections", ["kind", "split_a", "split_b"], 50), ("Families in several splits", "family_leakage", ["template_family"], 50), ("Gates", "dataset_gates", ["gate"], 20)]),
    "readiness": ("Readiness for training", [("Labels by split", "label_readiness_pivot", ["label"], 25), ("Labels without a span", "missing_labels", ["split", "label"], 75), ("Diversity of templates", "template_diversity", ["split", "label"], 100)]),
    "hard_negatives": ("Hard negatives", [("Families", "hard_negative_families", ["template_family"], 100)]),
    "sequence_lengths": ("Lengths and windows", [("Characters by language", "text_length_percentiles", ["lang"], 50), ("Spans that one window would cut", "truncated_spans", ["label"], 25)]),
    "alignment": ("Alignment with tokens", [("Status of the spans", "span_token_alignment", ["status"], 10)]),
    "scores": ("Scores", [("Overall", "micro_macro_f1", ["scope"], 10), ("By label", "per_label_prf", ["label"], 25), ("By segment", "source_segments", ["segment"], 10), ("Records", "record_error_rate", ["records"], 1), ("Confidence of exact matches", "confidence_summary", ["label"], 25)]),
    "generalization": ("Generalization", [("By segment", "source_segments", ["segment"], 10), ("Hard negatives", "hard_negative_families", ["template_family"], 50), ("Context targets", "context_target_errors", ["category"], 50)]),
    "comparison": ("Two runs compared", [("Metrics", "metric_comparison", ["metric"], 100)]),
    "decision": ("Decision by gates", [("Gates", "named_gates", ["name"], 50), ("Values", "gate_actuals", ["metric"], 100)]),
    "security": ("What is masked", [("Rates by split", "full_mask_recall_rollup", ["split"], 10), ("Confusions by direction", "directional_confusion", ["gold_label", "pred_label"], 100), ("Contexts of confusions", "top3_contexts_per_confusion", ["gold_label", "pred_label", "place"], 100)]),
    "context": ("Context", [("Context targets", "context_target_errors", ["category"], 50), ("Nothing taken for a label", "o_target_errors", ["pred_label"], 25), ("Look-alikes", "ssn_context", ["support"], 1), ("Subtypes", "subtype_recall", ["source_label"], 50), ("Pairs that break a rule", "pair_group_consistency", ["contrast_group_id"], 50)]),
    "preflight": ("Before training", [("Gates", "dataset_gates", ["gate"], 20), ("Alignment", "span_token_alignment", ["status"], 10), ("Ontology", "ontology_contract", ["mask_action", "high_risk"], 20), ("Rules of targets", "target_rule_faults", ["record_idx", "item"], 20)]),
    "training": ("Training", [("Best step by label", "best_checkpoint", ["label"], 25), ("Values", "gate_actuals", ["metric"], 100)]),
}


def render(spark: SparkSession, folder: str, name: str) -> str:
    """The Markdown of a report over the tables of a folder."""
    title, sections = REPORTS[name]
    parts = [f"# {title}\n"]
    parts += [f"## {heading}\n\n{markdown_table(catalogue.QUERIES[query](spark, folder), order, most)}" for heading, query, order, most in sections]
    return "\n".join(parts) + "\n"


def policy_matrix(spark: SparkSession) -> DataFrame:
    """(gold_label, pred_label, gold_action, pred_action, safe): what masking a value as another label does, for all pairs of the fixed labels; safe where the same action is taken."""
    label = spark.createDataFrame([(x, MASK_ACTIONS.get(x, "MASK")) for x in LABELS], "label string, action string")
    return label.toDF("gold_label", "gold_action").crossJoin(label.toDF("pred_label", "pred_action")).select("gold_label", "pred_label", "gold_action", "pred_action", (F.col("gold_action") == F.col("pred_action")).alias("safe"))


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that go out as CSV: labels, scores by label, the confusion grid, tagged errors and masking outcomes."""
    q = {n: catalogue.QUERIES[n](spark, folder) for n in ("label_distribution_zero_filled", "per_label_prf", "confusion_cells", "error_tags", "security_outcomes")}
    return {
        "label_distribution": q["label_distribution_zero_filled"].select("label", F.col("spans").alias("count"), F.round(F.col("share") * 100, 2).alias("percentage")).orderBy("label_ord"),
        "per_label": q["per_label_prf"].orderBy("label"), "confusion": confusion_grid(q["confusion_cells"], list(LABELS)), "tagged_errors": q["error_tags"].orderBy("record_idx", "gs", "ps"),
        "security_outcomes": q["security_outcomes"].orderBy("record_idx", "gold_idx", "pred_idx"),
    }


def export(spark: SparkSession, folder: str, out: str) -> None:
    """All tables as CSV below a folder that must not hold them yet."""
    for name, rows in tables(spark, folder).items():
        write_csv(rows, f"{out}/{name}")
