"""Queries of this subpackage over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import crosssplit, cutting, groups, neardup, packing, pii, shared_spans, tokens


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.mentions(_table(spark, folder, "split_record"))


def p1_masked(spark: SparkSession, folder: str) -> DataFrame:
    return pii.mask(_table(spark, folder, "split_record"), _table(spark, folder, "label_spec"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    text = neardup.near_duplicate_pairs(_table(spark, folder, "split_record"), "record_idx", "text", neardup.TEXT)
    specs = _table(spark, folder, "family_spec").select("spec_id", groups.spaced_name(F.col("template_family")).alias("name"))
    family = neardup.near_duplicate_pairs(specs, "spec_id", "name", neardup.NAME)
    return text.select(F.lit("text").alias("field_name"), "key_a", "key_b").unionByName(family.select(F.lit("family").alias("field_name"), "key_a", "key_b"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(_table(spark, folder, "split_record"), "record_idx", "text", neardup.TEXT)


def p2_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Groups by runs of five words with their counts, 0.8 of the multisets in common."""
    return neardup.near_duplicate_groups(_table(spark, folder, "split_record"), "record_idx", "text", neardup.WORDS5)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return cutting.cut_items(_table(spark, folder, "split_record"), _table(spark, folder, "align_window"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return cutting.cut_texts(_table(spark, folder, "split_record"))


def p3_windows(spark: SparkSession, folder: str) -> DataFrame:
    return cutting.cut_windows(_table(spark, folder, "align_window"), _table(spark, folder, "split_record"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.broken_groups(_table(spark, folder, "family_spec"), _table(spark, folder, "split_record"))


def p4_assigned(spark: SparkSession, folder: str) -> DataFrame:
    return groups.assign_splits(_table(spark, folder, "family_spec"), _table(spark, folder, "split_record"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return crosssplit.overlaps(_table(spark, folder, "split_record"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return crosssplit.report(_table(spark, folder, "split_record"))


def p5_edited(spark: SparkSession, folder: str) -> DataFrame:
    return crosssplit.edited_overlaps(_table(spark, folder, "split_record"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(_table(spark, folder, "documents"))


def p6_slices(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_slices(_table(spark, folder, "documents"))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_spans(_table(spark, folder, "documents"))


def p8_share(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_share(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_masked, p2_found, p2_groups, p2_weighted, p3_found, p3_pieces, p3_windows, p4_found, p4_assigned, p5_found, p5_report, p5_edited, p6_ids, p6_slices, p7_packed, p8_found, p8_share)
}

_TRIM = "regexp_replace(lower({0}), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_HAVE = "CASE WHEN {0} IN ('', 'unknown', 'n/a', 'none', '-') OR regexp_full_match({0}, '0+') THEN NULL ELSE {0} END"


def _id(x: str) -> str:
    return _HAVE.format(_TRIM.format(x))


def _name(x: str) -> str:
    return _HAVE.format(f"regexp_replace({_id(x)}, '[_\\-.\\p{{Z}}\\s]+', '', 'g')")


_TEXT_PAIRS = """w AS (SELECT record_idx AS k, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM split_record WHERE text IS NOT NULL),
  s AS (SELECT k, unnest(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS h FROM w WHERE len(w) > 2), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
  o AS (SELECT a.k AS a, b.k AS b, count(*) AS v FROM s a JOIN s b USING (h) WHERE a.k < b.k GROUP BY 1, 2), pairs AS (SELECT a, b FROM o JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 3 * v >= x.n + y.n)"""
_FAMILY_PAIRS = f"""fw AS (SELECT spec_id AS k, regexp_replace({_TRIM.format("template_family")}, '[_\\-.\\p{{Z}}\\s]+', '_', 'g') AS f FROM family_spec WHERE template_family IS NOT NULL),
  fs AS (SELECT k, unnest(list_distinct(list_transform(generate_series(1, length(f) - 2), lambda i: substring(f, i, 3)))) AS h FROM fw WHERE length(f) > 2), fn AS (SELECT k, count(*) AS n FROM fs GROUP BY 1),
  fo AS (SELECT a.k AS a, b.k AS b, count(*) AS v FROM fs a JOIN fs b USING (h) WHERE a.k < b.k GROUP BY 1, 2), fpairs AS (SELECT a, b FROM fo JOIN fn x ON x.k = a JOIN fn y ON y.k = b WHERE 16 * v >= 6 * (x.n + y.n))"""
_SPLIT = _TRIM.format("split")
_KIND = """SELECT record_idx, '{0}' AS overlap_kind FROM r WHERE sp IN ('dev', 'test') AND {1} IN (SELECT {1} FROM r WHERE sp = 'train' AND {1} IS NOT NULL)"""

#: Of the queries that SQL can express on whole tables.
SQL: dict[str, str] = {
    "p2_found": f"WITH {_TEXT_PAIRS}, {_FAMILY_PAIRS} SELECT 'text' AS field_name, a AS key_a, b AS key_b FROM pairs UNION ALL SELECT 'family', a, b FROM fpairs",
    "p3_found": "SELECT 'record' AS item_kind, record_idx, -1 AS window_index FROM split_record WHERE length(text) > 1200 UNION ALL SELECT DISTINCT 'window', record_idx, window_index FROM align_window WHERE len(offset_mapping) > 384",
    "p4_found": f"""WITH RECURSIVE k AS (SELECT DISTINCT spec_id, key FROM (SELECT spec_id, 'f' || {_name("template_family")} AS key FROM family_spec UNION ALL SELECT spec_id, 's' || {_id("semantic_signature")} FROM family_spec
      UNION ALL SELECT spec_id, 'v' || {_id("seed_value_hash")} FROM family_spec) q WHERE key IS NOT NULL), e AS (SELECT DISTINCT a.spec_id AS a, b.spec_id AS b FROM k a JOIN k b USING (key)),
      r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a AS spec_id, min(b) AS group_id FROM r GROUP BY 1),
      x AS (SELECT group_id FROM g JOIN family_spec USING (spec_id) GROUP BY 1 HAVING count(DISTINCT nullif({_TRIM.format("intended_split")}, '')) > 1) SELECT spec_id, group_id FROM g JOIN x USING (group_id)""",
    "p5_found": f"""WITH {_TEXT_PAIRS}, r AS (SELECT record_idx, {_SPLIT} AS sp, {_id("meta.source")} || chr(0) || {_id("meta.source_record_id")} AS sid, {_name("meta.template_family")} AS fam,
      {_id("list_filter(meta.contrast_targets, lambda x: x.target_role = 'focus')[1].value_sha256")} AS vh FROM split_record), d AS (SELECT a AS p, b AS q FROM pairs UNION ALL SELECT b, a FROM pairs)
      {_KIND.format("source_id", "sid")} UNION ALL {_KIND.format("family", "fam")} UNION ALL {_KIND.format("value_hash", "vh")}
      UNION ALL SELECT DISTINCT p, 'text' FROM d JOIN r a ON a.record_idx = p JOIN r b ON b.record_idx = q WHERE a.sp IN ('dev', 'test') AND b.sp = 'train'""",
}

_P5 = SQL["p5_found"]
SQL["p5_report"] = f"""WITH found AS ({_P5}), q AS (SELECT record_idx, {_SPLIT} AS split, meta.source AS source FROM split_record), n AS (SELECT split, source, count(*) AS records FROM q WHERE split IN ('dev', 'test') GROUP BY 1, 2)
SELECT q.split, q.source, overlap_kind, records, count(DISTINCT record_idx) AS overlapping FROM found JOIN q USING (record_idx) JOIN n ON n.split = q.split AND n.source IS NOT DISTINCT FROM q.source GROUP BY 1, 2, 3, 4"""
_GROUPED = """e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), base AS (SELECT k, text FROM w JOIN split_record ON record_idx = k WHERE k IN (SELECT k FROM s)), r(k, g) AS (SELECT k, k FROM base UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.k),
  g AS (SELECT k, min(g) AS group_id FROM r GROUP BY 1), c AS (SELECT text, count(*) AS class_rows FROM base GROUP BY 1), l AS (SELECT e.a AS k, count(DISTINCT y.text) AS links FROM e JOIN base x ON x.k = e.a JOIN base y ON y.k = e.b WHERE x.text <> y.text GROUP BY 1)
SELECT k AS record_idx, group_id, class_rows, coalesce(links, 0) AS links FROM base JOIN g USING (k) JOIN c USING (text) LEFT JOIN l USING (k)"""
SQL["p2_groups"] = f"WITH RECURSIVE {_TEXT_PAIRS}, {_GROUPED}"
SQL["p2_weighted"] = f"""WITH RECURSIVE w AS (SELECT record_idx AS k, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM split_record WHERE text IS NOT NULL),
  s AS (SELECT k, h, count(*) AS c FROM (SELECT k, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) AS h FROM w WHERE len(w) > 4) q GROUP BY 1, 2), n AS (SELECT k, sum(c) AS n FROM s GROUP BY 1),
  o AS (SELECT a.k AS a, b.k AS b, sum(least(a.c, b.c)) AS v FROM s a JOIN s b USING (h) WHERE a.k < b.k GROUP BY 1, 2), pairs AS (SELECT a, b FROM o JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 10 * v >= 8 * (x.n + y.n - v)), {_GROUPED}"""
