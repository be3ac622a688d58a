"""Registered queries over the tables of a folder, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as X
from ..operators import audits, conversion, corpus, decoding, gates, matching, outcomes, reporting, spans, synthesis, validation
from ..schema import HIGH_RISK, LABELS, LEGACY_REVIEW_STATES, REVIEW_STATES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Run = Callable[["Tables"], DataFrame]


class Tables:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def gold(self) -> DataFrame:
        return spans.valid_gold(self.split_record)

    @property
    def scored_gold(self) -> DataFrame:
        return self.gold.where("split in ('dev', 'test')")

    @property
    def pred(self) -> DataFrame:
        return spans.predicted_spans(self.pred_span)


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[run.__name__] = lambda spark, folder: run(Tables(spark, folder))
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_RAW = """raw AS (SELECT record_idx, split, length(text) AS n, i - 1 AS gold_idx, entities[i].span_start AS s, entities[i].span_end AS e, entities[i].label AS label
  FROM (SELECT record_idx, split, text, entities, unnest(generate_series(1, len(entities))) AS i FROM split_record WHERE len(entities) > 0) q)"""
_GOLD = f"{_RAW}, allgold AS (SELECT * FROM raw WHERE s >= 0 AND s < e AND e <= n AND label IN {_in(LABELS)}), gold AS (SELECT * FROM allgold WHERE split IN ('dev', 'test'))"
_PRED = "pred AS (SELECT DISTINCT record_idx, pred_idx, span_start AS s, span_end AS e, label, confidence FROM pred_span)"
_NUM = f"""{_GOLD}, {_PRED}, g AS (SELECT record_idx, s, e, label, gold_idx, row_number() OVER (PARTITION BY record_idx, s, e, label ORDER BY gold_idx) AS rn FROM gold),
  p AS (SELECT *, row_number() OVER (PARTITION BY record_idx, s, e, label ORDER BY pred_idx) AS rn FROM pred),
  exact AS (SELECT g.record_idx, gold_idx, pred_idx, g.s, g.e, g.label, confidence FROM g JOIN p USING (record_idx, s, e, label, rn)),
  ug AS (SELECT g.* FROM g ANTI JOIN p USING (record_idx, s, e, label, rn)), up AS (SELECT p.* FROM p ANTI JOIN g USING (record_idx, s, e, label, rn))"""
_COUNTS = f"""{_NUM}, counts AS (SELECT l.label, l.high_risk, (SELECT count(*) FROM exact x WHERE x.label = l.label) AS tp, (SELECT count(*) FROM pred x WHERE x.label = l.label) AS predicted,
  (SELECT count(*) FROM gold x WHERE x.label = l.label) AS support FROM label_spec l)"""
_SYN = "(coalesce(meta.review_status IN ('synthetic_generated', 'generated'), false) OR meta.template_family IS NOT NULL OR coalesce(meta.source = 'custom_logs', false))"


# ---- records and spans


@query(f"""WITH {_GOLD}, c AS (SELECT label, count(*) AS n FROM allgold GROUP BY 1)
SELECT CAST(label_ord AS BIGINT) AS label_ord, l.label, coalesce(n, 0) AS spans, round(coalesce(n, 0) / CAST((SELECT count(*) FROM allgold) AS DOUBLE), 6) AS share FROM label_spec l LEFT JOIN c USING (label)""")
def label_distribution_zero_filled(t: Tables) -> DataFrame:
    return spans.label_distribution(t.gold, t.label_spec)


@query(f"""WITH {_RAW}, x AS (SELECT *, row_number() OVER (PARTITION BY record_idx, s, e, label ORDER BY gold_idx) AS nth,
  lag(e) OVER (PARTITION BY record_idx ORDER BY s NULLS LAST, e NULLS LAST, label NULLS LAST, gold_idx) AS p FROM raw)
SELECT CASE WHEN s IS NULL OR e IS NULL OR label IS NULL THEN 'missing_field' WHEN n IS NULL OR s < 0 OR s >= e OR e > n THEN 'out_of_bounds'
  WHEN label NOT IN {_in(LABELS)} THEN 'unknown_label' WHEN nth > 1 THEN 'duplicate' WHEN p > s THEN 'overlap' ELSE 'valid' END AS fault, count(*) AS spans FROM x GROUP BY 1""")
def span_validation_faults(t: Tables) -> DataFrame:
    return spans.span_faults(t.split_record).groupBy(F.coalesce("fault", F.lit("valid")).alias("fault")).agg(F.count(F.lit(1)).alias("spans"))


@query(f"""SELECT CASE WHEN text IS NULL THEN 'text_missing' WHEN regexp_replace(text, '[\\s\\p{{Z}}]+', '', 'g') = '' THEN 'text_blank' ELSE '' END AS text_fault, entities IS NULL AS no_entities, meta.source IS NULL AS no_source,
  coalesce(meta.review_status NOT IN {_in(REVIEW_STATES)}, true) AS review_fault, count(*) AS records FROM split_record GROUP BY ALL""")
def record_validation_errors(t: Tables) -> DataFrame:
    f = spans.record_faults(t.split_record).join(t.split_record.select("record_idx", F.col("meta.source").isNull().alias("no_source"), F.col("entities").isNull().alias("no_entities")), "record_idx")
    has = lambda *x: F.arrays_overlap("faults", F.array(*map(F.lit, x)))
    text = F.when(has("text_missing"), "text_missing").when(has("text_blank"), "text_blank").otherwise("")
    return f.groupBy(text.alias("text_fault"), "no_entities", "no_source", has("review_missing", "review_unknown").alias("review_fault")).agg(F.count(F.lit(1)).alias("records"))


@query(f"""WITH {_GOLD}, x AS (SELECT *, lag(e) OVER (PARTITION BY record_idx ORDER BY s, e, label, gold_idx) AS p FROM allgold) SELECT record_idx, count(*) AS overlaps FROM x WHERE p > s GROUP BY 1""")
def span_overlap_lag(t: Tables) -> DataFrame:
    return spans.adjacent_overlaps(t.gold)


@query(f"""WITH {_GOLD}, x AS (SELECT *, max(e) OVER (PARTITION BY record_idx ORDER BY gold_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM allgold) SELECT record_idx, count(*) AS overlaps FROM x WHERE s < m GROUP BY 1""")
def span_overlap_running_max(t: Tables) -> DataFrame:
    return spans.running_overlaps(t.gold)


_SET = "(SELECT DISTINCT unnest({0}) x)"


@query("""WITH a AS (SELECT record_idx, list_sort(coalesce(list_transform(entities, lambda x: (x.span_start, x.span_end, x.label)::VARCHAR), [])) AS a,
  list_sort(coalesce(list_transform(meta.entity_provenance, lambda x: (x.span_start, x.span_end, x.label)::VARCHAR), [])) AS b FROM split_record)
SELECT list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS same_set, a = b AS same_bag, count(*) AS records FROM a GROUP BY 1, 2""")
def provenance_agreement(t: Tables) -> DataFrame:
    return spans.provenance_agreement(t.split_record).groupBy("same_set", "same_bag").agg(F.count(F.lit(1)).alias("records"))


@query("""WITH t AS (SELECT record_idx, text, entities, i - 1 AS target_idx, meta.contrast_targets[i] AS t FROM (SELECT *, unnest(generate_series(1, len(meta.contrast_targets))) AS i FROM split_record WHERE len(meta.contrast_targets) > 0) q),
  x AS (SELECT *, coalesce(t.span_start >= 0 AND t.span_start < t.span_end AND t.span_end <= length(text), false) AS ok FROM t)
SELECT record_idx, target_idx, t.target_role AS target_role, ok AS in_bounds, coalesce(ok AND sha256(substring(text, t.span_start + 1, t.span_end - t.span_start)) = lower(t.value_sha256), false) AS hash_ok,
  coalesce(CASE WHEN t.expected_label = 'O' THEN NOT (entities IS NULL AND NULL) AND len(list_filter(entities, lambda x: x.span_start < t.span_end AND x.span_end > t.span_start)) = 0
    ELSE len(list_filter(entities, lambda x: x.span_start = t.span_start AND x.span_end = t.span_end AND x.label = t.expected_label)) > 0 END, false) AS label_ok FROM x""")
def contrast_target_checks(t: Tables) -> DataFrame:
    return spans.target_faults(t.split_record)


# ---- collections


@query("""WITH r AS (SELECT record_idx, text, list_sort(coalesce(list_transform(entities, lambda x: (x.span_start, x.span_end, x.label)::VARCHAR), [])) AS sig FROM split_record WHERE text IS NOT NULL),
  f AS (SELECT text, min(record_idx) AS first_idx, arg_min(sig, record_idx) AS first_sig, count(*) AS copies FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT first_idx, copies, count(*) FILTER (r.sig <> f.first_sig) AS conflicts FROM r JOIN f USING (text) GROUP BY f.text, first_idx, copies""")
def exact_duplicate_texts(t: Tables) -> DataFrame:
    return corpus.duplicate_texts(t.split_record)


@query("""SELECT coalesce(meta.source, '<unattributed>') AS source, count(*) AS kept FROM split_record s WHERE text IS NULL OR record_idx IN (SELECT min(record_idx) FROM split_record WHERE text IS NOT NULL GROUP BY text) GROUP BY 1""")
def first_seen_dedup(t: Tables) -> DataFrame:
    return corpus.first_seen(t.split_record).groupBy(F.coalesce("meta.source", F.lit("<unattributed>")).alias("source")).agg(F.count(F.lit(1)).alias("kept"))


@query(f"""SELECT coalesce(meta.source, '<unattributed>') AS source, count(*) AS records, CAST(sum(coalesce(len(entities), 0)) AS BIGINT) AS spans, count(*) FILTER (coalesce(len(entities), 0) = 0) AS negatives,
  count(*) FILTER (text IS NULL) AS without_text, count(*) FILTER ({_SYN}) AS synthetic, count(*) FILTER (coalesce(meta.license_reviewed, false)) AS licensed FROM split_record GROUP BY 1""")
def source_lineage_stats(t: Tables) -> DataFrame:
    return corpus.lineage(t.split_record)


@query(f"SELECT {_SYN} AS synthetic, count(*) AS records, CAST(sum(coalesce(len(entities), 0)) AS BIGINT) AS spans FROM split_record GROUP BY 1")
def source_mix(t: Tables) -> DataFrame:
    n = F.greatest(F.coalesce(F.size("entities"), F.lit(0)), F.lit(0))
    return t.split_record.groupBy(corpus.is_synthetic().alias("synthetic")).agg(F.count(F.lit(1)).alias("records"), F.sum(n).alias("spans"))


@query(f"""WITH {_RAW}, x AS (SELECT split, upper(regexp_replace(regexp_replace(regexp_replace(label, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '[\\s\\-./]+', '_', 'g'), '^_+|_+$', '', 'g')) AS c, label, s, e, n FROM raw),
  y AS (SELECT CASE WHEN label IS NULL OR regexp_replace(label, '[\\s\\p{{Z}}]+', '', 'g') = '' THEN 'missing_label' WHEN s IS NULL OR e IS NULL THEN 'missing_offsets' WHEN n IS NULL OR s < 0 OR s >= e OR e > n THEN 'offsets_outside_text'
    WHEN c IN ('SWIFT_BIC') THEN 'deferred' WHEN c IN ('DOB', 'AGE') THEN 'healthcare' WHEN c IN ('COUNTRY') THEN 'benign' WHEN c NOT IN {_in(LABELS)} THEN 'unsupported_label' ELSE 'candidate' END AS disposition FROM x)
SELECT disposition, disposition NOT IN ('candidate', 'benign') AS blocks, count(*) AS spans FROM y GROUP BY 1, 2""")
def span_dispositions(t: Tables) -> DataFrame:
    d = conversion.dispositions(spans.gold_spans(t.split_record), {}, ("SWIFT_BIC",), ("DOB", "AGE"), ("COUNTRY",))
    return d.groupBy("disposition", "blocks").agg(F.count(F.lit(1)).alias("spans"))


_RANK = "CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LABELS)) + " END"
_RESOLVED = f"""{_GOLD}, d AS (SELECT *, row_number() OVER (PARTITION BY record_idx ORDER BY s - e, s, e, {_RANK}, label, f) AS k FROM (SELECT record_idx, s, e, label, count(*) AS members, min(gold_idx) AS f FROM allgold GROUP BY 1, 2, 3, 4) q),
  walk(record_idx, k, taken, kept, hit) AS (SELECT DISTINCT record_idx, 0::BIGINT, []::STRUCT(s INT, e INT, label VARCHAR)[], false, NULL::STRUCT(s INT, e INT, label VARCHAR) FROM d
    UNION ALL SELECT w.record_idx, d.k, CASE WHEN len(list_filter(taken, lambda y: y.s < d.e AND d.s < y.e)) = 0 THEN list_append(taken, {{'s': d.s, 'e': d.e, 'label': d.label}}) ELSE taken END,
      len(list_filter(taken, lambda y: y.s < d.e AND d.s < y.e)) = 0, list_filter(taken, lambda y: y.s < d.e AND d.s < y.e)[1] FROM walk w JOIN d ON d.record_idx = w.record_idx AND d.k = w.k + 1),
  resolved AS (SELECT d.record_idx, s, e, d.label, members, kept, hit.s AS conflict_s, hit.e AS conflict_e, hit.label AS conflict_label FROM d JOIN walk USING (record_idx, k))"""


@query(f"WITH RECURSIVE {_RESOLVED} SELECT * FROM resolved")
def overlap_resolution(t: Tables) -> DataFrame:
    return conversion.resolve_overlaps(t.gold).select("record_idx", "s", "e", "label", "members", "kept", F.col("conflict.s").alias("conflict_s"), F.col("conflict.e").alias("conflict_e"), F.col("conflict.label").alias("conflict_label"))


@query(f"""WITH {_GOLD} SELECT record_idx, s, e, label, count(*) AS members FROM allgold GROUP BY ALL""")
def collapsed_candidates(t: Tables) -> DataFrame:
    return conversion.resolve_overlaps(t.gold).select("record_idx", "s", "e", "label", "members")


@query("""WITH x AS (SELECT split_part(replace(lower(regexp_replace(lang, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), '_', '-'), '-', 1) AS l FROM documents)
SELECT nullif(CASE WHEN l IN ('*', 'all', 'any') THEN '*' WHEN l IN ('eng', 'english') THEN 'en' WHEN l IN ('spa', 'spanish') THEN 'es' WHEN l IN ('swe', 'swedish') THEN 'sv' WHEN l IN ('deu', 'ger', 'german') THEN 'de' WHEN l IN ('ita', 'italian') THEN 'it'
  WHEN l IN ('fra', 'fre', 'france', 'french') THEN 'fr' WHEN l IN ('nld', 'dut', 'dutch') THEN 'nl' ELSE l END, '') AS language, count(*) AS documents FROM x GROUP BY 1""")
def language_filter_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy(X.language(F.col("lang")).alias("language")).agg(F.count(F.lit(1)).alias("documents"))


@query("""SELECT split, count(*) AS records, CAST(sum(coalesce(len(entities), 0)) AS BIGINT) AS spans, count(*) FILTER (coalesce(len(entities), 0) = 0) AS negatives, count(*) FILTER (len(entities) > 1) AS multi_entity, count(DISTINCT meta.template_family) AS families,
  count(DISTINCT meta.contrast_group_id) AS contrast_groups, count(DISTINCT meta.source_record_id) AS ids, count(DISTINCT meta.surface_style) AS styles, count(DISTINCT meta.text_format) AS formats FROM split_record GROUP BY 1""")
def dataset_profile(t: Tables) -> DataFrame:
    return corpus.profile(t.split_record)


_GROUPS = f"""gid AS (SELECT CASE WHEN {_SYN} AND meta.template_family IS NOT NULL THEN 'synthetic:' || meta.template_family ELSE 'external:' || coalesce(meta.source, '<unattributed>') || ':' || coalesce(meta.source_record_id, sha256(coalesce(text, ''))) END AS group_id,
  CASE WHEN {_SYN} THEN 'synthetic' ELSE 'external' END || '|' || coalesce(meta.primary_entity, 'O') AS stratum FROM split_record), groups AS (SELECT group_id, min(stratum) AS stratum FROM gid GROUP BY 1)"""
_ALLOC = f"""{_GROUPS}, sz AS (SELECT stratum, count(*) AS groups FROM groups GROUP BY 1),
  b AS (SELECT *, CAST(floor(groups * 0.8 + 1e-9) AS BIGINT) AS b0, CAST(floor(groups * 0.1 + 1e-9) AS BIGINT) AS b1 FROM sz), f AS (SELECT *, round(CAST(groups * 0.8 AS DOUBLE) - b0, 9) AS f0, round(CAST(groups * 0.1 AS DOUBLE) - b1, 9) AS f1, groups - b0 - 2 * b1 AS lo FROM b),
  o AS (SELECT *, list_transform(list_sort([{{'f': -f0, 'i': 0}}, {{'f': -f1, 'i': 1}}, {{'f': -f1, 'i': 2}}]), lambda x: x.i) AS ord FROM f),
  c AS (SELECT stratum, groups, b0 + (list_position(ord, 0) <= lo)::BIGINT AS c0, b1 + (list_position(ord, 1) <= lo)::BIGINT AS c1, b1 + (list_position(ord, 2) <= lo)::BIGINT AS c2 FROM o),
  d AS (SELECT stratum, groups, c0 - (groups >= 3 AND c1 = 0 AND c0 > 1)::BIGINT AS c0, c1 + (groups >= 3 AND c1 = 0 AND c0 > 1)::BIGINT AS c1, c2 FROM c),
  alloc AS (SELECT stratum, groups, c0 - (groups >= 3 AND c2 = 0 AND c0 > 1)::BIGINT AS train, c1 AS dev, c2 + (groups >= 3 AND c2 = 0 AND c0 > 1)::BIGINT AS test FROM d)"""


@query(f"WITH {_ALLOC} SELECT * FROM alloc")
def split_allocation_counts(t: Tables) -> DataFrame:
    groups = corpus.group_id(t.split_record).groupBy("group_id").agg(F.min("stratum").alias("stratum"))
    return corpus.allocation(groups.groupBy("stratum").agg(F.count(F.lit(1)).alias("groups")))


@query(f"""WITH {_ALLOC}, r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42' || chr(0) || stratum || chr(0) || group_id), group_id) AS k FROM groups)
SELECT group_id, r.stratum, CASE WHEN k <= train THEN 'train' WHEN k <= train + dev THEN 'dev' ELSE 'test' END AS split FROM r JOIN alloc USING (stratum)""")
def group_split_assignment(t: Tables) -> DataFrame:
    return corpus.assign_groups(t.split_record)


_FACTS = """f AS (SELECT DISTINCT kind, value, split FROM (SELECT split, 'text' AS kind, sha256(text) AS value FROM split_record UNION ALL SELECT split, 'source_record_id', meta.source_record_id FROM split_record
  UNION ALL SELECT split, 'template_family', meta.template_family FROM split_record UNION ALL SELECT split, 'value_sha256', list_filter(meta.contrast_targets, lambda x: x.target_role = 'focus')[1].value_sha256 FROM split_record) q WHERE split IS NOT NULL AND value IS NOT NULL)"""


@query(f"WITH {_FACTS} SELECT a.kind, a.split AS split_a, b.split AS split_b, count(*) AS shared FROM f a JOIN f b ON a.kind = b.kind AND a.value = b.value AND a.split < b.split GROUP BY ALL")
def pairwise_intersections(t: Tables) -> DataFrame:
    return corpus.pairwise_overlaps(corpus.facts(t.split_record))


@query(f"WITH {_FACTS} SELECT value AS template_family, count(*) AS splits FROM f WHERE kind = 'template_family' GROUP BY 1 HAVING count(*) > 1")
def family_leakage(t: Tables) -> DataFrame:
    f = corpus.facts(t.split_record).where("kind = 'template_family'")
    return f.groupBy(F.col("value").alias("template_family")).agg(F.count(F.lit(1)).alias("splits")).where("splits > 1")


@query(f"WITH {_FACTS} SELECT kind, count(*) AS contaminated FROM f a WHERE split <> 'train' AND EXISTS (SELECT 1 FROM f b WHERE b.kind = a.kind AND b.value = a.value AND b.split = 'train') GROUP BY 1")
def parent_contamination(t: Tables) -> DataFrame:
    f = corpus.facts(t.split_record)
    parent = f.where("split = 'train'").select("kind", "value")
    return f.where("split <> 'train'").join(parent, ["kind", "value"], "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("contaminated"))


@query(f"""WITH {_GOLD} SELECT l.label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test,
  count(*) FILTER (split = 'train') >= 300 AND count(*) FILTER (split = 'dev') >= 40 AND count(*) FILTER (split = 'test') >= 40 AS ready FROM label_spec l LEFT JOIN allgold g USING (label) GROUP BY 1""")
def label_readiness_pivot(t: Tables) -> DataFrame:
    return corpus.readiness(t.gold, t.label_spec, {"train": 300, "dev": 40, "test": 40})


@query(f"""WITH x AS (SELECT split, meta.template_family AS f, unnest(entities).label AS label FROM split_record WHERE {_SYN} AND meta.template_family IS NOT NULL AND split IS NOT NULL AND len(entities) > 0)
SELECT split, label, count(DISTINCT f) AS families FROM x WHERE label IS NOT NULL GROUP BY 1, 2""")
def template_diversity(t: Tables) -> DataFrame:
    return corpus.diversity(t.split_record)


@query("""WITH i AS (SELECT DISTINCT record_idx, contrast_group_id, family, category, morphology, context_role, item_value, value_hash FROM group_item WHERE contrast_group_id IS NOT NULL),
  g AS (SELECT contrast_group_id, count(DISTINCT record_idx) AS items, concat_ws(',', CASE WHEN count(DISTINCT record_idx) <> 2 THEN 'size' END, CASE WHEN count(DISTINCT family) > 1 THEN 'family' END, CASE WHEN count(DISTINCT category) > 1 THEN 'category' END,
    CASE WHEN count(DISTINCT morphology) > 1 THEN 'morphology' END, CASE WHEN count(DISTINCT item_value) > 1 THEN 'value' END, CASE WHEN count(DISTINCT value_hash) > 1 THEN 'hash' END, CASE WHEN count(DISTINCT context_role) <> 2 THEN 'roles' END) AS faults FROM i GROUP BY 1)
SELECT * FROM g WHERE faults <> ''""")
def pair_group_consistency(t: Tables) -> DataFrame:
    return corpus.group_faults(t.group_item)


@query("""SELECT lang, count(length(text)) AS n, round(quantile_cont(length(text), 0.5), 6) AS median, round(quantile_cont(length(text), 0.9), 6) AS p90, round(quantile_cont(length(text), 0.95), 6) AS p95, round(quantile_cont(length(text), 0.99), 6) AS p99,
  max(length(text)) AS most, count(*) FILTER (length(text) > 128) AS over_128, count(*) FILTER (length(text) > 256) AS over_256, count(*) FILTER (length(text) > 384) AS over_384, count(*) FILTER (length(text) > 512) AS over_512 FROM documents GROUP BY 1""")
def text_length_percentiles(t: Tables) -> DataFrame:
    return corpus.lengths(t.documents.select("lang", F.length("text").alias("length")), "lang", "length")


@query("""SELECT DISTINCT r FROM (SELECT unnest([min(record_idx) FILTER (split = 'train'), min(record_idx) FILTER (len(entities) > 1), min(record_idx) FILTER (len(entities) = 0), min(record_idx) FILTER (length(text) > 1200),
  min(record_idx) FILTER (meta.text_format = 'json'), min(record_idx) FILTER (meta.scenario_kind = 'hard_negative')]) AS r FROM split_record) q WHERE r IS NOT NULL""")
def representative_sample(t: Tables) -> DataFrame:
    features = {"a": F.col("split") == "train", "b": F.size("entities") > 1, "c": F.size("entities") == 0, "d": F.length("text") > 1200, "e": F.col("meta.text_format") == "json", "f": F.col("meta.scenario_kind") == "hard_negative"}
    return corpus.representatives(t.split_record, "record_idx", features).select(F.col("record_idx").alias("r"))


# ---- scoring


@query(f"WITH {_NUM} SELECT record_idx, gold_idx, pred_idx, s, e, label, confidence FROM exact")
def exact_span_match_multiset(t: Tables) -> DataFrame:
    m = matching.exact_matches(t.scored_gold, t.pred)
    return m.withColumn("gold_idx", F.col("gold_idx").cast("bigint"))


@query(f"""WITH {_NUM} SELECT g.record_idx, g.gold_idx, p.pred_idx, g.label AS gold_label, p.label AS pred_label, round((least(g.e, p.e) - greatest(g.s, p.s)) / CAST(greatest(g.e, p.e) - least(g.s, p.s) AS DOUBLE), 6) AS iou
FROM ug g JOIN up p ON g.record_idx = p.record_idx AND g.s < p.e AND p.s < g.e""")
def iou_overlap_candidates(t: Tables) -> DataFrame:
    c = matching.overlap_candidates(t.scored_gold, t.pred)
    return c.select("record_idx", F.col("gold_idx").cast("bigint").alias("gold_idx"), "pred_idx", "gold_label", "pred_label", M.r6(F.col("iou")).alias("iou"))


_TAX = f"""{_NUM}, cand AS (SELECT *, row_number() OVER (PARTITION BY record_idx ORDER BY iou DESC, gold_idx DESC, pred_idx DESC) AS k FROM (SELECT g.record_idx, g.gold_idx, p.pred_idx, g.s AS gs, g.e AS ge, g.label AS gl, p.s AS ps, p.e AS pe, p.label AS pl, p.confidence,
    (least(g.e, p.e) - greatest(g.s, p.s)) / CAST(greatest(g.e, p.e) - least(g.s, p.s) AS DOUBLE) AS iou FROM ug g JOIN up p ON g.record_idx = p.record_idx AND g.s < p.e AND p.s < g.e) q),
  walk(record_idx, k, golds, preds, taken) AS (SELECT DISTINCT record_idx, 0::BIGINT, []::BIGINT[], []::BIGINT[], false FROM cand
    UNION ALL SELECT w.record_idx, c.k, CASE WHEN list_contains(golds, c.gold_idx) OR list_contains(preds, c.pred_idx) THEN golds ELSE list_append(golds, c.gold_idx) END,
      CASE WHEN list_contains(golds, c.gold_idx) OR list_contains(preds, c.pred_idx) THEN preds ELSE list_append(preds, c.pred_idx) END, NOT (list_contains(golds, c.gold_idx) OR list_contains(preds, c.pred_idx)) FROM walk w JOIN cand c ON c.record_idx = w.record_idx AND c.k = w.k + 1),
  pairs AS (SELECT c.* FROM cand c JOIN walk w USING (record_idx, k) WHERE w.taken),
  tax AS (SELECT record_idx, 'exact' AS category, gold_idx, pred_idx, label AS gold_label, label AS pred_label, confidence FROM exact
    UNION ALL SELECT record_idx, CASE WHEN gl <> pl THEN 'wrong_class' WHEN ps >= gs AND pe <= ge THEN 'too_short' WHEN gs >= ps AND ge <= pe THEN 'too_long' ELSE 'shifted' END, gold_idx, pred_idx, gl, pl, confidence FROM pairs
    UNION ALL SELECT record_idx, 'false_negative', gold_idx, NULL, label, NULL, NULL FROM ug ANTI JOIN pairs USING (record_idx, gold_idx) UNION ALL SELECT record_idx, 'false_positive', NULL, pred_idx, NULL, label, confidence FROM up ANTI JOIN pairs USING (record_idx, pred_idx))"""


@query(f"WITH RECURSIVE {_TAX} SELECT record_idx, category, gold_idx::INT AS gold_idx, pred_idx, gold_label, pred_label, confidence FROM tax")
def greedy_match_taxonomy(t: Tables) -> DataFrame:
    return matching.taxonomy(t.scored_gold, t.pred)


@query(f"""WITH RECURSIVE {_TAX} SELECT CASE WHEN category = 'false_positive' THEN '<SPURIOUS>' ELSE gold_label END AS gold_label, CASE WHEN category = 'false_negative' THEN '<MISSED>' WHEN category IN ('too_short', 'too_long', 'shifted') THEN '<BOUNDARY>' ELSE pred_label END AS pred_label,
  count(*) AS n FROM tax GROUP BY 1, 2""")
def confusion_cells(t: Tables) -> DataFrame:
    return matching.confusion(matching.taxonomy(t.scored_gold, t.pred))


@query(f"WITH {_NUM} SELECT 'gold' AS side, label, count(*) AS n FROM ug GROUP BY 2 UNION ALL SELECT 'pred', label, count(*) FROM up GROUP BY 2")
def unmatched_spans(t: Tables) -> DataFrame:
    g, p = matching.unmatched(t.scored_gold, t.pred)
    both = g.select(F.lit("gold").alias("side"), "label").unionByName(p.select(F.lit("pred").alias("side"), "label"))
    return both.groupBy("side", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_COUNTS} SELECT label, tp, predicted, support, round(coalesce(tp / nullif(predicted, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(support, 0)::DOUBLE, 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0), 6) AS f1 FROM counts""")
def per_label_prf(t: Tables) -> DataFrame:
    return matching.per_label(matching.label_counts(t.scored_gold, t.pred, t.label_spec))


@query(f"""WITH {_COUNTS}, v AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS r, coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f FROM counts)
SELECT 'micro' AS scope, round(sum(tp) / sum(predicted)::DOUBLE, 6) AS precision, round(sum(tp) / sum(support)::DOUBLE, 6) AS recall, round(2 * sum(tp) / sum(predicted + support)::DOUBLE, 6) AS f1 FROM v
UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM v UNION ALL SELECT 'macro_supported', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM v WHERE support > 0
UNION ALL SELECT 'high_risk', round(coalesce(sum(tp) / nullif(sum(predicted), 0)::DOUBLE, 0), 6), round(coalesce(sum(tp) / nullif(sum(support), 0)::DOUBLE, 0), 6), round(coalesce(2 * sum(tp) / nullif(sum(predicted + support), 0)::DOUBLE, 0), 6) FROM v WHERE high_risk""")
def micro_macro_f1(t: Tables) -> DataFrame:
    return matching.overall(matching.label_counts(t.scored_gold, t.pred, t.label_spec))


@query(f"""WITH {_NUM}, f AS (SELECT record_idx, record_idx IN (SELECT record_idx FROM ug) OR record_idx IN (SELECT record_idx FROM up) AS d, record_idx IN (SELECT record_idx FROM up) AS x FROM split_record WHERE split IN ('dev', 'test'))
SELECT count(*) AS records, round(count(*) FILTER (d) / count(*)::DOUBLE, 6) AS record_error_rate, round(count(*) FILTER (x) / count(*)::DOUBLE, 6) AS record_false_positive_rate FROM f""")
def record_error_rate(t: Tables) -> DataFrame:
    return matching.error_rates(matching.record_errors(t.split_record.where("split in ('dev', 'test')"), t.scored_gold, t.pred))


@query(f"""WITH {_NUM} SELECT label, count(confidence) AS n, round(avg(confidence), 6) AS mean, round(quantile_cont(confidence, 0.5), 6) AS median, round(quantile_cont(confidence, 0.25), 6) AS p25, round(quantile_cont(confidence, 0.75), 6) AS p75,
  round(min(confidence), 6) AS least, round(max(confidence), 6) AS most FROM exact GROUP BY 1""")
def confidence_summary(t: Tables) -> DataFrame:
    return matching.confidence_summary(matching.exact_matches(t.scored_gold, t.pred))


_OVER = f"""{_GOLD}, {_PRED}, o AS (SELECT g.record_idx, gold_idx, g.s AS gs, g.e AS ge, g.label AS gl, pred_idx, p.s AS ps, p.e AS pe, p.label AS pl FROM gold g JOIN pred p ON g.record_idx = p.record_idx AND g.s < p.e AND p.s < g.e)"""
_SEC = f"""{_OVER}, b AS (SELECT record_idx, gold_idx, arg_min({{'i': pred_idx, 's': ps, 'e': pe, 'l': pl}}, pred_idx) FILTER (ps <= gs AND pe >= ge) AS c, arg_min({{'i': pred_idx, 's': ps, 'e': pe, 'l': pl}}, pred_idx) AS o FROM o WHERE pl IN {_in(LABELS)} GROUP BY 1, 2),
  sec AS (SELECT g.record_idx, g.gold_idx, coalesce(c.i, o.i) AS pred_idx, g.label AS gold_label, coalesce(c.l, o.l) AS pred_label, CASE WHEN c IS NOT NULL AND c.l <> g.label THEN 'safe_wrong_class' WHEN c.s = g.s AND c.e = g.e THEN 'exact' WHEN c IS NOT NULL THEN 'boundary_long' WHEN o IS NOT NULL THEN 'partial' ELSE 'miss' END AS outcome
    FROM gold g LEFT JOIN b USING (record_idx, gold_idx)
    UNION ALL SELECT p.record_idx, NULL, p.pred_idx, NULL, p.label, 'overmasking' FROM pred p WHERE p.label IN {_in(LABELS)} AND NOT EXISTS (SELECT 1 FROM o WHERE o.record_idx = p.record_idx AND o.pred_idx = p.pred_idx))"""


@query(f"WITH {_SEC} SELECT * FROM sec")
def security_outcomes(t: Tables) -> DataFrame:
    return outcomes.security_outcomes(t.scored_gold, t.pred).withColumn("gold_idx", F.col("gold_idx").cast("bigint"))


@query(f"""WITH {_SEC} SELECT split, count(gold_idx) AS gold, count(*) FILTER (outcome = 'miss') AS misses, count(*) FILTER (outcome = 'partial') AS partials, count(*) FILTER (outcome = 'safe_wrong_class') AS wrong_class, count(*) FILTER (outcome = 'overmasking') AS overmasked,
  round(coalesce(count(*) FILTER (outcome IN ('exact', 'boundary_long', 'safe_wrong_class')) / nullif(count(gold_idx), 0)::DOUBLE, 1), 6) AS full_mask_recall,
  round(coalesce(count(*) FILTER (outcome IN ('exact', 'boundary_long', 'safe_wrong_class', 'partial')) / nullif(count(gold_idx), 0)::DOUBLE, 1), 6) AS any_cover_recall,
  count(*) FILTER (risk) AS high_risk_gold, count(*) FILTER (risk AND outcome IN ('exact', 'boundary_long', 'safe_wrong_class')) AS high_risk_full_mask, count(*) FILTER (risk AND outcome = 'miss') AS high_risk_misses, count(*) FILTER (risk AND outcome = 'partial') AS high_risk_partials,
  round(coalesce(count(*) FILTER (risk AND outcome IN ('exact', 'boundary_long', 'safe_wrong_class')) / nullif(count(*) FILTER (risk), 0)::DOUBLE, 1), 6) AS high_risk_full_mask_recall
FROM (SELECT *, coalesce(gold_label IN {_in(HIGH_RISK)}, false) AS risk FROM sec) q JOIN split_record USING (record_idx) GROUP BY ROLLUP (split)""")
def full_mask_recall_rollup(t: Tables) -> DataFrame:
    return outcomes.masking_rates(outcomes.security_outcomes(t.scored_gold, t.pred), t.split_record)


@query(f"WITH {_OVER} SELECT gl AS gold_label, pl AS pred_label, count(*) AS spans, count(DISTINCT record_idx) AS records FROM (SELECT DISTINCT record_idx, gold_idx, gl, pl FROM o WHERE gl <> pl) q GROUP BY 1, 2")
def directional_confusion(t: Tables) -> DataFrame:
    return outcomes.directions(t.scored_gold, t.pred)


_TARGETS = f"""{_PRED}, t AS (SELECT record_idx, i - 1 AS target_idx, meta.contrast_targets[i].span_start AS s, meta.contrast_targets[i].span_end AS e, meta.contrast_targets[i].expected_label AS x, coalesce(meta.contrast_category, '<UNSPECIFIED>') AS category
  FROM (SELECT *, unnest(generate_series(1, len(meta.contrast_targets))) AS i FROM split_record WHERE len(meta.contrast_targets) > 0 AND split IN ('dev', 'test')) q), tt AS (SELECT * FROM t WHERE s >= 0 AND e > s AND trim(x) <> ''),
  h AS (SELECT record_idx, target_idx, count(*) AS n, count(*) FILTER (p.s = tt.s AND p.e = tt.e AND p.label = tt.x) AS k FROM tt JOIN pred p USING (record_idx) WHERE tt.s < p.e AND p.s < tt.e GROUP BY 1, 2),
  oc AS (SELECT tt.*, NOT (CASE WHEN x = 'O' THEN coalesce(n, 0) = 0 ELSE coalesce(n, 0) = 1 AND coalesce(k, 0) = 1 END) AS error FROM tt LEFT JOIN h USING (record_idx, target_idx)),
  rates AS (SELECT category, count(*) AS targets, count(*) FILTER (error) AS errors, round(count(*) FILTER (error) / count(*)::DOUBLE, 6) AS rate FROM oc GROUP BY ROLLUP (category))"""


def _target_rates(t: Tables) -> DataFrame:
    return outcomes.target_rates(outcomes.target_outcomes(outcomes.targets(t.split_record.where("split in ('dev', 'test')")), t.pred))


@query(f"WITH {_TARGETS} SELECT * FROM rates")
def context_target_errors(t: Tables) -> DataFrame:
    return _target_rates(t)


@query(f"WITH {_TARGETS} SELECT * FROM rates WHERE category IS NOT NULL ORDER BY rate DESC, category LIMIT 1")
def worst_category(t: Tables) -> DataFrame:
    return outcomes.worst_category(_target_rates(t))


@query(f"WITH {_TARGETS} SELECT label AS pred_label, count(*) AS o_targets, count(DISTINCT record_idx) AS records FROM (SELECT DISTINCT record_idx, target_idx, label FROM tt JOIN pred p USING (record_idx) WHERE x = 'O' AND tt.s < p.e AND p.s < tt.e) q GROUP BY 1")
def o_target_errors(t: Tables) -> DataFrame:
    return outcomes.o_target_predictions(outcomes.targets(t.split_record.where("split in ('dev', 'test')")), t.pred)


@query(f"""WITH {_PRED}, v AS (SELECT record_idx, unnest(meta.entity_provenance) AS v FROM split_record WHERE split IN ('dev', 'test')), h AS (SELECT DISTINCT record_idx, s, e, label FROM pred)
SELECT upper(v.source_label) AS source_label, count(*) AS support, count(h.s) AS found, round(count(h.s) / count(*)::DOUBLE, 6) AS recall FROM v LEFT JOIN h ON v.record_idx = h.record_idx AND v.v.span_start = h.s AND v.v.span_end = h.e AND v.v.label = h.label GROUP BY 1""")
def subtype_recall(t: Tables) -> DataFrame:
    return outcomes.subtype_recall(t.split_record.where("split in ('dev', 'test')"), t.pred)


@query(f"""WITH {_OVER}, c AS (SELECT gl AS gold_label, pl AS pred_label, coalesce(meta.contrast_category, meta.source, 'unclassified') AS context, count(*) AS n, min(record_idx) AS f FROM o JOIN split_record USING (record_idx) WHERE gl <> pl GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY gold_label, pred_label ORDER BY n DESC, f, context) AS place FROM c) SELECT gold_label, pred_label, context, n, place FROM r WHERE place <= 3""")
def top3_contexts_per_confusion(t: Tables) -> DataFrame:
    pairs = outcomes._pairs(t.scored_gold, t.pred)
    return outcomes.top_contexts(pairs, F.coalesce("meta.contrast_category", "meta.source", F.lit("unclassified")), t.split_record)


@query("""SELECT meta.template_family AS template_family, count(*) AS records, count(DISTINCT meta.text_format) AS formats, count(DISTINCT meta.surface_style) AS styles, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test
FROM split_record WHERE meta.scenario_kind = 'hard_negative' AND meta.template_family IS NOT NULL GROUP BY 1""")
def hard_negative_families(t: Tables) -> DataFrame:
    return corpus.hard_negatives(t.split_record)


@query()
def converted_records(t: Tables) -> DataFrame:
    raw = t.split_record.select("record_idx", "text", F.to_json(F.transform("entities", lambda x: F.struct(x["span_start"].alias("start"), x["span_end"].alias("end"), x["label"].alias("label")))).alias("raw_spans"))
    return conversion.convert(raw, {}, ("SWIFT_BIC",), ("DOB", "AGE"), ("COUNTRY",))


@query("""WITH r AS (SELECT record_idx, coalesce(meta.source, '<unattributed>') AS source, text, regexp_replace(text, '[\\s\\p{Z}]+', '', 'g') <> '' AS ok, NOT coalesce(meta.license_reviewed, true) AS x, list_sort(coalesce(list_transform(entities, lambda x: (x.span_start, x.span_end, x.label)::VARCHAR), [])) AS sig FROM split_record),
  v AS (SELECT *, coalesce(ok, false) AS valid, NOT coalesce(ok, false) OR x AS gone FROM r), f AS (SELECT text, min(record_idx) AS first_idx, arg_min(sig, record_idx) AS fs FROM v WHERE NOT gone GROUP BY 1)
SELECT source, count(*) AS read, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (valid AND gone) AS excluded, count(*) FILTER (NOT gone AND record_idx <> first_idx) AS duplicates, count(*) FILTER (NOT gone AND record_idx <> first_idx AND sig <> fs) AS conflicts,
  count(*) FILTER (NOT gone AND record_idx = first_idx) AS merged FROM v LEFT JOIN f USING (text) GROUP BY 1""")
def merge_statistics(t: Tables) -> DataFrame:
    r = t.split_record.withColumn("valid", X.filled(F.col("text"))).withColumn("training_exclusion", ~F.coalesce("meta.license_reviewed", F.lit(True)))
    return corpus.merge(r.withColumn("excluded", F.array().cast("array<struct<blocks:boolean>>")), F.col("meta.source"))[1]


# ---- tokens and scores


_TOKENS = """lw AS (SELECT record_idx, window_index, arg_max(offset_mapping, {'a': aligned_at, 'n': len(offset_mapping)}) AS m FROM align_window GROUP BY 1, 2), tk AS (SELECT record_idx, window_index, i - 1 AS tok_idx, m[i].tok_start AS ts, m[i].tok_end AS te FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM lw WHERE len(m) > 0) q WHERE m[i].tok_end > m[i].tok_start),
  rt AS (SELECT record_idx, ts, te, row_number() OVER (PARTITION BY record_idx ORDER BY ts, te) - 1 AS tok_idx FROM (SELECT DISTINCT record_idx, ts, te FROM tk) q)"""


@query(f"""WITH {_GOLD}, {_TOKENS}, mx AS (SELECT record_idx, max(tok_idx) AS last FROM rt GROUP BY 1), lh AS (SELECT rt.*, greatest(0, ceil((tok_idx - 383) / 256.0)::BIGINT) AS low, least(floor(tok_idx / 256.0)::BIGINT, greatest(0, ceil((last + 1 - 384) / 256.0)::BIGINT)) AS high FROM rt JOIN mx USING (record_idx)),
  ow AS (SELECT record_idx, w AS window_index, tok_idx - w * 256 AS pos, ts, te FROM (SELECT *, unnest(generate_series(low, greatest(low, high))) AS w FROM lh) q), hit AS (SELECT ow.*, gold_idx FROM ow JOIN allgold g ON g.record_idx = ow.record_idx AND ts < g.e AND g.s < te),
  fi AS (SELECT *, min(pos) OVER (PARTITION BY record_idx, window_index, gold_idx) AS f FROM hit), tg AS (SELECT record_idx, window_index, pos, count(*) AS n, min(f) AS f FROM fi GROUP BY 1, 2, 3)
SELECT ow.record_idx, ow.window_index::INT AS window_index, count(*) AS tokens, count(*) FILTER (n = 1 AND f = pos) AS begins, count(*) FILTER (n > 1) AS ignored FROM ow LEFT JOIN tg USING (record_idx, window_index, pos) GROUP BY 1, 2""")
def overflow_windows(t: Tables) -> DataFrame:
    tagged = decoding.bio_tags(decoding.overflow_windows(decoding.record_tokens(t.align_window)), t.gold)
    return tagged.groupBy("record_idx", "window_index").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("tag").startswith("B-")).alias("begins"), F.count_if(F.col("tag") == "IGNORE").alias("ignored"))


@query(f"""WITH {_GOLD}, {_TOKENS}, hit AS (SELECT tk.*, gold_idx, s, e FROM tk JOIN allgold g ON g.record_idx = tk.record_idx AND ts < e AND s < te), sh AS (SELECT record_idx, window_index, tok_idx, count(*) AS k FROM hit GROUP BY 1, 2, 3),
  per AS (SELECT h.record_idx, h.window_index, gold_idx, s, e, min(ts) AS a, max(te) AS b, max(k) AS k FROM hit h JOIN sh USING (record_idx, window_index, tok_idx) GROUP BY 1, 2, 3, 4, 5),
  ch AS (SELECT p.record_idx, window_index, gold_idx, c FROM (SELECT *, unnest(generate_series(s, e - 1)) AS c FROM per) p JOIN split_record USING (record_idx) WHERE NOT regexp_full_match(substring(text, c + 1, 1), '[\\s\\x0B]')),
  un AS (SELECT DISTINCT record_idx, window_index, gold_idx FROM ch WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.record_idx = ch.record_idx AND h.window_index = ch.window_index AND h.gold_idx = ch.gold_idx AND h.ts <= c AND c < h.te)),
  st AS (SELECT p.record_idx, p.gold_idx, max(CASE WHEN u.gold_idx IS NOT NULL THEN 2 WHEN k > 1 THEN 4 WHEN abs(a - s) + abs(b - e) > 3 THEN 3 WHEN abs(a - s) + abs(b - e) > 0 THEN 5 ELSE 6 END) AS state FROM per p LEFT JOIN un u USING (record_idx, window_index, gold_idx) GROUP BY 1, 2)
SELECT CASE state WHEN 6 THEN 'aligned' WHEN 5 THEN 'boundary_adjusted' WHEN 4 THEN 'collision' WHEN 3 THEN 'excessive' WHEN 2 THEN 'truncated' ELSE 'failed' END AS status, count(*) AS spans FROM allgold LEFT JOIN st USING (record_idx, gold_idx) WHERE record_idx IN (SELECT record_idx FROM align_window) GROUP BY 1""")
def span_token_alignment(t: Tables) -> DataFrame:
    a = decoding.align_spans(t.gold, t.align_window, t.split_record)
    return a.groupBy("status").agg(F.count(F.lit(1)).alias("spans"))


@query("""WITH w AS (SELECT record_idx, window_index, arg_max(offset_mapping, {'a': aligned_at, 'n': len(offset_mapping)}) AS m FROM align_window GROUP BY 1, 2)
SELECT record_idx, count(*) AS windows, CAST(sum(len(list_filter(m, lambda x: x.tok_end > x.tok_start))) AS BIGINT) AS tokens FROM w WHERE len(list_filter(m, lambda x: x.tok_end > x.tok_start)) > 0 GROUP BY 1""")
def window_token_counts(t: Tables) -> DataFrame:
    return decoding.tokens(t.align_window).groupBy("record_idx").agg(F.countDistinct("window_index").alias("windows"), F.count(F.lit(1)).alias("tokens"))


_BIO = "CASE event_type WHEN 'click' THEN 'B-A' WHEN 'purchase' THEN 'I-A' WHEN 'signup' THEN 'B-B' WHEN 'error' THEN 'I-B' ELSE 'O' END"
_BIOSQL = f"""t AS (SELECT user_id, {_BIO} AS tag, value AS confidence, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  l AS (SELECT *, CASE WHEN tag <> 'O' THEN substring(tag, 3) END AS label FROM t), m AS (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY n) AS before FROM l),
  k AS (SELECT *, label IS NOT NULL AND NOT (tag LIKE 'I-%' AND coalesce(before = label, false)) AS new FROM m), z AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY n) AS span_no FROM k)"""


def _events(t: Tables) -> DataFrame:
    return t.events.select("user_id", "ts", "event_id", F.expr(_BIO).alias("tag"), F.col("value").alias("confidence"))


@query(f"""WITH {_BIOSQL} SELECT user_id, CAST(span_no AS BIGINT) AS span_no, label, min(n) AS first_token, max(n) AS last_token, count(*) AS tokens, round(avg(confidence), 6) AS mean_confidence, round(min(confidence), 6) AS least_confidence, bool_or(tag LIKE 'I-%' AND new) AS opened_badly
FROM z WHERE label IS NOT NULL GROUP BY 1, 2, 3""")
def bio_decode_spans(t: Tables) -> DataFrame:
    return decoding.bio_spans(_events(t), "user_id", ["ts", "event_id"])


@query(f"WITH {_BIOSQL} SELECT label, count(*) AS invalid_transitions FROM z WHERE tag LIKE 'I-%' AND new GROUP BY 1")
def invalid_bio_transitions(t: Tables) -> DataFrame:
    return decoding.bio_spans(_events(t), "user_id", ["ts", "event_id"]).where("opened_badly").groupBy("label").agg(F.count(F.lit(1)).alias("invalid_transitions"))


@query("""WITH e AS (SELECT label, i AS k, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) q), m AS (SELECT label, k, avg(v) AS v, count(*) AS n FROM e GROUP BY 1, 2)
SELECT label, max(n) AS n, round(sum(v), 4) AS total, round(max(v), 4) AS most FROM m GROUP BY 1""")
def window_logit_average(t: Tables) -> DataFrame:
    a = decoding.average_vectors(t.embeddings, ["label"], "embedding")
    return a.select("label", "n", F.round(F.aggregate("embedding", F.lit(0.0), lambda x, y: x + y), 4).alias("total"), F.round(F.array_max("embedding"), 4).alias("most"))


@query("""SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best, round(1 / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE)))), 6) AS confidence FROM embeddings""")
def softmax_argmax(t: Tables) -> DataFrame:
    return decoding.classify(t.embeddings, "vec_id", "embedding")


# ---- templates, checks, gates


@query()
def template_skeletons(t: Tables) -> DataFrame:
    s = t.split_record.where("text is not null").select("record_idx", F.sha2(X.skeleton(X.blank_spans(F.col("text"), F.col("entities"))), 256).alias("skeleton"))
    return s.groupBy("skeleton").agg(F.count(F.lit(1)).alias("records"), F.min("record_idx").alias("first_idx")).where("records > 1")


@query("""WITH f AS (SELECT spec_id, regexp_extract_all(lower(template_family), '[a-z0-9]+') AS t FROM family_spec), g AS (SELECT spec_id, CASE WHEN len(t) > 2 THEN list_distinct(list_transform(generate_series(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) ELSE [] END AS g FROM f),
  e AS (SELECT spec_id, len(g) AS n, unnest(g) AS x FROM g), s AS (SELECT a.spec_id AS left_id, b.spec_id AS right_id, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.spec_id < b.spec_id GROUP BY 1, 2)
SELECT left_id, right_id, round(k / (na + nb - k)::DOUBLE, 6) AS jaccard FROM s""")
def family_trigram_jaccard(t: Tables) -> DataFrame:
    g = t.family_spec.select("spec_id", X.token_trigrams(F.regexp_replace("template_family", "_", " ")).alias("g")).select("spec_id", F.size("g").alias("n"), F.explode("g").alias("x"))
    left, right = g.toDF("left_id", "na", "x"), g.toDF("right_id", "nb", "x")
    s = left.join(right, "x").where("left_id < right_id").groupBy("left_id", "right_id", "na", "nb").agg(F.count(F.lit(1)).alias("k"))
    return s.select("left_id", "right_id", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("jaccard"))


@query("""SELECT category, count(*) AS items, count(*) FILTER (sha256(item_value) = lower(value_hash)) AS hashes_hold FROM group_item GROUP BY 1""")
def value_hash_checks(t: Tables) -> DataFrame:
    return t.group_item.groupBy("category").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.sha2("item_value", 256) == F.lower("value_hash")).alias("hashes_hold"))


@query("""WITH d AS (SELECT o_orderkey, list_reverse(list_transform(regexp_extract_all(o_orderkey::VARCHAR, '[0-9]'), lambda x: x::INT)) AS d FROM orders), s AS (SELECT o_orderkey, list_sum(list_transform(d, lambda v, i: CASE WHEN i % 2 = 1 THEN v WHEN v * 2 > 9 THEN v * 2 - 9 ELSE v * 2 END)) AS s FROM d)
SELECT s % 10 = 0 AS valid, count(*) AS orders FROM s GROUP BY 1""")
def luhn_valid_numbers(t: Tables) -> DataFrame:
    return t.orders.groupBy(X.luhn_valid(F.col("o_orderkey").cast("string")).alias("valid")).agg(F.count(F.lit(1)).alias("orders"))


@query("""WITH d AS (SELECT lpad((o_orderkey * 7919)::VARCHAR, 9, '0') AS x FROM orders) SELECT length(x) = 9 AND (3 * (x[1]::INT + x[4]::INT + x[7]::INT) + 7 * (x[2]::INT + x[5]::INT + x[8]::INT) + x[3]::INT + x[6]::INT + x[9]::INT) % 10 = 0 AS valid, count(*) AS numbers FROM d GROUP BY 1""")
def routing_checksum(t: Tables) -> DataFrame:
    x = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 9, "0")
    return t.orders.groupBy(X.routing_valid(x).alias("valid")).agg(F.count(F.lit(1)).alias("numbers"))


@query("""SELECT (o_orderkey * 1000003) % 97 AS remainder, count(*) AS numbers FROM orders GROUP BY 1""")
def mod97_remainders(t: Tables) -> DataFrame:
    return t.orders.groupBy(X.mod97((F.col("o_orderkey") * 1000003).cast("string")).cast("bigint").alias("remainder")).agg(F.count(F.lit(1)).alias("numbers"))


_GATES = [("macro_f1_minimum", 0.9), ("micro_f1_minimum", 0.5), ("high_risk_f1_min", 0.9), ("macro_supported_f1_maximum", 1.0), ("absent_minimum", 0.1)]


@query(f"""WITH {_COUNTS}, v AS (SELECT *, coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f FROM counts), m AS (SELECT 'micro_f1' AS metric, round(2 * sum(tp) / sum(predicted + support)::DOUBLE, 6) AS actual FROM v UNION ALL SELECT 'macro_f1', round(avg(f), 6) FROM v
  UNION ALL SELECT 'macro_supported_f1', round(avg(f), 6) FROM v WHERE support > 0 UNION ALL SELECT 'high_risk_f1', round(coalesce(2 * sum(tp) / nullif(sum(predicted + support), 0)::DOUBLE, 0), 6) FROM v WHERE high_risk),
  gt(name, metric, operator, threshold) AS (VALUES ('macro_f1_minimum', 'macro_f1', '>=', 0.9::DOUBLE), ('micro_f1_minimum', 'micro_f1', '>=', 0.5), ('high_risk_f1_min', 'high_risk_f1', '>=', 0.9), ('macro_supported_f1_maximum', 'macro_supported_f1', '<=', 1.0), ('absent_minimum', 'absent', '>=', 0.1))
SELECT name, gt.metric, operator, threshold, actual, coalesce(CASE operator WHEN '>=' THEN actual >= threshold ELSE actual <= threshold END, false) AS passed FROM gt LEFT JOIN m USING (metric)""")
def named_gates(t: Tables) -> DataFrame:
    o = matching.overall(matching.label_counts(t.scored_gold, t.pred, t.label_spec)).select(F.concat("scope", F.lit("_f1")).alias("metric"), F.col("f1").alias("actual"))
    return gates.evaluate_gates(t.spark.createDataFrame(_GATES, "name string, threshold double"), o, lenient=True)


@query("""WITH RECURSIVE st AS (SELECT label, pred_idx AS step, round(avg(confidence), 6) AS score FROM pred_span WHERE label IS NOT NULL GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY step) AS k FROM st),
  walk(label, k, best, best_score) AS (SELECT label, k, step::BIGINT, score FROM o WHERE k = 1 UNION ALL SELECT w.label, o.k, CASE WHEN o.score > w.best_score + 0.001 THEN o.step::BIGINT ELSE w.best END, CASE WHEN o.score > w.best_score + 0.001 THEN o.score ELSE w.best_score END FROM walk w JOIN o ON o.label = w.label AND o.k = w.k + 1)
SELECT label, arg_max(best, k) AS best, arg_max(best_score, k) AS best_score FROM walk GROUP BY 1""")
def best_checkpoint(t: Tables) -> DataFrame:
    steps = t.pred_span.groupBy(F.col("label"), (F.col("pred_idx")).alias("step")).agg(F.round(F.avg("confidence"), 6).alias("score"))
    return gates.best_step(steps.where("label is not null"), "label", "step", "score")


@query("""SELECT a.label AS metric, a.x AS a, b.x AS b, round(b.x - a.x, 6) AS delta FROM (SELECT label, round(avg(confidence), 6) AS x FROM pred_span WHERE pred_idx % 2 = 0 GROUP BY 1) a JOIN (SELECT label, round(avg(confidence), 6) AS x FROM pred_span WHERE pred_idx % 2 = 1 GROUP BY 1) b ON a.label = b.label""")
def metric_comparison(t: Tables) -> DataFrame:
    side = lambda k: t.pred_span.where(F.col("pred_idx") % 2 == k).groupBy(F.col("label").alias("metric")).agg(F.round(F.avg("confidence"), 6).alias("actual"))
    return gates.compare_metrics(side(0), side(1))


@query(f"SELECT mask_action, high_risk, label IN {_in(HIGH_RISK)} AS listed, count(*) AS labels FROM label_spec GROUP BY 1, 2, 3")
def ontology_contract(t: Tables) -> DataFrame:
    return t.label_spec.groupBy("mask_action", "high_risk", F.col("label").isin(*HIGH_RISK).alias("listed")).agg(F.count(F.lit(1)).alias("labels"))


# ---- audits and synthesis


@query(f"""WITH {_RAW}, {_FACTS}, x AS (SELECT *, row_number() OVER (PARTITION BY record_idx, s, e, label ORDER BY gold_idx) AS nth, lag(e) OVER (PARTITION BY record_idx ORDER BY s NULLS LAST, e NULLS LAST, label NULLS LAST, gold_idx) AS p FROM raw),
  sh AS (SELECT kind, count(*) AS pairs FROM (SELECT DISTINCT a.kind, a.split AS x, b.split AS y FROM f a JOIN f b ON a.kind = b.kind AND a.value = b.value AND a.split < b.split) q GROUP BY 1),
  tt AS (SELECT text, entities, t, coalesce(t.span_start >= 0 AND t.span_start < t.span_end AND t.span_end <= length(text), false) AS ok FROM (SELECT text, entities, unnest(meta.contrast_targets) AS t FROM split_record) q),
  tg AS (SELECT ok, coalesce(ok AND sha256(substring(text, t.span_start + 1, t.span_end - t.span_start)) = lower(t.value_sha256), false) AS hash_ok, coalesce(CASE WHEN t.expected_label = 'O' THEN NOT (entities IS NULL AND NULL) AND len(list_filter(entities, lambda x: x.span_start < t.span_end AND x.span_end > t.span_start)) = 0
    ELSE len(list_filter(entities, lambda x: x.span_start = t.span_start AND x.span_end = t.span_end AND x.label = t.expected_label)) > 0 END, false) AS label_ok FROM tt),
  o AS (SELECT 'span_faults' AS gate, count(*) FILTER (s IS NULL OR e IS NULL OR label IS NULL OR n IS NULL OR s < 0 OR s >= e OR e > n OR label NOT IN {_in(LABELS)} OR nth > 1 OR p > s) AS actual FROM x
    UNION ALL SELECT 'repeated_texts', count(*) FROM (SELECT text FROM split_record WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) q
    UNION ALL SELECT 'provenance_differs', count(*) FILTER (list_sort(list_distinct(a)) <> list_sort(list_distinct(b))) FROM (SELECT coalesce(list_transform(entities, lambda x: (x.span_start, x.span_end, x.label)::VARCHAR), []) AS a,
      coalesce(list_transform(meta.entity_provenance, lambda x: (x.span_start, x.span_end, x.label)::VARCHAR), []) AS b FROM split_record) q
    UNION ALL SELECT 'target_offsets', count(*) FILTER (NOT ok) FROM tg UNION ALL SELECT 'target_hashes', count(*) FILTER (ok AND NOT hash_ok) FROM tg UNION ALL SELECT 'target_labels', count(*) FILTER (ok AND NOT label_ok) FROM tg
    UNION ALL SELECT 'repeated_ids', count(*) FROM (SELECT 1 FROM split_record WHERE meta.source_record_id IS NOT NULL GROUP BY coalesce(meta.source, ''), meta.source_record_id HAVING count(*) > 1) q
    UNION ALL SELECT 'cross_split_' || k, coalesce(pairs, 0) FROM (VALUES ('text'), ('source_record_id'), ('template_family'), ('value_sha256')) v(k) LEFT JOIN sh ON kind = k)
SELECT gate, actual, 0::BIGINT AS expected, actual = 0 AS passed FROM o""")
def dataset_gates(t: Tables) -> DataFrame:
    return audits.dataset_gates(t.split_record)


_LOOKS = {"ssn_vs_order_reference": "SSN", "card_vs_transaction": "CREDIT_CARD_NUMBER", "account_vs_batch": "BANK_ACCOUNT_NUMBER", "phone_vs_ticket": "PHONE", "ip_vs_build": "IP_ADDRESS", "token_vs_trace": "AUTH_TOKEN"}


@query(f"""WITH RECURSIVE {_TAX}, sub AS (SELECT template_family AS f, min(business_id_subtype) AS subtype FROM family_spec GROUP BY 1), look(c, look) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _LOOKS.items())}),
  er AS (SELECT row_number() OVER () AS id, x.record_idx, x.category, g.s AS gs, g.e AS ge, p.s AS ps, p.e AS pe, x.gold_label, x.pred_label FROM tax x LEFT JOIN gold g ON g.record_idx = x.record_idx AND g.gold_idx = x.gold_idx LEFT JOIN pred p ON p.record_idx = x.record_idx AND p.pred_idx = x.pred_idx WHERE x.category <> 'exact'),
  tg AS (SELECT record_idx, t.span_start AS s, t.span_end AS e, t.expected_label AS x, look, subtype FROM (SELECT record_idx, meta.contrast_category AS c, meta.template_family AS f, unnest(meta.contrast_targets) AS t FROM split_record) q LEFT JOIN look USING (c) LEFT JOIN sub USING (f)
    WHERE t.span_start >= 0 AND t.span_end > t.span_start AND trim(t.expected_label) <> ''),
  fl AS (SELECT er.id, count(*) AS n, bool_or(x IN ('O', 'BUSINESS_ID') AND pred_label = look) AS a, bool_or(x = look AND pred_label = 'BUSINESS_ID') AS b, bool_or(x = 'BUSINESS_ID' AND upper(subtype) IN {_in(audits.UNSEEN)}) AS d
    FROM er JOIN tg ON tg.record_idx = er.record_idx AND (coalesce(gs < tg.e AND ge > tg.s, false) OR coalesce(ps < tg.e AND pe > tg.s, false)) GROUP BY 1)
SELECT er.record_idx, category, gs, ge, ps, pe, gold_label, pred_label, concat_ws(',', CASE WHEN a THEN 'morphology-over-context' END, CASE WHEN b THEN 'context-over-morphology' END, CASE WHEN n > 0 AND meta.surface_style = 'abbreviated_key' THEN 'ambiguous-key' END, CASE WHEN d THEN 'unseen-business-subtype' END,
  CASE WHEN n > 0 AND (meta.text_format IN {_in(audits.STRUCTURED)} OR meta.surface_style IN {_in(audits.STRUCTURED_STYLES)}) THEN 'structured-field-confusion' END) AS tags FROM er LEFT JOIN fl USING (id) JOIN split_record r ON r.record_idx = er.record_idx""")
def error_tags(t: Tables) -> DataFrame:
    tax = matching.taxonomy(t.scored_gold, t.pred).where("category <> 'exact'")
    gold, pred = t.scored_gold.select("record_idx", "gold_idx", F.col("s").alias("gs"), F.col("e").alias("ge")), t.pred.select("record_idx", "pred_idx", F.col("s").alias("ps"), F.col("e").alias("pe"))
    placed = tax.join(gold, ["record_idx", "gold_idx"], "left").join(pred, ["record_idx", "pred_idx"], "left").select("record_idx", "category", "gs", "ge", "ps", "pe", "gold_label", "pred_label")
    subtypes = t.family_spec.groupBy("template_family").agg(F.min("business_id_subtype").alias("subtype"))
    known = t.split_record.select("record_idx", F.col("meta.template_family").alias("template_family")).join(subtypes, "template_family").select("record_idx", "subtype")
    tagged = audits.error_tags(placed, t.split_record, outcomes.targets(t.split_record).join(known, "record_idx", "left"), _LOOKS)
    return tagged.withColumn("tags", F.array_join("tags", ","))


@query(f"""WITH {_OVER} SELECT count(*) AS predictions, count(DISTINCT record_idx) AS records FROM pred p WHERE label = 'BUSINESS_ID' AND record_idx IN (SELECT record_idx FROM split_record WHERE meta.template_family LIKE 'account%')
  AND NOT EXISTS (SELECT 1 FROM o WHERE o.record_idx = p.record_idx AND o.pred_idx = p.pred_idx)""")
def accountlike_overmask(t: Tables) -> DataFrame:
    p = audits.overmasked(t.pred, t.scored_gold, t.split_record, "BUSINESS_ID", F.col("meta.template_family").like("account%"))
    return p.agg(F.count(F.lit(1)).alias("predictions"), F.countDistinct("record_idx").alias("records"))


@query()
def family_most_similar(t: Tables) -> DataFrame:
    f = t.family_spec.where("template_family is not null").select(F.col("template_family").alias("name"), F.regexp_replace("template_family", "_", " ").alias("template")).distinct()
    return audits.greatest_similarities(f, f)


@query("SELECT meta.source AS part, count(*) AS records, round(count(*) / CAST((SELECT count(*) FROM split_record) AS DOUBLE), 6) AS share FROM split_record GROUP BY 1")
def corpus_composition(t: Tables) -> DataFrame:
    return audits.composition(t.split_record, F.col("meta.source"))


@query()
def synthetic_records(t: Tables) -> DataFrame:
    """As many records as family_spec counts pairs, over the whole catalogue of templates."""
    rows = t.family_spec.agg(F.coalesce(F.sum("pair_count"), F.lit(0)).alias("n")).first().n
    return synthesis.generate(t.spark, synthesis.catalog(t.spark).drop("kind"), int(rows))


@query()
def synthetic_negatives(t: Tables) -> DataFrame:
    return synthesis.unlabeled(t.spark, int(t.family_spec.count()))


@query()
def synthetic_pairs(t: Tables) -> DataFrame:
    f = t.family_spec.where("morphology_class is not null and pair_count is not null").select(F.col("template_family").alias("family"), F.col("morphology_class").alias("label"), F.col("pair_count").alias("pairs"), F.lit("verified value {FOCUS} of the customer").alias("sensitive"), F.lit("order reference {FOCUS} replayed").alias("harmless"))
    return synthesis.contrast_pairs(t.spark, f.distinct())


# ---- rules of records

_BLANK = "coalesce(regexp_replace({0}, '[\\s\\p{{Z}}]+', '', 'g'), '') = ''"
_FITS = "coalesce({0}.span_start >= 0 AND {0}.span_start < {0}.span_end AND {0}.span_end <= length(text), false)"
_KEPT = "coalesce(len(list_filter(entities, lambda y: y.span_start = {0}.span_start AND y.span_end = {0}.span_end AND y.label = {1})) > 0, false)"
_PROV = f"""pv AS (SELECT record_idx, text, entities, meta.entity_provenance AS items, i AS nth, meta.entity_provenance[i] AS x FROM (SELECT *, unnest(generate_series(1, len(meta.entity_provenance))) AS i FROM split_record WHERE len(meta.entity_provenance) > 0) q),
  pf AS (SELECT record_idx, nth - 1 AS item, CASE WHEN x.span_start IS NULL OR x.span_end IS NULL OR x.label IS NULL OR x.source_label IS NULL THEN ['missing_field'] WHEN NOT {_FITS.format("x")} THEN ['outside_text'] WHEN x.label NOT IN {_in(LABELS)} THEN ['unknown_label']
    WHEN {_BLANK.format("x.source_label")} THEN ['blank_source_label'] ELSE list_filter([CASE WHEN NOT {_KEPT.format("x", "x.label")} THEN 'not_retained' END, CASE WHEN x.source_span_index < 0 THEN 'negative_source_index' END, CASE WHEN list_contains(items[1:nth - 1], x) THEN 'duplicate' END], lambda c: c IS NOT NULL) END AS codes FROM pv)"""


@query(f"WITH {_PROV} SELECT record_idx, item, array_to_string(codes, ',') AS codes FROM pf")
def provenance_faults(t: Tables) -> DataFrame:
    return validation.provenance_faults(t.split_record).withColumn("codes", F.array_join("codes", ","))


@query(f"""WITH ex AS (SELECT record_idx, text, entities, list_transform(list_filter(entities, lambda y: y.label IS NULL OR y.label NOT IN {_in(LABELS)} OR NOT coalesce(y.span_start >= 0 AND y.span_start < y.span_end AND y.span_end <= length(text), false)),
    lambda y: {{'span_start': y.span_start, 'span_end': y.span_end, 'source_label': y.label, 'category': CASE WHEN y.label = upper(y.label) THEN 'invalid_source_span' END, 'mapped_label': upper(y.label)}}) AS items FROM split_record),
  en AS (SELECT record_idx, text, entities, items, i AS nth, items[i] AS x FROM (SELECT *, unnest(generate_series(1, len(items))) AS i FROM ex WHERE len(items) > 0) q)
SELECT record_idx, nth - 1 AS item, CASE WHEN {_BLANK.format("x.source_label")} THEN 'blank_source_label' WHEN coalesce(x.category, '') <> 'invalid_source_span' AND (x.span_start IS NULL OR x.span_end IS NULL) THEN 'offsets_missing' WHEN coalesce(x.category, '') <> 'invalid_source_span' AND NOT {_FITS.format("x")} THEN 'outside_text'
  ELSE concat_ws(',', CASE WHEN x.mapped_label NOT IN {_in(LABELS)} THEN 'unknown_mapped_label' END, CASE WHEN x.mapped_label IN {_in(LABELS)} AND {_FITS.format("x")} AND {_KEPT.format("x", "x.mapped_label")} THEN 'also_retained' END,
    CASE WHEN len(list_filter(items[1:nth - 1], lambda y: y.span_start IS NOT DISTINCT FROM x.span_start AND y.span_end IS NOT DISTINCT FROM x.span_end AND y.source_label IS NOT DISTINCT FROM x.source_label)) > 0 THEN 'duplicate' END) END AS codes FROM en""")
def excluded_span_faults(t: Tables) -> DataFrame:
    """Of the delivered spans that are no candidates, as a conversion would exclude them."""
    bad = F.filter("entities", lambda y: y["label"].isNull() | ~y["label"].isin(*LABELS) | ~spans.in_bounds(y["span_start"], y["span_end"], F.length("text")))
    item = lambda y: F.struct(y["span_start"].alias("span_start"), y["span_end"].alias("span_end"), y["label"].alias("source_label"), F.lit("excluded").alias("reason"), F.when(y["label"] == F.upper(y["label"]), validation.INVALID_SOURCE).alias("category"), F.upper(y["label"]).alias("mapped_label"), F.lit(True).alias("blocks"))
    return validation.excluded_faults(t.split_record.select("record_idx", "text", "entities", F.transform(bad, item).alias("excluded"))).withColumn("codes", F.array_join("codes", ","))


_META = f"""mf AS (SELECT record_idx, concat_ws(',', CASE WHEN {_BLANK.format("meta.source")} THEN 'source_missing' END, CASE WHEN {_BLANK.format("meta.review_status")} THEN 'review_missing' END, CASE WHEN NOT {_BLANK.format("meta.review_status")} AND meta.review_status NOT IN {_in((*REVIEW_STATES, *LEGACY_REVIEW_STATES))} THEN 'review_unknown' END,
  CASE WHEN meta.license_reviewed IS NULL THEN 'license_missing' END, CASE WHEN meta.template_family IS NOT NULL AND {_BLANK.format("meta.template_family")} THEN 'family_blank' END, CASE WHEN NOT {_BLANK.format("meta.template_family")} AND regexp_matches(meta.template_family, '[\\s\\p{{Z}}]') THEN 'family_with_blank' END,
  CASE WHEN meta.review_status = 'synthetic_generated' AND meta.template_family IS NULL THEN 'family_missing' END) AS codes, concat_ws(',', CASE WHEN meta.review_status = 'generated' THEN 'review_legacy' END, CASE WHEN meta.review_status = 'generated' AND meta.template_family IS NULL THEN 'family_missing' END) AS warnings FROM split_record)"""


@query(f"WITH {_META} SELECT * FROM mf")
def meta_faults(t: Tables) -> DataFrame:
    return validation.meta_faults(t.split_record).select("record_idx", F.array_join("codes", ",").alias("codes"), F.array_join("warnings", ",").alias("warnings"))


_FOCUS = {k: (v, "BUSINESS_ID", "O") for k, v in _LOOKS.items()}


@query(f"""WITH x AS (SELECT record_idx, text, entities, meta.contrast_category AS category, i - 1 AS item, meta.contrast_targets[i] AS x FROM (SELECT *, unnest(generate_series(1, len(meta.contrast_targets))) AS i FROM split_record WHERE len(meta.contrast_targets) > 0) q)
SELECT record_idx, item, x.target_role AS target_role, CASE WHEN NOT {_FITS.format("x")} THEN 'offsets' WHEN x.expected_label IS NULL OR x.expected_label NOT IN {_in(("O", *LABELS))} THEN 'unknown_label' WHEN NOT coalesce(regexp_full_match(x.value_sha256, '[0-9a-f]{{64}}'), false) THEN 'hash_format'
  WHEN sha256(substring(text, x.span_start + 1, x.span_end - x.span_start)) <> x.value_sha256 THEN 'hash_differs' WHEN x.expected_label = 'O' AND coalesce(len(list_filter(entities, lambda y: y.span_start < x.span_end AND y.span_end > x.span_start)) > 0, false) THEN 'o_touches_span'
  WHEN x.expected_label <> 'O' AND NOT {_KEPT.format("x", "x.expected_label")} THEN 'no_equal_span'
  WHEN x.target_role = 'focus' AND x.expected_label NOT IN ('BUSINESS_ID', 'O') AND x.expected_label <> CASE category {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LOOKS.items())} END THEN 'focus_label' WHEN x.target_role = 'companion' AND x.expected_label = 'O' THEN 'companion_is_nothing' END AS code FROM x""")
def target_rule_faults(t: Tables) -> DataFrame:
    return validation.target_rules(t.split_record, _FOCUS)


_VALID = f"""{_PROV}, {_META}, {_RAW}, sx AS (SELECT *, row_number() OVER (PARTITION BY record_idx, s, e, label ORDER BY gold_idx) AS nth, lag(e) OVER (PARTITION BY record_idx ORDER BY s NULLS LAST, e NULLS LAST, label NULLS LAST, gold_idx) AS p FROM raw),
  sn AS (SELECT record_idx, count(*) AS span_codes FROM sx WHERE s IS NULL OR e IS NULL OR label IS NULL OR n IS NULL OR s < 0 OR s >= e OR e > n OR label NOT IN {_in(LABELS)} OR nth > 1 OR p > s GROUP BY 1), pn AS (SELECT record_idx, count(*) AS provenance_codes FROM pf WHERE len(codes) > 0 GROUP BY 1),
  va AS (SELECT record_idx, split, CASE WHEN text IS NULL THEN 'text_missing' WHEN {_BLANK.format("text")} THEN 'text_blank' WHEN entities IS NULL THEN 'entities_missing' END AS text_code, coalesce(span_codes, 0) AS span_codes, CASE WHEN codes = '' THEN 0 ELSE len(string_split(codes, ',')) END AS meta_codes, coalesce(provenance_codes, 0) AS provenance_codes
    FROM split_record JOIN mf USING (record_idx) LEFT JOIN sn USING (record_idx) LEFT JOIN pn USING (record_idx))"""


@query(f"""WITH {_VALID} SELECT record_idx, text_code IS NULL AND span_codes + meta_codes + provenance_codes = 0 AS valid,
  concat_ws('; ', text_code, CASE WHEN span_codes > 0 THEN 'span_codes: ' || span_codes END, CASE WHEN meta_codes > 0 THEN 'meta_codes: ' || meta_codes END, CASE WHEN provenance_codes > 0 THEN 'provenance_codes: ' || provenance_codes END) AS message FROM va""")
def record_validity(t: Tables) -> DataFrame:
    return validation.messages(validation.validity(t.split_record))


@query(f"WITH {_GOLD} SELECT s.split, l.label FROM (SELECT DISTINCT split FROM split_record WHERE split IS NOT NULL) s CROSS JOIN label_spec l WHERE NOT EXISTS (SELECT 1 FROM allgold g WHERE g.split = s.split AND g.label = l.label)")
def missing_labels(t: Tables) -> DataFrame:
    labels = F.array(*map(F.lit, LABELS))
    required = t.split_record.where("split is not null").select("split").distinct().select("split", F.explode(labels).alias("label"))
    return validation.missing(required, t.gold, "split", "label")


# ---- reports and what gates compare


@query(f"""WITH {_NUM}, seg AS (SELECT record_idx, CASE WHEN {_SYN} THEN 'synthetic' ELSE 'external' END AS segment FROM split_record), x AS (SELECT segment, label, 1 AS t, 0 AS p, 0 AS g FROM exact JOIN seg USING (record_idx) UNION ALL SELECT segment, label, 0, 1, 0 FROM pred JOIN seg USING (record_idx) JOIN split_record USING (record_idx) WHERE split IN ('dev', 'test')
    UNION ALL SELECT segment, label, 0, 0, 1 FROM gold JOIN seg USING (record_idx)), y AS (SELECT coalesce(segment, 'overall') AS segment, label, sum(t) AS tp, sum(p) AS predicted, sum(g) AS support FROM x GROUP BY GROUPING SETS ((segment, label), (label))),
  v AS (SELECT *, coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f FROM y), r AS (SELECT coalesce(segment, 'overall') AS segment, count(*) AS records FROM seg JOIN split_record USING (record_idx) WHERE split IN ('dev', 'test') GROUP BY ROLLUP (segment))
SELECT segment, records, CAST(sum(support) AS BIGINT) AS gold, round(coalesce(sum(tp) / nullif(sum(predicted), 0)::DOUBLE, 0), 6) AS precision, round(coalesce(sum(tp) / nullif(sum(support), 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * sum(tp) / nullif(sum(predicted + support), 0)::DOUBLE, 0), 6) AS f1,
  round(coalesce(avg(f) FILTER (support > 0), 0), 6) AS supported_macro_f1 FROM v JOIN r USING (segment) GROUP BY 1, 2""")
def source_segments(t: Tables) -> DataFrame:
    scored = t.split_record.where("split in ('dev', 'test')")
    segment = scored.select("record_idx", F.when(corpus.is_synthetic(), "synthetic").otherwise("external").alias("segment"))
    return reporting.segments(segment, t.scored_gold, t.pred)


@query(f"""WITH {_GOLD}, {_PRED}, sg AS (SELECT * FROM gold WHERE label = 'SSN'), bg AS (SELECT * FROM gold WHERE label = 'BUSINESS_ID'), sp AS (SELECT p.* FROM pred p JOIN split_record USING (record_idx) WHERE label = 'SSN' AND split IN ('dev', 'test')),
  lone AS (SELECT * FROM sp p WHERE NOT EXISTS (SELECT 1 FROM sg g WHERE g.record_idx = p.record_idx AND g.s < p.e AND p.s < g.e))
SELECT (SELECT count(*) FROM sg) AS support, (SELECT count(*) FROM sg g WHERE EXISTS (SELECT 1 FROM sp p WHERE p.record_idx = g.record_idx AND p.s = g.s AND p.e = g.e)) AS recognized,
  (SELECT count(*) FROM lone p WHERE EXISTS (SELECT 1 FROM bg g WHERE g.record_idx = p.record_idx AND g.s < p.e AND p.s < g.e)) AS others_as_label, (SELECT count(*) FROM lone p WHERE NOT EXISTS (SELECT 1 FROM bg g WHERE g.record_idx = p.record_idx AND g.s < p.e AND p.s < g.e)) AS nothing_as_label,
  (SELECT count(*) FROM sg g WHERE EXISTS (SELECT 1 FROM pred p WHERE p.record_idx = g.record_idx AND p.label = 'BUSINESS_ID' AND p.s < g.e AND g.s < p.e)) AS label_as_other, (SELECT count(*) FROM sg g WHERE EXISTS (SELECT 1 FROM sp p WHERE p.record_idx = g.record_idx AND p.s < g.e AND g.s < p.e AND (p.s <> g.s OR p.e <> g.e))) AS boundary_errors""")
def ssn_context(t: Tables) -> DataFrame:
    scored = t.split_record.where("split in ('dev', 'test')").select("record_idx")
    return outcomes.label_in_context(t.scored_gold, t.pred.join(scored, "record_idx", "left_semi"), "SSN", "BUSINESS_ID")


@query(f"""WITH {_GOLD}, {_TOKENS}, ft AS (SELECT * FROM rt WHERE tok_idx < 384), ch AS (SELECT g.record_idx, g.gold_idx, g.label, unnest(generate_series(g.s, g.e - 1)) AS c, text FROM allgold g JOIN split_record USING (record_idx) WHERE g.record_idx IN (SELECT record_idx FROM rt)),
  un AS (SELECT DISTINCT record_idx, gold_idx, label FROM ch WHERE NOT regexp_full_match(substring(text, c + 1, 1), '[\\s\\p{{Z}}]') AND NOT EXISTS (SELECT 1 FROM ft WHERE ft.record_idx = ch.record_idx AND ft.ts <= c AND c < ft.te)) SELECT label, count(*) AS truncated FROM un GROUP BY 1""")
def truncated_spans(t: Tables) -> DataFrame:
    return decoding.truncated(t.gold, decoding.record_tokens(t.align_window), t.split_record).groupBy("label").agg(F.count(F.lit(1)).alias("truncated"))


@query(f"""WITH {_COUNTS}, {_TARGETS.removeprefix(_PRED + ", ")}, {_OVER.removeprefix(_GOLD + ", " + _PRED + ", ")}, v AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS r, coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f FROM counts),
  fl AS (SELECT record_idx, record_idx IN (SELECT record_idx FROM ug) OR record_idx IN (SELECT record_idx FROM up) AS d, record_idx IN (SELECT record_idx FROM up) AS x FROM split_record WHERE split IN ('dev', 'test')),
  pair(a, b) AS (VALUES ('SSN', 'ITIN'), ('CREDIT_CARD_NUMBER', 'BUSINESS_ID'), ('BUSINESS_ID', 'SSN'))
SELECT 'micro_f1' AS metric, round(2 * sum(tp) / sum(predicted + support)::DOUBLE, 6) AS actual FROM v UNION ALL SELECT 'macro_f1', round(avg(f), 6) FROM v UNION ALL SELECT 'supported_macro_f1', round(avg(f), 6) FROM v WHERE support > 0
UNION ALL SELECT 'high_risk_recall', round(coalesce(sum(tp) / nullif(sum(support), 0)::DOUBLE, 0), 6) FROM v WHERE high_risk UNION ALL SELECT 'minimum_individual_label_recall', round(coalesce(min(r), 0), 6) FROM v WHERE support > 0
UNION ALL SELECT lower(label) || '_' || n, CASE n WHEN 'precision' THEN round(p, 6) WHEN 'recall' THEN round(r, 6) ELSE round(f, 6) END FROM v CROSS JOIN (VALUES ('precision'), ('recall'), ('f1')) k(n) WHERE label IN ('BUSINESS_ID', 'SSN', 'IP_ADDRESS')
UNION ALL SELECT 'record_error_rate', round(count(*) FILTER (d) / count(*)::DOUBLE, 6) FROM fl UNION ALL SELECT 'record_false_positive_rate', round(count(*) FILTER (x) / count(*)::DOUBLE, 6) FROM fl
UNION ALL SELECT 'context_target_error_rate', coalesce(max(rate) FILTER (category IS NULL), 0) FROM rates UNION ALL SELECT 'maximum_category_error_rate', coalesce(max(rate) FILTER (category IS NOT NULL), 0) FROM rates
UNION ALL SELECT lower(a) || '_to_' || lower(b) || '_count', count(*)::DOUBLE FROM pair, (SELECT DISTINCT record_idx, gold_idx, gl, pl FROM o WHERE gl <> pl) q WHERE gl = a AND pl = b GROUP BY a, b
UNION ALL SELECT lower(a) || '_to_' || lower(b) || '_count', 0 FROM pair WHERE NOT EXISTS (SELECT 1 FROM o WHERE gl = a AND pl = b)""")
def gate_actuals(t: Tables) -> DataFrame:
    scored = t.split_record.where("split in ('dev', 'test')")
    counts = matching.label_counts(t.scored_gold, t.pred, t.label_spec)
    targets = outcomes.target_outcomes(outcomes.targets(scored), t.pred)
    return reporting.gate_actuals(counts, outcomes.target_rates(targets), matching.error_rates(matching.record_errors(scored, t.scored_gold, t.pred)), outcomes.directions(t.scored_gold, t.pred))
