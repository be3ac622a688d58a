"""From delivered spans of any shape to canonical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_label, filled
from ..schema import LABELS

# Names by which the fields of a span go, and the keys under which a list of spans may stand, in order of preference.
START_NAMES = ("start", "start_idx", "start_index", "begin", "offset_start")
END_NAMES = ("end", "end_idx", "end_index", "stop", "offset_end")
LABEL_NAMES = ("label", "type", "entity", "entity_type", "pii_type", "category")
VALUE_NAMES = ("text", "value", "span_text", "entity_text")
COLLECTIONS = ("spans", "entities", "annotations", "pii", "items")


def _field(v: str, names: tuple[str, ...], at: int | None = None) -> Column:
    """The first of the fields that is there, as a string; else the element at a place of a list."""
    places = [f"$.{n}" for n in names] + ([] if at is None else [f"$[{at}]"])
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in places])


def parse_spans(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, span_index, start, end, label, value) from a JSON column: a list of objects or of [start, end, label], an object with such a list under one of COLLECTIONS, one span, or label -> list of
    spans or of [start, end]. Fields go by any of their names.

    Values stay strings (null where missing), so nothing is lost before the checks. What is no JSON gives no row."""
    v = rows.select(key, F.try_parse_json(F.col(raw)).alias("v")).where("v is not null")
    inner = v.withColumn("v", F.coalesce(*[F.try_variant_get("v", f"$.{c}", "variant") for c in COLLECTIONS], F.col("v")))
    kind = F.schema_of_variant("v")
    one = _field("v", LABEL_NAMES).isNotNull() | _field("v", START_NAMES).isNotNull()
    lists = inner.where(kind.startswith("ARRAY"))
    single = inner.where(kind.startswith("OBJECT") & one).withColumn("v", F.parse_json(F.concat(F.lit("["), F.to_json("v"), F.lit("]"))))
    by_label = inner.where(kind.startswith("OBJECT") & ~one)
    flat = lists.unionByName(single)
    items = flat.lateralJoin(flat.sparkSession.tvf.variant_explode(F.col("v").outer()).select("pos", F.col("value").alias("x")))
    parts = [_field("x", START_NAMES, 0).alias("start"), _field("x", END_NAMES, 1).alias("end")]
    listed = items.select(key, F.col("pos").cast("int").alias("span_index"), *parts, _field("x", LABEL_NAMES, 2).alias("label"), _field("x", VALUE_NAMES).alias("value"))
    pairs = by_label.lateralJoin(by_label.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("label"), F.col("value").alias("y")))
    pairs = pairs.lateralJoin(pairs.sparkSession.tvf.variant_explode(F.col("y").outer()).select("pos", F.col("value").alias("x")))
    named = pairs.select(key, F.col("pos").cast("int").alias("span_index"), *parts, "label", _field("x", VALUE_NAMES).alias("value"))
    return listed.unionByName(named)


def dispositions(spans: DataFrame, aliases: dict[str, str], deferred: tuple[str, ...] = (), healthcare: tuple[str, ...] = (), benign: tuple[str, ...] = ()) -> DataFrame:
    """spans(record_idx, gold_idx, s, e, label, text_length) with canonical, disposition and blocks: the first that fits of missing label, offsets missing, offsets
    outside the text, deferred, health care, benign, unknown label, candidate."""
    label = canonical_label(F.col("label"), aliases)
    kinds = (
        F.when(~filled(F.col("label")), "missing_label").when(F.col("s").isNull() | F.col("e").isNull(), "missing_offsets")
        .when(F.col("text_length").isNull() | (F.col("s") < 0) | (F.col("s") >= F.col("e")) | (F.col("e") > F.col("text_length")), "offsets_outside_text")
        .when(label.isin(*deferred, ""), "deferred").when(label.isin(*healthcare, ""), "healthcare").when(label.isin(*benign, ""), "benign")
        .when(~label.isin(*LABELS), "unsupported_label").otherwise("candidate")
    )
    out = spans.withColumn("canonical", F.when(filled(F.col("label")), label)).withColumn("disposition", kinds)
    return out.withColumn("blocks", ~F.col("disposition").isin("candidate", "benign"))


def resolve_overlaps(candidates: DataFrame) -> DataFrame:
    """(record_idx, s, e, label, members, kept, conflict) of distinct (s, e, label): longest first, then earliest, ontology rank, label and first member, a span is kept unless it
    overlaps one kept before; conflict is that span."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LABELS)), F.col("label")), F.lit(0)), F.lit(len(LABELS) + 1))
    g = candidates.groupBy("record_idx", "s", "e", "label").agg(F.count(F.lit(1)).alias("members"), F.min("gold_idx").alias("first"))
    item = F.struct((F.col("s") - F.col("e")).alias("l"), "s", "e", rank.alias("r"), "label", "first", "members")
    per = g.groupBy("record_idx").agg(F.array_sort(F.collect_list(item)).alias("c"))
    fold = F.expr(
        "aggregate(c, cast(array() as array<struct<s:int,e:int,label:string,members:bigint,kept:boolean,conflicts:array<struct<s:int,e:int,label:string>>>>), (a, x) -> "
        "concat(a, array(struct(x.s as s, x.e as e, x.label as label, x.members as members, not exists(a, y -> y.kept and y.s < x.e and x.s < y.e) as kept, "
        "transform(slice(filter(a, y -> y.kept and y.s < x.e and x.s < y.e), 1, 1), y -> struct(y.s as s, y.e as e, y.label as label)) as conflicts))))"
    )
    return per.select("record_idx", F.explode(fold).alias("m")).select("record_idx", "m.s", "m.e", "m.label", "m.members", "m.kept", F.get("m.conflicts", 0).alias("conflict"))


def convert(rows: DataFrame, aliases: dict[str, str], deferred: tuple[str, ...] = (), healthcare: tuple[str, ...] = (), benign: tuple[str, ...] = ()) -> DataFrame:
    """(record_idx, text, entities, provenance, excluded, training_exclusion) from rows(record_idx, text, raw_spans): every source span ends in exactly one place.

    entities: kept spans in order of start, end and label; provenance: every candidate behind them with its source label; excluded: all others with their reason, losers of overlaps among them.
    training_exclusion: whether any excluded span blocks. Rows without text are left out."""
    text = rows.where(filled(F.col("text"))).select("record_idx", "text")
    parsed = parse_spans(rows, "record_idx", "raw_spans").where("start is not null or end is not null or label is not null")
    whole = lambda c: F.when(F.col(c).rlike("^-?[0-9]{1,9}$"), F.col(c).cast("int"))
    s = parsed.join(text, "record_idx").select("record_idx", F.col("span_index").alias("gold_idx"), whole("start").alias("s"), whole("end").alias("e"), "label", F.length("text").alias("text_length"))
    d = dispositions(s, aliases, deferred, healthcare, benign)
    good = d.where("disposition = 'candidate'").select("record_idx", "gold_idx", "s", "e", F.col("canonical").alias("label"), F.col("label").alias("source_label"))
    resolved = resolve_overlaps(good)
    members = good.join(resolved.select("record_idx", "s", "e", "label", "kept"), ["record_idx", "s", "e", "label"])
    entity = F.struct(F.col("s").alias("span_start"), F.col("e").alias("span_end"), "label")
    kept = resolved.where("kept").groupBy("record_idx").agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    prov = F.struct(F.col("s").alias("span_start"), F.col("e").alias("span_end"), "label", "source_label", F.col("gold_idx").alias("source_span_index"))
    provenance = members.where("kept").groupBy("record_idx").agg(F.array_sort(F.collect_list(prov)).alias("provenance"))
    lost = members.where("not kept").select("record_idx", "gold_idx", "s", "e", "source_label", F.lit("overlap_conflict").alias("reason"), F.lit(True).alias("blocks"))
    out = d.where("disposition <> 'candidate'").select("record_idx", "gold_idx", "s", "e", F.col("label").alias("source_label"), F.col("disposition").alias("reason"), "blocks").unionByName(lost)
    item = F.struct(F.coalesce("s", F.lit(2147483647)).alias("order_start"), F.coalesce("e", F.lit(2147483647)).alias("order_end"), F.col("gold_idx").alias("source_span_index"), "source_label", "reason", "blocks")
    excluded = out.groupBy("record_idx").agg(F.array_sort(F.collect_list(item)).alias("excluded"), F.max("blocks").alias("b"))
    j = text.join(kept, "record_idx", "left").join(provenance, "record_idx", "left").join(excluded, "record_idx", "left")
    return j.withColumn("training_exclusion", F.coalesce("b", F.lit(False))).drop("b")
