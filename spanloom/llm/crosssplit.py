"""Records of evaluation splits that also stand, exactly or almost, in the training split.

The edit-distance segment join named for this problem cannot give the required result: a pair counts when half of the distinct runs of
three words agree, wherever they stand, so a text of n words may be n / 9 and more edits (or any reordering) away. Cut into that many
segments plus one, each segment is three words or less, and such runs stand in up to thousands of texts each. The almost equal texts
therefore come from the banded BagMinHash join with its exact check of the overlap, restricted to pairs across the splits. README.md has the figures. edited_overlaps is the segment join for texts that are a few edits apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import cut
from .groups import id_key, name_key, outer_clean
from .neardup import TEXT, Likeness, across_classes, classed
from .segments import EDITS, edit_join

EVALUATION, TRAINING = ("dev", "test"), "train"
#: Copies of a shared key on the side without rows, against hot keys.
SALT = 16


def _keys() -> dict[str, Column]:
    focus = F.get(F.filter("meta.contrast_targets", lambda t: t["target_role"] == "focus"), 0)["value_sha256"]
    source, record = id_key(F.col("meta.source")), id_key(F.col("meta.source_record_id"))
    return {
        "source_id": F.when(source.isNotNull() & record.isNotNull(), F.to_json(F.array(source, record))),
        "value_hash": id_key(focus),
        "family": name_key(F.col("meta.template_family")),
    }


def key_overlaps(records: DataFrame) -> DataFrame:
    """(record_idx, overlap_kind) for source_id, value_hash and family. Keys of the training side are aggregated before the shuffle and meet the
    aggregated ones of the evaluation side; only keys that both have go back to the rows, salted, so a hot key is spread."""
    kinds = _keys()
    split = outer_clean(F.col("split"))
    pairs = F.array(*[F.struct(F.lit(k).alias("overlap_kind"), c.alias("value")) for k, c in kinds.items()])
    tall = records.where(split.isin(*EVALUATION, TRAINING)).select("record_idx", (split != TRAINING).alias("evaluated"), F.explode(pairs).alias("p"))
    tall = tall.select("record_idx", "evaluated", "p.overlap_kind", F.xxhash64("p.value").alias("h"), F.col("p.value").alias("value")).where("value is not null")
    shared = tall.groupBy("overlap_kind", "value").agg(F.max("evaluated").alias("e"), F.min("evaluated").alias("t")).where("e and not t").select("overlap_kind", "value")
    spread = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = tall.where("evaluated").withColumn("salt", F.pmod(F.xxhash64("record_idx"), F.lit(SALT)).cast("int"))
    return rows.join(spread, ["overlap_kind", "value", "salt"], "left_semi").select("record_idx", "overlap_kind").distinct()


def text_overlaps(records: DataFrame, like: Likeness = TEXT) -> DataFrame:
    """(record_idx): evaluation records whose text is equal or similar enough to a training text."""
    split = outer_clean(F.col("split"))
    rows = records.where(split.isin(*EVALUATION, TRAINING)).select("record_idx", "text", (split != TRAINING).alias("evaluated"))
    classes = classed(rows, "text", like, "record_idx", "evaluated")
    known = cut(classes.select("record_idx", "sid", "evaluated"))
    found = across_classes(classes, known.select("sid", "evaluated"), like, "evaluated")
    return known.where("evaluated").select("record_idx", "sid").join(found, "sid", "left_semi").select("record_idx").distinct()


def edited_overlaps(records: DataFrame, edits: int = EDITS) -> DataFrame:
    """(record_idx, distance): evaluation records whose text is at most `edits` edits from a training text, with the least distance. Blank texts are left out."""
    split = outer_clean(F.col("split"))
    rows = records.where(split.isin(*EVALUATION, TRAINING) & (outer_clean(F.col("text")) != "")).select("record_idx", "text", (split != TRAINING).alias("evaluated"))
    pairs = edit_join(rows.where("evaluated"), rows.where("not evaluated"), edits=edits)
    least = pairs.groupBy(F.col("evaluation").alias("h")).agg(F.min("distance").alias("distance"))
    return rows.where("evaluated").select("record_idx", F.xxhash64("text").alias("h")).join(least, "h").select("record_idx", "distance")


def overlaps(records: DataFrame) -> DataFrame:
    """(record_idx, overlap_kind): each way in which a dev or test record overlaps some training record.

    Records without a split are on neither side. Missing names, ids and hashes, null texts and those of fewer than three words overlap nothing.
    """
    return key_overlaps(records).unionByName(text_overlaps(records).select("record_idx", F.lit("text").alias("overlap_kind")))


def report(records: DataFrame) -> DataFrame:
    """(split, source, overlap_kind, records, overlapping): overlapping records by split, source (null for none) and kind, with all records of that split and source."""
    rows = records.select("record_idx", outer_clean(F.col("split")).alias("split"), F.col("meta.source").alias("source")).where(F.col("split").isin(*EVALUATION))
    total = rows.groupBy("split", "source").agg(F.count(F.lit(1)).alias("records"))
    found = rows.join(overlaps(records), "record_idx").groupBy("split", "source", "overlap_kind").agg(F.countDistinct("record_idx").alias("overlapping"))
    return found.alias("f").join(total.alias("t"), (F.col("f.split") == F.col("t.split")) & F.col("f.source").eqNullSafe(F.col("t.source"))).select("f.split", "f.source", "overlap_kind", "records", "overlapping")
