"""Token tables: windows, alignment of spans to tokens, averaged scores, BIO decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import argmax, softmax


def latest_windows(windows: DataFrame) -> DataFrame:
    """(record_idx, window_index, offset_mapping): of rows with one key the one aligned last."""
    return windows.groupBy("record_idx", "window_index").agg(F.max_by("offset_mapping", F.struct("aligned_at", F.size("offset_mapping"))).alias("offset_mapping"))


def tokens(windows: DataFrame) -> DataFrame:
    """(record_idx, window_index, tok_idx, ts, te): one row a token; tokens without characters are left out."""
    w = latest_windows(windows).select("record_idx", "window_index", F.posexplode("offset_mapping").alias("tok_idx", "t"))
    return w.select("record_idx", "window_index", "tok_idx", F.col("t.tok_start").alias("ts"), F.col("t.tok_end").alias("te")).where("te > ts")


def record_tokens(windows: DataFrame) -> DataFrame:
    """(record_idx, tok_idx, ts, te): the tokens of each record over all its windows, once each and numbered from 0 without gaps."""
    t = tokens(windows).select("record_idx", "ts", "te").distinct()
    return t.select("record_idx", (F.row_number().over(Window.partitionBy("record_idx").orderBy("ts", "te")) - 1).alias("tok_idx"), "ts", "te")


def align_spans(spans: DataFrame, windows: DataFrame, records: DataFrame, most_adjusted: int = 3) -> DataFrame:
    """(record_idx, gold_idx, status, windows_seen): how each span meets the tokens of its record's windows.

    In a window a span is whole when all its characters but white space lie in tokens that overlap it, collides when a token overlaps another span too,
    and is excessive when its tokens begin and end more than `most_adjusted` characters off in all. aligned or boundary_adjusted in any window wins; then
    collision, excessive, truncated (tokens seen, not whole) and failed (no token).
    """
    t = tokens(windows)
    s = spans.select("record_idx", "gold_idx", "s", "e")
    hit = t.join(s, "record_idx").where("ts < e and s < te")
    shared = hit.groupBy("record_idx", "window_index", "tok_idx").agg(F.count(F.lit(1)).alias("n"))
    per = hit.join(shared, ["record_idx", "window_index", "tok_idx"]).groupBy("record_idx", "window_index", "gold_idx", "s", "e")
    per = per.agg(F.min("ts").alias("a"), F.max("te").alias("b"), F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "te"))).alias("tt"))
    # texts of records without windows never leave the scan's side of the shuffle
    per = per.join(records.join(windows.select("record_idx").distinct(), "record_idx", "left_semi").select("record_idx", "text"), "record_idx")
    # white space between neighbouring tokens and before the first; anything else there is uncovered
    gaps = F.expr("aggregate(tt, struct(s as at, true as ok), (x, t) -> struct(greatest(x.at, t.te) as at, x.ok and (t.ts <= x.at or trim(regexp_replace(substring(text, x.at + 1, least(t.ts, e) - x.at), '\\\\s+', ' ')) = '') as ok))")
    per = per.withColumn("g", gaps).withColumn("whole", F.col("g.ok") & ((F.col("g.at") >= F.col("e")) | (F.trim(F.regexp_replace(F.expr("substring(text, g.at + 1, e - g.at)"), r"\s+", " ")) == "")))
    off = F.abs(F.col("a") - F.col("s")) + F.abs(F.col("b") - F.col("e"))
    state = F.when(~F.col("whole"), 2).when(F.col("n") > 1, 4).when(off > most_adjusted, 3).when(off > 0, 5).otherwise(6)
    best = per.withColumn("state", state).groupBy("record_idx", "gold_idx").agg(F.max("state").alias("state"), F.countDistinct("window_index").alias("windows_seen"))
    names = F.create_map(*[F.lit(x) for kv in {6: "aligned", 5: "boundary_adjusted", 4: "collision", 3: "excessive", 2: "truncated"}.items() for x in kv])
    has = windows.select("record_idx").distinct()
    out = s.join(has, "record_idx", "left_semi").join(best, ["record_idx", "gold_idx"], "left")
    return out.select("record_idx", "gold_idx", F.coalesce(names[F.col("state")], F.lit("failed")).alias("status"), F.coalesce("windows_seen", F.lit(0)).cast("bigint").alias("windows_seen"))


def bio_spans(tagged: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, span_no, label, first_token, last_token, tokens, mean_confidence, least_confidence) from tagged(key, order..., tag, confidence).

    I-X goes on only within a span of X; else it opens a span of its own. `opened_badly` tells those."""
    w = Window.partitionBy(key).orderBy(*order)
    label = F.when(F.col("tag") != "O", F.substring("tag", 3, 100))
    t = tagged.withColumn("label", label).withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("label").over(w))
    same = F.col("label").isNotNull() & F.col("tag").startswith("I-") & F.coalesce(F.col("before") == F.col("label"), F.lit(False))
    t = t.withColumn("new", (F.col("label").isNotNull() & ~same).cast("int")).withColumn("span_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.where("label is not null").withColumn("bad", F.col("tag").startswith("I-") & (F.col("new") == 1))
    out = t.groupBy(key, "span_no", "label").agg(F.min("n").cast("bigint").alias("first_token"), F.max("n").cast("bigint").alias("last_token"), F.count(F.lit(1)).alias("tokens"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.min("confidence"), 6).alias("least_confidence"), F.max("bad").alias("opened_badly"))
    return out.withColumn("span_no", F.col("span_no").cast("bigint"))


def average_vectors(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, vector, n): element-wise mean of the vectors of equal keys; pre-aggregated by element, so no group is gathered."""
    e = rows.select(*keys, F.posexplode(vector).alias("k", "v")).groupBy(*keys, "k").agg(F.avg(F.col("v").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("k", "v")))
    return e.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias(vector), F.max("n").alias("n"))


def classify(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, best, confidence): first largest element and its softmax."""
    return rows.select(key, argmax(F.col(vector)).cast("bigint").alias("best"), F.round(F.array_max(softmax(F.col(vector))), 6).alias("confidence"))


def overflow_windows(tokens_: DataFrame, most: int = 384, stride: int = 128) -> DataFrame:
    """(record_idx, window_index, tok_idx, ts, te) from (record_idx, tok_idx, ts, te): windows of at most `most` tokens that share `stride`. Each token goes to the windows it
    stands in by arithmetic on its position; no sequence is gathered."""
    step = most - stride
    last = F.max("tok_idx").over(Window.partitionBy("record_idx"))
    low = F.greatest(F.lit(0), F.ceil((F.col("tok_idx") - (most - 1)) / step))
    # no window begins where the one before already reaches the end
    high = F.least(F.floor(F.col("tok_idx") / step), F.greatest(F.lit(0), F.ceil((F.col("last") + 1 - most) / step)))
    t = tokens_.withColumn("last", last).withColumn("window_index", F.explode(F.sequence(low.cast("int"), F.greatest(low, high).cast("int"))))
    return t.select("record_idx", "window_index", (F.col("tok_idx") - F.col("window_index") * step).cast("int").alias("tok_idx"), "ts", "te")


def truncated(spans: DataFrame, tokens_: DataFrame, records: DataFrame, most: int = 384) -> DataFrame:
    """(record_idx, gold_idx, label) of the spans that a single window of the first `most` tokens of record_tokens would cut: some character of theirs but white space lies in none of these tokens.
    Records without tokens are left out."""
    t = tokens_.where(F.col("tok_idx") < most).select("record_idx", "ts", "te")
    s = spans.join(tokens_.select("record_idx").distinct(), "record_idx", "left_semi").select("record_idx", "gold_idx", "label", "s", "e")
    hit = s.join(t, (s["record_idx"] == t["record_idx"]) & (F.col("ts") < F.col("e")) & (F.col("s") < F.col("te")), "left").select(s["record_idx"], "gold_idx", "label", "s", "e", "ts", "te")
    per = hit.groupBy("record_idx", "gold_idx", "label", "s", "e").agg(F.array_sort(F.collect_list(F.when(F.col("ts").isNotNull(), F.struct("ts", "te")))).alias("tt"))
    per = per.join(records.select("record_idx", "text"), "record_idx")
    # what lies before, between and behind the tokens of a span
    rest = F.expr("aggregate(tt, struct(s as at, '' as left), (x, t) -> struct(greatest(x.at, t.te) as at, concat(x.left, if(t.ts > x.at, substring(text, x.at + 1, t.ts - x.at), '')) as left), x -> concat(x.left, if(e > x.at, substring(text, x.at + 1, e - x.at), '')))")
    return per.where(F.length(F.regexp_replace(rest, r"[\s\p{Z}]+", "")) > 0).select("record_idx", "gold_idx", "label")


def bio_tags(windowed: DataFrame, spans: DataFrame) -> DataFrame:
    """windowed with tag: B- at a span's first token in a window, I- after, O elsewhere, IGNORE for tokens that two spans share."""
    hit = windowed.join(spans.select("record_idx", "gold_idx", "s", "e", "label"), "record_idx").where("ts < e and s < te")
    first = F.min("tok_idx").over(Window.partitionBy("record_idx", "window_index", "gold_idx"))
    hit = hit.withColumn("first", first).groupBy("record_idx", "window_index", "tok_idx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("s", "e", "label", "first")).alias("x"))
    tag = F.when(F.col("n").isNull(), "O").when(F.col("n") > 1, "IGNORE").when(F.col("tok_idx") == F.col("x.first"), F.concat(F.lit("B-"), "x.label")).otherwise(F.concat(F.lit("I-"), "x.label"))
    return windowed.join(hit, ["record_idx", "window_index", "tok_idx"], "left").select("record_idx", "window_index", "tok_idx", "ts", "te", tag.alias("tag"))


def weighted_loss(batches: DataFrame) -> DataFrame:
    """(loss): mean of (loss, tokens) weighted by tokens; null without tokens."""
    return batches.agg(F.try_divide(F.sum(F.col("loss") * F.col("tokens")), F.sum("tokens")).alias("loss"))
