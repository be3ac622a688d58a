"""The stateless checks on a stream of record files, and first-seen texts within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spans import in_bounds
from ..schema import LABELS


def record_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of records as they arrive in a folder; the files of the pattern that are there tell the schema."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def valid_spans(records: DataFrame) -> DataFrame:
    """(record_idx, ingested_at, label) of the spans within their text and with a label of the ontology; no state."""
    x = records.select("record_idx", "ingested_at", F.length("text").alias("n"), F.explode("entities").alias("x"))
    return x.where(in_bounds(F.col("x.span_start"), F.col("x.span_end"), F.col("n")) & F.col("x.label").isin(*LABELS)).select("record_idx", "ingested_at", F.col("x.label").alias("label"))


def label_counts(records: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """(day, label, spans): counts by day of arrival; records later than the watermark are left out by Structured Streaming in append mode."""
    spans = valid_spans(records).withWatermark("ingested_at", late)
    return spans.groupBy(F.window("ingested_at", window).alias("w"), "label").agg(F.count(F.lit(1)).alias("spans")).select(F.col("w.start").alias("day"), "label", "spans")


def first_texts(records: DataFrame, late: str = "30 days") -> DataFrame:
    """Records whose text was not seen within the watermark; state is a hash a text."""
    return records.where("text is not null").withColumn("text_hash", F.sha2("text", 256)).withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["text_hash"])
