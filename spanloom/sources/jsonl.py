"""JSON lines: lenient, strict and strictest reading, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RECORD


def read_lines(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """(file, line_order, line, record, bad): one row a line that is not blank. A bad line is data, not an error: record is null and bad is true.

    line_order grows with the place in a file (the file's blocks are read in order) without counting lines across tasks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line_order"), F.regexp_replace("value", "^﻿", "").alias("line")).where(F.trim("line") != "")
    told = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("r", F.from_json("line", told, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.select("file", "line_order", "line", F.when(~bad, F.struct(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])).alias("record"), bad.alias("bad"))


def read_records(spark: SparkSession, path: str, schema: T.StructType = RECORD, strict: bool = False) -> DataFrame:
    """The records of the good lines; strict fails on the first bad one."""
    lines = read_lines(spark, path, schema)
    if strict:
        lines = lines.withColumn("record", F.when(F.col("bad"), F.raise_error(F.concat(F.lit("bad line in "), "file"))).otherwise(F.col("record")))
    return lines.where("record is not null").select("record.*")


def rejects(lines: DataFrame, shown: int = 5) -> DataFrame:
    """The first bad lines of each file, without their values: (file, line_order, length)."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("file").orderBy("line_order"))
    return lines.where("bad").withColumn("n", n).where(F.col("n") <= shown).select("file", "line_order", F.length("line").alias("length"))


def write_records(records: DataFrame, path: str, overwrite: bool = False) -> None:
    """Compact JSON lines with explicit nulls; nothing is written for an empty table, nor over an existing one unless told."""
    if records.isEmpty():
        raise ValueError("no rows to write")
    lines = records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(path)
