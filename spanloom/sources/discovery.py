"""Sources whose columns are not known before: which of them hold the text, the spans and the language, told as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names by which the parts of a record go, in order of preference.
CANDIDATES = {
    "text": ("generated_text", "text", "document", "content", "message", "sample"),
    "spans": ("pii_spans", "entities", "annotations", "pii", "entity_list", "labels"),
    "language": ("language", "lang", "locale"),
    "record_id": ("index", "id", "record_id", "level_0"),
}


def _plain(name: str) -> str:
    return "".join(c for c in name.casefold() if c.isalnum())


def resolve(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """The first candidate that is a column as it stands, else the first that is one without case and separators."""
    for c in candidates:
        if c in columns:
            return c
    plain = {_plain(c): c for c in reversed(columns)}
    return next((plain[_plain(c)] for c in candidates if _plain(c) in plain), None)


def inspect(rows: DataFrame) -> DataFrame:
    """(part, column, type, problem): one row for each part of a record; nothing is guessed and no value is shown."""
    types = dict(rows.dtypes)
    told = []
    for part, names in CANDIDATES.items():
        column = resolve(rows.columns, names)
        told.append((part, column, types.get(column), None if column else f"none of {', '.join(names)}"))
    return rows.sparkSession.createDataFrame(told, "part string, column string, type string, problem string")


def value_types(rows: DataFrame) -> DataFrame:
    """(column, type, length) of the first row, without its values."""
    first = rows.limit(1)
    return first.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.length(F.to_json(F.struct(F.col(f"`{c}`")))).alias("length")) for c, t in rows.dtypes])).alias("x")).select("x.*")


def load(spark: SparkSession, path: str, languages: tuple[str, ...] | None = None, most: int | None = None) -> DataFrame:
    """(record_id, text, raw_spans, language) of a Parquet source with discovered columns. languages and most apply in this order: the limit counts matching rows, by record_id."""
    from ..functions.text import language

    if not path.lower().rstrip("/").endswith(".parquet"):
        raise ValueError(f"not a Parquet path: {path}")
    rows = spark.read.parquet(path)
    found = {p: resolve(rows.columns, names) for p, names in CANDIDATES.items()}
    missing = [p for p in ("text", "spans") if not found[p]]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    raw = F.col(f"`{found['spans']}`")
    raw = raw if dict(rows.dtypes)[found["spans"]] == "string" else F.to_json(raw)
    out = rows.select(
        (F.col(f"`{found['record_id']}`").cast("string") if found["record_id"] else F.sha2(F.col(f"`{found['text']}`"), 256)).alias("record_id"), F.col(f"`{found['text']}`").alias("text"), raw.alias("raw_spans"),
        (language(F.col(f"`{found['language']}`")) if found["language"] else F.lit(None).cast("string")).alias("language"),
    )
    if languages and "*" not in languages:
        out = out.where(F.col("language").isin(*languages))
    return out.orderBy("record_id").limit(most) if most is not None else out
