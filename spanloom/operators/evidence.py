"""Frozen evidence: hashes of files, manifests, write-once receipts."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that are in memory at once.
CHUNK = 8 << 20


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path in batch.column(0).to_pylist():
            h = hashlib.sha256()
            system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + unquote(path.removeprefix("file:")))
            with system.open_input_stream(inner) as f:
                while piece := f.read(CHUNK):
                    h.update(piece)
            digests.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string())], names=["path", "bytes", "sha256"])


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder, hashed where it lies: one task a file, in pieces of CHUNK bytes, so a file may have any size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))
    return files.repartition("path").mapInArrow(_hashed, "path string, bytes bigint, sha256 string")


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state): same, changed, missing or extra."""
    j = expected.alias("e").join(actual.alias("a"), "path", "full_outer")
    state = F.when(F.col("a.sha256").isNull(), "missing").when(F.col("e.sha256").isNull(), "extra").when((F.col("e.sha256") == F.col("a.sha256")) & (F.col("e.bytes") == F.col("a.bytes")), "same").otherwise("changed")
    return j.select("path", state.alias("state"))


def fingerprint(entries: dict[str, str]) -> str:
    """SHA-256 of the sorted path -> hash object as compact JSON."""
    return hashlib.sha256(json.dumps(dict(sorted(entries.items())), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def jsonl_sha256(records: DataFrame, order: str, text: str) -> str:
    """SHA-256 of the lines in order, each with its line end, as of a file. A hash of one file is made in order, so lines stream through the driver: meant for a file that is
    written as one. lines_sha256 is for tables of any size."""
    h = hashlib.sha256()
    for row in records.orderBy(order).select(text).toLocalIterator():
        h.update(row[0].encode() + b"\n")
    return h.hexdigest()


def lines_sha256(records: DataFrame, order: str, text: str) -> str:
    """SHA-256 over a whole table in any order and partitioning, without the rows passing the driver: the sum modulo 2**256 of the SHA-256 of each (order, text), with the number of rows.
    Equal tables have equal hashes; order must be unique for rows to keep their places."""
    parts = [F.conv(F.substring(F.sha2(F.to_json(F.struct(order, text)), 256), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    row = records.agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"p{i}") for i, p in enumerate(parts)]).first()
    total = sum(int(row[f"p{i}"] or 0) << (32 * (7 - i)) for i in range(8)) % (1 << 256)
    return hashlib.sha256(f"{row.n}:{total:064x}".encode()).hexdigest()


def _put(path: str, text: str, mode: str) -> None:
    with open(path, mode, encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())


def atomic_text(path: str, text: str) -> None:
    """Replaces a file whole; a stale temporary file is refused."""
    _put(path + ".tmp", text, "x")
    os.replace(path + ".tmp", path)


def atomic_json(path: str, value: Any) -> None:
    atomic_text(path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def receipt(path: str, value: Any) -> None:
    """Written once; an existing one is an error."""
    _put(path, json.dumps(value, indent=2, sort_keys=True) + "\n", "x")


def guard_absent(*paths: str) -> None:
    there = [p for p in paths if os.path.exists(p)]
    if there:
        raise FileExistsError(f"exists already: {', '.join(sorted(there))}")


def side_car(path: str) -> str:
    """Writes `hash  name` beside the file and gives the hash."""
    with open(path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    atomic_text(path + ".sha256", f"{digest}  {os.path.basename(path)}\n")
    return digest


def read_side_car(path: str, name: str) -> str:
    with open(path, encoding="utf-8") as f:
        digest, _, told = f.read().rstrip("\n").partition("  ")
    if told != name or len(digest) != 64 or set(digest) - set("0123456789abcdef"):
        raise ValueError(f"not a hash of {name}: {path}")
    return digest
