"""Filling containers of fixed capacity with documents measured in tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import cut
from .differencing import pack
from .tokens import BYTE_BPE_50K, count_tokens

CAPACITY = 2048
#: Pieces that are differenced together: bounds a task, while the last container of each such group is all that grouping can cost.
GROUP_PIECES = 2000


def pack_sizes(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(key, piece_index, token_start, token_end, container_id): one row for each piece of each row of `sizes`.

    Only rows over capacity are split, into full containers and a rest. Rows without size (null, 0 or less) take no room and
    come out with piece_index 0, an empty range and a null container. Equal keys are separate items. An empty table gives none.
    Groups are by a hash of the row's number, so a hot key cannot fill one.
    """
    items = cut(sizes.select(F.col(key).alias("item_key"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("n")))
    pieces = items.withColumn("row", F.monotonically_increasing_id()).select(
        "item_key", "row", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece_index")
    )
    pieces = pieces.select("item_key", "row", "piece_index", (F.col("piece_index") * F.lit(capacity).cast("bigint")).alias("token_start"), F.least("n", (F.col("piece_index") + 1) * F.lit(capacity).cast("bigint")).alias("token_end"))
    count = items.agg(F.sum(F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)))).first()[0] or 0
    groups = max(1, -(-int(count) // group_pieces))
    kind = sizes.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row", "piece_index"], kind="stable").reset_index(drop=True)
        n = (group.token_end - group.token_start).to_numpy()
        used = np.flatnonzero(n > 0)
        container = np.full(len(n), -1, np.int64)
        container[used] = pack(n[used], capacity)
        ids = pd.array(container + int(group["pack_group"].iloc[0]) * (1 << 24), dtype="Int64")
        ids[container < 0] = pd.NA
        out = group[["item_key", "piece_index", "token_start", "token_end"]].copy()
        out["container_id"] = ids
        return out

    grouped = pieces.withColumn("pack_group", F.pmod(F.xxhash64("row", "piece_index"), F.lit(groups))).repartition(min(groups, 10_000), "pack_group")
    return grouped.groupBy("pack_group").applyInPandas(run, f"item_key {kind}, piece_index int, token_start bigint, token_end bigint, container_id bigint").withColumnRenamed("item_key", key)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ranks_path: str = BYTE_BPE_50K) -> DataFrame:
    """pack_sizes over the numbers of tokens of the texts; null and empty texts take no room."""
    return pack_sizes(count_tokens(docs, key, text, ranks_path), key, "n_tokens", capacity)
