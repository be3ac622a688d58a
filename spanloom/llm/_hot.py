"""Keys that several items share, found in one sorted pass, with hot keys spread.

Rows are (key, sid); the low bits of the key are no part of it but tell what the row is. A key that many items of a step share leaves its task as one row that tells a group; the members of the group go by the group's own number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import cut
from ._chars import U64, mix

#: Items of a step from which on a shared key is sent as one row.
TOGETHER = 8
#: Low bits of a key as it is sent: the side, and whether the row is of one item, tells a group, or tells a member of a group.
SIDE, LONE, GROUP, MEMBER, LOW = 1, 0, 2, 4, 7


def grouped(key: np.ndarray, sid: np.ndarray, side: np.ndarray | None) -> pa.RecordBatch:
    """Rows (key, sid) with the low bits of the key as above. Of a key that TOGETHER items of the step and more share there is one row, which tells a group; the members of
    the group are rows with the group's number for a key."""
    key = (key.view(U64) & ~U64(LOW)) | (U64(0) if side is None else side.astype(U64))
    sid = sid.view(U64)
    order = np.argsort(key)
    key, sid = key[order], sid[order]
    edge = np.flatnonzero(np.concatenate((np.ones(1, bool), key[1:] != key[:-1])))
    many = np.diff(edge, append=len(key))
    hot = many >= TOGETHER
    if not hot.any():
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sid.view(np.int64))], names=["key", "sid"])
    within = np.repeat(hot, many)
    number = mix(key[edge[hot]] + mix(sid[edge[hot]]))
    keys = (key[~within], key[edge[hot]] | U64(GROUP), np.repeat((number & ~U64(LOW)) | U64(MEMBER), many[hot]))
    sids = (sid[~within], number, sid[within])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, sids)], names=["key", "sid"])


def _shared(batches: Iterator[pa.RecordBatch], sides: bool) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key and sid those whose key, but for the low bits, another item (with `sides`: one of the other side) has too, groups that have their key alone, and all members."""
    held_key, held_sid = np.zeros(0, U64), np.zeros(0, U64)

    def told(key: np.ndarray, sid: np.ndarray) -> pa.RecordBatch:
        own = key >> U64(3)
        edge = np.flatnonzero(np.concatenate((np.ones(1, bool), own[1:] != own[:-1])))
        many = np.diff(edge, append=len(key))
        member = (key & U64(MEMBER)) > 0
        if sides:
            one = np.maximum.reduceat((key & U64(SIDE)).astype(np.uint8), edge) > np.minimum.reduceat((key & U64(SIDE)).astype(np.uint8), edge)
        else:
            one = (np.maximum.reduceat(sid, edge) != np.minimum.reduceat(sid, edge)) | (np.maximum.reduceat((key & U64(GROUP)).astype(np.uint8), edge) > 0)
        keep = np.repeat(one, many) | member
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        keep &= new
        return pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(sid[keep].view(np.int64))], names=["key", "sid"])

    for batch in batches:
        key = np.concatenate((held_key, batch.column(0).to_numpy().view(U64)))
        sid = np.concatenate((held_sid, batch.column(1).to_numpy().view(U64)))
        if not len(key):
            continue
        # the last key may go on in the next batch; of a hot key there is a row a step only
        cut_ = int(np.flatnonzero((key >> U64(3)) == (key[-1] >> U64(3)))[0]) if (key[0] >> U64(3)) != (key[-1] >> U64(3)) else 0
        if cut_:
            yield told(key[:cut_], sid[:cut_])
        held_key, held_sid = key[cut_:], sid[cut_:]
    if len(held_key):
        yield told(held_key, held_sid)


def shared_rows(sent: DataFrame, sides: bool = False) -> DataFrame:
    """(key, sid[, side]) of the rows sent as by grouped: the items of each key (its upper 61 bits, as a signed number) that more than one item has; with sides, that items of both sides have. Computed once."""
    upper = F.shiftright("key", 3)
    # rows are sent by the upper bits and ordered by all
    kept = cut(sent.repartition(upper).sortWithinPartitions("key", "sid").mapInArrow(partial(_shared, sides=sides), "key bigint, sid bigint"))
    kind = F.col("key").bitwiseAND(LOW - SIDE)
    told = lambda d: d.select(upper.alias("key"), "sid", (F.col("key").bitwiseAND(SIDE) == SIDE).alias("side"))
    groups = told(kept.where(kind == GROUP)).withColumnRenamed("sid", "number").withColumn("number", F.shiftright("number", 3))
    members = kept.where(kind == MEMBER).select(upper.alias("number"), "sid")
    out = told(kept.where(kind == LONE)).unionByName(groups.join(members, "number").select("key", "sid", "side"))
    return out if sides else out.select("key", "sid")
