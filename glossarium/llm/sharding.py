"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A shard follows from the key and the number of shards alone: there is no ring
table to store or broadcast, and with one more shard a key either stays or
moves into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, for all keys at once."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = jump[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * _MULTIPLIER + np.uint64(1)
        step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[live] = ((shard[live] + 1) * (2147483648.0 / step)).astype(np.int64)
        live = live[jump[live] < shards]
    return shard.astype(np.int32)


def shard_of(key: F.Column, shards: int) -> F.Column:
    """Column of the shard (int, 0 to shards - 1) of a bigint key; null counts as key 0."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy().astype(np.int64).view(np.uint64), shards))

    return of(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024
) -> DataFrame:
    """Shard, gapless slot and size of every row of docs, under the law ``key``.

    Result: id_col, size (UTF-8 bytes and 1), text_crc32, law, shard, slot,
    grown_shard (the shard if there were one more). Key: id_col, a bigint (or
    the XXH64 of another type). Null text: size 1, CRC of the empty text. Null
    key: shard of key 0. Repeated rows each get a slot of their own; ties are in
    any order. No rows: no rows. Other columns of docs are not used.

    Slots: rows of a shard are ordered by a hash bucket of the key, then by key.
    Only the row counts of shards x buckets are summed in one place, so no task
    has to order a whole shard; the table of offsets is at most
    shards x buckets rows and is broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.typeName()
    key = F.col(id_col) if kind in ("long", "integer", "short", "byte") else F.xxhash64(F.col(id_col))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, shards).alias("shard"),
        shard_of(key, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("__bucket"),
    )
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "__bucket")
        .agg(F.count("*").alias("__n"))
        .select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    within = Window.partitionBy("shard", "__bucket").orderBy(F.col(id_col), "text_crc32", "size")
    return (
        rows.join(F.broadcast(starts), ["shard", "__bucket"])
        .withColumn("slot", (F.col("__start") + F.row_number().over(within) - 1).cast("long"))
        .select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
    )
