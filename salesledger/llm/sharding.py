"""Shards by jump consistent hashing: a stable key and the number of shards decide, no table is kept.

Law: ``key``. When a shard is added, a key either stays or moves to the new shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger.llm.columns import fresh

BLOCKS = 256
"""Parts of a shard that are numbered on their own; one holds 1 / (shards * BLOCKS) of the rows."""


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key. A key jumps ahead through the shard counts at which it would move."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    at, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        at[moving] = ahead[moving]
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[moving] = ((at[moving] + 1) * (2.0**31 / draw)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return at


def shards_of(shards: int, *keys: str) -> Column:
    """Struct of ``shard`` and, with one shard more, ``grown_shard`` of the columns named ``keys``; see ``shard_of``."""
    if shards < 1:
        raise ValueError("there is at least one shard")

    @F.arrow_udf("shard int, grown_shard int")
    def both(key: pa.Array) -> pa.Array:
        hashes = key.to_numpy(zero_copy_only=False)
        now, grown = (pa.array(jump(hashes, n).astype(np.int32)) for n in (shards, shards + 1))
        return pa.StructArray.from_arrays([now, grown], ["shard", "grown_shard"])

    return both.asNondeterministic()(F.xxhash64(*keys))


def shard_of(shards: int, *keys: str) -> Column:
    """Shard of the columns named ``keys``, of any type; nulls are a value of their own."""
    if shards < 1:
        raise ValueError("there is at least one shard")

    @F.arrow_udf("int")
    def shard(key: pa.Array) -> pa.Array:
        return pa.array(jump(key.to_numpy(zero_copy_only=False), shards).astype(np.int32))

    # Said not to repeat, so that Spark makes no second call, and Python worker, for a filter on its result.
    return shard.asNondeterministic()(F.xxhash64(*keys))


def with_shards(docs: DataFrame, shards: int, key: str = "doc_id", blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with ``shard``, ``grown_shard`` (with one shard more) and ``slot``, gapless from 0 within the shard.

    A shard's rows are numbered in blocks of keys by another hash of the key: the rows of each block are counted from the key
    column alone, running sums over the few thousand blocks give their first slots, and rows are ordered
    inside blocks only. Rows that repeat a key share shard and block and get different slots, in the order of ``text_crc32`` and
    ``size`` where there are such columns, so rows of one key and other texts keep theirs; null is a key. Other columns pass
    through; existing columns of these names are replaced.
    """
    ties = [c for c in ("text_crc32", "size") if c in docs.columns]
    names = [c for c in docs.columns if c not in ("shard", "grown_shard", "slot")]
    part, first_slot = fresh("block", names), fresh("first", names)
    block = F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.lit(blocks)).cast("int")
    counts = docs.select(shard_of(shards, key).alias("shard"), block.alias(part)).groupBy("shard", part).count()
    # At most shards * blocks rows, whatever the input.
    first = counts.selectExpr(
        "shard", part, f"sum(count) OVER (PARTITION BY shard ORDER BY {part}) - count AS {first_slot}"
    )
    both = fresh("both", names)
    placed = docs.select(*names, shards_of(shards, key).alias(both), block.alias(part))
    placed = placed.select(*names, part, f"{both}.shard", f"{both}.grown_shard")
    placed = placed.join(F.broadcast(first), ["shard", part])
    numbered = placed.withColumn(
        "slot", F.expr(f"{first_slot} + row_number() OVER (PARTITION BY shard, {part} ORDER BY {', '.join([key, *ties])}) - 1")
    )
    return numbered.select(*names, "shard", "slot", "grown_shard")


def sizes(docs: DataFrame) -> DataFrame:
    """Columns doc_id, size (UTF-8 bytes of the text plus 1) and text_crc32 of each row; a null text has 0 bytes, no CRC."""
    return docs.selectExpr(
        "doc_id",
        "CAST(coalesce(octet_length(CAST(text AS STRING)), 0) + 1 AS BIGINT) AS size",
        "crc32(CAST(CAST(text AS STRING) AS BINARY)) AS text_crc32",
    )
