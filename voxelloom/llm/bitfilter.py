"""A blocked Bloom filter over 64-bit keys, of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# One block is 512 bits, eight words of 64; a key sets one bit in each word of its block.
WORDS = 8
BITS_PER_KEY = 16
# The filter never exceeds this; more keys only make it pass more to the exact step that follows.
MAX_FILTER_BYTES = 8 << 20


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def filter_blocks(n: int) -> int:
    """Blocks of a filter for ``n`` keys, bounded."""
    return int(max(1, min(-(-n * BITS_PER_KEY // (64 * WORDS)), MAX_FILTER_BYTES // (8 * WORDS))))


def filter_rows(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0, ..., w7) of the blocks that hold a key."""
    h, bits = key_hashes(F.col(key))
    masks = [F.expr(f"shiftleft(1L, cast(shiftright(bits, {6 * i}) & 63 as int))").alias(f"w{i}") for i in range(WORDS)]
    return (
        keys.select(F.pmod(h, F.lit(blocks)).cast("int").alias("block"), bits.alias("bits"))
        .select("block", *masks)
        .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    )


def build_filter(keys: DataFrame, key: str, n: int) -> np.ndarray:
    """The bits of all keys, as blocks of eight words."""
    blocks = filter_blocks(n)
    table = np.zeros((blocks, WORDS), np.int64)
    for r in filter_rows(keys, key, blocks).collect():
        table[r[0]] = r[1:]
    return table.view(np.uint64)


def with_may(rows: DataFrame, keys: DataFrame, key: str, of: str) -> DataFrame:
    """``rows`` with ``may``: whether column ``of`` may be among the column ``key`` of ``keys``.

    The filter's blocks are a table of bounded size that is broadcast, so the
    bits are looked up in the JVM and a task needs no Python worker for it.
    """
    blocks = filter_blocks(keys.count())
    table = F.broadcast(materialize(filter_rows(keys, key, blocks)).withColumnRenamed("block", "of_block"))
    h, bits = key_hashes(F.col(of))
    asked = rows.withColumn("in_block", F.pmod(h, F.lit(blocks)).cast("int")).withColumn("bits", bits)
    held = " and ".join(f"shiftright(w{i}, cast(shiftright(bits, {6 * i}) & 63 as int)) & 1 = 1" for i in range(WORDS))
    return (
        asked.join(table, F.col("in_block") == F.col("of_block"), "left")
        .withColumn("may", F.expr(f"coalesce({held}, false)"))
        .drop("in_block", "of_block", "bits", *[f"w{i}" for i in range(WORDS)])
    )


def may_hold(table: np.ndarray, h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether all eight bits of each key are set."""
    block = table[np.mod(h, len(table))]
    place = (bits.view(np.uint64)[:, None] >> (np.arange(WORDS, dtype=np.uint64) * np.uint64(6))) & np.uint64(63)
    return ((block >> place) & np.uint64(1)).all(axis=1)


def in_filter(table, key: Column) -> Column:
    """Whether a row's key may be among the filter's; ``table`` is the broadcast filter."""

    @F.pandas_udf("boolean")
    def held(h: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series(may_hold(table.value, h.to_numpy(np.int64), bits.to_numpy(np.int64)))

    return held(*key_hashes(key))


def drop_ids(rows: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``rows`` without those whose id is in the first column of ``gone``; rows surely not in it are not moved."""
    ids = materialize(gone.select(F.col(gone.columns[0]).alias("gone_id")).distinct())
    # A row stays in one column, so its names meet no others.
    marked = with_may(rows.select(F.struct("*").alias("row"), F.col(id_col).alias("id")), ids, "gone_id", "id")
    left = marked.where("may").join(ids, F.col("id") == F.col("gone_id"), "left_anti")
    return marked.where("not may").unionByName(left).select("row.*")
