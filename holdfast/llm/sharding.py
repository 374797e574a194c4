"""Jump consistent hashing of stable keys to shards.

The shard of a key is a function of the key and the shard count alone; there is no ring table.
Going from n to n + 1 shards moves a key either nowhere or to the new shard, about 1 in n + 1.

Slots number the rows of a shard from 0 in key order without any task that sees a whole shard:
rows are dealt by range of the key, numbered within (range, shard), and each such group is moved
up by the count of the groups before it.

Defined results: a null id hashes like a value of its own, the same for every such row, and comes
first; rows with one id share its shard and are ordered by text checksum and size; null text has size 1
and the checksum of no bytes; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, spill

SHARDS = 8
_STEP = np.uint64(2862933555777941757)


def mix(keys: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that keys in sequence start the generator far apart."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys, all keys a step at a time."""
    state = keys.astype(np.uint64).copy()
    at = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    jump = np.zeros(len(state), dtype=np.int64)
    while len(live):
        at[live] = jump[live]
        state[live] = state[live] * _STEP + np.uint64(1)
        step = (at[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))
        jump[live] = step.astype(np.int64)
        live = live[jump[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a whole-number key column; null is a key of its own."""

    @F.pandas_udf("int")
    def run(keys: pd.Series, missing: pd.Series) -> pd.Series:
        hashed = mix(keys.to_numpy(dtype=np.int64).view(np.uint64))
        hashed[missing.to_numpy(dtype=bool)] = np.uint64(0x5851F42D4C957F2D)
        return pd.Series(jump_hash(hashed, shards), dtype="int32")

    return run(F.coalesce(key.cast("long"), F.lit(0).cast("long")), key.isNull())


def assign_shards(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row a document: its key, size, text_crc32, shard, slot and the shard if one is added."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(key_col).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.repartitionByRange("key", "text_crc32", "size").withColumn("range", F.spark_partition_id())
    rows, _ = spill(rows.withColumns({"shard": shard_of(F.col("key"), shards), "grown_shard": shard_of(F.col("key"), shards + 1)}), "shards")
    counts = rows.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("shard", "range").orderBy("key", "text_crc32", "size")
    return rows.withColumn("place", F.row_number().over(local) - 1).join(bases, ["shard", "range"]).select("key", "size", "text_crc32", "shard", (F.col("base") + F.col("place")).alias("slot"), "grown_shard")


def op8(spark, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of every document by its id."""
    out = assign_shards(documents(spark, sf_dir))
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
