"""Sharding by jump consistent hashing.

`jump_hash` maps a 64-bit key to one of n shards without a ring table (Lamping and Veach, 2014): appending a shard moves about one
key in n + 1, and only into the new shard. The key is a hash of the row's stable key, so the shard depends on that key and the
number of shards alone: law `key`.

Defined results: a null text has size 1 and crc32 0; a null key is one key like any other; rows with equal keys share a shard; an empty
table gives an empty result; extra columns pass through unless they clash with a result column, in any case of letters. Slots go by
hashed key, size and checksum, so the texts of a key that a third of all rows has are dealt over all buckets of its shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtally.llm.shared import pack, quoted, unpack, written

SHARDS = 8
BUCKET_ROWS = 20_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """keys: uint64. All keys jump together; those whose next jump is beyond the last shard drop out."""
    key, out = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    going, j = np.arange(len(keys)), np.zeros(len(keys), np.float64)
    while len(going):
        out[going] = j.astype(np.int64)
        key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[going] >> np.uint64(33)).astype(np.float64) + 1.0)
        j = np.floor((out[going] + 1) * step)
        stay = j < shards
        going, j = going[stay], j[stay]
    return out


def shard_udf(shards: int):
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard. Only keys, sizes and checksums are shuffled, never texts."""
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    own, row = pack(df, (*added, text))
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    light = df.select(
        *row,
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.xxhash64(F.col(quoted(key))).alias("_h"),
    )
    light = light.withColumn("shard", shard_udf(shards)(F.col("_h"))).withColumn("grown_shard", shard_udf(shards + 1)(F.col("_h")))
    # Slots: a shard's rows are numbered bucket by bucket, so that no task sorts a whole shard.
    light = written(light, "shards")
    rows = light.count()
    buckets = max(1, -(-rows // (shards * BUCKET_ROWS)), min(64, rows // 512))
    light = light.withColumn("_b", F.pmod(F.xxhash64(F.lit(7), F.col("_h"), "size", "text_crc32"), F.lit(buckets)).cast("int"))
    sums = light.groupBy("shard", "_b").agg(F.count("*").alias("n"))
    offsets = sums.withColumn("_from", F.sum("n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("n")).drop("n")
    inside = Window.partitionBy("shard", "_b").orderBy("_h", "text_crc32", "size")
    numbered = light.withColumn("_r", F.row_number().over(inside) - 1)
    out = numbered.join(offsets, ["shard", "_b"])
    return out.select(*unpack(own), "size", "text_crc32", "law", "shard", (F.col("_from") + F.col("_r")).cast("long").alias("slot"), "grown_shard")
