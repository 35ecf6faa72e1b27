"""Shards by jump consistent hashing (operator 6).

The shard of a row follows from its key and the number of shards alone: no ring
table, and of ``n`` keys only about ``n / (shards + 1)`` move when a shard is appended,
all of them into it. Key: the id; other keys are hashed to 64 bits first.

Slots number the rows of a shard from 0 without gaps. A shard is numbered in
``parts`` hashed parts side by side, each after the rows of the parts before it.

Nulls: a null id is the key 0; a null text has size 1 and the crc32 of no bytes. Rows
with one id share a shard and get slots of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from celestile.llm.scratch import Scratch

SHARDS = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's loop over all keys at once: at most ``shards`` rounds, about
    ``ln(shards)`` jumps a key."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    b, j = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while live.size:
        b[live] = j[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        j[live] = ((b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[j[live] < shards]
    return b


def shards_of(key: Column, shards: int) -> Column:
    """A struct of the ``shard`` of each key, and ``grown_shard`` with one shard more."""

    @F.pandas_udf("shard int, grown_shard int")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for k in parts:
            keys = k.to_numpy(np.int64)
            yield pd.DataFrame({"shard": jump(keys, shards).astype(np.int32), "grown_shard": jump(keys, shards + 1).astype(np.int32)})

    return of(F.coalesce(key.cast("long"), F.lit(0)))


def with_slots(rows: DataFrame, scratch: Scratch, order: list[str], parts: int) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each ``shard``."""
    cut = scratch.save(rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")), "cut")
    sums = cut.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("shard", "_part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_before"))  # shards * parts rows
    own = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*order))
    out = cut.withColumn("_own", own).join(F.broadcast(before), ["shard", "_part"])
    return out.withColumn("slot", (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_part", "_before", "_own")


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows = rows.withColumn("to", shards_of(F.col("doc_id"), shards)).select("doc_id", "size", "text_crc32", "to.shard", "to.grown_shard")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    out = with_slots(rows, scratch, ["doc_id", "text_crc32", "size"], parts)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
