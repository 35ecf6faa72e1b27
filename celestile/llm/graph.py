"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestile.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``(src, dst)`` links of any orderable type -> ``(node, root)``: the smallest
    node that can be reached. Nodes without a link to another node are absent, so
    callers left-join; links with a null end or to themselves are ignored.

    Each round costs two equi-joins on columns of node ids. The minima are written
    before they are joined, so both join sides are plain exchanges and AQE can
    split the partition of a hub node. Only a count and a sum of hashes reach the
    driver.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = scratch.save(e, "links")
    mark = _mark(now)
    for _ in range(max_rounds if mark[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m")), "large")
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        big = scratch.save(big, "big")
        least = scratch.save(big.groupBy("u").agg(F.min("v").alias("m")), "small")
        hung = big.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        for old in (low, big, least, now):
            scratch.drop(old)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
