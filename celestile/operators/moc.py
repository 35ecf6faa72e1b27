"""Coverage as sets of disjoint order-29 ranges ``(lo BIGINT, hi BIGINT)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from celestile.functions import healpix as hp
from celestile.operators import cells as C

#: Ranges are merged within blocks of this order, then across their edges.
BLOCK_ORDER = 4
_SHIFT = 2 * (hp.MAX_ORDER - BLOCK_ORDER)


def _islands(ranges: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
    return marked.withColumn("_island", F.sum("_new").over(w)).groupBy(*by, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def normalise(ranges: DataFrame) -> DataFrame:
    """Touching and overlapping ranges merged. The ranges are cut at block edges and merged
    in each block; only those that meet an edge, two a block at most, are merged once
    more in one task."""
    block = F.explode(F.sequence(F.shiftright("lo", _SHIFT), F.shiftright(F.col("hi") - 1, _SHIFT)))
    cut = ranges.where("lo < hi").withColumn("_block", block)
    cut = cut.select("_block", F.greatest("lo", F.shiftleft("_block", _SHIFT)).alias("lo"), F.least("hi", F.shiftleft(F.col("_block") + 1, _SHIFT)).alias("hi"))
    merged = _islands(cut, ["_block"])
    edge = (F.col("lo") == F.shiftleft("_block", _SHIFT)) | (F.col("hi") == F.shiftleft(F.col("_block") + 1, _SHIFT))
    across = _islands(merged.where(edge).select(F.lit(0).alias("_all"), "lo", "hi"), ["_all"])
    return merged.where(~edge).select("lo", "hi").unionByName(across.select("lo", "hi"))


def from_cells(cells: DataFrame) -> DataFrame:
    return normalise(C.with_bounds(cells).select("lo", "hi"))


def from_counts(counts: DataFrame, order: int) -> DataFrame:
    """The coverage of a point map ``(pix, n)``: cells with any rows."""
    return from_cells(counts.where("n <> 0").select(F.lit(order).alias("Norder"), F.col("pix").alias("Npix")))


def to_cells(ranges: DataFrame) -> DataFrame:
    """The fewest cells that make up the ranges: at each order those within a range whose
    parent isn't, at most three at either end."""
    o = F.explode(F.sequence(F.lit(0), F.lit(hp.MAX_ORDER)))
    r = ranges.where("lo < hi").withColumn("Norder", o).withColumn("_s", (F.lit(hp.MAX_ORDER) - F.col("Norder")) * 2)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_s"))
    r = r.withColumns({"_a": F.call_function("shiftright", F.col("lo") + one - 1, F.col("_s")), "_b": F.call_function("shiftright", F.col("hi"), F.col("_s"))})
    up = F.call_function("shiftleft", F.lit(4).cast("long"), F.col("_s"))
    pa, pb = F.call_function("shiftright", F.col("lo") + up - 1, F.col("_s") + 2) * 4, F.call_function("shiftright", F.col("hi"), F.col("_s") + 2) * 4
    first = F.col("Norder") == 0
    r = r.withColumns({"_pa": F.when(first, F.col("_b")).otherwise(pa), "_pb": F.when(first, F.col("_b")).otherwise(pb)})
    empty = F.array().cast("array<bigint>")
    span = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(empty)
    none = F.col("_pa") >= F.col("_pb")  # no whole parent within
    pix = F.when(none, span(F.col("_a"), F.col("_b"))).otherwise(F.concat(span(F.col("_a"), F.col("_pa")), span(F.col("_pb"), F.col("_b"))))
    return r.select(F.col("Norder").cast("int").alias("Norder"), F.explode(pix).alias("Npix"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return normalise(a.select("lo", "hi").unionByName(b.select("lo", "hi")))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two cells that share sky the smaller is what they share."""
    pairs = C.overlapping_pairs(to_cells(a), to_cells(b))
    deeper = F.col("l_order") >= F.col("r_order")
    return from_cells(pairs.select(F.when(deeper, F.col("l_order")).otherwise(F.col("r_order")).alias("Norder"), F.when(deeper, F.col("l_pix")).otherwise(F.col("r_pix")).alias("Npix")))


def flatten(ranges: DataFrame, order: int) -> DataFrame:
    """All cells of an order that the ranges touch."""
    s = 2 * (hp.MAX_ORDER - order)
    return ranges.select(F.lit(order).alias("Norder"), F.explode(F.sequence(F.shiftright("lo", s), F.shiftright(F.col("hi") - 1, s))).alias("Npix")).distinct()


def grow(ranges: DataFrame, order: int) -> DataFrame:
    """The ranges and all neighbours, at an order, of the cells they touch."""
    own = flatten(ranges, order)
    near = hp.with_neighbours(own, "Npix", order).select("Norder", F.explode("neighbours").alias("Npix")).where("Npix is not null")
    return from_cells(own.unionByName(near))


def filter_cells(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """The cells that share sky with the ranges."""
    return C.overlapping(cells, to_cells(ranges))
