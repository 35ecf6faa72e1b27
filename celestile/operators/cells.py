"""Sets of cells as DataFrames ``(Norder INT, Npix BIGINT)``.

Cells of mixed orders are compared by their order-29 interval ``[lo, hi)``, or by
equality with the ancestors of the deeper one, which keeps every join an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from celestile.functions import healpix as hp
from celestile.functions.pixel import as_pixel

CELL = "Norder INT, Npix BIGINT"


def from_pixels(spark: SparkSession, pixels: list) -> DataFrame:
    """A short list of (order, pixel) as a DataFrame."""
    return spark.createDataFrame([tuple(as_pixel(tuple(p))) for p in pixels], CELL)


def of_index(df: DataFrame, index: str, order: int) -> DataFrame:
    return df.select(F.lit(order).alias("Norder"), hp.to_order(F.col(index), order).alias("Npix")).distinct()


def with_bounds(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"lo": hp.first29(F.col("Norder"), F.col("Npix")), "hi": hp.past29(F.col("Norder"), F.col("Npix"))})


def nested_order(cells: DataFrame) -> DataFrame:
    """Sorted along the nested curve; of overlapping cells the larger first."""
    return cells.orderBy(hp.first29(F.col("Norder"), F.col("Npix")), "Norder")


def nested_rank(cells: DataFrame, block_order: int = 4) -> DataFrame:
    """Adds ``rank``, the place along the nested curve from 0. Ranked within blocks of the
    sky; the blocks' sizes (12 * 4^block_order of them at most) are summed up."""
    lo = hp.first29(F.col("Norder"), F.col("Npix"))
    c = cells.withColumns({"_lo": lo, "_block": F.shiftright(lo, 2 * (hp.MAX_ORDER - block_order))})
    sizes = c.groupBy("_block").agg(F.count("*").alias("n"))
    before = sizes.select("_block", F.coalesce(F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy("_lo", "Norder"))
    return c.withColumn("_own", own).join(F.broadcast(before), "_block").withColumn("rank", F.col("_before") + F.col("_own") - 1).drop("_lo", "_block", "_own", "_before")


def ancestors(cells: DataFrame, lowest: int | Column = 0, strict: bool = False, order: str = "a_order", pixel: str = "a_pix") -> DataFrame:
    """Each cell with each of its ancestors (itself too unless ``strict``)."""
    top = F.col("Norder") - 1 if strict else F.col("Norder")
    rows = cells.where(F.col("Norder") > lowest) if strict else cells
    return rows.withColumn(order, F.explode(F.sequence(F.lit(lowest) if isinstance(lowest, int) else lowest, top))).withColumn(pixel, hp.ancestor(F.col("Npix"), F.col("Norder") - F.col(order)))


def lower(cells: DataFrame, steps: int) -> DataFrame:
    """The ancestor ``steps`` orders up. Fails for cells that have none."""
    if steps < 0:
        raise ValueError("steps must not be negative")
    o = F.when(F.col("Norder") >= steps, F.col("Norder") - steps).otherwise(F.raise_error(F.lit("no cell so far up")).cast("int"))
    return cells.withColumns({"Norder": o, "Npix": F.shiftright("Npix", 2 * steps)})


def descendants(cells: DataFrame, steps: int) -> DataFrame:
    """All cells ``steps`` orders down; of the whole sky, order -1, the base cells first."""
    if steps < 0:
        raise ValueError("steps must not be negative")
    whole = F.col("Norder") < 0
    n = F.when(whole, F.lit(12 << 2 * max(steps - 1, 0))).otherwise(F.lit(1 << 2 * steps))
    first = F.when(whole, F.lit(0)).otherwise(F.shiftleft("Npix", 2 * steps))
    fits = F.col("Norder") + steps <= hp.MAX_ORDER
    below = F.when(fits, F.sequence(first.cast("long"), (first + n - 1).cast("long"))).otherwise(F.raise_error(F.lit("orders end at 29")).cast("array<bigint>"))
    return cells.select((F.col("Norder") + steps).alias("Norder"), F.explode(below).alias("Npix")) if steps else cells


def overlapping_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(l_order, l_pix, r_order, r_pix)`` of all cells that share sky: of two such cells
    one is the other or an ancestor of it."""
    r = ancestors(right).select("a_order", "a_pix", F.col("Norder").alias("r_order"), F.col("Npix").alias("r_pix"))
    l_ = left.select(F.col("Norder").alias("l_order"), F.col("Npix").alias("l_pix"))
    down = r.join(l_, (F.col("a_order") == F.col("l_order")) & (F.col("a_pix") == F.col("l_pix"))).select("l_order", "l_pix", "r_order", "r_pix")
    la = ancestors(left, strict=True).select("a_order", "a_pix", F.col("Norder").alias("l_order"), F.col("Npix").alias("l_pix"))
    r_ = right.select(F.col("Norder").alias("r_order"), F.col("Npix").alias("r_pix"))
    up = la.join(r_, (F.col("a_order") == F.col("r_order")) & (F.col("a_pix") == F.col("r_pix"))).select("l_order", "l_pix", "r_order", "r_pix")
    return down.unionByName(up)


def overlapping(cells: DataFrame, others: DataFrame) -> DataFrame:
    """The cells that share sky with any of the others, with all their columns."""
    hit = overlapping_pairs(cells.select("Norder", "Npix"), others.select("Norder", "Npix")).select(F.col("l_order").alias("Norder"), F.col("l_pix").alias("Npix")).distinct()
    return cells.join(hit, ["Norder", "Npix"], "left_semi")


def contains(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``contained``: whether the very cell is in the set."""
    return wanted.join(cells.select("Norder", "Npix", F.lit(True).alias("_in")).distinct(), ["Norder", "Npix"], "left").withColumn("contained", F.coalesce("_in", F.lit(False))).drop("_in")


def overlaps_within(cells: DataFrame) -> DataFrame:
    """Pairs of different rows of one set that share sky, repeated cells included; a tree has none."""
    twice = cells.groupBy("Norder", "Npix").agg(F.count("*").alias("n")).where("n > 1").select("Norder", "Npix", F.col("Norder").alias("in_order"), F.col("Npix").alias("in_pix"))
    up = ancestors(cells.select("Norder", "Npix").distinct(), strict=True)
    own = cells.select(F.col("Norder").alias("in_order"), F.col("Npix").alias("in_pix")).distinct()
    deep = up.join(own, (F.col("a_order") == F.col("in_order")) & (F.col("a_pix") == F.col("in_pix"))).select("Norder", "Npix", "in_order", "in_pix")
    return twice.unionByName(deep)


def tree(cells: DataFrame) -> DataFrame:
    """The cells, checked: fails if any two share sky."""
    bad = overlaps_within(cells).first()
    if bad:
        raise ValueError(f"cells overlap: order {bad[0]} pixel {bad[1]} lies in order {bad[2]} pixel {bad[3]}")
    return cells


def highest_order(cells: DataFrame) -> DataFrame:
    """One row ``max_order``; null for an empty set."""
    return cells.agg(F.max("Norder").cast("int").alias("max_order"))


def coverage(cells: DataFrame) -> DataFrame:
    """One row ``coverage``: the cells' share of the sky, taken as 41253 square degrees."""
    by = cells.groupBy("Norder").agg(F.count("*").alias("n"))
    area = F.lit(hp.nside2pixarea(1, degrees=True)) / F.pow(F.lit(4.0), F.col("Norder"))
    return by.agg(F.coalesce(F.sum(area * F.col("n")) / hp.SKY_DEGREES, F.lit(0.0)).alias("coverage"))


def base_cells(spark: SparkSession) -> DataFrame:
    return spark.range(12).select(F.lit(0).alias("Norder"), F.col("id").alias("Npix"))


def remainder(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """``(c_order, c_pix, Norder, Npix)``: for each outer cell that holds smaller inner cells,
    the largest cells of what they leave. Around every inner cell these are the siblings
    on the way up that hold no inner cell."""
    up = ancestors(inner.select("Norder", "Npix"), strict=True)
    own = outer.select(F.col("Norder").alias("c_order"), F.col("Npix").alias("c_pix"))
    held = up.join(own, (F.col("a_order") == F.col("c_order")) & (F.col("a_pix") == F.col("c_pix"))).select("c_order", "c_pix", "Norder", "Npix")
    path = held.withColumn("o", F.explode(F.sequence(F.col("c_order") + 1, F.col("Norder")))).select("c_order", "c_pix", "o", hp.ancestor(F.col("Npix"), F.col("Norder") - F.col("o")).alias("p")).distinct()
    parents = path.select("c_order", "c_pix", "o", F.shiftright("p", 2).alias("up")).distinct()
    around = parents.select("c_order", "c_pix", "o", F.explode(F.sequence(F.shiftleft("up", 2), F.shiftleft("up", 2) + 3)).alias("p"))
    return around.join(path, ["c_order", "c_pix", "o", "p"], "left_anti").select("c_order", "c_pix", F.col("o").alias("Norder"), F.col("p").alias("Npix"))


def negative(cells: DataFrame) -> DataFrame:
    """The fewest cells that cover the sky outside of a tree."""
    base = base_cells(cells.sparkSession)
    empty = base.join(ancestors(cells.select("Norder", "Npix")).select(F.col("a_order").alias("Norder"), F.col("a_pix").alias("Npix")).distinct(), ["Norder", "Npix"], "left_anti")
    return empty.unionByName(remainder(base, cells).select("Norder", "Npix"))
