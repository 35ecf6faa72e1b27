"""Density histograms and adaptive partitions of the sky."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestile.functions import healpix as hp


def histogram(df: DataFrame, order: int, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """``(pix, n)`` of the cells that hold rows: a partial count, one exchange of cells."""
    if missing := {ra, dec} - set(df.columns):
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    return hp.with_pixel(df.select(ra, dec), ra, dec, order, "pix").groupBy("pix").agg(F.count("*").alias("n"))


def histogram_by_index(df: DataFrame, order: int, index: str = hp.INDEX_COLUMN) -> DataFrame:
    return df.groupBy(hp.to_order(F.col(index), order).alias("pix")).agg(F.count("*").alias("n"))


def dense(counts: DataFrame, order: int) -> DataFrame:
    """All cells of the order, those without rows with 0."""
    every = counts.sparkSession.range(hp.order2npix(order)).withColumnRenamed("id", "pix")
    return every.join(counts, "pix", "left").select("pix", F.coalesce("n", F.lit(0)).alias("n"))


def empty(spark, order: int) -> DataFrame:
    return spark.range(hp.order2npix(order)).select(F.col("id").alias("pix"), F.lit(0).cast("long").alias("n"))


def rollup(counts: DataFrame, highest: int, lowest: int = 0) -> DataFrame:
    """``(o, p, n)``: sums of a histogram at every order from ``lowest`` to ``highest``."""
    o = F.explode(F.sequence(F.lit(lowest), F.lit(highest)))
    up = counts.select(o.alias("o"), "pix", "n").select("o", F.call_function("shiftright", F.col("pix"), ((F.lit(highest) - F.col("o")) * 2).cast("int")).alias("p"), "n")
    return up.groupBy("o", "p").agg(F.sum("n").alias("n"))


def alignment(counts: DataFrame, highest: int = 10, lowest: int = 0, threshold: int = 1_000_000, drop_empty_siblings: bool = False, keep_overfull: bool = False) -> DataFrame:
    """``(pix, Norder, Npix, total)``: the partition of each cell that holds rows, and its rows.

    It is the largest cell from ``lowest`` on with ``threshold`` rows or fewer; with
    ``drop_empty_siblings`` the largest whose rows don't all lie in one quarter, else
    the cell of the highest order itself. Fails if a single cell holds more than
    ``threshold``, unless ``keep_overfull`` makes such a cell a partition of its own.
    """
    if lowest > highest:
        raise ValueError("the lowest order must not exceed the highest")
    most = counts.agg(F.max("n"), F.max("pix")).first()
    if most[1] is not None and most[1] >= hp.order2npix(highest):
        raise ValueError("the histogram is of another order")
    if most[0] is not None and most[0] > threshold and not keep_overfull:
        raise ValueError(f"a single cell holds {most[0]} rows, more than {threshold}")
    sums = rollup(counts.where("n > 0"), highest, lowest)
    ok = sums.where((F.col("n") <= threshold) | (F.col("o") == highest))
    if drop_empty_siblings:
        child = sums.groupBy((F.col("o") - 1).alias("o"), F.shiftright("p", 2).alias("p")).agg(F.max("n").alias("best"))
        inner = ok.where(F.col("o") < highest).join(child, ["o", "p"]).where("n <> best").drop("best")
        ok = inner.unionByName(sums.where(F.col("o") == highest))
    # The partitions are those that have no other above them; each cell then looks up its own ancestors.
    up = counts.where("n > 0").select("pix", F.explode(F.sequence(F.lit(lowest), F.lit(highest))).alias("o"))
    up = up.withColumn("p", F.call_function("shiftright", F.col("pix"), ((F.lit(highest) - F.col("o")) * 2).cast("int")))
    met = up.join(ok, ["o", "p"])
    best = met.groupBy("pix").agg(F.min(F.struct("o", "p", "n")).alias("b"))
    return best.select("pix", F.col("b.o").alias("Norder"), F.col("b.p").alias("Npix"), F.col("b.n").alias("total"))


def partitions(aligned: DataFrame) -> DataFrame:
    return aligned.select("Norder", "Npix", "total").distinct()


#: Partitions, each a file, that are held to place rows; a table of them takes 8 bytes each.
MOST_HELD = 1_000_000


def assign(rows: DataFrame, aligned: DataFrame, highest: int, index: str = hp.INDEX_COLUMN) -> DataFrame:
    """Rows with the ``Norder`` and ``Npix`` of their partition; rows in none go.

    Up to ``MOST_HELD`` partitions are broadcast, a table for each order that occurs, and
    a row probes its ancestors there, so rows aren't shuffled. Where there are more, rows
    meet the alignment, a row a cell of the highest order, in a join.
    """
    spark = rows.sparkSession
    held = partitions(aligned).select("Norder", "Npix").limit(MOST_HELD + 1).toArrow()
    if held.num_rows > MOST_HELD:
        where = aligned.select(F.col("pix").alias("_pix"), "Norder", "Npix")
        return rows.withColumn("_pix", hp.to_order(F.col(index), highest)).join(where, "_pix").drop("_pix")
    none = F.lit(None)
    order, pixel, out = [none.cast("int")], [none.cast("long")], rows
    for o in sorted(set(held["Norder"].to_pylist())):
        cells = held.filter(pc.equal(held["Norder"], o)).select(["Npix"]).rename_columns([f"_at{o}"])
        out = out.join(F.broadcast(spark.createDataFrame(cells)), hp.to_order(F.col(index), o) == F.col(f"_at{o}"), "left")
        order.append(F.when(F.col(f"_at{o}").isNotNull(), F.lit(o)))
        pixel.append(F.col(f"_at{o}"))
    out = out.withColumns({"Norder": F.coalesce(*order), "Npix": F.coalesce(*pixel)}).where("Norder is not null")
    return out.drop(*(c for c in out.columns if c.startswith("_at") and c not in rows.columns))
