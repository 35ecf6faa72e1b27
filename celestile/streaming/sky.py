"""Positions in streams: indexing and region tests are stateless, and counts by cell and
time are plain aggregations whose state a watermark bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestile.functions import healpix as hp
from celestile.operators import regions as R


def indexed(stream: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """The stream with its spatial index."""
    return hp.with_index(stream, ra, dec)


def inside(stream: DataFrame, region: R.Region, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """The rows in a region."""
    return stream.where(R.row_predicate(region, ra, dec))


def counts(stream: DataFrame, order: int, time: str, window: str, late: str, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """``(start, pix, n)``: rows by cell and window. Rows later than ``late`` are left out, and
    windows that old leave the state."""
    rows = hp.with_pixel(stream.select(time, ra, dec), ra, dec, order, "pix").withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("w"), "pix").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "pix", "n")
