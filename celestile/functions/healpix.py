"""Cells of the nested quadtree over twelve base cells: orders, sizes, positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celestile.functions import formulas

MAX_ORDER = 29
INDEX_COLUMN = "_healpix_29"
SKY_DEGREES = 41253


def check_order(order: int, most: int = MAX_ORDER) -> int:
    if order > most or order < 0:
        raise ValueError(f"order must be between 0 and {most}, not {order}")
    return order


# orders and sizes, as plain numbers
def order2nside(order: int) -> int:
    return 1 << check_order(order)


def nside2order(nside: int) -> int:
    if nside < 1 or nside & (nside - 1):
        raise ValueError(f"{nside} is not a power of two")
    return nside.bit_length() - 1


def nside2npix(nside: int) -> int:
    return 12 * nside * nside


def npix2nside(npix: int) -> int:
    nside = math.isqrt(npix // 12)
    if npix != 12 * nside * nside or nside & (nside - 1):
        raise ValueError(f"no order has {npix} cells")
    return nside


def order2npix(order: int) -> int:
    return 12 << 2 * check_order(order)


def npix2order(npix: int) -> int:
    return nside2order(npix2nside(npix))


def nside2pixarea(nside: int, degrees: bool = False) -> float:
    area = 4 * math.pi / nside2npix(nside)
    return area * (180 / math.pi) ** 2 if degrees else area


def nside2resol(nside: int, arcmin: bool = False) -> float:
    size = math.sqrt(nside2pixarea(nside))
    return math.degrees(size) * 60 if arcmin else size


def avgsize2mindist(size):
    """Least width of a cell from its average size; numbers or columns."""
    return size / 1.6


def mindist2avgsize(dist):
    return dist * 1.6


def avgsize2order(size_arcmin: float) -> int:
    """The highest order whose cells have this average size or more."""
    return int(math.log2(math.sqrt(math.pi / 3) / math.radians(size_arcmin / 60)))


def margin2order(margin_arcmin: float) -> int:
    """The highest order whose cells are everywhere wider than a margin."""
    return avgsize2order(mindist2avgsize(margin_arcmin))


def avgsize2order_col(size_arcmin: Column) -> Column:
    """As ``avgsize2order``; null for a size of 0."""
    return F.log2(F.try_divide(F.sqrt(F.pi() / 3), F.radians(size_arcmin / 60))).cast("int")


def cell_radius(order: int) -> float:
    """The largest distance in degrees from the centre of a cell to its corners."""
    n = 1 << order
    z, top = 2 / 3, 1 - (1 - 1 / n) ** 2 / 3
    phi = math.pi / (4 * n)
    c = z * top + math.sqrt(1 - z * z) * math.sqrt(1 - top * top) * math.cos(phi)
    s = math.hypot(math.sqrt(1 - z * z) * math.sin(phi), math.sqrt(1 - top * top) * z - top * math.sqrt(1 - z * z) * math.cos(phi))
    return math.degrees(math.atan2(s, c))


# cell arithmetic, on columns
def to_order(index: Column, order: int) -> Column:
    """The order's cell of an order-29 cell."""
    return F.shiftright(index.cast("long"), 2 * (MAX_ORDER - check_order(order)))


def to_index(pixel: Column, order: int) -> Column:
    """The first order-29 cell of a cell."""
    return F.shiftleft(pixel.cast("long"), 2 * (MAX_ORDER - check_order(order)))


def first29(order: Column, pixel: Column) -> Column:
    """The first order-29 cell of cells of any orders."""
    return F.call_function("shiftleft", pixel.cast("long"), ((F.lit(MAX_ORDER) - order) * 2).cast("int"))


def past29(order: Column, pixel: Column) -> Column:
    return F.call_function("shiftleft", pixel.cast("long") + 1, ((F.lit(MAX_ORDER) - order) * 2).cast("int"))


def ancestor(pixel: Column, steps: Column) -> Column:
    return F.call_function("shiftright", pixel.cast("long"), (steps * 2).cast("int"))


def directory(pixel: Column) -> Column:
    """The bucket of ten thousand cells a leaf file is kept in."""
    return pixel - F.pmod(pixel, F.lit(10000))


def interval_order(lo: Column, hi: Column, order: int) -> Column:
    """The order of the cell that spans ``[lo, hi)`` of an order, by counting bits."""
    return (F.lit(order) - F.floor((F.length(F.bin(hi - lo)) - 1) / 2)).cast("int")


def wrap_ra(ra: Column) -> Column:
    return F.pmod(ra, F.lit(360.0))


# positions, on DataFrames: each adds columns
def with_pixel(df: DataFrame, ra: str, dec: str, order: int, out: str = "pixel") -> DataFrame:
    return formulas.apply(df, formulas.ang2pix(ra, dec, check_order(order), out), [out])


def with_index(df: DataFrame, ra: str = "ra", dec: str = "dec", out: str = INDEX_COLUMN) -> DataFrame:
    """Adds the spatial index: the order-29 cell."""
    return with_pixel(df, ra, dec, MAX_ORDER, out)


def with_centre(df: DataFrame, pixel: str, order: int, ra: str = "ra", dec: str = "dec") -> DataFrame:
    return formulas.apply(df, formulas.pix2ang(pixel, check_order(order), ra, dec), [ra, dec])


def with_xyf(df: DataFrame, pixel: str, order: int) -> DataFrame:
    return formulas.apply(df, formulas.pix2xyf(pixel, check_order(order), "x", "y", "face"), ["x", "y", "face"])


def with_neighbours(df: DataFrame, pixel: str, order: int, out: str = "neighbours") -> DataFrame:
    """Adds the eight neighbours as an array (SW, W, NW, N, NE, E, SE, S), null where there is none."""
    steps, names = formulas.all_neighbours(pixel, check_order(order))
    return formulas.apply(df, [*steps, {out: f"array({', '.join(names)})"}], [out])


def with_nested(df: DataFrame, ring: str, order: int, out: str = "pixel") -> DataFrame:
    """Adds the nested number of cells numbered along rings: the cell that holds the ring cell's centre."""
    steps = formulas.ring2ang(ring, check_order(order), "_rra", "_rdec")
    return formulas.apply(df, [*steps, *formulas.ang2pix("_rra", "_rdec", order, out)], [out])


def with_vector(df: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
    r, d = F.radians(ra), F.radians(dec)
    return df.withColumns({"x": F.cos(d) * F.cos(r), "y": F.cos(d) * F.sin(r), "z": F.sin(d)})


def vector_ra(x: Column, y: Column) -> Column:
    return wrap_ra(F.degrees(F.atan2(y, x)))


def vector_dec(x: Column, y: Column, z: Column) -> Column:
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def separation(ra1: str, dec1: str, ra2: str, dec2: str) -> Column:
    return F.expr(formulas.separation(ra1, dec1, ra2, dec2))


def with_boundary(df: DataFrame, pixel: str, order: int, step: int) -> DataFrame:
    """Explodes each cell into ``4 * step`` points of its boundary: ``sample``, ``ra``, ``dec``."""
    n = float(1 << check_order(order))
    steps = formulas.pix2xyf(pixel, order, "_bx", "_by", "_bf")
    base = formulas.apply(df, steps, ["_bx", "_by", "_bf"]).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(4 * step - 1))))
    xc, yc, dc, d = f"(_bx + 0.5e0) / {n!r}e0", f"(_by + 0.5e0) / {n!r}e0", f"CAST({0.5 / n!r} AS DOUBLE)", f"CAST({1 / (step * n)!r} AS DOUBLE)"
    i = f"(sample % {step})"
    side = f"(sample div {step})"
    u = f"CASE {side} WHEN 0 THEN {xc} + {dc} - {i} * {d} WHEN 1 THEN {xc} - {dc} WHEN 2 THEN {xc} - {dc} + {i} * {d} ELSE {xc} + {dc} END"
    v = f"CASE {side} WHEN 0 THEN {yc} + {dc} WHEN 1 THEN {yc} + {dc} - {i} * {d} WHEN 2 THEN {yc} - {dc} ELSE {yc} - {dc} + {i} * {d} END"
    out = formulas.apply(base, [{"_bu": u, "_bv": v}, *formulas.xyf2ang("_bu", "_bv", "_bf", "ra", "dec")], ["ra", "dec"])
    return out.drop("_bx", "_by", "_bf")
