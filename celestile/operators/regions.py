"""Cone, box and polygon searches: exact predicates on rows, covers of cells.

A cover holds every cell that may touch the region (a cell is kept if its centre is no
farther from the region than any point of a cell can be from its centre), so a
search first keeps the leaf cells, or the index ranges, that meet the cover, and then
tests rows exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from celestile.functions import formulas
from celestile.functions import healpix as hp
from celestile.operators import cells as C


def _check_dec(dec) -> None:
    if np.any(np.abs(np.asarray(dec, dtype=float)) > 90):
        raise ValueError("declination must be between -90 and 90")


def _num(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


@dataclass(frozen=True)
class Cone:
    """Rows within ``radius_arcsec`` of a position."""

    ra: float
    dec: float
    radius_arcsec: float

    def __post_init__(self) -> None:
        if self.radius_arcsec <= 0:
            raise ValueError("cone radius must be positive")
        _check_dec(self.dec)

    def width(self) -> float:
        return 2 * self.radius_arcsec / 3600

    def sql(self, ra: str, dec: str, slack: float = 0.0) -> str:
        return f"{formulas.separation(ra, dec, _num(self.ra), _num(self.dec))} <= {_num(self.radius_arcsec / 3600 + slack)}"


@dataclass(frozen=True)
class Box:
    """Rows in a range of right ascension, which may wrap, or of declination, or both."""

    ra: tuple[float, float] | None = None
    dec: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        ra = tuple(x % 360 for x in self.ra) if self.ra else None
        object.__setattr__(self, "ra", ra)
        object.__setattr__(self, "dec", tuple(self.dec) if self.dec else None)
        bad = ra is None and self.dec is None
        bad = bad or ra is not None and (len(ra) != 2 or ra[0] == ra[1])
        if self.dec is not None:
            _check_dec(self.dec)
            bad = bad or len(self.dec) != 2 or self.dec[0] >= self.dec[1]
        if bad:
            raise ValueError("invalid ra or dec range")

    def width(self) -> float:
        return max((self.ra[1] - self.ra[0]) % 360 if self.ra else 360.0, self.dec[1] - self.dec[0] if self.dec else 180.0)

    def sql(self, ra: str, dec: str, slack: float = 0.0) -> str:
        out = []
        if self.ra and not slack:
            a, b = self.ra
            out.append(f"((({ra} - {_num(a)}) % 360.0e0 + 360.0e0) % 360.0e0) <= {_num((b - a) % 360)}")
        elif self.ra:
            # A lune is what lies left of one meridian plane and right of another; either of them if it is wide.
            a, b = map(math.radians, self.ra)
            x, y = f"cos(radians({dec})) * cos(radians({ra}))", f"cos(radians({dec})) * sin(radians({ra}))"
            least = _num(-math.sin(math.radians(min(slack, 90.0))))
            p = f"(({y}) * {_num(math.cos(a))} - ({x}) * {_num(math.sin(a))} >= {least})"
            q = f"(({x}) * {_num(math.sin(b))} - ({y}) * {_num(math.cos(b))} >= {least})"
            out.append(f"({p} {'AND' if (self.ra[1] - self.ra[0]) % 360 < 180 else 'OR'} {q})")
        if self.dec:
            out.append(f"{dec} >= {_num(self.dec[0] - slack)} AND {dec} <= {_num(self.dec[1] + slack)}")
        return " AND ".join(out)


@dataclass(frozen=True)
class Polygon:
    """Rows in a convex spherical polygon, given as (ra, dec) or as (x, y, z) vertices."""

    vertices: tuple

    def __post_init__(self) -> None:
        v = [tuple(map(float, p)) for p in self.vertices]
        if v and all(len(p) == 2 for p in v):
            _check_dec([p[1] for p in v])
            r = np.radians(np.array(v))
            v = np.stack([np.cos(r[:, 1]) * np.cos(r[:, 0]), np.cos(r[:, 1]) * np.sin(r[:, 0]), np.sin(r[:, 1])], axis=1)
        v = np.array(v, dtype=float)
        if len(v) < 3:
            raise ValueError("a polygon needs three vertices")
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        if len(np.unique(v.round(12), axis=0)) != len(v):
            raise ValueError("polygon vertices must differ")
        if np.linalg.matrix_rank(v, tol=1e-9) < 3:
            raise ValueError("polygon is degenerate: its vertices lie on a great circle")
        object.__setattr__(self, "vertices", tuple(map(tuple, v.tolist())))

    def width(self) -> float:
        v = np.array(self.vertices)
        return math.degrees(math.acos(max(-1.0, min(1.0, float((v @ v.T).min())))))

    def normals(self) -> np.ndarray:
        v = np.array(self.vertices)
        n = np.cross(v, np.roll(v, -1, axis=0))
        n = n / np.linalg.norm(n, axis=1, keepdims=True)
        return n if (n @ v.sum(axis=0)).sum() >= 0 else -n

    def sql(self, ra: str, dec: str, slack: float = 0.0) -> str:
        x, y, z = f"cos(radians({dec})) * cos(radians({ra}))", f"cos(radians({dec})) * sin(radians({ra}))", f"sin(radians({dec}))"
        least = _num(-math.sin(math.radians(min(slack, 90.0))))
        return " AND ".join(f"(({x}) * {_num(a)} + ({y}) * {_num(b)} + ({z}) * {_num(c)} >= {least})" for a, b, c in self.normals().tolist())


Region = Cone | Box | Polygon


def row_predicate(region: Region, ra: str = "ra", dec: str = "dec") -> Column:
    return F.expr(region.sql(ra, dec))


def _near(cells: DataFrame, region: Region, order: int) -> DataFrame:
    """The cells of one order whose centre is near enough."""
    names = cells.columns
    return hp.with_centre(cells, "Npix", order, "_ra", "_dec").where(region.sql("_ra", "_dec", hp.cell_radius(order))).select(*names)


def cover(spark: SparkSession, region: Region, order: int, step: int = 2) -> DataFrame:
    """The cells of an order that may touch a region. Refined from low orders, so only
    cells near the region are ever made."""
    at = min(order, 3)
    out = _near(spark.range(12 << 2 * at).select(F.lit(at).alias("Norder"), F.col("id").alias("Npix")), region, at)
    while at < order:
        to = min(order, at + step)
        d = 2 * (to - at)
        out = out.select(F.lit(to).alias("Norder"), F.explode(F.sequence(F.shiftleft("Npix", d), F.shiftleft(F.col("Npix") + 1, d) - 1)).alias("Npix"))
        out, at = _near(out, region, to), to
    return out


def filter_leaves(leaves: DataFrame, region: Region, order: int) -> DataFrame:
    """The leaf cells that may touch a region, judged by their parts of an order or by
    themselves where they are deeper: only these are refined, never the whole sky."""
    # A leaf at or above the order meets the cover of the order; a deeper one meets the cell above it.
    return C.overlapping(leaves, cover(leaves.sparkSession, region, order))


def cover_order(region: Region, across: int = 16) -> int:
    """The order whose cells are about a sixteenth of a region's width, from 6 on: a cover then
    has some hundred cells however small the region is."""
    return max(6, min(18, hp.avgsize2order(max(region.width(), 1e-9) * 60 / across)))


def strip_cells(spark: SparkSession, order: int, south: float, north: float, inclusive: bool = True) -> DataFrame:
    """The cells of an order that may touch a band of declination; if not ``inclusive`` those
    whose centres lie in it."""
    return _of_region(spark, Box(dec=(south, north)), order, inclusive)


def polygon_cells(spark: SparkSession, order: int, vertices, inclusive: bool = True) -> DataFrame:
    """As ``strip_cells``, of a convex polygon."""
    return _of_region(spark, Polygon(tuple(map(tuple, vertices))), order, inclusive)


def _of_region(spark: SparkSession, region: Region, order: int, inclusive: bool) -> DataFrame:
    cells = cover(spark, region, order)
    if inclusive:
        return cells
    return hp.with_centre(cells, "Npix", order, "_ra", "_dec").where(region.sql("_ra", "_dec")).select("Norder", "Npix")


def held_cover(spark: SparkSession, region: Region, order: int | None = None) -> DataFrame:
    """As ``cover``, its cells held by the driver: at an order of ``cover_order`` some hundred, or
    those of order 6 at most."""
    return spark.createDataFrame(cover(spark, region, cover_order(region) if order is None else order).toArrow())


def index_ranges(cells: DataFrame, most: int = 64) -> list[tuple[int, int]]:
    """At most ``most`` ranges of the spatial index that hold the cells of a cover: those
    closest to one another are joined."""
    out: list[list[int]] = []
    for o, p in sorted((r["Norder"], r["Npix"]) for r in cells.collect()):
        lo, hi = (p + k << 2 * (hp.MAX_ORDER - o) for k in (0, 1))
        if out and out[-1][1] == lo:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    while len(out) > most:
        gap = sorted(out[i + 1][0] - out[i][1] for i in range(len(out) - 1))[len(out) - most - 1]
        joined = [out[0]]
        for lo, hi in out[1:]:
            if lo - joined[-1][1] <= gap:
                joined[-1][1] = hi
            else:
                joined.append([lo, hi])
        out = joined
    return [(a, b) for a, b in out]


def search(rows: DataFrame, region: Region, ra: str = "ra", dec: str = "dec", index: str | None = hp.INDEX_COLUMN, order: int | None = None, cells: DataFrame | None = None) -> DataFrame:
    """The rows in a region. With an index column, ranges of it go to the scan as
    filters, so row groups outside the cover aren't read. The cover is ``cells`` or one whose
    order, unless given, follows the region's width."""
    if index and index in rows.columns:
        keep = F.lit(False)
        for lo, hi in index_ranges(cells if cells is not None else held_cover(rows.sparkSession, region, order)):
            keep = keep | ((F.col(index) >= lo) & (F.col(index) < hi))
        rows = rows.where(keep)
    return rows.where(row_predicate(region, ra, dec))
