"""Alignment of two cell trees: which cells of one meet which of the other."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestile.operators import cells as C
from celestile.operators import moc as M


class AlignmentType(str, Enum):
    INNER = "inner"
    OUTER = "outer"
    LEFT = "left"
    RIGHT = "right"


COLUMNS = ["primary_Norder", "primary_Npix", "join_Norder", "join_Npix", "aligned_Norder", "aligned_Npix"]


def align(left: DataFrame, right: DataFrame, how: AlignmentType | str = "inner") -> DataFrame:
    """Six columns: the primary cell, the join cell, and the smaller of both, which is
    their common sky. ``left``, ``right`` and ``outer`` also keep what a cell of that side
    does not share, as the largest cells, the other side null."""
    how = AlignmentType(how)
    pairs = C.overlapping_pairs(left, right)
    deeper = F.col("l_order") >= F.col("r_order")
    out = pairs.select(
        F.col("l_order").alias("primary_Norder"), F.col("l_pix").alias("primary_Npix"), F.col("r_order").alias("join_Norder"), F.col("r_pix").alias("join_Npix"),
        F.when(deeper, F.col("l_order")).otherwise(F.col("r_order")).alias("aligned_Norder"), F.when(deeper, F.col("l_pix")).otherwise(F.col("r_pix")).alias("aligned_Npix"),
    )
    none = (F.lit(None).cast("int"), F.lit(None).cast("long"))
    if how in (AlignmentType.LEFT, AlignmentType.OUTER):
        out = out.unionByName(_unshared(left, right, pairs.select("l_order", "l_pix")).select(F.col("c_order").alias("primary_Norder"), F.col("c_pix").alias("primary_Npix"), none[0].alias("join_Norder"), none[1].alias("join_Npix"), F.col("Norder").alias("aligned_Norder"), F.col("Npix").alias("aligned_Npix")))
    if how in (AlignmentType.RIGHT, AlignmentType.OUTER):
        out = out.unionByName(_unshared(right, left, pairs.select("r_order", "r_pix")).select(none[0].alias("primary_Norder"), none[1].alias("primary_Npix"), F.col("c_order").alias("join_Norder"), F.col("c_pix").alias("join_Npix"), F.col("Norder").alias("aligned_Norder"), F.col("Npix").alias("aligned_Npix")))
    return out


def _unshared(own: DataFrame, other: DataFrame, met: DataFrame) -> DataFrame:
    """``(c_order, c_pix, Norder, Npix)``: each own cell and the largest cells of it outside the other.
    ``met`` are the own cells that share sky with any other."""
    alone = own.select("Norder", "Npix").join(met.toDF("Norder", "Npix").distinct(), ["Norder", "Npix"], "left_anti")
    whole = alone.select(F.col("Norder").alias("c_order"), F.col("Npix").alias("c_pix"), "Norder", "Npix")
    return whole.unionByName(C.remainder(own, other))


def align_with_mocs(left: DataFrame, right: DataFrame, left_moc: DataFrame | None, right_moc: DataFrame | None, how: AlignmentType | str = "inner") -> DataFrame:
    """As ``align``, of what lies in the coverage: of both for ``inner``, of the kept side
    for ``left`` and ``right``, of either for ``outer``. A missing coverage is its tree's."""
    how = AlignmentType(how)
    a = left_moc if left_moc is not None else M.from_cells(left)
    b = right_moc if right_moc is not None else M.from_cells(right)
    moc = {AlignmentType.INNER: lambda: M.intersection(a, b), AlignmentType.LEFT: lambda: a, AlignmentType.RIGHT: lambda: b, AlignmentType.OUTER: lambda: M.union(a, b)}[how]()
    return filter_alignment(align(left, right, how), moc)


def filter_alignment(mapping: DataFrame, moc: DataFrame) -> DataFrame:
    """The rows whose aligned cell shares sky with the coverage."""
    cells = mapping.select(F.col("aligned_Norder").alias("Norder"), F.col("aligned_Npix").alias("Npix")).distinct()
    kept = M.filter_cells(cells, moc).select(F.col("Norder").alias("aligned_Norder"), F.col("Npix").alias("aligned_Npix"))
    return mapping.join(kept, ["aligned_Norder", "aligned_Npix"], "left_semi").select(*COLUMNS)


def filtered_cells(cells: DataFrame, search: DataFrame) -> DataFrame:
    """The distinct cells that meet a search tree."""
    return align(cells, search).select(F.col("primary_Norder").alias("Norder"), F.col("primary_Npix").alias("Npix")).distinct()
