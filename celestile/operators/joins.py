"""Secondary indexes, associations and cross-matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestile.functions import healpix as hp


def build_index(rows: DataFrame, key: str, extra: list[str] | None = None) -> DataFrame:
    """``(key, Norder, Npix, _healpix_29, *extra)``, one row for each key and place."""
    return rows.select(key, "Norder", "Npix", hp.INDEX_COLUMN, *(extra or [])).distinct()


def lookup(index: DataFrame, key: str, values: list) -> DataFrame:
    """The cells that hold any of the values; the filter reaches the scan."""
    return index.where(F.col(key).isin(values)).select("Norder", "Npix").distinct()


def lookup_table(index: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """As ``lookup`` for a table of keys of any size."""
    return index.join(wanted.select(key).distinct(), key, "left_semi").select("Norder", "Npix").distinct()


def join_map(pairs: DataFrame) -> DataFrame:
    """``(Norder, Npix, joins)`` of pairs ``(Norder, Npix, join_Norder, join_Npix)``: the
    sorted join cells of each primary cell; pairs without a join cell leave it empty."""
    other = F.when(F.col("join_Norder").isNotNull(), F.struct("join_Norder", "join_Npix"))
    return pairs.groupBy("Norder", "Npix").agg(F.array_sort(F.collect_list(other)).alias("joins"))


def associate(primary: DataFrame, secondary: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """An association of two catalogs by equal columns: ``(Norder, Npix, join_Norder,
    join_Npix, n)`` of the partition pairs that have rows in common."""
    a = primary.select(*(F.col(x).alias(f"_k{i}") for i, (x, _) in enumerate(on)), "Norder", "Npix")
    b = secondary.select(*(F.col(y).alias(f"_k{i}") for i, (_, y) in enumerate(on)), F.col("Norder").alias("join_Norder"), F.col("Npix").alias("join_Npix"))
    return a.join(b, [f"_k{i}" for i in range(len(on))]).groupBy("Norder", "Npix", "join_Norder", "join_Npix").agg(F.count("*").alias("n"))


def join_rows(primary: DataFrame, secondary: DataFrame, left_on: str, right_on: str, how: str = "inner") -> DataFrame:
    """Rows joined by the columns an association declares."""
    return primary.join(secondary, primary[left_on] == secondary[right_on], how)


#: 40 degrees: beyond, pairs lie further apart than neighbouring base cells.
WIDEST = 40 * 3600.0


def cross_match(left: DataFrame, right: DataFrame, radius_arcsec: float, left_id: str, right_id: str, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """``(left_id, right_id, arcsec)`` of all pairs within a radius.

    Every right row is written to its own cell and to that cell's neighbours, at an
    order whose cells are wider than the radius everywhere, and meets the left rows of
    the cell in an equi-join; distances are tested within. Dense cells are what AQE
    splits. Only ids and positions are exchanged. Radii over ``WIDEST`` are refused.
    """
    if radius_arcsec > WIDEST:
        raise ValueError(f"a radius of {radius_arcsec} arcsec reaches beyond the cells around a base cell; {WIDEST} at most")
    order = max(0, min(hp.margin2order(radius_arcsec / 60), 29))
    a = hp.with_pixel(left.select(F.col(left_id).alias("_a"), F.col(ra).alias("_ra"), F.col(dec).alias("_dec")), "_ra", "_dec", order, "_cell")
    b = hp.with_pixel(right.select(F.col(right_id).alias("_b"), F.col(ra).alias("_rb"), F.col(dec).alias("_db")), "_rb", "_db", order, "_own")
    b = hp.with_neighbours(b, "_own", order, "_ring")
    b = b.withColumn("_cell", F.explode(F.array_distinct(F.array_compact(F.concat(F.array("_own"), "_ring"))))).drop("_own", "_ring")
    met = a.join(b, "_cell").withColumn("arcsec", hp.separation("_ra", "_dec", "_rb", "_db") * 3600)
    return met.where(F.col("arcsec") <= radius_arcsec).select(F.col("_a").alias(left_id), F.col("_b").alias(right_id), "arcsec")
