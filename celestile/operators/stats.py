"""Column statistics and partition sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from celestile.functions import healpix as hp

CATALOG_COLUMNS = ("Norder", "Dir", "Npix", hp.INDEX_COLUMN)


def chosen(names: list[str], exclude_catalog_columns: bool = True, exclude: list[str] | None = None, include: list[str] | None = None) -> list[str]:
    out = [c for c in names if not include or c in include]
    gone = set(exclude or ()) | (set(CATALOG_COLUMNS) if exclude_catalog_columns else set())
    return [c for c in out if c not in gone]


def column_statistics(df: DataFrame, **which) -> DataFrame:
    """``(column_names, min_value, max_value, null_count)`` of each column, values as text,
    in one pass."""
    names = chosen(df.columns, **which)
    if not names:
        return df.sparkSession.createDataFrame([], "column_names string, min_value string, max_value string, null_count long")
    one = df.agg(*(x for i, c in enumerate(names) for x in (F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"b{i}"), F.count_if(F.col(c).isNull()).alias(f"n{i}"))))
    rows = F.array(*(F.struct(F.lit(c).alias("column_names"), F.col(f"a{i}").alias("min_value"), F.col(f"b{i}").alias("max_value"), F.col(f"n{i}").alias("null_count")) for i, c in enumerate(names)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def size_bins(sizes: DataFrame, size: str, edges: list[float]) -> DataFrame:
    """``(bin, n, total, share)`` of partitions by size; bin 0 lies below the first edge."""
    which = F.lit(0)
    for i, e in enumerate(edges, 1):
        which = F.when(F.col(size) >= e, i).otherwise(which)
    by = sizes.groupBy(which.alias("bin")).agg(F.count("*").alias("n"), F.sum(size).alias("total"))
    whole = F.sum("total").over(Window.partitionBy(F.lit(0)))  # a row for each bin
    return by.select("bin", "n", "total", (F.col("total") / whole).alias("share"))


def partition_files(df: DataFrame) -> DataFrame:
    """``(file, bytes, rows)`` of the files a table is read from."""
    return df.select("_metadata.file_path", "_metadata.file_size").groupBy(F.col("file_path").alias("file"), F.col("file_size").alias("bytes")).agg(F.count("*").alias("rows"))
