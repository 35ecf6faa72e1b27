"""Catalogs made from other catalogs: secondary indexes, associations, margins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestile.functions import healpix as hp
from celestile.operators import joins as J
from celestile.operators import margins as G
from celestile.sources import metadata as M
from celestile.sources import paths as P
from celestile.sources.properties import Properties
from celestile.sources.writer import finish, write_leaves


def write_index(cat, key: str, base: str, name: str, extra: list[str] | None = None, files: int | None = None) -> None:
    """A table of the places of every key, in files of ranges of the key, so that a lookup
    reads the row groups of its values alone."""
    index = J.build_index(cat.rows([key, "Norder", "Npix", hp.INDEX_COLUMN, *(extra or [])]), key, extra)
    dealt = index.repartitionByRange(*([files] if files else []), key).sortWithinPartitions(key)
    dealt.write.parquet(f"{base}/{P.DATASET}")
    total = M.row_total(cat.spark, f"{base}/{P.DATASET}")
    more = {"extra_columns": extra} if extra else {}
    Properties(catalog_name=name, catalog_type="index", total_rows=total, primary_catalog=cat.path or cat.name, indexing_column=key, **more).write(base)


#: Pairs of an association that are listed in small files; more are rows of Parquet files.
MOST_PAIRS = 100_000


def write_association(primary, secondary, on: list[tuple[str, str]], base: str, name: str) -> list[tuple[int, int, int, int]] | DataFrame:
    """The pairs of partitions with rows in common; rows are joined by the columns it names.
    Up to ``MOST_PAIRS`` are lists in small files; where there are more, the executors write
    them as rows, and the driver holds a row for each primary cell. Returns the pairs, as a
    list or, where there are more, as a DataFrame."""
    a = primary.rows([*(x for x, _ in on), "Norder", "Npix"])
    b = secondary.rows([*(y for _, y in on), "Norder", "Npix"])
    found = J.associate(a, b, on)
    along = hp.first29(F.col("Norder"), F.col("Npix")), hp.first29(F.col("join_Norder"), F.col("join_Npix"))
    held = found.limit(MOST_PAIRS + 1).collect()
    many = len(held) > MOST_PAIRS
    if many:
        found.repartitionByRange(*along).sortWithinPartitions(*along).write.parquet(f"{base}/{P.DATASET}")
        written = primary.spark.read.parquet(f"{base}/{P.DATASET}")
        M.write_partitions(base, [tuple(r) for r in written.select("Norder", "Npix").distinct().orderBy(along[0]).collect()])  # a row for each partition
        total = written.agg(F.sum("n")).first()[0]
    else:
        held.sort(key=lambda r: (r[1] << 2 * (hp.MAX_ORDER - r[0]), r[3] << 2 * (hp.MAX_ORDER - r[2])))
        pairs = [tuple(r[:4]) for r in held]
        M.write_cells_metadata(base, pairs, M.PAIR)
        M.write_pairs(base, pairs)
        total = sum(r["n"] for r in held)
    Properties(
        catalog_name=name, catalog_type="association", total_rows=total, primary_catalog=primary.path or primary.name, primary_column=on[0][0],
        join_catalog=secondary.path or secondary.name, join_column=on[0][1], contains_leaf_files=many,
    ).write(base)
    return M.pairs_table(primary.spark, base) if many else pairs


def write_margin(cat, threshold_arcsec: float, base: str, name: str) -> list[tuple[int, int]]:
    """The rows of other partitions around each partition, in files by the partition they
    surround; their own cell stays in the index column."""
    p = cat.properties
    rows: DataFrame = G.margin_cache(cat.rows(cat.all_columns()), cat.partitions, threshold_arcsec, p.ra_column, p.dec_column)
    rows = rows.drop("Norder", "Npix", "Dir").withColumnsRenamed({"margin_Norder": "Norder", "margin_Npix": "Npix"})
    written = write_leaves(rows, base)
    cells = [c[:2] for c in written]
    finish(cat.spark, base, name, cells, sum(c[2] for c in written), "margin", primary_catalog=cat.path or cat.name, margin_threshold=threshold_arcsec, ra_column=p.ra_column, dec_column=p.dec_column)
    return cells
