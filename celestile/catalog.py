"""Catalogs: lazy rows, a small table of partitions, and properties."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from celestile.operators import align as A
from celestile.operators import cells as C
from celestile.operators import joins as J
from celestile.operators import margins as G
from celestile.operators import moc as M
from celestile.operators import regions as R
from celestile.sources import metadata, paths, skymap
from celestile.sources.properties import Properties


#: Leaf files that a scan names one by one; one of more reads the folder and keeps the rows of the leaves.
MOST_FILES = 100_000
#: Named files that a task lists at least; Spark alone makes a task for each, up to 10,000.
FILES_LISTED = 300
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _few_listing_tasks(spark: SparkSession, files: int) -> Iterator[None]:
    """Spark lists files as they are named, by a session's setting, which is put back after."""
    held = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(held), -(-files // FILES_LISTED))))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, held)


@dataclass
class Catalog:
    """A catalog of any type. ``partitions`` are its leaf cells ``(Norder, Npix)``, ``moc`` its
    coverage where known, at ``moc_order``; ``pairs`` the cell pairs of an association."""

    spark: SparkSession
    properties: Properties
    partitions: DataFrame
    path: str | None = None
    moc: DataFrame | None = None
    moc_order: int | None = None
    pairs: DataFrame | None = None
    rows_df: DataFrame | None = None
    #: The folder a filtered catalog was taken from; its rows are still read from there.
    source: str | None = None

    @property
    def name(self) -> str:
        return self.properties.catalog_name

    @property
    def on_disk(self) -> bool:
        return self.path is not None

    def rows(self, columns: list[str] | None = None) -> DataFrame:
        """The rows of the partitions, with the default columns unless others are named; all
        columns for an empty list. Only the files of the catalog's own leaf cells are listed
        and opened."""
        names = columns if columns is not None else self.properties.default_columns
        if self.rows_df is not None:
            df = self._of_leaves(self.rows_df)
        elif self._folder:
            df = self._scan()
        else:
            raise ValueError("the catalog has no rows")
        return df.select(*names) if names else df

    @property
    def _folder(self) -> str | None:
        return self.path or self.source

    def _of_leaves(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.partitions.select("Norder", "Npix"), ["Norder", "Npix"], "left_semi")

    def _scan(self) -> DataFrame:
        top = f"{self._folder}/{paths.DATASET}"
        leaves = self.partitions.select("Norder", "Npix").limit(MOST_FILES + 1).collect()
        named = 0 < len(leaves) <= MOST_FILES
        read = self.spark.read.option("basePath", top)
        if named:
            with _few_listing_tasks(self.spark, len(leaves)):
                df = read.parquet(*paths.leaf_files(self._folder, leaves))
        else:
            df = read.parquet(top)
        df = df.withColumns({c: F.col(c).cast(t) for c, t in (("Norder", "int"), ("Dir", "long"), ("Npix", "long")) if c in df.columns})
        return df if named else self._of_leaves(df)

    def all_columns(self) -> list[str]:
        rows = self.rows_df if self.rows_df is not None else self.spark.read.parquet(f"{self._folder}/{paths.DATASET}")
        return rows.columns

    @property
    def schema(self):
        """From the small metadata files; None, with a warning, where there are none."""
        for name in (paths.COMMON, paths.METADATA):
            if self.path and paths.exists(paths.pointer(self.path, name)):
                return from_arrow_schema(metadata.read_schema(paths.pointer(self.path, name)))
        warnings.warn(f"{self.name} has no metadata file", stacklevel=2)
        return None

    def max_coverage_order(self) -> int | None:
        top = C.highest_order(self.partitions).first()[0]
        return max((x for x in (top, self.moc_order) if x is not None), default=None)

    def filter_cells(self, cells: DataFrame) -> Catalog:
        return self._kept(C.overlapping(self.partitions, cells), M.from_cells(cells))

    def filter_pixels(self, pixels: list) -> Catalog:
        return self.filter_cells(C.from_pixels(self.spark, pixels))

    def filter_moc(self, moc: DataFrame) -> Catalog:
        if self.properties.catalog_type == "margin":
            order = max(x for x in (self.max_coverage_order(), 0) if x is not None)
            return self._kept(G.filter_margin(self.partitions, moc, order, self.properties.margin_threshold), moc)
        return self._kept(M.filter_cells(self.partitions, moc), moc)

    def _kept(self, partitions: DataFrame, moc: DataFrame) -> Catalog:
        pairs = self.pairs.join(partitions.select("Norder", "Npix"), ["Norder", "Npix"], "left_semi") if self.pairs is not None else None
        own = M.intersection(self.moc, moc) if self.moc is not None else None
        # No more cells than the catalog's own list, which the driver holds; held again, filters don't pile up.
        partitions = self.spark.createDataFrame(partitions.toArrow())
        return replace(self, partitions=partitions, moc=own, pairs=pairs, properties=self.properties.updated(total_rows=0), source=self._folder, path=None)

    def filter_region(self, region: R.Region, order: int | None = None) -> Catalog:
        """The leaf cells that may touch a region; rows are tested by ``search``."""
        at = order if order is not None else self.max_coverage_order()
        if at is None:
            return self
        return self._kept(R.filter_leaves(self.partitions, region, at), M.from_cells(R.cover(self.spark, region, at)))

    def filter_by_cone(self, ra: float, dec: float, radius_arcsec: float) -> Catalog:
        return self.filter_region(R.Cone(ra, dec, radius_arcsec))

    def filter_by_box(self, ra=None, dec=None) -> Catalog:
        return self.filter_region(R.Box(ra or None, dec or None))

    def filter_by_polygon(self, vertices) -> Catalog:
        return self.filter_region(R.Polygon(tuple(map(tuple, vertices))))

    def search(self, region: R.Region) -> DataFrame:
        """The rows in a region: of the leaves that meet its cover, the row groups that do."""
        p, cells = self.properties, R.held_cover(self.spark, region)
        rows = replace(self, partitions=C.overlapping(self.partitions, cells)).rows([])
        return R.search(rows, region, p.ra_column, p.dec_column, cells=cells)

    def align(self, other: Catalog, how: str = "inner") -> DataFrame:
        return A.align_with_mocs(self.partitions, other.partitions, self.moc, other.moc, how)

    def negative_cells(self) -> DataFrame:
        return C.negative(self.partitions)

    def join_map(self) -> DataFrame:
        if self.pairs is None:
            raise TypeError(f"{self.name} is not an association")
        return J.join_map(self.pairs)

    def loc_partitions(self, values: list) -> DataFrame:
        """The cells of an index catalog that hold any of the values, along the nested curve."""
        rows = self.spark.read.parquet(f"{self.path}/{paths.DATASET}") if self.rows_df is None else self.rows_df
        rows = rows.withColumns({"Norder": F.col("Norder").cast("int"), "Npix": F.col("Npix").cast("long")})
        return C.nested_order(J.lookup(rows, self.properties.indexing_column, values))

    def coverage(self) -> float:
        return C.coverage(self.partitions).first()[0]


def in_memory(spark: SparkSession, properties: Properties, partitions: DataFrame | list, pairs: DataFrame | None = None, rows: DataFrame | None = None) -> Catalog:
    if isinstance(partitions, list):
        partitions = C.from_pixels(spark, partitions)
    elif not isinstance(partitions, DataFrame):
        raise TypeError("partitions must be a list of cells or a DataFrame")
    if properties.catalog_type == "association" and not isinstance(pairs, DataFrame):
        raise TypeError("an association needs a DataFrame of cell pairs")
    return Catalog(spark, properties, C.tree(partitions), pairs=pairs, rows_df=rows)


def open_catalog(spark: SparkSession, path: str, catalog_type: str | None = None) -> Catalog:
    """Read the metadata of a catalog; its rows stay unread."""
    if not paths.exists(path):
        raise FileNotFoundError(f"no directory at {path}")
    p = Properties.read(path)
    kind = catalog_type or p.catalog_type
    if kind not in ("object", "source", "association", "index", "margin"):
        raise NotImplementedError(f"cannot load a catalog of type {kind}")
    if kind == "index":
        return Catalog(spark, p, C.from_pixels(spark, []), path)
    pairs = None
    if kind == "association":
        pairs = metadata.pairs_table(spark, path)
    cells = C.tree(C.from_pixels(spark, metadata.read_partitions(path)))
    moc = order = counts = None
    if paths.exists(f"{path}/{paths.POINT_MAP}"):
        counts = spark.read.parquet(f"{path}/{paths.POINT_MAP}")
        order = counts.agg(F.max("order")).first()[0]
    elif paths.exists(f"{path}/{paths.SKY_MAP}"):
        counts, order = skymap.read_counts(spark, f"{path}/{paths.SKY_MAP}")
    if order is not None:
        moc = M.from_counts(counts.where("n <> 0"), order)
    return Catalog(spark, p, cells, path, moc, order, pairs)
