"""Queries on catalogs that are written first and then opened, searched and read again.

The SQL works on the tables and knows nothing of files.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celestile import catalog as K
from celestile.functions import formulas as X
from celestile.functions import healpix as hp
from celestile.operators import regions as R
from celestile.plans import queries as Q
from celestile.plans.queries import query
from celestile.plans.sky import view, view_sql
from celestile.sources import files, metadata, paths, shared, skymap, stores, validation
from celestile.sources.writer import write_catalog

HIGHEST, MOST = 5, 200
#: Folders by session and folder of tables.
_WRITTEN: dict[tuple[str, str], str] = {}

_ALIGNED = Q.aligned_sql(Q.hist_sql("orders", HIGHEST), HIGHEST, str(MOST))
_PARTS = f"SELECT DISTINCT Norder, Npix, total FROM ({_ALIGNED})"
_ROWS = f"SELECT r.*, a.Norder, a.Npix FROM ({Q.pix_sql('orders', HIGHEST)}) r JOIN ({_ALIGNED}) a USING (pix)"


def stored(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a catalog of the orders, written once a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _WRITTEN:
        base = f"{shared.folder(spark, 'celestile-stored')}/orders"
        rows = view(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
        write_catalog(rows, base, "orders", highest=HIGHEST, threshold=MOST, keep_overfull=True, default_columns=["o_orderkey", "ra", "dec"])
        _WRITTEN[key] = base
    return _WRITTEN[key]


def opened(spark: SparkSession, sf_dir: str) -> K.Catalog:
    return K.open_catalog(spark, stored(spark, sf_dir))


def _cells(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions and their rows, from the footers: those of ``MOST`` rows or fewer, as the SQL has
    them. A cell of order ``HIGHEST`` that holds more is a leaf of its own in the catalog, but in no
    partition of the SQL."""
    groups = [(metadata.single_value(g, "Norder"), metadata.single_value(g, "Npix"), g.num_rows) for g in metadata.row_groups(stored(spark, sf_dir))]
    sums = _cells(spark, groups, "Norder INT, Npix BIGINT, n BIGINT").groupBy("Norder", "Npix").agg(F.sum("n").alias("total"))
    return sums.where(F.col("total") <= MOST)


def _fitting(spark: SparkSession, sf_dir: str, df: DataFrame, side: str = "") -> DataFrame:
    """What is of partitions that the SQL has; of the whole catalog come the rows that it has of all orders."""
    held = _partitions(spark, sf_dir).select(F.col("Norder").alias(f"{side}Norder"), F.col("Npix").alias(f"{side}Npix"))
    return df.join(held, [f"{side}Norder", f"{side}Npix"], "left_semi")


def _fitting_leaves(spark: SparkSession, sf_dir: str, cat: K.Catalog) -> K.Catalog:
    """As ``_fitting``, told of the leaves, so that the files of others aren't opened."""
    return replace(cat, partitions=_fitting(spark, sf_dir, cat.partitions))


@query("stored_partitions", _PARTS)
def _(spark, d):
    return _partitions(spark, d)


@query("stored_partition_list", f"SELECT DISTINCT Norder, Npix FROM ({_ALIGNED})")
def _(spark, d):
    return _fitting(spark, d, opened(spark, d).partitions)


@query("stored_leaf_files", f"SELECT DISTINCT Norder, Npix FROM ({_ALIGNED})")
def _(spark, d):
    return _fitting(spark, d, _cells(spark, [paths.cell_of_path(f) for f in metadata.leaf_list(stored(spark, d))], "Norder INT, Npix BIGINT"))


@query("stored_rows", f"SELECT o_orderkey, Norder, Npix FROM ({_ROWS})")
def _(spark, d):
    return _fitting_leaves(spark, d, opened(spark, d)).rows(["o_orderkey", "Norder", "Npix"])


@query("stored_default_columns", f"SELECT o_orderkey, round(ra, 6) AS ra, round(dec, 6) AS dec FROM ({view_sql('orders')})")
def _(spark, d):
    return opened(spark, d).rows().select("o_orderkey", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


@query("stored_filtered_rows", f"SELECT o_orderkey FROM ({_ROWS}) WHERE Norder = 0 AND Npix IN (0, 4) OR pix >> {2 * HIGHEST} = 4 OR (Norder > 0 AND pix >> {2 * (HIGHEST - 1)} = 1)")
def _(spark, d):
    """The rows of the leaves that share sky with two cells of different orders."""
    return _fitting_leaves(spark, d, opened(spark, d).filter_pixels([(0, 4), (1, 1)])).rows(["o_orderkey"])


for _name, _region in {"cone": R.Cone(315.0, -20.0, 20 * 3600.0), "box": R.Box(ra=(350.0, 60.0), dec=(10.0, 60.0)), "small_cone": R.Cone(120.0, 10.0, 2 * 3600.0)}.items():

    @query(f"stored_{_name}_rows", f"SELECT o_orderkey FROM ({view_sql('orders')}) WHERE {_region.sql('ra', 'dec')}")
    def _(spark, d, region=_region):
        return opened(spark, d).search(region).select("o_orderkey")


@query("stored_coverage", Q._merged(Q.cell_moc_sql("orders", HIGHEST)))
def _(spark, d):
    return opened(spark, d).moc


@query("stored_sky_map", Q.hist_sql("orders", HIGHEST))
def _(spark, d):
    """A map of counts as a FITS file and back."""
    base = stored(spark, d)
    at = f"{base.rpartition('/')[0]}/{paths.SKY_MAP}"
    skymap.write_map(spark.read.parquet(f"{base}/{paths.POINT_MAP}"), HIGHEST, at)
    return skymap.read_counts(spark, at)[0]


@query("stored_statistics", " UNION ALL ".join(f"SELECT '{c}' AS column_names, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, count(*) - count({c}) AS null_count FROM orders" for c in ("o_orderkey", "o_custkey")))
def _(spark, d):
    """From the footers alone."""
    found = metadata.footer_statistics(spark, paths.pointer(stored(spark, d), paths.METADATA))
    return found.where(F.col("column_names").isin("o_orderkey", "o_custkey"))


@query("stored_schema", "SELECT unnest(['o_orderkey', 'o_custkey', 'ra', 'dec', '_healpix_29', 'Norder', 'Npix', 'Dir']) AS column_name")
def _(spark, d):
    return _cells(spark, [(c,) for c in opened(spark, d).schema.names], "column_name STRING")


@query("stored_properties", "SELECT 'orders' AS catalog_name, 'object' AS catalog_type, count(*) AS total_rows FROM orders")
def _(spark, d):
    p = opened(spark, d).properties
    return _cells(spark, [(p.catalog_name, p.catalog_type, p.total_rows)], "catalog_name STRING, catalog_type STRING, total_rows BIGINT")


@query("stored_validation", f"SELECT 0::BIGINT AS problems, count(*) AS leaves FROM ({_PARTS})")
def _(spark, d):
    base = stored(spark, d)
    leaves = _fitting(spark, d, _cells(spark, metadata.read_partitions(base), "Norder INT, Npix BIGINT")).count()
    return _cells(spark, [(len(list(validation.problems(spark, base))), leaves)], "problems BIGINT, leaves BIGINT")


@query("stored_index", f"SELECT DISTINCT Norder, Npix FROM ({_ROWS}) WHERE o_custkey IN (SELECT o_custkey FROM orders ORDER BY o_orderkey, o_custkey LIMIT 3)")
def _(spark, d):
    """Leaves that hold the customers of the first three orders (the values looked up), by an index on disk."""
    at = f"{shared.folder(spark, 'celestile-index')}/by_customer"
    stores.write_index(opened(spark, d), "o_custkey", at, "by_customer")
    wanted = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey").orderBy("o_orderkey", "o_custkey").limit(3)
    return _fitting(spark, d, K.open_catalog(spark, at).loc_partitions([r[0] for r in wanted.collect()]))


_SELF = f"SELECT DISTINCT a.Norder, a.Npix, b.Norder AS join_Norder, b.Npix AS join_Npix FROM ({_ROWS}) a JOIN ({_ROWS}) b ON a.o_custkey = b.o_custkey"


def _association(spark, d) -> str:
    at = f"{shared.folder(spark, 'celestile-association')}/same_customer"
    cat = opened(spark, d)
    stores.write_association(cat, cat, [("o_custkey", "o_custkey")], at, "same_customer")
    return at


@query("stored_association", _SELF)
def _(spark, d):
    return _fitting(spark, d, _fitting(spark, d, K.open_catalog(spark, _association(spark, d)).pairs), "join_").select(*metadata.PAIR)


@query("stored_association_footers", _SELF)
def _(spark, d):
    """From the row groups of the metadata file, one for each pair; of too many pairs for that, from the rows."""
    at = _association(spark, d)
    listed = paths.pointer(at, paths.METADATA)
    pairs = _cells(spark, metadata.pairs_from_metadata(listed, strict=True), "Norder INT, Npix BIGINT, join_Norder INT, join_Npix BIGINT") if paths.exists(listed) else metadata.pairs_table(spark, at)
    return _fitting(spark, d, _fitting(spark, d, pairs), "join_").select(*metadata.PAIR)


_FINE = hp.margin2order(60.0)
_AROUND, _NEAR = X.all_neighbours("p", _FINE, "duckdb")


@query("stored_margin", f"""WITH t AS ({_PARTS}), f AS (SELECT p, unnest([{', '.join(_NEAR)}]) AS near FROM ({X.nest(f'SELECT range AS p FROM range({12 << 2 * _FINE})', _AROUND)})),
    ring AS (SELECT DISTINCT Norder, Npix, near FROM f, t WHERE p >> (2 * ({_FINE} - Norder)) = Npix AND near IS NOT NULL AND near >> (2 * ({_FINE} - Norder)) <> Npix)
    SELECT o_orderkey, ring.Norder, ring.Npix FROM ({Q.pix_sql('orders', _FINE)}) r JOIN ring ON r.pix = ring.near""")
def _(spark, d):
    """Rows around each leaf, from a margin catalog on disk."""
    at = f"{shared.folder(spark, 'celestile-margin')}/around"
    stores.write_margin(opened(spark, d), 3600.0, at, "around")
    return _fitting(spark, d, K.open_catalog(spark, at).rows(["o_orderkey", "Norder", "Npix"])).select("o_orderkey", "Norder", "Npix")


@query("stored_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    at = f"{shared.folder(spark, 'celestile-csv')}/customer"
    files.write_csv(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_acctbal"), at)
    return files.read_csv(spark, at, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE")


@query("stored_align", f"SELECT Norder AS primary_Norder, Npix AS primary_Npix, Norder AS join_Norder, Npix AS join_Npix, Norder AS aligned_Norder, Npix AS aligned_Npix FROM ({_PARTS})")
def _(spark, d):
    cat = opened(spark, d)
    return _fitting(spark, d, cat.align(cat), "aligned_").select(*(f"{side}_{c}" for side in ("primary", "join", "aligned") for c in ("Norder", "Npix")))
