"""Queries over the driver's tables for every operator, each with SQL of its own.

The SQL shares the formulas of positions with the operators; set operations and joins
are written another way there: by comparing intervals, or by enumerating cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celestile.functions import formulas as X
from celestile.functions import healpix as hp
from celestile.functions.pixel import as_pixel
from celestile.operators import align as A
from celestile.operators import cells as C
from celestile.operators import joins as J
from celestile.operators import margins as G
from celestile.operators import moc as M
from celestile.operators import partition as T
from celestile.operators import regions as R
from celestile.operators import stats as S
from celestile.plans.sky import view, view_sql
from celestile.sources import paths as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ("l_orderkey", "l_partkey", "l_linenumber")
_KEY = ", ".join(KEY)
#: Trees that are aligned: partitions of two tables up to this order.
TOP = 4
SHARES = {"lineitem": 400, "orders": 1500}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# pieces of SQL
def pix_sql(table: str, order: int, *columns: str) -> str:
    return X.nest(view_sql(table, *columns), X.ang2pix("ra", "dec", order, "pix"))


def hist_sql(table: str, order: int) -> str:
    return f"SELECT pix, count(*) AS n FROM ({pix_sql(table, order)}) GROUP BY pix"


def sums_sql(hist: str, highest: int, lowest: int = 0) -> str:
    return f"SELECT o, pix >> (2 * ({highest} - o)) AS p, CAST(sum(n) AS BIGINT) AS n FROM ({hist}), (SELECT unnest(range({lowest}, {highest + 1}))::INT AS o) GROUP BY ALL"


def aligned_sql(hist: str, highest: int, threshold: str, drop: bool = False) -> str:
    ok = f"n <= {threshold}"
    if drop:
        ok = f"(o = {highest} OR ({ok} AND n <> (SELECT max(n) FROM sums c WHERE c.o = sums.o + 1 AND c.p >> 2 = sums.p)))"
    return f"""WITH h AS ({hist}), sums AS ({sums_sql('SELECT * FROM h', highest)}), ok AS (SELECT * FROM sums WHERE {ok}),
    best AS (SELECT h.pix, min(ok.o) AS o FROM h, ok WHERE h.pix >> (2 * ({highest} - ok.o)) = ok.p GROUP BY h.pix)
    SELECT best.pix, ok.o AS Norder, ok.p AS Npix, ok.n AS total FROM best JOIN ok ON ok.o = best.o AND ok.p = best.pix >> (2 * ({highest} - best.o))"""


def threshold(table: str) -> str:
    """Rows a partition may hold: a share of the table."""
    return f"(SELECT max(x) FROM (SELECT count(*) / {SHARES[table]} + 1 AS x FROM {table} UNION ALL SELECT max(n) FROM ({hist_sql(table, TOP)})))"


def tree_sql(table: str) -> str:
    lim = f"CAST(floor({threshold(table)}) AS BIGINT)"
    return f"SELECT DISTINCT Norder, Npix, Npix << (2 * (29 - Norder)) AS lo, (Npix + 1) << (2 * (29 - Norder)) AS hi FROM ({aligned_sql(hist_sql(table, TOP), TOP, lim)})"


def tree_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The partitions of a table, held by the driver as those of an opened catalog are. There
    are ``12 * 4 ** TOP`` cells at most, and one scan counts them."""
    counts = T.histogram(view(spark, sf_dir, table), TOP).toArrow()
    n = counts["n"].to_pylist()
    most = max(sum(n) // SHARES[table] + 1, *n, 0)
    held = T.partitions(T.alignment(spark.createDataFrame(counts), TOP, 0, most)).select("Norder", "Npix")
    return spark.createDataFrame(held.toArrow())


LEFT, RIGHT = tree_sql("lineitem"), tree_sql("orders")
BOTH = f"WITH l AS ({LEFT}), r AS ({RIGHT})"


def trees(spark, sf_dir):
    return tree_of(spark, sf_dir, "lineitem"), tree_of(spark, sf_dir, "orders")


# positions and indexes
@query("spatial_index_29", f"SELECT {_KEY}, pix AS _healpix_29 FROM ({pix_sql('lineitem', 29)})")
def _(spark, d):
    return hp.with_index(view(spark, d, "lineitem", *KEY)).select(*KEY, hp.INDEX_COLUMN)


@query("index_to_order8", f"SELECT {_KEY}, pix >> 42 AS pix8 FROM ({pix_sql('lineitem', 29)})")
def _(spark, d):
    return hp.with_index(view(spark, d, "lineitem", *KEY)).select(*KEY, hp.to_order(F.col(hp.INDEX_COLUMN), 8).alias("pix8"))


@query("order_to_index", f"SELECT DISTINCT pix, pix * {4**21} AS first_index FROM ({pix_sql('lineitem', 8)})")
def _(spark, d):
    return hp.with_pixel(view(spark, d, "lineitem"), "ra", "dec", 8, "pix").select("pix").distinct().select("pix", hp.to_index(F.col("pix"), 8).alias("first_index"))


@query("leaf_paths", f"SELECT DISTINCT pix, '/cat/dataset/Norder=8/Dir=' || CAST((pix // 10000) * 10000 AS VARCHAR) || '/Npix=' || CAST(pix AS VARCHAR) || '.parquet' AS path FROM ({pix_sql('lineitem', 8)})")
def _(spark, d):
    c = hp.with_pixel(view(spark, d, "lineitem"), "ra", "dec", 8, "pix").select("pix").distinct()
    return c.select("pix", P.leaf_path("/cat", F.lit(8), F.col("pix")).alias("path"))


@query("path_parse", f"SELECT DISTINCT 8 AS Norder, pix AS Npix FROM ({pix_sql('lineitem', 8)})")
def _(spark, d):
    return P.with_cell_of_path(QUERIES["leaf_paths"](spark, d), "path").select("Norder", "Npix")


@query("vectors", "SELECT o_orderkey, round(cos(radians(dec)) * cos(radians(ra)), 6) AS x, round(cos(radians(dec)) * sin(radians(ra)), 6) AS y, round(sin(radians(dec)), 6) AS z, round(ra, 6) AS ra_back, round(dec, 6) AS dec_back FROM (" + view_sql("orders") + ")")
def _(spark, d):
    v = hp.with_vector(view(spark, d, "orders"))
    return v.select("o_orderkey", *(F.round(c, 6).alias(c) for c in "xyz"), F.round(hp.vector_ra(F.col("x"), F.col("y")), 6).alias("ra_back"), F.round(hp.vector_dec(F.col("x"), F.col("y"), F.col("z")), 6).alias("dec_back"))


@query("wrap_ra", "SELECT o_orderkey, ((o_custkey - o_orderkey) % 360 + 360) % 360 AS wrapped FROM orders")
def _(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", hp.wrap_ra(F.col("o_custkey") - F.col("o_orderkey")).cast("long").alias("wrapped"))


@query("pix_centre", f"SELECT pix, round(clon, 6) AS ra, round(clat, 6) AS dec FROM ({X.nest(f'SELECT DISTINCT pix FROM ({pix_sql("orders", 6)})', X.pix2ang('pix', 6, 'clon', 'clat', 'duckdb'))})")
def _(spark, d):
    c = hp.with_pixel(view(spark, d, "orders"), "ra", "dec", 6, "pix").select("pix").distinct()
    return hp.with_centre(c, "pix", 6, "ra", "dec").select("pix", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


@query("pix_xyf", f"SELECT pix, x, y, face FROM ({X.nest(f'SELECT DISTINCT pix FROM ({pix_sql("orders", 6)})', X.pix2xyf('pix', 6, 'x', 'y', 'face'))})")
def _(spark, d):
    return hp.with_xyf(hp.with_pixel(view(spark, d, "orders"), "ra", "dec", 6, "pix").select("pix").distinct(), "pix", 6)


_STEPS, _NEAR = X.all_neighbours("pix", 3, "duckdb")


@query("neighbours", f"SELECT pix, k, near FROM (SELECT pix, unnest(range(8)) AS k, unnest([{', '.join(_NEAR)}]) AS near FROM ({X.nest('SELECT range AS pix FROM range(768)', _STEPS)})) WHERE near IS NOT NULL")
def _(spark, d):
    c = hp.with_neighbours(spark.range(768).withColumnRenamed("id", "pix"), "pix", 3)
    return c.select("pix", F.posexplode("neighbours").alias("k", "near")).where("near is not null").select("pix", F.col("k").cast("long").alias("k"), "near")


def _border_sql(order: int, step: int) -> str:
    n, dc, dd = float(1 << order), f"CAST({0.5 / (1 << order)!r} AS DOUBLE)", f"CAST({1 / (step * (1 << order))!r} AS DOUBLE)"
    q = X.nest(f"SELECT range AS pix FROM range({12 << 2 * order})", X.pix2xyf("pix", order, "qx", "qy", "qf"))
    q = f"SELECT *, s // {step} AS side, s % {step} AS i FROM (SELECT *, unnest(range({4 * step})) AS s FROM ({q}))"
    u = f"(qx + 0.5e0) / {n!r}e0 + CASE side WHEN 0 THEN {dc} - i * {dd} WHEN 1 THEN -{dc} WHEN 2 THEN i * {dd} - {dc} ELSE {dc} END"
    v = f"(qy + 0.5e0) / {n!r}e0 + CASE side WHEN 0 THEN {dc} WHEN 1 THEN {dc} - i * {dd} WHEN 2 THEN -{dc} ELSE i * {dd} - {dc} END"
    return X.nest(q, [{"bu": u, "bv": v}, *X.xyf2ang("bu", "bv", "qf", "ra", "dec", "duckdb")])


@query("pixel_boundaries", f"SELECT pix, CAST(s AS INT) AS sample, round(cos(radians(dec)) * cos(radians(ra)), 6) + 0.0 AS x, round(cos(radians(dec)) * sin(radians(ra)), 6) + 0.0 AS y, round(dec, 6) + 0.0 AS dec FROM ({_border_sql(1, 4)})")
def _(spark, d):
    b = hp.with_vector(hp.with_boundary(spark.range(48).withColumnRenamed("id", "pix"), "pix", 1, 4))
    return b.select("pix", "sample", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("x", "y", "dec")))


@query("separation", f"SELECT o_orderkey, round({X.separation('ra', 'dec', '45.0e0', '-30.0e0')}, 6) AS degrees_apart FROM ({view_sql('orders')})")
def _(spark, d):
    return view(spark, d, "orders").select("o_orderkey", F.round(hp.separation("ra", "dec", "45.0e0", "-30.0e0"), 6).alias("degrees_apart"))


@query("margin2order", "SELECT c_custkey, CAST(trunc(log2(sqrt(pi() / 3) / radians(((c_custkey + 1) / 100.0e0) * 1.6e0 / 60))) AS INT) AS margin_order FROM customer")
def _(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", hp.avgsize2order_col(hp.mindist2avgsize((F.col("c_custkey") + 1) / 100.0)).alias("margin_order"))


# plain numbers of orders and cells
_ORDERS = "SELECT unnest(range(30))::INT AS Norder"


@query("order_sizes", f"SELECT Norder, 1::BIGINT << Norder AS nside, 12::BIGINT << (2 * Norder) AS npix, round(41252.96124941927 / (12 * pow(4.0, Norder)) * pow(4.0, Norder), 6) AS sky_of_twelfth, round(60 * sqrt(41252.96124941927 / 12) * pow(0.5, Norder), 9) AS arcmin FROM ({_ORDERS})")
def _(spark, d):
    rows = [(o, hp.order2nside(o), hp.order2npix(o), hp.nside2pixarea(1 << o, degrees=True) * 4.0**o, hp.nside2resol(1 << o, arcmin=True)) for o in range(30) if hp.npix2order(hp.order2npix(o)) == hp.nside2order(1 << o) == o]
    df = spark.createDataFrame(rows, "Norder INT, nside BIGINT, npix BIGINT, sky_of_twelfth DOUBLE, arcmin DOUBLE")
    return df.withColumns({"sky_of_twelfth": F.round("sky_of_twelfth", 6), "arcmin": F.round("arcmin", 9)})


@query("size_conversions", "SELECT c_custkey, round((c_custkey + 1) / 160.0e0, 9) AS mindist, round((c_custkey + 1) * 0.016e0, 9) AS avgsize, CAST(trunc(log2(sqrt(pi() / 3) / radians((c_custkey + 1) / 6000.0e0))) AS INT) AS size_order FROM customer")
def _(spark, d):
    size = (F.col("c_custkey") + 1) / 100.0
    out = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", hp.avgsize2mindist(size).alias("mindist"), hp.mindist2avgsize(size).alias("avgsize"), hp.avgsize2order_col(size).alias("size_order"))
    return out.withColumns({c: F.round(c, 9) for c in ("mindist", "avgsize")})


@query("interval_cells", f"SELECT Norder, Npix FROM ({LEFT})")
def _(spark, d):
    """Cells back from the ranges they span."""
    c = C.with_bounds(tree_of(spark, d, "lineitem")).select("lo", "hi", hp.interval_order(F.col("lo"), F.col("hi"), 29).alias("Norder"))
    return c.select("Norder", F.call_function("shiftright", F.col("lo"), ((F.lit(29) - F.col("Norder")) * 2).cast("int")).alias("Npix"))


@query("pixel_text", f"SELECT Norder, Npix, 'Order: ' || Norder || ', Pixel: ' || Npix AS text FROM ({LEFT})")
def _(spark, d):
    rows = [(*(c := as_pixel(tuple(r))), str(c)) for r in tree_of(spark, d, "lineitem").collect()]  # a row a partition
    return spark.createDataFrame(rows, "Norder INT, Npix BIGINT, text STRING")


_CENTRES5 = X.nest("SELECT range AS pix FROM range(12288)", X.pix2ang("pix", 5, "cra", "cdec", "duckdb"))


@query("ring2nest", f"SELECT row_number() OVER (ORDER BY round(cdec, 8) DESC, round(cra, 8)) - 1 AS ring, pix FROM ({_CENTRES5})")
def _(spark, d):
    """Ring numbers are ranks of centres from the north, by right ascension within a ring."""
    return hp.with_nested(spark.range(12288).withColumnRenamed("id", "ring"), "ring", 5, "pix")


@query("strip_centres", f"SELECT 5 AS Norder, pix AS Npix FROM ({_CENTRES5}) WHERE cdec BETWEEN -12.5 AND 33.3")
def _(spark, d):
    return R.strip_cells(spark, 5, -12.5, 33.3, inclusive=False)


@query("polygon_centres", f"SELECT 5 AS Norder, pix AS Npix FROM ({_CENTRES5}) WHERE cra > 10.0 AND cra < 80.0 AND tan(radians(cdec)) > tan(radians(33.0e0)) * cos(radians(cra - 45.0)) / cos(radians(35.0e0))")
def _(spark, d):
    """A triangle with a corner at the pole, its sides written as two meridians and a great circle there."""
    return R.polygon_cells(spark, 5, ((10.0, 33.0), (80.0, 33.0), (0.0, 90.0)), inclusive=False)


# histograms and partitions
@query("hist_order5", f"SELECT pix, n FROM ({hist_sql('lineitem', 5)})")
def _(spark, d):
    return T.histogram(view(spark, d, "lineitem"), 5)


@query("hist_dense_order2", f"SELECT range AS pix, coalesce(n, 0) AS n FROM range(192) LEFT JOIN ({hist_sql('supplier', 2)}) ON range = pix")
def _(spark, d):
    return T.dense(T.histogram(view(spark, d, "supplier"), 2), 2)


@query("rollup_sums", sums_sql(hist_sql("lineitem", 5), 5))
def _(spark, d):
    return T.rollup(T.histogram(view(spark, d, "lineitem"), 5), 5)


def _fitting(counts: DataFrame) -> DataFrame:
    """The alignment of an order-5 histogram as its SQL has it: cells that hold more than 2000 rows
    themselves, which the operator keeps as partitions, are in none there."""
    return T.alignment(counts, 5, 0, 2000, keep_overfull=True).where("total <= 2000")


@query("align_threshold", aligned_sql(hist_sql("lineitem", 5), 5, "2000"))
def _(spark, d):
    return _fitting(T.histogram(view(spark, d, "lineitem"), 5))


@query("align_drop_siblings", aligned_sql(hist_sql("supplier", 5), 5, "40", True))
def _(spark, d):
    return T.alignment(T.histogram(view(spark, d, "supplier"), 5), 5, 0, 40, drop_empty_siblings=True, keep_overfull=True)


_ASSIGNED = f"SELECT a.Norder, a.Npix, count(*) AS n_rows, min(l_orderkey) AS first_key FROM ({pix_sql('lineitem', 5)}) r JOIN ({aligned_sql(hist_sql('lineitem', 5), 5, '2000')}) a USING (pix) GROUP BY ALL"


@query("assign_partitions", _ASSIGNED)
def _(spark, d):
    rows = hp.with_index(view(spark, d, "lineitem", "l_orderkey"))
    return T.assign(rows, _fitting(T.histogram_by_index(rows, 5)), 5).groupBy("Norder", "Npix").agg(F.count("*").alias("n_rows"), F.min("l_orderkey").alias("first_key"))


@query("partition_counts", f"SELECT DISTINCT Norder, Npix, total FROM ({aligned_sql(hist_sql('lineitem', 5), 5, '2000')})")
def _(spark, d):
    return T.partitions(QUERIES["align_threshold"](spark, d))


@query("size_bins", f"SELECT CASE WHEN total >= 1500 THEN 2 WHEN total >= 750 THEN 1 ELSE 0 END AS bin, count(*) AS n, CAST(sum(total) AS BIGINT) AS total, round(sum(total) / (SELECT sum(total) FROM (SELECT DISTINCT Norder, Npix, total FROM ({aligned_sql(hist_sql('lineitem', 5), 5, '2000')}))), 6) AS share FROM (SELECT DISTINCT Norder, Npix, total FROM ({aligned_sql(hist_sql('lineitem', 5), 5, '2000')})) GROUP BY 1")
def _(spark, d):
    return S.size_bins(QUERIES["partition_counts"](spark, d), "total", [750, 1500]).withColumn("share", F.round("share", 6))


# trees
@query("frac_coverage", f"SELECT round(sum({4 * math.pi * (180 / math.pi) ** 2 / 12!r} / pow(4.0, Norder)) / 41253, 9) AS coverage FROM ({LEFT})")
def _(spark, d):
    return C.coverage(tree_of(spark, d, "lineitem")).select(F.round("coverage", 9).alias("coverage"))


@query("max_order", f"SELECT max(Norder) AS max_order FROM ({RIGHT})")
def _(spark, d):
    return C.highest_order(tree_of(spark, d, "orders"))


@query("nested_sort_rank", f"SELECT Norder, Npix, row_number() OVER (ORDER BY lo) - 1 AS rank FROM ({RIGHT})")
def _(spark, d):
    return C.nested_rank(tree_of(spark, d, "orders")).select("Norder", "Npix", F.col("rank").cast("long").alias("rank"))


@query("tree_overlaps", f"{BOTH}, u AS (SELECT DISTINCT * FROM (SELECT * FROM l UNION ALL SELECT * FROM r)) SELECT a.Norder, a.Npix, b.Norder AS in_order, b.Npix AS in_pix FROM u a JOIN u b ON b.lo <= a.lo AND a.hi <= b.hi AND b.Norder < a.Norder")
def _(spark, d):
    l, r = trees(spark, d)
    return C.overlaps_within(l.unionByName(r).distinct())


@query("contains", f"{BOTH} SELECT r.Norder, r.Npix, EXISTS (SELECT 1 FROM l WHERE l.Norder = r.Norder AND l.Npix = r.Npix) AS contained FROM r")
def _(spark, d):
    l, r = trees(spark, d)
    return C.contains(l, r)


@query("filter_pixel_list", f"SELECT Norder, Npix FROM ({LEFT}) WHERE (lo < (9::BIGINT << 56) AND hi > (8::BIGINT << 56)) OR (Npix >> (2 * Norder)) IN (0, 7)")
def _(spark, d):
    return C.overlapping(tree_of(spark, d, "lineitem"), C.from_pixels(spark, [(0, 0), (1, 8), (0, 7)]))


@query("ancestors", f"SELECT Norder, Npix, o AS a_order, Npix >> (2 * (Norder - o)) AS a_pix FROM ({LEFT}), (SELECT unnest(range(0, 5))::INT AS o) WHERE o <= Norder")
def _(spark, d):
    return C.ancestors(tree_of(spark, d, "lineitem"))


@query("descendants", f"SELECT Norder + 2 AS Norder, unnest(range(Npix * 16, (Npix + 1) * 16)) AS Npix FROM ({LEFT})")
def _(spark, d):
    return C.descendants(tree_of(spark, d, "lineitem"), 2)


@query("order_map", f"SELECT unnest(range(lo >> 46, hi >> 46)) AS pix, Norder AS value FROM ({LEFT})")
def _(spark, d):
    """Each leaf as the cells of order 6 it is drawn with, and its order."""
    c = C.with_bounds(tree_of(spark, d, "lineitem"))
    return c.select(F.explode(F.sequence(F.shiftright("lo", 46), F.shiftright("hi", 46) - 1)).alias("pix"), F.col("Norder").alias("value"))


# coverage
def _merged(q: str) -> str:
    return f"SELECT min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(fresh) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT lo, hi, CASE WHEN lo <= max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({q}))) GROUP BY g"


def cell_moc_sql(table: str, order: int) -> str:
    s = 2 * (29 - order)
    return f"SELECT DISTINCT pix << {s} AS lo, (pix + 1) << {s} AS hi FROM ({pix_sql(table, order)})"


def cell_moc(spark, d, table, order):
    return M.from_cells(hp.with_pixel(view(spark, d, table), "ra", "dec", order, "Npix").select(F.lit(order).alias("Norder"), "Npix").distinct())


MOC_A, MOC_B = ("supplier", 3), ("customer", 4)


@query("moc_normalise", _merged(cell_moc_sql(*MOC_B)))
def _(spark, d):
    return cell_moc(spark, d, *MOC_B)


@query("moc_union", _merged(f"{cell_moc_sql(*MOC_A)} UNION ALL {cell_moc_sql(*MOC_B)}"))
def _(spark, d):
    return M.union(cell_moc(spark, d, *MOC_A), cell_moc(spark, d, *MOC_B))


_INTERSECT = _merged(f"SELECT greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM ({_merged(cell_moc_sql(*MOC_A))}) a JOIN ({_merged(cell_moc_sql(*MOC_B))}) b ON a.lo < b.hi AND b.lo < a.hi")


@query("moc_intersection", _INTERSECT)
def _(spark, d):
    return M.intersection(cell_moc(spark, d, *MOC_A), cell_moc(spark, d, *MOC_B))


@query("moc_cells", f"SELECT DISTINCT CAST(o AS INT) AS Norder, p AS Npix FROM (SELECT o, unnest(range((lo + (1::BIGINT << s) - 1) >> s, hi >> s)) AS p, s, lo AS a, hi AS b FROM ({_merged(cell_moc_sql(*MOC_B))}), (SELECT unnest(range(0, 5)) AS o, 2 * (29 - unnest(range(0, 5))) AS s)) WHERE o = 0 OR NOT ((p >> 2) << (s + 2) >= a AND ((p >> 2) + 1) << (s + 2) <= b)")
def _(spark, d):
    return M.to_cells(cell_moc(spark, d, *MOC_B))


_GROW_STEPS, _GROW_NEAR = X.all_neighbours("pix", 3, "duckdb")
_GROWN = f"SELECT unnest([pix, {', '.join(_GROW_NEAR)}]) AS p FROM ({X.nest(f'SELECT DISTINCT pix FROM ({pix_sql("supplier", 3)})', _GROW_STEPS)})"
_GROWN_MOC = _merged(f"SELECT DISTINCT p << 52 AS lo, (p + 1) << 52 AS hi FROM ({_GROWN}) WHERE p IS NOT NULL")


@query("moc_grow", _GROWN_MOC)
def _(spark, d):
    return M.grow(cell_moc(spark, d, *MOC_A), 3)


@query("filter_moc", f"WITH m AS ({cell_moc_sql(*MOC_A)}) SELECT Norder, Npix FROM ({LEFT}) t WHERE EXISTS (SELECT 1 FROM m WHERE m.lo < t.hi AND t.lo < m.hi)")
def _(spark, d):
    return M.filter_cells(tree_of(spark, d, "lineitem"), cell_moc(spark, d, *MOC_A))


@query("margin_filter", f"WITH m AS ({_GROWN_MOC}) SELECT Norder, Npix FROM ({LEFT}) t WHERE EXISTS (SELECT 1 FROM m WHERE m.lo < t.hi AND t.lo < m.hi)")
def _(spark, d):
    return G.filter_margin(tree_of(spark, d, "lineitem"), cell_moc(spark, d, *MOC_A), 3, 3600)


# alignment
_INNER = "SELECT l.Norder AS primary_Norder, l.Npix AS primary_Npix, r.Norder AS join_Norder, r.Npix AS join_Npix, CASE WHEN l.Norder >= r.Norder THEN l.Norder ELSE r.Norder END AS aligned_Norder, CASE WHEN l.Norder >= r.Norder THEN l.Npix ELSE r.Npix END AS aligned_Npix FROM l JOIN r ON l.lo < r.hi AND r.lo < l.hi"


def _gaps(own: str, other: str) -> str:
    """Parts of each own cell that meet no other cell while their parents do, or are the cell itself."""
    part = f"SELECT Norder AS co, Npix AS cp, o, unnest(range(Npix << (2 * (o - Norder)), (Npix + 1) << (2 * (o - Norder)))) AS p FROM {own}, (SELECT unnest(range(0, {TOP + 1}))::INT AS o) WHERE o >= Norder"
    meets = lambda p, o: f"EXISTS (SELECT 1 FROM {other} x WHERE x.lo < (({p}) + 1) << (2 * (29 - ({o}))) AND (({p}) << (2 * (29 - ({o})))) < x.hi)"
    return f"SELECT co, cp, o, p FROM ({part}) WHERE NOT {meets('p', 'o')} AND (o = co OR {meets('p >> 2', 'o - 1')})"


_LEFT_ONLY = f"SELECT co, cp, NULL::INT, NULL::BIGINT, o, p FROM ({_gaps('l', 'r')})"
_RIGHT_ONLY = f"SELECT NULL::INT, NULL::BIGINT, co, cp, o, p FROM ({_gaps('r', 'l')})"
_ALIGN = {"inner": _INNER, "left": f"{_INNER} UNION ALL {_LEFT_ONLY}", "right": f"{_INNER} UNION ALL {_RIGHT_ONLY}", "outer": f"{_INNER} UNION ALL {_LEFT_ONLY} UNION ALL {_RIGHT_ONLY}"}


def _align_query(how: str):
    @query(f"align_{how}", f"{BOTH} {_ALIGN[how]}")
    def _(spark, d):
        l, r = trees(spark, d)
        return A.align(l, r, how)


for _how in _ALIGN:
    _align_query(_how)


@query("align_with_mocs", f"{BOTH}, m AS ({_INTERSECT}) SELECT * FROM ({_INNER}) a WHERE EXISTS (SELECT 1 FROM m WHERE m.lo < (aligned_Npix + 1) << (2 * (29 - aligned_Norder)) AND aligned_Npix << (2 * (29 - aligned_Norder)) < m.hi)")
def _(spark, d):
    l, r = trees(spark, d)
    return A.align_with_mocs(l, r, cell_moc(spark, d, *MOC_A), cell_moc(spark, d, *MOC_B))


@query("filtered_pixel_list", f"{BOTH} SELECT DISTINCT l.Norder, l.Npix FROM l JOIN r ON l.lo < r.hi AND r.lo < l.hi")
def _(spark, d):
    return A.filtered_cells(*trees(spark, d))


_SPARSE = f"SELECT 3 AS Norder, pix AS Npix, pix << 52 AS lo, (pix + 1) << 52 AS hi FROM (SELECT DISTINCT pix FROM ({pix_sql('supplier', 3)}))"


@query("negative_tree", f"WITH t AS ({_SPARSE}), c AS (SELECT o, unnest(range(12::BIGINT << (2 * o))) AS p FROM (SELECT unnest(range(0, 4))::INT AS o)), f AS (SELECT o, p FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.lo < (p + 1) << (2 * (29 - o)) AND p << (2 * (29 - o)) < t.hi)) SELECT o AS Norder, p AS Npix FROM f WHERE o = 0 OR NOT EXISTS (SELECT 1 FROM f u WHERE u.o = f.o - 1 AND u.p = f.p >> 2)")
def _(spark, d):
    return C.negative(hp.with_pixel(view(spark, d, "supplier"), "ra", "dec", 3, "Npix").select(F.lit(3).alias("Norder"), "Npix").distinct())


@query("validation_sets", f"SELECT 0::BIGINT AS only_planned, 0::BIGINT AS only_found, count(*) AS same FROM (SELECT DISTINCT Norder, Npix FROM ({aligned_sql(hist_sql('lineitem', 5), 5, '2000')}))")
def _(spark, d):
    """Planned partitions against those that rows are in."""
    planned = QUERIES["partition_counts"](spark, d).select("Norder", "Npix", F.lit(1).alias("a"))
    found = QUERIES["assign_partitions"](spark, d).select("Norder", "Npix", F.lit(1).alias("b"))
    both = planned.join(found, ["Norder", "Npix"], "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_planned"), F.count_if(F.col("a").isNull()).alias("only_found"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("same"))


# regions
REGIONS = {
    "cone": R.Cone(315.0, -20.0, 20 * 3600.0), "box_ra": R.Box(ra=(100.0, 160.0)), "box_ra_wrap": R.Box(ra=(330.0, 40.0)), "box_ra_wide": R.Box(ra=(20.0, 310.0)),
    "box_dec": R.Box(dec=(-10.0, 25.0)), "box_both": R.Box(ra=(350.0, 60.0), dec=(10.0, 60.0)), "polygon": R.Polygon(((300.0, -50.0), (300.0, -10.0), (340.0, -12.0), (335.0, -55.0))),
}


def _region_queries(name: str, region: R.Region) -> None:
    @query(f"{name}_rows", f"SELECT {_KEY} FROM ({view_sql('lineitem')}) WHERE {region.sql('ra', 'dec')}")
    def _(spark, d):
        return R.search(hp.with_index(view(spark, d, "lineitem", *KEY)), region, order=5).select(*KEY)

    centres = X.nest("SELECT range AS Npix FROM range(3072)", X.pix2ang("Npix", 4, "cra", "cdec", "duckdb"))

    @query(f"{name}_cells", f"SELECT 4 AS Norder, Npix FROM ({centres}) WHERE {region.sql('cra', 'cdec', hp.cell_radius(4))}")
    def _(spark, d):
        return R.cover(spark, region, 4)

    cover = f"SELECT Npix << 50 AS lo, (Npix + 1) << 50 AS hi FROM ({centres}) WHERE {region.sql('cra', 'cdec', hp.cell_radius(4))}"

    @query(f"{name}_leaves", f"WITH t AS ({LEFT}), m AS ({cover}) SELECT Norder, Npix FROM t WHERE EXISTS (SELECT 1 FROM m WHERE m.lo < t.hi AND t.lo < m.hi)")
    def _(spark, d):
        return R.filter_leaves(tree_of(spark, d, "lineitem"), region, 4)


for _name, _region in REGIONS.items():
    _region_queries(_name, _region)


# margins
def _on_border(q: str, side: str, steps: int, turned: int = 1) -> str:
    """Whether part ``q`` of a cell lies along a side, by its bits of x and of y: all 0, all 1 or any."""
    tests = []
    for steps_to, at in ((X.NEAR_X, 0), (X.NEAR_Y, 1)):
        mask = sum(1 << 2 * i + at for i in range(steps))
        to = X.pick(tuple(turned * d for d in steps_to), side, "duckdb")
        tests.append(f"CASE {to} WHEN -1 THEN q_ & {mask} = 0 WHEN 1 THEN q_ & {mask} = {mask} ELSE true END".replace("q_", f"({q})"))
    return " AND ".join(f"({t})" for t in tests)


@query("edge_cells", f"SELECT pix, which, (pix << 6) + q AS edge_pix FROM (SELECT range AS pix, unnest(range(8)) AS which FROM range(48)), (SELECT range AS q FROM range(64)) WHERE {_on_border('q', 'which', 3, -1)}")
def _(spark, d):
    c = spark.range(48).select(F.col("id").alias("pix"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("which"))
    return c.select("pix", "which", F.explode(G.edge_cells(F.col("pix"), F.col("which"), 3)).alias("edge_pix"))


def _margin_sql(order: int, steps: int) -> str:
    """All cells of the finer order, each with its neighbours across those sides of the coarse cell that it lies along."""
    near_steps, near = X.all_neighbours("p", order + steps, "duckdb")
    fine = X.nest(f"SELECT range AS p FROM range({12 << 2 * (order + steps)})", near_steps)
    sides = f"SELECT p >> {2 * steps} AS cell, p & {(1 << 2 * steps) - 1} AS q, unnest(range(8)) AS side, unnest([{', '.join(near)}]) AS margin_pix FROM ({fine})"
    return f"SELECT cell, side, margin_pix FROM ({sides}) WHERE margin_pix IS NOT NULL AND {_on_border('q', 'side', steps)}"


@query("margin_cells", _margin_sql(2, 2))
def _(spark, d):
    m = G.margin_cells(spark.range(192).withColumnRenamed("id", "Npix"), 2, 2)
    return m.select("cell", F.col("side").cast("long").alias("side"), "margin_pix")


@query("margin_rows", f"SELECT {_KEY}, m.cell AS margin_cell FROM ({pix_sql('lineitem', 5)}) r JOIN (SELECT DISTINCT cell, margin_pix FROM ({_margin_sql(2, 3)})) m ON r.pix = m.margin_pix")
def _(spark, d):
    rows = hp.with_pixel(view(spark, d, "lineitem", *KEY), "ra", "dec", 5, "fine").withColumn("cell", F.shiftright("fine", 6))
    ring = G.margin_cells(spark.range(192).withColumnRenamed("id", "Npix"), 2, 3).select(F.col("cell").alias("margin_cell"), F.col("margin_pix").alias("fine")).distinct()
    return rows.join(ring, "fine").select(*KEY, "margin_cell")


def near_sql(order: int, pixel: int, step: int, arcsec: float, points: str) -> str:
    n, most = 4 * step, X.separation("p.ra", "p.dec", "b.bra", "b.bdec")
    gap = X.separation("u.bra", "u.bdec", "v.bra", "v.bdec")
    angle = "acos(greatest(-1.0e0, least(1.0e0, (cos(y) - cos(x) * cos(z)) / (sin(x) * sin(z)))))"
    return f"""WITH b AS (SELECT s, ra AS bra, dec AS bdec FROM ({_border_sql(order, step)}) WHERE pix = {pixel}),
    g AS (SELECT u.s, {gap} AS gap FROM b u JOIN b v ON v.s = (u.s + {n - 1}) % {n}),
    d AS (SELECT o_orderkey, s, {most} AS m FROM ({points}) p, b),
    n AS (SELECT o_orderkey, s AS k, m AS near FROM d QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY m, s) = 1),
    t AS (SELECT n.*, f.m AS bef, a.m AS aft FROM n JOIN d f ON f.o_orderkey = n.o_orderkey AND f.s = (n.k + {n - 1}) % {n} JOIN d a ON a.o_orderkey = n.o_orderkey AND a.s = (n.k + 1) % {n}),
    h AS (SELECT o_orderkey, near, radians(least(bef, aft)) AS x, radians(near) AS y, radians(gap) AS z FROM t JOIN g ON g.s = CASE WHEN aft <= bef THEN k ELSE (k + {n - 1}) % {n} END)
    SELECT o_orderkey, near <= {arcsec / 3600!r} OR degrees(asin(sin({angle}) * sin(x))) <= {arcsec / 3600!r} AS in_margin FROM h"""


@query("near_boundary")
def _(spark, d):
    """All orders against a cell's boundary. Its SQL takes too long on a whole table; ``near_sql`` is for small ones."""
    return G.near_boundary(view(spark, d, "orders", "o_orderkey"), 1, 3, 7200.0).select("o_orderkey", "in_margin")


# indexes, associations, matches
_PLACED = f"SELECT r.*, a.Norder, a.Npix FROM ({pix_sql('lineitem', 5)}) r JOIN ({aligned_sql(hist_sql('lineitem', 5), 5, '2000')}) a USING (pix)"


def _placed(spark, d, *columns):
    rows = hp.with_index(view(spark, d, "lineitem", *columns))
    return T.assign(rows, _fitting(T.histogram_by_index(rows, 5)), 5)


@query("index_build", f"SELECT DISTINCT l_partkey, Norder, Npix FROM ({_PLACED})")
def _(spark, d):
    return J.build_index(_placed(spark, d, "l_partkey"), "l_partkey").select("l_partkey", "Norder", "Npix").distinct()


@query("index_lookup", f"SELECT DISTINCT Norder, Npix FROM ({_PLACED}) WHERE l_partkey IN (7, 70, 99999999)")
def _(spark, d):
    return J.lookup(J.build_index(_placed(spark, d, "l_partkey"), "l_partkey"), "l_partkey", [7, 70, 99999999])


_ORDERS_PLACED = f"SELECT r.o_orderkey, r.o_custkey, r.pix FROM ({pix_sql('orders', 1)}) r"
_CUSTOMERS_PLACED = f"SELECT r.c_custkey, r.pix FROM ({pix_sql('customer', 2)}) r"
_ASSOCIATED = f"SELECT 1 AS Norder, o.pix AS Npix, 2 AS join_Norder, c.pix AS join_Npix, count(*) AS n FROM ({_ORDERS_PLACED}) o JOIN ({_CUSTOMERS_PLACED}) c ON o_custkey = c_custkey GROUP BY ALL"


def _pairs(spark, d):
    o = hp.with_pixel(view(spark, d, "orders"), "ra", "dec", 1, "Npix").withColumn("Norder", F.lit(1))
    c = hp.with_pixel(view(spark, d, "customer"), "ra", "dec", 2, "Npix").withColumn("Norder", F.lit(2))
    return J.associate(o, c, [("o_custkey", "c_custkey")])


@query("assoc_pairs", _ASSOCIATED)
def _(spark, d):
    return _pairs(spark, d)


@query("assoc_map", f"SELECT Norder, Npix, count(*) AS n_joins, CAST(sum(join_Npix) AS BIGINT) AS join_sum FROM ({_ASSOCIATED}) GROUP BY ALL")
def _(spark, d):
    m = J.join_map(_pairs(spark, d))
    return m.select("Norder", "Npix", F.size("joins").cast("long").alias("n_joins"), F.aggregate("joins", F.lit(0).cast("long"), lambda a, j: a + j["join_Npix"]).alias("join_sum"))


@query("assoc_join", "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    return J.join_rows(spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet"), "o_custkey", "c_custkey").select("o_orderkey", "c_custkey", "c_mktsegment")


@query("crossmatch", f"SELECT s_suppkey, o_orderkey, round({X.separation('s.ra', 's.dec', 'o.ra', 'o.dec')} * 3600, 3) AS arcsec FROM ({view_sql('supplier')}) s JOIN ({view_sql('orders')}) o ON {X.separation('s.ra', 's.dec', 'o.ra', 'o.dec')} * 3600 <= 4000.0e0")
def _(spark, d):
    m = J.cross_match(view(spark, d, "supplier"), view(spark, d, "orders"), 4000.0, "s_suppkey", "o_orderkey")
    return m.withColumn("arcsec", F.round("arcsec", 3))


# statistics
_STATS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("column_stats", " UNION ALL ".join(f"SELECT '{c}' AS column_names, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, count(*) - count({c}) AS null_count FROM orders" for c in _STATS))
def _(spark, d):
    return S.column_statistics(spark.read.parquet(f"{d}/orders.parquet"), include=list(_STATS))


@query("null_counts", "SELECT 'text' AS column_names, count(*) - count(text) AS null_count FROM documents UNION ALL SELECT 'lang', count(*) - count(lang) FROM documents")
def _(spark, d):
    return S.column_statistics(spark.read.parquet(f"{d}/documents.parquet"), include=["text", "lang"]).select("column_names", "null_count")
