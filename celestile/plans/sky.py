"""Deterministic sky positions for the tables at hand, the same text in any SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: table -> (columns of ra in hundredths of a degree, of dec)
KEYS = {
    "lineitem": ("l_orderkey * 137 + l_partkey * 59 + l_linenumber * 7", "l_partkey * 89 + l_suppkey * 31 + l_linenumber * 13"),
    "orders": ("o_orderkey * 137 + o_custkey * 59", "o_orderkey * 89 + o_custkey * 31"),
    "customer": ("c_custkey * 1371 + c_nationkey * 59", "c_custkey * 893 + c_nationkey * 31"),
    "supplier": ("s_suppkey * 3571 + s_nationkey * 59", "s_suppkey * 1789 + s_nationkey * 31"),
    "part": ("p_partkey * 137 + p_size * 59", "p_partkey * 89 + p_size * 31"),
    "events": ("event_id * 137 + user_id * 59", "event_id * 89 + user_id * 31"),
}


def position(table: str) -> tuple[str, str]:
    a, b = KEYS[table]
    return f"(({a}) % 36000) / 100.0e0", f"(({b}) % 17999) / 100.0e0 - 89.99e0"


def view(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The table with ``ra`` and ``dec``; only the named columns, if any."""
    ra, dec = position(table)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(columns or ("*",)), f"{ra} AS ra", f"{dec} AS dec")


def view_sql(table: str, *columns: str) -> str:
    ra, dec = position(table)
    return f"SELECT {', '.join(columns or ('*',))}, {ra} AS ra, {dec} AS dec FROM {table}"
