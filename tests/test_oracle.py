"""Every query of the core against its SQL."""

from pathlib import Path

import pytest

from celestile.plans import queries as Q
from celestile.sources import paths
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_sql(spark, small, con, name):
    assert_same(Q.QUERIES[name](spark, small), con, Q.ORACLE_SQL[name])


#: Added to an order's key, this leaves its position.
SAME_PLACE = 36000 * 17999


@pytest.fixture(scope="module")
def crowded(small, tmp_path_factory):
    """The small tables with 2100 line items more in one cell and 250 orders more in another."""
    d, con = tmp_path_factory.mktemp("crowded"), connect(small)
    for t, key, n in (("lineitem", "l_orderkey", 2100), ("orders", "o_orderkey", 250)):
        more = f"SELECT * REPLACE ({key} + (i + 1) * {SAME_PLACE} AS {key}) FROM (FROM {t} ORDER BY ALL LIMIT 1), range({n}) r(i)"
        con.execute(f"COPY (FROM {t} UNION ALL SELECT * EXCLUDE (i) FROM ({more})) TO '{d}/{t}.parquet'")
    for f in Path(small).iterdir():
        if not (d / f.name).exists():
            (d / f.name).symlink_to(f)
    return str(d)


@pytest.mark.parametrize("name", ["align_threshold", "assign_partitions", "index_build", "index_lookup", "partition_counts", "size_bins", "validation_sets", *sorted(n for n in Q.ORACLE_SQL if n.startswith("stored_") and n != "stored_csv")])
def test_overfull_cells_as_sql(spark, crowded, name):
    assert_same(Q.QUERIES[name](spark, crowded), connect(crowded), Q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["stored_rows", "stored_filtered_rows"])
def test_leaves_in_no_partition_are_not_opened(spark, crowded, name):
    held = {tuple(r) for r in Q.QUERIES["stored_partition_list"](spark, crowded).collect()}
    opened = {paths.cell_of_path(f) for f in Q.QUERIES[name](spark, crowded).inputFiles()}
    assert opened and opened <= held


def test_near_boundary_as_sql_on_some_points(spark, small, con):
    from celestile.plans.sky import view_sql

    some = "o_orderkey % 40 = 0"
    got = Q.QUERIES["near_boundary"](spark, small).where(some)
    assert_same(got, con, Q.near_sql(1, 3, 100, 7200.0, f"SELECT o_orderkey, ra, dec FROM ({view_sql('orders')}) WHERE {some}"))


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
