"""Comparing a Spark result with DuckDB's, as multisets of rows with columns by name."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(directory):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{directory}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}" if v else "0"
    return str(v)


def multiset(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql):
    got = multiset(df.columns, df.collect())
    rel = con.execute(sql)
    want = multiset([c[0] for c in rel.description], rel.fetchall())
    assert got[0] == want[0]
    assert sum(got[1].values()) == sum(want[1].values())
    assert got[1] == want[1], list((got[1] - want[1]).items())[:3] + list((want[1] - got[1]).items())[:3]
