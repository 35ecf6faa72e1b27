"""Parquet footers: partition lists, statistics, combined metadata files.

Footers of leaf files are read on the executors where there are many; what reaches the
driver is a row for each row group.
"""

from __future__ import annotations

import csv
import io
import warnings
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from celestile.sources import paths as P

PAIR = ("Norder", "Npix", "join_Norder", "join_Npix")


def read_footer(path: str) -> pq.FileMetaData:
    if not P.exists(path):
        raise FileNotFoundError(f"no parquet file at {path}")
    where, at = P.located(path)
    return pq.read_metadata(at, filesystem=where)


def read_schema(path: str) -> pa.Schema:
    where, at = P.located(path)
    return pq.read_schema(at, filesystem=where)


def row_groups(path: str) -> Iterator[pq.RowGroupMetaData]:
    """The row groups of a metadata file, or of that of a catalog directory."""
    where = P.pointer(path, P.METADATA) if P.is_directory(path) else path
    footer = read_footer(where)
    for i in range(footer.num_row_groups):
        yield footer.row_group(i)


def statistics(group: pq.RowGroupMetaData) -> dict[str, pq.Statistics | None]:
    return {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}


def single_value(group: pq.RowGroupMetaData, column: str):
    """The value all rows of a group share."""
    stats = statistics(group)
    if column not in stats:
        raise ValueError(f"no column {column}")
    s = stats[column]
    if s is None or not s.has_min_max or s.min != s.max:
        raise ValueError(f"{column} has more than one value in a row group")
    return s.min


def _cells(path: str, columns: tuple[str, ...], strict: bool) -> list[tuple[int, ...]]:
    out = []
    for g in row_groups(path):
        stats = statistics(g)
        if missing := [c for c in columns if c not in stats]:
            raise ValueError(f"no column {', '.join(missing)} in {path}")
        out.append(tuple(int(single_value(g, c)) if strict else int(stats[c].min) for c in columns))
    return out


def partitions_from_metadata(path: str, strict: bool = False) -> list[tuple[int, int]]:
    """Cells by row group, once each, in their order. Unless ``strict``, minima are trusted."""
    return list(dict.fromkeys(_cells(path, PAIR[:2], strict)))


def pairs_from_metadata(path: str, strict: bool = False) -> list[tuple[int, int, int, int]]:
    return _cells(path, PAIR, strict)


def _csv(path: str, columns: tuple[str, ...]) -> list[tuple[int, ...]]:
    rows = list(csv.DictReader(io.StringIO(P.read_text(path))))
    if rows and (missing := [c for c in columns if c not in rows[0]]):
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    return [tuple(int(float(r[c])) for c in columns) for r in rows]


def partitions_from_csv(path: str) -> list[tuple[int, int]]:
    return list(dict.fromkeys(_csv(path, PAIR[:2])))


def pairs_from_csv(path: str) -> list[tuple[int, int, int, int]]:
    return _csv(path, PAIR)


def read_partitions(base: str) -> list[tuple[int, int]]:
    """The cells of a catalog: from the small CSV file, else from the metadata file."""
    return _either(base, P.INFO, partitions_from_csv, partitions_from_metadata)


def read_pairs(base: str) -> list[tuple[int, int, int, int]]:
    return _either(base, P.JOIN_INFO, pairs_from_csv, pairs_from_metadata)


def pairs_table(spark: SparkSession, base: str) -> DataFrame:
    """The pairs of an association: from its small files, else, where there are many, from its rows."""
    if not any(P.exists(P.pointer(base, f)) for f in (P.JOIN_INFO, P.METADATA)) and P.find_files(f"{str(base).rstrip('/')}/{P.DATASET}", "*.parquet"):
        return spark.read.parquet(f"{base}/{P.DATASET}").select(*PAIR)
    return spark.createDataFrame(read_pairs(base), "Norder INT, Npix BIGINT, join_Norder INT, join_Npix BIGINT")


def _either(base: str, name: str, of_csv, of_metadata):
    if P.exists(P.pointer(base, name)):
        return of_csv(P.pointer(base, name))
    if P.exists(P.pointer(base, P.METADATA)):
        warnings.warn(f"{base} has no {name}; reading the metadata file is slower", stacklevel=3)
        return of_metadata(P.pointer(base, P.METADATA))
    raise FileNotFoundError(f"{base} has neither {name} nor {P.METADATA}")


def write_csv(path: str, columns: tuple[str, ...], rows: list[tuple]) -> None:
    text = io.StringIO()
    w = csv.writer(text, lineterminator="\n")
    w.writerow(columns)
    w.writerows(rows)
    P.write_text(path, text.getvalue())


def write_partitions(base: str | None, cells: list, path: str | None = None) -> None:
    if not (path or base):
        raise ValueError("give a catalog or a file")
    write_csv(path or P.pointer(base, P.INFO), PAIR[:2], cells)


def write_pairs(base: str, pairs: list) -> None:
    """Both CSV files of an association: its pairs, and their primary cells once each."""
    write_csv(P.pointer(base, P.JOIN_INFO), PAIR, pairs)
    write_partitions(base, list(dict.fromkeys(p[:2] for p in pairs)))


def write_cells_metadata(base: str, rows: list[tuple[int, ...]], columns: tuple[str, ...] = PAIR[:2]) -> int:
    """Metadata files whose row groups stand for cells or pairs of them; returns their number."""
    P.make_directory(f"{base}/{P.DATASET}", exist_ok=True)
    schema = pa.schema([(c, pa.int64()) for c in columns])
    where, at = P.located(P.pointer(base, P.METADATA))
    with pq.ParquetWriter(at, schema, filesystem=where) as w:
        for r in rows:
            w.write_table(pa.table({c: [v] for c, v in zip(columns, r)}, schema))
    pq.write_metadata(schema, P.located(P.pointer(base, P.COMMON))[1], filesystem=where)
    return len(rows)


def leaf_list(base: str) -> list[str]:
    """The leaf files of a catalog, as paths of its file system."""
    top = f"{P.located(base)[1]}/{P.DATASET}"
    return [f for f in P.find_files(f"{str(base).rstrip('/')}/{P.DATASET}", "*.parquet") if not f[len(top) + 1 :].startswith("intermediate")]


def cell_of_footer(footer: pq.FileMetaData, order: str = "Norder", pixel: str = "Npix") -> tuple[int, int]:
    if not footer.num_row_groups:
        raise ValueError("no row groups")
    return int(single_value(footer.row_group(0), order)), int(single_value(footer.row_group(0), pixel))


#: Above this many leaf files footers are read by the executors.
MANY_FOOTERS = 2000


def _footers(files: list[str], where, spark: SparkSession | None) -> Iterator[pq.FileMetaData]:
    if spark is None or len(files) <= MANY_FOOTERS:
        yield from (pq.read_metadata(f, filesystem=where) for f in files)
        return

    def read(batches):
        for b in batches:
            got = [pq.read_metadata(f, filesystem=where) for f in b.column("f").to_pylist()]
            kept = []
            for m in got:
                sink = pa.BufferOutputStream()
                m.write_metadata_file(sink)
                kept.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(kept, pa.binary())], ["i", "m"])

    df = spark.createDataFrame(list(enumerate(files)), "i long, f string").repartition(max(1, len(files) // 200))
    for r in df.mapInArrow(read, "i long, m binary").orderBy("i").toLocalIterator():
        yield pq.read_metadata(pa.BufferReader(bytes(r["m"])))


def write_metadata(base: str, by_cell: bool = True, out: str | None = None, spark: SparkSession | None = None) -> int:
    """Combine the footers of all leaf files into the two metadata files, row groups along
    the nested curve unless ``by_cell`` is false; returns the number of rows. With a
    session the footers of many files are read by the executors."""
    where = P.located(base)[0]
    top = f"{P.located(base)[1]}/{P.DATASET}"
    found, total, schema = [], 0, None
    files = leaf_list(base)
    for f, footer in zip(files, _footers(files, where, spark)):
        footer.set_file_path(f[len(top) + 1 :])
        cell = P.cell_of_path(f[len(top) :]) if by_cell else (0, 0)
        if by_cell and cell == P.INVALID:
            cell = cell_of_footer(footer)
        found.append((cell[1] << 2 * (29 - cell[0]), len(found), footer))
        total += footer.num_rows
        schema = schema or pq.read_schema(f, filesystem=where)
    if schema is None:
        raise FileNotFoundError(f"no leaf files under {top}")
    into = out or base
    P.make_directory(f"{into}/{P.DATASET}", exist_ok=True)
    to = P.located(into)[0]
    found.sort(key=lambda x: x[:2])
    pq.write_metadata(schema, P.located(P.pointer(into, P.METADATA))[1], metadata_collector=[x[2] for x in found], filesystem=to)
    pq.write_metadata(schema, P.located(P.pointer(into, P.COMMON))[1], filesystem=to)
    return total


def footer_statistics(spark: SparkSession, path: str) -> DataFrame:
    """``(column_names, min_value, max_value, null_count)`` from a metadata file alone."""
    best: dict[str, list] = {}
    for g in row_groups(path):
        for name, s in statistics(g).items():
            lo, hi, nulls = best.setdefault(name, [None, None, 0])
            if s is not None and s.has_min_max:
                lo, hi = (s.min if lo is None else min(lo, s.min)), (s.max if hi is None else max(hi, s.max))
            best[name] = [lo, hi, nulls + (s.null_count or 0 if s is not None else 0)]
    rows = [(k, None if a is None else str(a), None if b is None else str(b), n) for k, (a, b, n) in best.items()]
    return spark.createDataFrame(rows, "column_names string, min_value string, max_value string, null_count long")


def row_total(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet folder, counted by its footers."""
    return spark.read.parquet(path).count()
