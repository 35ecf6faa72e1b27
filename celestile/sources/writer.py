"""Writing rows as a catalog: one sorted Parquet file for each adaptive partition."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestile.functions import healpix as hp
from celestile.operators import partition as A
from celestile.sources import metadata as M
from celestile.sources import paths as P
from celestile.sources.properties import Properties

#: Rows of a row group.
GROUP = 100_000


def _leaf_writer(base: str):
    """Rows come sorted by partition and index; each partition's go to a file of its own, a
    row group at a time. Files are written aside and renamed, so a task that is run again
    leaves the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import numpy as np
        import pyarrow.parquet as pq

        store = P.located(base)[0]
        now, writer, part, done, held = None, None, "", 0, []

        def flush() -> None:
            nonlocal held
            if held:
                writer.write_table(pa.Table.from_batches(held), row_group_size=GROUP)
                held = []

        def close() -> tuple | None:
            if writer is None:
                return None
            flush()
            writer.close()
            store.move(part, P.located(P.leaf_file(base, *now))[1])
            return (*now, done)

        out = []
        for b in batches:
            order, pixel = b.column("Norder").to_numpy(), b.column("Npix").to_numpy()
            cuts = [0, *(np.nonzero((order[1:] != order[:-1]) | (pixel[1:] != pixel[:-1]))[0] + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                cell = int(order[x]), int(pixel[x])
                if cell != now:
                    if (got := close()) is not None:
                        out.append(got)
                    now, done, held = cell, 0, []
                    where = P.located(P.leaf_file(base, *now))[1]
                    store.create_dir(where.rpartition("/")[0], recursive=True)
                    part = f"{where}.{uuid.uuid4().hex}.tmp"
                    writer = pq.ParquetWriter(part, b.schema, filesystem=store)
                held.append(b.slice(x, y - x))
                done += y - x
                if sum(h.num_rows for h in held) >= GROUP:
                    flush()
        if (got := close()) is not None:
            out.append(got)
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["Norder", "Npix", "rows"])

    return write


def write_leaves(rows: DataFrame, base: str) -> list[tuple[int, int, int]]:
    """A file for each partition of ``rows (Norder, Npix, _healpix_29, ...)``, sorted by index;
    returns ``(Norder, Npix, rows)`` along the nested curve."""
    dealt = rows.withColumn("Dir", hp.directory(F.col("Npix"))).repartition("Norder", "Npix")
    sorted_ = dealt.sortWithinPartitions("Norder", "Npix", hp.INDEX_COLUMN)
    written = sorted_.mapInArrow(_leaf_writer(base), "Norder int, Npix long, rows long").collect()  # a row for each file
    return sorted((tuple(r) for r in written), key=lambda r: r[1] << 2 * (hp.MAX_ORDER - r[0]))


def write_catalog(df: DataFrame, base: str, name: str, ra: str = "ra", dec: str = "dec", highest: int = 10, lowest: int = 0, threshold: int = 1_000_000, drop_empty_siblings: bool = False, catalog_type: str = "object", keep_overfull: bool = False, **more) -> list[tuple[int, int]]:
    """Index, partition and write ``df`` with its metadata files; returns its partitions.
    ``base`` must be a folder that all executors share, or the URI of a store. A partition
    holds at most ``threshold`` rows, so no task gets more than its share of files; with
    ``keep_overfull`` a cell of the highest order that holds more stays one file, whole."""
    spark = df.sparkSession
    rows = hp.with_index(df, ra, dec)
    counts = A.histogram_by_index(rows, highest)
    counts.withColumn("order", F.lit(highest)).write.mode("overwrite").parquet(f"{base}/{P.POINT_MAP}")
    counts = spark.read.parquet(f"{base}/{P.POINT_MAP}").select("pix", "n")
    aligned = A.alignment(counts, highest, lowest, threshold, drop_empty_siblings, keep_overfull)
    written = write_leaves(A.assign(rows, aligned, highest), base)
    cells = [c[:2] for c in written]
    finish(spark, base, name, cells, sum(c[2] for c in written), catalog_type, ra_column=ra, dec_column=dec, **more)
    return cells


def finish(spark, base: str, name: str, cells: list, total: int, catalog_type: str, **more) -> None:
    M.write_partitions(base, cells)
    if cells:
        M.write_metadata(base, spark=spark)
    Properties(catalog_name=name, catalog_type=catalog_type, total_rows=total, **more).write(base)
