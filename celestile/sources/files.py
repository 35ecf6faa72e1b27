"""Plain tables and texts as sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Files and folders as one lazy table; files whose names begin with ``_`` are skipped."""
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A CSV file with a header line. Without a ``schema`` types are inferred in a pass of their own."""
    read = spark.read.options(**({"header": True} | options))
    return read.schema(schema).csv(path) if schema else read.option("inferSchema", True).csv(path)


def csv_chunks(spark: SparkSession, path: str, size: int = 10_000, schema: str | None = None) -> Iterator[list[Row]]:
    """The rows of a CSV file a chunk at a time; the driver holds one partition at most."""
    chunk: list[Row] = []
    for row in read_csv(spark, path, schema).toLocalIterator():
        chunk.append(row)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value)``, a row for each line."""
    return spark.read.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)
