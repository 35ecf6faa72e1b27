"""Token ids in ORC files (operator 2).

Documents are dealt by ranges of ``doc_id`` and sorted, each range is encoded and
written as one ORC file of ``(doc_id, part, base, n_tokens, ids)``: ids in ORC's integer
run-length encoding, row indexes every ``STRIDE`` rows, Bloom filters on ``doc_id``.
Readers take stripes in parallel and skip row groups by minima, maxima and filters.
``base`` counts the ids before a document in its own file; ``starts`` adds the files
before it, one sum for each file.

Nulls: a null text is an empty one and gets the end id alone; null ids come first.
Rows with one id stay apart, ordered by a hash of their texts. An empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from celestile.llm.batches import runs
from celestile.llm.scratch import Scratch
from celestile.llm.vocab import opened

END = 2
STRIDE = 1000
STRIPE = 16 << 20
SCHEMA = "doc_id long, part int, base long, n_tokens int, ids array<int>"
#: Bytes of text that are encoded at once.
AT_ONCE = 1 << 22


def _encoder(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, base = opened(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            texts = whole.column("text")
            for at, to in runs(texts, AT_ONCE):
                flat, ends = enc.encode_column(texts[at:to])
                flat = np.insert(flat, ends[1:], end)
                offsets = ends + np.arange(len(ends))
                yield pa.RecordBatch.from_arrays(
                    [whole.column("doc_id")[at:to], pa.array(np.full(to - at, part, np.int32)), pa.array(base + offsets[:-1]), pa.array(np.diff(offsets).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))],
                    ["doc_id", "part", "base", "n_tokens", "ids"],
                )
                base += int(offsets[-1])
            pa.default_memory_pool().release_unused()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, files: int | None = None) -> None:
    """Encode every text whole and write the files. ``tokenizer`` is the place of a
    vocabulary file on every machine."""
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("tie", F.xxhash64("text"))  # many rows of one id spread over several files
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    out = rows.mapInArrow(_encoder(tokenizer, end), SCHEMA).write
    out = out.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    out.option("orc.create.index", "true").option("orc.row.index.stride", STRIDE).option("orc.stripe.size", STRIPE).orc(path, compression="zstd")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents: the filter is pushed to the row indexes and filters."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def starts(table: DataFrame) -> DataFrame:
    """``table`` with ``start``: the ids of all documents before. One row for each file
    is broadcast."""
    sums = table.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("sum"))
    before = sums.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return table.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("base")).drop("before")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        at = ids.offsets.to_numpy().astype(np.int64) * 4
        crc = [zlib.crc32(flat[x:y]) for x, y in zip(at, at[1:])]
        n = pa.array((at[1:] - at[:-1]) // 4)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("base"), n, pa.array(crc, pa.int64())], ["doc_id", "part", "base", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files."""
    seen = read(spark, path).select("doc_id", "part", "base", "ids").mapInArrow(_digest, "doc_id long, part int, base long, n_tokens long, ids_crc32 long")
    sums = starts(read(spark, path).select("part", "n_tokens", "base")).select("part", (F.col("start") - F.col("base")).alias("before")).distinct()
    return seen.join(F.broadcast(sums), "part").select("doc_id", (F.col("before") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def encoded(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = Scratch(spark, "tokens").path("orc")
    write(docs, path, tokenizer)
    return digest(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
