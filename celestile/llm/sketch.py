"""Threshold-scaled sketches of documents (operator 4).

The sketch of a text is the set of all its shingle hashes below a fixed fraction of
the hash range, so sketches of parts merge by union, and texts of very unequal
length are compared by containment: the share of the smaller sketch found in the
other. The smallest hash is kept in any case, so only texts without words have an
empty sketch. Columns and SQL functions only.

A containment from ``m`` kept hashes is off by about ``sqrt(c * (1 - c) / m)``; a text of
fewer than 40 shingles keeps fewer than 10 and is only roughly placed.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, shingles five words in a row, or
all of a shorter text. Nulls: a null text is an empty one; null ids come first.
Sketches without a hash are alike (1) and unlike any other (0).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRACTION = 0.25
WIDTH = 5


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all shingles: of the hashes of their words."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < width, F.array(F.xxhash64(w))).otherwise(runs)

    return _let(F.transform(words(text), lambda x: F.xxhash64(x)), of)


def sketch(text: Column, fraction: float = FRACTION, width: int = WIDTH) -> Column:
    """The sorted set of hashes in the lowest ``fraction`` of the range, and the smallest."""
    return F.array_sort(_let(hashes(text, width), lambda h: _kept(h, fraction)))


def _kept(h: Column, fraction: float) -> Column:
    bound = min(-(1 << 63) + int(fraction * (1 << 64)), (1 << 63) - 1)
    return F.array_union(F.filter(h, lambda x: x < F.lit(bound)), F.filter(F.array(F.array_min(h)), lambda x: x.isNotNull()))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of all shingles of two parts, the same as from their shingles together: a
    smallest hash over the bound goes if the other part has a smaller one."""
    return F.array_sort(_let(F.array_union(a, b), lambda h: _kept(h, fraction)))


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller sketch that the other holds, 0 to 1."""
    least = F.least(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b)) / least
    return F.when(F.size(a) + F.size(b) == 0, 1.0).when(least == 0, 0.0).otherwise(both).cast("double")


def packed(a: Column) -> Column:
    """A sketch as text: base64 of its hashes, eight bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def order_key(doc_id: Column, text: Column) -> Column:
    """A string that sorts as ids do, null first, and rows of one id by the beginning of their
    texts; so many rows of one id can be cut into ranges."""
    at = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(at, F.lit("!")), F.hex(F.encode(F.left(text, F.lit(32)), "utf-8")))


def _range(key: Column, heads: Column, n: int) -> Column:
    """The number of the last of ``n`` sorted heads at or below a key, by binary search."""
    size = 1 << n.bit_length()
    steps = F.array(*(F.lit(size >> (i + 1)) for i in range(size.bit_length() - 1)))
    reach = lambda at, step: F.when((at + step < n) & (F.get(heads, at + step) <= key), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), reach)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``(doc_id, text, own, next_text, next_own)``: each row with its sketch, and text and
    sketch of the next row in ascending doc_id order (of equal ids by text); after the
    last comes the first.

    One exchange of the texts, each range of ids to a partition of its own. The first rows of
    a range also go to the range before it, as guests that end it. The driver holds the first
    key of each range, one for each partition; only rows of one id whose texts begin with the
    same 32 characters can't be parted.
    """
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", order_key(F.col("doc_id"), F.col("text")))
    dealt = rows.select("key").repartitionByRange(n, "key").select("key", F.spark_partition_id().alias("part"))
    firsts = sorted(r["first"] for r in dealt.groupBy("part").agg(F.min("key").alias("first")).collect())  # a row for each range
    k = max(1, len(firsts))
    heads = F.split(F.lit(",".join(firsts)), ",")
    rows = rows.withColumn("at", _range(F.col("key"), heads, k))
    guest = F.when(F.get(heads, F.col("at")) == F.col("key"), F.struct(((F.col("at") + k - 1) % k).alias("range"), F.lit(1).alias("guest")))
    both = F.array_compact(F.array(F.struct(F.col("at").alias("range"), F.lit(0).alias("guest")), guest))
    spread = rows.select("doc_id", "text", F.explode(both).alias("to")).select("doc_id", "text", "to.range", "to.guest")
    spread = spread.repartitionById(k, F.col("range")).withColumn("own", sketch(F.col("text")))
    w = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    out = spread.withColumns({"next_text": F.lead("text").over(w), "next_own": F.lead("own").over(w)})
    return out.where("guest = 0").select("doc_id", "text", "own", "next_text", "next_own")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.length("text")
    out = docs.withColumns({"n_chars": n.cast("long"), "q": (n / 4).cast("int")})
    out = out.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - F.col("q")), F.left("next_text", F.col("q"))))
    out = out.withColumn("changed", sketch(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("own")).alias("fingerprint"), packed(F.col("changed")).alias("edited_fingerprint"),
        containment(F.col("own"), F.col("changed")).alias("near_edited"), containment(F.col("own"), F.col("next_own")).alias("near_next"),
    )
