"""A training-data pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``; ``run`` writes what it returns as Parquet
and hands it, read again, to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celestile.llm import decontaminate, mixing, simhash, token_files, toxicity
from celestile.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity model rejects go; it learns as in operator 7."""
    model = toxicity.fit(spark, docs, toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs, model, out="_celestile_tox").where("_celestile_tox.score < 0.5").drop("_celestile_tox")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest id (of
    equal ids, the one whose text has the smallest hash; rows without an id come after all others).

    Texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or
    more, verified on the sets; candidates come from bands of minima. SimHashes of the
    sets that differ in 4 bits of 64 or fewer, and in 46 of 256, link as well: 39 of 256 differ on
    average at 0.8. Texts without words are one group.
    """
    key = "_celestile_id"
    late = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), late))
    groups = simhash.groups(spark, rows.select(F.col(key).alias("doc_id"), "text"), width=5, max_distance=4, check_distance=46)
    kept = groups.groupBy("component_id").agg(F.min("doc_id").alias(key)).select(key)
    rest = rows.join(kept, key, "left_semi")
    if rest.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rest.select(*docs.columns)
    one = rest.groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row"))
    return one.select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark passage within its error budget go."""
    marked = decontaminate.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="_celestile_leaks")
    return marked.where(F.size("_celestile_leaks") == 0).drop("_celestile_leaks")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn so that kept words meet the target shares of sources, languages and topics."""
    return mixing.sample(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row in ORC files, digested from the files."""
    return token_files.encoded(spark, docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("leaks", drop_leaks), ("mixing", mix), ("token_files", write_tokens)]
#: Learnt scores, Hamming links and edit distances have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
