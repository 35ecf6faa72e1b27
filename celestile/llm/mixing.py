"""Mixing sources to target weights by iterative proportional fitting (operator 8).

Token weights of the cells (source, language, topic) are raked until their sums meet
the target marginals of every dimension; documents are then kept with probability
``min(1, kappa * factor of their cell)``, where ``kappa`` makes the expected number of
kept tokens the asked share of all. The draw is a hash of the id, so it repeats.

Only cells are iterated on, as a table: each step is a partial sum by one dimension
and an equi-join. The driver sees sums, never cells. Columns and SQL functions only.

Nulls: a null source, language or topic is a value of its own; a null text has no
words; a null id draws as the empty string. Rows with one id share one fate.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from celestile.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
#: The target share of a value goes with its own share to this power: 1 keeps a
#: marginal as it is, 0 makes it even.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.9}
KEEP = 0.5
TOLERANCE = 1e-8
#: Raking ends unsettled after so many rounds in a row that don't lower the deviation by
#: a share of ``SHRINK``.
PATIENCE = 20
SHRINK = 1e-6


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, words: Column) -> Column:
    """A topic by the shape of a text, for tables without a topic column."""
    return F.when(F.instr(text, " | ") > 0, "table").when(words < 50, "note").when(words < 500, "article").otherwise("book")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def rake(sized: DataFrame, scratch: Scratch, dims: tuple[str, ...] = DIMENSIONS, temper: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, tolerance: float = TOLERANCE) -> DataFrame:
    """``(*dims, tokens, factor, met, probability)`` of each cell of ``sized (*dims, tokens)``.

    ``targets`` may give ``(value, share)`` for a dimension; a value it lacks gets no
    weight. Other dimensions follow ``temper``. A value whose goal is met by nothing is
    left out of the fit. Rounds go on until every marginal is met within ``tolerance``.
    Marginals that no weights can meet together never are: once the deviation has stopped
    shrinking for ``PATIENCE`` rounds the weights stand as they are, exact in the last
    dimension, with ``met`` false and a warning.
    """
    temper, targets = TEMPER | (temper or {}), targets or {}
    cells = scratch.save(sized.groupBy(*dims).agg(F.sum("tokens").alias("tokens")).withColumn("factor", F.lit(1.0)), "cells")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.withColumns({"met": F.lit(True), "probability": F.lit(float(keep))})
    goals = {}
    for d in dims:
        have = cells.groupBy(d).agg(F.sum("tokens").alias("n")).where("n > 0")
        if d in targets:
            share = targets[d].select(F.col("value").alias("v"), F.col("share").cast("double").alias("goal"))
            goal = have.join(share, have[d].eqNullSafe(share["v"]), "left").select(F.col(d).alias("of"), F.coalesce("goal", F.lit(0.0)).alias("goal"))
        else:
            goal = have.select(F.col(d).alias("of"), F.pow(F.col("n") / total, F.lit(temper[d])).alias("goal"))
        goal = scratch.save(goal, f"goal-{d}")
        whole = goal.agg(F.sum("goal")).first()[0]
        goals[d] = goal.select("of", (F.col("goal") / whole * total).alias("goal"))
    rounds, idle, low = 0, 0, float("inf")
    while True:
        now, offs = cells, []
        for d in dims:
            have = now.groupBy(d).agg(F.sum(F.col("tokens") * F.col("factor")).alias("have"))
            step = have.join(goals[d], have[d].eqNullSafe(F.col("of"))).where("have > 0")
            step = step.select(F.col("of").alias("_of"), (F.col("goal") / F.col("have")).alias("_by"), (F.abs(F.col("goal") - F.col("have")) / total).alias(f"_off_{d}"))
            offs.append(f"_off_{d}")
            held = now.join(step, now[d].eqNullSafe(F.col("_of")), "left").withColumn("factor", F.col("factor") * F.coalesce("_by", F.lit(1.0)))
            now = held.select(*dims, "tokens", "factor", *offs)
        # One plan and one table a round: the exchanges of a step are used again by the next.
        now = scratch.save(now, "cells")
        off = max(x or 0.0 for x in now.agg(*(F.max(x) for x in offs)).first())
        scratch.drop(cells)
        cells = now.drop(*offs)
        cells._celestile_path = now._celestile_path
        rounds += 1
        if off <= tolerance:
            break
        idle = 0 if off < low * (1 - SHRINK) else idle + 1
        low = low if idle else off
        if idle == PATIENCE:
            warnings.warn(f"the marginals can't be met together: off by {off:g} of all tokens after {rounds} rounds and no longer shrinking", stacklevel=2)
            break
    wanted, level, full = keep * total, 0.0, -1
    while True:  # cells whose probability is capped at 1 hand their excess to the others
        capped = F.col("factor") * F.lit(level) >= 1
        n, sure, rest = cells.agg(F.count_if(capped), F.sum(F.when(capped, F.col("tokens")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("tokens") * F.col("factor")))).first()
        if n == full or not rest:
            break
        full, level = n, max(level, (wanted - sure) / rest)
    return cells.withColumns({"met": F.lit(off <= tolerance), "probability": F.least(F.lit(1.0), F.col("factor") * F.lit(level))})


def sized(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with ``tokens`` and ``topic``, columns of these names replaced. ``topic`` is an
    expression on ``docs``; without one texts are told apart by their shape."""
    topic = topic_of(F.coalesce("text", F.lit("")), n_words(F.col("text"))) if topic is None else topic
    return docs.withColumns({"tokens": n_words(F.col("text")), "topic": topic})


def drawn(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows (doc_id, *dims, ...)`` with ``probability`` and ``selected``. The join with
    the cells is broadcast by Spark only under its size limit."""
    c = cells.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), "met", "probability")
    on = [rows[d].eqNullSafe(c[f"_{d}"]) for d in DIMENSIONS]
    out = rows.join(c, on, "left").drop(*(f"_{d}" for d in DIMENSIONS))
    return out.withColumn("selected", draw(F.col("doc_id")) < F.col("probability"))


def sample(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The kept rows of ``docs``, with their columns."""
    scratch = Scratch(docs.sparkSession, "mixing")
    slim = scratch.save(sized(docs.select("text", "source", "lang")).select(*DIMENSIONS, "tokens"), "sized")
    cells = scratch.save(rake(slim, scratch, keep=keep), "raked").select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), "probability")
    topic = topic_of(F.coalesce("text", F.lit("")), n_words(F.col("text")))
    on = F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("_celestile_topic").eqNullSafe(F.col("_topic"))
    marked = docs.withColumn("_celestile_topic", topic).join(cells, on, "left")
    return marked.where(draw(F.col("doc_id")) < F.col("probability")).select(*(docs[c] for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "mixing")
    rows = scratch.save(sized(docs.select("doc_id", "text", "source", "lang")).drop("text"), "sized")
    cells = scratch.save(rake(rows, scratch), "raked")
    out = drawn(rows, cells)
    return out.select("doc_id", "source", "lang", "topic", F.col("tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"), "selected", F.col("met").alias("targets_met"))
