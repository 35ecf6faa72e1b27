"""Toxic passages as maximum-scoring segments (operator 7).

A word scores its log-odds between toxic and clean training texts under an
informative Dirichlet prior (the words' shares in both together); a word without a
score of its own takes that of its first ``STEM`` bytes, counted alike. A text is a
sequence of such scores with a negative drift, and one linear scan finds all its
maximal scoring segments. Segment scores are calibrated by the extreme-value law of
such segments: with ``lam`` solving ``E[exp(lam * score)] = 1`` on clean words, a text
of ``n`` words holds ``K * n * exp(-lam * S)`` segments of score ``S`` by chance. The
evidence of all significant segments is summed, and a logistic curve fitted on the
training texts turns it into a probability.

Labels are learnt from a bounded sample of labelled rows, ``SAMPLE`` at most, taken
by a hash of the id; equal texts count once there. Scoring covers every text whole.

Nulls: a null text scores as an empty one; a row with a null label or id teaches
nothing. Without toxic training texts, or any at all, every score is next to 0 (9e-14);
with toxic ones only it is next to 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celestile.llm.scratch import Scratch

SAMPLE = 20_000
#: A word is kept if it is at least this share of all words seen in training texts, so
#: there are at most 1 / SHARE of them.
SHARE = 2e-6
LEAST_TEXTS = 4
#: Longer words also count by their first bytes.
STEM = 6
Z = 3.0
DRIFT = 0.05
E_VALUE = 0.05
#: A-Z to a-z; ASCII punctuation, digits and controls to spaces.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


@dataclass
class Model:
    odds: dict[bytes, float] = field(default_factory=dict)
    drift: float = DRIFT
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    base: float = -30.0

    def scores(self) -> Scores:
        if "_scores" not in self.__dict__:
            self._scores = Scores(self.odds)
        return self._scores

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_scores"}


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def stem(word: bytes) -> bytes:
    """The feature of a word's beginning; a word itself never holds the mark."""
    return word[:STEM] + b"*"


def features(text: str | None) -> set[bytes]:
    words = set(tokens(text))
    return words | {stem(w) for w in words if len(w) >= STEM}


class Scores(dict):
    """Scores by word, found once per process; forgotten when there are ``ROOM``."""

    ROOM = 250_000

    def __init__(self, odds: dict[bytes, float]) -> None:
        super().__init__()
        self.odds = odds

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.ROOM:
            self.clear()
        self[word] = s = self.odds.get(word) or (self.odds.get(stem(word), 0.0) if len(word) >= STEM else 0.0)
        return s


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of a sequence in which the
    listed positions have the listed scores and all others ``-drift``. Linear: each
    candidate remembers the last one whose sum to the left is smaller."""
    start: list[int] = []
    end: list[int] = []
    low: list[float] = []
    high: list[float] = []
    link: list[int] = []
    total, at = 0.0, 0
    for pos, s in scores:
        total -= drift * (pos - at)
        at = pos + 1
        if s <= 0:
            total += s
            continue
        a, b, lo, hi = pos, pos + 1, total, total + s
        total = hi
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= lo:
                j = link[j]
            if j < 0 or high[j] >= hi:
                start.append(a), end.append(b), low.append(lo), high.append(hi), link.append(j)
                break
            a, lo, j2 = start[j], low[j], link[j]
            del start[j:], end[j:], low[j:], high[j:], link[j:]
            j = j2
    return [(a, b, h - lo) for a, b, lo, h in zip(start, end, low, high)]


def passages(text: str | None, m: Model) -> tuple[int, list[tuple[int, int, float]]]:
    """The number of words, and the maximal segments by word position."""
    w = tokens(text)
    got = np.fromiter(map(m.scores().__getitem__, w), np.float64, len(w))
    where = np.nonzero(got)[0]
    return len(w), segments(list(zip(where.tolist(), got[where].tolist())), m.drift)


def evidence(n: int, found: list[tuple[int, int, float]], m: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """Summed calibrated evidence, and the significant passages."""
    level = m.log_k + math.log(max(n, 1))
    sure = [x for x in found if m.lam * x[2] - level > -math.log(E_VALUE)]
    if sure:
        return sum(m.lam * x[2] - level for x in sure), sure
    return m.lam * max((x[2] for x in found), default=0.0) - level, sure


def _squash(x: np.ndarray) -> np.ndarray:
    return np.arcsinh(x / 2)


def probability(x: np.ndarray, m: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m.slope * _squash(x) + m.base, -30, 30)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for b in batches:
        for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            (toxic if y else clean).update(features(text))
        if len(toxic) + len(clean) > 500_000:
            yield _counted(toxic, clean)
            toxic, clean = Counter(), Counter()
    yield _counted(toxic, clean)


def _counted(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    w = list(toxic.keys() | clean.keys())
    return pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array([toxic[x] for x in w], pa.int64()), pa.array([clean[x] for x in w], pa.int64())], ["word", "t", "c"])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((y - p) * x).sum() - 1e-3 * a, (y - p).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a + float(step[0]), b + float(step[1])
        if abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the rows of ``labels (doc_id, toxic)`` that are given; the caller
    leaves out what is held out. At most ``sample`` of them are used."""
    scratch = Scratch(spark, "toxicity")
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Broadcast: ``sample`` rows of two numbers at most.
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    texts = texts.groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    texts = scratch.save(texts.select("text", "toxic"), "texts")
    words = scratch.save(texts.mapInArrow(_counts, "word binary, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "words")
    t_all, c_all = (float(x or 0) for x in words.agg(F.sum("t"), F.sum("c")).first())
    if not t_all or not c_all:
        return Model(base=-30.0 if not t_all else 30.0)
    kept = words.where(F.col("t") + F.col("c") >= max(LEAST_TEXTS, (t_all + c_all) * SHARE)).toPandas()
    t, c = kept["t"].to_numpy(float), kept["c"].to_numpy(float)
    prior = t_all * (t + c) / (t_all + c_all)  # as much prior as toxic words seen
    s = np.log((t + prior) / (2 * t_all)) - np.log((c + prior) / (c_all + t_all))
    sure = np.abs(s) / np.sqrt(1 / (t + prior) + 1 / (c + prior)) >= Z
    m = Model(odds={bytes(w): float(x) for w, x in zip(kept["word"][sure], s[sure])})
    f, s = c[sure] / c_all, s[sure]
    while f @ s - (1 - f.sum()) * m.drift >= -0.2 * m.drift:
        m.drift *= 1.5
    lo, hi = 0.0, 20.0
    for _ in range(80):
        m.lam = (lo + hi) / 2
        grows = f @ np.exp(np.minimum(m.lam * s, 600)) + (1 - f.sum()) * math.exp(-m.lam * m.drift) > 1
        lo, hi = (lo, m.lam) if grows else (m.lam, hi)
    model = spark.sparkContext.broadcast(m)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [passages(x, model.value) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([x[0] for x in got], pa.int64()), pa.array([[y[2] for y in x[1]] for x in got], pa.list_(pa.float64()))], ["toxic", "n", "s"])

    rows = texts.mapInArrow(best, "toxic int, n long, s array<double>").collect()  # ``sample`` at most
    clean = np.array([m.lam * max(r["s"], default=0.0) - math.log(max(r["n"], 1)) for r in rows if not r["toxic"]])
    m.log_k = float(np.quantile(clean, 0.8) + math.log(-math.log(0.8)))
    x = np.array([evidence(r["n"], [(0, 0, v) for v in r["s"]], m)[0] for r in rows])
    m.slope, m.base = _logistic(_squash(x), np.array([float(r["toxic"]) for r in rows]))
    return m


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds ``out``: a struct of the probability ``score``, the summed ``evidence`` and the
    significant ``passages`` (word positions, bits). All rows and columns stay; a
    column named like ``out`` is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, evidence double, passages array<struct<first:long,past:long,bits:double>>")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for part in texts:
            got = [evidence(*passages(x, m), m) for x in part]
            x = np.array([g[0] for g in got])
            bits = [[{"first": a, "past": b, "bits": m.lam * s / math.log(2)} for a, b, s in g[1]] for g in got]
            yield pd.DataFrame({"score": probability(x, m), "evidence": x, "passages": bits})

    return docs.withColumn(out, judge(F.col(text_col).cast("string")))


def training_labels(labels: DataFrame) -> DataFrame:
    """Rows whose crc32 of the id as text leaves a remainder other than 0 by 5."""
    return labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(spark, docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    out = score(docs, model).select("doc_id", held_out.alias("held_out"), F.col("toxicity.score").alias("score"), F.size("toxicity.passages").alias("passages"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
