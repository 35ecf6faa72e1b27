"""Benchmark passages in documents by pigeonhole edit matching (operator 10).

Texts are compared in normal form: A-Z lower-cased, ASCII punctuation and white
space runs as one space. A test item of ``m`` characters may differ by ``k =
floor(RATE * m)`` edits. Cut into ``k + 1`` pieces, at least one piece is left intact,
so an Aho-Corasick automaton over all pieces finds every candidate place; Myers'
bit-parallel distance of the whole item against the place decides.

Items are held on every executor in blocks of at most ``BLOCK_CHARS`` characters of
text; a larger benchmark takes more passes over the documents.

Nulls: a null or blank text contains nothing; an item that is null or blank in
normal form matches nothing. Items under ``EXACT_CHARS`` characters must occur
exactly, between word ends. Equal items under different ids each match.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.08
EXACT_CHARS = 20
BLOCK_CHARS = 4_000_000
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


def normal(text: str | None) -> str:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()).decode("utf-8", "surrogatepass")


def budget(m: int, rate: float = RATE) -> int:
    return int(rate * m) if m >= EXACT_CHARS else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` runs of near equal length with their offsets."""
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def myers(pattern_bits: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """The least edit distance of the pattern to any stretch of ``text``, and the end of
    the first such stretch; distance ``most + 1`` if all are farther."""
    top, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, d = full, 0, m
    best, end = most + 1, -1
    for i, ch in enumerate(text):
        eq = pattern_bits.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            d += 1
        elif mh & top:
            d -= 1
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if d < best:
            best, end = d, i + 1
    return best, end


class Matcher:
    """All items of a block: their pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        self.items = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            t = normal(text)
            if not t:
                continue
            if len(t) < EXACT_CHARS:
                t = f" {t} "
            k = budget(len(t), rate)
            bits: dict[str, int] = {}
            for i, ch in enumerate(t):
                bits[ch] = bits.get(ch, 0) | 1 << i
            for offset, piece in pieces(t, k):
                places.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, len(t), k, bits))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(item_id, distance, end)`` of each item within its budget: the least distance
        and where it first ends, in the normal form of the text."""
        t = normal(text)
        if self.empty or not t:
            return []
        t = f" {t} "
        spans: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.automaton.iter(t):
            at = last + 1 - size
            for n, offset in where:
                _, m, k, _ = self.items[n]
                a, b = max(0, at - offset - k), at - offset + m + k
                own = spans.setdefault(n, [])
                if own and a <= own[-1][1] and a >= own[-1][0]:
                    own[-1] = (own[-1][0], max(b, own[-1][1]))
                else:
                    own.append((a, b))
        out = []
        for n, own in spans.items():
            item_id, m, k, bits = self.items[n]
            best = (k + 1, -1)
            for a, b in own:
                d, end = myers(bits, m, t[a:b], k)
                if d < best[0]:
                    best = (d, a + end - 1)  # the leading space doesn't count
                    if not d:
                        break
            if best[0] <= k:
                out.append((item_id, *best))
        return out


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items, a block at a time; each stays under ``block_chars`` unless a single
    item is longer."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").orderBy("item_id")
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r["text"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def mark(docs: DataFrame, benchmark: DataFrame, out: str = "leaks", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds ``out``: the items found in each text, as ``array<struct<item_id, distance,
    past>>``; empty where there are none. All rows and columns stay."""
    sc = docs.sparkSession.sparkContext
    found = []
    for block in blocks(benchmark, block_chars):
        found.append(_finder(sc.broadcast(block), rate)(F.col("text").cast("string")))
    none = F.array().cast("array<struct<item_id:long,distance:int,past:long>>")
    return docs.withColumn(out, reduce(F.concat, found) if found else none)


def _finder(held, rate: float):
    @F.pandas_udf("array<struct<item_id:long,distance:int,past:long>>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(held.value, rate)
        for part in texts:
            yield pd.Series([[{"item_id": i, "distance": d, "past": e} for i, d, e in m.find(x)] for x in part], dtype=object)

    return find


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.distance", "leak.past")
