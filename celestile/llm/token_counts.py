"""Token counts with overlap resynchronisation (operator 5).

A text over ``CHUNK`` characters is encoded in overlapping chunks. Two neighbours are
spliced at the last place in their overlap where both begin a pre-token. The left
chunk begins at a true boundary and is cut well before its end, so its boundaries are
those of the whole text; the pattern never looks back, so the right chunk, with a
boundary there too, goes on as the whole text does. Where no boundary is common, the
overlap is doubled, and when it fills the chunk, the chunk is.

Nulls: a null text has no bytes and no tokens. All rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celestile.llm.batches import runs
from celestile.llm.vocab import Encoder, opened

CHUNK = 1 << 15
OVERLAP = 256
LIMIT = 1024
AT_ONCE = 1 << 20


def boundaries(enc: Encoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens (or runs of them) of a text begin, and their numbers of tokens."""
    got = enc.counts(text) if enc.kind == "gpt2" else None
    if got is None:
        e = enc.tokenizer.encode(text, add_special_tokens=False)
        if not e.ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, first = np.array(e.word_ids), np.array(e.offsets, dtype=np.int64)[:, 0]
        new = np.nonzero(np.r_[True, word[1:] != word[:-1]])[0]
        got = first[new], np.diff(np.r_[new, len(word)])
    return got


def count_long(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a text, chunk by chunk."""
    margin = 2 + max([0, *(len(t.content) for t in enc.tokenizer.get_added_tokens_decoder().values())])
    total, begin, size = 0, 0, chunk
    end = min(size, len(text))
    at, n = boundaries(enc, text[:end])
    wide = overlap
    while end < len(text):
        start = max(end - wide, begin)
        if start > begin:
            stop = min(start + size, len(text))
            right, m = boundaries(enc, text[start:stop])
            right = right + start
            both = np.intersect1d(at[at <= end - margin], right)
            both = both[both > begin]
            if len(both) and stop > end:
                cut = int(both[-1])
                total += int(n[at < cut].sum())
                at, n = right[right >= cut], m[right >= cut]
                begin, end, wide, size = cut, stop, overlap, chunk
                continue
        wide *= 2
        if wide >= end - begin:  # no boundary at all: a longer chunk from the same beginning
            size, wide = 2 * max(size, end - begin), overlap
            end = min(begin + size, len(text))
            at, n = boundaries(enc, text[begin:end])
            at = at + begin
    return total + int(n.sum())


def count_all(enc: Encoder, texts: list[str], chunk: int = CHUNK) -> list[int]:
    out = [0] * len(texts)
    rest = []
    if enc.kind == "gpt2":
        known = set().union(*(t.split(" ")[1:] for t in texts))
        enc._fill({p for p in known if p and not p[0].isspace() and not p[-1].isspace()}, " ")
    for i, t in enumerate(texts):
        if len(t) > chunk:
            out[i] = count_long(enc, t, chunk)
        elif enc.kind == "gpt2" and (got := enc.counts(t)) is not None:
            out[i] = int(got[1].sum())
        else:
            rest.append(i)
    for i, ids in zip(rest, enc.encode([texts[i] for i in rest])):
        out[i] = len(ids) // 4
    return out


def _run(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = opened(path)
        for b in batches:
            texts = b.column("text")
            for x, y in runs(texts, AT_ONCE):
                part = [t or "" for t in texts[x:y].to_pylist()]
                sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in part], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[x:y], sizes, pa.array(count_all(enc, part, chunk), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def counted(docs: DataFrame, tokenizer: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of every row. ``tokenizer`` is the place of a
    ``tokenizers`` file on every machine."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_run(tokenizer, chunk), "doc_id long, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
