"""Arrow batches of texts: cut by size, and as numbers of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Hash of the end of a text: of a space, which no word holds.
END = np.uint64(xxhash.xxh64_intdigest(b" "))


def runs(texts: pa.Array, at_once: int) -> Iterator[tuple[int, int]]:
    """``(from, to)`` of runs of rows with about ``at_once`` bytes of text, a longer text
    alone; together they hold every row."""
    ends = np.cumsum(np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], dtype=np.int64))
    at = 0
    while at < len(texts):
        used = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, used + at_once, "right")))
        yield at, to
        at = to


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all symbols in a row (0 the end of each text, others by falling frequency), the
    hash of each number, and the number of symbols of each text."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = cut.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    at = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))][cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()]
    words = flat.filter(full).dictionary_encode()
    numbers = words.indices.to_numpy()
    n = np.bincount(numbers, minlength=len(words.dictionary))
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) + 1
    kinds = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, kinds.tolist()), np.uint64, len(kinds))
    return np.insert(rank[numbers], at[1:], 0), np.r_[END, hashes[order]], np.diff(at) + 1
