"""Arrays as compressed bytes, for rows that carry many numbers through an exchange."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_CODEC = "zstd"


def pack(*arrays: np.ndarray) -> bytes:
    """Byte planes of all arrays, compressed together."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return head + pa.compress(body, codec=_CODEC, asbytes=True) if body else head


def unpack(data: bytes) -> list[np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    kinds = [struct.unpack_from("<2sQ", data, 4 + 10 * i) for i in range(n)]
    kinds = [(np.dtype("<" + k.decode()), size) for k, size in kinds]
    total = sum(k.itemsize * size for k, size in kinds)
    body = np.frombuffer(pa.decompress(data[4 + 10 * n :], total, codec=_CODEC, asbytes=True), np.uint8) if total else np.zeros(0, np.uint8)
    out, at = [], 0
    for k, size in kinds:
        part = body[at : at + k.itemsize * size]
        out.append(np.ascontiguousarray(part.reshape(k.itemsize, size).T).view(k).reshape(size) if size else np.zeros(0, k))
        at += k.itemsize * size
    return out


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads its input over all bits (SplitMix64's finisher)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 64-bit key, growing with the key: ``parts`` equal ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
