"""Sky maps in FITS files: one value for each cell of an order, in a binary table.

Headers are read on the driver, values by the executors in ranges of table rows. The
layout (blocks of 2880 bytes, cards of 80, big-endian values) is that of the public
FITS standard, the keywords those that sky maps carry by convention.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celestile.functions import healpix as hp
from celestile.sources import paths as P

BLOCK, CARD = 2880, 80
#: Codes of column types and what they are in NumPy.
TYPES = {"B": ">u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
#: Fixed value: what a cell holds that was not observed.
UNSEEN = -1.6375e30
#: Values of a table row of the maps written here, and of a part that is read at once.
ROW, PART = 1024, 1 << 20
#: Maps are written from the driver, 4 bytes a cell: 0.8 GB at this order.
MOST_ORDER = 12


@dataclass(frozen=True)
class Layout:
    """Where the values of a map lie: table rows of ``width`` bytes from ``start`` on, each with
    ``repeat`` values at ``offset``; with ``keys``, (offset, type) of the cell's number, one."""

    start: int
    width: int
    rows: int
    offset: int
    repeat: int
    kind: str
    order: int
    ring: bool
    keys: tuple[int, str] | None


def _header(f) -> tuple[dict[str, str], int]:
    """The cards at the stream's place, as text, and their number of bytes."""
    cards, size = {}, 0
    while "END" not in cards:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            raise ValueError("the file ends within a header")
        size += BLOCK
        for i in range(0, BLOCK, CARD):
            card = bytes(block[i : i + CARD]).decode("ascii")
            if card.strip() == "END":
                cards["END"] = ""
                break
            if card[8:10] == "= ":
                text = card[10:].strip()
                cards[card[:8].strip()] = text[1:].partition("'")[0].strip() if text.startswith("'") else text.partition("/")[0].strip()
    return cards, size


def _padded(n: int) -> int:
    return -(-n // BLOCK) * BLOCK


def layout(path: str) -> Layout:
    """The first table of a file that is a sky map; fails where there is none."""
    where, at = P.located(path)
    if not P.is_file(path):
        raise FileNotFoundError(f"no file at {path}")
    with where.open_input_file(at) as f:
        total, place = f.size(), 0
        while place < total:
            f.seek(place)
            cards, size = _header(f)
            axes = [int(cards[f"NAXIS{k + 1}"]) for k in range(int(cards.get("NAXIS", 0)))]
            data = abs(int(cards.get("BITPIX", 8))) // 8 * (math.prod(axes) if axes else 0) + int(cards.get("PCOUNT", 0))
            if cards.get("XTENSION") == "BINTABLE" and "NSIDE" in cards:
                return _of_cards(cards, place + size, axes)
            place += size + _padded(data)
    raise ValueError(f"{path} holds no sky map")


def _of_cards(cards: dict[str, str], start: int, axes: list[int]) -> Layout:
    columns, at = [], 0
    for k in range(int(cards["TFIELDS"])):
        form = re.fullmatch(r"(\d*)([A-Z])", cards[f"TFORM{k + 1}"])
        if not form or form[2] not in TYPES:
            raise ValueError(f"columns of type {cards[f'TFORM{k + 1}']} can't be read")
        n = int(form[1] or 1)
        columns.append((at, n, TYPES[form[2]]))
        at += n * np.dtype(TYPES[form[2]]).itemsize
    keyed = cards.get("INDXSCHM", "IMPLICIT") == "EXPLICIT"
    offset, repeat, kind = columns[1 if keyed else 0]
    keys = (columns[0][0], columns[0][2]) if keyed else None
    return Layout(start, axes[0], axes[1], offset, repeat, kind, hp.nside2order(int(cards["NSIDE"])), cards.get("ORDERING", "RING").startswith("RING"), keys)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """``(pix, value)`` of the cells, in nested numbers, that hold anything but 0; those not
    observed are left out. The path must be one that executors can reach."""
    at = layout(path)
    by = max(1, PART // at.repeat)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, name = P.located(path)
        with where.open_input_file(name) as f:
            for b in batches:
                for first in b.column("id").to_pylist():
                    n = min(by, at.rows - first)
                    f.seek(at.start + first * at.width)
                    raw = np.frombuffer(f.read(n * at.width), np.uint8).reshape(n, at.width)

                    def column(offset, repeat, kind, raw=raw):
                        size = np.dtype(kind).itemsize * repeat
                        return np.ascontiguousarray(raw[:, offset : offset + size]).view(kind).reshape(-1)

                    value = column(at.offset, at.repeat, at.kind).astype("f8")
                    key = column(at.keys[0], 1, at.keys[1]).astype("i8") if at.keys else first * at.repeat + np.arange(len(value), dtype="i8")
                    keep = (value != 0) & ~np.isclose(value, UNSEEN, rtol=1e-5, atol=0) & ~np.isnan(value) & (key >= 0) & (key < hp.order2npix(at.order))
                    yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(value[keep])], ["pix", "value"])

    out = spark.range(0, at.rows, by).mapInArrow(read, "pix long, value double")
    return hp.with_nested(out, "pix", at.order, "_nested").select(F.col("_nested").alias("pix"), "value") if at.ring else out


def read_counts(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """``(pix, n)`` of a map of counts, and its order."""
    return read_map(spark, path).select("pix", F.col("value").cast("long").alias("n")), layout(path).order


def _cards(*cards: tuple[str, object]) -> bytes:
    text = ""
    for k, v in cards:
        if isinstance(v, str):
            value = f"'{v:<8}'".ljust(20)
        else:
            value = ("T" if v is True else str(v)).rjust(20)
        text += f"{k:<8}= {value}".ljust(CARD)
    text += "END".ljust(CARD)
    return text.ljust(_padded(len(text))).encode("ascii")


def write_map(counts: DataFrame, order: int, path: str) -> None:
    """Write ``(pix, n)``, n of 32 bits and 0 where there is no row, as a map of nested cells. The
    map is made on the driver; orders past ``MOST_ORDER`` are refused."""
    if order > MOST_ORDER:
        raise ValueError(f"maps of more than order {MOST_ORDER} are not written")
    values = np.zeros(hp.order2npix(order), ">i4")
    held = counts.select("pix", "n").where("n <> 0").toArrow()  # a row a cell of the order
    values[held["pix"].to_numpy()] = held["n"].to_numpy()
    row = min(ROW, len(values))
    while len(values) % row:
        row //= 2
    first = _cards(("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True))
    table = _cards(
        ("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 4 * row), ("NAXIS2", len(values) // row), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 1),
        ("TTYPE1", "TEMPERATURE"), ("TFORM1", f"{row}J"), ("PIXTYPE", "HEALPIX"), ("ORDERING", "NESTED"), ("COORDSYS", "C"), ("EXTNAME", "xtension"),
        ("NSIDE", 1 << order), ("FIRSTPIX", 0), ("LASTPIX", len(values) - 1), ("INDXSCHM", "IMPLICIT"), ("OBJECT", "FULLSKY"),
    )
    where, at = P.located(path)
    with where.open_output_stream(at) as f:
        f.write(first + table)
        f.write(values.tobytes())
        f.write(bytes(_padded(values.nbytes) - values.nbytes))
