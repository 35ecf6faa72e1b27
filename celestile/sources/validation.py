"""Checks of a catalog's files against one another."""

from __future__ import annotations

import warnings

import pyarrow.dataset as ds
from pyspark.sql import SparkSession

from celestile.functions import healpix as hp
from celestile.sources import metadata as M
from celestile.sources import paths as P
from celestile.sources.properties import Properties


def properties_valid(base: str) -> bool:
    try:
        Properties.read(base)
    except (FileNotFoundError, ValueError, TypeError, NotImplementedError):
        return False
    return True


def has_partitions(base: str) -> bool:
    return P.is_file(P.pointer(base, P.INFO))


def has_metadata(base: str) -> bool:
    return P.is_file(P.pointer(base, P.METADATA))


def has_common_metadata(base: str) -> bool:
    return P.is_file(P.pointer(base, P.COMMON))


def _sorted(cells: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return sorted(cells, key=lambda c: c[1] << 2 * (hp.MAX_ORDER - c[0]))


def problems(spark: SparkSession, base: str):
    """What the strict check finds wrong, one text at a time. If files are missing, only that."""
    missing = [text for ok, text in (
        (properties_valid(base), "the properties file is missing or invalid"), (has_partitions(base), f"{P.INFO} is missing"),
        (has_metadata(base), f"{P.METADATA} is missing"), (has_common_metadata(base), f"{P.COMMON} is missing"),
    ) if not ok]
    yield from missing
    if missing:
        return
    from celestile.catalog import open_catalog

    own = _sorted([tuple(r) for r in open_catalog(spark, base).partitions.collect()])  # a row for each partition
    meta = P.pointer(base, P.METADATA)
    for what, read in (
        (f"{P.METADATA} (strict)", lambda: M.partitions_from_metadata(meta, strict=True)), (f"{P.METADATA} (minima)", lambda: M.partitions_from_metadata(meta)),
        (P.INFO, lambda: M.partitions_from_csv(P.pointer(base, P.INFO))),
    ):
        if _sorted(read()) != own:
            yield f"the partitions of the catalog and of {what} differ"
    where, at = P.located(base)
    ds.dataset(f"{at}/{P.DATASET}", filesystem=where, format="parquet", exclude_invalid_files=False)  # fails unless it is one dataset
    found = []
    for f in M.leaf_list(base):
        cell = P.cell_of_path(f[len(at) :])
        if cell == P.INVALID:
            yield f"no partition in the path {f[len(at):]}"
        found.append(cell)
    if _sorted([c for c in found if c != P.INVALID]) != own or P.INVALID in found:
        yield "the partitions of the catalog and of the leaf files differ"


def is_valid(spark: SparkSession, base: str, strict: bool = False, fail_fast: bool = False, verbose: bool = True) -> bool:
    """Without ``strict``, whether the properties and a list of partitions are there. With it,
    whether all files are there and agree; what is wrong is raised, printed or warned of."""
    if not strict:
        return properties_valid(base) and (has_partitions(base) or has_metadata(base))
    if verbose:
        print(f"Validating catalog at {base}")
    valid = True
    for text in problems(spark, base):
        if fail_fast:
            raise ValueError(text)
        print(text) if verbose else warnings.warn(text, stacklevel=2)
        valid = False
    if valid and verbose:
        cells = M.partitions_from_csv(P.pointer(base, P.INFO))
        area = sum(hp.nside2pixarea(1 << o, degrees=True) for o, _ in cells)
        print(f"Found {len(cells)} partitions: about {area:0.2f} sq deg, or {area / hp.SKY_DEGREES * 100:0.2f} % of the sky.")
    return valid
