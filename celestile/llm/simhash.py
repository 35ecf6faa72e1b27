"""SimHash near-duplicates, joined through pivot distance tables (operator 9).

Fingerprints that differ in at most ``max_distance`` bits are linked; documents
get the smallest id that can be reached over links.

* Every distinct fingerprint is compared once, whatever its number of copies.
* Pairs are formed in exact pigeonhole blocks: the 64 bits are cut into
  ``max_distance + r`` runs, and two linked fingerprints agree on at least ``r`` of
  them, so sharing the runs of one of the ``C(max_distance + r, r)`` choices loses
  no link. ``r`` follows from the number of fingerprints alone, by cost.
* A table holds the Hamming distances of each fingerprint to ``PIVOTS`` reference fingerprints, found
  once. Inside a block it discards pairs: by the triangle inequality a linked pair differs by at most
  ``max_distance`` in every coordinate. The block is sorted by the first
  coordinate, so whole runs of pairs are never formed; the others discard by the
  largest difference; survivors are verified on the bits.
* Blocks over ``BLOCK`` fingerprints are dealt as pairs of chunks, each pair a group
  of its own; a group emits a spanning forest of its links, never all of them.

``similar`` adds the pairs whose sets of shingles have a Jaccard similarity of
``SIMILAR`` or more: candidates share one of ``BANDS`` bands of ``ROWS`` minima (at 0.8
a pair shares none with a probability of 3e-5), differ in at most ``LOOSE`` bits of
the wide fingerprint (four deviations over the average at 0.8), and are verified on
the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from celestile.llm.batches import coded, runs
from celestile.llm.graph import components
from celestile.llm.packed import mix
from celestile.llm.scratch import Scratch

SEED = 42
BLOCK = 4096
PIVOTS = 16
#: Fixed reference fingerprints: hashes of their own numbers.
REFERENCES = np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), 7) for i in range(PIVOTS)], dtype=np.uint64)
_STEP = 1 << 16
SIMILAR = 0.8
BANDS, ROWS = 20, 4
LOOSE = 64
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
#: Bytes of sets, or rows without them, that a task gathers before it works on whole groups.
_HELD = 1 << 25


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(w: list[bytes], width: int) -> list[bytes]:
    """Runs of ``width`` words, repeats included; the whole sequence if it is shorter."""
    if len(w) < width:
        return [b" ".join(w)] if w else []
    return w if width == 1 else [b" ".join(x) for x in zip(*(w[i:] for i in range(width)))]


def simhash(items: list[bytes]) -> int:
    """Bit ``i`` is 1 if set in over half of the items' XXH64 (seed 42); 0 without items."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(items), _STEP):
        digests = b"".join(map(xxhash.xxh64_digest, items[at : at + _STEP], repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    value = 0
    for bit in (2 * ones > len(items)).tolist():  # digests are big-endian: the first bit is the highest
        value = value << 1 | bit
    return value


@dataclass
class Sets:
    """Sets of shingles of some texts, in the order of the texts."""

    fp: np.ndarray
    #: SimHashes of 256 bits, four numbers each
    wide: np.ndarray
    #: a number of each set
    sig: np.ndarray
    #: bands of minima, none without shingles
    bands: np.ndarray
    #: sorted 32-bit hashes of all sets in a row, and where each text's begin
    items: np.ndarray
    at: np.ndarray


def sets(texts: pa.Array, width: int) -> Sets:
    """Of the distinct shingles of each text, all from one 64-bit hash of each: hashes of the hashes of
    their words."""
    ids, hashes, sizes = coded(texts)
    h, n, words = hashes[ids], len(sizes), sizes - 1
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(n), sizes)
    nth = np.arange(len(ids)) - begin[doc]
    head = np.nonzero(nth + width <= words[doc])[0]
    s = np.zeros(len(head), np.uint64)
    for k in range(width):
        s = mix(s * np.uint64(3) + h[head + k])
    short = np.nonzero((words > 0) & (words < width))[0]
    t = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        t = np.where(k < words[short], mix(t * np.uint64(3) + h[np.minimum(begin[short] + k, len(h) - 1)]), t)
    s, doc = np.r_[s, t], np.r_[doc[head], short]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])] if len(s) else np.zeros(0, bool)
    s, doc = s[new], doc[new]
    count = np.bincount(doc, minlength=n)
    ones, least, total = np.zeros((n, 320), np.int32), np.full((n, BANDS * ROWS), np.iinfo(np.uint64).max, np.uint64), np.zeros(n, np.uint64)
    for a in range(0, len(s), 1 << 13):
        x, d = s[a : a + (1 << 13)], doc[a : a + (1 << 13)]
        at = np.r_[0, np.nonzero(d[1:] != d[:-1])[0] + 1]
        own = d[at]
        spread = np.stack([x, *(mix(x + np.uint64(i)) for i in range(1, 5))], axis=1)
        ones[own] += np.add.reduceat(np.unpackbits(spread.astype(">u8").view(np.uint8), axis=1), at, axis=0, dtype=np.int32)
        least[own] = np.minimum(least[own], np.minimum.reduceat(x[:, None] * (_RANDOM[0] | np.uint64(1)) + _RANDOM[1], at, axis=0))
        total[own] += np.add.reduceat(mix(x + np.uint64(5)), at)
    bits = np.packbits(2 * ones > count[:, None], axis=1).view(">u8").astype(np.uint64)
    bands = np.zeros((n, BANDS), np.uint64)
    for i in range(ROWS):
        bands = mix(bands * np.uint64(3) + least[:, i::ROWS][:, :BANDS])
    high = (s >> np.uint64(32)).astype("<u4")
    one = np.r_[True, (high[1:] != high[:-1]) | (doc[1:] != doc[:-1])] if len(s) else np.zeros(0, bool)
    at = np.r_[0, np.cumsum(np.bincount(doc[one], minlength=n))]
    return Sets(bits[:, 0], bits[:, 1:], np.where(count > 0, mix(total + count.astype(np.uint64)), 0), bands, high[one], at)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: The columns of the pivot distance table.
TABLE = [f"p{i}" for i in range(PIVOTS // 8)]
#: The columns of a wide fingerprint.
WIDE = ["c0", "c1", "c2", "c3"]


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, fp)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [signed(simhash(shingles(words(text.as_py()), width))) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def set_prints(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, fp, c0 to c3, sig, bands, items)`` of every row, from its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in runs(batch.column("text"), 1 << 22):
                got = sets(batch.column("text")[x:y], width)
                whole = lambda a: pa.array(np.ascontiguousarray(a).view(np.int64))
                full = np.diff(got.at) > 0
                bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(full * BANDS)].astype(np.int32)), whole(got.bands[full].ravel()))
                items = pa.Array.from_buffers(pa.binary(), y - x, [None, pa.py_buffer((4 * got.at).astype(np.int32)), pa.py_buffer(got.items.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[x:y], whole(got.fp), *(whole(got.wide[:, i]) for i in range(4)), whole(got.sig), bands, items], ["doc_id", "fp", *WIDE, "sig", "bands", "items"])

    kind = "doc_id long, fp long, c0 long, c1 long, c2 long, c3 long, sig long, bands array<long>, items binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)


#: What dealing out a row costs, in comparisons of two.
ROW_COST = 500


def masks(max_distance: int, n: int) -> list[int]:
    """One mask of bits for each choice of ``r`` of ``max_distance + r`` runs. Every ``r`` is
    exact; the one of least cost is taken: rows dealt, and comparisons within blocks of
    ``n / 2 ** bits`` fingerprints."""

    def cost(r: int) -> float:
        return math.comb(max_distance + r, r) * (ROW_COST + n / 2 ** (64 * r // (max_distance + r)))

    r = min(range(1, 9), key=cost)
    runs = max_distance + r
    edges = [64 * i // runs for i in range(runs + 1)]
    of_run = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(runs)]
    return [signed(sum(of_run[i] for i in c)) for c in combinations(range(runs), r)]


def pivots(fp: Column) -> list[Column]:
    """Distances to the references, a byte each, eight to a number."""
    far = lambda i: F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(signed(int(REFERENCES[i]))))).cast("long"), 8 * (i % 8))
    return [reduce(Column.bitwiseOR, map(far, range(a, a + 8))).alias(f"p{a // 8}") for a in range(0, PIVOTS, 8)]


def _forest(group: np.ndarray, node: np.ndarray, fp: np.ndarray, table: np.ndarray, chk: np.ndarray | None, reach: int, chk_reach: int) -> tuple[list, list]:
    """A spanning forest of the links within each group. Rows come sorted by group and
    distance to the first reference; ``table`` has the distances to all."""
    n = len(fp)
    first = table[:, 0]
    parent = np.arange(n)
    left: list[int] = []
    right: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    i, k = np.arange(n - 1 if n else 0), 1
    while i.size:
        i = i[i + k < n]
        j = i + k
        near = (group[i] == group[j]) & (first[j] - first[i] <= reach)
        i = i[near]
        j = i + k
        a = i[parent[i] != parent[j]]
        for at in range(1, PIVOTS, 5):
            if a.size:
                a = a[(np.abs(table[a, at : at + 5] - table[a + k, at : at + 5]) <= reach).all(axis=1)]
        if a.size:
            a = a[np.bitwise_count(fp[a] ^ fp[a + k]) <= reach]
        if a.size and chk is not None:
            a = a[np.bitwise_count(chk[a] ^ chk[a + k]).sum(axis=1) <= chk_reach]
        for x in a.tolist():
            p, q = find(x), find(x + k)
            if p != q:
                parent[max(p, q)] = min(p, q)
                left.append(int(node[x]))
                right.append(int(node[x + k]))
        if a.size:
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
        k += 1
    return left, right


def _links(max_distance: int, chk_distance: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(b: pa.RecordBatch) -> list[np.ndarray]:
            return [b.column(c).to_numpy(zero_copy_only=False) for c in names]

        names = ["t", "k", "a", "b", "node", "fp", *TABLE] + (WIDE if chk_distance is not None else [])
        held: list[list[np.ndarray]] = []
        rows = 0

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            cols = [np.concatenate(x) for x in zip(*held)] if held else []
            held, rows = [], 0
            if not cols or not len(cols[0]):
                return
            key = np.stack([c.astype(np.int64) for c in cols[:4]], axis=1)
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
            cut = len(new) if last else int(np.nonzero(new)[0][-1])
            if cut < len(new):
                held, rows = [[c[cut:] for c in cols]], len(new) - cut
            group = np.cumsum(new)[:cut]
            part = [c[:cut] for c in cols]
            of = 6 + len(TABLE)
            table = np.stack(part[6:of], axis=1).astype("<i8").view(np.int8)
            chk = np.stack(part[of:], axis=1).astype(np.int64).view(np.uint64) if chk_distance is not None else None
            x, y = _forest(group, part[4], part[5].astype(np.int64).view(np.uint64), table, chk, max_distance, chk_distance or 0)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["src", "dst"])

        for batch in batches:
            held.append(columns(batch))
            rows += batch.num_rows
            if rows >= 4 * BLOCK + 65536:
                yield from work(False)
        yield from work(True)

    return run


def links(nodes: DataFrame, scratch: Scratch, max_distance: int, chk_distance: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(src, dst)`` of node numbers: per block a spanning forest of all links between
    the written ``nodes (node, fp, p0, p1[, c0 to c3])``."""
    keep = ["node", "fp", *TABLE] + (WIDE if chk_distance is not None else [])
    choice = masks(max_distance, nodes.count())
    spread = nodes.select(*keep, F.posexplode(F.array(*[F.lit(m) for m in choice])).alias("t", "mask"))
    spread = chunked(spread.select(*keep, "t", F.col("fp").bitwiseAND(F.col("mask")).alias("k")), scratch, block)
    order = F.col(TABLE[0]).bitwiseAND(F.lit(255))
    dealt = spread.select("t", "k", "a", "b", *keep).repartition("t", "k", "a", "b").sortWithinPartitions("t", "k", "a", "b", order)
    return dealt.mapInArrow(_links(max_distance, chk_distance), "src long, dst long")


def chunked(spread: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """``spread (t, k, node, ...)`` with the pair of chunks ``(a, b)`` that a row is dealt to."""
    large = scratch.save(spread.groupBy("t", "k").count().where(F.col("count") > block), "large-blocks")
    n_large = large.count()
    if n_large:
        # At most (rows / block) of them; broadcast only when that is known to be few.
        other = F.broadcast(large) if n_large <= 50_000 else large
        spread = spread.join(other, ["t", "k"], "left").withColumn("chunks", F.coalesce(F.ceil(F.col("count") / (block // 2)), F.lit(1)).cast("int"))
        spread = spread.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        return spread.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    return spread.withColumns({"a": F.lit(0), "b": F.lit(0)})


_GROUP = ["t", "k", "a", "b"]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, each with where its groups begin and the last ends."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, size
        table = pa.Table.from_batches(held).combine_chunks()
        key = np.stack([table[c].to_numpy().astype(np.int64) for c in _GROUP], axis=1)
        edges = np.r_[0, np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1]
        end = len(key) if last else int(edges[-1])
        if end:
            yield table.slice(0, end), np.r_[edges[edges < end], end]
        held = table.slice(end).to_batches()
        size = sum(b.nbytes for b in held)

    limit = _HELD
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > limit:
            yield from cut(False)
            limit = max(_HELD, 2 * size)
    if held:
        yield from cut(True)


def _pairs(chk: np.ndarray, root: np.ndarray, before: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group that belong to several roots, whose wide fingerprints are close and that
    share none of the bands ``before`` this group's, where they have met already."""
    if len(root) > 1 and (root != root[0]).any():
        for i in range(len(root) - 1):
            j = i + 1 + np.nonzero(root[i + 1 :] != root[i])[0]
            j = j[np.bitwise_count(chk[j] ^ chk[i]).sum(axis=1) <= LOOSE]
            if before is not None and len(j):
                j = j[(before[j] != before[i]).all(axis=1)]
            if len(j):
                yield i, j


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([table[c].to_numpy() for c in WIDE], axis=1).view(np.uint64), table["root"].to_numpy()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a candidate in their group; a pair counts in the first band it shares."""
    for table, edges in _whole_groups(batches):
        chk, root = _sides(table)
        bands, t = np.frombuffer(b"".join(table["all"].to_pylist()), "<i8").reshape(-1, BANDS), table["t"].to_numpy()
        met = np.zeros(len(root), bool)
        for x, y in zip(edges, edges[1:]):
            for i, j in _pairs(chk[x:y], root[x:y], bands[x:y, : t[x]]):
                met[x + i] = met[x + j] = True
        yield from table.drop_columns(["all"]).filter(pa.array(met)).to_batches()


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest, between roots, of the pairs whose sets are similar."""
    for table, edges in _whole_groups(batches):
        chk, root = _sides(table)
        items = table["items"]
        left, right = [], []
        for x, y in zip(edges, edges[1:]):
            top: dict[int, int] = {}

            def find(r: int) -> int:
                while r in top:
                    r = top[r]
                return r

            sets: dict[int, np.ndarray] = {}

            def of(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = np.frombuffer(items[int(x + i)].as_py(), "<u4")
                return sets[i]

            for i, js in _pairs(chk[x:y], root[x:y]):
                for j in js.tolist():
                    p, q = find(int(root[x + i])), find(int(root[x + j]))
                    if p == q:
                        continue
                    a, b = of(i), of(j)
                    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
                        continue
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if both >= SIMILAR * (len(a) + len(b) - both):
                        top[max(p, q)] = min(p, q)
                        left.append(p)
                        right.append(q)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["src", "dst"])


def similar(placed: DataFrame, prints: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """``(src, dst)`` of roots that hold texts whose sets of shingles are similar, of the
    written ``placed (node, root, sig, bands, c0 to c3)``. Sets are dealt only to the
    groups where they have a candidate of another root that they share no earlier band with.

    Bands go through the exchanges with two numbers a row until those of a single root are gone; a set is
    taken from one row of each of its copies in a partition before it is dealt."""
    keep = ["node", "root", "sig", *WIDE]
    spread = placed.select("node", "root", F.posexplode("bands").alias("t", "k"))
    shared = spread.groupBy("t", "k").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("t", "k")
    spread = scratch.save(spread.select("t", "k", "node").join(scratch.save(shared, "bands"), ["t", "k"], "left_semi"), "shared")
    # All bands of a row as bytes, eight each, in order.
    every = F.unhex(F.concat_ws("", F.transform("bands", lambda x: F.lpad(F.hex(x), 16, "0"))))
    spread = chunked(spread.join(placed.select(*keep, every.alias("all")), "node"), scratch, block)
    dealt = lambda df, *more: df.select(*_GROUP, *keep, *more).repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    kind = "t int, k long, a int, b int, node long, root long, sig long, c0 long, c1 long, c2 long, c3 long"
    met = scratch.save(dealt(spread, "all").mapInArrow(_meet, kind), "met")
    sets = prints.where(F.length("items") > 0).groupBy("sig").agg(F.first("items").alias("items"))
    return dealt(met.join(sets, "sig"), "items").mapInArrow(_alike, "src long, dst long")


def groups(spark: SparkSession, docs: DataFrame, width: int = 4, max_distance: int = 4, check_distance: int | None = None) -> DataFrame:
    """``(doc_id, fp[, c0 to c3, sig], component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest non-null doc_id that can be reached over links,
    the row's own included; null only if no row of the component has an id. Null and
    blank texts have fingerprint 0 and are linked like any other. Repeated rows and
    repeated ids are kept as they are; other columns are ignored; an empty table
    gives an empty result.

    With ``check_distance`` all is taken from the distinct shingles: a link needs the
    fingerprints to differ in at most ``max_distance`` bits and the wide ones in at most
    ``check_distance`` of 256, or else the sets to be similar (``similar``).
    """
    scratch = Scratch(spark, "simhash")
    marks = ["fp"] if check_distance is None else ["fp", *WIDE, "sig"]
    prints = scratch.save(fingerprints(docs, width) if check_distance is None else set_prints(docs, width), "prints")
    more = [] if check_distance is None else [F.first("bands").alias("bands")]
    nodes = prints.groupBy(*marks).agg(F.min("doc_id").alias("rep"), *more).withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.save(nodes.select("*", *pivots(F.col("fp"))), "nodes")
    found = components(links(nodes, scratch, max_distance, check_distance), scratch)
    rest = [] if check_distance is None else ["node", "bands"]
    placed = scratch.save(nodes.join(found, "node", "left").select(*marks, *rest, "rep", F.coalesce("root", "node").alias("root")), "placed")
    if check_distance is not None:
        joined = components(similar(placed, prints, scratch), scratch).select(F.col("node").alias("root"), F.col("root").alias("top"))
        placed = scratch.save(placed.join(joined, "root", "left").select(*marks, "rep", F.coalesce("top", "root").alias("root")), "joined")
    least = scratch.save(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = scratch.save(placed.join(least, "root").select(*marks, "component_id"), "named")
    return prints.drop("bands", "items").join(named, marks, "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = groups(spark, docs, width=4, max_distance=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
