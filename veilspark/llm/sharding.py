"""Sharding by best-fit-decreasing bin packing of indivisible groups (rows of equal text).

A group's size is the bytes of its rows.  Groups in descending order enter the shard with
the tightest remaining capacity that still holds them; shards stand in a balanced tree
ordered by that capacity.  ``fewest_shards`` minimises shards of a fixed capacity,
``even_shards`` finds by bisection the smallest capacity that a given number of shards needs.

Scale: the driver packs sizes with counts, never groups.  Groups of one size fill the tightest
shard as far as it holds them before the next, which is what packing them one by one does, so
the result is that of single groups.  Sizes up to ``EXACT`` bytes count as they are; larger ones
are rounded up to 13 leading bits, so there are at most EXACT + 4096 a doubling of them, at any
number of groups, and no shard is filled above its capacity.  The groups of a size are numbered
and look their shard up in the sorted table of runs, which has a row a size and shard.  Numbers
within a size and within a shard come from counts per part, never from sorting all in one task.

Defined cases: null text is a group of its own of size 1 a row (a text counts its bytes plus
1); repeated rows each get a slot; a null doc_id sorts first; a group above the capacity gets a
shard of its own; an empty table gives an empty result; only doc_id and text are read, so extra
columns do not matter.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import join_totals
from .spill import Scratch, materialise

#: Sizes that are packed as they are; a power of two.
EXACT = 1 << 16
ROWS_A_PART = 200_000


class CapacityTree:
    """A treap of (remaining capacity, bin): insert, and take the least that is large enough."""

    def __init__(self) -> None:
        self._root: list | None = None
        self._dice = random.Random(7)

    def insert(self, key: tuple[int, int]) -> None:
        a, b = self._split(self._root, key)
        self._root = self._merge(self._merge(a, [key, self._dice.random(), None, None]), b)

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and gives the smallest key whose capacity is at least ``need``."""
        a, b = self._split(self._root, (need, -1))
        node, parent = b, None
        while node and node[2]:
            node, parent = node[2], node
        if node is None:
            self._root = a
            return None
        if parent is None:
            b = node[3]
        else:
            parent[2] = node[3]
        self._root = self._merge(a, b)
        return node[0]

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Keys below ``key``, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(sizes: Iterable[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """Runs (size, bin, how many) of the groups given as (size, count), in the order they are packed.

    With ``bins`` given, None if they do not suffice.  Without, a size above the capacity gets a bin
    for each of its groups.
    """
    tree, opened, out = CapacityTree(), 0, []
    for size, count in sorted(sizes, reverse=True):
        if size > capacity:
            if bins is not None:
                return None
            out += [(size, opened + i, 1) for i in range(count)]
            opened += count
        while count and size <= capacity:
            found = tree.take(size)
            if found is None:
                if opened == bins:
                    return None
                found = (capacity, opened)
                opened += 1
            n = min(count, found[0] // size)
            out.append((size, found[1], n))
            tree.insert((found[0] - n * size, found[1]))
            count -= n
    return out


def fewest_shards(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    return best_fit_decreasing(sizes, capacity) or []


def even_shards(sizes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Best fit into ``bins`` shards of the smallest capacity, found by bisection."""
    if not sizes:
        return []
    low = max(max(s for s, _ in sizes), -(-sum(s * n for s, n in sizes) // bins))
    high, best = low, None
    while (best := best_fit_decreasing(sizes, high, bins)) is None:
        high += max(1, high // 64)
    while low < high:
        mid = (low + high) // 2
        if (got := best_fit_decreasing(sizes, mid, bins)) is None:
            low = mid + 1
        else:
            high, best = mid, got
    return best


def packed_size(size: Column) -> Column:
    """``size`` as it is packed: from EXACT on rounded up to 13 leading bits."""
    unit = F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) - 12).cast("long")
    return F.when(size <= EXACT, size).otherwise(F.ceil(size / unit).cast("long") * unit)


def _part(parts: int) -> Column:
    """A part for each row, whatever it holds, so that repeated rows spread; to be stored with it."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part")


def _numbered(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """``rows``, which have a ``part``, with ``number``: from 0, gapless for each value of ``by``."""
    counts = rows.groupBy(by, "part").agg(F.count("*").alias("n"))
    before = counts.select(by, "part", (F.sum("n").over(Window.partitionBy(by).orderBy("part")) - F.col("n")).alias("base"))
    at = F.row_number().over(Window.partitionBy(by, "part").orderBy(*order))
    return rows.withColumn("at", at).join(before, [by, "part"]).withColumn("number", (F.col("base") + F.col("at") - 1).cast("long")).drop("part", "at", "base")


def _placed(groups: DataFrame, runs: list[tuple[int, int, int]]) -> DataFrame:
    """(gkey, n, shard) of groups numbered within their size."""
    size, shard, n = (np.array(x, np.int64) for x in zip(*runs))
    order = np.argsort(size, kind="stable")
    size, shard, n = size[order], shard[order], n[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(size)) + 1))
    total = np.cumsum(n)
    begin = total - n
    begin -= np.repeat(begin[first], np.diff(np.append(first, len(size))))  # number of the run's first group in its size
    sent = groups.sparkSession.sparkContext.broadcast((size[first], first, begin, shard))  # a row a size and shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, first, begin, shard = sent.value
        which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(begin))))
        runs_at = (which.astype(np.int64) << 44) + begin  # sorted: by size, then number
        for b in batches:
            wanted = (np.searchsorted(sizes, b.column(2).to_numpy()).astype(np.int64) << 44) + b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shard[np.searchsorted(runs_at, wanted, "right") - 1].astype(np.int32))], names=["gkey", "n", "shard"])

    return groups.select("gkey", "n", "packed", "number").mapInArrow(run, "gkey string, n long, shard int")


def shard_documents(docs: DataFrame, shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row; groups are equal texts.

    Give ``shards`` for that many even shards, or ``capacity`` for the fewest of that capacity.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("gkey"),
    )
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.table(rows)
        total = rows.count()
        if not total:
            return materialise(rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")))
        parts = max(16, -(-total // ROWS_A_PART))
        groups = scratch.table(rows.groupBy("gkey").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).select("*", packed_size(F.col("bytes")).alias("packed"), _part(parts)))
        sizes = [(r.packed, r.n) for r in groups.groupBy("packed").agg(F.count("*").alias("n")).collect()]  # see Scale for their number
        runs = fewest_shards(sizes, capacity) if capacity else even_shards(sizes, shards)
        placed = scratch.table(_placed(_numbered(groups, "packed", "gkey"), runs), groups)
        out = scratch.table(join_totals(rows, placed, ["gkey"], total).drop("gkey").select("*", _part(parts)), rows, placed)
        out = _numbered(out, "shard", "doc_id", "text_crc32")
        return materialise(out.select("doc_id", "size", "text_crc32", "shard", F.col("number").alias("slot")))
