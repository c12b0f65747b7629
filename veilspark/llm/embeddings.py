"""Embedding near-dedup by an epsilon grid order join.

Unit vectors of cosine >= t lie within ``eps = sqrt(2 - 2 t)`` of each other.  Vectors are
projected on their leading principal directions and sorted by the grid cell (edge eps) of that
projection, lexicographically; the sorted sequence is cut into blocks, and the join recurses on
pairs of sequence intervals: a pair whose bounding boxes are farther apart than eps is skipped
whole, any other is halved until single blocks remain.  Block pairs that remain are compared in
matrix products; pairs near the threshold are decided in double precision.

Scale: equal vectors are collapsed first, so a group of copies is one vector with a count.
Neighbouring blocks make a tile of at most ``TILE_ROWS`` vectors.  The recursion over intervals of
tiles runs level by level as joins of their boxes; the driver pairs only the ``TOP`` largest
intervals.  A task joins two tiles, so its memory has a fixed bound, and returns one row per vector
(links, and the smallest vector it reached), never pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite parts link with nothing;
vectors of other dimension than most compare only among equals of their dimension; repeated
rows count as links of each other; a null vec_id row is kept with null component; an empty
table gives an empty result; labels and extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest, join_totals
from .spill import Scratch, materialise

THRESHOLD = 0.9
BLOCK = 1024
TILE_ROWS = 8 * BLOCK
DIRECTIONS = 6
SAMPLE_ROWS = 20_000
#: Intervals that the driver pairs, and children of an interval.
TOP = 1024
CHILD_BITS = 6
#: Vectors compared at a time within a task.
STRIP = 1024


def principal_directions(vectors: DataFrame, dim: int, k: int = DIRECTIONS, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading directions (a column each) of a bounded sample; they steer skipping only, never results."""
    n = vectors.count()
    got = vectors.where(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(max(1, n // rows))) == 0).select("embedding").limit(2 * rows).toArrow() if n else None
    if not got or not got.num_rows:
        return np.zeros(dim), np.eye(dim)[:, :k]
    x = _unit(_matrix(got.column(0).combine_chunks(), dim))
    mean = x.mean(axis=0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)
    return mean, vt[:k].T


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class BoxTree:
    """Bounding boxes of the intervals of a sequence, halved again and again."""

    def __init__(self, low: np.ndarray, high: np.ndarray, eps: float) -> None:
        n, self.eps = len(low), eps
        self.size = 1 << max(0, (n - 1).bit_length())
        self.lo, self.hi = np.full((2 * self.size, low.shape[1]), np.inf), np.full((2 * self.size, low.shape[1]), -np.inf)
        self.lo[self.size : self.size + n], self.hi[self.size : self.size + n] = low, high
        for i in range(self.size - 1, 0, -1):
            self.lo[i], self.hi[i] = np.minimum(self.lo[2 * i], self.lo[2 * i + 1]), np.maximum(self.hi[2 * i], self.hi[2 * i + 1])

    def _near(self, a_lo: np.ndarray, a_hi: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether boxes lie within eps of the nodes b; empty nodes never do."""
        gap = np.maximum(0, np.maximum(a_lo - self.hi[b], self.lo[b] - a_hi))
        full = np.isfinite(gap).all(axis=1)
        return full & ((np.where(np.isfinite(gap), gap, 0) ** 2).sum(axis=1) <= self.eps * self.eps)

    def pairs(self) -> list[tuple[int, int]]:
        """Pairs of places (i <= j) within eps, by recursion on pairs of intervals of equal length, a level at once."""
        a, b = np.array([1]), np.array([1])
        while True:
            keep = self._near(self.lo[a], self.hi[a], b)
            a, b = a[keep], b[keep]
            if not len(a) or a[0] >= self.size:
                return sorted(zip((a - self.size).tolist(), (b - self.size).tolist()))
            same = a == b
            a, b = (np.concatenate((2 * a, 2 * a + 1, 2 * a, (2 * a + 1)[~same])), np.concatenate((2 * b, 2 * b + 1, 2 * b + 1, (2 * b)[~same])))


def interval_pairs(low: np.ndarray, high: np.ndarray, eps: float) -> list[tuple[int, int]]:
    """Pairs of blocks (i <= j) whose boxes are within eps."""
    return BoxTree(low, high, eps).pairs() if len(low) else []


def near_tiles(tiles: DataFrame, cells: int, eps: float) -> DataFrame:
    """(a, b), a <= b: pairs of tiles (id, l0, h0, l1, ...) whose boxes lie within eps.

    Ids are ``partition << 32 | number`` in the order of the sequence, so their leading bits name
    the intervals that hold them.
    """
    spark = tiles.sparkSession
    box = [f"{k}{i}" for i in range(cells) for k in "lh"]
    levels, shift = [tiles.withColumn("parent", F.shiftright("id", 32))], CHILD_BITS
    while True:
        above = levels[-1].groupBy(F.col("parent").alias("id")).agg(*[(F.min if c[0] == "l" else F.max)(c).alias(c) for c in box])
        if above.count() <= TOP:
            break
        levels.append(above.withColumn("parent", F.shiftright("id", shift)))
    top = sorted(above.collect(), key=lambda r: r.id)  # TOP rows at most
    low, high = (np.array([[r[f"{k}{i}"] for i in range(cells)] for r in top]).reshape(-1, cells) for k in "lh")
    pairs = spark.createDataFrame([(top[i].id, top[j].id) for i, j in interval_pairs(low, high, eps)], "a long, b long")
    for nodes in reversed(levels):
        side = lambda x: nodes.select(F.col("parent").alias(x), F.col("id").alias(f"{x}_id"), *[F.col(c).alias(f"{x}_{c}") for c in box])  # noqa: E731,B023
        apart = [F.greatest(F.lit(0.0), F.col(f"a_l{i}") - F.col(f"b_h{i}"), F.col(f"b_l{i}") - F.col(f"a_h{i}")) for i in range(cells)]
        met = pairs.join(side("a"), "a").join(side("b"), "b").where("a_id <= b_id")
        pairs = met.where(sum(x * x for x in apart) <= eps * eps).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return pairs


SPAN = "rep long, links long, root long"


def _compare(x: np.ndarray, y: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y of cosine >= t, exact in double precision; both hold unit vectors."""
    near = x.astype(np.float32) @ y.astype(np.float32).T >= t - 1e-4
    i, j = np.nonzero(near)
    if len(i):
        good = np.einsum("ij,ij->i", x[i], y[j]) >= t
        i, j = i[good], j[good]
    return i, j


def links(vectors: DataFrame, dim: int, scratch: Scratch, threshold: float = THRESHOLD, block: int = BLOCK, tile_rows: int = TILE_ROWS, part_rows: int = 0) -> DataFrame:
    """(rep, links, root) of distinct valid vectors (rep, copies, embedding): linked rows of other vectors, and the smallest rep seen linked.

    A rep has a row for each task that found it linked.
    """
    spark = vectors.sparkSession
    eps = math.sqrt(2 - 2 * threshold) + 1e-6
    n = vectors.count()
    mean, axes = principal_directions(vectors, dim)
    cells = axes.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = (_unit(_matrix(b.column(2), dim)) - mean) @ axes if len(b) else np.zeros((0, cells))
            grid = np.floor(p / eps).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(grid[:, i]) for i in range(cells)], *[pa.array(p[:, i]) for i in range(cells)]], names=["rep", "copies", "embedding", *[f"c{i}" for i in range(cells)], *[f"p{i}" for i in range(cells)]])

    schema = "rep long, copies long, embedding array<double>, " + ", ".join([f"c{i} long" for i in range(cells)] + [f"p{i} double" for i in range(cells)])
    order = [f"c{i}" for i in range(cells)] + ["p0", "rep"]
    parts = max(1, -(-n // (part_rows or 16 * block)))
    ranged = vectors.select("rep", "copies", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(project, schema).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            at = seen + np.arange(len(b))
            seen += len(b)
            yield pa.RecordBatch.from_arrays([pa.array(part + at // tile_rows), pa.array(part + at // block), *[b.column(i) for i in (0, 1, 2)], *[b.column(3 + cells + i) for i in range(cells)]], names=["tile", "number", "rep", "copies", "embedding", *[f"p{i}" for i in range(cells)]])

    blocks = scratch.table(ranged.mapInArrow(cut, "tile long, number long, rep long, copies long, embedding array<double>, " + ", ".join(f"p{i} double" for i in range(cells))))
    # Where partitions came out small, several neighbours make a tile: a vector is sent once for each tile near its own.
    seen = blocks.select(F.shiftright("number", 32)).distinct().count()
    join = max(0, int(math.log2(max(1.0, tile_rows / 2 * seen / max(1, n)))))
    whole = F.shiftleft(F.shiftright("tile", 32 + join), 32) + F.col("tile").bitwiseAND(F.lit((1 << 32) - 1))
    blocks = blocks.withColumn("tile", whole) if join else blocks
    tiles = blocks.groupBy(F.col("tile").alias("id")).agg(*[f(f"p{i}").alias(f"{k}{i}") for i in range(cells) for k, f in (("l", F.min), ("h", F.max))])
    pairs = scratch.table(near_tiles(scratch.table(tiles), cells, eps))
    route = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"), "a", "b")
    routed = blocks.select("tile", "number", "rep", "copies", "embedding").join(route, "tile")

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_tile, b_tile = key[0].as_py(), key[1].as_py()
        table = pa.Table.from_batches(list(batches))
        number = table.column("number").to_numpy()
        order = np.argsort(number, kind="stable")
        number, rep, copies, tile = number[order], table.column("rep").to_numpy()[order], table.column("copies").to_numpy()[order], table.column("tile").to_numpy()[order]
        x = _unit(_matrix(table.column("embedding").combine_chunks(), dim)[order])
        p = (x - mean) @ axes
        _, starts, ends = _runs(number)
        of = tile[starts]
        near = interval_pairs(np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts), eps)
        total, us, vs = np.zeros(len(rep), np.int64), [], []
        for a, b in near:
            if of[a] != a_tile or of[b] != b_tile:
                continue  # both in one of two tiles: another task has them
            s1, e1, s2, e2 = starts[a], ends[a], starts[b], ends[b]
            for s in range(s2, e2, STRIP):
                e = min(e2, s + STRIP)
                i, j = _compare(x[s1:e1], x[s:e], threshold)
                i, j = i + s1, j + s
                if a == b:
                    i, j = i[i < j], j[i < j]
                np.add.at(total, i, copies[j])
                np.add.at(total, j, copies[i])
                if len(i):
                    f = forest(i, j)
                    us.append(f[0])
                    vs.append(f[1])
        root = np.arange(len(rep))
        if us:
            # forest() finds the least place; the least rep of its tree stands for it.
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            root[u] = v
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, root, rep)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(total[hit]), pa.array(least[root[hit]])], names=["rep", "links", "root"])

    return routed.select("a", "b", "tile", "number", "rep", "copies", "embedding").groupBy("a", "b").applyInArrow(run, SPAN)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[s], s, np.append(s[1:], len(values))


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    valid = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    key = F.when(F.coalesce(valid, F.lit(False)), F.sha2(F.array_join(F.transform("embedding", lambda x: F.hex(F.xxhash64(x + 0.0, F.lit(1)))), ""), 256))
    with Scratch(table.sparkSession) as scratch:
        whole = scratch.table(rows.withColumn("key", key).withColumn("dim", F.size("embedding")))
        reps = whole.where("key is not null").groupBy("key", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
        reps = scratch.table(reps)
        rows = scratch.table(whole.select("vec_id", "key"), whole)
        found = None
        for dim in sorted(r.dim for r in reps.select("dim").distinct().collect()):
            part = links(reps.where(F.col("dim") == dim).select("rep", "copies", "embedding"), dim, scratch, threshold, block)
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = table.sparkSession.createDataFrame([], SPAN)
        found = scratch.table(found)
        roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
        total = found.groupBy("rep").agg(F.sum("links").alias("links"))
        by_rep = reps.select("key", "rep", "copies").join(total, "rep", "left").join(roots.select(F.col("u").alias("rep"), F.col("v").alias("top")), "rep", "left")
        by_key = by_rep.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("top", "rep").alias("component_id"), F.col("copies").alias("n"))
        alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        linked = join_totals(rows.where("key is not null"), by_key, ["key"], rows.count()).select("vec_id", "n_links", "component_id")
        return materialise(linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
