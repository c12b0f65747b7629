"""Centroid clustering by plain Lloyd rounds in whole numbers.

A component x becomes floor(scale * x).  The first centroids are the vectors of the smallest
hashes of their ids.  In each round ``mapInPandas`` gets the centroids with its function (the
broadcast: k vectors), takes squared differences to each of them in NumPy, and assigns a vector to
the nearest (ties: the lowest index); every task sums its vectors by cluster, ``groupBy`` adds the
tasks' sums, and the driver divides k sums.  All arithmetic is exact, so results depend neither
on how rows are dealt nor on the order of addition.

Scale: a round reads the vectors once and shuffles at most k * (d + 2) numbers a task, whatever
the number of rows or the size of a cluster.  Vectors are checkpointed once as packed integers, so a lost
executor costs part of one round.  Sums travel as 32-bit limbs, so they cannot overflow.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are
left out; components of 2**26 and more are computed with Python's integers, and distances beyond
a long are given as its largest value; repeated rows count each; of vectors that share an id, the
smaller seeds first; null ids seed last; fewer vectors than centroids give as many centroids as vectors;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spill import materialise, small_batches

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Whole numbers below it stay within 64 bits when differences are squared and added.
NARROW = 1 << 26
MOST = (1 << 63) - 1
LIMB = 32
#: Rows compared at a time.
CHUNK = 8192


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly, for any finite x."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def packed(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """vec_id, ints (32-bit whole numbers) and wide (null, or the components of a vector with larger ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dimensions)
            with np.errstate(over="ignore"):
                y = np.floor(x * scale)
            narrow = (np.abs(y) < NARROW).all(axis=1)
            ints = np.where(narrow[:, None], y, 0).astype("<i4")
            wide = [None if n else row.tobytes() for n, row in zip(narrow, x)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in ints], pa.binary()), pa.array(wide, pa.binary())], names=["vec_id", "ints", "wide"])

    x = F.col("embedding").cast("array<double>").alias("x")
    good = (F.size("x") == dimensions) & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return small_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), x).where(good).mapInArrow(run, "vec_id long, ints binary, wide binary")


def _numbers(ints: pd.Series, wide: pd.Series, dimensions: int, scale: int) -> np.ndarray:
    """The vectors of a batch as whole numbers: 64-bit, or Python's if any is wide."""
    x = np.frombuffer(b"".join(ints), "<i4").reshape(-1, dimensions).astype(np.int64)
    large = np.flatnonzero(wide.notna())
    if len(large):
        x = x.astype(object)
        for i in large:
            x[i] = [whole(v, scale) for v in np.frombuffer(wide.iloc[i]).tolist()]
    return x


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid and its squared distance."""
    exact = x.dtype == object or any(abs(v) >= NARROW for c in centroids for v in c)
    x = x.astype(object) if exact else x
    best, least = np.zeros(len(x), np.int64), None
    for k, c in enumerate(centroids):
        diff = x - np.array(c, x.dtype)
        d = (diff * diff).sum(axis=1) if exact else np.einsum("ij,ij->i", diff, diff)
        if least is None:
            least = d
        else:
            closer = d < least
            best[closer], least = k, np.where(closer, d, least)
    return best, least


def _total(values: np.ndarray) -> int:
    """The exact sum of numbers of up to 63 bits, or of Python's."""
    if values.dtype == object:
        return sum(values.tolist())
    return (int((values >> LIMB).sum()) << LIMB) + int((values & ((1 << LIMB) - 1)).sum())


def sums(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[tuple[list[int], int, int]]:
    """Per cluster: componentwise sums, number of vectors, sum of squared distances."""
    k, dimensions = len(centroids), len(centroids[0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [[0] * (dimensions + 2) for _ in range(k)]
        for frame in frames:
            for s in range(0, len(frame), CHUNK):
                x = _numbers(frame["ints"].iloc[s : s + CHUNK], frame["wide"].iloc[s : s + CHUNK], dimensions, scale)
                cluster, distance = nearest(x, centroids)
                for c in np.unique(cluster):
                    own = cluster == c
                    add = [*x[own].sum(axis=0).tolist(), int(own.sum()), _total(distance[own])]
                    total[c] = [a + b for a, b in zip(total[c], add)]
        rows = []
        for c, values in enumerate(total):
            for place, v in enumerate(values):
                sign, rest, limb = (-1 if v < 0 else 1), abs(v), 0
                while rest:
                    rows.append((c, place, limb, sign * (rest & ((1 << LIMB) - 1))))
                    rest, limb = rest >> LIMB, limb + 1
        yield pd.DataFrame(rows, columns=["cluster", "place", "limb", "value"])

    added = vectors.select("ints", "wide").mapInPandas(run, "cluster int, place int, limb int, value long").groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value"))
    out = [[0] * (dimensions + 2) for _ in range(k)]
    for r in added.collect():  # at most k * (dimensions + 2) * limbs rows
        out[r.cluster][r.place] += r.value << (LIMB * r.limb)
    return [(v[:dimensions], v[dimensions], v[dimensions + 1]) for v in out]


def seeds(vectors: DataFrame, k: int, seed: int, dimensions: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(h.asc_nulls_last(), "ints", "wide").limit(k).collect()
    return [[whole(v, scale) for v in np.frombuffer(r.wide).tolist()] if r.wide else np.frombuffer(r.ints, "<i4").tolist() for r in first]


def lloyd(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector kept."""
    schema = "vec_id string, cluster int, distance long"
    rows = materialise(packed(vectors, dimensions, scale))
    centroids = seeds(rows, k, seed, dimensions, scale)
    for _ in range(rounds if centroids else 0):
        centroids = [[s // n for s in total] if n else c for c, (total, n, _) in zip(centroids, sums(rows, centroids, scale))]
    inertia = [x for _, _, x in sums(rows, centroids, scale)] if centroids else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s in range(0, len(frame), CHUNK):
                part = frame.iloc[s : s + CHUNK]
                cluster, distance = nearest(_numbers(part["ints"], part["wide"], dimensions, scale), centroids)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "cluster": cluster.astype(np.int32), "distance": np.minimum(distance, MOST).astype(np.int64)})

    # Ids pass as text: pandas has no null among whole numbers.
    got = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "ints", "wide").mapInPandas(run, schema) if centroids else rows.sparkSession.createDataFrame([], schema)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>"), F.col("cluster") + 1)
    own = pick([min(x, MOST) for x in inertia], "long")
    return got.select(F.col("vec_id").cast("long").alias("vec_id"), "cluster", "distance", own.alias("cluster_inertia"), F.lit(min(sum(inertia), MOST)).cast("long").alias("inertia"), pick(names, "string").alias("centroid_sha256"))
