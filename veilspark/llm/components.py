"""Connected components by contracting edges around their ends.

Every edge (u, v), v < u, goes to the task of each of its ends, and each task replaces the edges
that it holds by a spanning forest whose trees are stars around their smallest vertex.  So all
edges of a vertex meet once, paths shrink on both sides of it, and a round costs one shuffle of
twice the edges.  An edge that the task of ``v`` got and would give out unchanged is left to the
task of ``u``, which keeps its ends connected, so edges don't multiply.  A round in which no task makes an edge that it did not get leaves one star a
component: had ``u`` a neighbour smaller than ``v``, neither of its tasks would give out (u, v),
and had ``v`` a smaller neighbour, the task of ``v`` would make a new edge.

Hubs: the edges to a vertex that holds more than 1/HEAVY of them are dealt over several tasks,
each of which also gets the vertex's own few edges to smaller ones.  A round's edges are a table
in the shared folder, so a lost executor costs one round, and the round before is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spill import Scratch

#: ``made``: the task that gave this edge out did not get it.
EDGES = "u long, v long, made boolean"
#: Vertices or keys of more than this share of the rows are heavy; there are fewer of them than HEAVY.
HEAVY = 1024
#: What a task knows of an edge: it made it, or got it for ``v`` only, or for ``u``.
MADE, OTHER, OWN = range(3)
#: Edges held before they are contracted.
HELD = 2_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of the given edges with the smallest vertex it reaches by them (itself left out)."""
    names, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(names))
    while True:  # hook the larger root below the smaller, then shorten all paths
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    keep = np.flatnonzero(root != np.arange(len(names)))
    return names[keep], names[root[keep]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spanning forest of all edges (u, v, own: it came for ``u``) of a task; it holds an edge a vertex and HELD more."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # u, v, what is known of the edge
    n, most = 0, HELD

    def shrunk() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, v, state = map(np.concatenate, zip(*held))
        new_u, new_v = forest(u, v)
        # Whether the edge from a vertex to its root was among those that came.
        place = np.searchsorted(new_u, u)
        place[place == len(new_u)] = 0
        same = (new_u[place] == u) & (new_v[place] == v)
        known = np.full(len(new_u), MADE, np.int8)
        np.maximum.at(known, place[same], state[same])
        return new_u, new_v, known

    for batch in batches:
        own = batch.column(2).to_numpy(zero_copy_only=False)
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.where(own, OWN, OTHER).astype(np.int8)))
        n += len(batch)
        if n > most:
            held = [shrunk()]
            n = len(held[0][0])
            most = n + max(HELD, n)
    if n:
        u, v, known = shrunk()
        stay = known != OTHER
        u, v, made = u[stay], v[stay], known[stay] == MADE
        for at in range(0, len(u), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(u[part]), pa.array(v[part]), pa.array(made[part])], names=["u", "v", "made"])


def _keyed(e: DataFrame, hubs: dict[int, int]) -> DataFrame:
    """(u, v, own, key): each edge for both its ends; hubs maps a heavy vertex to its number of keys."""
    e = e.select("u", "v")
    for_u, for_v = e.select("*", F.lit(True).alias("own"), F.xxhash64("u", F.lit(0)).alias("key")), e.select("*", F.lit(False).alias("own"), F.xxhash64("v", F.lit(0)).alias("key"))
    if not hubs:
        return for_u.unionByName(for_v)
    table = F.broadcast(e.sparkSession.createDataFrame(list(hubs.items()), "hub long, parts int"))  # below HEAVY rows
    spread = F.xxhash64("v", F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).cast("int"))
    for_v = for_v.join(table, F.col("v") == F.col("hub"), "left").withColumn("key", spread).drop("hub", "parts")
    # Each of a hub's tasks gets the hub's own edges to smaller vertices.
    of_hubs = for_u.join(table, F.col("u") == F.col("hub")).select("u", "v", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    for_u = for_u.join(table, F.col("u") == F.col("hub"), "left_anti")
    return for_u.unionByName(of_hubs.select("u", "v", "own", F.xxhash64("u", "i").alias("key"))).unionByName(for_v)


def _state(e: DataFrame) -> tuple[bool, dict[int, int]]:
    """Whether edges were made, and the hubs with the keys each needs."""
    by_v = e.groupBy("v").agg(F.count("*").alias("n"), F.max("made").alias("made"))
    n, most, made = by_v.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("made"), F.lit(False))).first()
    share = max(1, n // HEAVY)
    rows = e.groupBy("v").count().where(F.col("count") > share).collect() if made and most > share and n > HEAVY else []
    return made, {r.v: -(-r["count"] // share) for r in rows}


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): every vertex of ``edges`` (u, v) but the roots, with the smallest vertex of its component.

    Null ends and loops are ignored, repeated edges do no harm.
    """
    e = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = scratch.table(e.distinct().withColumn("made", F.lit(True)))
    made, hubs = True, _state(e)[1]
    while made:
        e = scratch.table(_keyed(e, hubs).repartition("key").select("u", "v", "own").mapInArrow(_contract, EDGES), e)
        made, hubs = _state(e)
    return scratch.table(e.select("u", "v").distinct(), e)


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined with a row a key, whose ``n`` counts the key's rows of all ``total``.

    Heavy keys are broadcast and their rows are not dealt by key, so no task takes a whole one.
    """
    light = F.col("n") <= total // HEAVY
    heavy = totals.where(~light).select(*keys, F.struct(*totals.drop(*keys, "n").columns).alias("__heavy"))
    tagged = rows.join(F.broadcast(heavy), keys, "left")
    near = tagged.where("__heavy is not null").select(*rows.columns, "__heavy.*")
    return near.unionByName(tagged.where("__heavy is null").select(*rows.columns).join(totals.where(light).drop("n"), keys))


def one_a_key(rows: DataFrame, wanted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """One of the rows of each key of ``wanted``, whose ``n`` counts the key's rows of all ``total``.

    Rows of heavy keys are found by a broadcast and thinned out in each task before they are dealt.
    """
    heavy = wanted.where(F.col("n") > total // HEAVY).select(*keys)
    light = wanted.where(F.col("n") <= total // HEAVY).select(*keys)
    if heavy.isEmpty():
        return rows.join(light, keys, "left_semi").dropDuplicates(keys)
    near = rows.join(F.broadcast(heavy), keys, "left_semi").dropDuplicates(keys)
    far = rows.join(F.broadcast(heavy), keys, "left_anti").join(light, keys, "left_semi").dropDuplicates(keys)
    return near.unionByName(far)
