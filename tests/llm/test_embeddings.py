import os

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import components, embeddings
from veilspark.llm.spill import Scratch


def brute(rows, t=0.9):
    """vec_id, n_links, component_id, kept by comparing all pairs."""
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for k, (_, v) in zip(ok, rows)]
    link = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= t] for i in range(n)]
    low = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in link[i]:
                if low[j] < low[i]:
                    low[i], changed = low[j], True
    return sorted((rows[i][0], len(link[i]), low[i], rows[i][0] == low[i]) for i in range(n))


def test_equals_brute_force_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows)
    assert sorted(map(tuple, embeddings.near_duplicates(df, block=64).collect())) == want


def test_clusters_copies_and_chains(spark):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for _ in range(12):
        base = rng.normal(size=16)
        for _ in range(8):
            base = base + rng.normal(size=16) * 0.12
            rows.append((k, base.tolist()))
            k += 1
    rows += [(k + i, rows[5][1]) for i in range(40)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embeddings.near_duplicates(df, block=16).collect())) == brute(rows)
    few = df.select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies"), "embedding").where("rep < 96")
    with Scratch(spark) as scratch:
        many, one = (sorted(map(tuple, embeddings.links(few, 16, scratch, block=8, tile_rows=n).groupBy("rep").agg(F.sum("links")).collect())) for n in (16, 1000))
    assert many == one and one
    with Scratch(spark) as scratch:  # 12 small partitions, which make one tile
        small = embeddings.links(few, 16, scratch, block=8, tile_rows=1000, part_rows=8).groupBy("rep").agg(F.sum("links"))
        assert sorted(map(tuple, small.collect())) == one


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [1e30, 1e-30]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, rep int, key string")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == brute(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_interval_pairs_skip_only_distant_blocks():
    rng = np.random.default_rng(1)
    low = np.sort(rng.uniform(0, 10, (37, 2)), axis=0)
    high = low + rng.uniform(0, 0.5, (37, 2))
    got = embeddings.interval_pairs(low, high, 0.4)
    gap = lambda i, j: np.linalg.norm(np.maximum(0, np.maximum(low[i] - high[j], low[j] - high[i])))
    assert got == [(i, j) for i in range(37) for j in range(i, 37) if gap(i, j) <= 0.4]


def test_tiles_meet_by_levels(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ids = sorted((int(p) << 32) + int(k) for p in rng.choice(5000, 60, replace=False) for k in range(3))
    low = np.sort(rng.uniform(0, 10, (len(ids), 2)), axis=0)
    high = low + rng.uniform(0, 0.3, (len(ids), 2))
    df = spark.createDataFrame([(i, *map(float, (l[0], h[0], l[1], h[1]))) for i, l, h in zip(ids, low, high)], "id long, l0 double, h0 double, l1 double, h1 double")
    gap = lambda i, j: np.linalg.norm(np.maximum(0, np.maximum(low[i] - high[j], low[j] - high[i])))
    want = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i, len(ids)) if gap(i, j) <= 0.4]
    for top in (embeddings.TOP, 8, 1):
        monkeypatch.setattr(embeddings, "TOP", top)
        assert sorted(map(tuple, embeddings.near_tiles(df, 2, 0.4).collect())) == want


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 90)] + [(7, 7)]
    edges += [(9000 - i, 9999) for i in range(80)] + [(9000 - i, 8000 - i) for i in range(80)]
    low = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame(edges, "u long, v long").repartition(4)
    for heavy in (components.HEAVY, 16):  # with 16, hubs are dealt over several tasks
        monkeypatch.setattr(components, "HEAVY", heavy)
        with Scratch(spark) as scratch:
            got = [(r.u, r.v) for r in components.components(df, scratch).collect()]
            assert len(got) == len(dict(got)) and dict(got) == {k: v for k, v in low.items() if k != v}
            assert components.components(df.limit(0), scratch).count() == 0


def test_scratch_leaves_nothing_behind(spark, tmp_path):
    spark.range(3).count()
    with Scratch(spark) as scratch:
        a = scratch.table(spark.range(100).toDF("x"))
        folder = scratch._top.removeprefix("file:")
        b = scratch.table(a.selectExpr("x + 1 as x"), a)
        assert b.agg(F.sum("x")).first()[0] == 5050 and len(os.listdir(folder)) == 1
    assert not os.path.exists(folder)
