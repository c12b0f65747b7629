import random
import re
from collections import defaultdict

import numpy as np

from veilspark.llm import jaccard


def grams(text):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, t=0.8):
    sets = [grams(x) for _, x in rows]
    link = defaultdict(set)
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            index[g].append(i)
    for own in index.values():
        for i in own:
            for j in own:
                if i < j and j not in link[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    link[i].add(j)
                    link[j].add(i)
    low = [d for d, _ in rows]
    moved = True
    while moved:
        moved = False
        for i, js in list(link.items()):
            for j in js:
                if low[j] < low[i]:
                    low[i], moved = low[j], True
    return sorted((rows[i][0], low[i], len(link[i])) for i in range(len(rows)))


def test_join_equals_brute_force_on_the_tables(spark):
    for sf in ("sf0.001", "sf0.01"):
        df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted(map(tuple, jaccard.jaccard_classes(df).collect())) == brute(rows)


def near_group(n, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for k in r.sample(range(150), r.randint(0, 4)):
            words[k] = r.choice(vocabulary)
        out.append(" ".join(words))
    return out


def test_large_groups_are_dealt_in_blocks(spark):
    rows = [(i, t) for i, t in enumerate(near_group(120) + ["same words in this very text here"] * 50 + [f"one two three four five {i}" for i in range(30)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sorted(map(tuple, jaccard.jaccard_classes(df, group=32).collect())) == want
    assert sorted(map(tuple, jaccard.jaccard_classes(df).collect())) == want


def test_odd_rows(odd, empty):
    df, rows = odd
    assert sorted(map(tuple, jaccard.jaccard_classes(df).collect())) == brute([(i, t) for i, t, *_ in rows])
    assert jaccard.jaccard_classes(empty).count() == 0
    left = jaccard.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 5, 6, 7, 8]


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_classes(df).collect()), key=str)
    assert got == [(1, 1, 1), (2, 1, 1), (None, None, 0)]
    assert jaccard.drop_near_duplicates(df).count() == 2


def test_clashing_columns_and_ids_of_several_texts(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(20))
    rows = [(1, text(1), 7, 8, 9), (2, text(1), 7, 8, 9), (3, text(3), 7, 8, 9), (3, text(4), 7, 8, 9), (3, text(3), 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id int, __n int, __kept int")
    left = jaccard.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, text(1)), (3, text(3)), (3, text(4))]


def test_pruning_keeps_the_posterior_law():
    rng = np.random.default_rng(5)
    for n in (16, 64, 160):
        m = jaccard.least_matches(n, 0.8, 0.01)
        for k, over in ((m, True), (m - 1, False)):
            tail = (rng.beta(k + 1, n - k + 1, 400_000) >= 0.8).mean()
            assert (tail >= 0.0085) == over or abs(tail - 0.01) < 0.002
    assert jaccard.least_matches(160) < 128
