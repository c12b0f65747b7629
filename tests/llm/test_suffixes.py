import hashlib
import random

import numpy as np

from veilspark.llm import suffixes


def brute(rows, n=100):
    """Kept bytes and maximal removed runs of each (doc_id, text)."""
    rows = sorted(rows, key=lambda r: r[0])
    seen, out = set(), {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if w in seen:
                gone[i : i + n] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        runs = int(np.sum(gone[:-1] & ~np.concatenate(([False], gone[:-2])))) if len(b) else 0
        out[d] = (len(b), hashlib.sha256(kept).hexdigest(), runs)
    return out


def got(df, **more):
    return {r.doc_id: (r.n_bytes, hashlib.sha256(r.kept).hexdigest(), len(r.spans)) for r in suffixes.remove_repeats(df, **more).collect()}


def test_equals_brute_force_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert sum(w[2] > 0 for w in want.values()) > 50
    assert got(df) == want


def shared_passages():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(160):
        cut = passage[r.randint(0, 40) : len(passage) - r.randint(0, 40)]
        rows.append((i, " ".join(word() for _ in range(r.randint(0, 30))) + cut + " ".join(word() for _ in range(r.randint(0, 30)))))
    rows += [(200, "a" * 1000), (201, "b" + "a" * 350), (202, "ab" * 300), (203, passage * 4), (204, "x" * 99), (205, None), (206, "")]
    return rows


def test_hot_anchors_and_periodic_texts(spark):
    rows = shared_passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    for parts in (1, 5):  # several runs of one rank over several partitions
        assert got(df.repartition(parts)) == want
    assert got(df, lengths=(50, 100)) == got(df, lengths=(100,)) == want


def test_odd_rows(odd, empty):
    df, rows = odd
    want = brute(list({i: (i, t) for i, t, *_ in rows}.values()))
    assert got(df) == want
    assert suffixes.remove_repeats(df).count() == len(rows)
    assert suffixes.remove_repeats(empty).count() == 0


def test_null_ids_hide_nothing(spark):
    r = random.Random(1)
    t = "".join(r.choice("abc ") for _ in range(300))
    df = spark.createDataFrame([(None, t), (5, t)], "doc_id long, text string")
    assert {r.doc_id: len(r.kept) for r in suffixes.remove_repeats(df).collect()} == {None: 300, 5: 300}


def test_repeated_rows_in_one_block_are_one_document(spark):
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared = text(40)
    rows = [(1, text(50)), (2, text(20) + shared), (3, shared + text(30)), (4, "ab" * 200)]
    df = spark.createDataFrame(rows + rows + rows[1:2], "doc_id long, text string")
    want = brute(rows)
    assert want[1][2] == want[2][2] == 0 and want[3][2] == 1
    for laid in (df.coalesce(1), df.repartition(6)):
        out = suffixes.remove_repeats(laid).collect()
        assert len(out) == 9
        assert {(x.doc_id, x.n_bytes, hashlib.sha256(x.kept).hexdigest(), len(x.spans)) for x in out} == {(d, *w) for d, w in want.items()}


def test_one_anchor_in_very_many_different_runs(spark):
    # A phrase of 60 bytes in 20,000 texts, each with other words around it; one text in a hundred has a twin.
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    phrase = "the one phrase that stands in every text of this whole table"
    rows = [(i, f"{word()} {word()} {word()} {word()} {word()} {phrase} {word()} {word()} {word()} {word()} {word()}") for i in range(20_000)]
    rows += [(20_000 + i, "x" + rows[i * 100][1][3:-4]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert got(df) == brute(rows)


def test_long_texts_are_cut_into_blocks(spark):
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared = text(80)
    rows = [(1, text(200_000) + shared + text(200_000)), (2, shared), (3, text(190_000) + shared + text(3) + shared), (4, text(174_750) + shared)]
    assert max(len(t) for _, t in rows) > 2 << 20
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_ranks_are_resolved_across_partitions():
    import itertools

    from pyspark.sql import Row

    r = random.Random(7)
    for _ in range(300):
        rows = sorted((r.randint(0, 2), r.randint(0, 2), d) for d in range(r.randint(1, 8)))
        cuts = sorted(r.choices(range(len(rows) + 1), k=3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        edges, settled = [], []
        for n, part in enumerate(p for p in parts if p):
            first = {k: next(g) for k, g in itertools.groupby(part, key=lambda x: x[:2])}
            kinds = {k: sum(x[0] == k for x in first) for k, _ in first}
            row = lambda x, kind: Row(rank=x[0], text=x[1], place=x[2], kind=kind, part=n, several=kinds[x[0]] > 1)
            edges += [row(part[0], suffixes.HEAD), row(part[-1], suffixes.LAST)]
            for x in part[1:]:
                if first[x[:2]] != x:
                    settled.append((True, x))
                elif kinds[x[0]] > 1:
                    settled.append((False, x))
                elif x[0] == part[-1][0]:
                    edges.append(row(x, suffixes.TAIL))
        # An open row of a rank that only the next partition shows to be shared waits as TAIL or HEAD.
        got = sorted(settled + [(was, (e.rank, e.text, e.place)) for was, e in suffixes.resolve(edges)])
        first = {k: next(g) for k, g in itertools.groupby(rows, key=lambda x: x[:2])}
        kinds = {k: sum(x[0] == k for x in first) for k, _ in first}
        want = sorted([(True, x) for x in rows if first[x[:2]] != x] + [(False, x) for x in first.values() if kinds[x[0]] > 1])
        assert got == want
