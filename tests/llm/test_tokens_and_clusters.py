import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm import alignment, jaccard, lloyd, mixing, tokenfile
from veilspark.llm.components import one_a_key
from veilspark.llm.text import text_bytes
from veilspark.llm.tokens import Encoder, parts, unit_starts

import pyarrow as pa

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def thue_morse(letters):
    """Two different texts on which any polynomial hash modulo 2**64 agrees."""
    a = "a"
    while len(a) < letters:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


# -- ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units_give_the_tokenizers_ids(name):
    r = random.Random(3)
    pool = [*"aAbBzZéßÉΣσςİıŉſﬁ0９ \t\n\r\x0b\x1c\x85\xa0   　'’“.,<|>日本語한😀̀ͅ", "<|endoftext|>", "'s", "'LL", " the", " don't", "   "]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(5000)] + ["", *thue_morse(1024), *thue_morse(4096)]
    enc = Encoder(path(name))
    for _ in range(2):  # the second time all units are known
        ids, at = enc.encode(*text_bytes(pa.array(texts)))
        want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:])] == want


def test_a_unit_under_the_hash_of_another_is_not_taken_for_it(monkeypatch):
    monkeypatch.setattr("veilspark.llm.tokens.span_hash", lambda p, s, e: np.zeros(len(s), np.uint64))
    enc = Encoder(A)
    texts = ["one two three", "three two one", "four"]
    for _ in range(2):
        ids, at = enc.encode(*text_bytes(pa.array(texts)))
        assert [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:])] == [enc.tokenizer.encode(t).ids for t in texts]


def test_long_texts_are_cut_where_units_end():
    data = np.frombuffer(("word, " * 50 + "x" * 400 + " end").encode(), np.uint8)
    got = list(parts(data, 64))
    assert got[0][0] == 0 and got[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert {s for s, _ in got} <= set(unit_starts(data, np.array([0, len(data)])).tolist())


# -- op13


def brute_files(rows):
    tok, at, out = Tokenizer.from_file(A), 0, []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_equal_brute_force(small):
    df, rows = small
    got = sorted(map(tuple, tokenfile.round_trip(df.repartition(5), A).collect()))
    assert got == brute_files(sorted(rows))


def test_token_files_odd_rows(spark, odd, empty):
    df, rows = odd
    df = df.unionByName(spark.createDataFrame([(None, "no id", None, None, None, 9, "x", 1)], df.schema))
    got = tokenfile.round_trip(df, A).orderBy("start").collect()
    assert got[0].doc_id is None and [r.doc_id for r in got[1:]] == sorted(x[0] for x in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    want = Counter((i, n, c) for i, _, n, c in brute_files([(None, "no id")] + [x[:2] for x in rows]))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert tokenfile.round_trip(empty, A).count() == 0


@pytest.mark.parametrize("encoding", tokenfile.ENCODINGS)
def test_token_files_layout_and_selective_reads(spark, small, tmp_path, encoding):
    df, rows = small
    folder = f"{tmp_path}/{encoding}"
    tokenfile.write_tokens(df, folder, A, encoding=encoding, row_group_bytes=64 << 10, page_bytes=4 << 10)
    files = [pq.ParquetFile(f) for f in tmp_path.glob(f"{encoding}/*.parquet")]
    groups = [f.metadata.row_group(g) for f in files for g in range(f.metadata.num_row_groups)]
    assert len(groups) > len(files)
    columns = {c.path_in_schema: c for c in (groups[0].column(i) for i in range(groups[0].num_columns))}
    ids = columns["ids.list.element"]
    assert ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta") and ids.has_dictionary_page == (encoding == "dictionary")
    assert all(c.has_offset_index for c in columns.values()) and columns["doc_id"].has_column_index
    with pytest.raises(ValueError):
        tokenfile.write_tokens(df, folder, A, encoding="plain")
    want = brute_files(sorted(rows))
    index = tokenfile.document_index(spark, folder)
    assert sorted(map(tuple, index.collect())) == [x[:3] for x in want]
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]
    few = tokenfile.read_documents(spark, folder, want[3][0], want[5][0])
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual" in few._jdf.queryExecution().toString() and few.count() == 3
    whole = [i for r in few.orderBy("doc_id").collect() for i in r.ids]
    begin = want[3][1] + 7
    cut = tokenfile.read_window(spark, folder, begin, len(whole) - 9).orderBy("at").collect()
    assert [i for r in cut for i in r.ids] == whole[7:-2] and cut[0]["at"] == begin


# -- op11


def brute_lloyd(rows, k=8, rounds=10):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [math.floor(Fraction(float(v)) * 1024) for v in x]))
    h = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: h(r[0]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in kept:
            by[near(v)[1]].append(v)
        centroids = [[sum(c) // len(by[n]) for c in zip(*by[n])] if by[n] else c for n, c in enumerate(centroids)]
    got = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in got:
        inertia[n] += d
    top = (1 << 63) - 1
    return Counter((i, n, min(d, top), min(inertia[n], top), min(sum(inertia.values()), top), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in got)


@pytest.mark.parametrize("large", [0.0, 1e30])
def test_lloyd_equals_brute_force(spark, large):
    r = random.Random(1)
    rows = [(i, [r.gauss(i % 5, 0.3) for _ in range(64)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 63 + [None]), (204, [float("nan")] * 64), (205, [float("inf")] + [0.0] * 63)]
    rows += [(7, rows[7][1])] * 3 + [(None, [0.5] * 64), (8, [-3.0] * 64), (300, [large] + [-0.25] * 63)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("distance", F.lit(1))
    single = [(i, x if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in rows]
    assert Counter(map(tuple, lloyd.lloyd(df.repartition(7)).collect())) == brute_lloyd(single)


def test_lloyd_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.0] * 64), (2, [0.0] * 64), (3, [1.0] * 64)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in lloyd.lloyd(df).collect()}
    assert len(got) == 3 and got[1].cluster == got[2].cluster != got[3].cluster and got[3].inertia == 0
    assert lloyd.lloyd(df.limit(0)).count() == 0 and lloyd.whole(1.7e308, 1024) == int(1.7e308) * 1024


# -- op12


def brute_align(rows):
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    letters, names = alignment.byte_letters(), {v: k for k, v in ta.get_vocab().items()}
    show_a = lambda i: bytes(letters[c] for c in names[i])
    show_b = lambda i: bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for i, t in rows:
        a, b = (ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t)) if t else ([], [])
        if not t or not b"".join(map(show_a, a)) == b"".join(map(show_b, b)) == (" " + t).encode():
            found.append((i, [], [], [], []))
            continue
        ends = [np.cumsum([0, *(len(show(x)) for x in ids)]) for show, ids in ((show_a, a), (show_b, b))]
        if len(a) < 60:
            links = [(b[y], a[x]) for x in range(len(a)) for y in range(len(b)) if ends[1][y] < ends[0][x + 1] and ends[0][x] < ends[1][y + 1]]
        else:  # by places where any token ends
            cuts = np.union1d(*ends)[1:]
            links = [(b[y], a[x]) for x, y in zip(*(np.searchsorted(e, cuts) - 1 for e in ends))]
        both = np.intersect1d(*ends)
        at_a, at_b = (np.searchsorted(e, both).tolist() for e in ends)
        groups = [",".join(map(str, a[p:q])) + "|" + ",".join(map(str, b[u:v])) for p, q, u, v in zip(at_a, at_a[1:], at_b, at_b[1:])]
        counts.update(links)
        found.append((i, a, b, groups, links))
    best = Counter()
    for (b, _), n in counts.items():
        best[b] = max(best[b], n)
    return Counter((i, len(a), len(b), len(g), len(ln), sum(counts[p] == best[p[0]] for p in ln), sum(counts[p] for p in ln), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, ln in found)


def test_alignment_equals_brute_force(small):
    df, rows = small
    odd_texts = [(-1, "▁ sign"), (-2, "<|endoftext|> x"), (-3, " "), (-4, "  two  blanks  "), (-5, "<0x41>\x00\t\n"), (-6, "é 日本語😀"), (-7, None), (-7, ""), (-8, "same"), (-8, "same")]
    df = df.select("doc_id", "text").unionByName(df.sparkSession.createDataFrame(odd_texts, "doc_id long, text string")).repartition(6)
    want = brute_align(rows + odd_texts)
    for size in (alignment.GROUP_BYTES, 2000):  # the second splits every bucket
        assert Counter(map(tuple, alignment.align(df, A, B, size).collect())) == want


def test_alignment_long_and_odd_rows(odd, empty, monkeypatch):
    df, rows = odd
    long = max((x[1] or "" for x in rows), key=len) * 6
    df = df.withColumn("text", F.when(F.col("doc_id") == 4, F.repeat("text", 6)).otherwise(F.col("text")))
    assert len(long) > alignment.BLOCK_BYTES
    assert Counter(map(tuple, alignment.align(df, A, B).collect())) == brute_align([(x[0], long if x[0] == 4 else x[1]) for x in rows])
    assert alignment.align(empty, A, B).count() == 0


# -- what earlier operators rest on


def test_texts_made_to_collide_are_no_copies(spark):
    rows = [(k, t) for n in (1024, 4096) for k, t in zip((n, n + 1), thue_morse(n))]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in got)


def test_a_listed_text_is_verified_once(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words))] * 3000 + [(2, near)] + [(10 + i, f"text {i} alone {i * i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_classes(df).collect()}
    assert (1, 1, 3000) in got and (2, 1, 3000) in got
    kept = jaccard.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == [1, *range(10, 60)]
    wanted = df.groupBy("doc_id").agg(F.count("*").alias("n"))
    assert one_a_key(df, wanted, ["doc_id"], df.count()).count() == 52


def test_rows_without_ids_reach_the_weights(spark):
    rows = spark.range(8000).selectExpr("cast(null as long) as doc_id", "concat('text ', lpad(id, 6, '0')) as text", "if(id % 4 = 0, 'src0', 'other') as source")
    out = mixing.poisson_mix(rows, {"src0": 0.1})
    n = Counter(r.source for r in out.select("source").collect())
    assert abs(n["src0"] / sum(n.values()) - 0.1) < 0.02
    assert out.select("shuffle_key").distinct().count() > 7000
