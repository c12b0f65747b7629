import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from veilspark.llm import licenses, matroska, mixing, packing, sharding, urls
from veilspark.llm.text import text_bytes
from veilspark.llm.tokens import Encoder

from pyspark.sql import functions as F

VOCABULARY = path("word_bpe_49k.json")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# -- op2


def test_mixing_reaches_its_weights(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "repeat('x', 100) as text", "case when id % 3 = 0 then 'src0' when id % 100 = 1 then 'src1' else concat('src', 3 + id % 7) end as source")
    out = mixing.poisson_mix(rows)
    n = Counter(r.source for r in out.select("source").collect())
    total = sum(n.values())
    assert abs(total / 6000 - 0.85) < 0.06  # src2 is missing, so its weight is not filled
    assert abs(n["src0"] / 6000 - 0.10) < 0.02 and abs(n["src1"] / 6000 - 0.15) < 0.02
    again = mixing.poisson_mix(rows)
    assert out.count() == again.count() and out.exceptAll(again).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_inverts_the_poisson_distribution(spark):
    rows = spark.range(20000).selectExpr("id as doc_id", "'xx' as text", "if(id < 100, 'src1', 'other') as source")
    got = mixing.poisson_mix(rows, {"src1": 0.6})
    per = Counter(r.doc_id for r in got.where("source = 'src1'").select("doc_id").collect())
    x = np.array([per.get(i, 0) for i in range(100)])
    assert abs(x.mean() - 120) < 6 and 50 < x.var() < 220  # a mean above MAX_MEAN, drawn in pieces
    rest = Counter(r.n for r in got.where("source = 'other'").groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    lam = 0.4 * 20000 / 19900
    for k in (1, 2, 3):
        p = np.exp(-lam) * lam**k / [1, 1, 2, 6][k]
        assert abs(rest[k] / 19900 - p) < 0.012


def test_mixing_odd_rows(odd, empty):
    df, rows = odd
    out = mixing.poisson_mix(df, {"src0": 0.5}).collect()
    assert all(r.copy < r.n_copies for r in out)
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add(r.n_copies)
    assert all(len(v) == 1 for v in by.values())
    assert mixing.poisson_mix(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.poisson_mix(empty, {"a": 0.7, "b": 0.7})


# -- op3


def brute_base(text):
    words = WORD.findall(lower(text))
    found = []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    got = licenses.license_scan(df).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == {k: brute_base(v) for k, v in texts.items()}
    assert sum(r.n_base > 0 for r in got) > 5
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_texts_are_found_with_edits(spark):
    bsd = "x y z. Redistribution and use, in source and binary forms, with or without CHANGES modification are permitted provided that the following conditions are met: z"
    df = spark.createDataFrame([(1, bsd), (2, "redistribution and use of many forms"), (3, "Apache-License; CC-BY")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert got[1].labels == "bsd" and 0.6 <= got[1].score < 1 and got[1].first_word is None
    assert got[2].labels == "" and got[2].score == 0
    assert got[3].base_labels == "apache,cc-by" and (got[3].first_word, got[3].last_word) == (0, 2)
    span = [r for r in licenses.spans(df).collect() if r.template is not None and r.doc_id == 1]
    assert len(span) == 1 and span[0].start_word == 3


def test_license_odd_rows(odd, empty):
    df, rows = odd
    got = licenses.license_scan(df).collect()
    key = lambda r: (r[0], r[1], r[2])
    assert sorted(map(key, got)) == sorted((i, *brute_base(t or "")[:2]) for i, t, *_ in rows)
    assert licenses.license_scan(empty).count() == 0


# -- op5


def test_encoder_equals_the_tokenizer(small):
    _, rows = small
    texts = [t for _, t in rows] + ["", "it's we're I'll you'd 'tis ''s x'S'm'", "a<|endoftext|>b", "İ ſ", "日本語 text", "½ ² ª º µ", "tab\tnew\x0b\x1c\x85 z", "e\u0301 x", "ÀÉÎõü", "  ", "123 45a6", "'", "'r 're 'rex", "!'s ?'ll", "😀", "\x00a"]
    data, at = text_bytes(pa.array(texts))
    ids, where = Encoder(VOCABULARY).encode(data, at)
    want = Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)
    assert [ids[where[i] : where[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in want]


def check_packing(pieces, want, size):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    got = Counter()
    for d, ps in by_doc.items():
        ps.sort(key=lambda p: p.start)
        whole = np.frombuffer(b"".join(p.ids for p in ps), "<u4").tolist()
        got[d, tuple(whole[:50]), len(whole)] += 1
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    return by_doc, by_seq, got


def test_packing_round_trip(small):
    df, rows = small
    pieces = packing.pack_documents(df, VOCABULARY, group_bytes=1 << 17).collect()
    tok = Tokenizer.from_file(VOCABULARY)
    want = {d: [*tok.encode(t, add_special_tokens=False).ids, 2] for d, t in rows}
    by_doc, by_seq, _ = check_packing(pieces, want, 4096)
    for d, ids in want.items():
        ps = by_doc[d]
        assert [p.start for p in ps] == np.cumsum([0] + [p.length for p in ps[:-1]]).tolist()
        assert np.frombuffer(b"".join(p.ids for p in ps), "<u4").tolist() == ids and ps[0].doc_tokens == len(ids)
    total = sum(map(len, want.values()))
    groups = len({s >> 32 for s in by_seq})
    assert len(by_seq) <= total // 4096 + groups


def test_packing_balances_cost():
    lengths = np.random.default_rng(3).integers(20, 900, 4000)
    pieces = packing.pack(lengths)
    cost = defaultdict(float)
    for _, _, n, s, _ in pieces:
        cost[s] += packing.cost(n)
    c = np.array(list(cost.values()))
    assert len(c) == -(-lengths.sum() // 4096)
    assert c.std() / c.mean() < 0.03
    assert sum(p[2] for p in pieces) == lengths.sum()


def test_packing_odd_rows(odd, empty):
    df, rows = odd
    pieces = packing.pack_documents(df, VOCABULARY).collect()
    n = Counter()
    for p in pieces:
        n[p.doc_id] += p.length
    tok = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert n == want
    assert packing.pack_documents(empty, VOCABULARY).count() == 0


# -- op7


def test_matroska_round_trip_and_equal_texts(odd, empty):
    df, rows = odd
    got = matroska.media_digest(df).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        b2 = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
        want.append((i, len(b), len(b2), hashlib.sha256(b2).hexdigest(), zlib.crc32(b2[-32:])))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id == 7}) == 1
    assert matroska.media_digest(empty).count() == 0


def test_matroska_lacings_and_unknown_sizes():
    frames = [b"a" * 3, b"b" * 300, b"c" * 7, b"d" * 40]
    flags, body = matroska.lace(frames)
    sizes, at = matroska.frame_sizes(body, 0, len(body), flags >> 1 & 3)
    assert flags == 6 and sizes == [3, 300, 7, 40] and body[at:] == b"".join(frames)
    xiph = bytes([3, 3, 255, 45, 7]) + b"".join(frames)
    assert matroska.frame_sizes(xiph, 0, len(xiph), 1) == ([3, 300, 7, 40], 5)
    e, u = matroska.element, matroska.uint
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x82\x00\x05\x00" + b"zz"))
    cluster = matroska._id(matroska.CLUSTER) + b"\xff" + u(matroska.CLUSTER_TIME, 100) + group  # unknown size
    x = matroska.parse(e(matroska.EBML, b"") + e(matroska.SEGMENT, cluster))
    assert [(p.track, p.timestamp, p.length, p.keyframe) for p in x.packets] == [(2, 105, 2, True)]  # the group refers to no other block
    with pytest.raises(ValueError):
        matroska.parse(b"RIFF")


def test_matroska_packet_table(spark):
    payload = bytes(range(256)) * 800
    df = spark.createDataFrame([(1, bytearray(matroska.write(payload, 500))), (2, None)], "file_id long, content binary")
    got = matroska.packet_table(df, "file_id", "content").orderBy("packet").collect()
    stored = matroska.write(payload, 500)
    assert b"".join(stored[r.start : r.start + r.length] for r in got) == payload
    assert {r.cued for r in got} == {True} and {r.codec for r in got} == {"A_PCM/INT/LIT"} and len(got) == -(-len(payload) // 500)


# -- op8


def check_shards(got, rows):
    assert len(got) == len(rows)
    at = defaultdict(list)
    group = defaultdict(set)
    text = {}
    for i, t, *_ in rows:
        text.setdefault(i, t)
    for r in got:
        at[r.shard].append(r.slot)
        group[text[r.doc_id]].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in at.values())
    assert all(len(v) == 1 for v in group.values())


def test_sharding_small(small):
    df, rows = small
    got = sharding.shard_documents(df, 8).collect()
    check_shards(got, rows)
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert sum(size.values()) == sum(len(t.encode()) + 1 for _, t in rows)
    assert max(size.values()) / min(size.values()) < 1.05


def test_sharding_odd_rows(odd, empty):
    df, rows = odd
    check_shards(sharding.shard_documents(df, 8).collect(), rows)
    assert sharding.shard_documents(empty, 8).count() == 0
    assert {r.shard for r in sharding.shard_documents(df, capacity=10**7).collect()} == {0}


def test_best_fit_equals_a_plain_search():
    rng = np.random.default_rng(2)
    for _ in range(30):
        items = rng.integers(1, 60, 80).tolist()
        bins, want = [], Counter()
        for s in sorted(items, reverse=True):
            fit = min((b for b in range(len(bins)) if bins[b] >= s), key=lambda b: (bins[b], b), default=None)
            if fit is None:
                bins.append(100)
                fit = len(bins) - 1
            bins[fit] -= s
            want[s, fit] += 1
        got = Counter()
        for s, b, n in sharding.best_fit_decreasing(Counter(items).items(), 100):
            got[s, b] += n
        assert got == want
    even = sharding.even_shards([(10, 16)], 8)
    assert [n for _, _, n in even] == [2] * 8


def test_packed_sizes_are_few_and_never_too_small(spark):
    x = [1, 100, 65_535, 65_536, 65_537, 70_000, 10**6 + 1, 2**40 + 1, 2**40]
    got = [r.p for r in spark.createDataFrame([(v,) for v in x], "s long").select("s", sharding.packed_size(F.col("s")).alias("p")).orderBy("s").collect()]
    assert got[:4] == sorted(x)[:4] and got[-2] == 2**40
    assert all(v <= p <= v * (1 + 1 / 4096) for v, p in zip(sorted(x), got))


# -- op10


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"[^/?#]*", rest)
        host, path = lower(m[0]), re.match(r"[^?#]*", rest[m.end() :])[0]
    best = None
    for verdict, rule in urls.HOST_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    hits = sorted({r.name for r in urls.PATTERN_RULES if url is not None and re.search(r.pattern, url.lower())}) if best is None else []
    return host, path, best and best[1], best[0] if best else "block" if hits else "allow", ",".join(hits)


def test_urls_equal_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: brute_url(r.url) for r in pages.select("page_id", "url").collect()}
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(pages).collect()}
    assert got == want and len({v[3] for v in got.values()}) == 2


def test_urls_odd_rows(spark):
    texts = [None, "", "no scheme", "http://", "HTTP://A.ORG/x", "http://EXAMPLE.org/en/1?x", "x://y?q=/z#f", "http://a.com/de/\nb", "http://b.net/login/a?u=1&next=2", "http://c.net/xxx", "http://c.net/xxxx", "http://a.net/casino/bonus", "http://spam-farm.net/", "http://x.org", "a://b://c.org/"]
    df = spark.createDataFrame([(i, u, "h", "z") for i, u in enumerate(texts)], "page_id long, url string, host string, verdict string")
    assert [tuple(r)[1:] for r in urls.judge(df).orderBy("page_id").collect()] == [brute_url(u) for u in texts]
    assert urls.judge(df.limit(0)).count() == 0


def test_urls_index_uses_the_rarest_token(spark):
    df = spark.createDataFrame([(1, "http://spam.net/farm"), (2, "http://spam.net/"), (3, "http://page.net/ref?page=1")], "page_id long, url string")
    rules = urls.expand(urls.PATTERN_RULES)
    index = urls.rarest_index(df, rules)
    named = {t: [rules[i].name for i in ids] for t, ids in index.items()}
    assert "spam-farm" in named["farm"] and "paged-referral" in named["page"] and set(named["xxx"] + named["porn"]) == {"adult"}


def test_urls_cost_does_not_follow_the_rules(spark):
    many = urls.PATTERN_RULES + tuple(urls.PatternRule(f"r{i}", f"/word{i}x/", (f"word{i}x",)) for i in range(2000))
    df = spark.createDataFrame([(1, "http://a.net/word7x/"), (2, "http://a.net/word7x/word9x/"), (3, "http://a.net/word7"), (3, "http://a.net/word7")], "page_id long, url string")
    out = urls.judge(df, pattern_rules=many)
    assert sorted((r.page_id, r.verdict, r.patterns) for r in out.collect()) == [(1, "block", "r7"), (2, "block", "r7,r9"), (3, "allow", ""), (3, "allow", "")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("rlike") == urls.judge(df)._jdf.queryExecution().optimizedPlan().toString().lower().count("rlike") == 1


def test_matroska_any_prefix_gives_whole_packets():
    whole = matroska.write(bytes(range(256)) * 40, 500)
    good = [(p.start, p.length) for p in matroska.parse(whole).packets]
    e = matroska.element
    group = e(matroska.CLUSTER, e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x81\x00\x00\x06\x02\x83\x85") + b"zz"))
    for n in range(0, len(whole), 7):
        try:
            got = [(p.start, p.length) for p in matroska.parse(whole[:n]).packets]
        except ValueError as x:
            assert "no EBML header" in str(x) and n < 40
        else:
            assert got == good[: len(got)]
    for n in range(len(group)):
        matroska.parse(e(matroska.EBML, b"") + e(matroska.SEGMENT, group[:n]))


def test_matroska_laced_times_and_keyframes():
    x = matroska.parse(matroska.write(bytes(5000), 500))
    step = 500 * 1_000_000_000 // matroska.RATE
    assert [p.timestamp_ns for p in x.packets] == [i * step for i in range(8)] + [x.packets[8].timestamp_ns, x.packets[8].timestamp_ns + step]
    e, u = matroska.element, matroska.uint
    block = e(matroska.BLOCK, b"\x82\x00\x05\x00" + b"zz")
    body = u(matroska.CLUSTER_TIME, 1) + e(matroska.BLOCK_GROUP, block) + e(matroska.BLOCK_GROUP, block + u(matroska.REFERENCE_BLOCK, 1))
    assert [p.keyframe for p in matroska.parse(e(matroska.EBML, b"") + e(matroska.SEGMENT, e(matroska.CLUSTER, body))).packets] == [True, False]


def test_matroska_broken_files_do_not_end_the_job(spark):
    df = spark.createDataFrame([(1, bytearray(b"RIFF")), (2, None), (3, bytearray(matroska.write(b"x" * 600)))], "file_id long, content binary")
    got = matroska.packet_table(df, "file_id", "content").collect()
    assert sorted((r.file_id, r.packet, r.error) for r in got) == [(1, -1, "no EBML header"), (3, 0, None), (3, 1, None)]


def test_matroska_clusters_of_unknown_size():
    e, u = matroska.element, matroska.uint
    block = e(matroska.SIMPLE_BLOCK, b"\x81\x00\x05\x80zz")
    open_ = lambda kind, body: matroska._id(kind) + b"\xff" + body
    group = open_(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x82\x00\x07\x00yy"))
    cue = e(matroska.CUES, e(matroska.CUE_POINT, u(matroska.CUE_TIME, 100) + e(matroska.CUE_POSITIONS, u(matroska.CUE_TRACK, 1) + u(matroska.CUE_CLUSTER, 0))))
    body = open_(matroska.CLUSTER, u(matroska.CLUSTER_TIME, 100) + group + block) + open_(matroska.CLUSTER, u(matroska.CLUSTER_TIME, 200) + block) + cue
    for segment in (e(matroska.SEGMENT, body), open_(matroska.SEGMENT, body)):
        x = matroska.parse(e(matroska.EBML, b"") + segment)
        assert [(p.track, p.timestamp, p.length) for p in x.packets] == [(2, 107, 2), (1, 105, 2), (1, 205, 2)]
        assert len(x.clusters) == 2 and x.cues == [(100, 1, 0)]


def test_sharding_keeps_a_small_capacity(spark):
    df = spark.createDataFrame([(i, f"{i:04d}" * 20) for i in range(200)] + [(999, "z" * 700)], "doc_id long, text string")
    got = sharding.shard_documents(df, capacity=500).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert len(got) == 201 and sorted(size.values())[-2] <= 500 and max(size.values()) == 701
    many = spark.range(20_000).selectExpr("id as doc_id", "rpad(cast(id as string), 960, 'x') as text")
    sizes = [r.b for r in sharding.shard_documents(many, capacity=10_000).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(sizes) <= 10_000 and len(sizes) == 2000
