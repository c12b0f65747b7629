from collections import Counter

import numpy as np

import corpus_pipeline as cp
from veilspark.llm import language, mixing

from .test_jaccard import brute as classes
from .test_suffixes import brute as repeats


def test_stages_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = list(cp.COLUMNS)

    one = cp.language_stage(spark, docs, "").toPandas()
    assert list(one.columns) == names
    texts = {r.doc_id: r for r in docs.collect()}
    assert set(one.doc_id) == {d for d, r in texts.items() if r.text and any(c.isalpha() for c in r.text)}
    assert (one.lang == [texts[d].lang for d in one.doc_id]).mean() > 0.97

    df = spark.createDataFrame(one)
    two = cp.near_duplicate_stage(spark, df, "").toPandas()
    low = {d: c for d, c, _ in classes(list(zip(one.doc_id, one.text)))}
    assert list(two.columns) == names and sorted(two.doc_id) == sorted({d for d, c in low.items() if d == c})

    df = spark.createDataFrame(two)
    three = cp.repeats_stage(spark, df, "").toPandas()
    want = repeats(list(zip(two.doc_id, two.text)))
    assert list(three.columns) == names
    before = dict(zip(two.doc_id, two.text))
    after = dict(zip(three.doc_id, three.text))
    for d, (_, _, n_spans) in want.items():
        if n_spans == 0:
            assert after[d] == before[d]
        else:
            assert d not in after or len(after[d]) < len(before[d]) and "�" not in after[d]
    assert (three.n_chars == three.text.str.len()).mean() > 0.99

    df = spark.createDataFrame(three)
    four = cp.mixing_stage(spark, df, "").toPandas()
    assert list(four.columns) == names and set(four.doc_id) <= set(three.doc_id)
    assert Counter(four.doc_id) == Counter({r.doc_id: r.n_copies for r in mixing.poisson_mix(df).select("doc_id", "n_copies").distinct().collect()})

    five = cp.packing_stage(spark, spark.createDataFrame(four), "").toPandas()
    assert five.length.sum() == sum(len(i) // 4 for i in five.ids) and five.groupby("sequence_id").length.sum().max() <= 4096
    assert len(five[five.start == 0]) == len(four)


def test_run_on_the_smallest_table(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [n for n, _ in cp.STAGES] == ["language_id", "ngram_jaccard", "suffix_dedup", "poisson_mix", "packing"]


def test_stages_take_odd_rows(spark, odd, empty):
    df, _ = odd
    for source in (df, empty):
        docs = source
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, "")
        docs.count()


def test_cut_characters_leave_no_mark(spark):
    a = "é" * 60 + "x" * 10 + "zß" * 40
    df = spark.createDataFrame([(1, a), (2, "q" + a[3:] + "ö" * 20)], "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "length(text) n_chars")
    got = {r.doc_id: r.text for r in cp.repeats_stage(spark, df, "").collect()}
    assert "�" not in got[2] and got[2].startswith("q")


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_id(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 150 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark, odd, empty):
    df, rows = odd
    got = language.language_id(df).collect()
    by = {(r.doc_id): r for r in got}
    assert len(got) == len(rows) and [by[i].lang_pred for i in (1, 2, 6)] == ["und"] * 3 and by[1].score == 0
    assert by[3].lang_pred in {"en", "fr", "de"}
    assert language.language_id(empty).count() == 0
    nothing = language.language_id(df.withColumn("lang", df.lang.substr(9, 1).cast("string")).selectExpr("doc_id", "text", "nullif(lang, '') lang"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    emit, trans = rng.uniform(0.1, 1, (5, 3)).astype(np.float32), rng.uniform(0.1, 1, (3, 3))
    start = (np.full(3, 1 / 3) @ trans) * emit[0]
    want, moved, z = np.zeros((5, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=5):
        w = start[path[0]] * np.prod([trans[path[t - 1], path[t]] * emit[t, path[t]] for t in range(1, 5)])
        z += w
        for t, y in enumerate(path):
            want[t, y] += w
            if t:
                moved[path[t - 1], y] += w
    post, got = language.posteriors(emit, trans, np.array([0, 5]))
    assert np.allclose(post, want / z, atol=1e-5) and np.allclose(got, moved / z, atol=1e-4)
    long = rng.uniform(0.1, 1, (300, 3)).astype(np.float32)
    whole, _ = language.posteriors(long, trans, np.array([0, 40, 300]))
    a = np.full(3, 1 / 3)
    ahead = []
    for t in range(40, 300):
        a = (a @ trans) * long[t]
        a /= a.sum()
        ahead.append(a)
    b = np.ones(3)
    for t in range(299, 39, -1):
        p = ahead[t - 40] * b
        assert np.allclose(whole[t], p / p.sum(), atol=1e-4)
        b = trans @ (long[t] * b)
        b /= b.sum()
    assert np.allclose(whole[:40], language.posteriors(long[:40], trans, np.array([0, 40]))[0], atol=1e-5)


def test_label_runs_find_the_switch(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    de = docs.where("lang = 'de' and n_chars between 600 and 2000").first().text.split()[:40]
    fr = docs.where("lang = 'fr' and n_chars between 600 and 2000").first().text.split()[:40]
    df = spark.createDataFrame([(1, " ".join(w.strip(".,") for w in de + fr))], "doc_id long, text string")
    runs = [r for r in language.label_runs(df, model).orderBy("start_word").collect() if r.n_words > 5]
    assert [r.lang for r in runs] == ["de", "fr"] and abs(runs[1].start_word - 40) < 5
