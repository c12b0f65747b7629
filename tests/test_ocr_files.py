"""OCR words that stand in their files' rows: texts, confidence, words of hits, and the sieve that terms meet files by."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilspark.operators import anchors, ocr, terms

WORD = "file_id long, n long, text string, x double, y double, w double, h double, confidence double"


def laid_rows(spark):
    rng = random.Random(5)
    rows = [(f, n, rng.choice(["a", "Ünï", "the", " ", "an e"]), None if rng.random() < 0.05 else float(rng.randrange(9)), float(rng.randrange(60)), 5.0 + rng.randrange(9), 4.0 + rng.randrange(5), rng.choice([None, 20.0 + 45.0 * (f % 3) + 40 * rng.random()])) for f in range(9) for n in range(rng.choice([1, 2, 40]))]
    words = spark.createDataFrame(rows, WORD)
    files = words.groupBy("file_id").agg(F.collect_list(F.struct(*words.columns[1:])).alias("words"))
    return files.unionByName(spark.createDataFrame([(20, None), (21, [])], f"file_id long, words {dict(files.dtypes)['words']}")).localCheckpoint()


def test_texts_and_confidence_equal_those_of_word_rows(spark):
    files = laid_rows(spark)
    words = ocr.words_of(ocr.lay_out(files))
    got = {r.file_id: r.text for r in ocr.file_texts(files).collect()}
    assert {i: t for i, t in got.items() if t} == {r.file_id: r.text for r in ocr.ocr_text(words).collect()} and got[20] == got[21] == ""
    joined = ocr.lay_out(files, text=True).select("text", ocr.file_text(F.col("words"), lines=False).alias("want")).collect()
    assert all(r.text == r.want for r in joined) and len(joined) == files.count()
    low = sorted(map(tuple, ocr.file_low_confidence(files).collect()))
    assert low == sorted(map(tuple, ocr.low_confidence(words).collect())) and {x for _, x in low} == {True, False}


def test_only_wanted_fields_are_handed_over(spark):
    files = laid_rows(spark)
    some = ocr.lay_out(files, fields=("seq", "text"))
    assert some.schema["words"].dataType.elementType.names == ["text", "seq"]
    assert sorted(map(tuple, ocr.words_of(some).collect())) == sorted(map(tuple, ocr.words_of(ocr.lay_out(files)).select("file_id", "text", "seq").collect()))


def test_words_of_a_hit_come_back_alone(spark):
    laid = ocr.lay_out(laid_rows(spark), text=True).withColumn("hits", F.array(*[F.struct(F.lit(i).cast("long").alias("hit"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for i, (a, b) in enumerate([(0, 3), (2, 2), (5, 900), (9000, 9001)])]))
    met = ocr.touched(laid)
    assert met.columns == ["file_id", "hits"]
    words = {r.file_id: r.words for r in laid.collect()}
    for r in met.collect():
        for h in r.hits:
            assert h.words == [w for w in words[r.file_id] if w.start < h.end and w.end > h.start]


def test_queries_of_texts_and_confidence_shuffle_no_words(spark):
    for name in ("ocr_low_confidence", "ocr_text", "quote_regions"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan, name


def test_places_of_words():
    words = "a b a a b c a".split()
    asked = [["a"], ["a", "b"], ["a", "a", "b"], ["c"], ["d"], ["b", "d"], ["a", "a", "a"]]
    assert sorted(terms.place_words(words, asked)) == sorted((i, k) for i, t in enumerate(asked) for k in range(len(words)) if words[k : k + len(t)] == t)


def test_the_sieve_stays_fine_for_many_entries(spark):
    keys = spark.range(300_000).select(F.xxhash64("id").alias("anchor"))
    sieve = anchors._sieve(keys).first().sieve
    assert sum((b & (1 << 64) - 1).bit_count() for b in sieve) < 0.05 * 64 * len(sieve)
    files = spark.range(3).select(F.col("id").alias("file_id"), F.array(F.xxhash64("id"), F.xxhash64(F.col("id") + 10**9)).alias("anchors"))
    assert sorted(r.file_id for r in anchors.meet(files, keys).collect()) == [0, 1, 2]
