"""What showed only at size: large keys, ties, batches, and words of many files."""

import dataclasses
import random
import re
import time

import duckdb
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilspark.functions import spans
from veilspark.operators import anchors, batches, carry, documents, ocr, residue, rules, terms
from veilspark.plans import samples


def made(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def by_sql(name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_byte_labels_of_large_keys(spark, tmp_path):
    keys = [7, 2_097_152, 36_000_001, 35_999_999, 4_000_000_000, 2**62]
    d = made(spark, tmp_path, "orders", [(k,) for k in keys], "o_orderkey long")
    got = {r.o_orderkey: r.label for r in entry.queries()["byte_labels"](spark, d).collect()}

    def label(k):
        v = k**3 % 7_000_000_000 + k % 2000
        v = v % 1024 if k % 3 == 0 else v
        size, unit = next((s, u) for s, u in ((1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB"), (1, "B")) if v >= s or s == 1)
        return f"{v} B" if size == 1 else f"{v / size:.1f} {unit}"

    assert got == {k: label(k) for k in keys}


def test_env_values_that_are_empty_or_found_twice(spark, tmp_path):
    secret = "API_SECRET=aB3dE5fG7hI9jK1lM3nO5pQ7"  # of two rules, grown to one value
    rows = [(i, secret if i % 2 else "a\nTOKEN=\nlongervalue") for i in range(200)]
    d = made(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = sorted(map(tuple, entry.queries()["redact_env"](spark, d).collect()))
    assert got == by_sql("redact_env", d, "documents")


def test_files_go_to_python_and_back_in_small_batches(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64MB")
        documents.extract_documents(spark.createDataFrame([], "file_id long, format string, content binary"))
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= batches.BATCH_BYTES
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", was)
    third = batches.FRAME_BYTES // 3 + 1
    sizes = [len(f) for f in batches.frames(((third, [(i, k) for k in range(2)]) for i in range(7)), ["i", "k"])]
    assert sizes == [6, 6, 2] and not list(batches.frames([], ["i"]))


def test_models_keep_what_is_asked(spark):
    made = samples.make(spark.createDataFrame([(1, "a b")], "file_id long, text string"), "xlsx").unionByName(spark.createDataFrame([(2, "xlsx", bytearray(b"no"))], "file_id long, format string, content binary"))
    got = documents.extract_documents(made, keep=("content",), fields=("file_id", "text", "error"))
    assert got.columns == ["file_id", "text", "error", "content"]
    rows = {r.file_id: r for r in got.collect()}
    assert rows[1].text == documents.extract("xlsx", bytes(rows[1].content)).text and rows[1].error is None
    assert rows[2].text is None and rows[2].error and bytes(rows[2].content) == b"no"


def test_spans_meet_only_the_segments_near_them():
    m, n = documents.Model(), 40_000
    sheet = documents.section("s")
    for i in range(n):
        m.add(sheet, "", None, None, [("word", "p", i, None)])
        m.hide(f"h{i}", "kind", "note", None)
    start = time.process_time()
    cut = documents.edits(m, [(i * 5, i * 5 + 2) for i in range(n)] + [(3, 6)])
    assert len(cut) == n and cut["p", 0, None] == [(0, 2, "[REDACTED]"), (3, 4, "[REDACTED]")] and cut["p", 1, None] == [(0, 2, "")]
    assert len(m.text) == 5 * n - 1 and len(m.hidden) == n and time.process_time() - start < 20


WORD = "file_id long, n long, text string, x double, y double, w double, h double, confidence double"


def test_words_of_a_file_are_laid_out_without_a_shuffle(spark):
    rng = random.Random(7)
    rows = [(f, n, rng.choice(["a", "Ünï", "the", " ", "an e"]), None if rng.random() < 0.05 else float(rng.randrange(9)), float(rng.randrange(40)), 5.0 + rng.randrange(9), 4.0 + rng.randrange(5), 150.0 * rng.random()) for f in range(5) for n in range(60)]
    words = spark.createDataFrame(rows, WORD)
    files = words.groupBy("file_id").agg(F.collect_list(F.struct(*words.columns[1:])).alias("words")).localCheckpoint()
    laid = ocr.lay_out(files)
    assert "Exchange" not in laid._jdf.queryExecution().executedPlan().toString()
    kept = ocr.assign_lines(words.where("trim(text) <> ''")).withColumn("seq", F.row_number().over(Window.partitionBy("file_id").orderBy("line", "x", "n")) - 1)
    columns = ["file_id", "n", "line", "seq", "start", "end"]
    want = sorted(map(tuple, ocr.word_offsets(kept).select(*columns).collect()))
    assert sorted(map(tuple, ocr.words_of(laid).select(*columns).collect())) == want
    assert sorted(map(tuple, ocr.word_offsets(ocr.ocr_result(words)).select(*columns).collect())) == want
    assert {r.file_id: r.text for r in laid.select("file_id", ocr.file_text(F.col("words")).alias("text")).collect()} == {r.file_id: r.text for r in ocr.ocr_text(kept).collect()}
    assert {r.c for r in ocr.words_of(laid).selectExpr("confidence between 0 and 100 as c").collect()} == {True}

    text = ocr.file_text(F.col("words"), lines=False)
    hits = F.transform(spans.hits(text, "an? [a-z]"), lambda h, n: h.withField("hit", n.cast("long")).withField("start", h["start"] + F.when(n % 4 == 3, 9000).otherwise(0)).withField("end", h["end"] + F.when(n % 4 == 3, 9000).otherwise(0)))
    both = laid.withColumn("hits", hits)
    rows = both.select("file_id", F.explode("hits").alias("h")).select("file_id", "h.*")
    box = ["file_id", "hit", "x", "y", "w", "h"]
    key = lambda r: tuple(repr(v) for v in r)
    for one, other, more in ((ocr.file_evidence(both), ocr.hit_evidence(rows, ocr.words_of(laid)), "type"), (ocr.file_regions(both), ocr.quote_regions(rows, ocr.words_of(laid)), "quote")):
        got = sorted(map(tuple, one.select(*box, more).collect()), key=key)
        assert got == sorted(map(tuple, other.select(*box, more).collect()), key=key) and got

    layer = F.transform(F.filter("words", lambda w: w["n"] % 3 == 0), lambda w: F.struct((w["x"] + 4).alias("x"), *[w[k].alias(k) for k in "ywh"]))
    new = ocr.words_of(ocr.new_file_words(laid.withColumn("layer", layer))).select("file_id", "n").collect()
    boxes = laid.select("file_id", F.explode(layer).alias("b")).select("file_id", "b.*")
    assert sorted(map(tuple, new)) == sorted(map(tuple, ocr.new_words(ocr.words_of(laid), boxes).select("file_id", "n").collect()))


def test_terms_of_ocr_words_stay_in_their_files_rows(spark):
    words = [(1, [(n, t, float(n % 4 * 50), float(n // 4 * 20), 40.0, 10.0, 90.0) for n, t in enumerate("Big Blue, x big blue blue blue (one) ONE".split())]), (2, [(0, "one", 1.0, 2.0, 3.0, 4.0, 90.0)])]
    files = spark.createDataFrame(words, "file_id long, words array<struct<n:long,text:string,x:double,y:double,w:double,h:double,confidence:double>>").localCheckpoint()
    known = spark.createDataFrame([(0, "big blue"), (1, "blue blue"), (2, "one"), (3, "big blue blue"), (4, "absent words"), (5, " ")], "number long, term string")
    laid = ocr.lay_out(files)
    asked = terms.asked_regions(laid, known).localCheckpoint()
    placed = terms.regions_of(ocr.lay_out(files.join(asked, "file_id").localCheckpoint(), ("asked",)))
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.file_id, r.number, r["first"], r["last"], r.x, r.w, r.quote) for r in placed.collect())
    assert got == [(1, 0, 0, 1, 0.0, 90.0, "Big Blue,"), (1, 0, 3, 4, 0.0, 190.0, "big blue"), (1, 1, 4, 5, 0.0, 90.0, "blue blue"), (1, 1, 5, 6, 50.0, 90.0, "blue blue"), (1, 2, 7, 7, 150.0, 40.0, "(one)"), (1, 2, 8, 8, 0.0, 40.0, "ONE"), (1, 3, 3, 5, 0.0, 190.0, "big blue blue"), (2, 2, 0, 0, 1.0, 3.0, "one")]
    assert sorted(map(tuple, terms.term_regions(ocr.words_of(laid), known).collect())) == sorted(map(tuple, placed.collect()))


def test_a_long_text_is_read_once_for_all_its_terms():
    rng = random.Random(3)
    kinds = [f"w{i}" for i in range(60)]
    text = " ".join(rng.choice(kinds) for _ in range(40_000))
    asked = [f"{a} {b}" for a in kinds for b in kinds]
    start = time.process_time()
    hits = terms.place_terms(text, asked)
    assert time.process_time() - start < 10
    some = [h for h in hits if h[0] in (0, 61, 3599)]
    assert some == [(i, *m.span()) for i in (0, 61, 3599) for m in list(re.finditer(rf"\b{asked[i]}\b", text))[:50]]


def test_terms_between_borders(spark):
    text = "a a a a\nx\u00e4y \u00e4 \u212aelvin's Stra\u1e9ee a++b ++ foo-bar xfoo-bar FOO-BAR"
    known = ["a a", "\u00e4", "kelvin's", "stra\u00dfe", "++", "foo-bar", "-bar", "no"]
    files = spark.createDataFrame([(1, text), (2, None)], "file_id long, text string")
    table = spark.createDataFrame(list(enumerate(known)), "number long, term string")
    got = sorted((r.number, r.start, r.line, r.quote) for r in terms.find_terms(files, table).collect())
    want = sorted((known.index(r.term), r.start, r.line, r.quote) for r in terms.term_hits(files, known).collect())
    assert got == want and {n for n, *_ in got} == set(range(7))


def test_only_what_entries_are_filed_under_is_dealt_out(spark):
    words = spark.createDataFrame([(i, [f"w{i}", f"w{i + 1}", "x"]) for i in range(2000)], "file_id long, words array<string>")
    entries = spark.createDataFrame([(k, [f"w{k}", f"w{k + 1}"]) for k in (5, 700)] + [(9, [])], "k long, words array<string>")
    met = anchors.meet(words.select("file_id", anchors.held(F.col("words")).alias("anchors")), entries.select("k", anchors.anchor(F.col("words")).alias("anchor")))
    got = sorted((r.k, r.file_id) for r in met.collect())
    assert got == sorted([(5, 5), (700, 700)] + [(9, i) for i in range(2000)])


def test_needles_of_two_words_are_proven_by_the_join(spark):
    views = residue.text_views(spark.createDataFrame([(1, "The  heron, stands. A-b c"), (2, "heron stands"), (3, None)], "file_id long, text string"))
    needles = ["heron, stands", "heron stands", "stands.", "HERON", "her", "a-b", "a-b c", ", stands", "c", "..."]
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = sorted((r.file_id, r.needle) for r in residue.find_needles(views, asked).collect())
    assert got == sorted([(1, n) for n in ("heron, stands", "stands.", "HERON", "a-b", "a-b c", ", stands")] + [(2, "heron stands"), (2, "HERON")])


def test_a_report_scans_its_files_once(spark):
    known = entry.queries()
    for name, scans in (("layer_scores", 1), ("review_progress", 1), ("finding_facets", 2), ("inconsistent_redaction", 3), ("open_after_verify", 2)):
        plan = known[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= scans, name


def test_gates_leave_out_only_what_holds_nothing(spark):
    rows = ["PaSSword: hunter22", "toKen = abcdef", "paſſword=abcdef", "apİ_key=abcdef", "x.DEV.example a.b.c", "4111 1111 1111 1111", "x4111 1111 1111 1111", "iban DE89 3704 0044 0532 0130 00", "110.0.0.1 10.0.0.1", "﻿​x", "Ignore Previous Instructions", "nothing", None]
    files = spark.createDataFrame(list(enumerate(rows)), "file_id long, text string")
    open_rules = tuple(dataclasses.replace(r, words=(), ahead=None, gate=None) for r in rules.RULES)
    got = sorted(map(tuple, rules.hit_rows(files).collect()))
    assert got == sorted(map(tuple, rules.hit_rows(files, open_rules).collect())) and {r[0] for r in got} >= {0, 1, 2, 3, 4, 5, 7, 8}
    assert {r.file_id for r in rules.candidates(files).where("category = 'hidden-data'").collect()} == {9}
    assert {(r.file_id, r.quote) for r in terms.term_hits(files, ["token", "Api_Key", "password"]).collect()} == {(0, "PaSSword"), (1, "toKen"), (2, "paſſword"), (3, "apİ_key")}


def test_repeated_candidates_are_matched_each(spark):
    span = ("text-span", 1, 3, 0, "q", None, None, None, None, None, None, None)
    kind = f"array<{rules.EVIDENCE}>"
    new = spark.createDataFrame([(1, "c", 0, [span]), (1, "c", 0, [span]), (1, "c", 1, []), (2, "c", 0, [span])], f"file_id long, category string, ordinal long, evidence {kind}")
    old = spark.createDataFrame([(1, "c", 4, [span], "b", "keep"), (1, "c", 3, [span], "a", "redact")], f"file_id long, category string, ordinal long, evidence {kind}, finding_id string, decision string")
    got = sorted(map(tuple, carry.verify_match(new, old).collect()), key=str)
    assert got == sorted([(1, "c", 0, "a", "redact"), (1, "c", 0, "a", "redact"), (1, "c", 1, None, "open"), (2, "c", 0, None, "open")], key=str)
