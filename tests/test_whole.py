"""Queries that keep every hit of a text, however many there are."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilspark.functions import spans
from veilspark.operators import documents, package, rules, terms
from veilspark.plans import inputs, package_flow

MANY = [
    " ".join(f"u{i}@x.org" for i in range(70)) + " +49 30 1234567," * 60 + " 4111 1111 1111 1111," * 60,
    "heron " * 2100 + "cc by license " * 70 + "​ " * 30 + "you are now. " * 40,
    "\n".join(f"API_KEY{i}=aB3dE5fG7hI9jK1lM3nO5p{i}" for i in range(80)) + " pwd=abcdefg" * 60,
    " ".join(f"AKIA{i:016d}" for i in range(90)),
    "one heron",
    None,
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    rows = [(i + 19, t) for i, t in enumerate(MANY)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def equal_to_sql(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tables}/documents.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = [tuple(r) for r in entry.queries()[name](spark, tables).select(*want.columns).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
    return got


def test_apply_profile_has_every_term_and_range(spark, tables):
    got = equal_to_sql(spark, tables, "apply_profile")
    terms_found = [r for r in got if r[2] == "protected-term" and r[0] == 20]
    assert len(terms_found) == 2100 + 70 + 70 == len({r[1] for r in terms_found})
    assert {1001, 1999, 10000, 10001, 19000, 19100} <= {r[1] for r in terms_found}


def test_layer_scores_counts_every_hit(spark, tables):
    got = {r[0]: r for r in equal_to_sql(spark, tables, "layer_scores")}
    assert sum(r[1] + r[2] for r in got.values()) == 2100 + 70 + 70 + 1 + 4


def test_redact_env_leaves_no_later_value(spark, tables):
    equal_to_sql(spark, tables, "redact_env")


def test_export_package_redacts_every_hit(spark, tables):
    got = {r.file_id: r.digest for r in package_flow.export_package(spark, tables).collect()}
    text = MANY[3] + "\n" + inputs.SNIPPETS[22]
    for i in range(90):
        text = text.replace(f"AKIA{i:016d}", "[REDACTED]")
    assert "AKIA" not in text and got[22] == hashlib.md5(text.replace("heron", "[REDACTED]").encode()).hexdigest()


@pytest.mark.parametrize("fmt", ["docx", "xlsx", "pptx"])
def test_documents_are_redacted_at_every_hit(spark, tables, fmt, monkeypatch):
    monkeypatch.setattr(documents, "redact_documents", lambda plan: plan.select("file_id", F.encode(F.size("spans").cast("string"), "utf-8").alias("redacted"), F.array().alias("notes"), F.array().alias("residue"), F.lit(None).alias("error")))
    seen = []
    of = documents.redact_documents
    monkeypatch.setattr(documents, "redact_documents", lambda plan: seen.append(plan) or of(plan))
    entry.queries()[f"{fmt}_redact"](spark, tables)
    count = {r.file_id: len(r.spans) for r in seen[0].select("file_id", "spans").collect()}
    assert count[19] >= 70 + 60  # no less than the addresses and the cards


def test_whole_scans(spark):
    text = "a@b.co " * 300
    df = spark.createDataFrame([(1, text), (2, "x")], "file_id long, text string")
    assert [r.start for r in rules.hit_rows(df, (rules.BY_ID["email"],), whole=True).collect()] == [7 * i for i in range(300)]
    assert len(terms.find_terms(df, spark.createDataFrame([(0, "co")], "number long, term string"), whole=True).collect()) == 300
    assert len(terms.place_words(["a"] * 200, [["a"]], 200)) == 200
    found = rules.candidates(spark.createDataFrame([(1, "x​ " * 300 + "you are now. " * 25)], "file_id long, text string"), whole=True).collect()
    assert sorted(len(r.evidence) for r in found) == [25, 300]
    assert [e.start for e in next(r.evidence for r in found if len(r.evidence) == 25)] == [900 + 13 * i for i in range(25)]


def test_long_lists_of_spans(spark):
    lots = [(3 * i, 3 * i + 2 + i % 2) for i in range(1000)] + [(5000, 5004), (5003, 5009), (5001, 5002)]
    r = spark.createDataFrame([(lots,)], "s array<struct<start:bigint,end:bigint>>").select(spans.islands(F.col("s")).alias("i"), spans.islands(F.col("s"), touch=True).alias("t")).first()
    assert [(x.start, x.end) for x in r.i] == lots[:1000] + [(5000, 5009)]
    assert len(r.t) == 502


def test_scores_take_the_first_label_left():
    span = lambda q, kind="text-span", **box: {"type": kind, "quote": q, **{k: box.get(k) for k in "xywh"}}
    found = [{"ordinal": i, "method": "rule", "evidence": e} for i, e in enumerate([[span("b"), span("a")], [span("a")], [span("a")], [span(None, "image-region", x=0.0, y=0.0, w=2.0, h=2.0), span("b")]])]
    box = {"x": 0.0, "y": 0.0, "w": 2.0, "h": 2.0}
    labels = [{"ordinal": i, "quote": q, "box": b} for i, (q, b) in enumerate([("a", None), ("b", None), ("a", None), (None, box)])]
    assert next(r for r in package._score((1, "c"), found, labels) if r[0] == "rule") == ("rule", 3, 1, 1)
