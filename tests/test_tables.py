import io
import zipfile

import pytest

from veilspark.operators import documents, related, rules
from veilspark.plans import samples
from veilspark.sources import tables

SCHEMA = "package_id int, finding_id string, decision string"


def test_packages_are_replaced_one_at_a_time(spark, tmp_path):
    root = str(tmp_path)
    assert tables.read(spark, root, "findings", SCHEMA).count() == 0
    tables.write(spark.createDataFrame([(1, "a", "open"), (2, "b", "keep")], SCHEMA), root, "findings", SCHEMA)
    tables.write(spark.createDataFrame([(2, "c", "redact")], SCHEMA), root, "findings", SCHEMA)
    assert sorted(map(tuple, tables.read(spark, root, "findings", SCHEMA).collect())) == [(1, "a", "open"), (2, "c", "redact")]
    later = tables.read(spark, root, "findings", SCHEMA + ", interrupted boolean", {"interrupted": False})
    assert {r.interrupted for r in later.collect()} == {False}
    tables.delete_package(spark, root, "findings", 1)
    assert [r.finding_id for r in tables.read(spark, root, "findings", SCHEMA).collect()] == ["c"]


def test_tables_refuse_what_they_do_not_know(spark):
    df = spark.createDataFrame([(1, "a", "maybe")], SCHEMA)
    with pytest.raises(Exception, match="no such value"):
        tables.checked(df, SCHEMA).collect()
    with pytest.raises(ValueError, match="unknown"):
        tables.checked(df.withColumn("key", df.decision), SCHEMA)
    with pytest.raises(ValueError, match="missing"):
        tables.checked(df.drop("decision"), SCHEMA)
    with pytest.raises(ValueError, match="safe"):
        tables.folder("/x", "../y")


def test_zip_and_list(spark):
    df = spark.createDataFrame([("b.txt", bytearray(b"2")), ("a.txt", bytearray(b"1"))], "unique_name string, content binary")
    z = zipfile.ZipFile(io.BytesIO(tables.zip_copies(df)))
    assert z.namelist() == ["a.txt", "b.txt"] and z.read("b.txt") == b"2"
    p = spark.createDataFrame([(1, "2026-01-01T00:00:00.000Z"), (2, "2026-03-01T00:00:00.000Z")], "package_id int, created_at string")
    assert [r.package_id for r in tables.list_packages(p).collect()] == [2, 1]


def test_related_findings_join_a_group(spark):
    span = lambda s, e: ("text-span", s, e, 0, "q", None, None, None, None, None, None, None)
    kind = f"array<{rules.EVIDENCE}>"
    found = spark.createDataFrame([(1, "protected-term", 0, [span(0, 4)]), (1, "protected-term", 1, [span(9, 12)]), (2, "protected-term", 2, [span(0, 4)])], f"file_id long, category string, ordinal long, evidence {kind}")
    old = spark.createDataFrame([(1, "protected-term", 5, [span(0, 4)], "a", None, "keep"), (2, "protected-term", 6, [span(0, 4)], "b", "rel-old", "redact"), (2, "secret", 7, [span(0, 4)], "c", None, "open")], f"file_id long, category string, ordinal long, evidence {kind}, finding_id string, group_id string, decision string")
    got = {r.finding_id: (r.group_id, r.decision) for r in related.join_groups(found, old, "Acme").collect()}
    assert got == {"a": ("rel-old", "keep"), "b": ("rel-old", "redact"), "c": (None, "open"), "rel-1-protected-term-1": ("rel-old", "open")}
    none = {r.finding_id: r.group_id for r in related.join_groups(found.limit(0), old, "Acme").collect()}
    assert none == {"a": None, "b": "rel-old", "c": None}
    files = spark.createDataFrame([(1, "text", "processed", "t"), (2, "image", "pending", None), (3, "document", "processed", "d"), (4, "text", "failed", "x")], "file_id long, kind string, status string, text string")
    ocr = spark.createDataFrame([(2, "seen"), (3, "no")], "file_id long, text string")
    assert sorted(map(tuple, related.sources(files, ocr).collect())) == [(1, "t"), (2, "seen")]


def test_embedded_images(spark):
    df = spark.createDataFrame([(1, bytearray(samples.docx("x")))], "file_id long, content binary")
    assert [(r.file_id, r.image_id, r.mime) for r in documents.embedded_images(df).collect()] == [(1, "word/media/image1.png", "image/png")]
