import random

from pyspark.sql import functions as F

from veilspark.operators import documents, residue
from veilspark.plans import package_flow as flow
from veilspark.plans import samples


def test_needles_equal_a_plain_search(spark):
    rng = random.Random(4)
    words = ["Ann", "ann", "Lee", "leeward", "C++", "x", "été", "ß", "12", "-", "..", "Ünal"]
    texts = [(i, rng.choice(["", " ", "\t"]).join(rng.choices(words, k=12)) + rng.choice(["", " "]).join(rng.choices(words, k=8))) for i in range(40)] + [(99, ""), (98, None)]
    needles = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(150)] + ["...", "ANN  lee", "ab", "", None]
    views = residue.text_views(spark.createDataFrame(texts, "file_id long, text string"))
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    wanted = {(i, n) for i, t in texts for n in needles if t and n and len(documents.fold(n)) >= 3 and documents.contains_word(documents.fold(t), documents.fold(n))}
    got = [(r.file_id, r.needle) for r in residue.find_needles(views, asked).collect()]
    assert set(got) == wanted and len(got) == len(wanted) > 50
    own = spark.createDataFrame([(i % 40, n) for i, n in enumerate(needles)], "file_id long, needle string")
    assert {(r.file_id, r.needle) for r in residue.find_needles(views, own).collect()} == {(i, n) for i, n in wanted if any(j % 40 == i and m == n for j, m in enumerate(needles))}
    none = spark.createDataFrame([], "needle string")
    assert residue.find_needles(views, none).count() == 0 and residue.find_needles(views.limit(0), asked).count() == 0


def test_document_views_hold_what_the_row_search_finds(spark):
    rows = [(i, f, bytearray(samples.MAKERS[f]("Alpha beta\nGamma Delta line"))) for i, f in enumerate(["docx", "xlsx", "pptx", "pdf"])] + [(9, "docx", bytearray(b"PK broken"))]
    copies = spark.createDataFrame(rows, "file_id long, format string, content binary")
    needles = ["gamma  delta", "Gamma", samples.SECRET, "Ann Writer", "absent"]
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = {(r.file_id, r.needle) for r in residue.find_needles(residue.document_views(copies), asked).collect()}
    assert got == {(i, n) for i, f, c in rows[:4] for n in documents.residue(f, bytes(c), needles)} and len(got) > 6


def test_what_a_document_still_holds_becomes_a_finding(spark, tmp_path):
    content = bytearray(samples.docx("write to ann@example.com\nfor Ann Writer"))
    copies = spark.createDataFrame([(1, "a.docx", "document", "docx", content, None), (2, "b.txt", "text", "txt", bytearray(b"nothing here"), None), (3, "c.docx", "document", "docx", None, "The document cannot be read.")], "file_id long, name string, kind string, format string, content binary, error string")
    copies = flow.write_copies(copies, str(tmp_path / "copies"))
    evidence = F.transform(flow._structure_evidence(F.lit(None), F.lit(None), F.lit(None), F.col("q")), lambda e: e.withField("type", F.lit("text-span")).withField("start", F.lit(900).cast("long")).withField("end", F.lit(910).cast("long")))
    rows = [(1, 0, "protected-term", "Ann Writer", "redact"), (1, 1, "protected-term", "Gone Words", "redact"), (2, 0, "secret", "nothing here", "redact")]
    findings = spark.createDataFrame(rows, "file_id long, ordinal long, category string, q string, decision string").withColumn("evidence", evidence).withColumn("finding_id", F.concat_ws("-", "file_id", "ordinal"))
    words = spark.createDataFrame([], "file_id long, n long, text string, x double, y double, w double, h double, confidence double")
    allow = spark.createDataFrame([("hidden-data", "ann writer")], "category string, match_text string")
    matched = flow.verify_all(copies, findings, words, ["Ann Writer"], [], "profile-client", allow)
    matched.write.parquet(str(tmp_path / "matched"))
    matched = spark.read.parquet(str(tmp_path / "matched"))
    new = [r for r in matched.collect() if r.ordinal >= flow.RESIDUE_AT]
    assert [(r.file_id, r.category, r.finding_id, r.decision) for r in new] == [(1, "hidden-data", None, "open")]
    assert [r.finding_id for r in matched.where("category = 'protected-term'").collect()] == ["1-0"]
    report = flow.verification(matched).first()
    assert report.status == "open-findings" and report.text == f"{report.open_findings}{flow.OPEN_FINDINGS}" and report.open_findings >= 2
    clean = flow.verification(matched.limit(0)).first()
    assert (clean.status, clean.text, clean.reported) == ("no-open-findings", flow.NO_OPEN_FINDINGS, 0)
