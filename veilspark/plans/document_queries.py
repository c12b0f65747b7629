"""Queries over office documents, images and PDF files made of the documents table; no SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import documents, export, images, rules
from veilspark.operators.batches import frames, small_batches
from veilspark.plans import samples
from veilspark.plans.inputs import FILES_SQL, files
from veilspark.sources import ooxml, uploads


def _made(fmt: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.make(files(spark, sf_dir), fmt)


def _scan(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return images.scan_images(_made(fmt, spark, sf_dir))

    return run


def image_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.image_findings(images.scan_images(_made("png", spark, sf_dir).unionByName(_made("jpeg", spark, sf_dir))))


def png_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _made("png", spark, sf_dir).withColumn("boxes", F.array(F.struct(F.lit(4.5).alias("x"), F.lit(3.0).alias("y"), F.lit(2.0).alias("w"), F.lit(1.0).alias("h"))))
    return images.redact_images(f).select("file_id", F.sha2("redacted", 256).alias("sha256"), "error")


def _extract(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = documents.extract_documents(_made(fmt, spark, sf_dir))
        return m.select("file_id", F.length("text").cast("long").alias("length"), F.md5("text").alias("digest"), F.size("items").alias("items"), F.size("segments").alias("segments"), F.size("hidden").alias("hidden"), "signed", "error")

    return run


def _redact(fmt: str):
    """All spans of the scan and all hidden items removed, with what of them the copy still holds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = documents.extract_documents(_made(fmt, spark, sf_dir), keep=("format", "content"), fields=("file_id", "text", "hidden", "error"))
        spans = F.transform(F.flatten(F.array(*[rules.scan_rule("text", r, whole=True) for r in (rules.BY_ID["email"], rules.BY_ID["credit-card"], rules.BY_ID["phone"])])), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))
        plan = m.where("error is null").select("file_id", "format", "content", spans.alias("spans"), F.expr("transform(hidden, h -> h.id)").alias("remove"), F.array(F.lit(samples.SECRET)).alias("needles"))
        out = documents.redact_documents(plan)
        return out.select("file_id", F.octet_length("redacted").alias("bytes"), F.size("notes").alias("notes"), F.size("residue").alias("residue"), "error")

    return run


def hidden_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = documents.extract_documents(_made("docx", spark, sf_dir), fields=("file_id", "hidden"))
    return documents.hidden_candidates(m).select("file_id", "rule_id", "category", "anchor")


def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.document_notes(documents.extract_documents(_made("docx", spark, sf_dir), fields=("file_id", "not_analysed", "signed")))


def ooxml_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.part_table(_made("xlsx", spark, sf_dir)).select("file_id", "name", "content_type", "size", "error")


def ooxml_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.reachable_parts(ooxml.relationship_table(_made("docx", spark, sf_dir)))


def office_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made("docx", spark, sf_dir).withColumn("extension", F.element_at(F.array(F.lit("docx"), F.lit("xlsx"), F.lit("txt")), (F.col("file_id") % 3 + 1).cast("int")))
    return uploads.detect_kind(made.select("file_id", "extension", "content")).select("file_id", "kind", "mime", "reason")


def _residue(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def check(batches):
            for b in batches:
                each = ((len(c), [(i, documents.residue(fmt, bytes(c), [samples.SECRET, "absent words", "ab"]))]) for i, c in zip(b["file_id"], b["content"]))
                yield from frames(each, ["file_id", "found"])

        return small_batches(_made(fmt, spark, sf_dir)).select("file_id", "content").mapInPandas(check, "file_id long, found array<string>").select("file_id", F.array_join("found", "|").alias("found"))

    return run


def xml_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    coded = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "'", "&APOS;"), "th", F.when(F.col("file_id") % 3 == 0, "&lt;").when(F.col("file_id") % 3 == 1, "&#60;").otherwise("&#x3C;"))
    coded = F.regexp_replace(F.regexp_replace(coded, "ü", "&#252;"), "é", "&#xe9;")
    return f.select("file_id", F.md5(export.decode_entities(coded)).alias("digest"))


_RELS = ("word/document.xml", "docProps/core.xml", "word/comments.xml", "word/media/image1.png", "word/media/image2.emf")
QUERIES = {
    "png_scan": _scan("png"),
    "jpeg_scan": _scan("jpeg"),
    **{f.__name__: f for f in (image_findings, png_redact, hidden_candidates, document_notes, ooxml_parts, ooxml_reachable, office_kind, xml_entities)},
    **{f"{fmt}_extract": _extract(fmt) for fmt in ("docx", "xlsx", "pptx")},
    **{f"{fmt}_redact": _redact(fmt) for fmt in ("docx", "xlsx", "pptx")},
    "ooxml_residue": _residue("docx"),
    "pdf_residue": _residue("pdf"),
}
ORACLES = {
    "document_notes": "SELECT doc_id AS file_id, 'not-analysed' AS kind, 'Image: word/media/image2.emf: Image format not analysed' AS note FROM documents",
    "xml_entities": f"WITH {FILES_SQL} SELECT file_id, md5(replace(text, 'th', '<')) AS digest FROM files",
    "ooxml_reachable": "SELECT doc_id AS file_id, unnest([" + ", ".join(f"'{n}'" for n in _RELS) + "]) AS part FROM documents",
    "ooxml_residue": f"SELECT doc_id AS file_id, '{samples.SECRET}' AS found FROM documents",
    "pdf_residue": f"SELECT doc_id AS file_id, '{samples.SECRET}' AS found FROM documents",
    "office_kind": f"""SELECT doc_id AS file_id, CASE doc_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'unsupported' ELSE 'text' END AS kind, CASE doc_id % 3 WHEN 0 THEN '{uploads.OOXML["docx"][3]}' WHEN 1 THEN '{uploads.OCTETS}' ELSE 'text/plain' END AS mime, CASE WHEN doc_id % 3 = 1 THEN '{uploads.OOXML["xlsx"][1]}' END AS reason FROM documents""",
}
