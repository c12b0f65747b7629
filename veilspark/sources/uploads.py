"""Uploaded files: ingest limits, kinds by extension and content, decoding, fingerprints."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.operators.export import stored_extension

MOST_BYTES = 26_214_400
MOST_FILES = 50

#: Text types, file signatures, wording of rejections.
TEXT_MIMES = {"txt": "text/plain", "md": "text/markdown", "json": "application/json", "csv": "text/csv", "env": "text/plain", "log": "text/plain", "yaml": "application/yaml", "yml": "application/yaml"}
PNG, JPEG, PDF, ZIP, CFB = "89504E470D0A1A0A", "FFD8FF", "255044462D", "504B0304", "D0CF11E0A1B11AE1"
OCTETS = "application/octet-stream"
NOT_PNG = "The file name says PNG, but the content is not PNG."
NOT_JPEG = "The file name says JPEG, but the content is not JPEG."
NOT_PDF = "The file name says PDF, but the content is not PDF."
ENCRYPTED_PDF = "Encrypted PDF"
NOT_SUPPORTED = "This file type is not supported."
MACROS = "Macro-enabled documents are not supported."
MACRO_EXTENSIONS = ("docm", "xlsm", "pptm")
OOXML = {
    "docx": ("word/document.xml", "The file name says DOCX, but the content is not a Word document.", "Encrypted document", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    "xlsx": ("xl/workbook.xml", "The file name says XLSX, but the content is not an Excel workbook.", "Encrypted workbook", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    "pptx": ("ppt/presentation.xml", "The file name says PPTX, but the content is not a PowerPoint presentation.", "Encrypted presentation", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
}
TOO_LARGE = ("too-large", "The file is larger than 25 MB.")
TOO_MANY = ("limit-reached", "A package can have 50 files.")
KIND = "struct<kind:string,mime:string,reason:string>"

EXAMPLES = ("txt", "png", "jpg", "pdf", "jpeg", "docm", "exe", "yml", "")
EXAMPLE_HEADS = ("", PNG, JPEG, PDF, "89504E47", "FFD8FFE0", "25504446")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content, size) of the files under a path, through Spark's reader; larger ones are pruned before their bytes are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MOST_BYTES)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("length").alias("size"))


def oversized_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, code, reason) of the files under a path that ``read_files`` leaves out; their bytes are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > MOST_BYTES)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.lit(TOO_LARGE[0]).alias("code"), F.lit(TOO_LARGE[1]).alias("reason"))


def rejected(files: DataFrame) -> DataFrame:
    """(package_id, ordinal, name, code, reason) of the files that ``ingest`` leaves out: too large, or beyond the package's limit."""
    size = F.octet_length("content")
    kept = F.when(size <= MOST_BYTES, 1)
    n = F.count(kept).over(Window.partitionBy("package_id").orderBy("ordinal"))
    which = F.when(size > MOST_BYTES, F.struct(*map(F.lit, TOO_LARGE))).when(n > MOST_FILES, F.struct(*map(F.lit, TOO_MANY)))
    return files.select("package_id", "ordinal", "name", which.alias("__w")).where("__w is not null").select("package_id", "ordinal", "name", F.col("__w.col1").alias("code"), F.col("__w.col2").alias("reason"))


def ingest(files: DataFrame) -> DataFrame:
    """Files (package_id, ordinal, name, content) within the limits of size and number, with extension, sha256 and size."""
    small = files.withColumn("size", F.octet_length("content").cast("long")).where(F.col("size") <= MOST_BYTES)
    n = F.row_number().over(Window.partitionBy("package_id").orderBy("ordinal"))
    kept = small.withColumn("__n", n).where(F.col("__n") <= MOST_FILES).drop("__n")
    return kept.withColumn("extension", stored_extension(F.col("name"))).withColumn("sha256", F.sha2("content", 256))


def _starts(content: Column, signature: str) -> Column:
    return F.hex(F.substring(content, 1, len(signature) // 2)) == signature


def plain_kind(extension: Column, content: Column) -> Column:
    """Kind, mime and rejection by extension and first bytes; packages of office documents need ``document_kind``."""
    is_text = extension.isin(*TEXT_MIMES)
    mimes = F.create_map(*[F.lit(x) for kv in TEXT_MIMES.items() for x in kv])
    made = lambda kind, mime, reason=None: F.struct(F.lit(kind).alias("kind"), F.lit(mime).alias("mime"), F.lit(reason).cast("string").alias("reason"))
    reject = lambda why: made("unsupported", OCTETS, why)
    encrypted = F.hex(content).rlike("^(?:..)*?" + b"/Encrypt".hex().upper())
    return (
        F.when(is_text, F.struct(F.lit("text").alias("kind"), mimes[extension].alias("mime"), F.lit(None).cast("string").alias("reason")))
        .when(extension == "png", F.when(_starts(content, PNG), made("image", "image/png")).otherwise(reject(NOT_PNG)))
        .when(extension.isin("jpg", "jpeg"), F.when(_starts(content, JPEG), made("image", "image/jpeg")).otherwise(reject(NOT_JPEG)))
        .when((extension == "pdf") & ~_starts(content, PDF), reject(NOT_PDF))
        .when((extension == "pdf") & encrypted, reject(ENCRYPTED_PDF))
        .when(extension == "pdf", made("document", "application/pdf"))
        .when(extension.isin(*MACRO_EXTENSIONS), reject(MACROS))
        .otherwise(reject(NOT_SUPPORTED))
    )


def ooxml_kind(extension: str, content: bytes) -> tuple[str, str, str | None]:
    main, mismatch, encrypted, mime = OOXML[extension]
    if content.startswith(bytes.fromhex(CFB)):
        return "unsupported", OCTETS, encrypted if "EncryptionInfo".encode("utf-16-le") in content else mismatch
    if not content.startswith(bytes.fromhex(ZIP)):
        return "unsupported", OCTETS, mismatch
    try:
        names = zipfile.ZipFile(io.BytesIO(content)).namelist()
    except (zipfile.BadZipFile, ValueError, OSError):
        return "unsupported", OCTETS, mismatch
    if main not in names:
        return "unsupported", OCTETS, mismatch
    if any(n.endswith("vbaProject.bin") for n in names):
        return "unsupported", OCTETS, MACROS
    return "document", mime, None


def _document_kind(extension: pd.Series, content: pd.Series) -> pd.DataFrame:
    """Kind of office packages, by their parts."""
    return pd.DataFrame([ooxml_kind(e, bytes(c)) if e in OOXML else (None, None, None) for e, c in zip(extension, content)], columns=["kind", "mime", "reason"])


def detect_kind(files: DataFrame) -> DataFrame:
    """``files`` (extension, content) with kind, mime and reason; only office packages go through Python."""
    office = F.col("extension").isin(*OOXML)
    a = files.where(~office).withColumn("__k", plain_kind(F.col("extension"), F.col("content")))
    b = files.where(office).withColumn("__k", F.pandas_udf(_document_kind, KIND)("extension", "content"))
    return a.unionByName(b).select(*files.columns, F.col("__k.kind").alias("kind"), F.col("__k.mime").alias("mime"), F.col("__k.reason").alias("reason"))


def decode(content: Column) -> Column:
    """UTF-8 text, or null where the bytes are not valid (such a file fails)."""
    return F.try_validate_utf8(content.cast("string"))


def decode_lenient(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def _sql() -> str:
    ext = f"([{', '.join(repr(e) for e in EXAMPLES)}])[page_id % {len(EXAMPLES)} + 1]"
    starts = {PNG: "page_id % 7 = 1", JPEG: "page_id % 7 IN (2, 5)", PDF: "page_id % 7 = 3"}
    return f"""WITH a AS (SELECT page_id, {ext} AS e FROM pages)
SELECT page_id, CASE WHEN e IN ('txt', 'yml') THEN 'text' WHEN e = 'png' AND {starts[PNG]} OR e IN ('jpg', 'jpeg') AND {starts[JPEG]} THEN 'image' WHEN e = 'pdf' AND {starts[PDF]} AND page_id % 5 <> 0 THEN 'document' ELSE 'unsupported' END AS kind,
CASE WHEN e = 'txt' THEN 'text/plain' WHEN e = 'yml' THEN 'application/yaml' WHEN e = 'png' AND {starts[PNG]} THEN 'image/png' WHEN e IN ('jpg', 'jpeg') AND {starts[JPEG]} THEN 'image/jpeg' WHEN e = 'pdf' AND {starts[PDF]} AND page_id % 5 <> 0 THEN 'application/pdf' ELSE '{OCTETS}' END AS mime,
CASE WHEN e = 'png' AND NOT {starts[PNG]} THEN '{NOT_PNG}' WHEN e IN ('jpg', 'jpeg') AND NOT ({starts[JPEG]}) THEN '{NOT_JPEG}' WHEN e = 'pdf' AND NOT {starts[PDF]} THEN '{NOT_PDF}' WHEN e = 'pdf' AND page_id % 5 = 0 THEN '{ENCRYPTED_PDF}' WHEN e = 'docm' THEN '{MACROS}' WHEN e IN ('exe', '') THEN '{NOT_SUPPORTED}' END AS reason FROM a"""


KIND_SQL = _sql()
