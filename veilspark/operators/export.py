"""Reviewed copies: redaction plans, gates, needles of residue, names, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import regex, spans
from veilspark.operators.batches import each_key, gathered

PADDING = 3
LEAST_NEEDLE = 3


def redact_files(files: DataFrame, spans_by_file: DataFrame) -> DataFrame:
    """Files (file_id, name, text) with ``redacted``; ``spans_by_file`` has file_id, start, end."""
    s = spans_by_file.groupBy("file_id").agg(F.collect_list(F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))).alias("__s"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    df = files.join(s, "file_id", "left")
    return df.withColumn("redacted", spans.redact("text", spans.env_spans("name", "text", F.coalesce("__s", none)))).drop("__s")


def pad_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box grown by the padding and cut to the image, as whole pixels; null if nothing is left."""
    left, top = F.greatest(F.lit(0), F.floor(x) - PADDING), F.greatest(F.lit(0), F.floor(y) - PADDING)
    right, bottom = F.least(width, F.ceil(x + w) + PADDING), F.least(height, F.ceil(y + h) + PADDING)
    return F.when((right > left) & (bottom > top), F.struct(left.cast("bigint").alias("left"), top.cast("bigint").alias("top"), (right - left).cast("bigint").alias("width"), (bottom - top).cast("bigint").alias("height")))


def exportable(files: DataFrame) -> DataFrame:
    return files.where("not excluded and status = 'processed'")


def redactable(kind: Column, evidence: Column) -> Column:
    """Some evidence can be acted on in a file of this kind."""
    named = lambda e: F.coalesce(e["anchor"] != "", F.lit(False))
    whole = lambda e: F.coalesce(e["anchor"].startswith("image:") | e["anchor"].startswith("page:"), F.lit(False))
    hidden = lambda e: F.coalesce(e["anchor"].startswith("hidden:"), F.lit(False)) & (e["type"] == "file-structure")
    document = F.exists(evidence, lambda e: (e["type"] == "text-span") | ((e["type"] == "image-region") & named(e)) | ((e["type"] == "image-whole") & whole(e)) | hidden(e))
    target = F.when(kind == "image", "image-region").otherwise("text-span")
    return F.when(kind == "document", document).otherwise(F.exists(evidence, lambda e: e["type"].isin("file-structure") | (e["type"] == target)))


def export_errors(status: str, warnings: DataFrame, findings: DataFrame, confirmed: bool) -> list[str]:
    """Why a package cannot be exported; empty if it can.  ``findings``: decision, file_kind, evidence."""
    out = []
    if status not in ("scanned", "exported"):
        out.append("The package is not scanned.")
    if not confirmed and not warnings.isEmpty():
        out.append("Warnings are not confirmed.")
    n = findings.where((F.col("decision") == "redact") & ~redactable(F.col("file_kind"), F.col("evidence"))).count()
    if n:
        out.append(f"{n} findings cannot be redacted.")
    return out


def fold(q: Column) -> Column:
    """A quote for comparing: trimmed, white space collapsed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(q, f"[{regex.SPACE_CLASS}]+", " ")))


def needle_plan(quotes: DataFrame) -> DataFrame:
    """(file_id, needle, skipped): what must be gone from each reviewed copy.

    ``quotes``: file_id, ordinal, quote, removed (False where a finding keeps it).  A kept quote
    is no needle; equal quotes in any case are one, in the spelling that comes last; short ones
    are skipped with a note.
    """
    q = quotes.withColumn("key", fold(F.col("quote")))
    kept = q.where("not removed").select("file_id", "key").distinct()
    unique = q.where("removed").join(kept, ["file_id", "key"], "left_anti").groupBy("file_id", "key").agg(F.max_by("quote", "ordinal").alias("q"))
    needle = F.trim(F.col("q"))
    return unique.select("file_id", needle.alias("needle"), (F.length(needle) < LEAST_NEEDLE).alias("skipped"))


def contains_word(text: Column, needle: Column) -> Column:
    """``needle`` stands in ``text`` with no letter or digit beside it, on sides where it has one itself."""
    before = F.when(needle.rlike(r"^[\p{L}\p{N}]"), r"(?<![\p{L}\p{N}])").otherwise("")
    after = F.when(needle.rlike(r"[\p{L}\p{N}]$"), r"(?![\p{L}\p{N}])").otherwise("")
    safe = F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return (needle != "") & text.contains(needle) & F.call_function("regexp_like", text, F.concat(before, F.lit("\\Q"), safe, F.lit("\\E"), after))


def decode_entities(text: Column) -> Column:
    """The five named XML entities and numeric references to plain characters, in one pass; others stay."""
    pattern = "(?i)&(?:#x0*([0-9a-f]{1,6})|#0*([0-9]{1,7})|(amp|lt|gt|quot|apos));"

    def char(found: Column) -> Column:
        part = lambda i: F.regexp_extract(found, pattern, i)
        code = F.when(part(1) != "", F.conv(part(1), 16, 10)).otherwise(F.nullif(part(2), F.lit(""))).cast("long")
        plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        name = F.lower(part(3))
        named = F.when(name == "amp", "&").when(name == "lt", "<").when(name == "gt", ">").when(name == "quot", '"').when(name == "apos", "'")
        return F.when(name != "", named).when((code < 0xD800) | code.between(0xE000, 0x10FFFF), plain).otherwise(found)

    gaps = F.split(text, pattern, -1)
    chars = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), char)
    return F.array_join(F.zip_with(gaps, F.array_append(chars, F.lit("")), lambda a, b: F.concat(a, b)), "")


def stored_extension(name: Column) -> Column:
    base = F.lower(F.element_at(F.split(name, r"[\\/]"), -1))
    dot = F.length(base) - F.locate(".", F.reverse(base))  # zero-based place of the last dot
    some = base.contains(".") & (dot > 0)
    return F.when(base.startswith(".env"), "env").when(some, F.substring(F.regexp_replace(F.substr(base, dot + 2), "[^a-z0-9]", ""), 1, 10)).otherwise("")


def export_name(name: Column) -> Column:
    """A name that is safe to write: no folders, no control or reserved characters, no reserved names."""
    base = F.element_at(F.split(name, r"[\\/]"), -1)
    safe = F.substring(F.regexp_replace(F.regexp_replace(base, r'[\x00-\x1f\x7f<>:"/\\|?*]', "_"), "[. ]+$", ""), 1, 120)
    safe = F.when((safe == "") | safe.rlike(r"^\.+$"), "file").otherwise(safe)
    return F.when(safe.rlike(r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$"), F.concat(F.lit("_"), safe)).otherwise(safe)


def _unique(key: tuple, files: list[dict]) -> list[tuple]:
    used: set[str] = set()
    out = []
    for r in sorted(files, key=lambda r: r["ordinal"]):
        name = r["name"]
        stem, dot, ext = name.rpartition(".") if name.rfind(".") > 0 else (name, "", "")
        unique, n = name, 2
        while unique.lower() in used:
            unique, n = f"{stem} ({n}){dot}{ext}", n + 1
        used.add(unique.lower())
        out.append((*key, r["ordinal"], name, unique))
    return out


def unique_names(files: DataFrame) -> DataFrame:
    """``unique_name`` for each file (package_id, ordinal, name); a package has 50 files at most."""
    df = gathered(files.select("package_id", "ordinal", "name"), ["package_id"], "files")
    return each_key(df, ["package_id"], ["files"], _unique, "package_id long, ordinal long, name string, unique_name string")


def changed_originals(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files (file_id, name, content) whose fingerprint is not the stored one (file_id, sha256)."""
    return now.select("file_id", "name", F.sha2("content", 256).alias("__h")).join(before, "file_id").where(F.col("__h") != F.col("sha256")).select("file_id", "name")


def manifest(files: DataFrame) -> DataFrame:
    """What an export holds: package_id, unique_name, bytes, sha256."""
    return files.select("package_id", "unique_name", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")).withColumn("n", F.count("*").over(Window.partitionBy("package_id")))
