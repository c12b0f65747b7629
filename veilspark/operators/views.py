"""Queries behind the review screens: filters, facets, counts, search, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import spans
from veilspark.operators.rules import ZERO_WIDTH


def filter_findings(findings: DataFrame, file_id: int | None = None, category: str | None = None, method: str | None = None, state: str | None = None) -> DataFrame:
    """``state``: open or decided."""
    if file_id is not None:
        findings = findings.where(F.col("file_id") == file_id)
    if category is not None:
        findings = findings.where(F.col("category") == category)
    if method is not None:
        findings = findings.where(F.exists("detections", lambda d: d["method"] == method))
    if state is not None:
        findings = findings.where((F.col("decision") == "open") == (state == "open"))
    return findings


def facets(findings: DataFrame) -> DataFrame:
    """Distinct (facet, value): categories, and methods of any detection."""
    facet = lambda name, value: F.struct(F.lit(name).alias("facet"), value.alias("value"))
    methods = F.coalesce(F.transform("detections", lambda d: facet("method", d["method"])), F.array().cast("array<struct<facet:string,value:string>>"))
    return spans.rows_of(findings, [], F.array_append(methods, facet("category", F.col("category"))), "f").select("f.*").distinct()


def redaction_counts(findings: DataFrame) -> DataFrame:
    return findings.where("decision = 'redact'").groupBy("category").agg(F.count("*").alias("redactions"))


def progress(findings: DataFrame, *more: Column) -> DataFrame:
    """One row: how many findings there are and are decided, and ``more`` that is counted with them."""
    done = F.count(F.when(F.col("decision") != "open", 1))
    return findings.agg(F.count("*").alias("total"), done.alias("decided"), F.coalesce(F.round(F.try_divide(done * 100, F.count("*"))), F.lit(100.0)).cast("long").alias("percent"), *more)


def settled(decision: Column) -> Column:
    return ~decision.isin("open", "redact")


def search_packages(packages: DataFrame, recipients: DataFrame, profiles: DataFrame, text: str = "", state: str | None = None) -> DataFrame:
    """Packages with recipient and profile names, by words in any case and by state (open or exported)."""
    df = packages.join(recipients.select(F.col("id").alias("recipient_id"), F.col("name").alias("recipient"), "profile_id"), "recipient_id", "left").join(profiles.select(F.col("id").alias("profile_id"), F.col("name").alias("profile")), "profile_id", "left")
    if text.strip():
        df = df.where(F.lower(F.concat_ws(" ", "name", "recipient", "profile")).contains(text.strip().lower()))
    if state is not None:
        df = df.where((F.col("status") == "exported") == (state == "exported"))
    return df


def text_segments(texts: DataFrame) -> DataFrame:
    """Pieces of each text (file_id, text, spans) between all span borders."""
    return spans.rows_of(texts, ["file_id"], spans.segments("text", F.col("spans")), "s").select("file_id", "s.*")


def segment_lines(texts: DataFrame) -> DataFrame:
    """(file_id, line, piece, text, covered): segments cut at line feeds."""
    pieces = F.transform(spans.segments("text", F.col("spans")), lambda s: F.struct(s["start"].alias("start"), s["covered"].alias("covered"), spans.line_at("text", s["start"]).alias("first"), F.split(s["text"], "\n", -1).alias("parts")))
    segs = spans.rows_of(texts, ["file_id"], pieces, "s").select("file_id", "s.*")
    rows = segs.select("file_id", "first", "start", "covered", F.posexplode("parts").alias("n", "piece"))
    return rows.where("piece <> ''").select("file_id", (F.col("first") + F.col("n")).alias("line"), "start", "piece", "covered")


def visible(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{ZERO_WIDTH}]", "")) != ""


def quote_of(evidence: Column | str) -> Column:
    """The first quote with a visible character, or null."""
    fits = F.filter(evidence, lambda e: e["type"].isin("text-span", "image-region") & F.coalesce(visible(e["quote"]), F.lit(False)))
    return F.try_element_at(fits, F.lit(1))["quote"]


def where_of(e: Column) -> Column:
    return (
        F.when(e["type"] == "text-span", F.concat(F.lit("line "), (e["line"] + 1).cast("string")))
        .when(e["type"] == "image-region", "image region")
        .when(e["type"] == "image-whole", "whole image")
        .when(e["byte_offset"].isNull(), "file structure")
        .otherwise(F.concat(F.lit("byte "), e["byte_offset"].cast("string")))
    )


def format_bytes(n: Column) -> Column:
    one = lambda p, unit: F.concat(F.format_string("%.1f", n / float(1024**p)), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, one(1, "KB")).when(n < 1024**3, one(2, "MB")).otherwise(one(3, "GB"))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def sentence_case(slug: Column) -> Column:
    text = F.replace(slug, F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def column_name(n: Column) -> Column:
    """Spreadsheet column of a number from 1."""
    step = lambda acc, _: F.struct(F.when(acc["n"] > 0, F.floor((acc["n"] - 1) / 26)).otherwise(0).cast("bigint").alias("n"), F.when(acc["n"] > 0, F.concat(F.char(F.lit(65) + (acc["n"] - 1) % 26), acc["s"])).otherwise(acc["s"]).alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.struct(n.cast("bigint").alias("n"), F.lit("").alias("s")), step, lambda acc: acc["s"])


def column_number(name: Column) -> Column:
    letters = F.filter(F.split(F.upper(name), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda n, c: n * 26 + F.ascii(c) - 64)


def grid(items: DataFrame, columns: list[int]) -> DataFrame:
    """Cells (section, row, col, text) as a table: a row a grid row, a column for each of ``columns``."""
    return items.groupBy("section", "row").pivot("col", columns).agg(F.first("text"))
