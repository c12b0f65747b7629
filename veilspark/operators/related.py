"""Related findings: where to search for a term, and joining what is found to groups that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators import carry
from veilspark.operators.terms import slug


def sources(files: DataFrame, ocr_texts: DataFrame) -> DataFrame:
    """(file_id, text) to search: texts of text files and OCR texts of images that were read; documents give nothing.

    ``files``: file_id, kind, status, text.  ``ocr_texts``: file_id, text.
    """
    live = files.where("status in ('processed', 'pending')")
    texts = live.where("kind = 'text'").select("file_id", "text")
    seen = live.where("kind = 'image'").select("file_id").join(ocr_texts.select("file_id", "text"), "file_id")
    return texts.unionByName(seen)


def join_groups(found: DataFrame, findings: DataFrame, term: str) -> DataFrame:
    """All findings after a search for a term.

    ``found`` (file_id, category, ordinal, evidence) are its candidates; ``findings`` also have
    finding_id, group_id, decision.  If a finding that shares evidence has a group, the first
    such group is used, else the term's own.  Findings met join it; candidates that meet none
    are added, open.
    """
    own = found.select("file_id", "category", F.explode(carry.keys("evidence")).alias("key"), F.col("ordinal").alias("new"))
    old = findings.select("file_id", "category", F.explode(carry.keys("evidence")).alias("key"), "finding_id", "group_id", F.col("ordinal").alias("old"))
    met = own.join(old, ["file_id", "category", "key"])
    group = met.where("group_id is not null").agg(F.min(F.struct("new", "old", "group_id"))["group_id"].alias("g"))
    group = group.select(F.coalesce("g", F.lit(None).cast("string")).alias("__known"))
    fallback = slug(F.lit(term.strip()))
    touched = met.select("finding_id").distinct().withColumn("__met", F.lit(True))
    one = F.broadcast(group)  # a single row
    joined = findings.join(touched, "finding_id", "left").join(one, how="left").withColumn("group_id", F.when(F.col("__met"), F.coalesce("__known", fallback)).otherwise(F.col("group_id"))).drop("__met", "__known")
    fresh = found.join(met.select("file_id", "category", F.col("new").alias("ordinal")).distinct(), ["file_id", "category", "ordinal"], "left_anti").join(one, how="left")
    named = F.concat_ws("-", F.lit("rel"), "file_id", "category", "ordinal")
    fresh = fresh.select("file_id", "category", "ordinal", "evidence", named.alias("finding_id"), F.coalesce("__known", fallback).alias("group_id"), F.lit("open").alias("decision"))
    return joined.select(*fresh.columns).unionByName(fresh)
