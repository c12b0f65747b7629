"""Review actions on findings, allow rules, files and recipients; all give the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISIONS = ("open", "redact", "keep", "keep-and-remember", "not-an-issue")


def decide(findings: DataFrame, finding_id: str, decision: str, whole_group: bool = False) -> DataFrame:
    """One finding decided, or every finding of its group."""
    if decision not in DECISIONS:
        raise ValueError(f"no such decision: {decision}")
    hit = F.col("finding_id") == finding_id
    if whole_group:
        group = findings.where(hit).select("group_id").first()
        if group is not None and group.group_id is not None:
            hit = hit | (F.col("group_id") == group.group_id)
    return findings.withColumn("decision", F.when(hit, decision).otherwise(F.col("decision")))


def decide_groups(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings with the decision of their group in ``decisions`` (group_id, decided), where it has one."""
    joined = findings.join(decisions, "group_id", "left")
    return joined.withColumn("decision", F.coalesce("decided", "decision")).drop("decided")


def remember_keeps(allow_rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Allow rules plus one for each finding kept to be remembered: not for secrets, not without a quote, not twice in any case.

    ``findings``: recipient_id, category, ordinal, decision, quote (its first).
    """
    new = findings.where("decision = 'keep-and-remember' and category <> 'secret' and quote is not null")
    new = new.withColumn("__k", F.lower("quote")).groupBy("recipient_id", "category", "__k").agg(F.min_by("quote", "ordinal").alias("match_text"))
    known = allow_rules.select("recipient_id", "category", F.lower("match_text").alias("__k")).distinct()
    fresh = new.join(known, ["recipient_id", "category", "__k"], "left_anti").drop("__k")
    return allow_rules.unionByName(fresh.select(*allow_rules.columns))


def exclude_files(files: DataFrame, ids: DataFrame, excluded: bool = True) -> DataFrame:
    """Files whose id is in ``ids`` (file_id) marked as excluded, or not."""
    marked = files.join(ids.select("file_id", F.lit(True).alias("__hit")).distinct(), "file_id", "left")
    return marked.withColumn("excluded", F.when(F.col("__hit"), F.lit(excluded)).otherwise(F.col("excluded"))).drop("__hit")


def keep_excluded(scanned: DataFrame, live: DataFrame) -> DataFrame:
    """Scanned files with the exclusion they have in the live package by now."""
    now = live.select("file_id", F.col("excluded").alias("__now"))
    return scanned.join(now, "file_id", "left").withColumn("excluded", F.coalesce("__now", "excluded")).drop("__now")


def upsert_recipients(recipients: DataFrame, changes: DataFrame) -> DataFrame:
    """Names and profiles changed by id, new recipients added, allow rules kept.

    Both have id, name, profile_id; ``recipients`` also allow_rules.
    """
    c = changes.select("id", F.col("name").alias("__name"), F.col("profile_id").alias("__profile"))
    both = recipients.join(c, "id", "full_outer")
    return both.select("id", F.coalesce("__name", "name").alias("name"), F.coalesce("__profile", "profile_id").alias("profile_id"), "allow_rules")


def add_region(findings: DataFrame, region: dict) -> DataFrame:
    """A finding drawn by hand: a box (x, y, w, h) on an image or page, or a span of text."""
    if region.get("type") == "image-region" and (min(region["x"], region["y"]) < 0 or min(region["w"], region["h"]) <= 0):
        raise ValueError("the box lies outside the image")
    if region.get("type") == "text-span" and not 0 <= region["start"] < region["end"]:
        raise ValueError("the span is empty")
    row = findings.sparkSession.createDataFrame([tuple(region.get(c) for c in findings.columns)], findings.schema)
    return findings.unionByName(row)


def remove_region(findings: DataFrame, finding_id: str) -> DataFrame:
    """Without one finding; only findings made by hand can go."""
    return findings.where((F.col("finding_id") != finding_id) | (F.col("method") != "manual"))


#: The package status and what may follow it (fixed values).
NEXT_STATUS = {"draft": ("scanning",), "scanning": ("scanned", "draft"), "scanned": ("scanning", "exporting"), "exporting": ("exported", "scanned"), "exported": ("scanning", "exporting")}


def advance(status: str, to: str) -> str:
    if to not in NEXT_STATUS.get(status, ()):
        raise ValueError(f"a package cannot go from {status} to {to}")
    return to


def recover(packages: DataFrame, live_jobs: DataFrame) -> DataFrame:
    """Packages that were scanning or exporting without a live job (package_id) go back and are marked interrupted."""
    j = packages.join(live_jobs.select("package_id", F.lit(True).alias("__live")).distinct(), "package_id", "left")
    lost = F.col("__live").isNull() & F.col("status").isin("scanning", "exporting")
    back = F.when(F.col("status") == "scanning", "draft").otherwise("scanned")
    return j.withColumn("interrupted", F.coalesce("interrupted", F.lit(False)) | lost).withColumn("status", F.when(lost, back).otherwise(F.col("status"))).drop("__live")
