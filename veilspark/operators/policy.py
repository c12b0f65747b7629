"""Recipient policy: profile buckets, allow rules, suggested actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The three preset profiles and what each does with a category.
PRESETS = {
    "profile-external-contractor": {"allowed": (), "needs-decision": ("personal-contact", "internal-infra", "unreleased-work"), "remove": ("secret", "other-client", "internal-pricing", "protected-term", "metadata", "hidden-data")},
    "profile-client": {"allowed": ("internal-infra",), "needs-decision": ("personal-contact", "unreleased-work", "internal-pricing"), "remove": ("secret", "other-client", "protected-term", "metadata", "hidden-data")},
    "profile-public-portfolio": {"allowed": (), "needs-decision": ("other",), "remove": ("secret", "personal-contact", "personal-id", "other-client", "protected-term", "internal-pricing", "internal-infra", "unreleased-work", "metadata", "hidden-data", "prompt-injection")},
}


def preset_buckets(spark: SparkSession) -> DataFrame:
    """(profile_id, category, bucket)."""
    return spark.createDataFrame([(p, c, b) for p, buckets in PRESETS.items() for b, cs in buckets.items() for c in cs], "profile_id string, category string, bucket string")


def has_quote(evidence: Column, text: Column) -> Column:
    """Some evidence quotes exactly ``text``, in any case."""
    return F.exists(evidence, lambda e: F.coalesce(F.lower(e["quote"]) == F.lower(text), F.lit(False)))


def apply_profile(candidates: DataFrame, buckets: DataFrame, allow_rules: DataFrame) -> DataFrame:
    """Adds suggested_action and allowed_by_recipient.

    ``candidates`` have file_id, ordinal, category, evidence, profile_id and recipient_id;
    ``allow_rules`` (recipient_id, category, match_text).  A matching allow rule wins over
    removal; a secret is never kept by a profile alone.
    """
    rules = allow_rules.groupBy("recipient_id", "category").agg(F.collect_set("match_text").alias("__texts"))
    df = candidates.join(buckets, ["profile_id", "category"], "left").join(rules, ["recipient_id", "category"], "left")
    texts = F.coalesce("__texts", F.array().cast("array<string>"))
    allowed = F.exists(texts, lambda t: has_quote(F.col("evidence"), t))
    action = F.when(allowed, "keep").when(F.col("bucket") == "remove", "redact").when((F.col("bucket") == "allowed") & (F.col("category") != "secret"), "keep").otherwise("needs-decision")
    return df.withColumn("suggested_action", action).withColumn("allowed_by_recipient", allowed).drop("bucket", "__texts")


def hidden_override(candidates: DataFrame) -> DataFrame:
    """Undecided hidden items of documents are redacted (needs file_kind, evidence, suggested_action)."""
    hidden = F.exists("evidence", lambda e: F.coalesce(e["anchor"].startswith("hidden:"), F.lit(False)))
    return candidates.withColumn("suggested_action", F.when((F.col("file_kind") == "document") & hidden & (F.col("suggested_action") == "needs-decision"), "redact").otherwise(F.col("suggested_action")))
