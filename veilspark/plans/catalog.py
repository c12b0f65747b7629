"""Every query of the review engine, by name, and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.operators import rules
from veilspark.plans import content_queries, document_queries, inputs, package_flow, residue_queries, review_queries, rule_queries

_MODULES = (rule_queries, review_queries, content_queries, document_queries, package_flow, residue_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship scan: every validated hit of every rule in all documents."""
    return rules.hit_rows(inputs.files(spark, sf_dir))
