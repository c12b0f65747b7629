"""Stored tables of a workspace: typed, checked on write and read, replaced a package at a time."""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE_ID = re.compile(r"[A-Za-z0-9_-]{1,80}")

#: The closed domains of the stored columns.
DOMAINS = {
    "decision": ("open", "redact", "keep", "keep-and-remember", "not-an-issue"),
    "status": ("pending", "processed", "failed", "unsupported"),
    "suggested_action": ("keep", "redact", "needs-decision"),
    "category": ("secret", "personal-contact", "personal-id", "other-client", "protected-term", "internal-pricing", "internal-infra", "unreleased-work", "metadata", "hidden-data", "prompt-injection", "other"),
}


def folder(root: str, table: str) -> str:
    if not SAFE_ID.fullmatch(table):
        raise ValueError(f"not a safe name: {table}")
    return f"{root.rstrip('/')}/{table}"


def checked(df: DataFrame, schema: T.StructType | str, defaults: dict | None = None) -> DataFrame:
    """``df`` in exactly this schema: missing columns take their default, unknown ones are refused.

    Values outside a column's closed domain fail the job when they are read.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    unknown = set(df.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    out = []
    for f in schema:
        if f.name not in df.columns and f.name not in (defaults or {}):
            raise ValueError(f"missing column: {f.name}")
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if defaults and f.name in defaults:
            c = F.coalesce(c.cast(f.dataType), F.lit(defaults[f.name]))
        c = c.cast(f.dataType)
        if f.name in DOMAINS:
            c = F.when(c.isNull() | c.isin(*DOMAINS[f.name]), c).otherwise(F.raise_error(F.concat(F.lit(f"{f.name}: no such value: "), c)).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def write(df: DataFrame, root: str, table: str, schema: T.StructType | str) -> None:
    """Replaces the packages that ``df`` holds (column package_id) and leaves the others."""
    checked(df, schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("package_id").parquet(folder(root, table))


def read(spark: SparkSession, root: str, table: str, schema: T.StructType | str, defaults: dict | None = None) -> DataFrame:
    """A stored table in the given schema; columns added since it was written take their default.  A missing table is empty."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    path = folder(root, table)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    stored = spark.read.option("mergeSchema", "true").parquet(path)
    return checked(stored.select(*[c for c in stored.columns if c in schema.names]), schema, defaults)


def delete_package(spark: SparkSession, root: str, table: str, package_id: int) -> None:
    """Drops a package's partition."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(root, table)}/package_id={int(package_id)}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def list_packages(packages: DataFrame) -> DataFrame:
    """Newest first (created_at is an ISO date-time)."""
    return packages.orderBy(F.to_timestamp("created_at").desc(), "package_id")


def zip_copies(copies: DataFrame, most_bytes: int = 50 * 26_214_400) -> bytes:
    """The reviewed copies of one package (unique_name, content) as a zip file; a package has 50 files at most."""
    rows = copies.select("unique_name", "content").orderBy("unique_name").take(51)
    if len(rows) > 50 or sum(len(r.content) for r in rows) > most_bytes:
        raise ValueError("more than a package may hold")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in rows:
            z.writestr(r.unique_name, bytes(r.content))
    return out.getvalue()
