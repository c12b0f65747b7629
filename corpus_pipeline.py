"""The corpus pipeline: documents through five of the operators, each stage stored before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  Null texts or ids, repeated rows, empty tables and extra columns are
handled as the operators say; extra columns of ``docs`` are dropped by ``run``'s first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import jaccard, language, mixing, packing, suffixes
from veilspark.llm.queries import VOCABULARY
from veilspark.llm.spill import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected if it has no letters, or if no language reaches this mean posterior
#: (with a handful of learned languages an even guess stays below it).
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay, with ``lang`` as predicted."""
    got = language.identify(docs, language.train(docs), ("text", "source", "n_chars"))
    kept = got.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the least doc_id."""
    return jaccard.drop_near_duplicates(docs).select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay only where they stand first; a document that is all repeats goes.

    A removed span that begins or ends within a character leaves the rest of that character
    out as well.
    """
    got = suffixes.remove_repeats(docs, keep=("lang", "source", "n_chars"))
    text = F.when(F.size("spans") > 0, F.try_validate_utf8(F.col("kept"))).otherwise(F.col("kept").cast("string"))
    # Bytes of half characters: continuation bytes after a cut, or a head without them.
    text = F.coalesce(text, F.regexp_replace(F.make_valid_utf8(F.col("kept")), "�", ""))
    changed = F.size("spans") > 0
    out = got.where(~(changed & (F.octet_length("kept") == 0))).withColumn("new", text)
    return out.select("doc_id", F.col("new").alias("text"), "lang", "source", F.when(changed, F.length("new").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in global random order."""
    return mixing.poisson_mix(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("suffix_dedup", repeats_stage),
    ("poisson_mix", mixing_stage),
    ("packing", packing_stage),
]

#: A trained model, MinHash and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    tables = Scratch(spark)  # holds one stage's rows at a time; the last are read by what is returned
    *first, (_, last) = STAGES
    for _, stage in first:
        docs = tables.table(stage(spark, docs, sf_dir), docs)
    return last(spark, docs, sf_dir)
