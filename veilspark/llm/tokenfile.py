"""Token files: Parquet list columns with delta or dictionary encoding, small row groups and page indexes.

One row a document: ``doc_id``, ``part`` (number of its file), ``begin`` (ids before it in that
file), ``n_tokens`` and ``ids``.  Documents are dealt by ranges of doc_id and sorted, so files and
rows stand in ascending order, and Spark's own Parquet writer encodes the ids as bit-packed deltas
or as numbers into a dictionary page.  Row groups and pages are small and indexed, and doc_id is
sorted: reading some documents touches the pages that hold them, and what only asks where
documents stand (``document_index``) never reads ids.

Scale: text crosses the network once, before it is encoded, because a range exchange runs what is
below it twice.  Rows that repeat an id are spread by a hash of their text and their place, so no id
fills a file.  Places of files are sums over one number a file, at most ``MOST_PARTITIONS``.

Defined cases: a null text is empty and holds the end id alone; null doc_ids stand first; rows
that repeat an id follow each other, by a hash of their text; an empty table gives files without rows;
extra columns are ignored.  A document's ids must fit one Spark value (2 GB).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spill import Scratch, settings, small_batches
from .text import blocks, take_over, text_bytes
from .tokens import encoder

END_ID = 2
PART_BYTES = 16 << 20
MOST_PARTITIONS = 1 << 17
ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 64 << 10
ENCODINGS = ("delta", "dictionary")
SCHEMA = "doc_id long, part int, begin long, n_tokens long, ids array<int>"


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID) -> DataFrame:
    """The rows of a token file, dealt and sorted as its files are."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = min(max(1, -(-total // PART_BYTES)), MOST_PARTITIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("tokens")
        enc, part, first = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets):
                ids, at = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if end_id is not None:
                    ids = np.insert(ids, at[1:], np.uint32(end_id))
                    at = at + np.arange(len(at))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))
                columns = [batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part), pa.int32()), pa.array(first + at[:-1]), pa.array(np.diff(at)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "begin", "n_tokens", "ids"])
                first += int(at[-1])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = ["doc_id", "tie", "place"]
    return rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = END_ID, encoding: str = ENCODINGS[0], row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Writes the token files of ``docs`` to a folder that Spark can reach."""
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding is one of {ENCODINGS}")
    options = {
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.writer.version": "v2",  # integers without a dictionary are bit-packed deltas there
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "compression": "zstd",
    }
    with settings(docs.sparkSession, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        encode_documents(docs, vocabulary, end_id).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _starts(table: DataFrame) -> DataFrame:
    """(part, base): the ids before each file, a row a file."""
    sizes = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens; reads no ids."""
    table = _files(spark, path)
    return table.select("doc_id", "part", "begin", "n_tokens").join(F.broadcast(_starts(table)), "part").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens")


def read_documents(spark: SparkSession, path: str, least: int, most: int) -> DataFrame:
    """doc_id and ids of the documents from ``least`` to ``most``; row groups and pages without them are skipped."""
    return _files(spark, path).where(F.col("doc_id").between(least, most)).select("doc_id", "ids")


def read_window(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """doc_id, at (the place of its first id here) and ids of what stands at [start, start + length) of all ids."""
    table = _files(spark, path)
    first = F.col("base") + F.col("begin")
    hit = table.join(F.broadcast(_starts(table)), "part").where((first < start + length) & (first + F.col("n_tokens") > start))
    skip = F.greatest(F.lit(start) - first, F.lit(0)).cast("int")
    return hit.select("doc_id", (first + skip).alias("at"), F.slice("ids", skip + 1, F.least(F.col("n_tokens") - skip, F.lit(start + length) - first - skip).cast("int")).alias("ids"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            body = memoryview(np.ascontiguousarray(lists.values.to_numpy()).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(body[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = _files(spark, path)
    placed = small_batches(table).join(F.broadcast(_starts(table)), "part").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` written to token files in the shared folder and read back; they go when Spark ends."""
    path = Scratch(docs.sparkSession).folder("tokens")
    write_tokens(docs, path, vocabulary)
    return token_digest(docs.sparkSession, path)
