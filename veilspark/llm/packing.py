"""Cost-balanced packing of token documents into sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (projections, then attention).
Documents are dealt by a hash into packing groups of about ``GROUP_BYTES`` of text.  Within a
group as many sequences are opened as its tokens fill; documents in descending length go to
the sequence of the lowest cost that still has room.  What is longer than a sequence is cut
into full ones first, and where no sequence has room the document is cut at the room of the
emptiest, so a group pads less than one sequence.

Scale: the group count follows the input, each group is packed alone and the token ids cross
the network once.  Groups are dealt by a hash of each row's place as well as its content, so rows
that repeat a document spread.  A shuffle partition holds one group, or several where there would
be more than ``MOST_PARTITIONS``.  Defined cases: null text is empty and packs as the end id
alone; repeated rows are packed each; ties go by doc_id; an empty table gives an empty result;
extra columns are ignored; a null doc_id stays null; a text of more ids than a Spark value holds
(2**29) fails with ``ValueError``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spill import small_batches
from .text import blocks, take_over, text_bytes
from .tokens import encoder

SEQUENCE = 4096
END_ID = 2
LINEAR = 1.0
QUADRATIC = 1.0 / 2048
GROUP_BYTES = 8 << 20
MOST_PARTITIONS = 1 << 17


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: np.ndarray, size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; documents come in any order."""
    out: list[tuple[int, int, int, int, int]] = []
    next_sequence, rest = 0, []
    for i, n in enumerate(map(int, lengths)):
        for k in range(n // size):
            out.append((i, k * size, size, next_sequence, 0))
            next_sequence += 1
        if n % size:
            rest.append((-(n % size), i, n - n % size))
    rest.sort()
    opened = -(-sum(-r[0] for r in rest) // size)
    room = [size] * opened
    spent = [0.0] * opened
    heap = [(0.0, s) for s in range(opened)]

    def put(doc: int, start: int, n: int, s: int) -> None:
        out.append((doc, start, n, next_sequence + s, size - room[s]))
        room[s] -= n
        spent[s] += cost(n)

    for need, doc, start in rest:
        need, passed = -need, []
        while heap and room[heap[0][1]] < need:
            passed.append(heapq.heappop(heap))
        if heap:
            _, s = heapq.heappop(heap)
            put(doc, start, need, s)
            passed.append((spent[s], s))
        else:
            by_room = sorted((-room[s], s) for _, s in passed)
            used = set()
            for free, s in by_room:
                if need == 0:
                    break
                n = min(need, -free)
                put(doc, start, n, s)
                start, need = start + n, need - n
                used.add(s)
            passed = [(spent[s], s) for _, s in passed]
        for x in passed:
            if room[x[1]]:
                heapq.heappush(heap, x)
    return out


def token_table(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of each text, with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("tokens")
        enc = encoder(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets):
                ids, at = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if end_id is not None:
                    ids = np.insert(ids, at[1:], np.uint32(end_id))
                    at = at + np.arange(len(at))
                if at[-1] >= 1 << 29:
                    raise ValueError("a text of 2**29 tokens or more")
                body = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), body], names=["doc_id", "ids"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_documents(docs: DataFrame, path: str, size: int = SEQUENCE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Every piece with its ids (little-endian unsigned 32-bit)."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-total // group_bytes))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")]).combine_chunks()
        raw, offsets = text_bytes(table.column("ids"))
        lengths = np.diff(offsets) // 4
        pieces = pack(lengths, size)
        doc, start, n, seq, offset = (np.array(x, np.int64) for x in zip(*pieces)) if pieces else (np.zeros(0, np.int64),) * 5
        begin = offsets[doc] + start * 4
        body = raw.tobytes()
        ids = [body[i : i + 4 * k] for i, k in zip(begin.tolist(), n.tolist())]
        group = table.column("grp")[0].as_py()
        return pa.Table.from_arrays([table.column("doc_id").combine_chunks().take(pa.array(doc)), pa.array(start), pa.array(n), pa.array(ids, pa.binary()), pa.array(lengths[doc]), pa.array((group << 32) + seq), pa.array(offset)], schema=PIECE)

    tokens = token_table(docs, path).withColumn("grp", F.pmod(F.xxhash64("doc_id", F.crc32("ids"), F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return tokens.repartition(min(groups, MOST_PARTITIONS), "grp").groupBy("grp").applyInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
