"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

Distributed prefix doubling.  Names of all substrings grow by pairs, length 25 at offset 25 to
length 50, length 50 at offset 50 to length 100; at each length Spark sorts (pair of ranks,
text, place) over the cluster, and ranks that stand alone drop out.

Not every position is sorted.  Each window of LENGTH bytes has an anchor at each of the lengths,
the substring in it of the smallest name, which depends on the window's content alone; so equal
windows have equal anchors, and neighbouring windows that share one make a *run*.  A row of the
sort is a run: the ranks of its anchors at the last length and this one, its text and its place.
Three things follow from the sorted order:

* a run alone under its rank pair drops out with all its windows: none stands elsewhere;
* of runs of equal text all but the first are repeats throughout;
* runs of different text under one rank pair go on to the next length, cut at its anchors.

At LENGTH every window is a run of its own, so nothing is left open.  Texts are compared by a
64-bit hash under an equal 64-bit name of the anchor, not byte by byte.

Scale: the sort is by range over all four columns, so a rank of any number of runs is spread
over tasks; a task needs only its neighbours' first and last rows, three a partition, which the
driver resolves.  Runs that are equal within a block of 1 MB are collapsed before anything is
shuffled.  Long texts are cut into overlapping blocks, so memory follows the block.

Defined cases: null text is empty; a row with a null doc_id is kept whole and hides nothing;
rows that repeat a doc_id are one document listed again and get equal results; texts below
LENGTH bytes are kept; matches never cross documents; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spill import Scratch, materialise, small_batches
from .text import U, mix, overlapping_blocks, prefix_hash, span_hash, take_over, text_bytes, window_argmin

#: Lengths of the ranks; each is twice the one before.
LENGTHS = (25, 50, 100)

#: rank: pair of ranks as one number; text: hash of the run; more: windows after the first; body: its bytes.
RUNS = "rank long, text long, doc_id long, lo long, more int"
BODIES = RUNS + ", body binary"
#: What a sorted row turned out to be: a repeat, open (to be refined), the first or last open row of a partition, its last row.
REPEAT, OPEN, HEAD, TAIL, LAST = range(5)


def names(data: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """Names of all substrings of the last of ``lengths``, by pairs of names at doubled offsets."""
    p, n = prefix_hash(data), lengths[0]
    at = np.arange(max(0, len(data) - n + 1))
    out = span_hash(p, at, at + n)
    for have, n in zip(lengths, lengths[1:]):
        step = n - have  # at most ``have``
        out = mix(out[: max(0, len(out) - step)] * U(0xFF51AFD7ED558CCD) + out[step:])
    return out


def cut_runs(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...], whole: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: its name, hash of the run's bytes, row, first window, further windows."""
    none = np.zeros(0, np.int64)
    if len(data) < whole:
        return none.view(U), none.view(U), none, none, none
    name = names(data, lengths)
    anchor = window_argmin(name, whole - lengths[-1] + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + whole <= offsets[row + 1])
    anchor, row = anchor[start], row[start]
    if not len(start):
        return none.view(U), none.view(U), none, none, none
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
    last = np.append(first[1:], len(start)) - 1
    lo, hi = start[first], start[last]
    return name[anchor[first]], span_hash(prefix_hash(data), lo, hi + whole), row[first], lo - offsets[row[first]], hi - lo


def anchor_runs(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """A row per run at the first length; ``again`` where the same run stands earlier in the block."""
    whole = lengths[-1]
    columns = [x.split()[0] for x in RUNS.split(", ")] + ["again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("suffixes")
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            for a, b, begin, end in overlapping_blocks(offsets, whole - 1):
                at = np.clip(offsets[a : b + 1], begin, end) - begin
                name, text, row, lo, more = cut_runs(data[begin:end], at, lengths[:1], whole)
                doc, lo = ids[a:b][row], lo + max(0, begin - offsets[a])
                order = np.lexsort((lo, doc, text, name))
                if len(order):
                    # A row that repeats a document brings the same runs at the same places: no later ones.
                    new = np.any([x[order[1:]] != x[order[:-1]] for x in (name, text, doc, lo)], axis=0)
                    order = order[np.concatenate(([True], new))]
                again = np.zeros(len(name), bool)
                again[order[1:]] = (name[order[1:]] == name[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
                order.sort()  # by place, which takes less room
                yield pa.RecordBatch.from_arrays([pa.array(name[order].view(np.int64)), pa.array(text[order].view(np.int64)), pa.array(doc[order]), pa.array(lo[order]), pa.array(more[order].astype(np.int32)), pa.array(again[order])], names=columns)

    source = small_batches(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, RUNS + ", again boolean")


class _Partition:
    """Reads a sorted partition batch by batch and says what its rows are.

    The first row of a rank is open only if another text follows under that rank, so it waits for it.
    """

    def __init__(self) -> None:
        self.part = TaskContext.get().partitionId()
        self.last: pa.RecordBatch | None = None
        self.waiting: pa.RecordBatch | None = None
        self.head = False  # whether what waits is the partition's first row

    def _out(self, rows: pa.RecordBatch, kind: int, several: bool = False) -> pa.RecordBatch:
        n = len(rows)
        extra = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, self.part, np.int32)), pa.array(np.full(n, several))]
        return pa.RecordBatch.from_arrays([*rows.columns, *extra], names=[*rows.schema.names, "kind", "part", "several"])

    def _settle(self, several: bool) -> Iterator[pa.RecordBatch]:
        if self.waiting is not None and (self.head or several):
            yield self._out(self.waiting, HEAD if self.head else OPEN, several)
        self.waiting, self.head = None, False

    def read(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start = self.last is None
        before = batch.slice(0, 1) if start else self.last
        column = lambda c: np.concatenate((before.column(c).to_numpy(), batch.column(c).to_numpy()))
        change = [x[1:] != x[:-1] for x in map(column, ("rank", "text", "doc_id", "lo"))]
        rank, text = change[0], change[0] | change[1]
        there = text | change[2] | change[3]  # else a row listed again
        if start:
            rank[0] = text[0] = there[0] = True
        self.last = batch.slice(len(batch) - 1)
        yield self._out(batch.filter(pa.array(there & ~text)), REPEAT)
        first = np.flatnonzero(text)
        if not len(first):
            return
        yield from self._settle(not rank[first[0]])
        yield self._out(batch.filter(pa.array(text & ~rank)), OPEN)
        # The first of a rank: open if the next text is under that rank too.
        opens = rank[first]
        followed = np.append(~opens[1:], False)
        if start:
            self.waiting, self.head = batch.slice(0, 1), True
            if len(first) > 1:
                yield from self._settle(bool(followed[0]))
            opens[0] = False
        yield self._out(batch.take(pa.array(first[opens & followed])), OPEN)
        if opens[-1]:
            self.waiting = batch.slice(int(first[-1]), 1)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.last is None:
            return
        if self.waiting is not None:
            yield self._out(self.waiting, HEAD if self.head else TAIL)
        yield self._out(self.last, LAST)


def sort_runs(runs: DataFrame) -> DataFrame:
    """The runs in order of (rank, text, place), with kind, part and several; those alone under their rank are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Partition()
        for batch in batches:
            if len(batch):
                yield from p.read(batch)
        yield from p.end()

    order = ["rank", "text", "doc_id", "lo"]
    schema = ", ".join(f"{n} {t}" for n, t in runs.dtypes) + ", kind int, part int, several boolean"
    return runs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def resolve(rows: list) -> list[tuple[bool, object]]:
    """(repeat, row) of the HEAD and TAIL rows of all partitions that are repeats or open.

    ``rows`` hold each partition's HEAD, TAIL (if any) and LAST row.
    """
    parts: dict[int, dict[int, object]] = {}
    for r in rows:
        parts.setdefault(r.part, {})[r.kind] = r
    order = [parts[i] for i in sorted(parts)]
    follows = [False] * len(order)  # another text follows in later partitions under the rank of the LAST row
    for i in range(len(order) - 2, -1, -1):
        last, head = order[i][LAST], order[i + 1][HEAD]
        if head.rank == last.rank:
            after = order[i + 1][LAST]
            follows[i] = head.text != last.text or head.several or (after.rank == last.rank and follows[i + 1])
    out = []
    for i, p in enumerate(order):
        head, last, before = p[HEAD], p[LAST], order[i - 1][LAST] if i else None
        joined = before is not None and before.rank == head.rank
        if joined and before.text == head.text:
            out.append((True, head))
        elif joined or head.several or (last.rank == head.rank and follows[i]):
            out.append((False, head))
        if TAIL in p and follows[i]:
            out.append((False, p[TAIL]))
    return out


def _settled(ranked: DataFrame, whole: int, body: bool) -> tuple[DataFrame, DataFrame]:
    """Spans of the repeats, and the open runs."""
    spark = ranked.sparkSession
    columns = ["rank", "doc_id", "lo", "more"] + ["body"] * body
    edges = resolve(ranked.where(F.col("kind") >= HEAD).collect())  # three rows a partition at most
    schema = ranked.select(*columns).schema
    made = lambda repeat: spark.createDataFrame([tuple(r[c] for c in columns) for was, r in edges if was == repeat], schema)
    span = lambda rows: rows.select("doc_id", F.col("lo").alias("start"), (F.col("lo") + F.col("more") + whole).alias("end"))
    repeats = span(ranked.where(F.col("kind") == REPEAT)).unionByName(span(made(True)))
    return repeats, ranked.where(F.col("kind") == OPEN).select(*columns).unionByName(made(False))


#: Runs cut at a time.
PIECE = 8192


def _refined(rank: np.ndarray, doc: np.ndarray, begin: np.ndarray, data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...], whole: int) -> pa.RecordBatch:
    """The runs with the given bytes cut at the anchors of the last of ``lengths``, ranked by (rank so far, name of the anchor).

    At the full length a run is one window and its bytes are of no more use.
    """
    name, text, row, lo, more = cut_runs(data, offsets, lengths, whole)
    pair = mix(rank[row].view(U) * U(0xC4CEB9FE1A85EC53) + name)
    out = [pa.array(pair.view(np.int64)), pa.array(text.view(np.int64)), pa.array(doc[row]), pa.array(begin[row] + lo), pa.array(more.astype(np.int32))]
    if lengths[-1] < whole:
        at = offsets[row] + lo
        out.append(pa.array([data[i:j].tobytes() for i, j in zip(at, at + more + whole)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in _schema(lengths, whole).split(", ")])


def _schema(lengths: tuple[int, ...], whole: int) -> str:
    return BODIES if lengths[-1] < whole else RUNS


def refine_texts(docs: DataFrame, runs: DataFrame, lengths: tuple[int, ...], whole: int) -> DataFrame:
    """``_refined`` of runs (rank, doc_id, lo, more) of the documents."""
    wanted = runs.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "more", "rank")).alias("runs"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            lists = batch.column(2)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            lo, more, rank = (flat.field(c).to_numpy() for c in ("lo", "more", "rank"))
            # A doc_id may repeat with a shorter text: what lies beyond it is left out.
            keep = np.flatnonzero(lo + more + whole <= np.diff(offsets)[row])
            for s in range(0, len(keep), PIECE):
                k = keep[s : s + PIECE]
                size = more[k].astype(np.int64) + whole
                at = np.concatenate(([0], np.cumsum(size)))
                body = data[np.repeat(offsets[row[k]] + lo[k] - at[:-1], size) + np.arange(at[-1])]
                yield _refined(rank[k], ids[row[k]], lo[k], body, at, lengths, whole)

    return source.join(wanted, "doc_id").mapInArrow(run, _schema(lengths, whole))


def refine(bodies: DataFrame, lengths: tuple[int, ...], whole: int) -> DataFrame:
    """``_refined`` of runs (rank, doc_id, lo, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in batches:
            for s in range(0, len(wide), PIECE):
                batch = wide.slice(s, PIECE)
                rank, doc, begin = (batch.column(c).to_numpy() for c in ("rank", "doc_id", "lo"))
                yield _refined(rank, doc, begin, *text_bytes(batch.column("body")), lengths, whole)

    return bodies.select("rank", "doc_id", "lo", "body").mapInArrow(run, _schema(lengths, whole))


def _bounds(spans: DataFrame) -> DataFrame:
    """(doc_id, bounds): each document's merged spans as start << 32 | end."""
    packed = spans.select("doc_id", (F.shiftleft("start", 32) + F.col("end")).alias("span")).groupBy("doc_id").agg(F.collect_list("span").alias("bounds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            order = np.lexsort((flat, row))
            row, start, end = row[order], flat[order] >> 32, flat[order] & 0xFFFFFFFF
            shift = row.astype(np.int64) << 33  # rows one behind the other, so that one running maximum serves all
            reach = np.maximum.accumulate(end + shift)
            new = np.flatnonzero(np.concatenate(([True], (start + shift)[1:] > reach[:-1])))
            end = (reach - shift)[np.append(new[1:], len(row)) - 1]
            merged = (start[new] << 32) + end
            at = np.searchsorted(row[new], np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(merged))], names=["doc_id", "bounds"])

    return packed.mapInArrow(run, "doc_id long, bounds array<bigint>")


def repeated_bounds(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(doc_id, bounds): maximal spans of bytes covered by strings that start earlier, each as start << 32 | end."""
    whole = lengths[-1]
    if any(b != 2 * a for a, b in zip(lengths, lengths[1:])):
        raise ValueError("each length is twice the one before")
    with Scratch(docs.sparkSession) as scratch:
        runs = scratch.table(anchor_runs(docs, lengths))
        ranked = sort_runs(runs.where("not again").drop("again"))
        again = runs.where("again").drop("again").select("*", F.lit(REPEAT).alias("kind"), F.lit(0).alias("part"), F.lit(False).alias("several"))
        ranked = scratch.table(ranked.unionByName(again), runs)
        spans, still = _settled(ranked, whole, False)
        for n in range(2, len(lengths) + 1):
            # One Python step a stage: each would hold a worker of its own.
            refined = refine_texts(docs, still, lengths[:n], whole) if n == 2 else refine(still, lengths[:n], whole)
            refined = scratch.table(refined)
            ranked = scratch.table(sort_runs(refined), refined)
            found, still = _settled(ranked, whole, n < len(lengths))
            spans = spans.unionByName(found)
        return materialise(_bounds(spans))


def remove_repeats(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, kept (bytes that stay), spans (removed [start, end), maximal) of every row.

    ``keep`` names further columns of ``docs`` to carry along.
    """
    bounds = repeated_bounds(docs, lengths).select(F.col("doc_id").alias("__doc"), F.col("bounds").alias("__bounds"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("__text"), *keep)
    joined = source.join(bounds, F.col("doc_id") == F.col("__doc"), "left").select("doc_id", "__text", "__bounds", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                n, kept, out = [], [], []
                for text, bounds in zip(batch.column(1), batch.column(2).to_pylist()):
                    b = text.as_py() or b""
                    # A doc_id may repeat with a shorter text.
                    merged = [(x >> 32, min(x & 0xFFFFFFFF, len(b))) for x in bounds or () if x >> 32 < len(b)]
                    n.append(len(b))
                    out.append([{"start": s, "end": e} for s, e in merged])
                    edges = [0, *[x for m in merged for x in m], len(b)]
                    kept.append(b"".join(b[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(out, kind), *[batch.column(3 + i) for i in range(len(keep))]], names=["doc_id", "n_bytes", "kept", "spans", *keep])

    more = "".join(f", `{c}` {t}" for c, t in source.select(*keep).dtypes) if keep else ""
    return joined.mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>" + more)
