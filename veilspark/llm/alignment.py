"""Cross-tokenizer alignment by a cogroup of postings.

Every text is encoded by two tokenizers whose tokens tile the same bytes.  Offsets where tokens of
both end cut them into groups, and each pair of tokens whose byte ranges overlap is a link.  How
good a link is depends on the corpus: a pair's count is the number of links anywhere that hold it.

1. A map over the documents gives a row a document, and its pairs with their multiplicities as
   posting lists: one row a block of documents and *bucket* of side ids (the ids of the second
   tokenizer), sorted by pair and document.
2. Tasks add up the pairs they hold, ``groupBy`` their sums, and a window over a side id's few
   thousand partners finds its highest count.
3. Postings and counts meet by bucket: a cogroup, whose sorted streams Spark spills.  Each posting looks
   its pair up and is worth ``m * count`` to its document, and ``m`` links more where the count is
   the highest.
4. What documents get from the buckets is summed by document.

Scale: postings cross the network once, packed, and pairs are added up before they do.  A bucket
with more than ``GROUP_BYTES`` of postings is split by block over several groups, each of which gets
the bucket's counts, so a side id that stands in every document fills no task.  A block holds at most
a megabyte of text or one document, and a longer document is aligned in parts.

Defined cases: texts that are null, empty, or whose joined token bytes of either side aren't a space and
the text (the second tokenizer's sign for a space stands in them, say) have no tokens; rows that
repeat an id are documents of their own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .spill import Scratch, materialise, small_batches
from .text import BLOCK_BYTES, KEPT, blocks, take_over, text_bytes
from .tokens import Rows, Units, parts, unit_starts

#: Side ids are dealt to so many buckets.
BUCKETS = 32
#: Postings of a bucket beyond it are dealt over several groups.
GROUP_BYTES = 16 << 20
#: Distinct pairs that a task adds up before it sends them on.
HELD = 2_000_000
SPACE_SIGN = "▁"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted({*range(256)} - {*plain})
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner(Units):
    """What is kept of a unit: its numbers of tokens, groups and links, its links' pairs and its groups as text.

    Units begin with a space and end before one that follows another character.  No token of either
    side reaches over such a cut, so all units end where tokens of both sides do.
    """

    COUNTS = 4

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.width = max(vocabulary.values()) + 1
        self.bytes_a = [b""] * self.width
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in pieces):
            raise ValueError("a piece holds a space behind other characters, so texts can't be cut at spaces")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.lone = self.b.piece_to_id(SPACE_SIGN)
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.counts = np.zeros((0, self.COUNTS), np.int64)  # tokens of both sides, groups, links
        self.bad = np.zeros(0, bool)
        self.pairs, self.texts = Rows(np.uint64), Rows(np.uint8)

    def learn(self, new: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in new]
        side_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        counts, bad, pairs, shown = [], [], [], []
        for w, t, b in zip(new, texts, side_b):
            a = self.a.encode(t, add_special_tokens=False).ids
            b = b or [self.lone]
            own_a, own_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
            if b"".join(own_a) != w or b"".join(own_b) != w:
                counts.append((0,) * self.COUNTS)
                bad.append(True)
                pairs.append([])
                shown.append(b"")
                continue
            links, text, groups = self._align(a, b, own_a, own_b)
            counts.append((len(a), len(b), groups, len(links)))
            bad.append(False)
            pairs.append(links)
            shown.append(text)
        self.counts = np.concatenate((self.counts, np.array(counts, np.int64)))
        self.bad = np.concatenate((self.bad, np.array(bad)))
        self.pairs.add(np.fromiter((p for x in pairs for p in x), np.uint64), np.fromiter(map(len, pairs), np.int64, len(pairs)))
        self.texts.add(np.frombuffer(b"".join(shown), np.uint8), np.fromiter(map(len, shown), np.int64, len(shown)))

    def _align(self, a: list[int], b: list[int], own_a: list[bytes], own_b: list[bytes]) -> tuple[list[int], bytes, int]:
        """The pairs of all links, the groups as text (each ends with a semicolon), and their number."""
        if len(a) == len(b) == 1:
            return [b[0] * self.width + a[0]], b"%d|%d;" % (a[0], b[0]), 1
        links, text, groups = [], [], 0
        i = j = from_i = from_j = 0
        end_a, end_b = len(own_a[0]), len(own_b[0])
        while True:
            links.append(b[j] * self.width + a[i])
            both = end_a == end_b
            if both:
                text.append(f"{','.join(map(str, a[from_i : i + 1]))}|{','.join(map(str, b[from_j : j + 1]))};")
                groups += 1
                from_i, from_j = i + 1, j + 1
                if from_i == len(a):
                    return links, "".join(text).encode(), groups
            on_a, on_b = end_a <= end_b, end_b <= end_a
            if on_a:
                i += 1
                end_a += len(own_a[i])
            if on_b:
                j += 1
                end_b += len(own_b[j])

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        """Of a block of texts: counts, which are bad, (pairs with their multiplicities) by row, and groups as text.

        One long text gives several of these, a part each.
        """
        spaced = np.insert(data, offsets[:-1], np.uint8(32))
        at = offsets + np.arange(len(offsets))
        if len(at) == 2 and len(spaced) > BLOCK_BYTES:
            for s, e in parts(spaced, by_kind=False):
                yield self._rows(spaced[s:e], np.array([0, e - s]))
        else:
            yield self._rows(spaced, at)

    def _rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        starts = unit_starts(data, offsets, by_kind=False)
        which = self.numbers(data, starts)
        first = np.searchsorted(starts, offsets[:-1])
        counts = np.add.reduceat(self.counts[which], first) if len(which) else np.zeros((len(first), self.COUNTS), np.int64)
        bad = np.logical_or.reduceat(self.bad[which], first) if len(which) else np.zeros(len(first), bool)
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(which))))
        pairs, at = self.pairs.take(which)
        flat, text_at = self.texts.take(which)
        ends = np.append(text_at[first], len(flat)).tolist()
        body = flat.tobytes()
        return counts, bad, np.repeat(row, np.diff(at)), pairs, [body[s:e] for s, e in zip(ends[:-1], ends[1:])]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


KEPT.append(aligner.cache_clear)


def _counted(doc: np.ndarray, pair: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, document) in that order, with how often each stands there."""
    order = np.lexsort((doc, pair))
    doc, pair = doc[order], pair[order]
    first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])))) if len(pair) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(pair))) if times is None else np.add.reduceat(times[order], first) if len(first) else np.zeros(0, np.int64)
    return pair[first], doc[first], n


def _pack(pair: np.ndarray, doc: np.ndarray, n: np.ndarray) -> bytes:
    """A posting list: its length, steps between pairs, documents, multiplicities."""
    return b"".join((np.array([len(pair)], "<i8").tobytes(), np.diff(pair, prepend=pair.dtype.type(0)).astype("<u8").tobytes(), doc.astype("<u4").tobytes(), n.astype("<u4").tobytes()))


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(body, "<i8", 1)[0])
    return np.cumsum(np.frombuffer(body, "<u8", n, 8), dtype=np.uint64), np.frombuffer(body, "<u4", n, 8 + 8 * n).astype(np.int64), np.frombuffer(body, "<u4", n, 8 + 12 * n).astype(np.int64)


DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LOCAL = f"block long, doc int, {DOCUMENT}, bucket int, postings binary"
_NAMES = [x.split()[0] for x in LOCAL.split(", ")]


def postings(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row a document (bucket null), and a row a block of documents and bucket with its posting lists."""

    def long_text(tool: Aligner, data: np.ndarray, offsets: np.ndarray) -> tuple:
        total, bad, digest = np.zeros(tool.COUNTS, np.int64), False, hashlib.sha256()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        before = b""
        for counts, wrong, _, pairs, (text,) in tool.rows(data, offsets):
            total, bad = total + counts[0], bad or bool(wrong[0])
            digest.update(before)
            digest.update(text[:-1])
            before = text[-1:]
            held.append(np.unique(pairs, return_counts=True))
        pair, n = (np.concatenate(x) for x in zip(*held))
        return total[None, :], np.array([bad]), _counted(np.zeros(len(pair), np.int64), pair, n), [digest.hexdigest()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("alignment")
        tool, block = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            whole, ends = text_bytes(batch.column(1))
            for s, e in blocks(ends):
                data, offsets = whole[ends[s] : ends[e]], ends[s : e + 1] - ends[s]
                if e - s == 1 and len(data) >= BLOCK_BYTES:
                    counts, bad, (pair, doc, n), digests = long_text(tool, data, offsets)
                else:
                    ((counts, bad, doc, pair, texts),) = tool.rows(data, offsets)
                    keep = ~(bad | (np.diff(offsets) == 0))[doc]
                    pair, doc, n = _counted(doc[keep], pair[keep])
                    digests = [hashlib.sha256(t[:-1]).hexdigest() for t in texts]
                none = bad | (np.diff(offsets) == 0)
                if none.any():
                    counts = np.where(none[:, None], 0, counts)
                    digests = ["" if x else d for x, d in zip(none, digests)]
                    if e - s == 1:
                        pair, doc, n = pair[:0], doc[:0], n[:0]
                size = e - s
                columns = [pa.array(np.full(size, block)), pa.array(np.arange(size), pa.int32()), batch.column(0).slice(s, size), *(pa.array(c) for c in np.ascontiguousarray(counts.T)), pa.array(digests, pa.string()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
                side = (pair // np.uint64(tool.width)).astype(np.int64) % BUCKETS
                order = np.argsort(side, kind="stable")
                edges = np.searchsorted(side[order], np.arange(BUCKETS + 1))
                some = [(k, order[x:y]) for k, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if y > x]
                if some:
                    m = len(some)
                    columns = [pa.array(np.full(m, block)), *(pa.nulls(m, t) for t in (pa.int32(), *(pa.int64(),) * 5, pa.string())), pa.array([k for k, _ in some], pa.int32()), pa.array([_pack(pair[o], doc[o], n[o]) for _, o in some], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
                block += 1

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, LOCAL)


def pair_counts(lists: DataFrame, width: int) -> DataFrame:
    """(bucket, pairs, counts, best): all pairs of a bucket in order, their counts, and which are their side id's highest."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pair, _, n = _counted(np.zeros(size, np.int64), *(np.concatenate(x) for x in zip(*held)))
            return pair, n

        def rows(pair: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(pair), 1 << 16):
                part = slice(s, s + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array((pair[part] // np.uint64(width)).astype(np.int32)), pa.array((pair[part] % np.uint64(width)).astype(np.int32)), pa.array(n[part])], names=["b", "a", "n"])

        for batch in batches:
            for body in batch.column(0):
                pair, _, n = _unpack(body.as_py())
                pair, _, n = _counted(np.zeros(len(pair), np.int64), pair, n)
                held.append((pair, n))
                size += len(pair)
                if size > 2 * HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*merged())

    counts = lists.select("postings").mapInArrow(add, "b int, a int, n long").groupBy("b", "a").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b"))).withColumn("bucket", F.pmod("b", F.lit(BUCKETS)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        pair = table.column("b").to_numpy().astype(np.uint64) * np.uint64(width) + table.column("a").to_numpy().astype(np.uint64)
        order = np.argsort(pair)
        body = [pair[order].tobytes(), table.column("n").to_numpy()[order].tobytes(), table.column("best").to_numpy()[order].tobytes()]
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), **{k: pa.array([x], pa.binary()) for k, x in zip(("pairs", "counts", "best"), body)}})

    return counts.groupBy("bucket").applyInArrow(pack, "bucket int, pairs binary, counts binary, best binary")


def _worth(postings: pa.Table, counts: pa.Table) -> pa.Table:
    """block, doc, n_best and count_sum: what each document gets from the postings of one group."""
    if not len(postings) or not len(counts):
        return pa.table({"block": pa.array([], pa.int64()), "doc": pa.array([], pa.int32()), "n_best": pa.array([], pa.int64()), "count_sum": pa.array([], pa.int64())})
    pairs, count, best = (np.frombuffer(counts.column(k)[0].as_py(), t) for k, t in (("pairs", np.uint64), ("counts", np.int64), ("best", bool)))
    out: list[tuple[np.ndarray, ...]] = []
    for block, body in zip(postings.column("block"), postings.column("postings")):
        pair, doc, n = _unpack(body.as_py())
        at = np.searchsorted(pairs, pair)
        order = np.argsort(doc, kind="stable")
        doc = doc[order]
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        out.append((np.full(len(first), block.as_py()), doc[first], np.add.reduceat((n * best[at])[order], first), np.add.reduceat((n * count[at])[order], first)))
    block, doc, n_best, count_sum = map(np.concatenate, zip(*out))
    return pa.table({"block": block, "doc": pa.array(doc, pa.int32()), "n_best": n_best, "count_sum": count_sum})


def align(docs: DataFrame, path_a: str, path_b: str, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """DOCUMENT's columns, n_best and count_sum, a row a document."""
    spark = docs.sparkSession
    width = max(Tokenizer.from_file(path_a).get_vocab().values()) + 1
    with Scratch(spark) as scratch:
        local = scratch.table(postings(docs, path_a, path_b))
        lists = local.where("bucket is not null").select("block", "bucket", "postings")
        sizes = lists.groupBy("bucket").agg(F.sum(F.octet_length("postings")).alias("size")).collect()  # BUCKETS rows
        groups = _by_bucket({r["bucket"]: -(-r["size"] // group_bytes) for r in sizes})
        counts = scratch.table(pair_counts(lists, width))
        dealt = lists.withColumn("group", F.pmod(F.xxhash64("block"), groups).cast("int"))
        spread = counts.withColumn("group", F.explode(F.sequence(F.lit(0), groups - 1)))
        worth = dealt.groupBy("bucket", "group").cogroup(spread.groupBy("bucket", "group")).applyInArrow(_worth, "block long, doc int, n_best long, count_sum long")
        summed = worth.groupBy("block", "doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        rows = local.where("bucket is null").drop("bucket", "postings").join(summed, ["block", "doc"], "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return materialise(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))


def _by_bucket(groups: dict[int, int]) -> Column:
    """The number of groups of a row's bucket."""
    return F.element_at(F.array(*[F.lit(groups.get(k, 1)) for k in range(BUCKETS)]), F.col("bucket") + 1)
