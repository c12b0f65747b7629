"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of hashed shingles of five words.  Texts of equal shingle multisets collapse to
one representative with a count.  MinHash bands give candidates: representatives that share a
band are linked to the least of them (a star, never all pairs), and the stars' connected
components are the candidate groups.  Inside a group, pairs compare their MinHash values
``STEP`` at a time; under a uniform prior the posterior of the similarity after m of n agree
is Beta(m + 1, n - m + 1), and a pair is dropped once its probability of reaching the threshold
falls below ``TOLERANCE``.  What is left is verified exactly on the shingle sets.

Scale: bands are aggregated map-side, so a band value shared by very many texts costs no more
than others.  Groups above ``GROUP`` members are dealt in blocks over tasks.  A first pass over
the blocks sees MinHash values only (16 bits each) and names the representatives that keep a
partner there; only their texts travel to the second, which verifies.  Both return a row per
representative, so no plan node ever holds pairs.  At similarity t a pair shares no band with
probability (1 - t**ROWS)**BANDS, below 3e-6 at 0.8.

Words are runs of digits, a-z and non-ASCII characters of the lower-cased text; a text of one
to four words is a single shingle.  Defined cases: texts without words (null, empty, only
punctuation) link with nothing; a null doc_id links with nothing and has a null class; rows
that repeat a doc_id count as copies; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, forest, join_totals, one_a_key
from .spill import Scratch, materialise, small_batches
from .text import U, blocks, mix, row_starts, shingles, span_names, take_over, text_bytes, word_spans

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Bits kept of a MinHash value; unequal minima agree in them once in 65,536, so a few more pairs go on.
SIGN = 16
WIDTH = SIGN // 8
STEP = 16
TOLERANCE = 1e-6
GROUP = 1024
BUNDLE = 512

_rng = np.random.default_rng(20_240_601)
_XOR = _rng.integers(0, 1 << 64, HASHES, dtype=U, endpoint=False)
_MUL = _rng.integers(0, 1 << 64, HASHES, dtype=U, endpoint=False) | U(1)


def text_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a block of lower-cased texts and the row of each, in row order."""
    starts, ends, rows = word_spans(data, offsets)
    words = span_names(data, starts, ends)
    h, first = shingles(words, rows, WORDS)
    found, where = [h], [rows[first]]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    for k in range(1, WORDS):
        short, at = shingles(words, rows, k)
        keep = counts[rows[at]] == k
        found.append(mix(short[keep] + U(k)))
        where.append(rows[at[keep]])
    h, r = np.concatenate(found), np.concatenate(where)
    order = np.argsort(r, kind="stable")
    return h[order], r[order]


def minhash(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Upper ``SIGN`` bits of the smallest of each hash function, a row a text."""
    out = np.empty((len(starts), HASHES), np.uint16)
    if len(starts):
        for j in range(HASHES):
            out[:, j] = np.minimum.reduceat((h ^ _XOR[j]) * _MUL[j], starts) >> U(64 - SIGN)
    return out


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest agreements among n MinHash values with P(similarity >= threshold) >= tolerance.

    The posterior tail of Beta(m + 1, n - m + 1) above t equals P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def _sum_rows(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, U)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), f1, f2 (fingerprint of the shingles; null without words), sig (MinHash values)."""
    names = ["doc_id", "mark", "f1", "f2", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("jaccard")
        for batch in batches:
            data, offsets = text_bytes(_lowered(batch.column(2)))
            for a, b in blocks(offsets):
                h, rows = text_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                starts = row_starts(rows)
                some = rows[starts]
                f1, f2, sig = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), np.zeros((b - a, HASHES), np.uint16)
                f1[some], f2[some] = _sum_rows(mix(h + U(1)), starts).view(np.int64), _sum_rows(mix(h ^ U(0xA5A5)), starts).view(np.int64)
                sig[some] = minhash(h, starts)
                none = np.ones(b - a, bool)
                none[some] = False
                at = np.arange(b - a + 1, dtype=np.int32) * (WIDTH * HASHES)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(f1, mask=none), pa.array(f2, mask=none), pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at), pa.py_buffer(sig)])], names=names)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), _mark(), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, mark long, f1 long, f2 long, sig binary")


def _mark() -> Column:
    return F.xxhash64(F.col("text").cast("string")).alias("mark")


def candidate_groups(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, grp, size) of the representatives that share a band with another, by connected groups."""
    band = lambda b: F.xxhash64(b, F.substring("sig", b * (WIDTH * ROWS) + 1, WIDTH * ROWS))
    bands = reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("band"))
    shared = bands.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("n")).where("least < most").drop("most")
    stars = join_totals(bands, shared, ["band"], BANDS * reps.count()).where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    roots = components(stars, scratch)
    tops = roots.groupBy("v").agg((F.count("*") + 1).alias("size")).withColumn("n", F.col("size"))
    members = roots.select(F.col("u").alias("rep"), F.col("v").alias("grp")).unionByName(tops.select(F.col("v").alias("rep"), F.col("v").alias("grp")))
    return scratch.table(join_totals(members, tops.withColumnRenamed("v", "grp"), ["grp"], 2 * roots.count()), roots)


class Members:
    """The distinct texts of one task, by rep: groups, blocks, copies and MinHash values."""

    def __init__(self, table: pa.Table) -> None:
        rep = table.column("rep").to_numpy()
        #: Places in the table; rows that repeat a text are left out.
        _, self.row = np.unique(rep, return_index=True)
        self.rep = rep[self.row]
        self.grp, self.blk, self.copies = (table.column(c).to_numpy()[self.row] for c in ("grp", "blk", "copies"))
        raw, _ = text_bytes(table.column("sig").combine_chunks())
        self.sig = raw.reshape(-1, WIDTH * HASHES)[self.row].copy().view(np.uint16)

    def sides(self, bi: int, bj: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The two blocks to be compared of each group (one and the same array if they are one)."""
        by_group = np.argsort(self.grp, kind="stable")
        edges = np.append(row_starts(self.grp[by_group]), len(by_group))
        for s, e in zip(edges[:-1], edges[1:]):
            own = np.sort(by_group[s:e])
            x = own[self.blk[own] == bi]
            yield x, x if bi == bj else own[self.blk[own] == bj]


def likely_pairs(sig: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of texts of x and y that the comparison of MinHash values doesn't drop."""
    a, b = sig[x, :STEP], sig[y, :STEP]
    if len(x) * len(y) < 4096:
        same = (a[:, None, :] == b[None, :, :]).sum(axis=2)
    else:
        same = np.zeros((len(x), len(y)), np.int16)
        for k in range(STEP):
            same += a[:, k][:, None] == b[:, k][None, :]
    i, j = np.nonzero(same >= least_matches(STEP, threshold))
    m = same[i, j].astype(np.int64)
    i, j = x[i], y[j]
    if x is y:
        half = i < j
        i, j, m = i[half], j[half], m[half]
    for n in range(STEP, HASHES, STEP):
        if not len(i):
            break
        for s in range(0, len(i), 1 << 16):  # bounded memory
            q = slice(s, s + (1 << 16))
            m[q] += (sig[i[q], n : n + STEP] == sig[j[q], n : n + STEP]).sum(axis=1)
        alive = m >= least_matches(n + STEP, threshold)
        i, j, m = i[alive], j[alive], m[alive]
    return i, j


def similar_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose Jaccard similarity reaches the threshold, exactly."""
    if not len(i):
        return i, j
    common = _intersections(sets, i, j)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    good = common >= threshold * (size[i] + size[j] - common) - 1e-9
    return i[good], j[good]


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, exactly."""
    u, v = np.unique(i), np.unique(j)
    if len(i) <= 4 * (len(u) + len(v)):
        return np.fromiter((np.isin(sets[a], sets[b], assume_unique=True, kind="sort").sum() for a, b in zip(i.tolist(), j.tolist())), np.int64, len(i))
    # Many pairs of few sets: one product of 0/1 matrices, some shingles at a time.
    rows = np.union1d(u, v)
    flat = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    kept, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    pu, pv = np.searchsorted(rows, u), np.searchsorted(rows, v)
    total = np.zeros((len(u), len(v)), np.float32)
    for c in range(0, len(kept), 2048):
        s, e = np.searchsorted(column, (c, c + 2048))
        m = np.zeros((len(rows), 2048), np.float32)
        m[owner[s:e], column[s:e] - c] = 1
        total += m[pu] @ m[pv].T
    return total[np.searchsorted(u, i), np.searchsorted(v, j)].astype(np.int64)


def _prune(key: tuple, table: pa.Table, threshold: float) -> pa.Table:
    """The members that keep a likely partner in this task."""
    bi, bj = key[2].as_py(), key[3].as_py()
    t = Members(table)
    alive = np.zeros(len(t.rep), bool)
    for x, y in t.sides(bi, bj):
        for s in range(0, len(x), 256):  # not all pairs of two blocks at once
            i, j = likely_pairs(t.sig, x[s : s + 256], y, threshold)
            other = i != j
            alive[i[other]] = alive[j[other]] = True
    return table.take(pa.array(t.row[alive]))


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sorted shingle set of each text."""
    data, offsets = text_bytes(_lowered(column.combine_chunks()))
    out: list[np.ndarray] = []
    for a, b in blocks(offsets):
        h, rows = text_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        ends = np.searchsorted(rows, np.arange(b - a + 1))
        out += [np.unique(h[s:e]) for s, e in zip(ends[:-1], ends[1:])]
    return out


def _verify(key: tuple, table: pa.Table, threshold: float) -> pa.Table:
    """rep, links and least linked rep of the members that have links in this task."""
    bi, bj = key[2].as_py(), key[3].as_py()
    t = Members(table)
    sets = _sets(table.column("text").take(pa.array(t.row)))
    total, root = np.zeros(len(t.rep), np.int64), np.arange(len(t.rep))
    us, vs = [], []
    for x, y in t.sides(bi, bj):
        i, j = similar_pairs(sets, *likely_pairs(t.sig, x, y, threshold), threshold)
        np.add.at(total, i, t.copies[j])
        np.add.at(total, j, t.copies[i])
        if len(i):
            a, b = forest(i, j)
            us.append(a)
            vs.append(b)
    if us:
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        root[u] = v  # reps are sorted, so the least place is the least rep
    hit = np.flatnonzero(total)
    return pa.table({"rep": pa.array(t.rep[hit]), "links": pa.array(total[hit]), "root": pa.array(t.rep[root[hit]])})


TASK = ("large", "bundle", "bi", "bj")
MEMBER = "large long, bundle long, bi int, bj int, rep long, mark long, grp long, blk int, copies long, sig binary"


def _classes(docs: DataFrame, threshold: float, group: int, scratch: Scratch) -> DataFrame:
    """doc_id, mark, f1, f2, class_id and n_links, a row per row of docs."""
    rows = scratch.table(signatures(docs))
    reps = rows.where("doc_id is not null and f1 is not null").groupBy("f1", "f2")
    reps = reps.agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    reps = scratch.table(reps.select("f1", "f2", F.col("least.doc_id").alias("rep"), F.col("least.mark").alias("mark"), "copies", "sig"))
    members = candidate_groups(reps, scratch)
    bundles = max(1, members.count() // BUNDLE)
    dealt = members.withColumn("n", F.ceil(F.col("size") / group)).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    dealt = dealt.select("rep", "grp", "n", "blk").join(reps.select("rep", "mark", "copies", "sig"), "rep")
    # A large group is dealt as pairs of its blocks; small ones share tasks.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    large = F.col("n") > 1
    dealt = dealt.select(F.when(large, F.col("grp")).otherwise(F.lit(-1)).alias("large"), F.when(large, F.lit(0)).otherwise(F.pmod(F.xxhash64("grp"), F.lit(bundles))).cast("long").alias("bundle"), F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "rep", "mark", "grp", "blk", "copies", "sig")
    alive = scratch.table(dealt.groupBy(*TASK).applyInArrow(lambda key, table: _prune(key, table, threshold), MEMBER), members)
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), _mark(), F.col("text").cast("string").alias("text"))
    # However often a text is listed, it is verified once.
    listed = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("rep"), "mark").agg(F.count("*").alias("n"))
    wanted = scratch.table(alive.select("rep", "mark").distinct().join(listed, ["rep", "mark"]))
    texts = one_a_key(texts, wanted, ["rep", "mark"], rows.count())
    found = alive.join(texts, ["rep", "mark"]).groupBy(*TASK).applyInArrow(lambda key, table: _verify(key, table, threshold), "rep long, links long, root long")
    found = scratch.table(found, alive)
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
    total = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_rep = reps.select("f1", "f2", "rep", "copies").join(total, "rep", "left").join(roots.select(F.col("u").alias("rep"), F.col("v").alias("top")), "rep", "left")
    by_print = by_rep.select("f1", "f2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("top", "rep").alias("class_id"), F.col("copies").alias("n"))
    rows = rows.drop("sig")
    named = F.col("doc_id").isNotNull() & F.col("f1").isNotNull()
    alone = rows.where(~named).select("*", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"))
    return join_totals(rows.where(named), by_print, ["f1", "f2"], rows.count()).unionByName(alone)


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """doc_id, class_id (least doc_id reachable by links), n_links (other rows linked directly), a row per row of docs."""
    with Scratch(docs.sparkSession) as scratch:
        return materialise(_classes(docs, threshold, group, scratch).select("doc_id", "class_id", "n_links"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs`` with one row of each class; rows with a null doc_id stay.

    Of rows that repeat a doc_id, those of one fingerprint count as one document; others are judged
    apart, so that a text which merely shares its id with a kept one isn't lost.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = _classes(docs, threshold, GROUP, scratch).where("doc_id = class_id").groupBy("doc_id", "f1", "f2", "mark").agg(F.count("*").alias("n"))
        first = rows.groupBy("doc_id", "f1", "f2").agg(F.min(F.struct("mark", "n")).alias("first"))
        kept = materialise(first.select("doc_id", "first.mark", "first.n").groupBy("doc_id", "mark").agg(F.max("n").alias("n")))
    id_, mark = (_unused(docs, x) for x in ("kept_id", "kept_mark"))
    named = docs.where("doc_id is not null").withColumn(id_, F.col("doc_id").cast("long")).withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    once = one_a_key(named, kept.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), "n"), [id_, mark], docs.count())
    return once.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
