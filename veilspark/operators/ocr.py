"""OCR words: TSV rows, lines, texts, offsets, boxes of text spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import spans
from veilspark.operators.batches import small_batches

LOW_MEAN = 65
LOW_WORD = 60
LOW_RUN = 3
OVERLAP_SHARE = 0.3


def parse_tsv(rows: DataFrame) -> DataFrame:
    """Word rows of recogniser TSV lines (file_id, n, value): level 5, 12 columns at least, finite numbers, a box, some text."""
    c = F.split("value", "\t", -1)
    number = lambda i: F.nullif(F.get(c, F.lit(i)).try_cast("double"), F.lit(float("nan")))
    df = rows.select("file_id", "n", c.alias("c"), *[number(i).alias(k) for i, k in ((6, "x"), (7, "y"), (8, "w"), (9, "h"), (10, "confidence"))])
    text = F.array_join(F.slice("c", F.lit(12), F.greatest(F.size("c") - 11, F.lit(0))), "\t")
    finite = " and ".join(f"{k} is not null and abs({k}) < double('infinity')" for k in ("x", "y", "w", "h", "confidence"))
    return df.where(F.col("n") > 0).where("size(c) >= 12 and c[0] = '5'").where(finite).where("w > 0 and h > 0").select("file_id", "n", "x", "y", "w", "h", "confidence", text.alias("text")).where("trim(text) <> ''")


def fold_lines(centers: list[float | None], heights: list[float | None]) -> list[int]:
    """The line of each word, given in order of their centres; a word without a centre stays on the line."""
    out, line, c, h = [], -1, 0.0, 0.0
    for wc, wh in zip(centers, heights):
        high = max((x for x in (wh, h) if x is not None), default=None)
        if line < 0 or None not in (wc, c, high) and abs(wc - c) > high / 2:
            line, c, h = line + 1, wc, wh
        else:
            c, h = None if None in (wc, c) else (c + wc) / 2, high
        out.append(line)
    return out


def assign_lines(words: DataFrame) -> DataFrame:
    """``words`` (file_id, n, x, y, w, h, ...) with ``line``, by a fold over vertical centres.

    A word opens a line if its centre is farther from the line's than half the larger height;
    else the line's centre moves half way to it.
    """
    ordered = F.array_sort(F.collect_list(F.struct((F.col("y") + F.col("h") / 2).cast("double").alias("c"), F.col("n").cast("long").alias("n"), F.col("h").cast("double").alias("h"))))
    files = words.groupBy("file_id").agg(ordered.alias("ws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, per = lists.flatten(), np.diff(lists.offsets.to_numpy())
            centers, heights = (flat.field(k).to_pylist() for k in ("c", "h"))
            lines, at = [], 0
            for n in per.tolist():
                lines += fold_lines(centers[at : at + n], heights[at : at + n])
                at += n
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), per)))
            yield pa.RecordBatch.from_arrays([ids, flat.field("n"), pa.array(lines, pa.int32())], names=["file_id", "n", "line"])

    lines = files.mapInArrow(run, f"file_id {dict(files.dtypes)['file_id']}, n long, line int")
    return words.join(lines, ["file_id", "n"])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and which there are; in a sort by both, nulls come first, as in a sort of rows."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _in_order(lists: pa.ListArray) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray, np.ndarray]:
    """The words of some files in reading order, field by field, with the line and file of each and where each file's begin."""
    word, owner = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    some = pc.and_(pc.not_equal(pc.utf8_trim(word.field("text"), " "), ""), word.field("n").is_valid()).fill_null(False)
    if not pc.all(some, min_count=0).as_py():
        word, owner = word.filter(some), owner[some.to_numpy(zero_copy_only=False)]
    at = np.searchsorted(owner, np.arange(len(lists) + 1))
    (n, _), (x, has_x), (y, has_y), (h, has_h) = (_numbers(word.field(k)) for k in ("n", "x", "y", "h"))
    center, centered = y + h / 2, has_y & has_h
    down = np.lexsort((h, has_h, n, np.where(centered, center, 0), centered, owner))
    none = lambda values, there: np.where(there, values, None).tolist() if not there.all() else values.tolist()
    centers, heights = none(center[down], centered[down]), none(h[down], has_h[down])
    line = np.empty(len(down), np.int32)
    line[down] = [v for a, b in zip(at.tolist(), at[1:].tolist()) for v in fold_lines(centers[a:b], heights[a:b])]
    order = np.lexsort((n, x, has_x, line, owner))
    if (order[1:] < order[:-1]).any():
        word = word.take(pa.array(order))
    return dict(zip([f.name for f in word.type], word.flatten())), line[order], owner, at


def _held(confidence: pa.Array) -> pa.Array:
    return pc.max_element_wise(pc.min_element_wise(confidence, 100.0), 0.0)


def _joined(text: pa.Array, line: np.ndarray, at: np.ndarray, lines: bool) -> pa.Array:
    """The text of each file's words, as ``file_text``."""
    mark = np.ones(len(line), np.int8)
    mark[1:] += (lines & (line[1:] != line[:-1])).astype(np.int8)
    mark[at[:-1][at[:-1] < at[1:]]] = 0
    marks = pa.DictionaryArray.from_arrays(pa.array(mark), pa.array(["", " ", "\n"])).dictionary_decode()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pc.binary_join_element_wise(marks, text, "")), "")


def _as_lists(files: DataFrame) -> DataFrame:
    """Files with a list of words each, in small batches; a null list is an empty one."""
    empty = F.array().cast(files.schema["words"].dataType)
    return small_batches(files).withColumn("words", F.coalesce("words", empty))


def lay_out(files: DataFrame, keep: tuple[str, ...] = (), fields: tuple[str, ...] = (), text: bool = False) -> DataFrame:
    """Files (file_id, words), the words of each as a list, without blank ones and in reading order; columns to ``keep`` stay.

    A word (n, text, x, y, w, h, confidence, ...) gets its ``line``, its place ``seq`` and its offsets
    ``start`` and ``end`` in the text of all words joined by single characters; confidence is held
    within 0 to 100.  Nothing is shuffled: words that stand in one row stay there.  ``fields``: those of a word
    that are wanted, if not all, as each takes its time to hand over.  ``text``: with that text, parted by blanks.
    """
    types = {f.name: f.dataType.simpleString() for f in files.schema["words"].dataType.elementType} | {"line": "int", "seq": "int", "start": "bigint", "end": "bigint"}
    wanted = [f for f in types if not fields or f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, line, owner, at = _in_order(batch.column(1))
            if "confidence" in wanted:
                found["confidence"] = _held(found["confidence"])
            length = pc.utf8_length(found["text"]).to_numpy(zero_copy_only=False)
            before = np.concatenate(([0], np.cumsum(length + 1, dtype=np.int64)))
            start = before[:-1] - before[at][owner]
            found |= {"line": pa.array(line), "seq": pa.array((np.arange(len(line)) - at[owner]).astype(np.int32)), "start": pa.array(start), "end": pa.array(start + length)}
            words = pa.StructArray.from_arrays([found[f] for f in wanted], names=wanted)
            whole = [_joined(found["text"], line, at, False)] if text else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), words), *batch.columns[2:], *whole], names=["file_id", "words", *keep, *["text"][: len(whole)]])

    more = "".join(f", {c} {dict(files.dtypes)[c]}" for c in keep) + ", text string" * text
    schema = f"file_id {dict(files.dtypes)['file_id']}, words array<struct<{','.join(f'{f}:{types[f]}' for f in wanted)}>>{more}"
    return _as_lists(files).select("file_id", "words", *keep).mapInArrow(run, schema)


def file_texts(files: DataFrame) -> DataFrame:
    """(file_id, text) of files (file_id, words) as ``lay_out`` takes them: words in reading order, lines parted by line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, line, _, at = _in_order(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _joined(found["text"], line, at, True)], names=["file_id", "text"])

    return _as_lists(files).select("file_id", "words").mapInArrow(run, f"file_id {dict(files.dtypes)['file_id']}, text string")


def file_low_confidence(files: DataFrame) -> DataFrame:
    """As ``low_confidence``, for files (file_id, words) as ``lay_out`` takes them; those without words have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, line, owner, at = _in_order(batch.column(1))
            confidence = _held(found["confidence"]).to_numpy(zero_copy_only=False)
            weak = np.concatenate(([0], np.cumsum(confidence < LOW_WORD)))
            ends = np.arange(LOW_RUN - 1, len(line))
            begins = ends - (LOW_RUN - 1)
            run_there = (weak[ends + 1] - weak[begins] == LOW_RUN) & (line[ends] == line[begins]) & (owner[ends] == owner[begins])
            low = np.zeros(len(batch), bool)
            low[owner[ends[run_there]]] = True
            some = at[:-1] < at[1:]
            low[some] |= np.add.reduceat(confidence, at[:-1][some]) / np.diff(at)[some] < LOW_MEAN if some.any() else False
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), pa.array(low[some])], names=["file_id", "low"])

    return _as_lists(files).select("file_id", "words").mapInArrow(run, f"file_id {dict(files.dtypes)['file_id']}, low boolean")


def words_of(laid: DataFrame) -> DataFrame:
    """A row a word of files as ``lay_out`` gives them."""
    return laid.select("file_id", F.explode("words").alias("word")).select("file_id", "word.*")


def ocr_result(words: DataFrame) -> DataFrame:
    """Words without blanks in reading order: ``line``, ``seq`` and confidence within 0 to 100."""
    rest = [c for c in words.columns if c not in ("file_id", "line", "seq", "start", "end")]
    files = words.groupBy("file_id").agg(F.collect_list(F.struct(*rest)).alias("words"))
    return words_of(lay_out(files)).drop("start", "end")


def file_text(words: Column, lines: bool = True) -> Column:
    """The text of laid out words, joined by blanks; lines by line feeds if ``lines``."""
    broken = lambda w, i: F.concat(F.when(i == 0, "").when(lines & (F.get(words, i - 1)["line"] != w["line"]), "\n").otherwise(" "), w["text"])
    return F.array_join(F.transform(words, broken), "")


def touched(files: DataFrame) -> DataFrame:
    """(file_id, hits) of files (file_id, words, hits), with the words that each hit (start, end, ...) overlaps as its list ``words``.

    Both ends are found by bisection in the words as ``lay_out`` orders them.  Only the words found come back.
    """
    kind, same = (files.schema[c].dataType.simpleString() for c in ("hits", "words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (words, hits), (w, h) = batch.columns[1:], [c.flatten() for c in batch.columns[1:]]
            wa, ha = (c.offsets.to_numpy() - c.offsets.to_numpy()[0] for c in (words, hits))
            starts, ends, s, e = (c.field(k).to_numpy(zero_copy_only=False) for c in (w, h) for k in ("start", "end"))
            first, stop = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
            for a, b, c, d in zip(wa, wa[1:], ha, ha[1:]):
                first[c:d] = a + np.searchsorted(ends[a:b], s[c:d], "right")
                stop[c:d] = a + np.searchsorted(starts[a:b], e[c:d], "left")
            out = pa.StructArray.from_arrays([*h.flatten(), slices(w, first, stop - first)], names=[*[f.name for f in h.type], "words"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ha.astype(np.int32)), out)], names=["file_id", "hits"])

    schema = f"file_id {dict(files.dtypes)['file_id']}, hits array<{kind[6:-2]},words:{same}>>"
    return small_batches(files).select("file_id", "words", "hits").mapInArrow(run, schema)


def slices(values: pa.Array, first: np.ndarray, count: np.ndarray) -> pa.ListArray:
    """Runs of values, each by its first place and how many there are."""
    count = np.maximum(count, 0)
    ends = np.cumsum(count)
    at = np.repeat(first - (ends - count), count) + np.arange(count.sum())
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), values.take(pa.array(at)))


def file_evidence(files: DataFrame) -> DataFrame:
    """As ``hit_evidence``, for files (file_id, words, hits) whose laid out words and hits stand in one row."""
    rows = spans.rows_of(touched(files), ["file_id"], F.col("hits"), "hit").select("file_id", "hit.*")
    out = rows.select(*[c for c in rows.columns if c != "words"], *spans.union_box(F.col("words")))
    return out.withColumn("type", F.when(F.col("x").isNull(), "text-span").otherwise("image-region"))


def file_regions(files: DataFrame) -> DataFrame:
    """As ``quote_regions``, for files (file_id, words, hits) whose laid out words and hits stand in one row."""
    rows = spans.rows_of(touched(files), ["file_id"], F.col("hits"), "hit").select("file_id", "hit.*")
    whole = rows.where((F.size("words") > 0) & (F.get("words", F.lit(0))["start"] == F.col("start")) & (F.element_at("words", -1)["end"] == F.col("end")))
    lines = whole.select("file_id", "hit", "words", F.explode(F.array_distinct(F.transform("words", lambda w: w["line"]))).alias("line"))
    lines = lines.withColumn("words", F.filter("words", lambda w: w["line"] == F.col("line")))
    return lines.select("file_id", "hit", "line", *spans.union_box(F.col("words")), F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("quote"))


def low_confidence(words: DataFrame) -> DataFrame:
    """(file_id, low): a low mean, or a run of weak words on a line.  Needs line, x, seq, confidence."""
    w = Window.partitionBy("file_id", "line").orderBy("seq")
    weak = words.withColumn("weak", (F.col("confidence") < LOW_WORD).cast("int"))
    runs = weak.withColumn("g", F.row_number().over(w) - F.sum("weak").over(w))
    per_run = runs.groupBy("file_id", "line", "g").agg(F.sum("weak").alias("n"), F.sum("confidence").alias("c"), F.count("*").alias("k"))
    return per_run.groupBy("file_id").agg(((F.sum("c") / F.sum("k") < LOW_MEAN) | (F.max("n") >= LOW_RUN)).alias("low"))


def word_offsets(words: DataFrame) -> DataFrame:
    """``words`` (file_id, line, seq, text) with start and end in the file's OCR text."""
    before = Window.partitionBy("file_id").orderBy("line", "seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    return words.withColumn("start", start).withColumn("end", start + F.length("text"))


def ocr_text(words: DataFrame) -> DataFrame:
    """(file_id, text): words joined by blanks, lines by line feeds."""
    lines = words.groupBy("file_id", "line").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("ws"))
    lines = lines.select("file_id", "line", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("t"))
    return lines.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line", "t"))).alias("ls")).select("file_id", F.array_join(F.transform("ls", lambda x: x["t"]), "\n").alias("text"))


#: Offsets to a bucket, for joins of spans that overlap.
BUCKET = 64


def overlapping(hits: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs of a hit (file_id, start, end, ...) and a word (file_id, ws, we, ...) whose offsets overlap, each once.

    Both are dealt by the buckets of offsets that they touch, so a word meets the hits near it and no
    others.  A pair counts in the bucket where the later of both begins.
    """
    touched = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / BUCKET)))
    h, w = hits.withColumn("bucket", touched("start", "end")), words.withColumn("bucket", touched("ws", "we"))
    meet = (F.col("ws") < F.col("end")) & (F.col("we") > F.col("start"))
    return h.join(w, ["file_id", "bucket"]).where(meet & (F.col("bucket") == F.floor(F.greatest("start", "ws") / BUCKET))).drop("bucket")


def hit_evidence(hits: DataFrame, words: DataFrame) -> DataFrame:
    """Hits (file_id, hit, start, end, quote) as regions: the union box of the words they overlap, else as text spans.

    ``words`` come with offsets.
    """
    w = words.select("file_id", F.col("start").alias("ws"), F.col("end").alias("we"), "x", "y", "w", "h")
    own = ["file_id", "hit", "start", "end", "quote"]
    box = ["x", "y", "w", "h"]
    met = overlapping(hits.select(*own), w).select(*own, *box)
    both = met.unionByName(hits.select(*own, *[F.lit(None).cast(dict(met.dtypes)[c]).alias(c) for c in box]))
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    out = both.groupBy(*own).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (bottom - F.min("y")).alias("h"))
    return out.withColumn("type", F.when(F.col("x").isNull(), "text-span").otherwise("image-region"))


def quote_regions(hits: DataFrame, words: DataFrame) -> DataFrame:
    """Boxes of quotes in OCR text, one a line; a quote must begin and end with whole words."""
    w = words.select("file_id", "line", "seq", F.col("start").alias("ws"), F.col("end").alias("we"), "x", "y", "w", "h", F.col("text").alias("word"))
    both = overlapping(hits, w)
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    words_in = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda x: x["word"]), " ")
    lines = both.groupBy("file_id", "hit", "start", "end", "line").agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (bottom - F.min("y")).alias("h"), words_in.alias("quote"), F.min("ws").alias("ws"), F.max("we").alias("we"))
    of_hit = Window.partitionBy("file_id", "hit")
    whole = (F.min("ws").over(of_hit) == F.col("start")) & (F.max("we").over(of_hit) == F.col("end"))
    return lines.withColumn("whole", whole).where("whole").select("file_id", "hit", "line", "x", "y", "w", "h", "quote")


def _cells(boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boxes by each cell of their file's grid that they touch."""
    side = lambda at, length, unit: F.explode(F.sequence(F.floor(F.col(at) / F.col(unit)), F.floor((F.col(at) + F.col(length)) / F.col(unit))))
    gridded = boxes.join(sizes, "file_id").withColumn("column", side("x", "w", "wide"))
    return gridded.withColumn("row", side("y", "h", "high")).drop("wide", "high")


def new_words(ocr: DataFrame, layer: DataFrame) -> DataFrame:
    """OCR words that are not already in a document's text layer: less than a share of their box lies on one of its words.

    Boxes meet by the cells of a grid as coarse as a file's words, so a word meets those near it.
    """
    box = ["x", "y", "w", "h"]
    sizes = ocr.groupBy("file_id").agg(*[F.coalesce(F.nullif(2 * F.avg(c), F.lit(0.0)), F.lit(1.0)).alias(k) for c, k in (("w", "wide"), ("h", "high"))])
    a = _cells(ocr.select("file_id", *box), sizes)
    b = _cells(layer.select("file_id", *box), sizes).select("file_id", "column", "row", *[F.col(c).alias(f"l{c}") for c in box])
    wide = F.least(F.col("x") + F.col("w"), F.col("lx") + F.col("lw")) - F.greatest("x", "lx")
    high = F.least(F.col("y") + F.col("h"), F.col("ly") + F.col("lh")) - F.greatest("y", "ly")
    covered = a.join(b, ["file_id", "column", "row"]).where((wide > 0) & (high > 0) & (wide * high / (F.col("w") * F.col("h")) > OVERLAP_SHARE)).select("file_id", *box).distinct()
    return ocr.join(covered, ["file_id", *box], "left_anti")


#: Words and boxes compared at once.
BLOCK = 256


def covered(boxes: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """Which of some boxes lie with more than OVERLAP_SHARE of their area on a box of the layer; both as rows of x, y, w, h.

    Both are taken down the page, so a block of boxes meets those of the layer beside it.
    """
    out = np.zeros(len(boxes), bool)
    boxed = np.flatnonzero(~np.isnan(boxes).any(axis=1))
    boxed = boxed[np.argsort(boxes[boxed, 1], kind="stable")]
    layer = layer[~np.isnan(layer).any(axis=1)]
    layer = layer[np.argsort(layer[:, 1], kind="stable")]
    tall = layer[:, 3].max(initial=0.0)
    for at in range(0, len(boxed), BLOCK):
        some = boxed[at : at + BLOCK]
        x, y, w, h = boxes[some].T[:, :, None]
        first = np.searchsorted(layer[:, 1], y[0, 0] - tall, "left")
        stop = np.searchsorted(layer[:, 1], (y + h).max(), "right")
        for k in range(first, stop, BLOCK):
            lx, ly, lw, lh = layer[k : min(k + BLOCK, stop)].T[:, None, :]
            wide, high = np.minimum(x + w, lx + lw) - np.maximum(x, lx), np.minimum(y + h, ly + lh) - np.maximum(y, ly)
            meet = (wide > 0) & (high > 0)
            share = np.divide(wide * high, w * h, out=np.zeros(meet.shape), where=meet)
            out[some] |= (share > OVERLAP_SHARE).any(axis=1)
    return out


def new_file_words(files: DataFrame) -> DataFrame:
    """As ``new_words``, for files (file_id, words, layer) whose words and boxes of the text layer stand in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.columns[1:]
            flat = [c.flatten() for c in lists]
            (wa, la), (w, layer) = ([c.offsets.to_numpy() - c.offsets.to_numpy()[0] for c in lists], [np.column_stack([f.field(k).to_numpy(zero_copy_only=False).astype(float) for k in "xywh"]) for f in flat])
            new = np.ones(len(w), bool)
            for a, b, c, d in zip(wa, wa[1:], la, la[1:]):
                new[a:b] = ~covered(w[a:b], layer[c:d])
            at = np.concatenate(([0], np.cumsum(new)))[wa].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), flat[0].filter(pa.array(new)))], names=["file_id", "words"])

    kinds = dict(files.dtypes)
    return small_batches(files).select("file_id", "words", "layer").mapInArrow(run, f"file_id {kinds['file_id']}, words {kinds['words']}")


def append_ocr(models: DataFrame, words: DataFrame) -> DataFrame:
    """Document texts (file_id, text) with the OCR text of new words (file_id, line, seq, text) as a section of their own."""
    return models.join(ocr_text(words).withColumnRenamed("text", "__ocr"), "file_id", "left").withColumn("text", F.when(F.col("__ocr").isNull(), F.col("text")).when(F.col("text") == "", F.col("__ocr")).otherwise(F.concat("text", F.lit("\n\n"), "__ocr"))).drop("__ocr")


def iou(a: Column, b: Column) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    high = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    return wide * high / (a["w"] * a["h"] + b["w"] * b["h"] - wide * high)
