"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed; those whose hash occurs in a template are
joined in Spark with the template positions (hash and words must both agree), and each match
votes for the diagonal ``word position - template position``.  Votes are added per
(row, template, diagonal), neighbouring diagonals are merged where a template is matched
loosely, and a span counts once its merged votes verify: every k-gram of a phrase on one
diagonal, or at least ``MIN_COVERAGE`` of the k-grams of a longer template.

The templates are a fixed parameter, so their positions are broadcast, and the hash filter
in front of the join is the join's own key set.  Text crosses no network: only votes and one
row per document do.

Words are runs of digits, a-z and non-ASCII characters after lower-casing A-Z.  Defined cases:
null text is empty (no words, no labels, score 0); every input row gives one output row, so
repeated rows repeat; phrases may overlap and each place counts; an empty table gives an empty
result; only doc_id and text are read, so extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spill import small_batches
from .text import ASCII_LOWER, U, blocks, prefix_hash, shingles, span_hash, text_bytes, word_spans


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False
    #: Phrases need all their words in one place; other templates may be matched in part.
    phrase: bool = False


#: The base phrases with their labels, then notices of common licenses.
TEMPLATES = (
    Template("gpl", "gnu general public license", True, True),
    Template("apache", "apache license", True, True),
    Template("cc-by", "cc by", True, True),
    Template("mit", "mit license", True, True),
    Template("all-rights-reserved", "all rights reserved", False, True),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
PHRASE_K = 2
TEXT_K = 4
MAX_SHIFT = 3
MIN_COVERAGE = 0.6

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _grams(templates: tuple[Template, ...]) -> list[tuple[int, int, str]]:
    """(template, position, words of the k-gram)."""
    out = []
    for i, t in enumerate(templates):
        words = WORD.findall(t.text)
        k = PHRASE_K if t.phrase else TEXT_K
        if len(words) < k:
            raise ValueError(f"template of fewer than {k} words: {t.text}")
        out += [(i, p, " ".join(words[p : p + k])) for p in range(len(words) - k + 1)]
    return out


def gram_hash(gram: str) -> int:
    data = np.frombuffer(gram.encode(), np.uint8)
    starts, ends, rows = word_spans(data, np.array([0, len(data)]))
    h, _ = shingles(span_hash(prefix_hash(data), starts, ends), rows, len(starts))
    return int(h[0].astype(np.int64))


def scan_grams(docs: DataFrame, hashes: list[int]) -> DataFrame:
    """(uid, doc_id, n_words, pos, hash, gram): a row per k-gram whose hash is asked for, and one per text with pos null."""
    wanted = np.sort(np.array(hashes, np.int64).view(U))
    gate = np.zeros(1 << 16, bool)
    gate[(wanted & U(0xFFFF)).astype(np.int64)] = True
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("pos", pa.int64()), ("hash", pa.int64()), ("gram", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, ids = batch.column(0), batch.column(1)
            data, offsets = text_bytes(batch.column(2))
            for a, b in blocks(offsets):
                low, at = ASCII_LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
                starts, ends, rows = word_spans(low, at)
                words = span_hash(prefix_hash(low), starts, ends)
                counts = np.bincount(rows, minlength=b - a)
                base = np.concatenate(([0], np.cumsum(counts)))
                found = [(np.arange(b - a), np.full(b - a, -1), np.zeros(b - a, U), [None] * (b - a))]
                for k in (PHRASE_K, TEXT_K):
                    h, first = shingles(words, rows, k)
                    hit = np.flatnonzero(gate[(h & U(0xFFFF)).astype(np.int64)])
                    hit = hit[np.isin(h[hit], wanted)]
                    f = first[hit]
                    grams = [b" ".join(low[starts[j] : ends[j]].tobytes() for j in range(i, i + k)).decode("utf-8", "replace") for i in f]
                    found.append((rows[f], f - base[rows[f]], h[hit], grams))
                row = np.concatenate([x[0] for x in found])
                pos = np.concatenate([x[1] for x in found])
                take = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [uid.take(take), ids.take(take), pa.array(counts[row], pa.int64()), pa.array(pos, pa.int64(), mask=pos < 0), pa.array(np.concatenate([x[2] for x in found]).view(np.int64)), pa.array([g for x in found for g in x[3]], pa.string())],
                    schema=schema,
                )

    source = small_batches(docs).select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "uid long, doc_id long, n_words long, pos long, hash long, gram string")


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Verified spans: uid, doc_id, n_words, template (null in the one row a text without any has), start_word, end_word, coverage."""
    spark = docs.sparkSession
    grams = _grams(templates)
    key = {g: gram_hash(g) for _, _, g in grams}
    size = {i: sum(1 for x in grams if x[0] == i) for i in range(len(templates))}
    table = spark.createDataFrame([(key[g], g, i, p, size[i], templates[i].phrase, PHRASE_K if templates[i].phrase else TEXT_K) for i, p, g in grams], "t_hash long, t_gram string, template int, t_pos int, t_size int, phrase boolean, k int")
    votes = scan_grams(docs, sorted(set(key.values()))).join(F.broadcast(table), (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left")
    votes = votes.withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    lines = votes.groupBy("uid", "doc_id", "n_words", "template", "diagonal", "t_size", "phrase", "k").agg(F.collect_set("t_pos").alias("seen"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    order = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.col("phrase") | F.lag("diagonal").over(order).isNull() | (F.col("diagonal") - F.lag("diagonal").over(order) > MAX_SHIFT)
    lines = lines.withColumn("band", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    bands = lines.groupBy("uid", "doc_id", "n_words", "template", "band", "t_size", "phrase", "k").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("low").alias("start_word"), (F.max("high") + F.first("k")).alias("end_word"))
    bands = bands.withColumn("coverage", F.size("seen") / F.col("t_size"))
    enough = F.when(F.col("phrase"), F.col("coverage") >= 1).otherwise(F.col("coverage") >= MIN_COVERAGE)
    return bands.withColumn("template", F.when(enough, F.col("template"))).select("uid", "doc_id", "n_words", "template", "start_word", "end_word", "coverage")


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """A row per text: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.col("template").isin(*[i for i, t in enumerate(templates) if t.base])
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans(docs, templates)
        .groupBy("uid", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start_word"))).alias("first_word"),
            F.max(F.when(base, F.col("start_word"))).alias("last_word"),
            joined(F.when(base, label)).alias("base_labels"),
            joined(F.when(F.col("template").isNotNull(), label)).alias("labels"),
            F.coalesce(F.max(F.when(F.col("template").isNotNull(), F.col("coverage"))), F.lit(0.0)).alias("score"),
        )
        .drop("uid")
    )
