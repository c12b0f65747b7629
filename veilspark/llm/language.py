"""Language ID with a linear-chain conditional random field over words.

Every word has hashed features: prefixes and suffixes of 1 to 3 bytes, byte trigrams with word
ends, and the word itself (lexicon).  Training learns feature weights and label transitions by
gradient steps on the CRF likelihood of code-switched sequences, spliced from pieces of the
sampled texts; forward-backward then gives each word of a text its label posteriors.  A text's
language is the label of the greatest mean posterior, its score that mean.

Training reads a sample bounded by ``SAMPLE_PER_LANGUAGE`` texts a language (expected; the
driver takes ``2 * SAMPLE_PER_LANGUAGE`` a language at most), chosen by a hash, and is the only
step on the driver.  Prediction covers every word of every text in one map without a shuffle:
emissions are computed once per distinct word of a block, and forward-backward runs over all
word segments of a block at once, joined by their transfer matrices.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text
if nothing was learned; repeated rows each get a row; ties go to the alphabetically first
language; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spill import small_batches
from .text import ASCII_LOWER, U, blocks, mix, prefix_hash, span_hash, take_over, text_bytes, word_spans

SAMPLE_PER_LANGUAGE = 120
FEATURES = 1 << 17
ROUNDS = 40
RATE = 0.5
SEGMENT = 64
#: Lengths in words of the pieces that training splices into one sequence.
PIECE_WORDS = (3, 24)
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _spans_hash(p: np.ndarray, a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(span_hash(p, a, b) + U(salt)) & U(FEATURES - 1)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words in a row, and where each word's begin."""
    n = ends - starts
    # Words laid out as <word>, so that trigrams see the word ends.
    padded = n + 2
    at = np.concatenate(([0], np.cumsum(padded)))
    flat = np.full(at[-1], 2, np.uint8)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    take = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    flat[inner] = data[take]
    p = prefix_hash(flat)
    s, e = at[:-1], at[1:]
    cols = [_spans_hash(p, s, e, 1)]
    for k in (1, 2, 3):
        cols += [_spans_hash(p, s + 1, np.minimum(s + 1 + k, e - 1), 10 + k), _spans_hash(p, np.maximum(e - 1 - k, s + 1), e - 1, 20 + k)]
    grams = np.arange(len(flat) - 2)
    owner = np.repeat(np.arange(len(n)), padded)
    grams = grams[owner[grams] == owner[grams + 2]]
    tri = _spans_hash(p, grams, grams + 3, 30)
    ids = np.concatenate([*cols, tri]).astype(np.int64)
    word = np.concatenate([np.tile(np.arange(len(n)), len(cols)), owner[grams]])
    order = np.argsort(word, kind="stable")
    return ids[order], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(n)))))


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct words of a block (start, end), the distinct word and row of each word."""
    low = ASCII_LOWER[data]
    starts, ends, rows = word_spans(low, offsets)
    _, sample, inverse = np.unique(span_hash(prefix_hash(low), starts, ends), return_index=True, return_inverse=True)
    return low, starts[sample], ends[sample], inverse, rows


def scores(weights: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's features, a column a label, scaled by their number."""
    if len(at) < 2:
        return np.zeros((0, weights.shape[1]), np.float32)
    return (np.add.reduceat(weights[ids], at[:-1], axis=0) / np.sqrt(np.diff(at))[:, None]).astype(np.float32)


def posteriors(emit: np.ndarray, trans: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label posteriors of every word by forward-backward, and expected transitions summed.

    ``emit`` are positive factors a word and label, ``trans`` positive factors from row to
    column, ``at`` where each sequence begins (one more than sequences; none is empty).
    """
    labels = trans.shape[0]
    trans = trans.astype(np.float32)
    length = np.diff(at)
    per = -(-length // SEGMENT)  # segments of each sequence
    seg_seq = np.repeat(np.arange(len(length)), per)
    seg_rank = np.arange(len(seg_seq)) - np.repeat(np.cumsum(per) - per, per)
    seg_start = at[:-1][seg_seq] + seg_rank * SEGMENT
    seg_len = np.minimum(SEGMENT, at[1:][seg_seq] - seg_start)
    order = np.argsort(-seg_len, kind="stable")
    start, count = seg_start[order], seg_len[order]
    active = [int(np.searchsorted(-count, -t, "left")) for t in range(SEGMENT)]  # segments longer than t
    # Transfer matrix of each segment.
    m = np.tile(np.eye(labels, dtype=np.float32), (len(order), 1, 1))
    for t in range(SEGMENT):
        k = active[t]
        if not k:
            break
        m[:k] = (m[:k].reshape(-1, labels) @ trans).reshape(k, labels, labels) * emit[start[:k] + t][:, None, :]
        if t % 4 == 3:
            m[:k] /= m[:k].max(axis=(1, 2), keepdims=True)
    m /= m.max(axis=(1, 2), keepdims=True)
    matrix = np.empty_like(m)
    matrix[order] = m
    # What reaches each segment from both sides, segment by segment of all sequences together.
    left = np.full((len(order), labels), 1 / labels, np.float32)
    right = np.ones((len(order), labels), np.float32)
    first_seg = np.cumsum(per) - per
    by_count = np.argsort(-per, kind="stable")
    for r in range(1, int(per.max()) if len(per) else 0):
        s = first_seg[by_count[: int(np.searchsorted(-per[by_count], -r, "left"))]] + r
        v = np.einsum("ij,ijk->ik", left[s - 1], matrix[s - 1])
        left[s] = v / v.sum(axis=1, keepdims=True)
    for r in range(int(per.max()) - 2 if len(per) else -1, -1, -1):
        s = first_seg[by_count[: int(np.searchsorted(-per[by_count], -(r + 1), "left"))]] + r
        v = np.einsum("ijk,ik->ij", matrix[s + 1], right[s + 1])
        right[s] = v / v.sum(axis=1, keepdims=True)
    ahead = np.empty((len(emit), labels), np.float32)
    a = left[order]
    for t in range(SEGMENT):
        k = active[t]
        if not k:
            break
        v = (a[:k] @ trans) * emit[start[:k] + t]
        v /= v.sum(axis=1, keepdims=True)
        a[:k] = ahead[start[:k] + t] = v
    post = np.empty((len(emit), labels), np.float32)
    moved = np.zeros((labels, labels))
    b, before = right[order], left[order]
    for t in range(SEGMENT - 1, -1, -1):
        k = active[t]
        if not k:
            continue
        i = start[:k] + t
        v = ahead[i] * b[:k]
        post[i] = v / v.sum(axis=1, keepdims=True)
        prev = ahead[i - 1] if t else before[:k]
        back = emit[i] * b[:k]
        pair = prev[:, :, None] * trans * back[:, None, :]
        total = pair.sum(axis=(1, 2), keepdims=True)
        real = np.ones(k) if t else (seg_rank[order][:k] > 0).astype(float)  # the first word has no transition
        moved += (pair / total * real[:, None, None]).sum(axis=0)
        back = back @ trans.T
        b[:k] = back / back.sum(axis=1, keepdims=True)
    return post, moved


def word_posteriors(emit: np.ndarray, trans: np.ndarray, at: np.ndarray) -> np.ndarray:
    return posteriors(emit, trans, at)[0]


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray  # logarithms

    def emissions(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        s = scores(self.weights, ids, at)
        return np.exp(s - s.max(axis=1, keepdims=True, initial=-1e30)) + np.float32(1e-6)


def fit(texts: list[str], langs: list[str], seed: int = 1) -> Model | None:
    """Gradient steps (Adagrad) on the CRF likelihood of sequences spliced across languages."""
    labels = sorted(set(langs))
    if not labels:
        return None
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    low, ws, we, word, rows = distinct_words(data, offsets)
    if not len(word):
        return None
    ids, at = word_features(low, ws, we)
    row_label = np.array([labels.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    # Cut the words of every text into pieces, then string pieces together at random.
    begin = np.searchsorted(rows, np.arange(len(texts) + 1))
    pieces = []
    for r in range(len(texts)):
        i = int(begin[r])
        while i < begin[r + 1]:
            j = min(int(begin[r + 1]), i + int(rng.integers(*PIECE_WORDS)))
            pieces.append((i, j))
            i = j
    seq = np.concatenate([np.arange(*pieces[i]) for i in rng.permutation(len(pieces))])
    word, gold = word[seq], row_label[rows[seq]]
    bounds = np.append(np.arange(0, len(seq), 4 * SEGMENT), len(seq))
    inner = np.ones(len(seq), bool)
    inner[bounds[:-1]] = False
    k = len(labels)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    weights, trans = np.zeros((FEATURES, k), np.float32), np.zeros((k, k))
    w_sum, t_sum = np.full((FEATURES, k), 1e-6, np.float32), np.full((k, k), 1e-6)
    rare = np.zeros(k)
    np.add.at(rare, gold, 1)
    scale = 1 / np.sqrt(np.diff(at))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for _ in range(ROUNDS):
        m = Model(labels, weights, trans)
        post, moved = posteriors(m.emissions(ids, at)[word], np.exp(trans), bounds)
        diff = -post
        diff[np.arange(len(gold)), gold] += 1
        by_word = np.stack([np.bincount(word, diff[:, c], len(at) - 1) for c in range(k)], 1) * scale[:, None]
        grad = np.stack([np.bincount(ids, by_word[owner, c], FEATURES) for c in range(k)], 1).astype(np.float32) - 0.02 * weights
        w_sum += grad * grad
        weights = weights + RATE * grad / np.sqrt(w_sum)
        step = gold_pairs - moved - 0.02 * trans
        t_sum += step * step
        trans = trans + RATE * step / np.sqrt(t_sum)
    return Model(labels, weights, trans)


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """A model of the rows of ``docs`` that are labelled and not held out."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    dice = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(dice < share[F.col("lang")]).select("doc_id", "text", "lang").limit(2 * per_language * len(counts)).collect()
    sample.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text))
    return fit([r.text for r in sample], [r.lang for r in sample])


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("n_switches", pa.int64())])


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words and n_switches (label changes between words) of every row.

    ``keep`` names further columns of ``docs`` to carry along.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # of fixed size: FEATURES rows
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"), F.col("text").cast("string").alias("__text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("language")
        model = sent.value
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = text_bytes(batch.column(3))
            for a, b in blocks(offsets):
                n = b - a
                pred, score, words, switches = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
                low, ws, we, word, rows = distinct_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if model is not None and len(word):
                    emit = model.emissions(*word_features(low, ws, we))[word]
                    words = np.bincount(rows, minlength=n)
                    some = np.flatnonzero(words)
                    at = np.concatenate(([0], np.cumsum(words[some])))
                    post = word_posteriors(emit, np.exp(model.transitions), at)
                    mean = np.add.reduceat(post, at[:-1], axis=0) / words[some][:, None]
                    pred[some], score[some] = mean.argmax(axis=1), np.minimum(mean.max(axis=1), 1.0)
                    best = post.argmax(axis=1)
                    changed = np.concatenate((best[1:] != best[:-1], [False]))
                    changed[at[1:] - 1] = False
                    switches[some] = np.add.reduceat(changed.astype(np.int64), at[:-1])
                pred[~letters[a:b]] = -1
                score[pred < 0] = 0
                names = [*(model.labels if model else ()), UNKNOWN]
                out = [batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array([names[i] for i in pred], pa.string()), pa.array(score), pa.array(words, pa.int64()), pa.array(switches, pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *[batch.column(4 + i).slice(a, n) for i in range(len(keep))]], names=[*SCHEMA.names, *keep])

    more = "".join(f", `{c}` {t}" for c, t in source.select(*keep).dtypes) if keep else ""
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long" + more)


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))


def label_runs(docs: DataFrame, model: Model) -> DataFrame:
    """Code-switching: doc_id, start_word, n_words and lang of every run of equally labelled words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets):
                low, ws, we, word, rows = distinct_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(word):
                    continue
                words = np.bincount(rows, minlength=b - a)
                at = np.concatenate(([0], np.cumsum(words[words > 0])))
                best = word_posteriors(model.emissions(*word_features(low, ws, we))[word], np.exp(model.transitions), at).argmax(axis=1)
                new = np.concatenate(([True], (best[1:] != best[:-1]) | (rows[1:] != rows[:-1])))
                s = np.flatnonzero(new)
                first = np.searchsorted(rows, rows[s])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[s] + a)), pa.array(s - first, pa.int64()), pa.array(np.diff(np.append(s, len(best))), pa.int64()), pa.array([model.labels[i] for i in best[s]], pa.string())], names=["doc_id", "start_word", "n_words", "lang"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start_word long, n_words long, lang string")
