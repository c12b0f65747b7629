"""The thin queries opN_<name>: each applies its operator to a whole table, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, embeddings, jaccard, language, licenses, lloyd, matroska, mixing, packing, sharding, suffixes, tokenfile, urls


VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(_docs(spark, sf_dir))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(_docs(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_docs(spark, sf_dir))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_docs(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_docs(spark, sf_dir), public_tokenizers.path(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(_docs(spark, sf_dir))


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digest(_docs(spark, sf_dir))


def op8_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_docs(spark, sf_dir), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_docs(spark, sf_dir), public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_VOCABULARY))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_docs(spark, sf_dir), public_tokenizers.path(BYTE_VOCABULARY))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def _mix_sql() -> str:
    w = mixing.WEIGHTS
    rest = 1 - sum(w.values())
    name = "coalesce(CAST(doc_id AS VARCHAR), '~' || md5(coalesce(text, '')))"
    names = ", ".join(f"'{k}'" for k in w)
    share = " ".join(f"WHEN '{k}' THEN CAST({v!r} AS DOUBLE)" for k, v in w.items())
    h = lambda tag, *x: f"CAST('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', '{tag}', {', '.join(x)})), 1, 13) AS BIGINT)"
    return f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN source IN ({names}) THEN source ELSE '' END AS bucket FROM documents),
s AS (SELECT bucket, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM d GROUP BY bucket),
r AS (SELECT bucket, CASE WHEN bytes > 0 THEN (CASE bucket {share} ELSE CAST({rest!r} AS DOUBLE) END) * (SELECT CAST(sum(bytes) AS BIGINT) FROM s) / bytes ELSE 1.0 END AS rate FROM s),
m AS (SELECT bucket, greatest(1, CAST(ceil(rate / {mixing.MAX_MEAN}) AS INT)) AS pieces, rate / greatest(1, CAST(ceil(rate / {mixing.MAX_MEAN}) AS INT)) AS mean FROM r),
c AS (SELECT bucket, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf, mean FROM m
      UNION ALL SELECT bucket, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1), mean FROM c WHERE k < {mixing.TERMS}),
t AS (SELECT bucket, list(cdf ORDER BY k) AS cdf FROM c GROUP BY bucket),
n AS (SELECT d.*, CAST(list_sum(list_transform(range(1, m.pieces + 1), lambda i: len(list_filter(t.cdf, lambda x: x < ({h("n", name, "CAST(i AS VARCHAR)")} + 0.5) / 4503599627370496)))) AS BIGINT) AS n_copies
      FROM d JOIN m USING (bucket) JOIN t USING (bucket)),
e AS (SELECT doc_id, text, lang, source, n_chars, n_copies, unnest(range(0, n_copies)) AS copy FROM n WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy, {h("order", name, "CAST(copy AS VARCHAR)")} AS shuffle_key FROM e"""


def _url_sql() -> str:
    fits = ", ".join(f"CASE WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN {{'v': '{v}', 'r': '{r}'}} END" for v, r in sorted(urls.HOST_RULES, key=lambda x: -len(x[1])))
    hits = ", ".join(f"CASE WHEN rule IS NULL AND regexp_matches(lower(url), '{r.pattern}') THEN '{r.name}' END" for r in urls.PATTERN_RULES)
    return f"""
WITH a AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, regexp_extract(rest, '^[^?#]*') AS cut FROM a),
c AS (SELECT page_id, url, translate(regexp_extract(cut, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(cut, length(regexp_extract(cut, '^[^/]*')) + 1) AS path FROM b),
f AS (SELECT *, coalesce({fits}) AS fit FROM c),
g AS (SELECT *, fit.r AS rule FROM f),
p AS (SELECT *, list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))) AS names FROM g)
SELECT page_id, host, path, rule, coalesce(fit.v, CASE WHEN len(names) > 0 THEN 'block' ELSE 'allow' END) AS verdict, array_to_string(names, ',') AS patterns FROM p"""


def _lloyd_sql() -> str:
    d, k = lloyd.DIMENSIONS, lloyd.CLUSTERS
    square = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    # Whole numbers divided down: what is left over is taken off first.
    down = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    steps = []
    for i in range(lloyd.ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT v.row, v.vec_id, min({{'d': {square}, 'k': c.k}}) AS best FROM v, c{i} c GROUP BY v.row, v.vec_id)")
        if i < lloyd.ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(u.e, c.e) AS e FROM c{i} c LEFT JOIN (
      SELECT k, list({down} ORDER BY i) AS e FROM (SELECT a.best.k AS k, t.i, sum(v.e[t.i]) AS s, count(*) AS n FROM a{i} a JOIN v USING (row), range(1, {d + 1}) t(i) GROUP BY 1, 2) GROUP BY k) u USING (k))""")
    last = lloyd.ROUNDS
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({lloyd.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {d}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, e FROM (SELECT sha256('{lloyd.SEED}:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v ORDER BY h LIMIT {k})),
{", ".join(steps)},
n AS (SELECT k, sha256(array_to_string(e, ',')) AS centroid_sha256 FROM c{last})
SELECT vec_id, CAST(best.k AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{last} JOIN n ON n.k = best.k"""


def oracle_sql() -> dict[str, str]:
    return {"op2_poisson_mix": _mix_sql(), "op10_url_filter": _url_sql(), "op11_lloyd": _lloyd_sql()}
