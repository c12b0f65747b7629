"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each named source should make up its weight of the output's bytes; all other sources (and
null) share what is left in proportion to their size.  A source's mean repetition rate is
``weight * total / size``.  Every row draws its number of copies by inverting the Poisson
distribution of that mean at a uniform number hashed from seed and doc_id, is exploded by
it, and all copies are dealt over the cluster by a hash of seed, doc_id and copy (and, so that rows
of one id spread, of their place).

The table of rates has one row per named source and one for the rest, however large the
input, so it is broadcast; the text crosses the network once.  Rates above ``MAX_MEAN`` are
drawn as a sum of independent Poisson numbers of smaller mean, so no rate is cut off.

Defined cases: a row with a null doc_id draws by its text; rows that repeat a doc_id draw the
same number; null text has no bytes but is drawn like its source; sources without bytes keep
rate 1; an empty table gives an empty result; extra columns are kept, and one named like an
added column (copy, n_copies, shuffle_key) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20_25
WEIGHTS = {"src0": 0.10, "src1": 0.15, "src2": 0.15}
MAX_MEAN = 16.0
#: P(X > TERMS) is below 2**-52 for every mean up to MAX_MEAN.
TERMS = 80
#: Rows of one id are dealt to so many places.
SPREAD = 1 << 16


def _hash_long(*parts: Column) -> Column:
    """52 bits of an md5, the same in any engine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _name() -> Column:
    """What a row draws by."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def rates(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row per bucket: pieces (how many numbers are summed) and the CDF of one piece."""
    sizes = docs.groupBy(_bucket(weights).alias("bucket")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))
    whole = F.sum("bytes").over(Window.partitionBy(F.lit(1)))  # over one row a bucket
    share = F.create_map(*[x for k, v in [*weights.items(), ("", 1 - sum(weights.values()))] for x in (F.lit(k), F.lit(float(v)))])
    r = sizes.withColumn("total", whole).withColumn("rate", F.when(F.col("bytes") > 0, share[F.col("bucket")] * F.col("total") / F.col("bytes")).otherwise(F.lit(1.0)))
    r = r.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int")).withColumn("mean", F.col("rate") / F.col("pieces"))
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    step = lambda a, k: F.struct((a.p * F.col("mean") / k).alias("p"), F.concat(a.cdf, F.array(F.element_at(a.cdf, -1) + a.p * F.col("mean") / k)).alias("cdf"))
    return r.select("bucket", "pieces", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a.cdf).alias("cdf"))


def _bucket(weights: dict[str, float]) -> Column:
    return F.when(F.col("source").isin(*weights), F.col("source")).otherwise(F.lit(""))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` replicated to the weights and dealt globally; adds copy, n_copies, shuffle_key."""
    weights = WEIGHTS if weights is None else weights
    if not all(0 <= v <= 1 for v in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights lie in 0..1 and add up to 1 at most")
    docs = docs.drop("copy", "n_copies", "shuffle_key")
    keep = docs.columns
    table = rates(docs, weights).select(F.col("bucket").alias("__bucket"), F.col("pieces").alias("__pieces"), F.col("cdf").alias("__cdf"))
    drawn = docs.withColumn("__bucket", _bucket(weights)).withColumn("__name", _name()).join(F.broadcast(table), "__bucket")
    one = lambda i: F.size(F.filter("__cdf", lambda c: c < (_hash_long(F.lit(seed), F.lit("n"), F.col("__name"), i) + 0.5) / float(1 << 52)))
    n = F.aggregate(F.sequence(F.lit(1), F.col("__pieces")), F.lit(0), lambda acc, i: acc + one(i))
    drawn = drawn.withColumn("n_copies", n.cast("long")).where("n_copies > 0")
    copies = drawn.select(*keep, "__name", "n_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", _hash_long(F.lit(seed), F.lit("order"), F.col("__name"), F.col("copy"))).drop("__name")
    return keyed.repartition("shuffle_key", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).sortWithinPartitions("shuffle_key")
