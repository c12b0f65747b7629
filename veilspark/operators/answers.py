"""Answers of a model kept by what was asked, so that equal requests are asked once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: how many answers are kept.
MOST_ANSWERS = 128


def key_of(content: Column, model: Column, prompt_version: str, settings: Column) -> Column:
    """What makes two requests equal: content, model, version of the prompts, and settings with messages."""
    part = lambda c: F.sha2(F.coalesce(c.cast("binary"), F.lit("").cast("binary")), 256)
    return F.sha2(F.concat(part(content), part(model), part(F.lit(prompt_version)), part(settings)), 256)


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, content, model, first): what has to be asked, once a key, with the first ordinal that asks it.

    ``requests``: key, ordinal, content, model; ``cache``: key, answer, added.  Requests without content
    are always asked.
    """
    each = requests.groupBy("key").agg(F.min_by(F.struct("content", "model"), "ordinal").alias("r"), F.min("ordinal").alias("first"))
    return each.join(cache.select("key"), "key", "left_anti").select("key", "r.content", "r.model", "first")


def answered(requests: DataFrame, cache: DataFrame, new: DataFrame) -> DataFrame:
    """Each request with its answer and whether it was reused; ``new``: (key, answer) of the misses."""
    known = cache.select("key", "answer", F.lit(True).alias("reused")).unionByName(new.select("key", "answer", F.lit(False).alias("reused")))
    return requests.join(known, "key", "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def stored(cache: DataFrame, asked: DataFrame, new: DataFrame, most: int = MOST_ANSWERS) -> DataFrame:
    """The cache with the new answers added after the old ones; the oldest beyond ``most`` go.

    Null answers, and answers to requests without content, are not kept.
    """
    after = cache.agg(F.coalesce(F.max("added") + 1, F.lit(0).cast("long")).alias("after"))
    fresh = asked.where("content is not null").join(new.where("answer is not null"), "key").crossJoin(F.broadcast(after))
    both = cache.select("key", "answer", "added").unionByName(fresh.select("key", "answer", (F.col("after") + F.col("first")).alias("added")))
    return both.orderBy(F.desc("added"), "key").limit(most)


def ask_once(requests: DataFrame, cache: DataFrame, ask: Callable[[DataFrame], DataFrame], most: int = MOST_ANSWERS) -> tuple[DataFrame, DataFrame]:
    """(answered requests, cache for the next run).  ``ask`` gives (key, answer) of (key, content, model).

    Store the first before the second is used if asking is dear: both plans ask.
    """
    asked = misses(requests, cache)
    new = ask(asked.select("key", "content", "model")).select("key", "answer")
    return answered(requests, cache, new), stored(cache, asked, new, most)
