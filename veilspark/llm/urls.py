"""URL filters: host rules, and pattern rules found through their rarest literal token.

``parse`` splits a url without any normalisation but lower-casing A-Z of the host.  A host
rule fits its host and all subdomains if the path starts with its own; the longest wins.
Urls that no host rule fits go to the pattern rules: each is indexed under the one of its
literal tokens that the fewest urls hold, a url's tokens fetch candidate rules from that
index, and only those run their regular expression.

Cost does not grow with the number of pattern rules: a url's tokens are looked up in one hash set
of the index's tokens; only urls that hold one are joined with the table of rules by token (Spark
broadcasts that table if it is small) and only their candidate rules run.  Urls without an index
token are never shuffled.  Counting tokens gathers one number per distinct rule token.

Defined cases: a null url, or one without ``://``, has empty host and path and no rule, and
its verdict is allow; repeated rows each get their row; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule): a rule is host/path, split at its first slash.
HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@dataclass(frozen=True)
class PatternRule:
    """``tokens`` are runs of a-z0-9 that every url matching ``pattern`` holds between other characters."""

    name: str
    pattern: str
    tokens: tuple[str, ...]


#: Matched on the lower-cased url.
PATTERN_RULES = (
    PatternRule("spam-farm", r"://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    PatternRule("casino-bonus", r"[^a-z0-9]casino[^a-z0-9](.*[^a-z0-9])?bonus([^a-z0-9]|$)", ("casino", "bonus")),
    PatternRule("adult", r"[^a-z0-9](xxx|porn)([^a-z0-9]|$)", ()),
    PatternRule("login-next", r"/login(/[^?#]*)?\?(.*&)?next=", ("login", "next")),
    PatternRule("feed-copy", r"[?&]utm_source=feed(&|#|$)", ("utm", "source", "feed")),
    PatternRule("paged-referral", r"[?&]page=[0-9]+&ref=", ("page", "ref")),
)


def expand(rules: tuple[PatternRule, ...]) -> tuple[PatternRule, ...]:
    """A rule without tokens whose pattern is an alternation of words becomes one rule a word."""
    out = []
    for r in rules:
        if r.tokens:
            out.append(r)
            continue
        m = re.search(r"\(([a-z0-9]+(?:\|[a-z0-9]+)+)\)", r.pattern)
        if not m:
            raise ValueError(f"{r.name}: no literal token to index it by")
        out += [PatternRule(r.name, r.pattern.replace(m[0], w), (w,)) for w in m[1].split("|")]
    return tuple(out)


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    cut = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(cut, r"(?s)^([^/]*)", 1)
    path = F.substr(cut, F.length(host) + 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Struct (verdict, rule) of the longest host rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the last that fits is the longest
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def held_tokens(url: Column, words: list[str]) -> Column:
    """The url's tokens that are among ``words``; Spark looks each up in a hash set."""
    return F.filter(tokens(url), lambda t: t.isin(*words))


def rarest_index(pages: DataFrame, rules: tuple[PatternRule, ...]) -> dict[str, list[int]]:
    """Rule numbers under each rule's rarest token, counted over every url."""
    words = sorted({t for r in rules for t in r.tokens})
    if not words:
        return {}
    found = pages.select(F.explode_outer(held_tokens(F.col("url"), words)).alias("t")).where("t is not null")
    seen = dict.fromkeys(words, 0) | {r.t: r.n for r in found.groupBy("t").agg(F.count("*").alias("n")).collect()}  # a row a word
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (seen[t], t)), []).append(i)
    return index


def judge(pages: DataFrame, host_rules: tuple[tuple[str, str], ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, patterns (names of pattern rules that matched)."""
    spark = pages.sparkSession
    rules = expand(pattern_rules)
    index = rarest_index(pages, rules)
    host, path = parse(F.col("url"))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    df = df.withColumn("fit", rule_for(F.col("host"), F.col("path"), host_rules))
    none = F.array().cast("array<string>")
    held = F.when(F.col("fit").isNull(), held_tokens(F.col("url"), sorted(index))).otherwise(none) if index else none
    df = df.withColumn("held", held)
    out = ["page_id", "host", "path", "fit"]
    done = df.where(F.size("held") == 0).select(*out, none.alias("patterns"))
    if index:
        table = spark.createDataFrame([(t, rules[i].name, rules[i].pattern) for t, ids in index.items() for i in ids], "token string, name string, pattern string")
        asked = df.where(F.size("held") > 0).withColumn("row", F.monotonically_increasing_id())
        tried = asked.select(*out, "row", F.lower("url").alias("low"), F.explode("held").alias("token")).join(table, "token")
        hit = F.when(F.expr("low rlike pattern"), F.col("name"))
        done = done.unionByName(tried.groupBy("row", *out).agg(F.array_sort(F.collect_set(hit)).alias("patterns")).select(*out, "patterns"))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.size("patterns") > 0, "block").otherwise("allow"))
    return done.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.array_join("patterns", ",").alias("patterns"))
