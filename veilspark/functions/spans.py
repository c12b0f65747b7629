"""Spans of text as Column expressions: matches with offsets, lines, islands, redaction, segments.

Offsets are code points.  Everything is a built-in or a higher-order function, so plans stay on
the JVM and need no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, reduce, wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = "[REDACTED]"
HIT = "array<struct<start:bigint,end:bigint,quote:string>>"
#: Elements that a fold gathers before it sets them aside: appending to one long list would copy it at each step.
BLOCK = 128


def built_once(make: Callable[..., Column]) -> Callable[..., Column]:
    """``make`` with its large expressions kept by their arguments, for as long as the same JVM runs.

    An expression of hundreds of calls takes the driver longer to build than small tables take to run.
    """
    kept = lru_cache(maxsize=256)(lambda jvm, *args, **named: make(*args, **named))
    return wraps(make)(lambda *args, **named: kept(id(SparkContext._gateway), *args, **named))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_hits() -> Column:
    return F.array().cast(HIT)


def hits(text: Column | str, pattern: Column | str, gate: str | Column | None = None, valid: Callable[[Column], Column] | None = None, most: int | None = None, lines: bool = False) -> Column:
    """Leftmost non-overlapping matches as (start, end, quote), with the line if ``lines``.

    The gaps between matches give the offsets, in one fold.  ``gate`` is a cheap literal that
    every match holds, or a condition; other texts are not searched.  ``valid`` tells which quotes count, and
    ``most`` bounds how many of those are kept.  The fold is linear in the matches, as it gathers them in
    blocks where nothing bounds them.  A pattern may be a column.
    """
    text = _c(text)
    long = lambda x: x.cast("bigint")
    kind = HIT.replace(">>", ",line:int>>") if lines else HIT
    start = F.struct(long(F.lit(0)).alias("at"), F.lit(0).alias("line"), F.array().cast(kind).alias("out"), F.array().cast(f"array<{kind}>").alias("full"))

    def step(acc: Column, pair: Column) -> Column:
        s = acc["at"] + F.length(pair["gap"])
        e = s + F.length(pair["quote"])
        line = acc["line"] + count_of(pair["gap"], "\n") if lines else acc["line"]
        hit = F.struct(long(s).alias("start"), long(e).alias("end"), pair["quote"].alias("quote"), *([line.cast("int").alias("line")] if lines else []))
        after = line + count_of(pair["quote"], "\n") if lines else line
        if most is None:
            out, full = _gathered(acc, hit)
        else:
            good = (F.size(acc["out"]) < most) & good_quote(pair["quote"])
            out, full = F.when(good, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"), acc["full"].alias("full")
        return F.struct(long(e).alias("at"), after.cast("int").alias("line"), out, full)

    def good_quote(quote: Column) -> Column:
        return F.lit(True) if valid is None else F.coalesce(valid(quote), F.lit(False))

    def kept(acc: Column) -> Column:
        if most is not None:
            return acc["out"]
        every = _all_of(acc)
        return every if valid is None else F.filter(every, lambda h: good_quote(h["quote"]))

    def placed(found: Column) -> Column:
        pairs = F.arrays_zip(found.alias("quote"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"))
        return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, kept)).otherwise(F.array().cast(kind))

    # The matches become a lambda variable, so the search runs once; texts without any are not split.
    found = let(F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0)), placed)
    return found if gate is None else F.when(text.contains(gate) if isinstance(gate, str) else gate, found).otherwise(F.array().cast(kind))


def _gathered(acc: Column, new: Column) -> tuple[Column, Column]:
    """The lists ``out`` and ``full`` of a fold with one more element."""
    done = F.size(acc["out"]) >= BLOCK
    out = F.when(done, F.array(new)).otherwise(F.concat(acc["out"], F.array(new)))
    return out.alias("out"), F.when(done, F.concat(acc["full"], F.array(acc["out"]))).otherwise(acc["full"]).alias("full")


def _all_of(acc: Column) -> Column:
    return F.flatten(F.concat(acc["full"], F.array(acc["out"])))


def loud(text: Column | str) -> Column:
    """A text in capitals, for ``may_hold``; a few letters make it doubtful."""
    up = F.upper(_c(text))
    return let(up, lambda u: F.struct(u.alias("text"), (u.contains("\u212a") | u.contains("\u0130")).alias("odd")))


def may_hold(loud_text: Column, *words: str) -> Column:
    """Whether a text may hold one of some words in any case: true if it does, and seldom else.

    What isn't ASCII in a word is left out.  The Kelvin sign and the dotted capital I count as letters in a
    search without case and stay in capitals, so texts with them pass.
    """
    runs = [max(re.findall("[\x00-\x7f]*", w), key=len).upper() for w in words]
    return reduce(Column.__or__, [loud_text["text"].contains(r) for r in runs], loud_text["odd"])


def tagged(found: Column, name: str, value: Column) -> Column:
    """Each of the hits with one more field."""
    return F.transform(found, lambda h: h.withField(name, value))


def rows_of(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """``keep`` and a row per element of ``array``.

    In the outer form, as for the inner one Spark would copy the array's whole expression, with all
    its searches, into a filter below.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it names several times but that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def line_at(text: Column | str, start: Column) -> Column:
    """Zero-based line of an offset; only line feeds count."""
    head = F.substr(_c(text), F.lit(1), start.cast("int"))
    return count_of(head, "\n").cast("int")


def islands(spans: Column, touch: bool = False) -> Column:
    """Overlapping (start, end) spans joined, in order; abutting ones too if ``touch``."""
    kind = "array<struct<start:bigint,end:bigint>>"
    pure = F.transform(spans, lambda s: F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end")))
    ordered = F.array_sort(F.filter(pure, lambda s: s["end"] > s["start"]))

    def step(acc: Column, s: Column) -> Column:
        last = acc["last"]
        meets = last["end"] >= s["start"] if touch else last["end"] > s["start"]
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        out, full = _gathered(acc, last)
        same = F.struct(joined.alias("last"), acc["out"].alias("out"), acc["full"].alias("full"))
        return F.when(last.isNull(), F.struct(s.alias("last"), acc["out"].alias("out"), acc["full"].alias("full"))).when(meets, same).otherwise(F.struct(s.alias("last"), out, full))

    start = F.struct(F.lit(None).cast(kind[6:-1]).alias("last"), F.array().cast(kind).alias("out"), F.array().cast(f"array<{kind}>").alias("full"))
    return F.aggregate(ordered, start, step, lambda acc: F.concat(_all_of(acc), F.when(acc["last"].isNotNull(), F.array(acc["last"])).otherwise(F.array().cast(kind))))


def clamp(spans: Column, text: Column | str) -> Column:
    n = F.length(_c(text)).cast("bigint")
    into = lambda x: F.greatest(F.lit(0).cast("bigint"), F.least(x.cast("bigint"), n))
    return F.transform(spans, lambda s: F.struct(into(s["start"]).alias("start"), into(s["end"]).alias("end")))


def redact(text: Column | str, spans: Column) -> Column:
    """``text`` with each island of spans replaced; abutting spans leave two placeholders."""
    text = _c(text)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(PLACEHOLDER)).alias("out"))
    return F.aggregate(islands(clamp(spans, text)), start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))


def is_env_file(name: Column | str) -> Column:
    base = F.element_at(F.split(_c(name), "/"), -1)
    return (base == ".env") | base.startswith(".env.")


def env_value_span(text: Column | str, start: Column) -> Column:
    """The (start, end) of the value on the KEY=value line at ``start``, else null."""
    text = _c(text)
    # As lastIndexOf: the line feed at or before start - 1, and at 0 for start 0.
    upto = F.substr(text, F.lit(1), F.greatest(start, F.lit(1)).cast("int"))
    back = F.locate("\n", F.reverse(upto))
    line_start = F.when(back > 0, F.length(upto) - back + 1).otherwise(0).cast("bigint")
    ahead = F.locate("\n", F.substr(text, (start + 1).cast("int")))
    line_end = F.when(ahead > 0, start + ahead - 1).otherwise(F.length(text)).cast("bigint")
    line = F.substr(text, (line_start + 1).cast("int"), (line_end - line_start).cast("int"))
    equals = F.locate("=", line)
    key = F.substr(line, F.lit(1), equals - 1)
    value_end = line_end - F.when((line_end > line_start) & line.endswith("\r"), 1).otherwise(0)
    value_start = line_start + equals
    ok = (equals > 0) & key.rlike(r"^\s*[A-Za-z_][A-Za-z0-9_]*\s*$") & (start < line_end)
    return F.when(ok, F.struct(F.least(value_start, value_end).cast("bigint").alias("start"), F.greatest(value_start, value_end).cast("bigint").alias("end")))


def env_spans(name: Column | str, text: Column | str, spans: Column) -> Column:
    """Spans of dotenv files grown to whole values; other files keep theirs."""

    def grown(s: Column) -> Column:
        own = F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"))
        return F.coalesce(F.when(is_env_file(name), env_value_span(text, s["start"])), own)

    return F.transform(spans, grown)


def segments(text: Column | str, spans: Column) -> Column:
    """Pieces between all span borders, as (start, end, text, covered by how many spans)."""
    text = _c(text)
    n = F.length(text).cast("bigint")
    inner = F.filter(clamp(spans, text), lambda s: s["start"] < s["end"])
    borders = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("bigint"), n), F.transform(inner, lambda s: s["start"]), F.transform(inner, lambda s: s["end"]))))
    pairs = F.arrays_zip(F.slice(borders, F.lit(1), F.size(borders) - 1).alias("start"), F.slice(borders, F.lit(2), F.greatest(F.size(borders) - 1, F.lit(0))).alias("end"))
    covered = lambda p: F.size(F.filter(spans, lambda s: (s["start"] <= p["start"]) & (s["end"] >= p["end"])))
    return F.transform(F.filter(pairs, lambda p: p["end"] > p["start"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.substr(text, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")).alias("text"), covered(p).alias("covered")))


def union_box(words: Column) -> list[Column]:
    """x, y, w and h of the box around laid out words; nulls if there are none."""
    low = lambda k: F.array_min(F.transform(words, lambda w: w[k]))
    high = lambda k, size: F.array_max(F.transform(words, lambda w: w[k] + w[size]))
    return [low("x").alias("x"), low("y").alias("y"), (high("x", "w") - low("x")).alias("w"), (high("y", "h") - low("y")).alias("h")]


def utf16_offset(text: Column | str, at: Column) -> Column:
    """UTF-16 code units before a code point offset."""
    head = F.substr(_c(text), F.lit(1), at.cast("int"))
    return at + F.length(F.regexp_replace(head, r"[^\x{10000}-\x{10FFFF}]", ""))
