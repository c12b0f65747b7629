"""Merging findings of one file and category whose evidence overlaps.

Evidence is swept in window functions: a span that starts where all earlier ones have ended opens an
island, boxes do so down the page and then along a line, structure is joined by its anchor.  Most
candidates share no island and are done.  The others form parts: an island each, or all of a file and
category if one of its candidates reaches several shared islands.  Only inside a part is evidence
compared pair by pair, which splits it exactly and gives the order of the members.

Candidates are dealt once, by (file, category); every later step keeps that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.rules import EVIDENCE

DETECTIONS = f"array<struct<method:string,rule_id:string,evidence:array<{EVIDENCE}>>>"
RULE_METHODS = ("rule", "ocr-rule")
GROUP = ("file_id", "category")

#: Strict overlap of spans or boxes (whatever their anchors); equal anchors of structure.
OVERLAP = """coalesce(a.type = b.type AND CASE
  WHEN a.type = 'text-span' THEN a.`start` < b.`end` AND b.`start` < a.`end`
  WHEN a.type = 'image-region' THEN a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h
  ELSE a.type = 'file-structure' AND a.anchor <=> b.anchor END, false)"""
#: Whether member i overlaps a member of g.
MEETS = f"exists(g, j -> exists(ms[i].evidence, a -> exists(ms[j].evidence, b -> {OVERLAP})))"
#: Each member in turn enters the first group that it overlaps, or opens one.
ENTERED = f"""aggregate(sequence(0, size(ms) - 1), cast(array() AS array<array<int>>), (acc, i) ->
  transform(array(array_position(transform(acc, g -> {MEETS}), true)), p ->
    if(p = 0, concat(acc, array(array(i))), transform(acc, (g, k) -> if(k + 1 = p, concat(g, array(i)), g))))[0])"""
#: The front group takes in the first later one that it overlaps; when there is none, it is done.
JOINED = f"""aggregate(sequence(1, size(ms)),
  named_struct('done', cast(array() AS array<array<int>>), 'front', cast(array() AS array<int>), 'rest', {ENTERED}),
  (s, n) -> if(size(s.rest) = 0, s, transform(array(array_position(transform(s.rest, g -> exists(s.front, i -> {MEETS})), true)), p ->
    if(p > 0,
      named_struct('done', s.done, 'front', concat(s.front, s.rest[int(p - 1)]), 'rest', filter(s.rest, (g, k) -> k + 1 <> p)),
      named_struct('done', if(size(s.front) > 0, concat(s.done, array(s.front)), s.done), 'front', s.rest[0], 'rest', slice(s.rest, 2, size(s.rest)))))[0]),
  s -> concat(s.done, array(s.front)))"""


def _islands(rows: DataFrame, keys: tuple[str, ...], low: str, high: str, name: str) -> DataFrame:
    """Rows of equal keys numbered by the run of overlapping (low, high) that they belong to."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.when(F.col(low) < before, 0).otherwise(1))
    return rows.withColumn(name, F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def _node(span: Column, box: Column) -> Column:
    """What a piece of evidence may share with others: an island or an anchor; null if nothing."""
    return F.when((span | box) & F.col("low").isNotNull(), F.concat_ws("/", "type", "band", "run")).when(F.col("type") == "file-structure", F.concat(F.lit("anchor"), F.coalesce(F.concat(F.lit("="), "anchor"), F.lit(""))))


def _parts(candidates: DataFrame) -> DataFrame:
    """(file_id, category, part, ms): candidates that may overlap, in order; most are alone."""
    dealt = candidates.withColumn("evidence", F.col("evidence").cast(f"array<{EVIDENCE}>")).repartition(*GROUP)
    # Numbers that tell candidates apart; they stay within the tasks that give them.
    dealt = dealt.withColumn("n", F.monotonically_increasing_id())
    found = F.struct("ordinal", "title", "reason", "group_id", "method", "rule_id", "evidence")
    each = dealt.select(*GROUP, "n", found.alias("found"), F.posexplode_outer("evidence").alias("k", "e"))
    span, box = F.col("type") == "text-span", F.col("type") == "image-region"
    e = lambda c: F.col(f"e.{c}").cast("double")
    is_span = F.col("e.type") == "text-span"
    # A candidate travels with its first piece of evidence only.
    rows = each.select(*GROUP, "n", F.when(F.coalesce("k", F.lit(0)) == 0, F.col("found")).alias("found"), "e.type", "e.anchor", F.when(is_span, e("start")).otherwise(e("y")).alias("low"), F.when(is_span, e("end")).otherwise(e("y") + e("h")).alias("high"), F.when(is_span, e("start")).otherwise(e("x")).alias("left"), F.when(is_span, e("end")).otherwise(e("x") + e("w")).alias("right"))
    rows = _islands(rows, (*GROUP, "type"), "low", "high", "band")
    rows = _islands(rows, (*GROUP, "type", "band"), "left", "right", "run").withColumn("node", _node(span, box))
    same = Window.partitionBy(*GROUP, "node")
    shared = F.col("node").isNotNull() & (F.min("n").over(same) != F.max("n").over(same))
    rows = rows.withColumn("shared", F.when(shared, F.col("node")))
    whole = rows.groupBy(*GROUP, "n").agg(F.first("found", ignorenulls=True).alias("found"), F.collect_set("shared").alias("nodes"))
    several = F.max(F.size("nodes")).over(Window.partitionBy(*GROUP)) > 1
    part = F.when(F.size("nodes") == 0, F.concat_ws("/", F.lit("alone"), "n")).when(several, F.lit("several")).otherwise(F.get("nodes", F.lit(0)))
    return whole.withColumn("part", part).groupBy(*GROUP, "part").agg(F.array_sort(F.collect_list("found")).alias("ms"))


def merge(candidates: DataFrame) -> DataFrame:
    """One finding for each set of candidates joined by overlapping evidence.

    ``candidates``: file_id, ordinal (input order), category, title, reason, group_id, method,
    rule_id, evidence.  Repeated candidates meet like others.  Null or empty evidence overlaps nothing.
    """
    groups = F.when(F.size("ms") == 1, F.array(F.array(F.lit(0)))).otherwise(F.expr(JOINED))
    rows = _parts(candidates).select(*GROUP, "ms", F.explode(groups).alias("group")).withColumn("found", F.expr("transform(group, i -> ms[i])"))
    rule = F.filter("found", lambda m: m["method"].isin(*RULE_METHODS))
    rows = rows.withColumn("winner", F.coalesce(F.get(rule, F.lit(0)), F.get("found", F.lit(0))))
    ordinals = F.transform("found", lambda m: m["ordinal"].cast("bigint"))
    group_id = F.get(F.filter(F.transform("found", lambda m: m["group_id"]), lambda g: g.isNotNull()), F.lit(0))
    detections = F.array_distinct(F.transform("found", lambda m: F.struct(m["method"].alias("method"), m["rule_id"].alias("rule_id"), m["evidence"].alias("evidence"))))
    return rows.select(*GROUP, F.array_min(ordinals).alias("ordinal"), "winner.title", "winner.reason", group_id.alias("group_id"), ordinals.alias("members"), detections.cast(DETECTIONS).alias("detections"))


def merge_members(candidates: DataFrame) -> DataFrame:
    """(file_id, category, ordinal, component): each candidate with the least ordinal of its finding."""
    m = merge(candidates)
    return m.select("file_id", "category", F.explode("members").alias("ordinal"), F.col("ordinal").alias("component"))
