"""Checks and reports over a package: inconsistent redactions, coverage, scores, read model."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.terms import slug
from veilspark.operators.batches import each_key, gathered

VISIBLE = ("keep", "keep-and-remember", "open")
#: Why a processed file has no AI analysis.
NO_AI = {"skipped-no-model": "No model was available.", "skipped-too-large": "The file is too large for AI analysis.", "failed": "The model failed during the scan."}
METHODS = ("structure", "rule", "protected-term", "ocr-rule", "llm-text", "llm-vision")


def inconsistent_redactions(findings: DataFrame, files: DataFrame, protected_terms: DataFrame) -> DataFrame:
    """Groups that are redacted in one file and visible in another.

    ``findings``: file_id, ordinal, group_id, title, decision, quotes (array).  ``files``:
    file_id, name, excluded.  ``protected_terms``: term.  Findings without a group that quote a
    protected term join the term's group, so one may join several.
    """
    live = findings.join(files.where("excluded").select("file_id"), "file_id", "left_anti")
    terms = protected_terms.select(F.trim("term").alias("term")).where("term <> ''").distinct()
    named = terms.select("term", slug(F.col("term")).alias("group_id"))
    # One pass: a finding without a group goes by each of its quotes, others by none.
    late = F.col("group_id").isNull()
    quoted = F.when(late, F.array_distinct(F.transform("quotes", lambda q: F.lower(q)))).otherwise(F.array(F.lit(None).cast("string")))
    asked = live.select("*", late.cast("int").alias("late"), F.explode(quoted).alias("__q"))
    known = named.select(F.lower("term").alias("__q"), F.col("group_id").alias("__g"))
    members = asked.join(known, "__q", "left").withColumn("group_id", F.coalesce("group_id", "__g")).where("group_id is not null").drop("__q", "__g")
    members = members.join(files.select("file_id", "name"), "file_id", "left")
    at = lambda c: F.when(c, F.struct("late", "ordinal", "file_id", F.coalesce("name", F.col("file_id").cast("string")).alias("name")))
    titled = F.when(F.col("title").contains(": "), F.struct("late", "ordinal", F.substr("title", F.locate(": ", F.col("title")) + 2).alias("term")))
    groups = members.groupBy("group_id").agg(F.array_sort(F.collect_list(at(F.col("decision") == "redact"))).alias("red"), F.array_sort(F.collect_list(at(F.col("decision").isin(*VISIBLE)))).alias("vis"), F.min(titled).alias("titled"))
    groups = groups.where((F.size("red") > 0) & (F.size("vis") > 0)).join(named.groupBy("group_id").agg(F.min("term").alias("known")), "group_id", "left")
    ids = lambda c: F.array_distinct(F.transform(c, lambda m: m["file_id"]))
    names = lambda c: F.transform(F.array_distinct(F.transform(c, lambda m: F.struct(m["file_id"].alias("f"), m["name"].alias("n")))), lambda m: m["n"])
    term = F.coalesce("known", F.col("titled.term"), "group_id")
    message = F.concat(F.lit("'"), term, F.lit("' is redacted in "), F.array_join(names("red"), ", "), F.lit(" but still visible in "), F.array_join(names("vis"), ", "), F.lit("."))
    return groups.select(F.lit("inconsistent-redaction").alias("type"), term.alias("term"), "group_id", ids("red").alias("redacted_file_ids"), ids("vis").alias("visible_file_ids"), message.alias("message"))


def count_findings(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(category, findings, open) without excluded files."""
    live = findings.join(files.where("excluded").select("file_id"), "file_id", "left_anti")
    return live.groupBy("category").agg(F.count("*").alias("findings"), F.count(F.when(F.col("decision") == "open", 1)).alias("open"))


def coverage(files: DataFrame, findings: DataFrame, low_confidence: DataFrame | None = None) -> DataFrame:
    """One row: how many files were read, which were not and why, and what was found.

    ``files``: file_id, status, failure_reason, ai_analysis, excluded.
    """
    reason = F.coalesce("failure_reason", F.lit("The file could not be read."))
    no_ai = F.create_map(*[F.lit(x) for k, v in NO_AI.items() for x in (k, v)])
    listed = lambda c, v: F.array_sort(F.collect_list(F.when(c, v)))
    without = (F.col("status") == "processed") & (F.col("ai_analysis") != "done")
    row = files.agg(
        F.count("*").alias("files_total"),
        F.count(F.when(F.col("status") == "processed", 1)).alias("files_processed"),
        listed(F.col("status") == "failed", F.struct("file_id", reason.alias("reason"))).alias("files_failed"),
        listed(F.col("status") == "unsupported", F.col("file_id")).alias("files_unsupported"),
        listed(F.col("excluded"), F.col("file_id")).alias("files_excluded"),
        listed(without, F.struct("file_id", no_ai[F.col("ai_analysis")].alias("reason"))).alias("files_without_ai"),
    )
    counts = count_findings(files, findings).agg(F.coalesce(F.sum("open"), F.lit(0)).alias("findings_open"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "findings")))).alias("findings_by_category"))
    low = (low_confidence or files.select("file_id").limit(0)).agg(F.array_sort(F.collect_list("file_id")).alias("files_low_confidence"))
    return row.join(F.broadcast(counts), how="inner").join(F.broadcast(low), how="inner")  # three one-row tables


def files_without_ai(files: DataFrame) -> DataFrame:
    no_ai = F.create_map(*[F.lit(x) for k, v in NO_AI.items() for x in (k, v)])
    return files.where("status = 'processed' and ai_analysis <> 'done'").select("file_id", no_ai[F.col("ai_analysis")].alias("reason"))


def _box_match(a: dict, b: dict) -> bool:
    w = max(0.0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
    h = max(0.0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
    return w * h / (a["w"] * a["h"] + b["w"] * b["h"] - w * h) >= 0.5


def _score(key: tuple, left: list[dict], right: list[dict]) -> list[tuple]:
    """Each detection takes the first label that it meets and none took before; labels without a box are kept by their quotes."""
    rows = []
    detections, labels = (sorted(x, key=lambda r: r["ordinal"]) for x in (left, right))
    for method in METHODS:
        expected = [x for x in labels if method != "llm-vision" or x["box"] is not None]
        boxed = {i: x for i, x in enumerate(expected) if x["box"] is not None}
        quoted: dict[str, deque[int]] = {}
        for i, x in enumerate(expected):
            if x["box"] is None and x["quote"] is not None:
                quoted.setdefault(x["quote"], deque()).append(i)
        right_ones = wrong = 0
        for d in detections:
            if d["method"] != method:
                continue
            evidence = d["evidence"]
            first = next((i for i, x in boxed.items() if any(e["type"] == "image-region" and _box_match(x["box"], e) for e in evidence)), None)
            met = [] if first is None else [first]
            met += [quoted[e["quote"]][0] for e in evidence if e["type"] in ("text-span", "image-region") and quoted.get(e["quote"])]
            if not met:
                wrong += 1
                continue
            right_ones += 1
            hit = min(met)
            if boxed.pop(hit, None) is None:
                quoted[expected[hit]["quote"]].popleft()
        rows.append((method, right_ones, wrong, len(expected) - right_ones))
    return rows


def score_layers(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision and recall of each layer; a label is matched once, in detection order.

    ``detections``: file_id, category, ordinal, method, evidence.  ``labels``: file_id,
    category, ordinal, quote, box (struct or null).
    """
    d = detections.select("file_id", "category", "ordinal", "method", "evidence")
    x = labels.select("file_id", "category", "ordinal", "quote", "box")
    place = ["file_id", "category"]
    return score_places(gathered(d, place, "found").join(gathered(x, place, "labels"), place, "full"))


def score_places(both: DataFrame) -> DataFrame:
    """As ``score_layers``, for detections and labels that stand in one row a file and category, as the lists found and labels."""
    each = each_key(both, ["file_id", "category"], ["found", "labels"], _score, "layer string, true_positive long, false_positive long, false_negative long")
    total = each.groupBy("layer").agg(*[F.sum(c).alias(c) for c in ("true_positive", "false_positive", "false_negative")])
    tp = F.col("true_positive")
    return total.select("*", F.try_divide(tp, tp + F.col("false_positive")).alias("precision"), F.try_divide(tp, tp + F.col("false_negative")).alias("recall"))


def package_detail(package: DataFrame, files: DataFrame, findings: DataFrame, warnings: DataFrame) -> DataFrame:
    """The read model: a row a package with its files, findings and warnings."""
    f = files.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("file_id", "name", "status", "excluded"))).alias("files"))
    x = findings.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "file_id", "category", "decision"))).alias("findings"))
    w = warnings.groupBy("package_id").agg(F.array_sort(F.collect_list("message")).alias("warnings"))
    none = lambda c: F.coalesce(c, F.array())
    return package.join(f, "package_id", "left").join(x, "package_id", "left").join(w, "package_id", "left").select(*package.columns, none("files").alias("files"), none("findings").alias("findings"), none("warnings").alias("warnings"))
