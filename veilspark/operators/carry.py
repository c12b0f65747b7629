"""Evidence fingerprints, decisions carried to a new scan, and matching of re-scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.batches import each_key, gathered


def _round4(x: Column) -> Column:
    return (F.floor(x / 4 + 0.5) * 4).cast("long").cast("string")


def fingerprint(e: Column) -> Column:
    """The key by which one piece of evidence is recognised again."""
    box = F.concat_ws(",", *[_round4(e[k]) for k in "xywh"])
    named = (e["anchor"].isNotNull()) & (e["anchor"] != "")
    return (
        F.when(e["type"] == "text-span", F.concat(F.lit("span:"), e["start"].cast("string"), F.lit("-"), e["end"].cast("string")))
        .when(e["type"] == "image-region", F.when(named, F.concat(F.lit("box:"), e["anchor"], F.lit(":"), box)).otherwise(F.concat(F.lit("box:"), box)))
        .when(e["type"] == "image-whole", F.lit("whole"))
        .otherwise(F.when(named, F.concat(F.lit("struct:"), e["anchor"])).otherwise(F.concat(F.lit("bytes:"), F.coalesce(e["byte_offset"].cast("string"), F.lit("none")))))
    )


def keys(evidence: Column | str) -> Column:
    """Distinct fingerprints of an evidence array (of one file and category)."""
    return F.array_distinct(F.transform(evidence, fingerprint))


def quotes(evidence: Column | str) -> Column:
    """Non-empty quotes in order."""
    return F.transform(F.filter(evidence, lambda e: e["type"].isin("text-span", "image-region") & e["quote"].isNotNull() & (e["quote"] != "")), lambda e: e["quote"])


def shares_evidence(a: Column, b: Column) -> Column:
    return F.arrays_overlap(keys(a), keys(b))


CARRIED = "file_id long, category string, ordinal long, finding_id string, decision string"


def _carry(key: tuple, new: list[dict], old: list[dict]) -> list[tuple]:
    new, old = sorted(new, key=lambda r: r["ordinal"]), sorted(old, key=lambda r: r["old_ordinal"])
    free = dict(enumerate(old))
    by_key: dict[str, list[int]] = {}
    for i, r in free.items():
        for k in set(r["old_keys"]):
            by_key.setdefault(k, []).append(i)
    out = []
    for r in new:
        found = min((i for k in r["keys"] for i in by_key.get(k, ()) if i in free), default=None)
        was = free.pop(found) if found is not None else {"finding_id": None, "decision": "open"}
        out.append((*key, r["ordinal"], was["finding_id"], was["decision"]))
    return out


def carry_decisions(candidates: DataFrame, previous: DataFrame) -> DataFrame:
    """Each new candidate with the id and decision of the first old finding it still shares evidence with.

    In candidate order an old finding is used once; unmatched candidates are open without an
    id, unmatched old findings are dropped, and old findings made by hand are all kept.
    ``candidates``: file_id, category, ordinal, evidence.  ``previous``: also finding_id,
    decision, manual.
    """
    new = candidates.select("file_id", "category", "ordinal", keys("evidence").alias("keys"))
    old = previous.where("not manual").select("file_id", "category", "ordinal", "finding_id", "decision", keys("evidence").alias("keys"))
    old = old.toDF("file_id", "category", "old_ordinal", "finding_id", "decision", "old_keys")
    place = ["file_id", "category"]
    both = gathered(new, place, "new").join(gathered(old, place, "old"), place, "left")
    carried = each_key(both, place, ["new", "old"], _carry, CARRIED)
    return carried.unionByName(previous.where("manual").select("file_id", "category", F.col("ordinal").cast("long").alias("ordinal"), "finding_id", "decision"))


def verify_match(candidates: DataFrame, originals: DataFrame) -> DataFrame:
    """Candidates of a re-scan with the first original finding (by its ordinal) they repeat, or null.

    The same file and category, and a shared fingerprint or a shared quote (trimmed, any case).
    """
    fold = lambda e: F.transform(quotes(e), lambda q: F.concat(F.lit("quote:"), F.lower(F.trim(q))))
    both = F.array_distinct(F.concat(keys("evidence"), fold("evidence")))
    # Candidates are read once: each goes on with all its keys, numbered within its file, as ordinals may repeat.
    named = candidates.select("file_id", "category", "ordinal", both.alias("keys")).groupBy("file_id").agg(F.collect_list(F.struct("category", "ordinal", "keys")).alias("cs"))
    new = named.select("file_id", F.posexplode("cs").alias("n", "c")).select("file_id", "n", "c.category", "c.ordinal", F.explode_outer("c.keys").alias("key"))
    old = originals.select("file_id", "category", F.lit(True).alias("met"), F.col("ordinal").alias("original"), "finding_id", "decision", F.explode(both).alias("key"))
    first = F.min(F.when(F.col("met"), F.struct("original", "finding_id", "decision"))).alias("m")
    return new.join(old, ["file_id", "category", "key"], "left").groupBy("file_id", "n", "category", "ordinal").agg(first).select("file_id", "category", "ordinal", F.col("m.finding_id").alias("finding_id"), F.coalesce("m.decision", F.lit("open")).alias("decision"))


def still_open(matched: DataFrame) -> DataFrame:
    """How many findings stay open on reviewed copies: matched ones once each, and new ones."""
    each = matched.groupBy("file_id", "finding_id", "decision").agg(F.count("*").alias("n"))
    each = each.withColumn("n", F.when(F.col("finding_id").isNotNull(), F.lit(1).cast("long")).otherwise(F.col("n")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))
    return each.agg(total(F.col("decision").isin("open", "redact")).alias("open_findings"), total(F.lit(True)).alias("reported"), total(F.col("finding_id").isNull()).alias("new_findings"))


def first_by(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__n = 1").drop("__n")
