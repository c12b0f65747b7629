"""The deterministic parts of the model layer: locality, mode, chunks, grounding, status, mock provider."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import regex, spans
from veilspark.operators.batches import each_key, gathered, plain

CHUNK_LINES = 200
OVERLAP_LINES = 10
MOST_BYTES = 204_800

#: The demo provider's findings as (category, quote, reason).
MOCK_FINDINGS = (
    ("protected-term", "Project Juniper", "An unreleased project codename is visible."),
    ("protected-term", "Juniper", "A protected project name is visible."),
    ("internal-pricing", "Our day rate for Acme is 1,450 EUR", "Internal pricing for another client is visible."),
    ("other-client", "Acme Corp", "Another client name is visible."),
    ("unreleased-work", "Unreleased Atlas launch", "Unreleased work is visible."),
    ("internal-infra", "Private staging cluster", "Internal infrastructure is described."),
    ("personal-contact", "Mira's private mobile", "A private contact is described."),
    ("prompt-injection", "Ignore all prior instructions", "The file contains instructions aimed at the scanner."),
)


def locality(url: Column, provider: Column | None = None) -> Column:
    """Where a model server runs: mock, local, lan or remote; an address that cannot be read is remote."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^\[|\]$", ""), r"\.$", "")
    parts = F.split(host, r"\.")
    n = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    v4 = host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    lan4 = (n(1) == 10) | ((n(1) == 172) & n(2).between(16, 31)) | ((n(1) == 192) & (n(2) == 168)) | ((n(1) == 100) & n(2).between(64, 127))
    out = F.when(host.isin("localhost", "::1"), "local").when(host.endswith(".local"), "lan").when(v4 & (n(1) == 127), "local").when(v4 & lan4, "lan").when(host.rlike("^(fc|fd)[0-9a-f]{2}:"), "lan").otherwise("remote")
    out = F.when(url.isNull() | (host == ""), "remote").otherwise(out)
    return out if provider is None else F.when(provider == "mock", "mock").otherwise(out)


def mode(provider: Column, text_ok: Column, vision_ok: Column) -> Column:
    return F.when(provider == "mock", "full").when(~text_ok, "rules-only").when(vision_ok, "full").otherwise("text-ai")


def saved_setting(saved: Column, present: Column, environment: Column, default: Column) -> Column:
    """Saved (null counts, if present), else of the environment, else the default."""
    return F.when(present, saved).otherwise(F.coalesce(environment, default))


def too_large(text: Column) -> Column:
    return F.octet_length(text) > MOST_BYTES


def _lines(text: Column) -> Column:
    """Lines with their terminators: CR LF, CR or LF."""
    return F.regexp_extract_all(text, F.lit(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$"), F.lit(0))


def line_chunks(texts: DataFrame, size: int = CHUNK_LINES, overlap: int = OVERLAP_LINES) -> DataFrame:
    """(file_id, chunk, start_line, start, text): windows of lines that overlap."""
    df = texts.select("file_id", _lines(F.col("text")).alias("ls")).where("size(ls) > 0")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size("ls") - size) / step)).cast("int")
    # Each line is measured once, with the others of its step; offsets add up step by step.
    piece = lambda k, n: F.array_join(F.slice("ls", k * step + 1, F.lit(n)), "")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    add = lambda acc, k: F.struct((acc["at"] + F.length(piece(k, step))).cast("bigint").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    starts = F.aggregate(F.sequence(F.lit(0), last), zero, add, lambda acc: acc["out"])
    chunks = F.transform(starts, lambda start, k: F.struct(k.cast("long").alias("chunk"), (k * step).cast("long").alias("start_line"), start.alias("start"), piece(k, size).alias("text")))
    return spans.rows_of(df, ["file_id"], chunks, "c").select("file_id", "c.*")


def quote_spans(text: Column | str, quote: str) -> Column:
    """Exact non-overlapping places of a quote."""
    if not quote.strip():
        return spans.no_hits()
    return spans.hits(text, regex.literal(quote), quote)


_WS = re.compile("[" + "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in regex.SPACES) + "]+")


def _normal(text: str) -> tuple[str, list[int], list[int]]:
    value, starts, ends, at = [], [], [], 0
    while at < len(text):
        m = _WS.match(text, at)
        part, end = (" ", m.end()) if m else (text[at].lower(), at + 1)
        value.append(part)
        starts += [at] * len(part)
        ends += [end] * len(part)
        at = end
    return "".join(value), starts, ends


def ground(text: str, quote: str) -> list[tuple[int, int]]:
    """Places of a quote in one text: exact ones, else with white space collapsed and case folded, mapped back.

    What ``ground_quotes`` finds is held against this.
    """
    if not quote.strip():
        return []
    out, at = [], text.find(quote)
    while at >= 0:
        out.append((at, at + len(quote)))
        at = text.find(quote, at + len(quote))
    if out:
        return out
    value, starts, ends = _normal(text)
    target = _normal(quote)[0].strip()
    at = value.find(target)
    while at >= 0:
        out.append((starts[at], ends[at + len(target) - 1]))
        at = value.find(target, at + len(target))
    return out


def _alone() -> str:
    """Letters that a search without case takes for others although their lower case differs, and the dotted capital I first."""
    letters = map(chr, range(0x80, 0xD800))
    return "\u0130" + "".join(c for c in letters if c.lower() == c and len(c.upper()) == 1 and c.upper().lower() != c)


#: Such letters are coded as others that no text holds (noncharacters, then the last private ones) before the search, and decoded in what it finds.
_ALONE = _alone()
_CODES = "".join(chr(0xFDD0 + i) if i < 32 else chr(0x10FF00 + i) for i in range(len(_ALONE)))


def _loose(coded: Column) -> Column:
    """The pattern of a coded quote in any case and spacing; the dotted capital I counts as i and a dot."""
    safe = F.regexp_replace(coded, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    words = F.array_join(F.filter(F.split(safe, f"[{regex.SPACE_CLASS}]+"), lambda w: w != ""), f"[{regex.SPACE_CLASS}]+")
    dotted = F.regexp_replace(F.replace(words, F.lit(_CODES[0]), F.lit("i\u0307")), "(?i)i\u0307", f"(?:i\u0307|{_CODES[0]})")
    # A lone sharp s has no simple upper case, so the search wouldn't take its capital for it.
    sharp = F.regexp_replace(dotted, "[\u00df\u1e9e]", "(?:\u00df|\u1e9e)")
    ends = F.regexp_replace(F.regexp_replace(sharp, "^\u0307", f"[\u0307{_CODES[0]}]"), "(?i)i$", f"[i{_CODES[0]}]")
    return F.concat(F.lit("(?iu)"), ends)


def _line_breaks(piece: Column) -> Column:
    """Line ends of a piece of text; CR LF is one."""
    return spans.count_of(piece, "\n") + spans.count_of(piece, "\r") - F.size(F.split(piece, "\r\n", -1)) + 1


def _with_lines(text: Column, pattern: Column, found: Column) -> Column:
    """Hits with the number of line ends that begin before them; a CR LF cut by the edge of a hit counts once."""
    zero = F.struct(F.lit(0).alias("line"), F.lit(False).alias("cr"), F.array().cast("array<int>").alias("out"))
    pairs = F.arrays_zip(found["quote"].alias("quote"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"))
    after = lambda line, cr, piece: (line + _line_breaks(piece) - (cr & piece.startswith("\n")).cast("int")).cast("int")
    ends_cr = lambda cr, piece: F.when(piece == "", cr).otherwise(piece.endswith("\r"))

    def step(acc: Column, p: Column) -> Column:
        line, cr = after(acc["line"], acc["cr"], p["gap"]), ends_cr(acc["cr"], p["gap"])
        return F.struct(after(line, cr, p["quote"]).alias("line"), ends_cr(cr, p["quote"]).alias("cr"), F.array_append(acc["out"], line).alias("out"))

    lines = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
    plain = F.zip_with(found, lines, lambda h, n: F.struct(h["start"].alias("start"), h["end"].alias("end"), n.alias("line"), F.translate(h["quote"], _CODES, _ALONE).alias("quote")))
    return F.when(F.size(found) > 0, plain)


def ground_quotes(quotes: DataFrame) -> DataFrame:
    """Each (file_id, n, text, quote) with ``found``: an array of (start, end, line, quote); lines end at CR LF, CR or LF.

    Exact places count, else those in any case and spacing, all by searches of the JVM: coded text
    has the offsets of the text itself, so nothing is mapped back.  A null text or quote is found nowhere.
    """
    space = f"^[{regex.SPACE_CLASS}]*$"
    coded = quotes.select("file_id", "n", F.coalesce(F.translate("text", _ALONE, _CODES), F.lit("")).alias("coded"), F.coalesce(F.translate("quote", _ALONE, _CODES), F.lit("")).alias("quote"))
    exact = F.concat(F.lit("\\Q"), F.replace("quote", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    ways = coded.withColumn("pattern", F.when(F.col("quote").rlike(space), F.lit(None)).when(F.contains("coded", "quote"), exact).otherwise(_loose(F.col("quote"))))
    pattern = F.col("pattern")
    found = spans.let(spans.hits("coded", pattern), lambda h: _with_lines(F.col("coded"), pattern, h))
    none = F.array().cast("array<struct<start:bigint,end:bigint,line:int,quote:string>>")
    return ways.select("file_id", "n", F.coalesce(F.when(pattern.isNotNull(), found), none).alias("found"))


def grounded(found: DataFrame) -> DataFrame:
    """How many quotes stay, and how many are dropped because the text does not hold them."""
    return found.agg(F.count(F.when(F.size("found") > 0, 1)).alias("kept"), F.count(F.when(F.size("found") == 0, 1)).alias("dropped"))


def mock_findings(files: DataFrame, related: str | None = None) -> DataFrame:
    """(file_id, n, category, quote, reason) of the demo provider.

    A quote that holds another wins for the project name; with ``related``, only findings whose
    quote holds that term.
    """
    table = [(i, *f) for i, f in enumerate(MOCK_FINDINGS)]
    if related is not None:
        table = [t for t in table if related.lower() in t[2].lower()]
        if related.lower() == "juniper":
            table.append((len(MOCK_FINDINGS), "protected-term", "the green initiative", "A possible reference to Juniper."))
    low = F.lower("text")
    hit = lambda q: low.contains(q.lower())
    row = lambda t: F.struct(F.lit(t[0]).alias("n"), F.lit(t[1]).alias("category"), F.lit(t[2]).alias("quote"), F.lit(t[3]).alias("reason"))
    shadow = lambda t: ~hit("Project Juniper") if t[2] == "Juniper" and related is None else F.lit(True)
    each = F.array_compact(F.array(*[F.when(hit(t[2]) & shadow(t), row(t)) for t in table]))
    return spans.rows_of(files, ["file_id"], each, "f").select("file_id", "f.*")


def _merge_chunks(key: tuple, rows: list[dict]) -> list[tuple]:
    groups: list[tuple[int, list[dict], set]] = []
    for r in sorted(rows, key=lambda r: r["ordinal"]):
        found = [plain(e) for e in r["found"]]
        keys = {re.sub(r"\s+", " ", e["quote"].lower()) for e in found}
        home = next((g for g in groups if g[2] & keys), None)
        if home is None:
            groups.append((r["ordinal"], found, keys))
            continue
        home[2].update(keys)
        home[1].extend(e for e in found if e not in home[1])
    return [(*key, ordinal, found) for ordinal, found, _ in groups]


def merge_chunk_findings(findings: DataFrame) -> DataFrame:
    """Findings of several chunks joined: same file, category and title, and a quote in common.

    ``findings``: file_id, category, title, ordinal, found (as ``ground_quotes`` gives).
    """
    keys = ["file_id", "category", "title"]
    source = gathered(findings.select(*keys, "ordinal", "found"), keys, "rows")
    return each_key(source, keys, ["rows"], _merge_chunks, "file_id long, category string, title string, ordinal long, found array<struct<start:bigint,end:bigint,line:int,quote:string>>")


RANK = ("done", "skipped-too-large", "failed")


def file_status(parts: DataFrame) -> DataFrame:
    """(file_id, status): the worst of a file's parts (file_id, status)."""
    rank = F.array_position(F.array(*map(F.lit, RANK)), F.col("status"))
    return parts.groupBy("file_id").agg(F.element_at(F.array(*map(F.lit, RANK)), F.max(rank).cast("int")).alias("status"))


def fall_back(files: DataFrame) -> DataFrame:
    """Once a model fails (package_id, ordinal, status), it and all later files of the package count as failed."""
    before = Window.partitionBy("package_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.max((F.col("status") == "failed").cast("int")).over(before) == 1
    return files.withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))
