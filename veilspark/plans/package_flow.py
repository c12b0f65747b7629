"""A package from scan to verified export, as DataFrames: scan, merge, policy, carry, redact, re-scan.

``scan`` is one plan over all files; a file that cannot be read has its own error and the others
go on.  ``export`` writes the reviewed copies as a table and ``verify`` reads what was written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.operators import carry, documents, export, images, merge, ocr, package, policy, residue, rules, terms
from veilspark.plans.inputs import files as review_files
from veilspark.sources import uploads


@dataclass
class Scan:
    files: DataFrame  # file_id, name, text, status, failure_reason
    findings: DataFrame  # file_id, category, ordinal, title, reason, group_id, detections, evidence, suggested_action, allowed_by_recipient


def read_texts(originals: DataFrame) -> DataFrame:
    """Originals (file_id, name, content) decoded; bytes that are not UTF-8 fail that file only."""
    text = uploads.decode(F.col("content"))
    return originals.select("file_id", "name", text.alias("text"), F.when(text.isNull(), "failed").otherwise("processed").alias("status"), F.when(text.isNull(), "The file is not valid UTF-8.").alias("failure_reason"))


#: Wording of findings of the layers.
PROTECTED = ("protected-term", "Protected term: ", "You marked this term as sensitive for this package.")
OTHER_CLIENT = ("other-client", "Other client: ", "This names a different client than the package recipient.")
RESIDUE = ("Redacted text still present in the reviewed copy", "Text that was approved for removal is still in the reviewed file.")

#: Findings of a file keep the order of the layers: structure, rules, terms.  The layer is the upper bits of an ordinal.
IMAGE_AT, HIDDEN_AT, TEXT_AT, RULES_AT, TERMS_AT, CLIENTS_AT, RESIDUE_AT = (layer << 48 for layer in range(7))
CANDIDATE = ("file_id", "ordinal", "category", "title", "reason", "group_id", "method", "rule_id", "evidence")


def _structure_evidence(anchor: Column, byte_offset: Column, note: Column, quote: Column) -> Column:
    """A place in the structure of a file, as an array of one."""
    null = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("file-structure").alias("type"), null("bigint").alias("start"), null("bigint").alias("end"), null("int").alias("line"), quote.cast("string").alias("quote"), *[null("double").alias(k) for k in "xywh"], anchor.cast("string").alias("anchor"), byte_offset.cast("bigint").alias("byte_offset"), note.cast("string").alias("note")))


def _candidate(rows: DataFrame, ordinal: Column, method: str) -> DataFrame:
    rows = rows.withColumn("ordinal", ordinal.cast("long")).withColumn("method", F.lit(method))
    return rows.withColumn("group_id", F.col("group_id") if "group_id" in rows.columns else F.lit(None).cast("string")).select(*CANDIDATE)


def text_candidates(texts: DataFrame) -> DataFrame:
    """Rules, hidden characters and instructions in (file_id, text)."""
    found = rules.candidates(texts, whole=True)
    layer = F.col("ordinal") >= len(rules.RULES)
    out = _candidate(found, F.col("ordinal") + F.when(layer, TEXT_AT).otherwise(RULES_AT), "rule")
    return out.withColumn("method", F.when(F.col("ordinal") < RULES_AT, "structure").otherwise(F.col("method")))


def _boxed(text_span: Column, *columns: str) -> Column:
    """Evidence of the columns at hand: a text span, or the box that replaces it."""
    null = lambda t: F.lit(None).cast(t)
    at = [F.when(text_span, F.col(c)).alias(c) if c in columns else null(t).alias(c) for c, t in (("start", "bigint"), ("end", "bigint"), ("line", "int"))]
    return F.struct("type", *at, "quote", *"xywh", null("string").alias("anchor"), null("bigint").alias("byte_offset"), null("string").alias("note"))


def ocr_candidates(words: DataFrame, protected_terms: Terms = (), other_clients: Terms = ()) -> DataFrame:
    """Rules and terms in OCR words (file_id, n, text, x, y, w, h, confidence), with the boxes of the words that a hit touches.

    Hidden characters and instructions count as rules here.
    """
    placed = ocr.word_offsets(ocr.ocr_result(words))
    found = rules.candidates(ocr.ocr_text(placed), whole=True)
    each = found.select("file_id", "ordinal", F.posexplode("evidence").alias("k", "e"))
    hits = each.select("file_id", (F.shiftleft(F.col("ordinal").cast("long"), 32) + F.col("k")).alias("hit"), "e.start", "e.end", "e.quote", "e.line")
    boxes = ocr.hit_evidence(hits.drop("line"), placed).join(hits.select("file_id", "hit", "line"), ["file_id", "hit"])
    made = _boxed(F.col("type") == "text-span", "start", "end", "line")
    again = boxes.groupBy("file_id", F.shiftright("hit", 32).cast("int").alias("ordinal")).agg(F.array_sort(F.collect_list(F.struct("hit", made.alias("e")))).alias("es"))
    rows = found.drop("evidence").join(again, ["file_id", "ordinal"]).withColumn("evidence", F.transform("es", lambda x: x["e"]))
    out = _candidate(rows, F.col("ordinal") + RULES_AT, "ocr-rule")
    for base, dictionary, (category, title, reason) in _dictionaries(placed.sparkSession, protected_terms, other_clients):
        t = terms.term_regions(placed, dictionary, whole=True).withColumn("type", F.lit("image-region"))
        place = F.row_number().over(Window.partitionBy("file_id").orderBy("number", "first"))
        t = t.select("file_id", (base + place).alias("at"), F.lit(category).alias("category"), F.concat(F.lit(title), "term").alias("title"), F.lit(reason).alias("reason"), terms.slug(F.col("term")).alias("group_id"), F.lit(None).cast("string").alias("rule_id"), F.array(_boxed(F.lit(False))).alias("evidence"))
        out = out.unionByName(_candidate(t, F.col("at"), "protected-term"))
    return out


#: Terms in the order of their findings: some strings, or a table (number, term) of any size.
Terms = DataFrame | list[str] | tuple[str, ...]
#: Up to so many strings are searched for in one pass over the text; more make a table.
FEW_TERMS = 32


def _dictionaries(spark: SparkSession, protected_terms: Terms, other_clients: Terms) -> list[tuple[int, DataFrame, tuple[str, str, str]]]:
    """The first ordinal, the table (number, term) and the wording of each kind of terms that there are."""
    out = []
    for base, words, wording in ((TERMS_AT, protected_terms, PROTECTED), (CLIENTS_AT, other_clients, OTHER_CLIENT)):
        if not isinstance(words, DataFrame):
            named = [(i, w) for i, w in enumerate(words) if w.strip()]
            if not named:
                continue
            words = spark.createDataFrame(named, "number long, term string")
        out.append((base, words, wording))
    return out


def term_candidates(texts: DataFrame, protected_terms: Terms, other_clients: Terms) -> DataFrame | None:
    """A finding a hit of a term in (file_id, text), all of them; a file's are numbered term by term."""
    out = None
    kinds = {TERMS_AT: protected_terms, CLIENTS_AT: other_clients}
    for base, dictionary, (category, title, reason) in _dictionaries(texts.sparkSession, protected_terms, other_clients):
        given = kinds[base]
        if isinstance(given, DataFrame) or len(given) > FEW_TERMS:
            t = terms.find_terms(texts, dictionary, category, title, whole=True)
        else:
            number = F.create_map(*[x for i, w in enumerate(given) for x in (F.lit(w), F.lit(i))])
            t = terms.term_hits(texts, list(given), category, title, whole=True).withColumn("number", number[F.col("term")].cast("long"))
        place = F.row_number().over(Window.partitionBy("file_id").orderBy("number", "start"))
        hit = F.array(F.struct("start", "end", "quote"))
        t = t.withColumn("at", base + place).withColumn("reason", F.lit(reason)).withColumn("rule_id", F.lit(None).cast("string"))
        t = _candidate(t.withColumn("evidence", F.transform(rules.evidence(F.lit(""), hit), lambda e: e.withField("line", F.col("line")))), F.col("at"), "protected-term")
        out = t if out is None else out.unionByName(t)
    return out


def scan(files: DataFrame, protected_terms: Terms, other_clients: Terms, profile_id: str, allow_rules: DataFrame, more: DataFrame | None = None) -> Scan:
    """All text layers over all files, merged, with suggested actions.

    ``files`` as ``read_texts`` gives, with the kind if it has one.  ``allow_rules``: category,
    match_text of the recipient.  ``more``: candidates of other layers.
    """
    spark = files.sparkSession
    ok = files.where("status = 'processed' and text is not null").select("file_id", "text")
    found = text_candidates(ok)
    for other in (term_candidates(ok, protected_terms, other_clients), more):
        found = found if other is None else found.unionByName(other)
    merged = merge.merge(found).withColumn("evidence", F.flatten(F.transform("detections", lambda d: d["evidence"])))
    ready = merged.withColumn("profile_id", F.lit(profile_id)).withColumn("recipient_id", F.lit(0))
    acted = policy.apply_profile(ready, F.broadcast(policy.preset_buckets(spark)), allow_rules.select(F.lit(0).alias("recipient_id"), "category", "match_text"))
    if "kind" in files.columns:
        acted = policy.hidden_override(acted.join(files.select("file_id", F.col("kind").alias("file_kind")), "file_id")).drop("file_kind")
    return Scan(files, acted.drop("profile_id", "recipient_id", "members"))


def read_all(originals: DataFrame) -> DataFrame:
    """Files of every kind (file_id, name, content): kind, format, content, text, model, status and failure_reason.

    A file that cannot be read fails alone: unknown kinds, bytes that are no UTF-8, broken documents.
    PDF text needs an engine that is not here, so PDFs fail with that reason.
    """
    kinds = uploads.detect_kind(originals.withColumn("extension", export.stored_extension(F.col("name"))))
    model = "struct<hidden:array<struct<id:string,kind:string,note:string,quote:string,category:string>>,signed:boolean>"
    none = F.lit(None).cast(model).alias("model")
    shared = ["file_id", "name", "kind", F.col("extension").alias("format"), "content"]
    text = uploads.decode(F.col("content"))
    plain = kinds.where("kind = 'text'").select(*shared, text.alias("text"), none, F.when(text.isNull(), "The file is not valid UTF-8.").alias("failure_reason"))
    image = kinds.where("kind = 'image'").select(*shared, F.lit(None).cast("string").alias("text"), none, F.lit(None).cast("string").alias("failure_reason"))
    unsupported = kinds.where("kind = 'unsupported'").select(*shared, F.lit(None).cast("string").alias("text"), none, F.col("reason").alias("failure_reason"))
    office = kinds.where("kind = 'document' and extension <> 'pdf'")
    models = documents.extract_documents(office.select("file_id", F.col("extension").alias("format"), "content"))
    read = office.select(*shared).join(models.select("file_id", "text", F.struct("hidden", "signed").alias("model"), F.col("error").alias("failure_reason")), "file_id")
    pdf = kinds.where("kind = 'document' and extension = 'pdf'").select(*shared, F.lit(None).cast("string").alias("text"), none, F.lit("PDF text cannot be read here.").alias("failure_reason"))
    out = plain.unionByName(image).unionByName(unsupported).unionByName(read).unionByName(pdf)
    status = F.when(F.col("kind") == "unsupported", "unsupported").when(F.col("failure_reason").isNotNull(), "failed").otherwise("processed")
    return out.withColumn("status", status)


def structure_candidates(files: DataFrame) -> DataFrame:
    """Findings in the structure of images and documents, as ``read_all`` gives them."""
    scans = images.scan_images(files.where("kind = 'image' and status = 'processed'").select("file_id", "content"))
    found = images.image_findings(scans)
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("byte_offset").isNull(), "rule_id"))
    null = F.lit(None)
    picture = _candidate(found.withColumn("reason", F.col("title")).withColumn("evidence", _structure_evidence(null, F.col("byte_offset"), F.col("title"), null)), place + IMAGE_AT, "structure")
    hidden = documents.hidden_candidates(files.where("kind = 'document' and status = 'processed'").select("file_id", "model.hidden"))
    items = hidden.withColumn("reason", F.col("title")).withColumn("evidence", _structure_evidence(F.col("anchor"), null, F.col("title"), F.col("quote")))
    return picture.unionByName(_candidate(items, F.col("ordinal") + HIDDEN_AT, "structure"))


def analyze(files: DataFrame, words: DataFrame, protected_terms: Terms, other_clients: Terms, profile_id: str, allow_rules: DataFrame) -> Scan:
    """Files of all kinds through all layers in one plan.

    ``files`` as ``read_all`` gives, best stored, as each layer reads them.  ``words``: OCR words of
    images (``ocr_candidates``).
    """
    more = structure_candidates(files).unionByName(ocr_candidates(words, protected_terms, other_clients))
    return scan(files, protected_terms, other_clients, profile_id, allow_rules, more)


def carried(result: Scan, previous: DataFrame) -> DataFrame:
    """The scan's findings with ids and decisions of the findings before; new ones are open and named by their place."""
    kept = carry.carry_decisions(result.findings, previous).where("finding_id is not null").select("file_id", "category", "ordinal", "finding_id", "decision")
    named = F.concat_ws("-", F.lit("fnd"), "file_id", "category", "ordinal")
    out = result.findings.join(kept, ["file_id", "category", "ordinal"], "left")
    return out.withColumn("decision", F.coalesce("decision", F.lit("open"))).withColumn("finding_id", F.coalesce("finding_id", named))


def follow_suggestions(findings: DataFrame) -> DataFrame:
    """Open findings decided as suggested; those that need a decision stay open."""
    by = F.when(F.col("suggested_action") == "redact", "redact").when(F.col("suggested_action") == "keep", "keep")
    return findings.withColumn("decision", F.when(F.col("decision") == "open", F.coalesce(by, F.lit("open"))).otherwise(F.col("decision")))


def reviewed_copies(files: DataFrame, findings: DataFrame) -> DataFrame:
    """file_id, name, text of every readable file with its redacted spans replaced."""
    spans = findings.where("decision = 'redact'").select("file_id", F.explode("evidence").alias("e")).where("e.type = 'text-span'").select("file_id", F.col("e.start").alias("start"), F.col("e.end").alias("end"))
    return export.redact_files(files.where("status = 'processed'"), spans).select("file_id", "name", F.col("redacted").alias("text"))


def all_copies(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Reviewed copies of files of all kinds: file_id, name, kind, format, content, notes, residue, error.

    Spans of text are replaced, hidden items and spans of documents removed, boxes of images painted.
    A copy that cannot be made has its error.
    """
    redact = findings.where("decision = 'redact'").select("file_id", F.explode("evidence").alias("e")).select("file_id", "e.*")
    ok = export.exportable(files.withColumn("excluded", F.col("excluded") if "excluded" in files.columns else F.lit(False)))
    by_file = redact.groupBy("file_id").agg(
        F.collect_list(F.when(F.col("type") == "text-span", F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("spans"),
        F.collect_list(F.when(F.col("type") == "image-region", F.struct("x", "y", "w", "h"))).alias("boxes"),
        F.collect_set(F.when(F.col("anchor").startswith("hidden:"), F.substr("anchor", F.lit(8)))).alias("remove"),
    )
    needles = export.needle_plan(_quotes(findings)).where("not skipped").groupBy("file_id").agg(F.collect_list("needle").alias("needles"))
    joined = ok.join(by_file, "file_id", "left").join(needles, "file_id", "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    joined = joined.select("file_id", "name", "kind", "format", "content", "text", empty("spans", "array<struct<start:bigint,end:bigint>>"), empty("boxes", "array<struct<x:double,y:double,w:double,h:double>>"), empty("remove", "array<string>"), empty("needles", "array<string>"))
    none, no_list = F.lit(None).cast("string").alias("error"), F.array().cast("array<string>")
    same = ["file_id", "name", "kind", "format"]
    plain = joined.where("kind = 'text'")
    text = export.redact_files(plain.select(*same, "text"), plain.select("file_id", F.explode("spans").alias("s")).select("file_id", "s.*"))
    text = text.select(*same, F.col("redacted").cast("binary").alias("content"), no_list.alias("notes"), no_list.alias("residue"), none)
    office = joined.where("kind = 'document'")
    made = documents.redact_documents(office.select("file_id", "format", "content", "spans", "remove", "needles"))
    office = office.select(*same).join(made.select("file_id", F.col("redacted").alias("content"), "notes", "residue", "error"), "file_id")
    picture = joined.where("kind = 'image'")
    made = images.redact_images(picture.select("file_id", "content", "boxes"))
    picture = picture.select(*same).join(made.select("file_id", F.col("redacted").alias("content"), no_list.alias("notes"), no_list.alias("residue"), "error"), "file_id")
    return text.unionByName(office).unionByName(picture)


def _quotes(findings: DataFrame) -> DataFrame:
    """(file_id, ordinal, quote, removed) of all quoted evidence of decided findings."""
    rows = findings.where("decision in ('redact', 'keep')").select("file_id", "ordinal", F.col("decision") == "redact", F.explode("evidence").alias("e"))
    return rows.toDF("file_id", "ordinal", "removed", "e").where("e.quote is not null").select("file_id", "ordinal", "removed", "e.quote")


def residue_findings(copies: DataFrame) -> DataFrame:
    """Text that was to be removed and still stands in a copy: findings that need a decision, whatever the profile."""
    found = copies.select("file_id", F.explode("residue").alias("needle"))
    note = F.concat(F.lit('"'), "needle", F.lit('" is still in the reviewed copy.'))
    evidence = _structure_evidence(F.concat(F.lit("residue:"), F.lower("needle")), F.lit(None), note, F.lit(None))
    title, reason = RESIDUE
    return found.select("file_id", F.lit("hidden-data").alias("category"), F.lit(title).alias("title"), F.lit(reason).alias("reason"), F.lit("structure").alias("method"), F.lit("residue").alias("rule_id"), evidence.alias("evidence"), F.lit("needs-decision").alias("suggested_action"), F.lit(False).alias("allowed_by_recipient"))


def export_package_to(files: DataFrame, findings: DataFrame, path: str, status: str, warnings: DataFrame, confirmed: bool) -> tuple[list[str], DataFrame | None]:
    """The gates, then the copies written with safe unique names and their manifest: (errors, manifest).

    Nothing is written if a gate is closed.
    """
    kinds = files.select("file_id", F.col("kind").alias("file_kind"))
    errors = export.export_errors(status, warnings, findings.join(kinds, "file_id"), confirmed)
    if errors:
        return errors, None
    copies = all_copies(files, findings)
    names = export.unique_names(copies.where("error is null").select(F.lit(0).cast("long").alias("package_id"), F.col("file_id").alias("ordinal"), export.export_name(F.col("name")).alias("name")))
    named = copies.join(names.select(F.col("ordinal").alias("file_id"), "package_id", "unique_name"), "file_id", "left")
    written = write_copies(named, path)
    return [], export.manifest(written.where("error is null"))


def write_copies(copies: DataFrame, path: str) -> DataFrame:
    """The copies written, and read again from where they were written."""
    copies.write.mode("overwrite").parquet(path)
    return copies.sparkSession.read.parquet(path)


def verify(copies: DataFrame, findings: DataFrame, protected_terms: Terms, other_clients: Terms, profile_id: str, allow_rules: DataFrame) -> DataFrame:
    """Findings of the written copies, each with the original it repeats (null for new ones)."""
    again = scan(copies.withColumn("status", F.lit("processed")).withColumn("failure_reason", F.lit(None).cast("string")), protected_terms, other_clients, profile_id, allow_rules)
    return carry.verify_match(again.findings, findings)


def verify_all(copies: DataFrame, findings: DataFrame, words: DataFrame, protected_terms: Terms, other_clients: Terms, profile_id: str, allow_rules: DataFrame) -> DataFrame:
    """Findings of written copies of all kinds, each with the original it repeats (null for new ones).

    ``copies`` as ``write_copies`` gives: what was written is read and goes through all layers again,
    and what was removed from documents is looked for in all that can be read out of them.  Residue
    takes no profile, so no rule of the recipient hides it.  ``words``: OCR words of the image copies.
    """
    made = copies.where("error is null")
    again = analyze(read_all(made.select("file_id", "name", "content")), words, protected_terms, other_clients, profile_id, allow_rules).findings
    views = residue.document_views(made.where("kind = 'document'").select("file_id", "format", "content"))
    left = residue.find_needles(views, export.needle_plan(_quotes(findings)).where("not skipped").select("file_id", "needle"))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("evidence")[0]["note"]))
    left = residue_findings(left.select("file_id", F.array("needle").alias("residue"))).withColumn("ordinal", RESIDUE_AT + place)
    keep = ["file_id", "category", "ordinal", "evidence"]
    return carry.verify_match(again.select(*keep).unionByName(left.select(*keep)), findings)


#: Wording of a verification.
NO_OPEN_FINDINGS = "Reviewed. No open detected findings."
OPEN_FINDINGS = " open findings on the reviewed copies. Decide on the original files, then export again."


def verification(matched: DataFrame) -> DataFrame:
    """One row: the status of a verification, its text, and how many findings are open, reported and new."""
    n = F.col("open_findings")
    text = F.when(n == 0, NO_OPEN_FINDINGS).otherwise(F.concat(n, F.lit(OPEN_FINDINGS)))
    return carry.still_open(matched).select(F.when(n == 0, "no-open-findings").otherwise("open-findings").alias("status"), text.alias("text"), "open_findings", "reported", "new_findings")


# -- queries

TERMS = ["heron", "Project Juniper"]
CLIENTS = ["Acme Corp"]
ALLOW = [("personal-contact", "b@c.de")]


def _example(spark: SparkSession, sf_dir: str) -> Scan:
    f = review_files(spark, sf_dir).withColumn("content", F.when(F.col("file_id") % 41 == 5, F.unhex(F.lit("FF00"))).otherwise(F.col("text").cast("binary")))
    return scan(read_texts(f), TERMS, CLIENTS, "profile-client", spark.createDataFrame(ALLOW, "category string, match_text string"))


def scan_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _example(spark, sf_dir).findings.select("file_id", "category", "ordinal", "title", F.size("evidence").cast("long").alias("places"), "suggested_action", "allowed_by_recipient")


def scan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _example(spark, sf_dir)
    f = s.files.select("file_id", "status", "failure_reason", F.lit("done").alias("ai_analysis"), F.lit(False).alias("excluded"))
    c = package.coverage(f, s.findings.withColumn("decision", F.lit("open")))
    return c.select("files_total", "files_processed", F.size("files_failed").cast("long").alias("files_failed"), F.col("findings_open").cast("long").alias("findings_open"))


def export_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _example(spark, sf_dir)
    decided = follow_suggestions(s.findings.withColumn("decision", F.lit("open")))
    return reviewed_copies(s.files, decided).select("file_id", F.md5("text").alias("digest"))


def verify_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing that was redacted may be found in the copies again."""
    s = _example(spark, sf_dir)
    named = s.findings.withColumn("decision", F.lit("open")).withColumn("finding_id", F.concat_ws("-", "file_id", "category", "ordinal"))
    decided = follow_suggestions(named)
    found = verify(reviewed_copies(s.files, decided), decided, TERMS, CLIENTS, "profile-client", spark.createDataFrame(ALLOW, "category string, match_text string"))
    return found.groupBy("category", "decision").agg(F.count("*").alias("findings"))


QUERIES = {f.__name__: f for f in (scan_package, scan_coverage, export_package, verify_package)}
ORACLES: dict[str, str] = {}
