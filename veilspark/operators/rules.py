"""Rule scan: the table of regex rules, their hits with offsets, and findings per file and rule.

All rules run in one projection with literal patterns, so each compiles once and the text is
read once; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import regex, spans, validators

#: Validated hits kept of a rule in a text, and zero-width or instruction ranges, as surveyed (fixed values); ``whole`` scans keep all.
MOST_HITS = 50
MOST_RANGES = 20


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    title: str
    reason: str
    source: str
    insensitive: bool = False
    multiline: bool = False
    valid: Callable[[Column], Column] | None = None
    gate: str | None = None
    #: Words of which every validated hit holds one, in any case; and how every match begins, which is quicker to tell than its border.
    words: tuple[str, ...] = ()
    ahead: str | None = None

    @property
    def java(self) -> str:
        return regex.java((f"(?={self.ahead})" if self.ahead else "") + self.source, self.insensitive, self.multiline)

    @property
    def re2(self) -> str:
        return regex.re2(self.source, self.insensitive, self.multiline)


#: Ids, categories, wording and patterns of the rules, in scan order.
RULES = (
    Rule("private-key", "secret", "Private key", "This private key gives full access to whatever it protects.", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", gate="-----BEGIN "),
    Rule("aws-access-key", "secret", "AWS access key", "This AWS key can give access to cloud resources and data.", r"AKIA[0-9A-Z]{16}", gate="AKIA"),
    Rule("github-token", "secret", "GitHub token", "This token can give access to source code repositories.", r"(?:ghp_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})", gate="gh"),
    Rule("slack-token", "secret", "Slack token", "This token can give access to chat history and workspaces.", r"xox[bpas]-[A-Za-z0-9-]{10,}", gate="xox"),
    Rule("stripe-key", "secret", "Stripe key", "This key can move money and read customer payment data.", r"(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}", gate="k_"),
    Rule("google-api-key", "secret", "Google API key", "This key can be used to call Google services on your behalf.", r"AIza[0-9A-Za-z\-_]{35}", gate="AIza"),
    Rule("openai-style-key", "secret", "Possible access token", "This can give access to an account.", r"sk-[A-Za-z0-9-]{20,}", gate="sk-"),
    Rule("jwt", "secret", "JSON web token", "This token can give access to an account or session.", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", gate="eyJ"),
    Rule("credential-assignment", "secret", "Hardcoded credential", "A password, secret, or token is written directly in the file.", r"""(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[:=]\s*["']?[^\s"'\n;]{4,}""", insensitive=True, words=("password", "passwd", "pwd", "secret", "token", "api")),
    Rule("connection-string", "secret", "Connection string with credentials", "This connection string contains a username and password.", r"""(?:postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'\n]+""", insensitive=True, valid=validators.connection_string, gate="://"),
    Rule("dotenv-high-entropy", "secret", "High-entropy secret value", "This configured value looks randomly generated, like a secret.", r"^[A-Z][A-Z0-9_]{2,}=[^\n]{8,}$", multiline=True, valid=validators.dotenv_secret, gate="="),
    Rule("private-ipv4", "internal-infra", "Private IP address", "This address reveals internal network layout.", r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b", valid=validators.private_ipv4, gate=".", ahead="1[079]"),
    Rule("internal-hostname", "internal-infra", "Internal hostname", "This hostname reveals internal infrastructure.", r"\b(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|localhost)\b", insensitive=True, valid=validators.internal_host, words=validators.INFRA_WORDS),
    Rule("email", "personal-contact", "Email address", "This email address identifies a person.", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", gate="@"),
    Rule("phone", "personal-contact", "Phone number", "This phone number identifies a person.", r"\+[0-9][0-9\s().-]{7,}[0-9]", valid=validators.phone, gate="+"),
    Rule("credit-card", "personal-id", "Card number", "This looks like a payment card number.", r"\b(?:\d[ -]?){13,19}\b", valid=validators.card, ahead="[0-9]"),
    Rule("iban", "personal-id", "Bank account number", "This looks like an international bank account number.", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,28}\b", valid=validators.iban, ahead="[A-Z]{2}[0-9]"),
)
BY_ID = {r.id: r for r in RULES}

#: Characters of no width, and instruction phrases in search order.
ZERO_WIDTH = "​‌‍⁠﻿"
INJECTION_PHRASES = (
    "ignore previous instructions",
    "ignore all previous instructions",
    "disregard previous instructions",
    "mark this file as safe",
    "mark this as safe",
    "you are an ai",
    "you are now",
    "follow these new instructions",
)
HIDDEN_TEXT = ("zero-width-chars", "hidden-data", "Hidden zero-width characters", "Invisible characters can hide text from a reader.")
INJECTION = ("prompt-injection", "prompt-injection", "Instructions for an AI", "The text tries to instruct the tool that reads it.")


def _scan(text: Column | str, rule: Rule, loud: Column, whole: bool = False) -> Column:
    return spans.hits(text, rule.java, spans.may_hold(loud, *rule.words) if rule.words else rule.gate, rule.valid, None if whole else MOST_HITS, lines=True)


@spans.built_once
def scan_rule(text: Column | str, rule: Rule, whole: bool = False) -> Column:
    """Validated hits of one rule, with their lines, MOST_HITS at most if not ``whole``; a match that fails is not retried shorter."""
    return spans.let(spans.loud(text), lambda loud: _scan(text, rule, loud, whole)) if rule.words else _scan(text, rule, F.lit(None), whole)


def zero_width_ranges(text: Column | str, whole: bool = False) -> Column:
    """Runs of zero-width characters; a byte order mark at the very start does not count."""
    text = F.col(text) if isinstance(text, str) else text
    runs = spans.hits(text, f"[{ZERO_WIDTH}]+", reduce(Column.__or__, [text.contains(c) for c in ZERO_WIDTH]))
    cut = lambda h: (h["start"] == 0) & h["quote"].startswith("﻿")
    later = F.transform(runs, lambda h: F.when(cut(h), F.struct(F.lit(1).cast("bigint").alias("start"), h["end"].alias("end"), F.substr(h["quote"], F.lit(2)).alias("quote"))).otherwise(h))
    found = F.filter(later, lambda h: h["end"] > h["start"])
    return found if whole else F.slice(found, 1, MOST_RANGES)


def injection_ranges(text: Column | str, whole: bool = False) -> Column:
    """Phrase matches sorted by start; when the limit is reached and not ``whole``, the first ones in phrase order, unsorted."""
    text = F.col(text) if isinstance(text, str) else text
    found = spans.let(F.lower(text), lambda low: F.flatten(F.array(*[spans.hits(low, regex.literal(p), p) for p in INJECTION_PHRASES])))
    pure = lambda found: F.transform(found, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.substr(text, (h["start"] + 1).cast("int"), (h["end"] - h["start"]).cast("int")).alias("quote")))
    if whole:
        return F.array_sort(pure(found))
    return spans.let(found, lambda f: F.when(F.size(f) >= MOST_RANGES, F.slice(pure(f), 1, MOST_RANGES)).otherwise(F.array_sort(pure(f))))


@spans.built_once
def _each_hit(rules: tuple[Rule, ...], whole: bool) -> Column:
    return spans.let(spans.loud("text"), lambda loud: F.flatten(F.array(*[spans.tagged(_scan("text", r, loud, whole), "rule_id", F.lit(r.id)) for r in rules])))


def hit_rows(files: DataFrame, rules: tuple[Rule, ...] = RULES, whole: bool = False) -> DataFrame:
    """(file_id, rule_id, category, start, end, line, quote), a row per hit, MOST_HITS at most of a rule in a text if not ``whole``."""
    category = F.create_map(*[x for r in rules for x in (F.lit(r.id), F.lit(r.category))])
    rows = spans.rows_of(files, ["file_id"], _each_hit(tuple(rules), whole), "h").select("file_id", "h.*")
    return rows.select("file_id", "rule_id", category[F.col("rule_id")].alias("category"), "start", "end", "line", "quote")


@spans.built_once
def _each_candidate(rules: tuple[Rule, ...], whole: bool) -> Column:
    keys = ("rule_id", "category", "title", "reason")

    def each(loud: Column) -> Column:
        named = [((r.id, r.category, r.title, r.reason), evidence("text", _scan("text", r, loud, whole), lines=True)) for r in rules]
        named += [(HIDDEN_TEXT, evidence("text", zero_width_ranges("text", whole))), (INJECTION, evidence("text", injection_ranges("text", whole)))]
        return F.array(*[F.struct(F.lit(i).alias("ordinal"), *[F.lit(v).alias(k) for k, v in zip(keys, words)], found.alias("evidence")) for i, (words, found) in enumerate(named)])

    return F.filter(spans.let(spans.loud("text"), each), lambda r: F.size(r["evidence"]) > 0)


def candidates(files: DataFrame, rules: tuple[Rule, ...] = RULES, whole: bool = False) -> DataFrame:
    """One finding a file and rule, with its hits as evidence, in rule order; then hidden text and instructions.

    If not ``whole``, the first MOST_HITS of a rule and MOST_RANGES of the others are the evidence.
    """
    return spans.rows_of(files, ["file_id"], _each_candidate(tuple(rules), whole), "r").select("file_id", "r.*")


EVIDENCE = "struct<type:string,start:bigint,end:bigint,line:int,quote:string,x:double,y:double,w:double,h:double,anchor:string,byte_offset:bigint,note:string>"


def evidence(text: Column | str, found: Column, lines: bool = False) -> Column:
    """Hits as text-span evidence; ``lines``: they know theirs."""
    null = lambda t: F.lit(None).cast(t)
    return F.transform(found, lambda h: F.struct(F.lit("text-span").alias("type"), h["start"].alias("start"), h["end"].alias("end"), (h["line"] if lines else spans.line_at(text, h["start"])).alias("line"), h["quote"].alias("quote"), *[null("double").alias(k) for k in "xywh"], null("string").alias("anchor"), null("bigint").alias("byte_offset"), null("string").alias("note")))
