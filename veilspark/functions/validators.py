"""Checks of matched quotes, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a host name that tell of internal infrastructure (fixed values).
INFRA_WORDS = ("internal", "staging", "dev", "corp", "local", "localhost")


def digits_of(q: Column) -> Column:
    return F.regexp_replace(q, "[^0-9]", "")


def chars(q: Column) -> Column:
    return F.filter(F.split(q, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def card(q: Column) -> Column:
    plain = F.translate(q, " -", "")
    return F.length(plain).between(13, 19) & luhn(plain)


def iban(q: Column) -> Column:
    """Rest 1 modulo 97 after the first four characters move to the end and letters count from 10."""
    plain = F.replace(q, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    code = lambda c: F.ascii(c) - F.when(F.ascii(c) < 58, 48).otherwise(55)
    rest = F.aggregate(chars(turned), F.lit(0).cast("bigint"), lambda r, c: (r * F.when(F.ascii(c) < 58, 10).otherwise(100) + code(c)) % 97)
    return F.length(plain).between(15, 32) & plain.rlike("^[0-9A-Z]+$") & (rest == 1)


def private_ipv4(q: Column) -> Column:
    parts = F.split(q, r"\.")
    n = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    small = F.forall(F.slice(parts, 2, 3), lambda p: p.rlike("^[0-9]{1,3}$") & (p.try_cast("int") <= 255))
    return F.coalesce((F.size(parts) == 4) & small & (n(1).isin(10, 192) | ((n(1) == 172) & n(2).between(16, 31))), F.lit(False))


def internal_host(q: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(q), "[.-]"), F.array(*map(F.lit, INFRA_WORDS)))


def phone(q: Column) -> Column:
    return F.length(digits_of(q)).between(7, 15)


def connection_string(q: Column) -> Column:
    after = F.substr(q, F.locate("://", q) + 3)
    return (F.locate("://", q) > 0) & (F.locate("@", after) > 0) & F.substring_index(after, "@", 1).contains(":")


def entropy(q: Column) -> Column:
    """Shannon entropy in bits a character; 0 for the empty string."""
    all_chars = chars(q)
    n = F.length(q)
    share = lambda c: F.size(F.filter(all_chars, lambda d: d == c)) / n
    kinds = F.array_sort(F.array_distinct(all_chars))
    return F.aggregate(kinds, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def dotenv_secret(q: Column) -> Column:
    value = F.trim(F.translate(F.substr(q, F.locate("=", q) + 1), "\"'", ""))
    return (F.locate("=", q) > 0) & (F.length(value) >= 20) & (entropy(value) >= 4.0)
