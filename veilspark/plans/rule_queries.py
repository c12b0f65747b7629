"""Queries of the rule scan, validators, hidden text and terms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import regex, spans, validators
from veilspark.operators import rules, terms
from veilspark.plans.inputs import FILES_SQL, files, hits_sql, line_sql, quote

TERMS = ["heron", "the heron", "Acme", "license", "C++", "cc by", "Stätte", "  stupid "]

DIGITS = "regexp_replace({q}, '[^0-9]', '', 'g')"
CHARS = "list_filter(string_split({q}, ''), lambda c: c <> '')"


def _luhn_sql(d: str) -> str:
    v = "CAST(substr({d}, length({d}) - i + 1, 1) AS INT)".format(d=d)
    return f"(length({d}) > 0 AND regexp_full_match({d}, '[0-9]+') AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {v} WHEN {v} * 2 > 9 THEN {v} * 2 - 9 ELSE {v} * 2 END)) % 10 = 0)"


def _iban_sql(q: str) -> str:
    p = f"replace({q}, ' ', '')"
    t = f"(substr({p}, 5) || substr({p}, 1, 4))"
    digits = f"array_to_string(list_transform({CHARS.format(q=t)}, lambda c: CASE WHEN ascii(c) < 58 THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '')"
    rest = f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({digits}, ''), lambda c: CAST(c AS BIGINT))), lambda a, b: (a * 10 + b) % 97)"
    return f"(length({p}) BETWEEN 15 AND 32 AND regexp_full_match({p}, '[0-9A-Z]+') AND {rest} = 1)"


def entropy_sql(q: str) -> str:
    share = f"(length({q}) - length(replace({q}, c, ''))) / CAST(length({q}) AS DOUBLE)"
    return f"coalesce(list_sum(list_transform(list_distinct({CHARS.format(q=q)}), lambda c: - ({share}) * log2({share}))), 0.0)"


def _ipv4_sql(q: str) -> str:
    p = f"string_split({q}, '.')"
    n = lambda i: f"TRY_CAST({p}[{i}] AS INT)"
    return f"(len({p}) = 4 AND {n(2)} <= 255 AND {n(3)} <= 255 AND {n(4)} <= 255 AND ({n(1)} IN (10, 192) OR ({n(1)} = 172 AND {n(2)} BETWEEN 16 AND 31)))"


VALID_SQL = {
    "connection-string": lambda q: f"(strpos({q}, '://') > 0 AND strpos(substr({q}, strpos({q}, '://') + 3), '@') > 0 AND contains(split_part(substr({q}, strpos({q}, '://') + 3), '@', 1), ':'))",
    "dotenv-high-entropy": lambda q: (lambda v: f"(length({v}) >= 20 AND {entropy_sql(v)} >= 4.0)")(f"trim(replace(replace(substr({q}, strpos({q}, '=') + 1), chr(34), ''), chr(39), ''))"),
    "private-ipv4": _ipv4_sql,
    "internal-hostname": lambda q: f"len(list_intersect(string_split_regex(lower({q}), '[.-]'), [{', '.join(quote(w) for w in validators.INFRA_WORDS)}])) > 0",
    "phone": lambda q: f"length({DIGITS.format(q=q)}) BETWEEN 7 AND 15",
    "credit-card": lambda q: (lambda d: f"(length({d}) BETWEEN 13 AND 19 AND {_luhn_sql(d)})")(f"replace(replace({q}, ' ', ''), '-', '')"),
    "iban": _iban_sql,
}


def valid_hits_sql(rule: rules.Rule, text: str = "text", whole: bool = False) -> str:
    found = hits_sql(text, rule.re2)
    if rule.id in VALID_SQL:
        found = f"list_filter({found}, lambda h: {VALID_SQL[rule.id]('h.q')})"
    return found if whole else f"list_slice({found}, 1, {rules.MOST_HITS})"


def _scan(rule: rules.Rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rules.hit_rows(files(spark, sf_dir), (rule,)).select("file_id", "start", "end", "line", "quote")

    return run


def _scan_sql(rule: rules.Rule) -> str:
    return f"""WITH {FILES_SQL}, h AS (SELECT file_id, text, unnest({valid_hits_sql(rule)}) AS h FROM files)
SELECT file_id, h.s AS start, h.e AS "end", {line_sql("text", "h.s")} AS line, h.q AS quote FROM h"""


def all_hits_sql(whole: bool = False) -> str:
    """CTE ``hits``: the validated hits of every rule, MOST_HITS at most of each in a text if not ``whole``."""
    each = " UNION ALL ".join(f"SELECT file_id, {i} AS ordinal, {quote(r.id)} AS rule_id, {quote(r.category)} AS category, text, unnest({valid_hits_sql(r, whole=whole)}) AS h FROM files" for i, r in enumerate(rules.RULES))
    return f"""hits AS (SELECT file_id, ordinal, rule_id, category, h.s AS start, h.e AS "end", {line_sql("text", "h.s")} AS line, h.q AS quote FROM ({each}))"""


def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rules.candidates(files(spark, sf_dir), rules.RULES).where(F.col("ordinal") < len(rules.RULES))
    return c.select("file_id", "rule_id", "category", "title", F.size("evidence").cast("long").alias("n_hits"), F.element_at("evidence", 1)["start"].alias("first_start"), F.element_at("evidence", -1)["quote"].alias("last_quote"))


def _candidates_sql() -> str:
    title = "CASE rule_id " + " ".join(f"WHEN {quote(r.id)} THEN {quote(r.title)}" for r in rules.RULES) + " END"
    return f'WITH {FILES_SQL}, {all_hits_sql()} SELECT file_id, rule_id, category, {title} AS title, count(*) AS n_hits, min(start) AS first_start, arg_max(quote, start) AS last_quote FROM hits GROUP BY file_id, rule_id, category'


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.hit_rows(files(spark, sf_dir))


def zero_width_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Some texts begin with a byte order mark, alone or within a run.
    f = files(spark, sf_dir).withColumn("text", F.concat(F.element_at(F.array(F.lit(""), F.lit("﻿"), F.lit("﻿​")), (F.col("file_id") % 3 + 1).cast("int")), "text"))
    return spans.rows_of(f, ["file_id"], rules.zero_width_ranges("text"), "h").select("file_id", "h.start", "h.end")


def _zero_sql() -> str:
    h = hits_sql("t", f"[{rules.ZERO_WIDTH}]+")
    return f"""WITH {FILES_SQL}, f AS (SELECT file_id, (['', chr(65279), chr(65279) || chr(8203)])[file_id % 3 + 1] || text AS t FROM files),
h AS (SELECT file_id, unnest(list_slice(list_filter(list_transform({h}, lambda x: {{'s': CASE WHEN x.s = 0 AND starts_with(x.q, chr(65279)) THEN CAST(1 AS BIGINT) ELSE x.s END, 'e': x.e}}), lambda x: x.e > x.s), 1, 20)) AS h FROM f)
SELECT file_id, h.s AS start, h.e AS "end" FROM h"""


def injection_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = F.transform(rules.injection_ranges("text"), lambda h, n: h.withField("n", n.cast("long")))
    return spans.rows_of(files(spark, sf_dir), ["file_id"], numbered, "h").select("file_id", "h.n", "h.start", "h.end", "h.quote")


def _injection_sql() -> str:
    each = ", ".join(hits_sql("lower(text)", regex.literal(p)) for p in rules.INJECTION_PHRASES)
    return f"""WITH {FILES_SQL}, a AS (SELECT file_id, text, flatten([{each}]) AS hs FROM files),
h AS (SELECT file_id, text, unnest(list_sort(hs)) AS h, generate_subscripts(list_sort(hs), 1) - 1 AS n FROM a WHERE len(hs) < 20)
SELECT file_id, n, h.s AS start, h.e AS "end", substr(text, h.s + 1, h.e - h.s) AS quote FROM h"""


def entropy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.round(validators.entropy(F.concat("c_name", "c_mktsegment")), 6).alias("entropy"))


def validator_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    digits = F.lpad(F.col("c_custkey").cast("string"), 8, "4")
    number = F.concat(digits, F.lit("01"), F.reverse(digits))
    ip = F.concat_ws(".", F.element_at(F.array(*map(F.lit, ("10", "172", "192", "11"))), (F.col("c_custkey") % 4 + 1).cast("int")), (F.col("c_custkey") % 300).cast("string"), F.lit("7"), F.lit("9"))
    ib = F.concat(F.lit("DE"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit(" 3704 0044 0532 01"), F.lpad((F.col("c_custkey") % 97).cast("string"), 4, "0"))
    return c.select("c_custkey", validators.card(number).alias("card"), validators.private_ipv4(ip).alias("ipv4"), validators.iban(ib).alias("iban"), validators.internal_host(F.concat(F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "-dev.x").otherwise(".y"))).alias("host"), validators.phone(number).alias("phone"))


def _flags_sql() -> str:
    digits = "lpad(CAST(c_custkey AS VARCHAR), 8, '4')"
    number = f"({digits} || '01' || reverse({digits}))"
    ip = "((['10', '172', '192', '11'])[c_custkey % 4 + 1] || '.' || (c_custkey % 300) || '.7.9')"
    ib = "('DE' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || ' 3704 0044 0532 01' || lpad(CAST(c_custkey % 97 AS VARCHAR), 4, '0'))"
    host = "(lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN '-dev.x' ELSE '.y' END)"
    v = VALID_SQL
    return f"SELECT c_custkey, {v['credit-card']('n')} AS card, {v['private-ipv4']('ip')} AS ipv4, {v['iban']('ib')} AS iban, {v['internal-hostname']('host')} AS host, {v['phone']('n')} AS phone FROM (SELECT c_custkey, {number} AS n, {ip} AS ip, {ib} AS ib, {host} AS host FROM customer)"


def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_hits(files(spark, sf_dir), TERMS)


def term_hits_sql(term: str, whole: bool = False) -> str:
    """SQL for the list of hits of a term, 50 at most if not ``whole``."""
    found = hits_sql("text", regex.re2(chr(92) + "b" + regex.literal(term.strip()) + chr(92) + "b", True))
    return found if whole else f"list_slice({found}, 1, 50)"


def term_sql(words: list[str], category: str, title: str, whole: bool = False) -> str:
    each = " UNION ALL ".join(f"SELECT file_id, text, {quote(t)} AS term, unnest({term_hits_sql(t, whole)}) AS h FROM files" for t in words)
    return f"""WITH {FILES_SQL}, h AS ({each})
SELECT file_id, '{category}' AS category, term, {slug_sql("term")} AS group_id, {quote(title)} || term AS title, h.s AS start, h.e AS "end", {line_sql("text", "h.s")} AS line, h.q AS quote FROM h"""


def slug_sql(t: str) -> str:
    return f"'rel-' || coalesce(nullif(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'term')"


#: Recipients of the example package: the regions; the package goes to region 0.
def other_client_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipients = spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("r_regionkey as id", "r_name as name")
    f = files(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" for Asia, AMERICA or Middle East")))
    return terms.find_terms(f, terms.other_clients(recipients, 0), "other-client", "Other client: ").drop("number")


def _clients_sql() -> str:
    return f"""WITH {FILES_SQL}, f AS (SELECT file_id, text || ' for Asia, AMERICA or Middle East' AS text FROM files),
c AS (SELECT r_name AS term FROM region WHERE r_regionkey <> 0),
j AS (SELECT file_id, text, term, '(?i)\\b' || term || '\\b' AS p FROM f, c WHERE regexp_matches(text, '(?i)\\b' || term || '\\b')),
k AS (SELECT *, regexp_extract_all(text, p) AS m, string_split_regex(text, p) AS g FROM j),
h AS (SELECT file_id, text, term, unnest(range(1, len(m) + 1)) AS i, m, g FROM k),
x AS (SELECT file_id, text, term, m[i] AS q, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM h WHERE i <= 50)
SELECT file_id, 'other-client' AS category, term, {slug_sql("term")} AS group_id, 'Other client: ' || term AS title, s AS start, s + length(q) AS "end", {line_sql("text", "s")} AS line, q AS quote FROM x"""


def related_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.related_exact(files(spark, sf_dir), " mit license ")


#: A dictionary that grows with the table: two words of every document.
PHRASE = "^[^ ]* ([A-Za-z]+ [A-Za-z]+) "


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(number, term): a phrase of each document, of those that repeat one the first."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.regexp_extract("text", PHRASE, 1).alias("term"))
    return d.where("term <> ''").groupBy("term").agg(F.min("doc_id").alias("number")).select("number", "term")


def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phrase in every file."""
    return terms.find_terms(files(spark, sf_dir), phrases(spark, sf_dir)).select("file_id", "number", "start", "end", "line", "quote")


def _dictionary_sql() -> str:
    p = "'(?i)\\b' || term || '\\b'"
    return f"""WITH {FILES_SQL}, t AS (SELECT term, min(doc_id) AS number FROM (SELECT doc_id, regexp_extract(text, {quote(PHRASE)}, 1) AS term FROM documents) WHERE term <> '' GROUP BY term),
l AS (SELECT file_id, text, lower(text) AS low FROM files),
j AS (SELECT file_id, text, number, {p} AS p FROM l JOIN t ON contains(low, lower(term))),
k AS (SELECT *, regexp_extract_all(text, p) AS m, string_split_regex(text, p) AS g FROM j),
h AS (SELECT file_id, text, number, unnest(range(1, len(m) + 1)) AS i, m, g FROM k),
x AS (SELECT file_id, text, number, m[i] AS q, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM h WHERE i <= 50)
SELECT file_id, number, s AS start, s + length(q) AS "end", {line_sql("text", "s")} AS line, q AS quote FROM x"""


def slug_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", terms.slug(F.concat(F.lit(" "), "p_name", F.lit("/"), "p_brand", F.lit("!"))).alias("slug"))


QUERIES = {f"rule_scan_{r.id.replace('-', '_')}": _scan(r) for r in rules.RULES} | {f.__name__: f for f in (rule_hits, rule_candidates, zero_width_runs, injection_phrases, entropy_values, validator_flags, term_hits, other_client_hits, term_dictionary, related_exact, slug_terms)}
ORACLES = {f"rule_scan_{r.id.replace('-', '_')}": _scan_sql(r) for r in rules.RULES} | {
    "rule_hits": f'WITH {FILES_SQL}, {all_hits_sql()} SELECT file_id, rule_id, category, start, "end", line, quote FROM hits',
    "rule_candidates": _candidates_sql(),
    "zero_width_runs": _zero_sql(),
    "injection_phrases": _injection_sql(),
    "entropy_values": f"SELECT c_custkey, round({entropy_sql('v')}, 6) AS entropy FROM (SELECT c_custkey, c_name || c_mktsegment AS v FROM customer)",
    "validator_flags": _flags_sql(),
    "term_hits": term_sql(TERMS, "protected-term", "Protected term: "),
    "other_client_hits": _clients_sql(),
    "term_dictionary": _dictionary_sql(),
    "related_exact": term_sql(["mit license"], "protected-term", "Related: "),
    "slug_terms": f"SELECT p_partkey, {slug_sql(chr(39) + ' ' + chr(39) + ' || p_name || ' + chr(39) + '/' + chr(39) + ' || p_brand || ' + chr(39) + '!' + chr(39))} AS slug FROM part",
}
