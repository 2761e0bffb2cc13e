r"""PII spans: regular expressions propose, checksums and range tests confirm, nearby context words adjust the score.

Built-in functions only. For each kind, `regexp_extract_all` gives the matches and `split` by the same pattern the text
between them, so a fold over both gives each match's place in code points.

Kinds: email, ip (parts at most 255), card (13 to 19 digits passing Luhn), phone (9 to 15 digits), and by this method
iban (mod-97 equal to 1; of a listed country's length, else of any). Failing matches are dropped without retry. The patterns below match what the plain forms in
PLAIN match, but in time linear in the text: a match may only start where a run of its first class starts (or where the
last match ended), card lengths are bounded, and repeats are possessive where nothing can follow.

A span's score is BASE (WEAK for an iban that is not of a listed country and its length) plus NEAR if one of the kind's
context words stands within REACH code points on either side (up to the neighbouring match of the kind). Spans of the
added kind need a score of LEAST: a weak one counts only beside a context word. Base kinds stay whatever their score.

Defined cases: a null or empty text has no spans; repeated rows give repeated result rows; an empty
table gives no rows; a long text is scanned whole, in memory of a few times its size; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import table, text_of

#: The length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
_UNLISTED = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
#: The plain patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"\b(?:{_LISTED}|{_UNLISTED})\b",
}
#: The same matches (cards: those of 13 to 19 digits), each found in linear time.
PATTERNS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?=[A-Z]{{2}}[0-9]{{2}})(?<![A-Za-z0-9_])(?:{_LISTED}|{_UNLISTED})(?![A-Za-z0-9_])",
}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")
#: A text without this character class has no match of the kind.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}"}
CONTEXT = {
    "email": r"mail|contact|write|address|reach",
    "ip": r"\b(ip|host|server|address|login)\b",
    "card": r"card|visa|credit|debit|payment|account",
    "phone": r"phone|call|tel|mobile|fax|contact",
    "iban": r"iban|bank|account|transfer|konto",
}
BASE, WEAK, NEAR, LEAST, REACH = 0.6, 0.4, 0.3, 0.6, 40


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(match: Column) -> Column:
    code = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.length(code).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c))) == 1)


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}\z")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return _mod97(match) if kind == "iban" else F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _spans(kind: str, text: str) -> Column:
    """The confirmed spans of one kind in column `text`, in order."""
    pattern = PATTERNS[kind]
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    triples = F.zip_with(F.arrays_zip(gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next")), matches, lambda g, m: F.struct(g["gap"].alias("gap"), g["next"].alias("next"), m.alias("match")))
    triples = F.filter(triples, lambda t: t["match"].isNotNull())

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["gap"])
        end = start + F.length(t["match"])
        around = F.lower(F.concat(F.right(t["gap"], F.lit(REACH)), F.lit("\n"), F.left(t["next"], F.lit(REACH))))
        base = F.when(t["match"].rlike(rf"^(?:{_LISTED})\z"), BASE).otherwise(WEAK) if kind == "iban" else F.lit(BASE)
        score = base + F.when(around.rlike(CONTEXT[kind]), NEAR).otherwise(0.0)
        counts = _confirmed(kind, t["match"]) & (F.lit(True) if kind in BASE_KINDS else score >= LEAST)
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score")))
        return F.struct(end.alias("at"), F.when(counts, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast(_SPAN)
    found = F.aggregate(triples, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.col(text).rlike(NEEDS[kind]), found).otherwise(none)


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): an array of (kind, start, end, score), by kind in the order of KINDS, then start; end is exclusive."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    return rows.select("doc_id", F.concat(*[_spans(k, "t") for k in KINDS]).alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "iban")
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    scores = F.array_join(F.transform("spans", lambda s: F.format_string("%.1f", s["score"])), ",")
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), scores.alias("scores"))


_DIGITS = "regexp_replace(z.x, '[^0-9]', '', 'g')"
_CODE = "replace(z.x, ' ', '')"
_AS_NUMBER = f"array_to_string(list_transform(string_split(substr({_CODE}, 5) || left({_CODE}, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '')"
_SQL_TESTS = {
    "email": "true",
    "ip": "len(list_filter(string_split(z.x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN c > '4' THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": f"length({_CODE}) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split({_AS_NUMBER}, ''), lambda c: CAST(c AS INT)), lambda a, b: (a * 10 + b) % 97) = 1",
}


def _sql_score(kind: str) -> str:
    base = f"CASE WHEN regexp_full_match(m[i], '{_LISTED}') THEN {BASE} ELSE {WEAK} END" if kind == "iban" else str(BASE)
    return f"CAST({base} + CASE WHEN regexp_matches(lower(right(g[i], {REACH}) || chr(10) || left(g[i + 1], {REACH})), '{CONTEXT[kind]}') THEN {NEAR} ELSE 0 END AS DOUBLE)"


def _sql_kind(kind: str) -> str:
    return f"""
  SELECT doc_id, t, list_filter(list_transform(generate_series(1, len(m)), lambda i: {{'x': m[i], 'score': {_sql_score(kind)},
      's': CAST(list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0) AS BIGINT)}}),
    lambda z: {_SQL_TESTS[kind]}{"" if kind in BASE_KINDS else f" AND z.score >= {LEAST}"}) AS spans
  FROM (SELECT doc_id, t, regexp_extract_all(t, '{PLAIN[kind]}') AS m, string_split_regex(t, '{PLAIN[kind]}') AS g FROM docs)"""


def _sql_written(kinds: tuple[str, ...], form: str = "'{k}:' || z.s || ':' || (z.s + length(z.x))") -> str:
    parts = [f"list_transform({k}.spans, lambda z: {form.format(k=k)})" for k in kinds]
    joined = parts[0]
    for p in parts[1:]:
        joined = f"list_concat({joined}, {p})"
    return f"array_to_string({joined}, ',')"


SQL = (
    "WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),"
    + ",".join(f"{k} AS ({_sql_kind(k)})" for k in KINDS)
    + " SELECT email.doc_id, "
    + ", ".join(f"len({k}.spans) AS n_{k}" for k in BASE_KINDS)
    + f", sha256({_sql_written(BASE_KINDS)}) AS base_sha256, {_sql_written(KINDS)} AS spans, {_sql_written(KINDS, "format('{{:.1f}}', z.score)")} AS scores FROM email "
    + " ".join(f"JOIN {k} ON email.doc_id = {k}.doc_id" for k in KINDS[1:])
)
