"""Personal data, secrets and network indicators in text: a table of patterns, read in one pass over the text."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subjectlens.functions.text import entropy, luhn

class Pattern(NamedTuple):
    """A text can match only if it holds one of `literals` (if there are any) and matches the plain `hint` (if there is one)."""

    name: str
    regex: str
    kind: str
    risk: str
    hint: str | None = None
    literals: tuple[str, ...] = ()


# ---- fixed values: the patterns in order of precedence, in Java's dialect

_PUNCTUATION = r"[\.\?>\"'\)!,}:;”’＞＜\]]*"
_DEFANG = r"[\(\)\[\]{}<>\\]"
GENERIC_URL = r"(?i)([fhstu]\S\S?[px]s?(?::\/\/|:\\\\|:?__)(?:\x20|" + _DEFANG + r")*\w\S+?(?:\x20[\/\.][^\.\\/\s]\S*?)*)" + _PUNCTUATION + r"(?=\s|$)"
BRACKET_URL = r"\b([\.:\\/\w\[\]\(\)-]+(?:\x20?[\(\[]\x20?\.\x20?[\]\)]\x20?\S*?)+)" + _PUNCTUATION + r"(?=\s|$)"
BACKSLASH_URL = r"\b([:\\/\w\[\]\(\)-]+(?:\x20?\\?\.\x20?\S*?)*?(?:\x20?\\\.\x20?\S*?)(?:\x20?\\?\.\x20?\S*?)*)" + _PUNCTUATION + r"(?=\s|$)"
HEXENCODED_URL = r"(?i)([46][86](?:[57]4)?[57]4[57]0(?:[57]3)?3a2f2f(?:[2356def]|3[0-9adf]|[46][0-9a-f]|[57][0-9af])+)(?:[046]0|2[0-2489a-c]|3[bce]|[57][b-e]|[8-f][0-9a-f]|0a|0d|09|[\x5b-\x5d\x7b\x7d\x0a\x0d\x20]|$)"
URLENCODED_URL = r"(?i)(s?[hf]t?tps?%3A%2F%2F\w[\w%-]*?)(?:[^\w%-]|$)"
B64ENCODED_URL = (
    r"((?:"
    r"[\x2b\x2f-\x39A-Za-z]\s*[\x2b\x2f-\x39A-Za-z]\s*[\x31\x35\x39BFJNRVZdhlptx]\s*[Gm]\s*[Vd]\s*[FH]\s*[A]\s*\x36\s*L\s*y\s*[\x2b\x2f\x38-\x39]\s*|"
    r"[\x2b\x2f-\x39A-Za-z]\s*[\x2b\x2f-\x39A-Za-z]\s*[\x31\x35\x39BFJNRVZdhlptx]\s*[Io]\s*[Vd]\s*[FH]\s*[R]\s*[Qw]\s*[O]\s*i\s*\x38\s*v\s*[\x2b\x2f-\x39A-Za-z]\s*|"
    r"[\x2b\x2f-\x39A-Za-z]\s*[\x2b\x2f-\x39A-Za-z]\s*[\x31\x35\x39BFJNRVZdhlptx]\s*[Io]\s*[Vd]\s*[FH]\s*[R]\s*[Qw]\s*[Uc]\s*[z]\s*o\s*v\s*L\s*[\x2b\x2f-\x39w-z]\s*|"
    r"[RZ]\s*[ln]\s*[R]\s*[Qw]\s*[O]\s*i\s*\x38\s*v\s*[\x2b\x2f-\x39A-Za-z]\s*|"
    r"[Sa]\s*[FH]\s*[R]\s*[\x30U]\s*[Uc]\s*[D]\s*o\s*v\s*L\s*[\x2b\x2f-\x39w-z]\s*|"
    r"[Sa]\s*[FH]\s*[R]\s*[\x30U]\s*[Uc]\s*[FH]\s*[M]\s*\x36\s*L\s*y\s*[\x2b\x2f\x38-\x39]\s*"
    r")[A-Za-z0-9+/=\s]{1,357})(?=[^A-Za-z0-9+/=\s]|$)"
)
IPV4 = r"(?:^|(?![^\d\.]))((?:(?:[1-9]?\d|1\d\d|2[0-4]\d|25[0-5])[\[\(\\]*?\.[\]\)]*?){3}(?:[1-9]?\d|1\d\d|2[0-4]\d|25[0-5]))(?:(?=[^\d\.])|$)"
IPV6 = r"(?i)(\b(?:[a-f0-9]{1,4}:|:){2,7}(?:[a-f0-9]{1,4}|:)\b)"
EMAIL = r"(?i)([a-z0-9_.+-]+[\(\[\{\x20]*(?:@|\Wat\W)[\)\]\}\x20]*[a-z0-9-]+(?:(?:(?:\x20*" + _DEFANG + r"\x20*)*\.(?:\x20*" + _DEFANG + r"\x20*)*|\W+dot\W+)[a-z0-9-]+?)+)" + _PUNCTUATION + r"(?=\s|$)"
CREDIT_CARD = r"([0-9]{4}[ ]?[-]?[0-9]{4}[ ]?[-]?[0-9]{4}[ ]?[-]?[0-9]{4})"
YARA = (
    r"(?ms)(?:^|\s)((?:\s*?import\s+?\"[^\r\n]*?[\r\n]+|\s*?include\s+?\"[^\r\n]*?[\r\n]+|\s*?//[^\r\n]*[\r\n]+|\s*?/\*.*?\*/\s*?)*"
    r"(?:\s*?private\s+|\s*?global\s+)*rule\s*?\w+\s*?(?::[\s\w]+)?\s+\{.*?condition\s*?:.*?\s*\})(?:$|\s)"
)
SECRET = r"([\w-]{16,45})"


def hex_run(n: int) -> str:
    return r"(?:[^a-fA-F\d]|\b)([a-fA-F\d]{" + str(n) + r"})(?:[^a-fA-F\d]|\b)"


_HEX = r"[a-fA-F\d]{32}"
PATTERNS = (
    Pattern("GENERIC_URL", GENERIC_URL, "URL", "low", literals=("://", ":\\\\", "__")),
    Pattern("BRACKET_URL", BRACKET_URL, "URL", "low", r"[(\[] ?\. ?[\])]", (".]", ".)", ". ]", ". )")),
    Pattern("BACKSLASH_URL", BACKSLASH_URL, "URL", "low", literals=("\\.",)),
    Pattern("HEXENCODED_URL", HEXENCODED_URL, "URL", "medium", literals=("3a2f2f", "3A2F2F", "3a2F2F", "3a2f2F", "3a2F2f", "3A2f2f", "3A2F2f", "3A2f2F")),
    Pattern("URLENCODED_URL", URLENCODED_URL, "URL", "medium", r"(?i)%3A%2F%2F", ("%",)),
    Pattern("B64ENCODED_URL", B64ENCODED_URL, "URL", "medium", r"6\s*L\s*y|i\s*8\s*v|o\s*v\s*L"),
    Pattern("IPV4", IPV4, "IP", "low", r"\d[\[\(\\]*\.[\]\)]*\d"),
    Pattern("IPV6", IPV6, "IP", "low", r"(?i)[a-f0-9]*:[a-f0-9]*:", (":",)),
    Pattern("EMAIL", EMAIL, "Email", "medium", r"(?i)@|\Wat\W"),
    Pattern("MD5", hex_run(32), "Credential", "high", _HEX),
    Pattern("SHA1", hex_run(40), "Credential", "high", _HEX),
    Pattern("SHA256", hex_run(64), "Credential", "high", _HEX),
    Pattern("SHA512", hex_run(128), "Credential", "high", _HEX),
    Pattern("CREDIT_CARD", CREDIT_CARD, "CreditCard", "critical", r"[0-9]{4}"),
    Pattern("YARA", YARA, "File", "low", r"condition\s*:", ("condition",)),
    Pattern("HIGH_ENTROPY", SECRET, "Credential", "high", r"[\w-]{23}"),
)

SENSITIVE = ("health", "medical", "biometric", "precise location", "gps", "financial", "passport", "national insurance")

# ---- end of fixed values


def once(value: Column, use) -> Column:
    """use(value) with value bound to a name: it is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def possible(text: Column, p: Pattern) -> Column:
    """Whether a look at literals and a plain pattern leaves room for a match."""
    out = F.lit(False) if p.literals else F.lit(True)
    for x in p.literals:
        out = out | F.contains(text, F.lit(x))
    return out & text.rlike(p.hint) if p.hint else out


def found_by(text: Column, p: Pattern) -> Column:
    """Trimmed matches of one pattern in order, each once; validated where the pattern asks for it."""
    found = F.transform(F.regexp_extract_all(text, F.lit(p.regex), F.lit(1)), lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))
    found = F.array_distinct(F.filter(found, lambda v: v != ""))
    if p.name == "CREDIT_CARD":
        found = F.filter(found, luhn)
    if p.name == "HIGH_ENTROPY":
        found = F.filter(found, lambda v: (F.length(v) >= 23) & (entropy(v) > 4.5))
    return found


def matches(text: Column, p: Pattern) -> Column:
    return F.when(possible(text, p), found_by(text, p)).otherwise(F.array().cast("array<string>"))


def findings(docs: DataFrame, patterns: Sequence[Pattern] = PATTERNS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, finding_type, value, risk_level, pattern, position) per distinct value of a text.

    A value found by several patterns counts for the first one; position is its place among the text's findings. All
    happens within the row: one scan of the text column, no shuffle. `once` binds an array to a name, so that it is
    found once however often it is used.
    """
    tagged = lambda i: lambda v, k: F.struct(v.alias("value"), F.lit(i).alias("p"), k.alias("k"))
    nothing, parts = F.array().cast("array<struct<value:string,p:int,k:int>>"), []
    for _, group in itertools.groupby(enumerate(patterns), lambda ip: (ip[1].hint, ip[1].literals)):
        alike = list(group)  # patterns that are looked for under one condition
        every = F.concat(*[F.transform(found_by(F.col(text), p), tagged(i)) for i, p in alike])
        parts.append(F.when(possible(F.col(text), alike[0][1]), every).otherwise(nothing))
    found = F.concat(*parts)
    firsts = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["value"] != x["value"]))
    placed = once(once(found, lambda x: F.array_sort(x)), lambda s: F.array_sort(F.transform(firsts(s), lambda x: F.struct(x["p"].alias("p"), x["k"].alias("k"), x["value"].alias("value")))))
    rows = docs.select(key, F.posexplode(placed).alias("position", "x"))
    pick = lambda attribute: F.element_at(F.array(*[F.lit(getattr(p, attribute)) for p in patterns]), F.col("x.p") + 1)
    return rows.select(key, pick("kind").alias("finding_type"), F.col("x.value").alias("value"), pick("risk").alias("risk_level"), pick("name").alias("pattern"), "position")


def named(*names: str) -> tuple[Pattern, ...]:
    """A subset of the patterns, in their order."""
    return tuple(p for p in PATTERNS if p.name in names)


def urls(text: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*[matches(text, p) for p in PATTERNS[:3]])))


def emails(text: Column) -> Column:
    tidy = lambda v: F.replace(F.replace(F.replace(v, F.lit(" "), F.lit("")), F.lit("[.]"), F.lit(".")), F.lit("[@]"), F.lit("@"))
    return F.array_distinct(F.transform(matches(text, named("EMAIL")[0]), tidy))


def hashes(text: Column) -> Column:
    """A struct of arrays."""
    return F.struct(*[matches(text, p).alias(p.name.lower()) for p in named("MD5", "SHA1", "SHA256", "SHA512")])


def masked(value: Column) -> Column:
    """For reports: the first four characters and a hash."""
    return F.concat(F.left(value, F.lit(4)), F.lit("..."), F.left(F.sha2(value, 256), F.lit(8)))


def risk_signals(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, count, confidence, source) for e-mails, IPs and sensitive terms of a text."""
    text, low = F.col("text"), F.lower("text")
    count = lambda p, hint: F.when(hint, F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))))).otherwise(0)
    terms = F.filter(F.array(*map(F.lit, SENSITIVE)), lambda x: F.contains(low, x))
    row = lambda kind, n, confidence, source: F.struct(F.lit(kind).alias("kind"), n.alias("count"), F.lit(confidence).alias("confidence"), source.alias("source"))
    signals = F.array(
        row("email", count(r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", F.contains(text, F.lit("@"))), 0.9, F.lit("")),
        row("ip", count(r"\b(?:\d{1,3}\.){3}\d{1,3}\b", text.rlike(r"\d\.\d")), 0.85, F.lit("")),
        row("sensitive_terms", F.size(terms), 0.7, F.array_join(terms, ", ")),
    )
    return docs.select("doc_id", F.explode(F.filter(signals, lambda s: s["count"] > 0)).alias("s")).select("doc_id", "s.*")
