"""Column functions on names, addresses, labels and text. All are built from Spark functions; null gives null."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: word lists, patterns and lookup tables whose content decides the result

PREDICATE_STOPWORDS = ("a", "an", "the", "of", "with", "by", "to", "from", "in", "on", "for")
ENTITY_STOPWORDS = ("the", "a", "an", "of", "and", "or", "in", "on", "at", "to", "for", "with", "by", "as", "is", "are", "was", "were")
#: Words that a question is searched without, of the hybrid search and of the oracle.
SEARCH_STOPWORDS = (
    "who", "what", "where", "when", "why", "how", "is", "are", "was", "were", "has", "have", "had", "my", "the", "a", "an", "of", "to", "in", "for",
    "with", "on", "at", "by", "about", "find", "show", "tell", "me", "all", "any", "some",
)
ORACLE_STOPWORDS = (
    "who", "what", "where", "when", "why", "how", "is", "are", "was", "were", "has", "have", "had", "my", "the", "a", "an", "of", "to", "in", "for",
    "with", "on", "at", "by", "about", "does", "do",
)
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^[\+]?[(]?[0-9]{1,3}[)]?[-\s\.]?[0-9]{1,4}[-\s\.]?[0-9]{1,4}[-\s\.]?[0-9]{1,9}$"
URL = r"^https?://"
DOMAIN = r"^[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
CATEGORY_OF = {
    "pdf": ("pdf",),
    "image": ("jpg", "jpeg", "png", "gif", "webp", "bmp"),
    "spreadsheet": ("xlsx", "xls", "csv", "ods"),
    "audio": ("mp3", "wav", "ogg", "m4a", "flac", "aac"),
    "video": ("mp4", "avi", "mkv", "mov", "webm"),
    "document": ("doc", "docx", "txt", "rtf", "md"),
    "data": ("json", "xml", "html", "htm"),
}
#: The wider list for members of archives.
MEMBER_CATEGORY_OF = {
    "pdf": ("pdf",),
    "image": ("jpg", "jpeg", "png", "gif", "webp", "bmp", "svg", "ico"),
    "spreadsheet": ("xlsx", "xls", "csv", "tsv", "ods"),
    "audio": ("mp3", "wav", "ogg", "m4a", "flac", "aac", "opus", "wma", "ape"),
    "video": ("mp4", "avi", "mkv", "mov", "webm", "flv", "wmv", "mpeg", "mpg", "3gp"),
    "document": ("doc", "docx", "txt", "rtf", "md", "odt"),
    "data": ("json", "xml", "html", "htm", "yaml", "yml"),
}
MIME_OF = {
    "pdf": "application/pdf",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "csv": "text/csv",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "txt": "text/plain",
    "json": "application/json",
    "xml": "application/xml",
    "mp3": "audio/mpeg",
    "wav": "audio/wav",
    "m4a": "audio/mp4",
    "mp4": "video/mp4",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
DOWNLOADS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar", ".tar", ".gz", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".mp3", ".mp4", ".avi", ".mov")
LABEL_KEYS = ("name", "value", "label", "address", "username", "number", "domain")
#: Descriptions of findings by type; {} is the value.
DESCRIPTION_OF = {
    "email": "Email address found: {}",
    "username": 'Username "{}" found on social platforms',
    "social_profile": "Social media profile discovered",
    "breach_record": "Found in data breach",
    "domain": "Domain {} analyzed",
    "ip": "IP address {} associated",
    "phone": "Phone number {} found",
    "website": "Website {} crawled",
    "credential": "Credential exposure detected",
    "document": "Public document found",
}
PROFILE_URL_OF = {
    "github": "https://github.com/{}",
    "twitter": "https://twitter.com/{}",
    "instagram": "https://instagram.com/{}",
    "linkedin": "https://linkedin.com/in/{}",
    "facebook": "https://facebook.com/{}",
    "tiktok": "https://tiktok.com/@{}",
    "youtube": "https://youtube.com/@{}",
    "reddit": "https://reddit.com/user/{}",
    "pinterest": "https://pinterest.com/{}",
    "medium": "https://medium.com/@{}",
}
#: Words of a question with the articles that they lead to, and the articles where none does.
ARTICLES_OF = {
    "access": (12, 15), "delete": (17,), "erasure": (17,), "rectify": (16,), "correct": (16,),
    "portability": (20,), "transfer": (20,), "object": (21,), "consent": (6, 7), "children": (8,),
}
DEFAULT_ARTICLES = (15, 17)
#: Topics of the reference texts with their articles, in order.
TOPIC_ARTICLES = {
    "right of access": "Article 15 GDPR",
    "right to erasure": "Article 17 GDPR",
    "data portability": "Article 20 GDPR",
    "consent": "Article 6(1)(a), Article 7, Recital 32",
    "data breach notification": "Article 33, Article 34",
    "legitimate interest": "Article 6(1)(f), Recital 47",
    "rectification": "Article 16 GDPR",
    "restriction of processing": "Article 18 GDPR",
    "right to object": "Article 21 GDPR",
    "data processing agreement": "Article 28 GDPR",
    "data protection officer": "Article 37, Article 38, Article 39",
    "automated decision making": "Article 22 GDPR",
    "transfers": "Article 44-49 GDPR",
    "children": "Article 8 GDPR, Recital 38",
}
LABEL_OF = {
    "email": "Email", "username": "Username", "phone": "Phone", "domain": "Domain", "ip": "IP", "ipaddress": "IPAddress", "ip_address": "IPAddress",
    "identifier": "Identifier", "name": "Name", "social_profile": "SocialProfile", "socialprofile": "SocialProfile", "individual": "Individual",
    "organization": "Organization", "breach_record": "BreachRecord", "breachrecord": "BreachRecord", "credential": "Credential", "website": "Website",
    "document": "PublicDocument", "publicdocument": "PublicDocument", "cryptowallet": "CryptoWallet", "crypto_wallet": "CryptoWallet", "user": "User",
    "persona": "Persona", "company": "Company", "account": "Account", "attribute": "Attribute", "datapoint": "DataPoint", "data_point": "DataPoint",
    "entity": "Entity", "inference": "Inference",
}
TYPE_ORDER = ("User", "Persona", "Company", "Account", "Attribute", "DataPoint", "Inference", "Entity", "Email", "Username", "Phone", "Name", "Identifier", "Domain", "IP", "IPAddress", "ASN", "CIDR", "SocialProfile", "Individual", "Organization", "Website", "BreachRecord", "Credential", "PublicDocument", "CryptoWallet", "Transaction", "NFT", "ONSITFinding")

# ---- end of fixed values


def lookup(key: Column, table: dict[str, str], default: str | Column | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def choose(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first case that holds."""
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(cases[0][0], wrap(cases[0][1]))
    for c, v in cases[1:]:
        out = out.when(c, wrap(v))
    return out.otherwise(wrap(otherwise))


# ---------------------------------------------------------------- predicates and entities


def predicate(p: Column) -> Column:
    """trimmed, upper case, runs of space, hyphen and underscore as one underscore."""
    return F.regexp_replace(F.upper(F.trim(p)), "[ _-]+", "_")


def short_predicate(p: Column, most: int = 3) -> Column:
    """at most `most` words; of longer ones trailing stopwords go too, unless nothing were left."""
    words = F.split(predicate(p), "_")
    head = F.slice(words, 1, most)
    stops = F.array(*[F.lit(w.upper()) for w in PREDICATE_STOPWORDS])
    keep = reduce(lambda n, k: F.when((n == k) & F.array_contains(stops, F.get(head, F.lit(k - 1))), k - 1).otherwise(n), range(most, 0, -1), F.lit(most))
    cut = F.when(keep == 0, head).otherwise(F.slice(head, F.lit(1), F.greatest(keep, F.lit(1))))
    return F.when(F.size(words) <= most, predicate(p)).otherwise(F.array_join(cut, "_"))


def entity(name: Column) -> Column:
    """lower-case words without stopwords."""
    words = F.regexp_extract_all(F.lower(name), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_join(F.filter(words, lambda w: ~w.isin(*ENTITY_STOPWORDS)), " ")


def entity_kind(v: Column) -> Column:
    """email, phone, url, domain or text, in this order."""
    v = F.trim(v)
    return choose((v.rlike(EMAIL), "email"), (v.rlike(PHONE), "phone"), (v.rlike(URL), "url"), (v.rlike(DOMAIN), "domain"), otherwise="text")


def email(v: Column) -> Column:
    """lower case; at gmail without dots and without what follows a plus."""
    v = F.lower(F.trim(v))
    local, host = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    plain = F.concat(F.replace(F.substring_index(local, "+", 1), F.lit("."), F.lit("")), F.lit("@"), host)
    return F.when(F.contains(v, F.lit("@gmail")), plain).otherwise(v)


def phone(v: Column) -> Column:
    return F.regexp_replace(v, r"[^\d+]", "")


def url_host(v: Column) -> Column:
    """the authority, port included."""
    return F.lower(F.regexp_extract(F.trim(v), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def bare_domain(v: Column) -> Column:
    """host without its first www."""
    return F.regexp_replace(url_host(v), r"^(.*?)www\.", "$1")


def host_name(v: Column) -> Column:
    """The host of a URL without user and port, in lower case."""
    return F.regexp_replace(F.regexp_replace(url_host(v), "^[^@]*@", ""), r":\d+$", "")


def without_first(v: Column, part: str) -> Column:
    """v without the first occurrence of a literal."""
    at = F.instr(v, part)
    return F.when(at > 0, F.concat(F.substring(v, F.lit(1), at - 1), F.substring(v, at + len(part), F.length(v)))).otherwise(v)


def company_of(v: Column) -> Column:
    """display name from a URL: the host without its first www. and .com, the first dot left as a space, first letter in upper case."""
    spaced = F.regexp_replace(without_first(without_first(host_name(v), "www."), ".com"), r"^([^.]*)\.", "$1 ")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced)))


def default_domain(name: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(name), r"\s+", ""), F.lit(".com"))


def root_token(v: Column) -> Column:
    """the label before the public ending of a host or URL, or a name's first word, in lower case."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim(v)), r"^https?://", ""), r"[/?#:].*$", "")
    labels = F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")
    return F.when(F.size(labels) > 1, F.get(labels, F.size(labels) - 2)).otherwise(F.regexp_extract(host, r"^(\S+)", 1))


def entity_key(v: Column) -> Column:
    """The key under which spellings of one entity meet; empty where nothing is left."""
    kind = entity_kind(v)
    return choose((kind == "email", email(v)), (kind == "phone", phone(v)), (kind == "url", url_host(v)), (kind == "domain", F.lower(F.trim(v))), otherwise=entity(v))


# ---------------------------------------------------------------- secrets, addresses


def entropy(v: Column) -> Column:
    """Shannon entropy of the characters in bits."""
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    shares = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: (F.length(v) - F.length(F.replace(v, c, F.lit("")))) / F.length(v).cast("double"))
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def luhn(v: Column) -> Column:
    """13 to 19 digits with a right check digit."""
    digits = F.regexp_replace(v, r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def defang(v: Column) -> Column:
    return F.replace(F.replace(v, F.lit("http"), F.lit("hxxp")), F.lit("."), F.lit("[.]"))


def refang(v: Column) -> Column:
    out = v
    for a, b in (("hxxp", "http"), ("[.]", "."), ("[:]", ":")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def tidy_address(v: Column) -> Column:
    """F16: e-mail or IP without defanging marks."""
    return F.regexp_replace(F.replace(F.replace(v, F.lit("[.]"), F.lit(".")), F.lit("[@]"), F.lit("@")), r"[ ()\[\]{}]", "")


def valid_domain(v: Column) -> Column:
    """the host in lower case, or null."""
    host = F.lower(F.when(F.contains(v, F.lit("://")), url_host(v)).otherwise(F.trim(v)))
    return F.when(host.rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$"), host)


def ip_version(v: Column) -> Column:
    return F.when(F.contains(v, F.lit(":")), 6).otherwise(4)


def gravatar(v: Column) -> Column:
    return F.concat(F.lit("https://www.gravatar.com/avatar/"), F.md5(F.lower(F.trim(v))))


def entity_label(kind: Column, v: Column, platform: Column) -> Column:
    """the label of an entity by its class; platform is a wallet's chain or the type of a finding."""
    return choose(
        (kind.isin("username", "social_account"), F.when(F.coalesce(platform, F.lit("")) == "", v).otherwise(F.concat(v, F.lit("@"), platform))),
        (kind == "asn", F.concat(F.lit("AS"), v)),
        (kind == "wallet", F.concat(platform, F.lit(":"), F.left(v, F.lit(12)), F.lit("..."))),
        (kind == "finding", F.concat(platform, F.lit(": "), F.left(v, F.lit(50)))),
        otherwise=v,
    )


# ---------------------------------------------------------------- files, labels, levels


def extension(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1))


def file_category(name: Column) -> Column:
    return lookup(extension(name), {e: c for c, es in CATEGORY_OF.items() for e in es}, "other")


def mime_type(name: Column) -> Column:
    return lookup(extension(name), MIME_OF, "application/octet-stream")


def member_category(name: Column) -> Column:
    return lookup(extension(name), {e: c for c, es in MEMBER_CATEGORY_OF.items() for e in es}, "other")


def is_download(url: Column) -> Column:
    """X26."""
    out = F.lit(False)
    for ending in DOWNLOADS:
        out = out | F.endswith(F.lower(url), F.lit(ending))
    return out


def clean_label(v: Column) -> Column:
    """word characters only; empty is Entity; a leading digit comes after Entity."""
    out = F.regexp_replace(v, "[^A-Za-z0-9_]", "")
    return choose((out == "", "Entity"), (out.rlike("^[0-9]"), F.concat(F.lit("Entity"), out)), otherwise=out)


def label_of(kind: Column) -> Column:
    """F27."""
    return lookup(F.lower(kind), LABEL_OF, clean_label(kind))


def relation_type(v: Column) -> Column:
    """RELATES_TO where nothing is left or the first sign is a digit."""
    out = F.regexp_replace(F.upper(v), "[^A-Z0-9_]", "_")
    return F.when(out.rlike("^[A-Z_]"), out).otherwise("RELATES_TO")


def relation_letters(v: Column) -> Column:
    """digits are lost."""
    return F.regexp_replace(F.upper(v), "[^A-Z_]", "_")


def risk_level(v: Column) -> Column:
    low = F.lower(v)
    return F.when(low.isin("critical", "high", "medium", "low"), low).otherwise("low")


def inferred_risk(kind: Column, source: Column) -> Column:
    """F31."""
    kind, source = F.lower(kind), F.coalesce(source, F.lit(""))
    return choose(
        (kind.isin("breach_record", "credential", "password"), "critical"),
        (kind.isin("social_profile", "phone"), "medium"),
        (F.contains(source, F.lit("breach")) | F.contains(source, F.lit("leak")), "high"),
        otherwise="low",
    )


def description(kind: Column, v: Column) -> Column:
    """F32."""
    template = lookup(F.lower(kind), DESCRIPTION_OF)
    return F.coalesce(F.replace(template, F.lit("{}"), v), F.concat(kind, F.lit(": "), v))


def display_type(labels: Column) -> Column:
    """the first of the labels in a fixed order of types, else their first, else Unknown."""
    known = F.get(F.filter(F.array(*map(F.lit, TYPE_ORDER)), lambda x: F.array_contains(labels, x)), F.lit(0))
    return F.coalesce(known, F.nullif(F.get(labels, F.lit(0)), F.lit("")), F.lit("Unknown"))


def display_label(props: Column, kind: Column) -> Column:
    """the first property that isn't empty, else the type."""
    return F.coalesce(*[F.nullif(F.try_element_at(props, F.lit(k)), F.lit("")) for k in LABEL_KEYS], kind)


def ellipsis(v: Column, most: int) -> Column:
    return F.when(F.length(v) > most, F.concat(F.left(v, F.lit(most)), F.lit("..."))).otherwise(v)


def title_case(v: Column) -> Column:
    """underscores as spaces, first letters in upper case, the rest as it is."""
    words = F.split(F.replace(v, F.lit("_"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def spaced_words(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, "([A-Z])", " $1"))


def slug(v: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(v)), r"\s+", "_")


def relative_time(seconds: Column) -> Column:
    """F48."""
    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86400)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return choose((minutes < 60, text(minutes, " minutes ago")), (hours < 24, text(hours, " hours ago")), (days == 1, "Yesterday"), otherwise=text(days, " days ago"))


# ---------------------------------------------------------------- search text


def keywords(question: Column, stopwords=SEARCH_STOPWORDS) -> Column:
    """words of more than two letters that are no stopwords, in order."""
    words = F.split(F.replace(F.lower(question), F.lit("?"), F.lit("")), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stopwords))


def excerpt(text: Column, word: Column, size: int = 500) -> Column:
    """a window of `size` characters around the first occurrence, from the start if there is none."""
    at = F.locate(word, F.lower(text)) if isinstance(word, str) else F.position(word, F.lower(text))
    start = F.greatest(at - 1 - size // 2, F.lit(0))
    return F.substring(text, start + 1, F.lit(size))


def excerpts(text: Column, term: str, around: int = 150, most: int = 5) -> Column:
    """up to `most` windows around occurrences that do not overlap, each occurrence in bold.

    In a window the term stands in bold as the occurrence spells it. Occurrences are the gaps between the pieces that
    the term cuts the text into, so offsets are sums of piece lengths.
    """
    if not term:
        return F.array().cast("array<string>")
    literal = "(?i)" + re.escape(term)
    lengths = F.transform(F.split(text, literal, most + 1), F.length)
    shown = F.slice(lengths, F.lit(1), F.least(F.size(lengths) - 1, F.lit(most)))
    starts = F.transform(shown, lambda _, i: F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda a, n: a + n) + i * len(term))

    def window(at: Column) -> Column:
        first = F.greatest(at - around, F.lit(0))
        said = F.substring(text, at + 1, F.lit(len(term)))
        part = F.substring(text, first + 1, at + len(term) + around - first)
        bold = F.concat(F.lit("**"), F.regexp_replace(said, r"([\\$])", r"\\$1"), F.lit("**"))
        return F.regexp_replace(F.regexp_replace(part, r"^\s+|\s+$", ""), F.lit(literal), bold)

    return F.transform(starts, window)


def topic_of(topic: Column) -> Column:
    """the reference topic of a question: itself, else the one that holds most of its words, the first of equals; null where none does."""
    low = F.lower(topic)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    held = lambda name: F.size(F.filter(words, lambda w: F.contains(F.lit(name), w)))
    scored = [F.struct(held(name).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("k")) for i, name in enumerate(TOPIC_ARTICLES)]
    best = F.array_max(F.array(*scored))
    return F.when(low.isin(*TOPIC_ARTICLES), low).when(best["n"] > 0, best["k"])


def topic_articles(topic: Column) -> Column:
    return lookup(topic_of(topic), TOPIC_ARTICLES)


def articles(question: Column, found: Column) -> Column:
    """sorted article numbers of the question's words and of references `Article N` in found texts (array of strings)."""
    low, none = F.lower(question), F.array().cast("array<int>")
    named = [F.when(F.contains(low, F.lit(k)), F.array(*map(F.lit, v))).otherwise(none) for k, v in ARTICLES_OF.items()]
    cited = F.flatten(F.transform(found, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?i)Article\s+(\d+)"), F.lit(1)), lambda n: n.cast("int"))))
    out = F.array_sort(F.array_distinct(F.concat(F.coalesce(cited, none), *named)))
    return F.when(F.size(out) > 0, out).otherwise(F.array(*map(F.lit, DEFAULT_ARTICLES)))


def match_ratio(text: Column, terms: Column) -> Column:
    """share of the terms that the text contains."""
    low = F.lower(text)
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda x: F.contains(low, x))) / F.size(terms))


# ---------------------------------------------------------------- HTML


def strip_html(html: Column) -> Column:
    """without scripts, styles and tags; white space runs as one space."""
    out = html
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<[^>]+>", r"\s+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def headings(html: Column, most: int = 50) -> Column:
    inner = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return F.slice(F.filter(F.transform(inner, strip_html), lambda h: h != ""), 1, most)


def outline(text: Column) -> Column:
    """(level, text) of markdown headings, at most 80, or of lines in title case, at most 40."""
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}\s+.+$"), F.lit(0))
    parts = F.transform(heads, lambda h: F.struct(F.length(F.regexp_extract(h, "^(#{1,6})", 1)).alias("level"), _trimmed(F.regexp_extract(h, r"^#{1,6}\s+(.+)$", 1)).alias("text")))
    parts = F.filter(parts, lambda x: x["text"] != "")
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), _trimmed), lambda x: x.rlike(r"^[A-Z][A-Za-z0-9\s,&:/()-]{4,80}$"))
    titles = F.transform(F.slice(lines, 1, 40), lambda x: F.struct(F.lit(2).alias("level"), x.alias("text")))
    return F.when(F.size(parts) > 0, F.slice(parts, 1, 80)).otherwise(titles)


def _trimmed(v: Column) -> Column:
    return F.regexp_replace(v, r"^\s+|\s+$", "")


def is_html(text: Column) -> Column:
    """a tag, and the end of one of some elements."""
    return text.rlike(r"(?i)</?[a-z][\s\S]*>") & text.rlike(r"(?i)</(html|body|div|table|p|section|article|script)>")


def hrefs(html: Column) -> Column:
    """Targets of a and link tags in page order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<(?:a|link)\s[^>]*?href=[\"']([^\"'>]*)[\"']"), F.lit(1))


def resolved(href: Column, base: Column) -> Column:
    """An href as an absolute URL without its fragment, null if that is not http or https.

    Relative ones are joined to the page's own address, `.` and `..` in the path are followed.
    """
    href = F.regexp_replace(href, "#.*$", "")
    scheme, host = F.regexp_extract(base, "^([a-zA-Z]+):", 1), F.regexp_extract(base, r"^[a-zA-Z]+://([^/?#]*)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    path = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    rest = F.regexp_extract(href, r"(\?.*)$", 1)
    joined = F.when(F.startswith(href, F.lit("/")), F.regexp_extract(href, r"^([^?]*)", 1)).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), F.regexp_extract(href, r"^([^?]*)", 1)))
    steps = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))),
    )
    ending = F.when(joined.rlike(r"/\.\.?$"), F.lit("/")).otherwise("")
    return choose(
        (href.rlike("(?i)^https?://"), F.regexp_replace(href, r"^([^:]*)", F.lower(F.regexp_extract(href, "^([^:]*)", 1)))),
        (href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), None),
        (F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href)),
        (href == "", F.regexp_replace(base, "#.*$", "")),
        (F.startswith(href, F.lit("?")), F.concat(root, path, href)),
        otherwise=F.concat(root, F.array_join(steps, "/"), ending, rest),
    )


def script_sources(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)<script[^>]*?src=[\"']?([^\s>\"']+)"), F.lit(1))


# ---------------------------------------------------------------- mail policies


def spf_targets(record: Column) -> Column:
    """what include:, a: and mx: name."""
    parts = F.filter(F.split(record, r"\s+"), lambda x: x.rlike("^(include|a|mx):"))
    return F.transform(parts, lambda x: F.regexp_replace(x, "^(include|a|mx):", ""))


def dmarc_emails(record: Column) -> Column:
    """addresses of rua= and ruf=."""
    lists = F.regexp_extract_all(record, F.lit(r"ru[af]=mailto:([^;]+)"), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.trim(F.replace(x, F.lit("mailto:"), F.lit("")))))
