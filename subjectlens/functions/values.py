"""Column functions on dates, numbers, arrays, maps, vectors and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from subjectlens.functions.replies import once

ISO_DATE = r"\b(\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?Z?)?)\b"
COMMON_DATE = r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b"

# ---- fixed values: progress of a request by status, and the status that a message's class leads to

PROGRESS = {"draft": 0, "scheduled": 10, "processing": 40, "action_required": 60, "completed": 100}
STATUS_OF_CLASS = {
    "ACKNOWLEDGMENT": "processing",
    "VERIFICATION_NEEDED": "action_required",
    "PROCESSING": "processing",
    "DATA_READY": "data_available",
    "DATA_ATTACHED": "data_received",
    "PARTIAL_DATA": "partial_data",
    "REJECTION": "rejected",
    "EXTENSION": "extended",
    "CLARIFICATION": "action_required",
    "COMPLETION": "completed",
}
#: Rows of a table that is shown, and places around a date that make its context.
MOST_ROWS, BEFORE_DATE, AFTER_DATE = 250, 80, 140

# ---- end of fixed values


def progress(status: Column) -> Column:
    """0 for any other status."""
    pairs = F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, status), F.lit(0))


def status_of_class(label: Column) -> Column:
    """Null where the class does not change the status."""
    pairs = F.create_map(*[F.lit(x) for kv in STATUS_OF_CLASS.items() for x in kv])
    return F.try_element_at(pairs, label)


def day_or_null(text: Column) -> Column:
    """The day of a date or ISO time, null where the text is neither."""
    plain = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(text))
    return F.to_date(F.coalesce(plain, iso))


def noted(notes: Column, time: Column, text: Column) -> Column:
    """Notes with one more, after a blank line, its time in brackets."""
    return F.concat(F.coalesce(notes, F.lit("")), F.lit("\n\n["), time, F.lit("] "), text)


def timeline(text: Column, most: int = 1000) -> Column:
    """(date, label) of the dates in a text, ISO dates first, each at its first place with what stands around it."""
    def around(x: Column, at: Column) -> Column:
        first = F.greatest(at - F.lit(BEFORE_DATE), F.lit(0))
        return F.regexp_replace(F.substring(x, first + 1, at + AFTER_DATE - first), r"\s+", " ")

    def found(x: Column, pattern: str) -> Column:
        read = F.struct(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)).alias("values"), F.transform(F.split(x, pattern), F.length).alias("gaps"))
        sum_ = lambda n: F.aggregate(n, F.lit(0), lambda a, k: a + k)
        before = lambda r, i: sum_(F.slice(r["gaps"], F.lit(1), i + 1)) + sum_(F.transform(F.slice(r["values"], F.lit(1), i), F.length))
        return once(read, lambda r: F.transform(r["values"], lambda v, i: F.struct(v.alias("date"), before(r, i).alias("at"))))

    # each name is bound, so that a text is read once for each pattern; only dates that stay get a label
    both = lambda x: F.concat(found(x, ISO_DATE), found(x, COMMON_DATE))
    firsts = lambda b: F.filter(b, lambda y, i: F.array_position(b["date"], y["date"]) == i + 1)
    return once(text, lambda x: F.transform(F.slice(once(both(x), firsts), 1, most), lambda y: F.struct(y["date"].alias("date"), around(x, y["at"]).alias("label"))))


def deadline(created: Column, days: int = 30) -> Column:
    return F.date_add(created.cast("date"), days)


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded down."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000).cast("long")


def progress_of(days: Column, term: int = 30) -> tuple[Column, Column]:
    """Share of the term that has passed in percent, at most 100, and days that remain."""
    return F.least(F.lit(100), F.floor(days * 100 / term)).cast("long"), F.greatest(F.lit(0), term - days).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def chunk_estimate(words: Column, size: int, overlap: int) -> Column:
    """D12."""
    return F.when(words <= size, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor((words - overlap) / (size - overlap)) + 1)).cast("long")


def document_score(parts: Column) -> Column:
    return F.least(F.lit(1.0), 0.3 + 0.2 * parts)


def coordinates(text: Column, most: int = 1000) -> Column:
    """(lat, lon) pairs in range, each once, with a label of five decimals."""
    pattern = r"(-?\d{1,2}\.\d{3,})\s*[,;]\s*(-?\d{1,3}\.\d{3,})"
    lat, lon = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(lat, lon, lambda a, b: F.struct(a.cast("double").alias("lat"), b.cast("double").alias("lon")))
    return F.slice(F.filter(pairs, lambda p: (F.abs(p["lat"]) <= 90) & (F.abs(p["lon"]) <= 180)), 1, most)


def dates(text: Column) -> Column:
    """ISO dates, then day/month/year dates, each once."""
    iso = F.regexp_extract_all(text, F.lit(ISO_DATE), F.lit(1))
    common = F.regexp_extract_all(text, F.lit(COMMON_DATE), F.lit(1))
    return F.array_distinct(F.concat(iso, common))


def json_or_null(text: Column) -> Column:
    """The value if the text is a JSON object or array, else null."""
    return F.when(F.trim(text).rlike(r"^[\{\[]"), F.try_parse_json(text))


def merged_map(old: Column, new: Column) -> Column:
    """Keys of both; the right side wins."""
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    return F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>")))


def defaults_with(default: Column, given: Column) -> Column:
    """Given values over defaults; empty ones keep the default."""
    return merged_map(default, F.map_filter(given, lambda _, v: v.isNotNull() & (F.trim(v) != "")))


def delimiter_of(header: Column) -> Column:
    """The first of comma, tab, semicolon that the header holds."""
    out = F.when(F.contains(header, F.lit(";")), ";")
    for d in ("\t", ","):
        out = F.when(F.contains(header, F.lit(d)), F.lit(d)).otherwise(out)
    return out


def delimited_rows(text: Column, most: int = 250) -> Column:
    """Rows of a delimited text as maps, at most `most`: cells trimmed, one pair of quotes gone. Null without a delimiter."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    header = F.get(lines, F.lit(0))
    mark = delimiter_of(header)
    cells = lambda x: F.transform(F.split(x, mark, -1), lambda c: F.regexp_replace(F.trim(c), r'^"|"$', ""))
    names = cells(header)
    row = lambda x: F.map_from_arrays(names, F.transform(names, lambda _, i: F.coalesce(F.get(cells(x), i), F.lit(""))))
    return F.when(mark.isNotNull(), F.transform(F.slice(lines, F.lit(2), F.lit(most)), row))
