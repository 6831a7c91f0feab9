"""JSON and tables in texts: rows, flattened fields, structure, field coverage."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType


def _parsed(text: str | None):
    """The value of a text that begins like a JSON object or array, else None."""
    trimmed = (text or "").strip()
    if not trimmed.startswith(("{", "[")):
        return None
    try:
        return json.loads(trimmed)
    except ValueError:
        return None


def _flat(value: dict, prefix: str = "") -> dict:
    """Dotted names for inner objects, lengths for arrays."""
    row: dict = {}
    for name, entry in value.items():
        path = f"{prefix}.{name}" if prefix else name
        if isinstance(entry, dict):
            row |= _flat(entry, path)
        else:
            row[path] = len(entry) if isinstance(entry, list) else entry
    return row


def _rows(value) -> list[dict]:
    """An array's objects, or the first array in an object, or the object alone."""
    if isinstance(value, list):
        return [_flat(x if isinstance(x, dict) else dict(zip(map(str, range(len(x))), x, strict=True))) for x in value if isinstance(x, dict | list)]
    if isinstance(value, dict):
        inner = next((x for x in value.values() if isinstance(x, list)), None)
        return [_flat(value)] if inner is None else _rows(inner)
    return []


def _shown(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def _schema(value) -> dict:
    """The kinds of a value's parts; an array's item is that of its first element."""
    if isinstance(value, list):
        return {"type": "array", "count": len(value), "item": _schema(value[0]) if value else {"type": "unknown"}}
    if isinstance(value, dict):
        return {"type": "object", "fields": {k: _schema(v) for k, v in value.items()}}
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
    return {"type": kind}


def rows_of_json(text: str | None) -> list[list[tuple[str, str | None]]] | None:
    """D19 for one text: all its rows of (name, value); None if it isn't JSON."""
    return None if (v := _parsed(text)) is None else [[(k, _shown(x)) for k, x in r.items()] for r in _rows(v)]


@F.pandas_udf(ArrayType(ArrayType(StructType().add("name", StringType()).add("value", StringType()))))
def _json_fields(text: pd.Series) -> pd.Series:
    return pd.Series([None if (rows := rows_of_json(t)) is None else [[{"name": k, "value": x} for k, x in r] for r in rows] for t in text])


@F.pandas_udf(StringType())
def _json_schema(text: pd.Series) -> pd.Series:
    return pd.Series([None if (v := _parsed(t)) is None else json.dumps(_schema(v), separators=(",", ":")) for t in text])


def json_rows(text: Column) -> Column:
    """The rows of a JSON text, each an array of (name, value) in the order of its fields; null where it isn't JSON.

    Any shape of JSON is read, so this runs in batches in Python.
    """
    return _json_fields(text)


def json_schema(text: Column) -> Column:
    """The structure of a JSON text as JSON; null where it isn't JSON."""
    return _json_schema(text)


def field_coverage(rows: Column, most: int = 12) -> Column:
    """(name, n) of the fields with most non-blank values, at most 12; of equals the one that is met first."""
    flat = F.flatten(rows)
    filled = F.transform(F.filter(flat, lambda x: F.trim(F.coalesce(x["value"], F.lit(""))) != ""), lambda x: x["name"])
    names = F.array_distinct(filled)
    counted = F.transform(names, lambda n, i: F.struct((-F.size(F.filter(filled, lambda x: x == n))).alias("a"), i.alias("i"), n.alias("name")))
    best = F.slice(F.array_sort(counted), 1, most)
    return F.transform(best, lambda x: F.struct(x["name"].alias("name"), (-x["a"]).alias("n")))


def table_rows(maps: Column) -> Column:
    """Rows given as maps in the form of json_rows."""
    return F.transform(maps, lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))))


def columns_of(rows: Column, most: int = 50) -> Column:
    """Names of the fields in the order in which they are met, at most 50."""
    return F.slice(F.array_distinct(F.transform(F.flatten(rows), lambda x: x["name"])), 1, most)
