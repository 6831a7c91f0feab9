"""Benchmark decontamination: a prefix-filtered set join of item windows with documents."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjectlens.llm.shared import by_bytes, need, read, stash, text_of

#: Words in a window; an item of fewer words is one window.
WINDOW = 10
#: Bytes of item text in one block. A block's windows are broadcast; more items make more blocks, not larger ones.
BLOCK_BYTES = 8 << 20

#: Text bytes that are brought into Python at once.
TEXT_BYTES = 8 << 20

#: Lower-cases A-Z and turns every byte that is no ASCII digit, ASCII letter or part of a non-ASCII character into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class WindowIndex:
    """Windows of one block by their prefix token.

    Containment of a whole window needs every one of its tokens, so its necessary prefix is its single rarest token
    (by count in the documents, then by bytes). Where a document has that token, the token's offset in the window gives
    the only place the window can stand; length and position rule out what would reach over either end.
    """

    def __init__(self, items: list[tuple[object, str]], counts: dict[bytes, int], size: int):
        owners: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, text in items:
            for w in windows_of(words_of(text), size):
                owners[w].add(item)
        self.ids = sorted({i for o in owners.values() for i in o}, key=str)
        at = {i: k for k, i in enumerate(self.ids)}
        self.by_token: dict[bytes, list[tuple[int, list[bytes], tuple[int, ...]]]] = defaultdict(list)
        for w, o in owners.items():
            place = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
            self.by_token[w[place]].append((place, list(w), tuple(at[i] for i in o)))
        # of windows with one prefix token, those at one place share a lookup by their words
        self.table = {t: self._grouped(v) for t, v in self.by_token.items()}
        del self.by_token

    @staticmethod
    def _grouped(entries):
        places: dict[tuple[int, int], dict] = defaultdict(dict)
        for place, words, owners in entries:
            places[place, len(words)][tuple(words)] = owners
        return [(place, n, d) for (place, n), d in places.items()]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word intervals [start, end) of all occurrences, and the items they belong to."""
        found, items, table, total = [], set(), self.table, len(words)
        for i in [i for i, w in enumerate(words) if w in table]:
            for place, n, d in table[words[i]]:
                start = i - place
                if start >= 0 and start + n <= total and (o := d.get(tuple(words[start : start + n]))):
                    found.append((start, start + n))
                    items.update(o)
        return found, items


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of bounded size, each brought to the driver by itself."""
    sized = items.select("item_id", "text", F.octet_length("text").alias("n")).distinct()
    total = sized.agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    if n == 1:
        yield [(r.item_id, r.text) for r in sized.collect()]
        return
    slot = F.pmod(F.xxhash64(F.col("item_id"), F.col("text")), F.lit(2 * n))
    for k in range(2 * n):
        yield [(r.item_id, r.text) for r in sized.filter(slot == k).collect()]


def token_counts(docs: DataFrame, tokens: set[bytes]) -> dict[bytes, int]:
    """How often each of a block's tokens occurs in all documents."""
    known = docs.sparkSession.sparkContext.broadcast(tokens)

    def count(batches):
        total: Counter = Counter()
        keep = known.value
        for b in (part for whole in batches for part in by_bytes(whole, 0, TEXT_BYTES)):
            for x in b.column(0).to_pylist():
                total.update(w for w in words_of(x) if w in keep)
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    rows = docs.select(text_of().alias("text")).mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.w): r.n for r in rows}


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs(doc_id, text) against items(item_id, text): doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, hits (word intervals) and items (ids as strings, sorted).

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case. A window is `window`
    consecutive words of an item, or all words of a shorter item. A document word inside any occurrence is hit.
    Null texts and texts without words have no windows and no hits; rows that repeat an id are rated one by one; a null
    item id counts as the string "null"; no documents give an empty result, no items no hits.
    """
    docs, items = need(docs, "doc_id", "text"), need(items, "item_id", "text").withColumn("text", text_of())
    spark = docs.sparkSession
    schema = "doc_id long, row long, n_words long, hits array<struct<a:long,b:long>>, items array<string>"
    typed = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])
    parts = []
    for block in _blocks(items):
        tokens = {w for _, x in block for w in words_of(x)}
        index = spark.sparkContext.broadcast(WindowIndex([("null" if i is None else i, x) for i, x in block], token_counts(docs, tokens), window))

        def find(batches, index=index):
            for b in (part for whole in batches for part in by_bytes(whole, 2, TEXT_BYTES)):
                ids, out = b.column(0), ([], [], [])
                for x in b.column(2).to_pylist():
                    words = words_of(x)
                    found, items_ = index.value.hits(words)
                    out[0].append(len(words))
                    out[1].append([{"a": s, "b": e} for s, e in merged(found)])
                    out[2].append(sorted(str(index.value.ids[i]) for i in items_))
                yield pa.RecordBatch.from_arrays([ids, b.column(1), *(pa.array(v, typed.field(i + 2).type) for i, v in enumerate(out))], schema=typed)

        parts.append((docs.select("doc_id", F.lit(0).cast("long").alias("row"), text_of().alias("text")), find))
    if len(parts) == 1:
        out = parts[0][0].mapInArrow(parts[0][1], schema)
    else:
        out = _joined_blocks(docs, [f for _, f in parts], schema)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "hits", "items")


def _joined_blocks(docs: DataFrame, finders: list, schema: str) -> DataFrame:
    """Results of several blocks as one row per document: equal rows of docs meet by id and text, and their number comes back."""
    keyed = docs.groupBy("doc_id", text_of().alias("text"), F.xxhash64("text").alias("row")).agg(F.count("*").alias("copies"))
    keyed = stash(keyed, "decontaminate-docs")
    found = None
    for f in finders:
        part = keyed.select("doc_id", "row", "text").mapInArrow(f, schema)
        found = part if found is None else found.unionByName(part)
    whole = found.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    fold = F.aggregate(
        F.array_sort("hits"),
        F.expr("cast(array() as array<struct<a:long,b:long>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["b"] >= x["a"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.get(acc, F.size(acc) - 1)["a"].alias("a"), F.greatest(F.get(acc, F.size(acc) - 1)["b"], x["b"]).alias("b")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    whole = whole.withColumn("hits", fold).withColumnRenamed("doc_id", "id").withColumnRenamed("row", "r")
    out = keyed.select("doc_id", "row", "copies").join(whole, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("r")))
    return out.select("doc_id", "row", "n_words", "hits", "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, without those that hold an item's window. Each row is judged by its own text, whatever its id."""
    items, out, at = need(items, "item_id", "text").withColumn("text", text_of()), docs, docs.columns.index("text")
    for block in _blocks(items):
        tokens = {w for _, x in block for w in words_of(x)}
        index = docs.sparkSession.sparkContext.broadcast(WindowIndex([("null" if i is None else i, x) for i, x in block], token_counts(docs, tokens), window))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in (part for whole in batches for part in by_bytes(whole, at, TEXT_BYTES)):
                yield b.filter(pa.array([not index.value.hits(words_of(x or ""))[0] for x in b.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("hits", "items")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM i WHERE len(w) > 0)
), occ AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win))
), hit AS (SELECT DISTINCT r, s, n, item_id FROM occ JOIN win USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
