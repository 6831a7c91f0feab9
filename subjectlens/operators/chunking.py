"""Texts in chunks: by words, by words with offsets, by sentences, by lines, by sections. No chunker shuffles."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"


def check_sizes(size: int, overlap: int) -> int:
    """The step between chunks. An overlap that is not smaller than the size would never end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    return size - overlap


def check_bounds(size: int, overlap: int, most: int) -> None:
    """Sizes of 50 to 2000 words, overlaps of 0 to 500, chunks of at least 100 words at most."""
    check_sizes(size, overlap)
    if not (50 <= size <= 2000 and overlap <= 500 and most >= 100):
        raise ValueError("size must be 50 to 2000, overlap 0 to 500, most at least 100")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _numbers(n: Column) -> Column:
    """0 .. n - 1."""
    return F.sequence(F.lit(0), n.cast("int") - 1)


def word_chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_index, text, word_count). A short text is one chunk as it is; a blank one has none.

    Chunk k starts at word k * step; the last one ends with the text. Chunks are built inside the row, so no row carries
    the whole text once for each of them.
    """
    step = check_sizes(size, overlap)
    rows = docs.select("doc_id", "text", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n = F.size("w")
    last = F.greatest(F.lit(1), F.ceil(n / step) - 1).cast("int")

    def chunk(k: Column) -> Column:
        start = F.when(k < last, k * step).otherwise(F.least(last * step, n - overlap))
        stop = F.when(k < last, F.least(k * step + size, n)).otherwise(n)
        return F.struct(F.array_join(F.slice("w", start + 1, stop - start), " ").alias("text"), (stop - start).alias("word_count"))

    whole = F.array(F.struct(F.col("text").alias("text"), n.alias("word_count")))
    chunks = F.when(n <= size, whole).otherwise(F.transform(_numbers(last + 1), chunk))
    return rows.select("doc_id", F.posexplode(chunks).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.text", "c.word_count")


def offset_chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_index, start_offset, end_offset, text, word_count); offsets in code points.

    Pieces are words with the white space before them. Lengths are added up once for each step, then over the steps, so
    the work grows with the text and not with its square.
    """
    step = check_sizes(size, overlap)
    pieces = F.regexp_extract_all("text", F.lit(r"\s*\S+"), F.lit(0))
    rows = docs.select("doc_id", "text", pieces.alias("w")).filter(F.size("w") > 0)
    n = F.size("w")
    total = lambda first, k: F.aggregate(F.slice("w", first, k), F.lit(0), lambda a, x: a + F.length(x))
    count = F.ceil((n - size) / step).cast("int") + 1
    steps = F.when(n > size, F.transform(_numbers(count - 1), lambda k: total(k * step + 1, F.lit(step))))
    before = F.aggregate(F.when(count > 1, steps).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    rows = rows.select("doc_id", "text", "w", F.when(n > size, before).alias("before"))

    def chunk(start: Column, k: Column) -> Column:
        first, held = k * step + 1, F.least(F.lit(size), n - k * step)
        raw = F.array_join(F.slice("w", first, held), "")
        body = F.regexp_replace(raw, r"^\s+", "")
        end = start + F.length(raw)
        return F.struct((end - F.length(body)).alias("start_offset"), end.alias("end_offset"), body.alias("text"), held.alias("word_count"))

    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    whole = F.array(F.struct(F.lit(0).alias("start_offset"), F.length("text").alias("end_offset"), trimmed.alias("text"), n.alias("word_count")))
    chunks = F.when(n <= size, whole).otherwise(F.transform("before", chunk))
    out = rows.select("doc_id", F.posexplode(chunks).alias("chunk_index", "c"))
    return out.select("doc_id", "chunk_index", "c.start_offset", "c.end_offset", "c.text", "c.word_count")


def sentences(text: Column) -> Column:
    """T03."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")  # F.trim itself would take the place for the letters to trim


def packed(lengths: list[int], size: int, overlap: int, most: int) -> list[tuple[int, int]]:
    """Sentence ranges. A chunk is filled up to `size` words, never above `most` unless one sentence alone is longer;
    the next one starts with the trailing sentences that have at most `overlap` words. The chunk with the last sentence ends it."""
    out, i, n = [], 0, len(lengths)
    while i < n:
        total, j = 0, i
        while j < n and total < size and (j == i or total + lengths[j] <= most):
            total += lengths[j]
            j += 1
        out.append((i, j))
        if j >= n:
            break
        back, k = 0, j
        while k - 1 > i and back + lengths[k - 1] <= overlap:
            k -= 1
            back += lengths[k]
        while k < j and back + lengths[j] > most:  # so the next chunk has room for a sentence that is new
            back -= lengths[k]
            k += 1
        i = k
    return out


def word_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """T02 for one text: start and end offsets of its chunks."""
    spans, step = [m.span() for m in re.finditer(r"\S+", text)], size - overlap
    if len(spans) <= size:
        return [(0, len(text))] if spans else []
    return [(spans[k][0], spans[min(k + size, len(spans)) - 1][1]) for k in range(0, -(-(len(spans) - size) // step) * step + 1, step)]


def packed_lines(lengths: list[int], most: int) -> list[tuple[int, int]]:
    """Line ranges of at most `most` characters with their line breaks; a longer line is alone."""
    out, i = [], 0
    while i < len(lengths):
        total, j = lengths[i] + 1, i + 1
        while j < len(lengths) and total + lengths[j] + 1 <= most:
            total += lengths[j] + 1
            j += 1
        out.append((i, j))
        i = j
    return out


def _spans(docs: DataFrame, cut: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """(doc_id, chunk_index, start_offset, end_offset, text, word_count): cut(text) gives the chunks of one text as offsets."""
    typed = pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("text", pa.string()), ("word_count", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                ids, texts = (b.column(c).slice(i, 256).to_pylist() for c in (0, 1))
                rows = [(d, k, a, e, t[a:e], len(t[a:e].split())) for d, t in zip(ids, texts, strict=True) if t for k, (a, e) in enumerate(cut(t))]
                columns = list(zip(*rows, strict=True)) or [[]] * len(typed)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, typed, strict=True)], schema=typed)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, chunk_index int, start_offset int, end_offset int, text string, word_count int")


def sentence_spans(text: str, size: int, overlap: int, most: int) -> list[tuple[int, int]]:
    """T04 for one text; one of two sentences or fewer is cut by words."""
    found, at = [], 0
    for m in re.finditer(SENTENCE_END, text):
        found.append((at, m.start()))
        at = m.end()
    found.append((at, len(text)))
    if len(found) <= 2:
        return word_spans(text, size, overlap)
    return [(found[a][0], found[b - 1][1]) for a, b in packed([len(text[x:y].split()) for x, y in found], size, overlap, most)]


def sentence_chunks(docs: DataFrame, size: int = 500, overlap: int = 50, most: int = 800) -> DataFrame:
    """Sentences packed into chunks with offsets. Null and empty texts have none."""
    check_bounds(size, overlap, most)
    return _spans(docs, lambda text: sentence_spans(text, size, overlap, most))


def line_spans(text: str, most: int) -> list[tuple[int, int]]:
    """T08 for one text."""
    ends = list(itertools.accumulate(len(x) + 1 for x in text.split("\n")))
    starts = [0, *ends]
    return [(starts[a], ends[b - 1] - 1) for a, b in packed_lines([e - s - 1 for s, e in zip(starts, ends, strict=False)], most)]


def line_chunks(docs: DataFrame, most: int = 3000) -> DataFrame:
    """Lines packed into chunks of at most `most` characters."""
    return _spans(docs, lambda text: line_spans(text, most))


def token_chunks(docs: DataFrame, tokens: int = 400, overlap: int = 40, count: Callable[[Column], Column] | None = None) -> DataFrame:
    """Word chunks for a token limit (0.8 words a token); those above the limit are cut again at half the size.

    count gives the tokens of a text, such as a tokenizer's; without it four characters are one.
    """
    size, over = int(tokens * 0.8), int(overlap * 0.8)
    first = offset_chunks(docs, size, over)
    large = (count(F.col("text")) if count else F.floor(F.length("text") / 4)) > tokens
    small = first.filter(~large).select("doc_id", F.col("chunk_index").alias("a"), F.lit(0).alias("b"), "start_offset", "end_offset", "text", "word_count")
    again = offset_chunks(first.filter(large).select(F.struct("doc_id", "chunk_index", "start_offset").alias("doc_id"), "text"), max(2, size // 2), over // 2)
    base = F.col("doc_id.start_offset")
    again = again.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.chunk_index").alias("a"), F.col("chunk_index").alias("b"), (base + F.col("start_offset")).cast("int").alias("start_offset"), (base + F.col("end_offset")).cast("int").alias("end_offset"), "text", "word_count")
    number = (F.row_number().over(W.partitionBy("doc_id").orderBy("a", "b")) - 1).alias("chunk_index")
    return small.unionByName(again).select("doc_id", number, "start_offset", "end_offset", "text", "word_count")


def with_context(chunks: DataFrame, k: int = 1) -> DataFrame:
    """Each chunk with the k chunks before and after it, joined by a space."""
    near = W.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(-k, k)
    return chunks.withColumn("context", F.array_join(F.collect_list("text").over(near), " "))


def lines_with_section(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text, section): the last header at or above each line, else preamble."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    head = F.regexp_extract("text", r"(?i)^\s*((?:Article|Section|Chapter)\s+\d+)", 1)
    above = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("section", F.coalesce(F.last(F.when(head != "", F.lower(head)), ignorenulls=True).over(above), F.lit("preamble")))


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, n_lines, text): lines by section; of sections with the same header the last one stays."""
    lines = lines_with_section(docs)
    head = F.col("text").rlike(r"(?i)^\s*(Article|Section|Chapter)\s+\d+")
    upto = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("number", F.count_if(head).over(upto))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    every = lines.groupBy("doc_id", "section", "number").agg(F.count("*").alias("n_lines"), body.alias("text"))
    best = F.max_by(F.struct("n_lines", "text"), "number").alias("x")
    return every.groupBy("doc_id", "section").agg(best).select("doc_id", "section", "x.n_lines", "x.text")


def line_search(docs: DataFrame, terms: list[str], around: int = 5, most: int = 10, least: float = 0.5) -> DataFrame:
    """Lines that hold at least `least` of the terms, with context and section; of hits in one place the best stays."""
    lines = lines_with_section(docs)
    low = F.lower("text")
    hits = sum((F.contains(low, F.lit(x.lower())).cast("int") for x in terms), F.lit(0))
    frame = W.partitionBy("doc_id").orderBy("line").rowsBetween(-around, around)
    lines = lines.withColumn("context", F.array_join(F.collect_list("text").over(frame), "\n")).withColumn("score", hits / F.lit(len(terms)))
    found = lines.filter(F.col("score") >= least).withColumn("a", F.floor(F.greatest(F.col("line") - around, F.lit(0)) / 10)).withColumn("b", F.floor((F.col("line") + around) / 10))
    best = found.withColumn("r", F.row_number().over(W.partitionBy("doc_id", "a", "b").orderBy(F.desc("score"), "line"))).filter("r = 1")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "line"))).filter(F.col("rank") <= most)
    return ranked.select("doc_id", "line", "section", "score", "context", "rank")
