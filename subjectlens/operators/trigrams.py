"""Substring search with an index: postings of pieces of up to three letters, intersected by rarity, verified by the text itself."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from subjectlens.operators.patterns import automaton
from subjectlens.operators.tables import fresh_path, written

GRAM = 3
#: Folders of the postings table; a search for given words opens those of its pieces only.
BUCKETS = 64
#: Pieces of a needle that are looked up: its rarest.
LOOKED_UP = 4
#: Characters of the texts of a block, about, and the most rows that it has.
BLOCK_CHARS, BLOCK_ROWS = 4_000_000, 1 << 14
#: Keys that are numbered by a table of all that can be, not by sorting, and cells of bits that are held at once.
TABLE, CELLS = 1 << 24, 1 << 26
#: Words of a text that are looked for one by one; more of them are found in one pass over the text.
MOST_LOOKS = 16


def pieces(characters: Column) -> Column:
    """The distinct pieces of three letters of a needle given as its characters; a shorter one is a piece by itself."""
    whole = F.transform(F.slice(characters, 1, F.greatest(F.size(characters) - (GRAM - 1), F.lit(0))), lambda c, i: F.concat(c, *[F.get(characters, i + k) for k in range(1, GRAM)]))
    return F.when(F.size(characters) >= GRAM, F.array_distinct(whole)).otherwise(F.array(F.array_join(characters, "")))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _numbers(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys below `most`, and the place of each key among them."""
    if most > TABLE:
        return np.unique(keys, return_inverse=True)
    there = np.zeros(most, bool)
    there[keys] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[keys]


def _pieces_of(places: np.ndarray, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """(pieces, bits by piece and place) for the pieces of one, two and three letters of texts, in parts.

    A piece of three letters, the last of which may lie behind the text's end, is a number whose digits are the letters'
    numbers and 0 behind the end. So shorter pieces are ranges of the longer ones, and their bits are unions.
    """
    lengths, size = np.array([len(x) for x in texts]), (int(places[-1]) // 8 + 1) * 8
    letters, codes = _numbers(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), 0x110000)
    if not len(codes):
        return
    base = len(letters) + 1
    kind = np.int32 if base**GRAM < 1 << 31 else np.int64
    ended, at = np.zeros(len(codes) + (GRAM - 1) * len(texts), kind), np.repeat(np.arange(len(texts)), lengths)
    own = np.arange(len(codes)) + (GRAM - 1) * at
    ended[own] = codes + 1
    keys = ended[: len(ended) - GRAM + 1].copy()
    for i in range(1, GRAM):
        keys *= base
        keys += ended[i : len(keys) + i]
    found, which = _numbers(keys[own], base**GRAM)
    if len(found) * size > CELLS and len(texts) > 1:
        half = len(texts) // 2
        for part in (slice(None, half), slice(half, None)):
            yield from _pieces_of(places[part], texts[part])
        return
    bits = np.zeros((len(found), size), np.uint8)
    bits[which, places[at]] = 1
    for k in range(GRAM, 0, -1):
        full = found % base > 0
        spelt = np.stack([letters[found[full] // base ** (k - 1 - i) % base - 1] for i in range(k)], 1).astype("<u4").tobytes().decode("utf-32-le")
        if spelt:
            yield [spelt[i : i + k] for i in range(0, len(spelt), k)], bits[full].view(bool)
        found = found // base
        first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        found, bits = found[first], np.bitwise_or.reduceat(bits.view(np.uint64), first, axis=0).view(np.uint8)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram, n, places) from (block, place, low): a row for each piece of a block, or of a part of it."""
    for batch in batches:
        at = np.asarray(batch["block"])
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            for grams, bits in _pieces_of(np.asarray(batch["place"][a:b]), batch["low"][a:b].to_pylist()):
                blocks, n = pa.array(np.full(len(grams), at[a]), pa.int64()), pa.array(bits.sum(1), pa.int32())
                places = pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([blocks, pa.array(grams), n, places], ["block", "gram", "n", "places"])


def _holding(texts: dict[int, str], bits: np.ndarray, words: list[list[str]]) -> Iterator[np.ndarray]:
    """For each row of bits(place) the places whose text holds all its words; those without words stand as they are.

    Many words are looked for at once, in one pass over each text: a word's candidates can be most of the texts.
    """
    known, left = {}, np.array([bool(x) for x in words], bool)
    near = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[left], axis=0))) if left.any() else ()
    if at_once := int(np.bitwise_count(bits[left]).sum()) > MOST_LOOKS * len(near):
        number = {w: k for k, w in enumerate(dict.fromkeys(w for x in words for w in x))}
        machine, known = automaton(number), defaultdict(list)
        for p in near:
            for k in {k for _, k in machine.iter(texts[int(p)])}:
                known[k].append(p)
    for row, own in zip(bits, words, strict=True):
        if at_once and own:
            first, *rest = (known[number[w]] for w in own)
            yield np.array(sorted(set(first).intersection(*rest)) if rest else first, int)
        else:
            found = np.flatnonzero(np.unpackbits(row))
            yield np.array([p for p in found.tolist() if all(w in texts[p] for w in own)], int) if own else found


def _met(block: pa.Table, asked: pa.Table) -> pa.Table:
    """(needle, ids) of a block: its postings and its texts in, and what is asked as (needle, words, keys)."""
    text = pc.is_null(block["gram"])
    rows, low = np.flatnonzero(np.asarray(text)), block["low"].filter(text).to_pylist()
    at = np.asarray(block["place"].filter(text), dtype=int)
    size = int(at.max(initial=-1)) + 1
    texts, row_of = dict(zip(at.tolist(), low, strict=True)), np.full(-(-size // 8) * 8, -1)
    row_of[at] = rows
    posted = block.select(["gram", "places"]).filter(pc.invert(text))
    grams = pc.unique(posted["gram"])
    bits = np.zeros((len(grams) + 1, -(-size // 8)), np.uint8)  # the last one for pieces that the block doesn't have
    for g, part in zip(pc.index_in(posted["gram"], value_set=grams).to_pylist(), posted["places"].to_pylist(), strict=True):
        bits[g, : len(part)] |= np.frombuffer(part, np.uint8)
    looked = pa.chunked_array(asked["keys"].chunks).combine_chunks()
    keys = np.asarray(pc.fill_null(pc.index_in(looked.flatten(), value_set=grams), len(grams)))
    starts = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(looked)))].astype(int)
    ids, needles, ends = [], [], [0]
    for a in range(0, len(asked), step := max(1, CELLS // 4 // max(8 * bits.shape[1], 1))):
        part = asked.slice(a, step)
        b = a + len(part)
        both = np.bitwise_and.reduceat(bits[keys[starts[a] : starts[b]]], starts[a:b] - starts[a], axis=0)
        some = np.flatnonzero(both.any(1))
        both, part = both[some], part.take(pa.array(some))
        open_ = [[w for w in words if w not in has] for words, has in zip(part["words"].to_pylist(), part["keys"].to_pylist(), strict=True)]
        for needle, found in zip(part["needle"].to_pylist(), _holding(texts, both, open_), strict=True):
            if len(found):
                needles.append(needle)
                ids.append(row_of[found])
                ends.append(ends[-1] + len(found))
    taken = block["id"].combine_chunks().take(pa.array(np.concatenate(ids) if ids else np.zeros(0, int)))
    return pa.table({"needle": pa.array(needles, pa.string()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken)})


class TrigramIndex:
    """An index over rows(id, text) in the shared folder; ids are unique.

    Rows are kept in blocks as they come, about BLOCK_CHARS characters each. postings(bucket, gram, block, n, places) says
    which rows of a block hold a piece of one, two or three letters, as bits; it has a folder for each bucket and is sorted by
    piece, so given words read their buckets, and of these the row groups that hold them; counts(gram, n) says how rare a
    piece is. Null texts are not indexed; texts and needles are compared in lower case.
    """

    def __init__(self, rows: DataFrame):
        spark, whole = rows.sparkSession, rows.select("id", "text").filter("text is not null")
        mean = whole.agg(F.avg(F.char_length("text"))).first()[0] or 1.0
        size = 1 << (max(1, min(BLOCK_ROWS, int(BLOCK_CHARS / max(mean, 1.0)))).bit_length() - 1)
        place = F.monotonically_increasing_id()  # counts the rows of a task; blocks are what is written here
        numbered = whole.withColumn("at", place).select(F.floor(F.col("at") / size).cast("long").alias("block"), (F.col("at") % size).cast("int").alias("place"), "id", "text")
        path = fresh_path(spark, "indexed")
        numbered.write.option("maxRecordsPerFile", size).parquet(path)  # a block a file, so that tasks can share them
        self.rows = spark.read.schema(numbered.schema).parquet(path)
        flat = self.rows.select("block", "place", F.lower("text").alias("low")).mapInArrow(_posted, "block long, gram string, n int, places binary").withColumn("bucket", _bucket(F.col("gram")))
        path = fresh_path(spark, "postings")
        # a piece of every text would be one task's: rows of a bucket are dealt out further by their blocks
        dealt = flat.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(8))).sortWithinPartitions("bucket", "gram", "block")
        dealt.write.partitionBy("bucket").parquet(path)
        self.postings = spark.read.schema(dealt.select("gram", "block", "n", "places", "bucket").schema).parquet(path)
        self.counts = written(self.postings.groupBy("gram").agg(F.sum("n").alias("n")), "grams")

    def _found(self, asked: DataFrame, postings: DataFrame) -> DataFrame:
        """(needle, id) for asked(needle, words, keys): the rows that have all the keys as pieces and hold all the words.

        The postings and texts of a block meet all that is asked in one task, so neither postings nor candidates are
        copied for each needle.
        """
        none = lambda name: F.lit(None).cast(self.rows.schema[name].dataType).alias(name)
        lists = postings.select("block", none("place"), none("id"), F.lit(None).cast("string").alias("low"), "gram", "places")
        texts = self.rows.select("block", "place", "id", F.lower("text").alias("low"), F.lit(None).cast("string").alias("gram"), F.lit(None).cast("binary").alias("places"))
        every = asked.crossJoin(F.broadcast(self.rows.select("block").distinct()))  # a number for each block
        kind = self.rows.schema["id"].dataType.simpleString()
        met = lists.unionByName(texts).groupBy("block").cogroup(every.groupBy("block")).applyInArrow(_met, f"needle string, ids array<{kind}>")
        return met.select("needle", F.explode("ids").alias("id"))

    def search(self, needles: DataFrame) -> DataFrame:
        """(needle, id): the rows whose text holds the needle, for each distinct needle of needles(needle).

        A needle's rarest pieces are looked up and their postings intersected, then the text decides. A needle of up to
        three characters is a piece itself, so its postings are the answer. The empty needle, which is in every text, and
        nulls find nothing.
        """
        asked = written(needles.select(F.lower("needle").alias("low"), "needle").filter("needle <> ''").distinct(), "needles")
        flat = asked.select("needle", "low", F.explode(pieces(F.split("low", ""))).alias("gram"))
        counted = flat.join(self.counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rare = counted.withColumn("r", F.row_number().over(W.partitionBy("needle").orderBy("n", "gram"))).filter(F.col("r") <= LOOKED_UP)
        asked = written(rare.groupBy("needle", "low").agg(F.collect_list("gram").alias("keys")).select("needle", F.array("low").alias("words"), "keys"), "needles")
        wanted = asked.select(F.explode("keys").alias("gram")).distinct()
        return self._found(asked, self.postings.join(F.broadcast(wanted), "gram", "left_semi"))  # no more than there are pieces

    def holding(self, words: Iterable[str]) -> DataFrame:
        """(id): the rows whose text holds all the words. Only the buckets of the words' pieces are read; no words: no rows."""
        spark, low = self.rows.sparkSession, sorted({w.lower() for w in words})
        if not low or "" in low:
            return self.rows.limit(0).select("id")
        grams = sorted({g for w in low for g in ({w} if len(w) < GRAM else (w[i : i + GRAM] for i in range(len(w) - GRAM + 1)))})
        known = {r.gram: r.n for r in self.counts.filter(F.col("gram").isin(grams)).collect()}  # a row for each piece of the words
        rare = sorted(grams, key=lambda g: (known.get(g, 0), g))[:LOOKED_UP]
        buckets = spark.range(1).select(F.array(*[_bucket(F.lit(g)) for g in rare]).alias("b")).first().b
        met = self.postings.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(rare))
        return self._found(spark.createDataFrame([("", low, rare)], "needle string, words array<string>, keys array<string>"), met).select("id")
