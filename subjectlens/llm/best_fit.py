"""Packing documents into sequences: online best-fit with a fixed number of open bins in a bitset keyed by free space."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjectlens.llm.shared import by_bytes, need, read, stash, text_of
from subjectlens.llm.token_files import TEXT_BYTES, TOKENIZER, word_cache

END_ID = 0
CAPACITY = 2048
#: Bins that a task keeps open.
OPEN_BINS = 8192
#: Pieces that a task packs again in a later round, about.
PIECES_A_TASK = 16_384
#: Sequences of a task and tasks of a round that an id has room for: round, partition and number share its bits.
NUMBER_BITS, PARTITION_BITS = 32, 24

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, sequence_id long, offset long"


class Bins:
    """Online best-fit with `most` open bins: bit f of `free` is set if an open bin has f units of free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.n, self.free = capacity, most, 0, 0
        self.by_free: dict[int, list[list]] = {}

    def _out(self, f: int) -> list:
        bins = self.by_free[f]
        found = bins.pop()
        if not bins:
            del self.by_free[f]
            self.free ^= 1 << f
        self.n -= 1
        return found

    def _in(self, f: int, held: list) -> None:
        if f in self.by_free:
            self.by_free[f].append(held)
        else:
            self.by_free[f] = [held]
            self.free |= 1 << f
        self.n += 1

    def put(self, size: int, item) -> tuple[list, int] | None:
        """Puts the item into the open bin that it fills best, or into a new one; returns the bin that closes by this, if one does, and its free space.

        A full bin closes. So does the fullest where a new bin would be one too many.
        """
        closed, fits = None, self.free >> size
        if fits:
            f = size + (fits & -fits).bit_length() - 1
            held = self._out(f)
        else:
            f, held = self.capacity, []
            if self.n >= self.most and size < self.capacity:
                least = (self.free & -self.free).bit_length() - 1
                closed = self._out(least), least
        held.append(item)
        if f == size:
            return held, 0
        self._in(f - size, held)
        return closed

    def rest(self) -> list[tuple[list, int]]:
        """The open bins and their free space, fullest first; none is open afterwards."""
        out = [(held, f) for f in sorted(self.by_free) for held in self.by_free[f]]
        self.by_free, self.free, self.n = {}, 0, 0
        return out


def _packed(rows: Iterator[tuple], round_: int, capacity: int, most: int, last: bool) -> Iterator[tuple[list, int | None]]:
    """(bin, its sequence id) for rows (doc_id, piece, start, length, crc); a bin that isn't full has no id, unless this is the last round."""
    number = (round_ << PARTITION_BITS | TaskContext.get().partitionId()) << NUMBER_BITS
    bins = Bins(capacity, most)
    for held, free in itertools.chain((x for row in rows if (x := bins.put(row[3], row))), _later(bins.rest)):
        final = last or free == 0
        yield held, number if final else None
        number += final


def _later(f) -> Iterator:
    """f's items; f is called when the first one is asked for."""
    yield from f()


def _batches(bins: Iterator[tuple[list, int | None]], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Bins as Arrow batches of placed pieces."""
    names = [c.split()[0] for c in PLACED.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in PLACED.split(", ")]
    out = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for held, number in bins:
        at = 0
        for row in held:
            out.append((*row, number, None if number is None else at))
            at += row[3]
        if len(out) >= rows:
            yield batch()
            out = []
    if out:
        yield batch()


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, most: int = OPEN_BINS) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document of more than `capacity` ids is cut into pieces of that many, its first piece has what is left over; each
    other document is one piece. Texts are encoded where they lie; a piece that fills a sequence is final, of the others
    only numbers are dealt out, evenly and a bounded number to a task. A task packs them best-fit, large ones first, with
    at most `most` bins open. Full bins are final, the pieces of others are dealt out and packed again among fewer
    tasks, so tasks leave no half-empty sequences, however many there are. The last round is the one that needs a single task, or
    the one after a round that left more than half of its pieces, which more rounds would not mend. Each round is a
    table in the shared folder.

    Null or empty text is the end id alone. Rows that repeat an id are documents of their own; ids may be null. Very long
    texts are encoded whole. An empty table gives an empty result; further columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    dtype = "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    end = np.array([end_id], dtype).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        cache = word_cache(path, dtype)
        for b in batches:
            for part in by_bytes(b, 1, TEXT_BYTES):
                for doc_id, x in zip(part.column(0).to_pylist(), cache.encode(part.column(1)), strict=True):
                    ids = np.frombuffer(x + end, dtype).astype("<u4")
                    cut = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for k, (a, e) in enumerate(zip(cut, cut[1:], strict=False)):
                        yield doc_id, k, a, e - a, zlib.crc32(ids[a:e])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << NUMBER_BITS)
        yield from _batches(([row], next(number) if row[3] == capacity else None) for row in pieces(batches))

    def again(round_: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield from _batches(_packed(rows, round_, capacity, most, last))

        return run

    texts = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    placed = stash(texts.mapInArrow(first, PLACED), "packed-0")
    done, round_, before, last = placed.filter("sequence_id is not null"), 0, None, False
    while not last and (left := (open_ := placed.filter("sequence_id is null").select(*[c.split()[0] for c in PIECE.split(", ")])).count()):
        tasks = -(-left // PIECES_A_TASK)
        last = tasks == 1 or (before is not None and 2 * left > before)
        round_, before = round_ + 1, left
        dealt = open_.repartition(tasks).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
        placed = stash(dealt.mapInArrow(again(round_, last), PLACED), f"packed-{round_}")
        done = done.union(placed.filter("sequence_id is not null"))
    return done


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
