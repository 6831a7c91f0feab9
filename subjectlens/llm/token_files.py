"""Token ids as files: canonical length-limited Huffman codes from global counts, decoded block by block."""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subjectlens.llm.shared import by_bytes, fresh_path, need, read, shared_dir, stash, text_of

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Longest code; raised where the vocabulary in use needs more.
MAX_BITS = 16
#: Tokens in an independently decodable block.
BLOCK = 256
#: A file is closed after so many payload bytes.
FILE_BYTES = 64 << 20
TOKENS_A_PARTITION = 8_000_000
#: Words whose ids a worker remembers.
REMEMBERED = 250_000
#: Text that is split and looked up at once.
TEXT_BYTES = 8 << 20
MAGIC = b"TOKHUF01"
HEAD = struct.Struct("<8sIIIQQQI")


# ---------------------------------------------------------------- text to ids


class WordCache:
    """Ids of whole texts, word by word.

    The tokenizer's pattern never joins two non-space characters across a single space or line break, so a text whose
    white space is single spaces and line breaks has the ids of its words one after the other, and a word's ids are
    looked up if it has been seen. A text with other white space is cut at such places only and its pieces are not
    remembered.
    """

    _word = re.compile(r"\n?\S+").fullmatch
    _marks = ".,;:!?%*#$&()-\"|"
    _cuts = re.compile(r"(?<=\S)(?=[ \n]\S)")

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for texts that hold the string of an added token
        self.added = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True  # words are encoded without looking for such strings
        for t in (self.tokenizer, self.plain):
            t.no_padding()
            t.no_truncation()
        self.dtype, self.width = np.dtype(dtype), np.dtype(dtype).itemsize
        self.code = {2: "H", 4: "I"}[self.width]
        #: Ids by word: "\nword" stands for itself, "word" for " word".
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        # the tokenizer writes bytes as characters: those that show stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.written = {k: k if k in shown else next(hidden) for k in range(256)}
        probe = ("word", "Zürich", "ñandú", "x")
        self.direct = all(self._letters(" " + w) == self._bytes([" " + w])[0] and self._letters(w) == self._bytes([w])[0] for w in probe)

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: str) -> bytes:
        """Ids of a word of letters, with or without a space before it: one piece of the tokenizer's pattern."""
        word = "Ġ" + word[1:] if word.isascii() and word[0] == " " else word.encode().decode("latin-1").translate(self.written)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of each text; words of letters skip the cutting."""
        if not self.direct:
            return self._bytes(words)
        rest = [k for k, w in enumerate(words) if not w.strip(" ").isalpha()]
        other = dict(zip(rest, self._bytes([words[k] for k in rest]), strict=True)) if rest else {}
        return [other[k] if k in other else self._letters(w) for k, w in enumerate(words)]

    def learn(self, words: list[str]) -> None:
        """Encodes new words. ASCII marks at the end of a word are ids of their own, so a word known without them is not new."""
        known, new, tails = self.known, {}, []
        for w in words:
            core = w.rstrip(self._marks)
            if core != w and core.isalpha():
                tails.append((w, core, w[len(core) :]))
                if core not in known:
                    new[core] = None
            else:
                new[w] = None
        known.update(zip(new, self.ids_of([w if w[0] == "\n" else " " + w for w in new]), strict=True))
        if lone := list({t for _, _, t in tails if t not in self.tails}):
            self.tails.update(zip(lone, self._bytes(lone), strict=True))
        for w, core, tail in tails:
            known[w] = known[core] + self.tails[tail]

    def look_up(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of distinct words, and the numbers of those that hold other white space. Words not met for long are forgotten."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
            self.tails.clear()
        found = list(map(self.known.get, words))
        missing = [k for k, x in enumerate(found) if x is None]
        new, odd = [], []
        for k in missing:
            w = words[k]
            if (x := self.older.get(w)) is not None:
                self.known[w] = x
            else:
                (new if self._word(w) else odd).append(k)
        self.learn([words[k] for k in new])
        for k in missing:
            found[k] = self.known.get(words[k], b"")
        return found, odd

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (no nulls). Texts that hold the string of an added token are encoded whole."""
        held = np.zeros(len(texts), bool)
        for x in self.added:
            held |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if not held.any():
            return self._by_words(texts)
        rest = iter(self._by_words(texts.filter(pa.array(~held))))
        whole = iter(texts.filter(pa.array(held)).to_pylist())
        return [np.array(self.plain.encode(next(whole), add_special_tokens=False).ids, self.dtype).tobytes() if x else next(rest) for x in held.tolist()]

    def _by_words(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. Words are looked up once for all texts."""
        n = len(texts)
        if not n:
            return []
        pieces = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n"), " ")
        coded = pieces.flatten().dictionary_encode()
        code, at = coded.indices.to_numpy().astype(np.int64), pieces.offsets.to_numpy()
        words = coded.dictionary.to_pylist()
        heads = [words[k] for k in code[at[:-1]].tolist()]
        found, odd = self.look_up(words)
        code[at[:-1]] = np.arange(len(words), len(words) + n)  # a text's first word has no space before it
        found += self.ids_of(heads)
        table = np.frombuffer(b"".join(found), self.dtype)
        size = np.array([len(x) for x in found]) // self.width
        start = np.cumsum(size) - size
        sizes = size[code]
        ends = np.cumsum(sizes)
        place = np.repeat(start[code] - ends + sizes, sizes)
        place += np.arange(len(place))
        data, bounds = table[place].tobytes(), (np.r_[0, ends][at] * self.width).tolist()
        out = [data[a:e] for a, e in zip(bounds, bounds[1:], strict=False)]
        other = {i for i, w in enumerate(heads) if at[i + 1] - at[i] > 1 and not self._word(w)}
        if odd:
            is_odd = np.zeros(len(found), bool)
            is_odd[odd] = True
            other |= set((np.searchsorted(at, np.flatnonzero(is_odd[code]), side="right") - 1).tolist())
        for i in other:
            out[i] = b"".join(self._bytes(self._cuts.split(texts[i].as_py())))
        return out


@lru_cache(maxsize=2)
def word_cache(path: str, dtype: str) -> WordCache:
    return WordCache(path, dtype)


def with_ids(docs: DataFrame, path: str, dtype: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids): the ids of each text with the end id, as little-endian unsigned integers."""
    end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(path, dtype)
        for b in batches:
            for part in by_bytes(b, 1, TEXT_BYTES):
                ids = [x + end for x in cache.encode(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n long, ids binary")


def id_counts(ids: DataFrame, dtype: str) -> np.ndarray:
    """How often each id occurs; at most one row per id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            c = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype))
            if len(c) > len(total):
                c[: len(total)] += total
                total = c
            else:
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


# ---------------------------------------------------------------- codes


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of the best prefix code with no length above limit (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out, n = np.zeros(len(counts), np.uint8), len(used)
    if n <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    packages, merges = np.empty(0, np.int64), []
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        merges.append(at >= n)
        both = both[at]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take, lengths = 2 * (n - 1), np.zeros(n, np.int64)
    for packed in reversed(merges):
        inside = int(packed[:take].sum())
        lengths[: take - inside] += 1
        take = 2 * inside
    out[order] = lengths
    return out


class Code:
    """Canonical codes of the given lengths: shorter first, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths = np.asarray(lengths, np.uint8)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        size = lengths[order].astype(np.int64)
        self.bits = bits = max(1, int(size.max(initial=1)))
        span = 1 << (bits - size)
        self.codes = np.zeros(len(lengths), np.uint32)
        self.codes[order] = ((np.cumsum(span) - span) >> (bits - size)).astype(np.uint32)
        room = (1 << bits) - int(span.sum())
        self.symbol = np.concatenate([np.repeat(order, span), np.zeros(room, np.int64)]).astype(np.uint32)
        self.size = np.concatenate([np.repeat(size, span), np.ones(room, np.int64)]).astype(np.int64)

    def encode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Texts laid end to end (text i ends before ends[i]) as bytes, each starting at a full byte.

        Returns the bytes, the byte length of each text, the bit offset of each block in its text, and blocks by text.
        """
        size, n = self.lengths[ids].astype(np.int64), np.diff(np.r_[0, ends])
        after = np.r_[0, np.cumsum(size)]
        bits = after[ends] - after[np.r_[0, ends[:-1]]]
        length = -(-bits // 8)
        start = np.cumsum(length) - length
        first = np.repeat(np.r_[0, ends[:-1]], n)
        inside = after[:-1] - after[first]
        at = inside + 8 * np.repeat(start, n)
        out = np.zeros(int(length.sum()) // 8 + 2, np.uint64)
        if len(ids):
            word, code = at >> 6, self.codes[ids].astype(np.uint64)
            room = 64 - (at & 63) - size  # below 0 where a code reaches into the next word
            over = np.flatnonzero(room < 0)
            high = code << np.maximum(room, 0).astype(np.uint64)
            high[over] = code[over] >> (-room[over]).astype(np.uint64)
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            out[word[heads]] = np.bitwise_or.reduceat(high, heads)
            out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        place = np.arange(len(ids)) - first
        return out.byteswap().tobytes()[: int(length.sum())], length, inside[place % BLOCK == 0], -(-n // BLOCK)

    def decode(self, data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Ids of blocks that start at bit `at` of data and hold `n` ids each, one block after the other.

        All blocks advance together, one table lookup for each id.
        """
        out_at = np.cumsum(n) - n
        order = np.argsort(-n, kind="stable")
        at, n, place = at[order].copy(), n[order], out_at[order]
        data = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint32)
        out, mask = np.empty(int(n.sum()), np.uint32), (1 << self.bits) - 1
        alive = np.searchsorted(-n, -np.arange(int(n.max(initial=0))), side="left")
        for step, k in enumerate(alive):
            bit = at[:k]
            byte = bit >> 3
            window = (data[byte] << 24) | (data[byte + 1] << 16) | (data[byte + 2] << 8) | data[byte + 3]
            code = (window >> (32 - self.bits - (bit & 7)).astype(np.uint32)) & mask
            out[place[:k] + step] = self.symbol[code]
            at[:k] += self.size[code]
        return out


# ---------------------------------------------------------------- files


def open_shared(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a file in the shared folder, whatever store holds it."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write_file(path: str, code: Code, docs: list[tuple]) -> None:
    """docs: (doc_id or None, n, bytes, block offsets). The file appears under its name only when it is whole."""
    body = io.BytesIO()
    ids = np.array([d[0] or 0 for d in docs], "<i8")
    body.write(np.packbits([d[0] is None for d in docs]).tobytes())
    for column in (ids, np.array([d[1] for d in docs], "<i8"), np.array([len(d[2]) for d in docs], "<i8"), np.concatenate([np.frombuffer(d[3], "<u8") for d in docs])):
        body.write(column.tobytes())
    lengths = zlib.compress(code.lengths.tobytes(), 6)
    table, payload = body.getvalue(), b"".join(d[2] for d in docs)
    fs, name = open_shared(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(name + ".part") as out:
        out.write(HEAD.pack(MAGIC, BLOCK, len(code.lengths), len(docs), len(lengths), len(table), len(payload), zlib.crc32(payload, zlib.crc32(table))))
        for x in (lengths, table, payload):
            out.write(x)
    fs.move(name + ".part", name)


def read_file(path: str, tokens: int = 2_000_000) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, ids in each, all their ids) in pieces of about so many tokens."""
    fs, name = open_shared(path)
    with fs.open_input_file(name) as f:
        magic, block, n_symbols, n_docs, n_lengths, n_table, n_payload, crc = HEAD.unpack(f.read(HEAD.size))
        lengths, table, payload = (f.read(k) for k in (n_lengths, n_table, n_payload))
    if magic != MAGIC or zlib.crc32(payload, zlib.crc32(table)) != crc:
        raise ValueError(f"{path} is damaged")
    code = Code(np.frombuffer(zlib.decompress(lengths), np.uint8))
    nulls = np.unpackbits(np.frombuffer(table, np.uint8, -(-n_docs // 8)))[:n_docs].astype(bool)
    ids, n, size = (np.frombuffer(table, "<i8", n_docs, -(-n_docs // 8) + 8 * n_docs * k) for k in range(3))
    offsets = np.frombuffer(table, "<u8", -1, -(-n_docs // 8) + 24 * n_docs).astype(np.int64)
    data, blocks = np.frombuffer(payload, np.uint8), -(-n // block)
    byte, first_block = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(blocks)]
    i = 0
    while i < n_docs:
        j = min(n_docs, max(i + 1, i + int(np.searchsorted(np.cumsum(n[i:]), tokens, side="right"))))
        count = np.full(first_block[j] - first_block[i], block, np.int64)
        count[first_block[i + 1 : j + 1] - first_block[i] - 1] = n[i:j] - (blocks[i:j] - 1) * block
        at = offsets[first_block[i] : first_block[j]] + 8 * np.repeat(byte[i:j] - byte[i], blocks[i:j])
        yield [None if z else int(x) for x, z in zip(ids[i:j], nulls[i:j], strict=True)], n[i:j], code.decode(data[byte[i] : byte[j]], at, count)
        i = j


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, limit: int = MAX_BITS) -> DataFrame:
    """Encodes docs(doc_id, text) and returns the manifest (path, part, seq, n_docs, n_tokens).

    Files follow each other by (part, seq) in ascending doc_id order, nulls last; rows that repeat an id are ordered by
    length and content. Every file has its own code table, so any file can be read alone, and any block in it.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    dtype = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    ids = with_ids(need(docs, "doc_id", "text"), tokenizer, dtype, end_id)
    ids.write.option("compression", "zstd").parquet(at := fresh_path(spark, "token-ids"))
    ids = spark.read.schema("doc_id long, n long, ids binary").parquet(at)
    code = spark.sparkContext.broadcast(Code(code_lengths(id_counts(ids, dtype), limit)))

    total = ids.agg(F.sum("n")).first()[0] or 0
    n_parts = max(-(-total // TOKENS_A_PARTITION), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def encoded(b: pa.RecordBatch) -> Iterator[tuple]:
        for i in range(0, b.num_rows, 128):
            s = b.slice(i, 128)
            n = s.column(1).to_numpy()
            flat = np.frombuffer(b"".join(s.column(2).to_pylist()), dtype)
            data, length, offsets, blocks = code.value.encode(flat, np.cumsum(n))
            ends, marks, offsets = np.cumsum(length).tolist(), (8 * np.cumsum(blocks)).tolist(), offsets.astype("<u8").tobytes()
            for k, doc_id in enumerate(s.column(0).to_pylist()):
                yield doc_id, int(n[k]), data[ends[k] - int(length[k]) : ends[k]], offsets[marks[k] - 8 * int(blocks[k]) : marks[k]]

    folder = fresh_path(spark, "token-files")
    shared_dir(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs_, size, done = TaskContext.get().partitionId(), [], 0, []

        def close():
            path = f"{folder}/part-{number:06d}-{len(done):04d}-{uuid.uuid4().hex[:12]}.tok"
            write_file(path, code.value, docs_)
            done.append((path, number, len(done), len(docs_), sum(d[1] for d in docs_)))

        for b in batches:
            for row in encoded(b):
                docs_.append(row)
                size += len(row[2])
                if size >= FILE_BYTES:
                    close()
                    docs_, size = [], 0
        if docs_:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "part", "seq", "n_docs", "n_tokens"), d, strict=True)) for d in done], schema=pa.schema([("path", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    order = F.col("doc_id").asc_nulls_last(), F.col("n").asc()
    placed = ids.repartitionByRange(n_parts, *order).sortWithinPartitions(*order, "ids")
    return stash(placed.mapInArrow(write, "path string, part long, seq long, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, decoded from the files; start counts the ids of all documents before."""
    spark = manifest.sparkSession
    ahead = F.coalesce(F.sum("n_tokens").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for ids, n, flat in read_file(path):
                    ends = np.cumsum(n)
                    flat = flat.astype("<u4", copy=False)
                    crc = [zlib.crc32(flat[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(n.sum())

    files = manifest.select("path", ahead.alias("start")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the token files of docs(doc_id, text) and reads them back: one row per row of docs.

    Null or empty text has the end id alone; an empty table gives no files and no rows; further columns are ignored.
    """
    return read_token_files(write_token_files(docs, tokenizer or public_tokenizers.path(TOKENIZER), end_id))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read(spark, sf_dir, "documents"))
