"""SimHash near-duplicates with pivot distance tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjectlens.llm.shared import by_bytes, need, read, salted_join, stash, text_of
from subjectlens.operators.graph import components

SEED = 42
#: Words in a shingle of op9.
SHINGLE = 4
#: Differing bits up to which fingerprints link.
RADIUS = 4
#: Reference fingerprints of the distance table.
N_PIVOTS = 16
#: Text bytes that are brought into Python at once.
TEXT_BYTES = 8 << 20
#: A bucket with more fingerprints is cut into pieces of about half so many, and all pairs of pieces are compared.
HOT_BUCKET = 1024


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the XXH64 hashes of all shingles; A-Z count as a-z; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    h, total, digest = np.zeros(64, np.int64), len(words) - shingle + 1, xxhash.xxh64_intdigest
    for i in range(0, total, 4096):  # very long texts in pieces
        part = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[i : min(i + 4096, total)], ends[i + shingle - 1 :], strict=False)], np.uint64)
        h += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(h * 2 > total, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the unsigned fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_bytes(whole, 1, TEXT_BYTES)):
            fp = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints, fixed and far apart (about half of the bits differ between any two)."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(n)], np.uint64)


def pivot_table(fp: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference, one row per reference."""
    return np.stack([np.bitwise_count(fp ^ p) for p in reference]).astype(np.int8)


def linked(fp: np.ndarray, left: np.ndarray, right: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (left, right) differ in at most radius bits.

    By the triangle inequality the distances of two such fingerprints to any reference differ by at most radius, so a
    pair is discarded as soon as one coordinate differs by more; the survivors are verified bit by bit.
    """
    alive = np.arange(len(left))
    for row in table:
        alive = alive[np.abs(row[left[alive]] - row[right[alive]]) <= radius]
    return alive[np.bitwise_count(fp[left[alive]] ^ fp[right[alive]]) <= radius]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the links (a, b) among n nodes, the numbers of those that form a spanning forest."""
    parent, kept = list(range(n)), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, np.int64)


def _window_pairs(low: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one bucket, sorted by its first coordinate, whose first coordinates differ by at most radius, in pieces."""
    ends, n = np.searchsorted(low, low + radius, side="right"), len(low)
    i = 0
    while i < n:
        j, room = i, 2_000_000
        while j < n and (room := room - (ends[j] - j - 1)) > 0:
            j += 1
        j = max(j, i + 1)
        counts = ends[i:j] - np.arange(i, j) - 1
        left = np.repeat(np.arange(i, j), counts)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts)
        i = j


def bucket_links(fp: np.ndarray, reference: np.ndarray, radius: int, side: np.ndarray | None = None) -> np.ndarray:
    """A spanning forest of the links within one bucket; with side, of those between the two sides."""
    table = pivot_table(fp, reference)
    order = np.argsort(table[0], kind="stable")
    fp, table = fp[order], table[:, order]
    side = None if side is None else side[order]
    found: list[np.ndarray] = []
    for left, right in _window_pairs(table[0].astype(np.int64), radius):
        if side is not None:
            keep = side[left] != side[right]
            left, right = left[keep], right[keep]
        ok = linked(fp, left, right, table[1:], radius)
        if len(ok):
            found.append(np.stack([left[ok], right[ok]]))
            if sum(x.shape[1] for x in found) > 4 * len(fp):
                pairs = np.concatenate(found, 1)
                found = [pairs[:, forest(len(fp), *pairs)]]
    if not found:
        return np.empty((2, 0), np.uint64)
    pairs = np.concatenate(found, 1)
    return fp[pairs[:, forest(len(fp), *pairs)]]


def small_bucket_links(key: np.ndarray, fp: np.ndarray, reference: np.ndarray, radius: int) -> np.ndarray:
    """Links within many buckets at once; rows are sorted by key. Large buckets go one by one."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    out = [bucket_links(fp[s : s + n], reference, radius) for s, n in zip(starts[sizes > 32], sizes[sizes > 32], strict=True)]
    small = np.repeat((sizes > 1) & (sizes <= 32), sizes)
    if small.any():
        k, f = key[small], fp[small]
        table, i = pivot_table(f, reference), np.arange(len(f))
        for step in range(1, 32):
            i = i[i + step < len(f)]
            i = i[k[i] == k[i + step]]
            if not len(i):
                break
            ok = i[linked(f, i, i + step, table, radius)]
            out.append(np.stack([f[ok], f[ok + step]]))
    return np.concatenate(out, 1) if out else np.empty((2, 0), np.uint64)


def blocks_of(n: int, radius: int = RADIUS) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks (start, width) of the 64 bits, and the groups of blocks that make keys, for n fingerprints.

    Of radius + k blocks, k or more are untouched by radius differing bits, so every group of k blocks makes a key. k is
    the smallest number from 2 on whose keys are long enough for n random fingerprints to be about alone in a bucket.
    """
    for k in range(2, 64 - radius):
        number = radius + k
        width, wider = divmod(64, number)
        if k * width >= max(1, n).bit_length() - 2 or number >= 16:
            break
    sizes = [width + (i < wider) for i in range(number)]
    starts = list(itertools.accumulate(sizes, initial=0))
    return list(zip(starts, sizes, strict=False)), list(itertools.combinations(range(number), k))


def bucket_keys(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(key, fp): each fingerprint under every group of its blocks; the key's number is mixed in where it fits, else hashed in."""
    blocks, groups = blocks_of(n, radius)
    fp = F.col("fp")
    part = lambda i: F.shiftrightunsigned(fp, blocks[i][0]).bitwiseAND(F.lit((1 << blocks[i][1]) - 1))
    keys = []
    for number, group in enumerate(groups):
        key, bits = F.lit(0).cast("long"), 0
        for i in group:
            key, bits = F.shiftleft(key, blocks[i][1]).bitwiseOR(part(i)), bits + blocks[i][1]
        tagged = F.lit(number << bits).cast("long").bitwiseOR(key) if bits + len(groups).bit_length() < 63 else F.xxhash64(F.lit(number), key)
        keys.append(tagged.cast("long"))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between distinct fingerprints of fps(fp) that connect all those at most radius bits apart.

    Where enough blocks agree two fingerprints meet in a bucket; within a bucket the distances to the reference
    fingerprints discard pairs, the rest is verified. Only a spanning forest of each bucket is returned, not its pairs.
    Buckets above HOT_BUCKET are dealt out as pairs of pieces to many tasks. Keys get longer with the number of
    fingerprints, so that buckets do not grow with it.
    """
    reference = pivots()
    keyed = bucket_keys(fps, fps.count(), radius)
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_BUCKET)
    hot = stash(hot, "simhash-hot")
    typed = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def emit(pairs: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.sort(pairs.astype(np.uint64).view(np.int64), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((0,), np.int64), np.empty((0,), np.uint64)
        for b in batches:
            key = np.concatenate([kept[0], b.column(0).to_numpy()])
            fp = np.concatenate([kept[1], b.column(1).to_numpy().view(np.uint64)])
            cut = np.searchsorted(key, key[-1]) if len(key) else 0
            yield emit(small_bucket_links(key[:cut], fp[:cut], reference, radius))
            kept = key[cut:], fp[cut:]
        yield emit(small_bucket_links(*kept, reference, radius))

    n = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cold = keyed.join(hot.select("key"), "key", "left_anti").repartition(int(n), "key").sortWithinPartitions("key")
    out = cold.mapInArrow(run, "u long, v long")

    dealt = (
        keyed.join(hot, "key")
        .withColumn("pieces", F.ceil(F.col("n") * 2 / HOT_BUCKET))
        .withColumn("mine", F.pmod(F.xxhash64("fp"), "pieces"))
        .select("key", "fp", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("other"))
        .select("key", "fp", "mine", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))
    )

    def run_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.empty((0,), np.int64)] * 5
        for b in itertools.chain(batches, [None]):
            if b is not None:
                kept = [np.concatenate([k, b.column(i).to_numpy()]) for i, k in enumerate(kept)]
            key, fp, mine, a, c = kept
            if not len(key):
                continue
            change = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            starts = np.flatnonzero(np.r_[True, change])
            last = len(key) if b is None else starts[-1]
            for s, e in zip(starts, np.r_[starts[1:], len(key)], strict=True):
                if e <= last:
                    yield emit(bucket_links(fp[s:e].view(np.uint64), reference, radius, mine[s:e] if a[s] != c[s] else None))
            kept = [k[last:] for k in kept]

    if hot.limit(1).count():
        out = out.unionByName(dealt.repartition(int(n), "key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run_hot, "u long, v long"))
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs(doc_id, text).

    component_id is the smallest doc_id that links of at most radius differing bits reach. Equal fingerprints are
    handled as one, so copies never meet in pairs. A text without words has fingerprint 0, which links like any other;
    null counts as empty; a null doc_id is larger than any other; rows that repeat an id may carry several texts and
    get a row each; an empty table gives an empty result.
    """
    docs = need(docs, "doc_id", "text")
    marked = stash(with_fingerprints(docs, shingle), "simhash-marks")
    first = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "simhash-first")
    links = stash(fingerprint_links(first.select("fp"), radius), "simhash-links")
    roots = components(links)
    placed = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = placed.join(smallest, "root").select("fp", "copies", "component_id")
    return salted_join(marked, of_fp, ["fp"], ["doc_id"], "copies", marked.count()).select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
