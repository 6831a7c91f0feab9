"""The pipeline's near-duplicate stage: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of the shingles (operator 9, pivot tables included) bring first candidates. At 0.8 two fingerprints of 64
bits differ in about ten, which no table of four bits can find, so a prefix-filtered join of the shingles brings the rest.
Every candidate is verified by its shingles.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subjectlens.llm.shared import by_bytes, stash, text_of
from subjectlens.llm.simhash import fingerprint_links
from subjectlens.operators.graph import components

SEED, SHINGLE = 42, 5
#: Texts are near copies from a Jaccard similarity of NUM / DEN.
NUM, DEN = 4, 5
#: What _common gives: the MOST most common shingles of all texts, of at least LEAST texts each.
LEAST, MOST = 4, 100_000
#: Pieces in which the texts that are compared with one text come to it; bytes of text that are cut into shingles at once.
PIECES, TEXT_BYTES = 64, 4 << 20
#: Shingles that are counted in one task; most bits that they are known by there; bits of a text's parity; texts under a key above which they are dealt out.
SLICE, SLOT_BITS, PARITY, HOT = 4 << 20, 48, 1024, 1024


def shingles(text: str) -> np.ndarray:
    """Sorted distinct XXH64 hashes of all runs of SHINGLE words; of fewer words, one of all; none without words. A-Z count as a-z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts, digest = [0, *ends], xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[min(SHINGLE, len(words)) - 1 :], strict=False)), np.uint64))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def fingerprint(found: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes; 0 without any."""
    if not len(found):
        return 0
    bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(found), bitorder="little").view(np.int64)[0])


def _marked(rows: DataFrame) -> DataFrame:
    """rows(row, doc_id, h, text) with a 128-bit digest of the shingles, their fingerprint and their number in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_bytes(whole, 3, TEXT_BYTES)):
            sets = [shingles(x) for x in b.column(3).to_pylist()]
            digests, fps = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], [fingerprint(x) for x in sets]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(digests, pa.binary()), pa.array(fps, pa.int64()), pa.array(map(len, sets), pa.int64())], names=["row", "doc_id", "h", "digest", "fp", "n"])

    return rows.mapInArrow(run, "row long, doc_id long, h long, digest binary, fp long, n long")


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, with their counts in all texts. The stage itself counts by _repeated, which moves less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_bytes(whole, 0, TEXT_BYTES)):
            keys, n = np.unique(np.concatenate([shingles(x) for x in b.column(0).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    keys = texts.select("text").mapInArrow(run, "key long, n long")
    table = keys.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "key").limit(MOST).toArrow()
    key, n = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def packed(entries: np.ndarray) -> bytes:
    """Sorted entries, slots of SLOT_BITS at most with 16 bits of text number behind, as differences of slots and text numbers."""
    apart = np.diff(entries >> np.uint64(16), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, : SLOT_BITS // 8]
    return pa.compress(apart.T.tobytes() + entries.view(np.uint8).reshape(-1, 8)[:, :2].T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    wide = SLOT_BITS // 8
    planes = np.frombuffer(pa.decompress(data, (wide + 2) * n, codec="zstd", asbytes=True), np.uint8).reshape(wide + 2, n)
    apart, who = np.zeros((n, 8), np.uint8), np.zeros((n, 8), np.uint8)
    apart[:, :wide], who[:, :2] = planes[:wide].T, planes[wide:].T
    return np.cumsum(apart.view(np.uint64).ravel(), dtype=np.uint64) << np.uint64(16) | who.view(np.uint64).ravel()


def parity(found: np.ndarray) -> bytes:
    """PARITY bits, each of them the parity of the number of shingles that fall on it."""
    return np.packbits(np.bincount((found % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) % 2 == 1).tobytes()


def _cut(texts: DataFrame, slices: int, bits: int) -> DataFrame:
    """(slice, block, n, entries, sids, sizes, parities): the shingles of blocks of texts by range of their first bits.

    A block is named by its first text; its slice 0 holds the texts' ids, numbers of shingles and parities as well.
    """
    typed = pa.schema([("slice", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("entries", pa.binary()), ("sids", pa.binary()), ("sizes", pa.binary()), ("parities", pa.binary())])
    edges = np.arange(1, slices, dtype=np.uint64) << np.uint64(bits + 16 - (slices.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for k in range(0, whole.num_rows, 1 << 16) for part in by_bytes(whole.slice(k, 1 << 16), 1, TEXT_BYTES)):
            sets = [shingles(x) for x in b.column(1).to_pylist()]
            sizes, sids = np.array([len(s) for s in sets], np.int64), b.column(0).to_numpy()
            entries = np.sort(np.concatenate(sets) >> np.uint64(64 - bits) << np.uint64(16) | np.repeat(np.arange(len(sets), dtype=np.uint64), sizes))
            cuts = [0, *np.searchsorted(entries, edges).tolist(), len(entries)]
            used = [k for k in range(slices) if not k or cuts[k] < cuts[k + 1]]
            head = lambda x: [x, *[None] * (len(used) - 1)]
            columns = [used, [int(sids[0])] * len(used), [cuts[k + 1] - cuts[k] for k in used], [packed(entries[cuts[k] : cuts[k + 1]]) for k in used], head(sids.tobytes()), head(sizes.tobytes()), head(b"".join(map(parity, sets)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, typed, strict=True)], schema=typed)

    return texts.select("sid", "text").mapInArrow(run, "slice int, block long, n long, entries binary, sids binary, sizes binary, parities binary")


def _repeated(cut: DataFrame) -> DataFrame:
    """The rows of cut with those entries only whose slots hold two or more in all blocks, and how many (seen)."""
    typed = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("entries", pa.binary()), ("seen", pa.binary()), ("sids", pa.binary()), ("sizes", pa.binary()), ("parities", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        parts = [unpacked(r["entries"], r["n"]) for r in rows]
        slot = np.concatenate(parts) >> np.uint64(16)
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        starts = np.flatnonzero(np.r_[len(slot) > 0, slot[1:] != slot[:-1]])
        n = np.diff(np.r_[starts, len(slot)])
        seen, at, out = np.empty(len(slot), np.uint32), 0, []
        seen[order] = np.repeat(n, n)
        for r, part in zip(rows, parts, strict=True):
            mine = seen[at : at + len(part)]
            kept, at = mine > 1, at + len(part)
            if r["sids"] is not None or kept.any():
                out.append({**r, "n": int(kept.sum()), "entries": packed(part[kept]), "seen": pa.compress(mine[kept].tobytes(), codec="zstd", asbytes=True)})
        yield pa.RecordBatch.from_pylist([{k: r[k] for k in typed.names} for r in out], schema=typed)

    return cut.groupBy("slice").applyInArrow(run, "block long, n long, entries binary, seen binary, sids binary, sizes binary, parities binary")


def _keys(texts: DataFrame, total: int) -> DataFrame:
    """(key, sid, place, parity): each text under those shingles of its prefix that are not its own alone; total: all shingles.

    Shingles are known by their first bits, enough for about one in 2000 to share them with another by chance; that adds
    keys and hides none. The order of keys is by how many shingles of all texts have these bits, rare ones first. So those
    that occur once come first and need no row. place holds a text's number of shingles (high) and where this one stands (low).
    """
    slices = 1 << max(0, -(-total // SLICE) - 1).bit_length()
    bits = min(SLOT_BITS, max(20, total.bit_length() + 11))
    typed = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("place", pa.int64()), ("parity", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        entries = np.concatenate([unpacked(r["entries"], r["n"]) for r in rows])
        seen = np.concatenate([np.frombuffer(pa.decompress(r["seen"], 4 * r["n"], codec="zstd", asbytes=True), np.uint32) for r in rows])
        sids, sizes, parities = next((np.frombuffer(r["sids"], np.int64), np.frombuffer(r["sizes"], np.int64), r["parities"]) for r in rows if r["sids"] is not None)
        slot, who = entries >> np.uint64(16), (entries & np.uint64(0xFFFF)).astype(np.int64)
        order = np.lexsort((slot, seen, who))
        slot, who = slot[order], who[order]
        n = np.bincount(who, minlength=len(sids))
        at = np.arange(len(who)) + (sizes - np.cumsum(n))[who]
        kept = at < (sizes + (sizes > 0) + (-NUM * sizes) // DEN)[who]
        slot, who, at = slot[kept], who[kept], at[kept]
        wide = PARITY // 8
        mine = pa.array([parities[k * wide : (k + 1) * wide] for k in who.tolist()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), pa.array(sids[who]), pa.array(sizes[who] << 32 | at), mine], schema=typed)

    return _repeated(_cut(texts, slices, bits)).groupBy("block").applyInArrow(run, "key long, sid long, place long, parity binary")


def _met(rows: DataFrame) -> DataFrame:
    """(x, y, shared, n, m): texts of rows(key, sid, place, parity, root) of different roots that share so many keys and may be near copies.

    Sets of n and m shingles whose parities differ in d bits differ in d shingles or more, so most pairs of half-alike
    texts fall away inside a task. A key with more than HOT texts is dealt out as pairs of pieces.
    """
    typed = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("shared", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])
    many = F.ceil(F.col("count") * 2 / HOT)
    dealt = rows.join(rows.groupBy("key").count(), "key").withColumn("pieces", F.when(F.col("count") > HOT, many).otherwise(1)).withColumn("mine", F.pmod(F.xxhash64("sid"), "pieces"))
    dealt = dealt.select("key", "sid", "place", "root", "parity", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("other"))
    dealt = dealt.withColumn("a", F.least("mine", "other")).withColumn("b", F.greatest("mine", "other")).select("key", "a", "b", "mine", "sid", "place", "root", "parity")

    def pairs(key, a, b, mine, sid, place, root, bits) -> Iterator[pa.RecordBatch]:
        size, at, i, found, room = place >> 32, place & 0xFFFFFFFF, np.arange(len(key)), [], 1 << 18
        for step in range(1, len(key)):
            i = i[i + step < len(key)]
            i = i[(key[i] == key[i + step]) & (a[i] == a[i + step]) & (b[i] == b[i + step])]
            if not len(i):
                break
            j = i + step
            n, m = size[i], size[j]
            ok = (root[i] != root[j]) & ((a[i] == b[i]) | (mine[i] != mine[j])) & (np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM)
            ok &= (np.minimum(n - at[i], m - at[j]) + np.minimum(at[i], at[j])) * (NUM + DEN) >= (n + m) * NUM
            u, v = i[ok], j[ok]
            for k in range(0, len(u), 1 << 16):
                p, q = u[k : k + (1 << 16)], v[k : k + (1 << 16)]
                near_enough = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64) * (DEN + NUM) <= (size[p] + size[q]) * (DEN - NUM)
                p, q = p[near_enough], q[near_enough]
                turned = sid[p] > sid[q]
                found.append(np.stack([np.where(turned, q, p), np.where(turned, p, q)]))
                room -= len(p)
            if room < 0:
                yield added(found, sid, size)
                found, room = [], 1 << 18
        if found:
            yield added(found, sid, size)

    def added(found, sid, size) -> pa.RecordBatch:
        p, q = np.concatenate(found, 1)
        x, y, n, m = sid[p], sid[q], size[p], size[q]
        order = np.lexsort((y, x))
        x, y, n, m = x[order], y[order], n[order], m[order]
        heads = np.flatnonzero(np.r_[len(x) > 0, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (x[heads], y[heads], np.diff(np.r_[heads, len(x)]), n[heads], m[heads])], schema=typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 7 + [np.empty((0, PARITY // 64), np.uint64)]
        for b in itertools.chain(batches, [None]):
            if b is not None:
                bits = np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint64).reshape(-1, PARITY // 64)
                kept = [np.concatenate([k, x]) for k, x in zip(kept, [*(b.column(c).to_numpy() for c in range(7)), bits], strict=True)]
            key, a, c = kept[:3]
            change = np.flatnonzero(np.r_[len(key) > 0, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
            last = len(key) if b is None else change[-1] if len(change) else 0
            if last:
                yield from pairs(*(k[:last] for k in kept))
            kept = [k[last:] for k in kept]

    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "x long, y long, shared long, n long, m long")


def _size(place: str) -> Column:
    return F.shiftright(place, 32)


def _may_link(a: str, b: str) -> Column:
    """Whether two sets that share the shingles at places a and b can be similar enough, by their sizes and these places."""
    n, m = _size(a), _size(b)
    at = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    rest = F.least(n - at(a), m - at(b)) + F.least(at(a), at(b))
    return (rest * (NUM + DEN) >= (n + m) * NUM) & (F.least(n, m) * DEN >= F.greatest(n, m) * NUM)


def _enough(shared: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m shingles can be similar enough if they share so many of their keys.

    What they share beyond that comes after the prefix that ends first, where ceil(0.8 n) - 1 shingles are left.
    """
    left = F.greatest(F.ceil(n * NUM / DEN), F.ceil(m * NUM / DEN)) - 1
    return (shared + left) * (NUM + DEN) >= (n + m) * NUM


def _counted(met: DataFrame) -> DataFrame:
    """(x, y, shared) of met(x, y, p, q), texts x and y that share a shingle at places p and q, which share enough shingles."""
    by = met.groupBy("x", "y").agg(F.count("*").alias("shared"), F.first(_size("p")).alias("n"), F.first(_size("q")).alias("m"))
    return by.filter(_enough(F.col("shared"), F.col("n"), F.col("m"))).select("x", "y", "shared")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(u, v) whose texts are near copies.

    The texts that are compared with one text come to it in up to PIECES pieces, each sorted behind that text, and are
    compared as they pass; so a text moves once for each of its pairs, and a text with very many pairs is in many tasks.
    """
    dealt = pairs.select("u", F.pmod(F.xxhash64("v"), F.lit(PIECES)).alias("piece"), "v")
    wanted = dealt.select("u", "piece", F.col("v").alias("sid"), F.lit(True).alias("other")).unionByName(dealt.select("u", "piece", F.col("u").alias("sid"), F.lit(False).alias("other")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: np.ndarray | None = None
        for b in batches:
            u, v = [], []
            for lead, sid, other, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                found = shingles(text)
                if not other:
                    mine = found
                elif near(mine, found):
                    u.append(lead)
                    v.append(sid)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    placed = wanted.join(texts.select("sid", "text"), "sid").repartition("u", "piece").sortWithinPartitions("u", "piece", "other")
    return placed.select("u", "sid", "other", "text").mapInArrow(run, "u long, v long")


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """(u, v): each of sets(sid, fp) with the first of its fingerprint, and the firsts of fingerprints that operator 9 links."""
    first = stash(sets.groupBy("fp").agg(F.min("sid").alias("lead")), "copies-first")
    same = sets.join(first, "fp").filter("sid <> lead").select(F.col("lead").alias("u"), F.col("sid").alias("v"))
    links = fingerprint_links(first.select("fp")).select(F.col("u").alias("a"), F.col("v").alias("b"))
    ends = lambda name, fp: first.select(F.col("fp").alias(fp), F.col("lead").alias(name))
    linked = links.join(ends("x", "a"), "a").join(ends("y", "b"), "b").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    return same.unionByName(linked)


def similar(keys: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of the texts(sid, text) named in sets(sid, fp), no two of them with equal shingles, that links of near copies connect with others.

    First each text is compared with those that fingerprints link it to, and with the one it shares most keys with of
    those that are first under its keys. Then texts that are still unconnected are compared with others under the same
    keys, if parities and numbers of keys leave room for a link. Pairs of half-alike texts under a key are looked at
    within tasks, so that work grows with the square of such groups; leaving pairs out would lose links.
    """
    place = F.row_number().over(W.partitionBy("key").orderBy("sid", "place"))
    first = F.first(F.struct("sid", "place")).over(W.partitionBy("key").orderBy("sid", "place").rowsBetween(W.unboundedPreceding, 0))
    led = keys.select("key", "sid", "place").repartition("key").withColumn("r", place).withColumn("lead", first).filter("r > 1 and sid <> lead.sid")
    shared = led.select(F.col("sid").alias("y"), F.col("place").alias("q"), F.col("lead.sid").alias("x"), F.col("lead.place").alias("p"))
    best = _counted(shared.filter(_may_link("p", "q"))).groupBy("y").agg(F.max_by("x", F.struct("shared", -F.col("x"))).alias("x"))
    tried = stash(best.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(_by_fingerprint(sets)).distinct(), "copies-pairs")
    ends = [tried.select(F.col(c).alias("sid")) for c in ("u", "v")]
    named = stash(keys.select("sid").unionByName(ends[0]).unionByName(ends[1]).distinct(), "copies-named")
    texts = stash(texts.join(named, "sid", "left_semi"), "copies-texts", "zstd")  # all that are ever compared
    links = stash(_verified(tried, texts), "copies-links")
    roots = stash(components(links), "copies-roots")

    placed = keys.join(roots, F.col("sid") == F.col("node"), "left").select("key", "sid", "place", "parity", F.coalesce("root", "sid").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key")
    open_ = stash(placed.join(mixed, "key", "left_semi"), "copies-open")
    by = _met(open_).groupBy("x", "y").agg(F.sum("shared").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    rest = by.filter(_enough(F.col("shared"), F.col("n"), F.col("m"))).select(F.col("x").alias("u"), F.col("y").alias("v")).join(tried, ["u", "v"], "left_anti")
    more = stash(_verified(stash(rest, "copies-pairs"), texts), "copies-links")
    return components(links.unionByName(more)) if more.limit(1).count() else roots


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one stays for each group that links of near copies connect.

    It is the row with the smallest doc_id, a null one being the largest. Rows are told apart by a number written once,
    so ids may be null or repeat. Null counts as empty; texts without words are copies of each other.
    """
    columns = docs.columns
    rows = stash(docs.withColumn("__row", F.monotonically_increasing_id()), "copies-rows", "zstd")
    marked = _marked(rows.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("h"), text_of().alias("text")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "row")).alias("best")
    sets = marked.groupBy("digest").agg(best, F.first("fp").alias("fp"), F.first("n").alias("n")).select(F.col("best.row").alias("sid"), "fp", "n", "best")
    sets = stash(sets, "copies-sets")
    texts = rows.select(F.col("__row").alias("sid"), text_of().alias("text"))
    keys = stash(_keys(texts.join(sets.select("sid"), "sid"), sets.agg(F.sum("n")).first()[0] or 0), "copies-keys", "zstd")
    roots = similar(keys, sets.select("sid", "fp"), texts)
    stays = sets.join(roots, F.col("sid") == F.col("node"), "left").groupBy(F.coalesce("root", "sid")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("__row"))
    return rows.join(stays, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in columns])
