"""Runs of words that repeat with a period: harmonic grid probing, then chunked comparison of arrays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjectlens.llm.shared import by_bytes, need, read, text_of

#: A run has so many words, and so many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words compared at first when a survivor is extended; each further chunk is twice as long.
CHUNK = 32
#: Text that is split into words at once.
TEXT_BYTES = 8 << 20
COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _agreeing(w: np.ndarray, a: int, p: int) -> tuple[int, int]:
    """The longest stretch [lo, hi) around a where word i equals word i + p, compared chunk by chunk in both directions."""
    hi, size, end = a + 1, CHUNK, len(w) - p
    while hi < end:
        stop = min(end, hi + size)
        other = w[hi:stop] != w[hi + p : stop + p]
        k = int(other.argmax())
        if other[k]:
            hi += k
            break
        hi, size = stop, 2 * size
    lo, size = a, CHUNK
    while lo:
        stop = max(0, lo - size)
        other = w[stop:lo][::-1] != w[stop + p : lo + p][::-1]
        k = int(other.argmax())
        if other[k]:
            lo -= k
            break
        lo, size = stop, 2 * size
    return lo, hi


class _Found:
    """The runs found so far in one text."""

    def __init__(self, w: np.ndarray):
        self.w = w
        self.runs: dict[tuple[int, int], int] = {}  # (start, end) to period
        self.end = self.period = np.empty(0, np.int64)  # by word, of the run found last that holds it

    def add(self, s: int, e: int, p: int) -> None:
        if (s, e) in self.runs:
            return
        if not self.runs:
            self.end, self.period = np.zeros(len(self.w), np.int64), np.ones(len(self.w), np.int64)
        self.runs[s, e] = p
        self.end[s:e], self.period[s:e] = e, p

    def outside(self, p: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Which grid points a of periods p are not inside a found run that has period p already: there the stretch would be that run's again."""
        return (a + p >= self.end[a]) | (p % self.period[a] != 0)

    def take(self, p: np.ndarray, a: np.ndarray) -> None:
        """Extends the survivors, smallest period first."""
        w, n = self.w, len(self.w)
        # a run holds all words between two neighbouring grid points, so words between them agree as well
        for part in (1, 2, 3, 5, 7):
            at = a + np.maximum(p * part // 8, np.minimum(part, p))
            ok = at + p < n
            ok[ok] = w[at[ok]] == w[(at + p)[ok]]
            p, a = p[ok], a[ok]
            if not len(p):
                return
        if self.runs:
            ok = self.outside(p, a)
            p, a = p[ok], a[ok]
        done_p, done_to = 0, -1
        for p_, a_ in zip(p.tolist(), a.tolist(), strict=True):
            if p_ == done_p and a_ < done_to:  # the same stretch as from the grid point before
                continue
            lo, hi = _agreeing(w, a_, p_)
            done_p, done_to = p_, hi
            if hi - lo + p_ >= max(LEAST_WORDS, LEAST_PERIODS * p_):
                self.add(lo, hi + p_, p_)


def periodic_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of each maximal run of the word codes w, by start, then period.

    A run of period p has at least 3 p words, so words p apart agree along 2 p words or more, which hold two neighbouring
    points jp and (j + 1)p of the grid of step p. Testing w[jp] against w[(j + 1)p] for all p and j takes n ln n tests,
    made by slices: small periods one by one, all points of their grid at once; larger ones in blocks [P, 2P), one j at
    once for all periods of the block. Periods come in ascending order, so a stretch is met first with its smallest, and
    grid points within it are skipped for multiples of that period (no two periods of a block divide each other).
    """
    n, found = len(w), _Found(w)
    last = n // LEAST_PERIODS
    if n < LEAST_WORDS or not last:
        return []
    single = min(last, math.isqrt(n))
    for p in range(1, single + 1):
        grid = w[::p]
        if len(j := np.flatnonzero(grid[:-1] == grid[1:])):
            found.take(np.full(len(j), p), j * p)
    low = single + 1
    while low <= last:
        high = min(last + 1, 2 * low)
        ps, aa = [], []
        for j in range((n - 1) // low):
            top = min(high, (n - 1) // (j + 1) + 1)
            if top <= low:
                break
            first = w[low * j : (top - 1) * j + 1 : j] if j else np.full(top - low, w[0])
            k = np.flatnonzero(first == w[low * (j + 1) : (top - 1) * (j + 1) + 1 : j + 1])
            if len(k):
                ps.append(k + low)
                aa.append((k + low) * j)
        if ps:
            p, a = np.concatenate(ps), np.concatenate(aa)
            order = np.lexsort((a, p))
            found.take(p[order], a[order])
        low = high
    return sorted(((s, e - s, q) for (s, e), q in found.runs.items()), key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:n]) == 0


def with_repeat(w: np.ndarray, h: int) -> np.ndarray:
    """The words as the contract of op11 has them: one in ten texts, by its hash h, ends in a repeated passage."""
    n = len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    w = w.copy()
    w[a:] = w[a + np.arange(n - a) % p]
    return w


def words_by_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, words): text i has the words words[codes[offsets[i] : offsets[i + 1]]]. White space is ASCII's."""
    pieces = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = pieces.flatten()
    coded = flat.dictionary_encode()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy()[real]
    return codes, np.r_[0, np.cumsum(real)][pieces.offsets.to_numpy() - pieces.offsets[0].as_py()], coded.dictionary


def collapse_runs(docs: DataFrame, edit=None) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_runs, the strongest run (start, length, period, exponent_milli), digests of all runs and of the text without repeats.

    A run is a maximal stretch of words with smallest period q that holds at least 24 words and 3 periods; texts are read
    whole, in tasks without a shuffle, in slices of about 8 MB (a longer text is a slice of its own). edit: takes (word
    codes, unsigned crc32 of the decimal doc_id) and returns the codes to look at.

    Null or empty text has no words: no runs, nulls for the run, digests of nothing. A null doc_id is never edited. Rows
    that repeat an id or a text are each judged alone; an empty table gives an empty result; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, 2, TEXT_BYTES):
                codes, offsets, words = words_by_text(part.column(2))
                rows, masks = [], []
                for i, h in enumerate(part.column(1).to_pylist()):
                    w = codes[offsets[i] : offsets[i + 1]]
                    if edit is not None and h is not None:
                        codes[offsets[i] : offsets[i + 1]] = w = edit(w, h)
                    runs = periodic_runs(w)
                    best = strongest(runs)
                    masks.append(kept_words(len(w), runs) if runs else np.ones(len(w), bool))
                    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
                    rows.append((len(runs), *(best and (*best, 1000 * best[1] // best[2]) or (None,) * 4), hashlib.sha256(listed.encode()).hexdigest()))
                kept = np.concatenate(masks)
                left = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)][offsets]), words.take(pa.array(codes[kept])))
                collapsed = [hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(left, pa.scalar(" ", words.type))]
                n_runs, start, length, period, milli, digest = zip(*rows, strict=True)
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in (n_runs, start, length, period, milli)), pa.array(digest), pa.array(collapsed)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in COLUMNS.split(", ")])

    rows = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"), text_of().alias("text"))
    return rows.mapInArrow(run, COLUMNS)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(read(spark, sf_dir, "documents"), with_repeat)
