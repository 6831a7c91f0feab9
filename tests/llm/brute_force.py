"""Operators by the plainest way: what they must give on small tables."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from fractions import Fraction

import xxhash

from subjectlens.llm.chat_tree import LEARNT
from subjectlens.llm.decontaminate import WINDOW, windows_of, words_of
from subjectlens.llm.near_copies import DEN, NUM
from subjectlens.llm.near_copies import SHINGLE as COPY_SHINGLE
from subjectlens.llm.simhash import RADIUS, SEED, SHINGLE
from subjectlens.llm.warc import LEAST_BYTES, digest


def simhash_rows(docs: list[tuple[int, str | None]], shingle: int = SHINGLE, radius: int = RADIUS) -> list[tuple]:
    """op9's rows by comparing all pairs: the check for small tables."""
    fps = []
    for _, text in docs:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, SEED) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    label = [i for i, _ in docs]
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(docs)), 2):
            if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return [(docs[i][0], f"{fps[i]:016x}", label[i]) for i in range(len(docs))]


def contamination_rows(docs: list[tuple[object, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract's columns, each document against each window: the check for small tables."""
    out = []
    for i, text in docs:
        words, marked, owners = words_of(text or ""), set(), set()
        for item, it in items:
            for w in windows_of(words_of(it or ""), window):
                for s in range(len(words) - len(w) + 1):
                    if tuple(words[s : s + len(w)]) == w:
                        marked.update(range(s, s + len(w)))
                        owners.add(str(item))
        out.append((i, len(words), len(marked), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(marked)))
    return out


def archive_rows(pages: list[tuple], least_bytes: int = LEAST_BYTES) -> list[tuple]:
    """op4's rows from (page_id, html), computed directly: the check for small tables."""
    first: dict[bytes, int] = {}
    for i, html in pages:
        p = (html or "").encode()
        first[p] = min(i, first.get(p, i))
    out = []
    for i, html in pages:
        p = (html or "").encode()
        revisit = len(p) >= least_bytes and first[p] != i
        out.append((i, len(p), digest(p), "revisit" if revisit else "response", first[p] if revisit else None))
    return out


def conversation_rows(rows: list[tuple]) -> list[tuple]:
    """op8's columns but the last from (conv_id, turn, role, text): the check for small tables."""
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        learnt = "".join(t[3] for t in turns if t[2] == LEARNT)
        out.append((conv, len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()))
    return out


def rows_that_stay(rows: list[tuple]) -> list[tuple]:
    """The rows (doc_id, text, ...) that stay, by comparing all pairs: the check for small tables."""
    words = [(r[1] or "").encode().lower().split() for r in rows]
    sets = [{tuple(w[i : i + COPY_SHINGLE]) for i in range(max(1, len(w) - COPY_SHINGLE + 1))} for w in words]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if label[i] != label[j] and len(sets[i] & sets[j]) * DEN >= NUM * len(sets[i] | sets[j]):
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    groups: dict[int, list[tuple]] = {}
    for x, r in zip(label, rows, strict=True):
        groups.setdefault(x, []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def run_rows(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """op11's rows, each period against each place: the check for small tables."""
    out = []
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if n and h is not None and h % 10 == 0:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [x if i < a else words[a + (i - a) % p] for i, x in enumerate(words)]
        runs: dict[tuple[int, int], int] = {}
        for p in range(1, n // 3 + 1):
            i = 0
            while i < n - p:
                j = i
                while j < n - p and words[j] == words[j + p]:
                    j += 1
                if j > i and j + p - i >= max(24, 3 * p):
                    runs.setdefault((i, j + p), p)
                i = j + 1
        found = sorted((s, e - s, p) for (s, e), p in runs.items())
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + length for s, length, p in found)]
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{p}\n" for s, length, p in sorted(found, key=lambda r: (r[0], r[2]))), " ".join(kept)))
        out.append((doc_id, len(found), *(best and (*best, 1000 * best[1] // best[2]) or (None,) * 4), *digests))
    return out
