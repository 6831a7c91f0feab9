"""Many substrings in many texts: Aho-Corasick automata over blocks of patterns, blocks met by slices of texts."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of patterns in an automaton, and of texts that meet it in a task, about.
PATTERN_CHARS, TEXT_CHARS = 2_000_000, 16_000_000


def _meet(texts: DataFrame, patterns: DataFrame, run, schema: str) -> DataFrame:
    """run(slice of texts, block of patterns) for every slice and block; texts(text, ...) and patterns(pattern, ...) are distinct.

    A text is copied once for each block of patterns, a pattern once for each slice of texts; blocks and slices are dealt
    by hash and their number follows the sizes, so neither side is gathered whole.
    """
    chars = lambda df, c: df.agg(F.sum(F.length(c) + 1)).first()[0] or 0
    slices, blocks = max(1, math.ceil(chars(texts, "text") / TEXT_CHARS)), max(1, math.ceil(chars(patterns, "pattern") / PATTERN_CHARS))
    slices = max(slices, -(-int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))
    dealt = lambda df, c, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(c), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left = dealt(texts, "text", "slice", slices, "block", blocks).groupBy("slice", "block")
    right = dealt(patterns, "pattern", "block", blocks, "slice", slices).groupBy("slice", "block")
    return left.cogroup(right).applyInPandas(run, schema)


def automaton(patterns: Iterable[str]):
    """Finds all patterns in one pass over a text: iter() gives (end, number of the pattern)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for k, p in enumerate(patterns):
        machine.add_word(p, k)
    machine.make_automaton()
    return machine


def _hits(texts: pd.DataFrame, patterns: pd.DataFrame):
    """(place of a text, places of the patterns that it holds)."""
    if len(texts) and len(patterns):
        machine = automaton(patterns["pattern"])
        for i, text in enumerate(texts["text"]):
            if found := {k for _, k in machine.iter(text)}:
                yield i, found


def _filled(df: DataFrame, column: str, *more: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.col(column) != "")).select(column, *more)


def held_pairs(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern): each distinct text of texts(text) with each distinct pattern of patterns(pattern) that it holds.

    Every text is read once for each block of patterns, whatever its length, so work follows the lengths and the matches.
    Null and empty texts and patterns are left out.
    """

    def run(texts: pd.DataFrame, patterns: pd.DataFrame) -> pd.DataFrame:
        rows = [(texts["text"].iat[i], patterns["pattern"].iat[k]) for i, found in _hits(texts, patterns) for k in found]
        return pd.DataFrame(rows, columns=["text", "pattern"], dtype=object)

    return _meet(_filled(texts, "text").distinct(), _filled(patterns, "pattern").distinct(), run, "text string, pattern string")


def best_in_texts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, a, b): for each text of texts(text) the greatest (a, b), two longs, of patterns(pattern, a, b) that it holds.

    A task gives one row for each text at most, however many patterns the text holds. Patterns must be distinct.
    """

    def run(texts: pd.DataFrame, patterns: pd.DataFrame) -> pd.DataFrame:
        rank = list(zip(patterns["a"], patterns["b"], strict=True))
        rows = [(texts["text"].iat[i], *max(rank[k] for k in found)) for i, found in _hits(texts, patterns)]
        return pd.DataFrame(rows, columns=["text", "a", "b"])

    found = _meet(_filled(texts, "text").distinct(), _filled(patterns, "pattern", "a", "b"), run, "text string, a long, b long")
    return found.groupBy("text").agg(F.max(F.struct("a", "b")).alias("x")).select("text", "x.a", "x.b")


def best_of_patterns(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, a, b): for each pattern of patterns(pattern) the greatest (a, b) of the texts(text, a, b) that hold it.

    A task gives one row for each pattern at most, so a pattern of one letter costs no more rows than any other. Texts must be distinct.
    """

    def run(texts: pd.DataFrame, patterns: pd.DataFrame) -> pd.DataFrame:
        rank, best = list(zip(texts["a"], texts["b"], strict=True)), {}
        for i, found in _hits(texts, patterns):
            for k in found:
                if k not in best or best[k] < rank[i]:
                    best[k] = rank[i]
        return pd.DataFrame([(patterns["pattern"].iat[k], *x) for k, x in best.items()], columns=["pattern", "a", "b"])

    found = _meet(_filled(texts, "text", "a", "b"), _filled(patterns, "pattern").distinct(), run, "pattern string, a long, b long")
    return found.groupBy("pattern").agg(F.max(F.struct("a", "b")).alias("x")).select("pattern", "x.a", "x.b")
