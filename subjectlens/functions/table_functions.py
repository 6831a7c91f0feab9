"""Functions of a text that give rows, for SQL: SELECT d.id, c.* FROM docs d, LATERAL line_chunks(d.text, 3000) c."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DataType, IntegerType, IntegralType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from subjectlens.functions.content import rows_of_json
from subjectlens.operators import chunking

CHUNK = StructType().add("chunk_index", IntegerType()).add("start_offset", IntegerType()).add("end_offset", IntegerType()).add("text", StringType()).add("word_count", IntegerType())


def _is(name: str, given: AnalyzeArgument, kind: type[DataType], word: str) -> None:
    if not isinstance(given.dataType, kind):
        raise ValueError(f"{name} must be {word}, not {given.dataType.simpleString()}")


def _number(name: str, given: AnalyzeArgument) -> int | None:
    """A whole number, known if it is a constant."""
    _is(name, given, IntegralType, "a whole number")
    if given.isConstantExpression and given.value is None:
        raise ValueError(f"{name} must not be null")
    return given.value if given.isConstantExpression else None


def _text(given: AnalyzeArgument) -> None:
    _is("text", given, StringType, "a string")


def _chunk_rows(text: str | None, cut: Callable[[str], list[tuple[int, int]]]) -> Iterator[tuple]:
    for k, (a, e) in enumerate(cut(text) if text else []):
        yield k, a, e, text[a:e], len(text[a:e].split())


class WordChunks:
    """Chunks of `size` words, `overlap` words in common, with offsets."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _text(text)
        n, m = _number("size", size), _number("overlap", overlap)
        if n is not None and m is not None:
            chunking.check_sizes(n, m)
        return AnalyzeResult(CHUNK)

    def eval(self, text: str, size: int, overlap: int):
        chunking.check_sizes(size, overlap)
        yield from _chunk_rows(text, lambda x: chunking.word_spans(x, size, overlap))


class SentenceChunks:
    """Sentences packed into chunks."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        _text(text)
        given = [_number(name, x) for name, x in (("size", size), ("overlap", overlap), ("most", most))]
        if None not in given:
            chunking.check_bounds(*given)
        return AnalyzeResult(CHUNK)

    def eval(self, text: str, size: int, overlap: int, most: int):
        chunking.check_bounds(size, overlap, most)
        yield from _chunk_rows(text, lambda x: chunking.sentence_spans(x, size, overlap, most))


class LineChunks:
    """Lines packed into chunks of at most `most` characters."""

    @staticmethod
    def analyze(text: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        _text(text)
        if (n := _number("most", most)) is not None and n < 1:
            raise ValueError("most must be at least 1")
        return AnalyzeResult(CHUNK)

    def eval(self, text: str, most: int):
        yield from _chunk_rows(text, lambda x: chunking.line_spans(x, most))


class Excerpts:
    """each place of a term, whatever its case, with the characters around it."""

    @staticmethod
    def analyze(text: AnalyzeArgument, term: AnalyzeArgument, around: AnalyzeArgument) -> AnalyzeResult:
        _text(text)
        _is("term", term, StringType, "a string")
        if (n := _number("around", around)) is not None and n < 0:
            raise ValueError("around must be at least 0")
        return AnalyzeResult(StructType().add("place", IntegerType()).add("start_offset", IntegerType()).add("excerpt", StringType()))

    def eval(self, text: str, term: str, around: int):
        low, find, at, k = (text or "").lower(), (term or "").lower(), 0, 0
        while find and (at := low.find(find, at)) >= 0:
            yield k, at, text[max(0, at - around) : at + len(find) + around]
            at, k = at + len(find), k + 1


class JsonRows:
    """The rows of a JSON text of any shape, a row for each of their fields."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _text(text)
        return AnalyzeResult(StructType().add("row", IntegerType()).add("place", IntegerType()).add("name", StringType()).add("value", StringType()))

    def eval(self, text: str):
        for i, row in enumerate(rows_of_json(text) or []):
            for k, (name, value) in enumerate(row):
                yield i, k, name, value


FUNCTIONS = {"word_chunks": WordChunks, "sentence_chunks": SentenceChunks, "line_chunks": LineChunks, "text_excerpts": Excerpts, "json_rows": JsonRows}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL by their names. Null texts have no rows."""
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, udtf(f, useArrow=False))  # rows pass one by one: with Arrow a batch of texts and all their rows are held, a frame for each text
