"""A corpus pipeline: toxic documents go, near copies go, benchmark passages go, sources are mixed, token files are written.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns the columns of documents, the
last one what is read back from its files. Stages are joined by Parquet files in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subjectlens.llm.decontaminate import decontaminated
from subjectlens.llm.mixing import mixed_documents
from subjectlens.llm.near_copies import one_of_each
from subjectlens.llm.shared import read, stash
from subjectlens.llm.token_files import token_files
from subjectlens.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, ordered=False)  # token files sort by doc_id


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: Trained models, fingerprints and the tokenizer have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Without documents there are no rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
