"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixing, token files.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept. All but the last return the
columns of ``documents``; the last returns one row per document written to the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linewatch.llm import decontaminate, mixing, quality, simhash, token_files
from linewatch.llm.common import bound_batches, bound_reads, table
from linewatch.session import working_path

#: Every worker and reader of an executor outlives its stage, so what each holds at once is kept smaller than in a single operator.
BATCH_BYTES = 2 << 20
READ_ROWS = 1024


def lean(spark: SparkSession) -> None:
    """Small batches in this session, in Arrow and from Parquet."""
    bound_batches(spark, BATCH_BYTES)
    bound_reads(spark, READ_ROWS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    lean(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    lean(spark)
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents holding a window of a benchmark item go."""
    lean(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: what each pass over the sources takes of a document is a row with its id."""
    lean(spark)
    return mixing.mixed_documents(docs, length_col="n_chars")


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    lean(spark)
    return token_files.encode_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            path = working_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
