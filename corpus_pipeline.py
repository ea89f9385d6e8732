"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept, as a stored table, and all but the last return the columns
of ``documents``. Extra columns are carried; the cases of nulls, empty texts, repeated rows and empty tables
are those of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leaksieve.llm import decontaminate, jaccard, langid, lines, modest_batches, packing
from leaksieve.llm.queries import TOKENIZER
from leaksieve.session import materialise

#: rows of a batch of texts: a stage's memory comes on top of what the stages before it left in an executor
BATCH = 250

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language; ``lang`` becomes the predicted one."""
    return langid.keep_known_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are similar to an earlier one, and documents that were nothing else."""
    return lines.drop_repeated_lines(docs, lines.WHOLE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return jaccard.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark out of the texts."""
    return decontaminate.remove_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return packing.pack_documents(docs, TOKENIZER)


def _stage(function: Stage) -> Stage:
    return lambda spark, docs, sf_dir: function(modest_batches(spark, BATCH), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _stage(language_id)),
    ("line_dedup", _stage(line_dedup)),
    ("near_duplicates", _stage(near_duplicates)),
    ("decontamination", _stage(decontamination)),
    ("packing", _stage(packing_stage)),
]

# None of the stages can be said in SQL: tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
