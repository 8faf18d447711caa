"""The corpus pipeline: five stages over ``documents``, each calling one operator of the llm subpackage.

Each stage reads all that the one before kept.  Stages up to the last return the columns of
``documents``, whatever they are; the last returns the packed pieces.  Rows are judged as rows: doc_ids may be
null or repeat, and other columns may have any name.  Tables without rows give none.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, language_id, near_dups, packing, suffix_dedup
from folioscope.llm._spark import bounded_batches, shared_dir
from folioscope.llm.queries import tokenizer_path

#: The stages learn and search; SQL can't express them.
ORACLE_SQL = None


def stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose Python workers get batches of bounded bytes; it is the caller's session that is set so."""

    @functools.wraps(run)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return run(spark, docs, sf_dir)

    return bounded


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; null texts, and those without a letter, have none."""
    return language_id.accepted(docs, language_id.fit(docs))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Null and empty texts are near to nothing and stay.  Repeated rows, of one doc_id and text, stay or go together; of rows
    with one doc_id and different texts each has its own verdict.
    """
    return near_dups.without_near_duplicates(docs)


@stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte ranges that a document of a smaller doc_id has; cut characters stay whole.

    A document of which nothing but white space is left goes, unless it came so; a null text becomes empty.  A document
    without a doc_id loses nothing.
    """
    out = suffix_dedup.without_repeats(docs, drop_emptied=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item; null and empty texts overlap none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; an empty text is the end id alone."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written as Parquet in the shared folder and read as the next one's input."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
