"""The corpus pipeline: documents in, packed training sequences out.

Stages run in order over all that the one before kept: the quality classifier drops documents that it
rejects, line dedup takes each site's boilerplate lines out, of each group of near duplicates one document
stays, documents that hold a benchmark item go, and what is left is packed into sequences.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra
columns of any name, and does with them what its operator's docstring says: documents without words are rejected by the
classifier, null ids are kept, and rows that repeat an id with one text leave one row in the third stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from eventide.llm.common import shared_dir, table
from eventide.llm.decontaminate import decontaminate
from eventide.llm.line_dedup import line_dedup
from eventide.llm.ngram_join import keep_one
from eventide.llm.packing import best_fit_pack
from eventide.llm.quality import keep_wanted


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the co-trained classifier wants."""
    return keep_wanted(docs, table(spark, sf_dir, "labels"))


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that too many pages of their site have."""
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each connected group of the n-gram Jaccard join."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark item is found."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack documents into sequences; one row per part."""
    return best_fit_pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", boilerplate_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", packing),
]

#: Models and iteration are beyond SQL; the tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; each result is written to the shared folder and read again.

    A stage's folder goes when the next one's is written, so that the packed rows alone stay.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
