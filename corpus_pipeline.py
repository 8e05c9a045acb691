"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.llm.line_quality import keep_good
from cuelight.llm.line_windows import with_lines_removed
from cuelight.llm.mixing import mixed
from cuelight.llm.ngram_join import without_near_copies
from cuelight.llm.pieces import digests, public_model
from cuelight.llm.tables import table
from cuelight.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go from the texts, and texts of which nothing is left."""
    return with_lines_removed(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id: five-word shingles, similarity of 0.8 or more."""
    return without_near_copies(docs, n=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated towards equal weights, at most one and a half times in the mean; no document goes."""
    return mixed(docs, repeats=1.5)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row of the mixture."""
    return digests(docs, public_model()).select("_doc.doc_id", F.col("_doc.source").alias("source"), "_digest.*")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("encoding", encoding)]
#: the field and the encoder are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
