"""Writers: transcripts as text, submissions, index tables, reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.functions.text import strip
from cuelight.operators.blockmax import BlockIndex
from cuelight.operators.lexical import Index, document_frequencies


def transcript_lines(segments: DataFrame, fps: float = 25.0) -> DataFrame:
    """video_id, start_sec, line: 'start | end | first frame | last frame | text'."""
    first = F.coalesce("start_frame", T.frame_of("start_sec", fps))
    last = F.coalesce("end_frame", T.frame_of("end_sec", fps))
    text = strip(F.coalesce("text", F.lit("")))
    return segments.select(
        "video_id", "start_sec", F.concat_ws(" | ", F.col("start_sec"), F.col("end_sec"), first, last, text).alias("line"))


def write_transcript_text(segments: DataFrame, path: str, fps: float = 25.0) -> None:
    """Text files in a folder per video, in time order inside a file.

    Rows are ranged by (video, time): a long video is cut into several files
    instead of going through one task.
    """
    lines = transcript_lines(segments, fps)
    (
        lines.repartitionByRange("video_id", "start_sec").sortWithinPartitions("video_id", "start_sec")
        .select("video_id", "line").write.mode("overwrite").partitionBy("video_id").text(path)
    )


def write_submission(lines: DataFrame, path: str) -> None:
    """One folder per query id with its at most 100 lines in order."""
    (
        lines.repartition("query_id").sortWithinPartitions("query_id", "row_no")
        .select("query_id", "line").write.mode("overwrite").partitionBy("query_id").text(path)
    )


def write_index(index: Index, path: str, buckets: int = 64) -> None:
    """Postings clustered by term, so a query reads the row groups of its terms only.

    A frequent term is split over files. The statistics are counted from the written postings, so the documents are read once for both.
    """
    postings = index.postings.hint("rebalance", buckets, "term").sortWithinPartitions("term")
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    written = index.postings.sparkSession.read.parquet(f"{path}/postings")
    document_frequencies(written).write.mode("overwrite").parquet(f"{path}/term_stats")
    index.corpus.write.mode("overwrite").parquet(f"{path}/corpus")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "term_stats", "corpus")])


def write_block_index(index: BlockIndex, path: str, buckets: int = 64) -> None:
    """Blocks clustered by term, a frequent term split over files; the bounds are columns of their own, so a search reads postings of opened blocks only."""
    blocks = index.blocks.hint("rebalance", buckets, "term").sortWithinPartitions("term", "block")
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    index.term_stats.write.mode("overwrite").parquet(f"{path}/term_stats")
    index.corpus.write.mode("overwrite").parquet(f"{path}/corpus")


def read_block_index(spark: SparkSession, path: str) -> BlockIndex:
    return BlockIndex(*[spark.read.parquet(f"{path}/{t}") for t in ("blocks", "term_stats", "corpus")])


def write_vectors(celled: DataFrame, path: str) -> None:
    """Vectors in a folder per cell, so a probe reads its cells only."""
    celled.repartition("cell", F.pmod(F.xxhash64("kf_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(path)


def write_vector_index(celled: DataFrame, centers: np.ndarray, path: str) -> None:
    """Vectors by cell and the centres of the cells (a fixed number of rows)."""
    write_vectors(celled, f"{path}/vectors")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    celled.sparkSession.createDataFrame(rows, "cell int, center array<double>").write.mode("overwrite").parquet(f"{path}/cells")


def read_vector_index(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """What :func:`operators.dense.probe_cells` takes: the vectors with their cells, and the centres in order."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return spark.read.parquet(f"{path}/vectors"), np.array([r["center"] for r in cells])


def write_report(summary: DataFrame, per_query: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(f"{path}/summary")
    per_query.write.mode("overwrite").json(f"{path}/per_query")
