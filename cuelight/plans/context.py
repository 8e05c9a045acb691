"""Context around a moment: what was said and shown, as rows and as one text block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.operators import intervals as I
from cuelight.operators import sequence as S


def video_context(points: DataFrame, segments: DataFrame, lines: DataFrame, keys, window: float = 45.0) -> DataFrame:
    """Counts of speech and screen text of a point's video, and how many of each are near it."""
    flags = I.near_flags(points, segments, keys, window).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_if("is_near").alias("n_near"))
    totals = points.select(*keys, "video_id").join(
        lines.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_lines")), "video_id", "left").drop("video_id")
    shown = I.screen_context(points, lines, keys, window).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_shown"))
    return flags.join(totals, list(keys), "left").join(shown, list(keys), "left").na.fill(0, ["n_lines", "n_shown"])


def format_windows(windows: DataFrame) -> DataFrame:
    """query_id, block: expanded windows as numbered lines (a query has a handful)."""
    line = F.format_string(
        "%d. [%s] %.1fs - %.1fs (%d segments, %.3f): %s", "window_no", "video_id", "win_start", "win_end", "num_segments",
        "rerank_score", "context")
    return windows.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("block"))


def context_block(clips: DataFrame, segments: DataFrame, lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, speech, screen, windows: the context of a clip as text, with the counts of lines.

    clips: query_id, video_id, clip_start, clip_end; candidates: reranked segments.
    A clip is short and its fallback is 20 rows, so the gathered lines are few.
    """
    said = I.clip_context(clips, segments.select("video_id", "segment_id", "start_sec", "end_sec", "text"), ["query_id"])
    said = said.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "start_sec", "segment_id", F.format_string("[%ss - %ss]: %s", "start_sec", "end_sec", "text").alias("l")))).alias("_s"))
    timed = lines.select("video_id", F.col("line_id").alias("segment_id"), F.col("t_sec").alias("start_sec"), F.col("t_sec").alias("end_sec"), "text")
    seen = I.clip_context(clips, timed, ["query_id"])
    seen = seen.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "start_sec", "segment_id", F.format_string("[%.2fs]: %s", "start_sec", "text").alias("l")))).alias("_o"))
    top = format_windows(S.expand_and_dedup(candidates, segments, max_windows=3))
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["l"]), "\n"), F.lit(""))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return (
        clips.select("query_id", "video_id").join(said, "query_id", "left").join(seen, "query_id", "left").join(top, "query_id", "left")
        .select("query_id", "video_id", text("_s").alias("speech"), count("_s").alias("n_speech"), text("_o").alias("screen"),
                count("_o").alias("n_screen"), F.coalesce("block", F.lit("")).alias("windows"))
    )
