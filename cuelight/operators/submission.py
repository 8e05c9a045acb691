"""Ranked output tables: padding, formatting, merging and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.functions.text import strip

#: fixed value: the video named in a row that stands for "no prediction"
DEFAULT_VIDEO = "L21_V001"
ROWS = 100


def pad(preds: DataFrame, queries: DataFrame, defaults: dict[str, Column], total: int = ROWS) -> DataFrame:
    """Exactly ``total`` rows per query: the last prediction repeats, a default row fills an empty query."""
    last = preds.groupBy("query_id").agg(F.max("rank").alias("_n"))
    slots = (
        queries.select("query_id").join(last, "query_id", "left")
        .withColumn("row_no", F.explode(F.sequence(F.lit(1), F.lit(total))))
        .withColumn("rank", F.when(F.col("_n").isNotNull(), F.least("row_no", "_n")).otherwise(-1))
        .drop("_n")
    )
    filled = slots.join(preds, ["query_id", "rank"], "left")
    values = [F.when(F.col("rank") < 0, v).otherwise(F.col(c)).alias(c) for c, v in defaults.items()]
    return filled.select("query_id", F.col("row_no").cast("bigint").alias("row_no"), *values)


def _frame(x) -> Column:
    return F.bround(F.col(x) if isinstance(x, str) else x, 0).cast("bigint")


def format_kis(preds: DataFrame, queries: DataFrame) -> DataFrame:
    rows = pad(preds, queries, {"video_id": F.lit(DEFAULT_VIDEO), "frame_idx": F.lit(0.0)})
    return rows.select("query_id", "row_no", F.concat_ws(",", T.file_stem("video_id"), _frame("frame_idx")).alias("line"))


def format_qa(preds: DataFrame, queries: DataFrame) -> DataFrame:
    rows = pad(preds, queries, {"video_id": F.lit(DEFAULT_VIDEO), "frame_idx": F.lit(0.0), "answer": F.lit("")})
    return rows.select(
        "query_id", "row_no",
        F.concat_ws(",", T.file_stem("video_id"), _frame("frame_idx"), T.csv_field("answer")).alias("line"),
    )


def format_sequences(preds: DataFrame, queries: DataFrame, n_events: int | None = None) -> DataFrame:
    """The default row has as many events as the first prediction, else ``n_events``, else four."""
    n = n_events or 4
    fallback = F.array(*[F.lit(float(30 * i)) for i in range(n)])
    rows = pad(preds, queries, {"video_id": F.lit(DEFAULT_VIDEO), "frames": fallback})
    frames = F.array_join(F.transform("frames", lambda f: F.bround(f, 0).cast("bigint").cast("string")), ",")
    return rows.select("query_id", "row_no", F.concat_ws(",", T.file_stem("video_id"), frames).alias("line"))


def merge_sources(flood: DataFrame, pinned: DataFrame, marked: DataFrame, results: DataFrame, k: int = ROWS) -> DataFrame:
    """Rows of a query by priority: flooded rows alone if there are any, else pinned, marked, results.

    All inputs: query_id, pos, video_id, frame_idx. Repeats keep their first place.
    """
    cols = ["query_id", "pos", "video_id", "frame_idx"]
    flooded = flood.select("query_id").distinct()
    tier = lambda df, i: df.select(*cols, F.lit(i).alias("_tier"))
    rest = tier(pinned, 1).unionByName(tier(marked, 2)).unionByName(tier(results, 3)).join(flooded, "query_id", "left_anti")
    first = rest.groupBy("query_id", "video_id", "frame_idx").agg(F.min(F.struct("_tier", "pos")).alias("_at"))
    rows = tier(flood, 0).select("query_id", "video_id", "frame_idx", F.struct("_tier", "pos").alias("_at")).unionByName(first)
    w = Window.partitionBy("query_id").orderBy("_at", "video_id", "frame_idx")
    return (
        rows.withColumn("row_no", F.row_number().over(w)).filter(F.col("row_no") <= k)
        .select("query_id", F.col("row_no").cast("bigint").alias("row_no"), "video_id", "frame_idx")
    )


def csv_fields(line) -> Column:
    """Fields of one CSV line, quotes removed."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(
        raw,
        lambda f: F.when(
            F.startswith(f, F.lit('"')), F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"'))
        ).otherwise(f),
    )


def validate(lines: DataFrame, mode: str | None = None) -> DataFrame:
    """Error rows (file, row_no, error) for submission lines (file, row_no, line).

    Row 0 carries the errors of a whole file; one with nothing but blank lines
    is empty.
    """
    f = F.col("_f")
    n = F.size(f)
    video = strip(f[0])
    is_int = lambda x: strip(x).rlike(r"^\d+$")
    as_mode = F.lit(mode) if mode else F.when(n == 2, "kis").when(n > 3, "trake").otherwise("any")
    frames = F.transform(F.slice(f, 2, F.greatest(F.lit(0), n - 1)), lambda x: strip(x).try_cast("bigint"))
    ordered = F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(frames) - 1)), lambda i: (
        F.size(frames) < 2) | (F.try_element_at(frames, i) <= F.try_element_at(frames, i + 1)))
    bad_frames = F.exists(frames, lambda x: x.isNull())
    checks = [
        F.when(F.lower(video).rlike(r"\.(mp4|avi|mkv|mov)$"), "file_extension"),
        F.when(video.rlike(r"[/\\]"), "path_separator"),
        F.when((as_mode == "kis") & (n != 2), "column_count")
        .when((as_mode == "kis") & ~is_int(F.try_element_at(f, F.lit(2))), "frame_not_integer")
        .when((as_mode == "qa") & (n < 3), "column_count")
        .when((as_mode == "trake") & (n < 3), "column_count")
        .when((as_mode == "trake") & bad_frames, "frame_not_integer")
        .when((as_mode == "trake") & ~ordered, "not_chronological"),
        F.when((as_mode == "qa") & (n >= 3) & ~is_int(F.try_element_at(f, F.lit(2))), "frame_not_integer"),
        F.when((as_mode == "qa") & (n >= 3) & (F.length(F.try_element_at(f, F.lit(3))) > 100), "answer_too_long"),
        F.when((F.col("row_no") == 1) & F.lower(f[0]).rlike("video|query|id|frame"), "header_row"),
    ]
    parsed = lines.filter(strip("line") != "").withColumn("_f", csv_fields(F.col("line")))
    per_row = parsed.select(
        "file", "row_no", F.explode(F.filter(F.array(*checks), lambda e: e.isNotNull())).alias("error")
    )
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("_n"), F.count_if(strip(F.coalesce("line", F.lit(""))) != "").alias("_filled"))
    whole = F.filter(F.array(F.when(F.col("_filled") == 0, "empty_file"), F.when(F.col("_n") > ROWS, "too_many_rows")), lambda e: e.isNotNull())
    return per_row.unionByName(sizes.select("file", F.lit(0).cast("bigint").alias("row_no"), F.explode(whole).alias("error")))
