"""Joins on time: points in intervals, overlaps, as-of, nearest, exclusion, judgements.

All of them are equi-joins on (video, time bin) with the exact range as residual
condition. The bin bounds how many rows share a join key, so a video with a
third of all rows is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_SEC = 60.0


def _bin(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(float(width)))


def point_in_interval(
    intervals: DataFrame, points: DataFrame, window: float | Column = 0.0, t: str = "pts_time",
    start: str = "start_sec", end: str = "end_sec", video: str = "video_id", bin_sec: float = BIN_SEC,
) -> DataFrame:
    """Pairs with start - window <= t <= end + window in the same video (inner join)."""
    w = F.lit(float(window)) if isinstance(window, (int, float)) else window
    lo, hi = F.col(start) - w, F.col(end) + w
    left = (
        intervals.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi")
        .withColumn("_bin", F.explode(F.sequence(_bin(F.col("_lo"), bin_sec), _bin(F.col("_hi"), bin_sec))))
    )
    right = points.withColumn("_bin", _bin(F.col(t), bin_sec))
    return (
        left.join(right, [video, "_bin"])
        .filter((F.col("_lo") <= F.col(t)) & (F.col(t) <= F.col("_hi")))
        .drop("_bin", "_lo", "_hi")
    )


def near_points(
    left: DataFrame, right: DataFrame, t: str, radius: float, left_t: str = "pts_time", video: str = "video_id",
) -> DataFrame:
    """Pairs with |left_t - t| <= radius; a bin is one radius wide, so a point visits three bins."""
    width = max(float(radius), 1e-3)
    visits = left.withColumn("_bin", F.explode(F.array(*[_bin(F.col(left_t), width) + d for d in (-1, 0, 1)])))
    homes = right.withColumn("_bin", _bin(F.col(t), width))
    return (
        visits.join(homes, [video, "_bin"])
        .filter(F.abs(F.col(left_t) - F.col(t)) <= radius)
        .drop("_bin")
    )


def interval_overlap(
    left: DataFrame, right: DataFrame, margin: float = 3.0, video: str = "video_id", bin_sec: float = BIN_SEC,
    left_cols=("clip_start", "clip_end"), right_cols=("start_sec", "end_sec"),
) -> DataFrame:
    """Pairs of intervals with r.start <= l.end + margin and r.end >= l.start - margin.

    Both sides visit all their bins; a pair is kept only in the first bin they share.
    """
    ls, le = F.col(left_cols[0]) - margin, F.col(left_cols[1]) + margin
    rs, re = F.col(right_cols[0]), F.col(right_cols[1])

    def spread(df, lo, hi, first):
        return (
            df.withColumn("_f", _bin(lo, bin_sec)).withColumn("_g", _bin(hi, bin_sec)).filter("_f <= _g")
            .withColumn("_bin", F.explode(F.sequence("_f", "_g"))).withColumnRenamed("_f", first).drop("_g")
        )

    a, b = spread(left, ls, le, "_fa"), spread(right, rs, re, "_fb")
    return (
        a.join(b, [video, "_bin"])
        .filter((F.col("_bin") == F.greatest("_fa", "_fb")) & (rs <= le) & (re >= ls))
        .drop("_bin", "_fa", "_fb")
    )


def best_per_point(hits: DataFrame, keys, score: str = "score", text: str = "text", tie: str = "hit_rank") -> DataFrame:
    """Largest positive score per key and the text of the hit that gave it; the first hit wins ties."""
    return (
        hits.filter(F.col(score) > 0)
        .groupBy(*keys)
        .agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(tie)).alias("r"), F.col(text).alias("t"))).alias("_b"))
        .select(*keys, F.col("_b.s").alias("score"), F.col("_b.t").alias("text"))
    )


def active_segment(
    points: DataFrame, segments: DataFrame, keys, t: str = "pts_time", slack: float = 1.5, reach: float = 15.0,
) -> DataFrame:
    """Text spoken at a point: the first segment active within ``slack``, else the nearest midpoint
    within ``reach`` marked with its start; empty when there is neither."""
    video = "video_id"
    p = points.select(*keys, video, F.col(t).alias("_p"))
    s = segments.select(
        video, "segment_id", "start_sec", "end_sec", "text",
        ((F.col("start_sec") + F.col("end_sec")) / 2.0).alias("_mid"),
    )
    active = point_in_interval(s, p, slack, t="_p").select(
        *keys, F.struct(F.lit(0).alias("tier"), F.lit(0.0).alias("d"), "start_sec", "segment_id", "text").alias("_c")
    )
    near = near_points(p, s, "_mid", reach, left_t="_p").select(
        *keys,
        F.struct(
            F.lit(1).alias("tier"), F.abs(F.col("_mid") - F.col("_p")).alias("d"), "start_sec", "segment_id",
            F.concat(F.format_string("[%.1fs] ", "start_sec"), "text").alias("text"),
        ).alias("_c"),
    )
    best = active.unionByName(near).groupBy(*keys).agg(F.min("_c").alias("_c"))
    return points.join(best.select(*keys, F.col("_c.text").alias("_t")), list(keys), "left").withColumn(
        "spoken", F.coalesce("_t", F.lit(""))
    ).drop("_t")


def nearest_row(marks: DataFrame, rows: DataFrame, keys, key: str = "kf_id") -> DataFrame:
    """Per mark the row with its (video, frame), else the row nearest in time in its video.

    marks: keys, video_id, frame_idx, pts_time. Candidates are reduced on the map side.
    """
    m = marks.select(*keys, "video_id", F.col("frame_idx").alias("_f"), F.col("pts_time").alias("_p"))
    order = F.struct(
        F.when(F.col("frame_idx") == F.col("_f"), 0).otherwise(1).alias("miss"),
        F.when(F.col("frame_idx") == F.col("_f"), 0.0).otherwise(F.abs(F.col("pts_time") - F.col("_p"))).alias("d"),
        F.col(key).alias("id"),
    )
    best = m.join(rows.select("video_id", "frame_idx", "pts_time", key), "video_id").groupBy(*keys).agg(
        F.min(order).alias("_o")
    )
    return best.select(*keys, F.col("_o.id").alias(key))


def shot_bounds(points: DataFrame, boundaries: DataFrame, keys, tolerance: float = 1.5) -> DataFrame:
    """Shot around each point, clamped to ``tolerance``, and the boundary frames inside it.

    points: keys, video_id, pts_time; boundaries: video_id, pts_time, frame_idx.
    """
    cents = lambda c: F.floor(c * 100.0 + 0.5) / 100.0
    p = points.select(*keys, "video_id", F.col("pts_time").alias("_p"))
    b = boundaries.select("video_id", F.col("pts_time").alias("_b"), "frame_idx")
    last = b.groupBy("video_id").agg(F.max("_b").alias("_last"))
    # only boundaries within the tolerance can move a clamped bound
    near = near_points(p, b, "_b", tolerance + 0.02, left_t="_p").groupBy(*keys).agg(
        F.max(F.when(F.col("_b") <= F.col("_p"), F.col("_b"))).alias("_prev"),
        F.min(F.when(F.col("_b") >= F.col("_p"), F.col("_b"))).alias("_next"),
    )
    t = F.col("_p")
    lo_clamp, hi_clamp = cents(t - tolerance), cents(t + tolerance)
    bounds = (
        p.join(last, "video_id", "left").join(near, list(keys), "left")
        .withColumn("_prev", F.coalesce("_prev", F.lit(0.0)))
        .withColumn("_next", F.coalesce("_next", F.when(F.col("_last") >= t, hi_clamp + 1.0).otherwise(F.col("_last"))))
        .withColumn("_start", F.greatest(cents(F.col("_prev")), lo_clamp))
        .withColumn("_end0", F.least(cents(F.col("_next")), hi_clamp))
        .withColumn(
            "_end", F.when(F.col("_end0") <= F.col("_start"), cents(F.col("_start") + tolerance)).otherwise(F.col("_end0"))
        )
        .withColumn("start_sec", F.when(F.col("_last").isNull(), F.greatest(F.lit(0.0), lo_clamp)).otherwise(F.col("_start")))
        .withColumn("end_sec", F.when(F.col("_last").isNull(), hi_clamp).otherwise(F.col("_end")))
        .select(*keys, "video_id", "start_sec", "end_sec")
    )
    inside = point_in_interval(bounds, b, 0.0, t="_b").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_b", "frame_idx"))).alias("_in")
    )
    return bounds.join(inside, list(keys), "left").select(
        *keys, "video_id", "start_sec", "end_sec",
        F.coalesce(F.transform("_in", lambda s: s["frame_idx"]), F.array().cast("array<bigint>")).alias("frames"),
    )


def outside_windows(points: DataFrame, windows: DataFrame, keys, t: str = "pts_time", margin: float = 5.0) -> DataFrame:
    """Points that lie in no window of their video, each window widened by ``margin``."""
    p = points.select(*keys, "video_id", F.col(t).alias("_p"))
    hit = point_in_interval(windows.select("video_id", "start_sec", "end_sec"), p, margin, t="_p")
    return points.join(hit.select(*keys).distinct(), list(keys), "left_anti")


def judged_hits(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Result rows that match a judged segment of their query (semi-type).

    truth: query_id, video_id, start_sec, end_sec, frames array. Judgements per
    query are few, so the join key is (query, video).
    """
    r, g = results.alias("r"), truth.alias("g")
    pts, lo, hi = F.col("r.pts_time"), F.col("g.start_sec"), F.col("g.end_sec")
    in_time = (lo >= 0) & (hi >= 0) & (pts >= 0) & pts.between(lo, hi)
    listed = F.coalesce(F.array_contains("g.frames", F.col("r.frame_idx")), F.lit(False))
    same = (F.col("r.query_id") == F.col("g.query_id")) & (F.col("r.video_id") == F.col("g.video_id"))
    return r.join(g, same & (listed | F.coalesce(in_time, F.lit(False))), "left_semi")


def hard_negatives(truth: DataFrame, segments: DataFrame, reach: float = 30.0) -> DataFrame:
    """Segments of the judged video within ``reach`` of a judged segment that are not relevant themselves."""
    wide = truth.select("query_id", "video_id", F.col("start_sec").alias("clip_start"), F.col("end_sec").alias("clip_end"))
    seg = segments.select("video_id", "segment_id", "start_sec", "end_sec")
    near = interval_overlap(wide, seg, reach).select("query_id", "video_id", "segment_id", "start_sec", "end_sec").distinct()
    relevant = interval_overlap(wide, seg, 0.0).select("query_id", "video_id", "segment_id").distinct()
    return near.join(relevant, ["query_id", "video_id", "segment_id"], "left_anti")


def frame_info(wanted: DataFrame, frame_map: DataFrame, fps: float = 30.0) -> DataFrame:
    """Position (0-based) to frame data; a position without a row gets a synthetic one at 30 fps."""
    m = frame_map.select(
        "video_id", (F.col("row_no") - 1).alias("position"), F.col("n").alias("_n"), F.col("pts_time").alias("_p"),
        F.col("fps").alias("_f"), F.col("frame_idx").alias("_x"),
    )
    i = F.col("position")
    return wanted.join(m, ["video_id", "position"], "left").select(
        *wanted.columns,
        F.coalesce("_n", i + 1).alias("n"), F.coalesce("_p", i.cast("double")).alias("pts_time"),
        F.coalesce("_f", F.lit(fps)).alias("fps"), F.coalesce("_x", (i * int(fps)).cast("bigint")).alias("frame_idx"),
    )


def frame_by_name(names: DataFrame, frame_map: DataFrame) -> DataFrame:
    """Keyframe name to frame: the row with that ``n``, else the last row at or before it, else n * 30."""
    n = F.coalesce(F.regexp_replace("name", r"(?<=.)\.[^.]*$", "").try_cast("bigint"), F.lit(1).cast("bigint"))
    w = names.withColumn("_n", n)
    exact = frame_map.groupBy("video_id", "n").agg(F.min_by("frame_idx", "row_no").alias("_exact"))
    size = frame_map.groupBy("video_id").agg(F.count(F.lit(1)).alias("_size"))
    by_pos = frame_map.select("video_id", F.col("row_no").alias("_pos"), F.col("frame_idx").alias("_clamped"))
    return (
        w.join(exact.withColumnRenamed("n", "_n"), ["video_id", "_n"], "left")
        .join(size, "video_id", "left")
        .withColumn("_pos", F.least(F.col("_n"), F.col("_size")))
        .join(by_pos, ["video_id", "_pos"], "left")
        .select(*names.columns, F.coalesce("_exact", "_clamped", F.col("_n") * 30).cast("bigint").alias("frame_idx"))
    )


def near_flags(points: DataFrame, segments: DataFrame, keys, window: float = 45.0) -> DataFrame:
    """All segments of a point's video with ``is_near``. The output is that large by definition."""
    p = points.select(*keys, "video_id", F.col("pts_time").alias("_p"))
    t = F.col("_p")
    near = (
        (F.abs(F.col("start_sec") - t) <= window) | (F.abs(F.col("end_sec") - t) <= window)
        | t.between(F.col("start_sec"), F.col("end_sec"))
    )
    return p.join(segments, "video_id").withColumn("is_near", near).drop("_p")


def screen_context(points: DataFrame, lines: DataFrame, keys, window: float = 45.0, fallback: int = 30) -> DataFrame:
    """Lines within ``window`` of a point; when there are none, the first ``fallback`` lines of the video."""
    p = points.select(*keys, "video_id", F.col("pts_time").alias("_p"))
    near = near_points(p, lines, "t_sec", window, left_t="_p").drop("_p").withColumn("is_near", F.lit(True))
    lonely = p.join(near.select(*keys).distinct(), list(keys), "left_anti").drop("_p")
    w = Window.partitionBy("video_id").orderBy("t_sec", "line_id")
    head = lines.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= fallback).drop("_rn")
    return near.unionByName(lonely.join(head, "video_id").withColumn("is_near", F.lit(False)))


def clip_context(clips: DataFrame, segments: DataFrame, keys, margin: float = 3.0, fallback: int = 20) -> DataFrame:
    """Segments that overlap a clip widened by ``margin``; when there are none, the first ``fallback``."""
    c = clips.select(*keys, "video_id", "clip_start", "clip_end")
    hits = interval_overlap(c, segments, margin).drop("clip_start", "clip_end").withColumn("overlaps", F.lit(True))
    lonely = c.join(hits.select(*keys).distinct(), list(keys), "left_anti").drop("clip_start", "clip_end")
    w = Window.partitionBy("video_id").orderBy("start_sec", "segment_id")
    head = segments.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= fallback).drop("_rn")
    return hits.unionByName(lonely.join(head, "video_id").withColumn("overlaps", F.lit(False)))
