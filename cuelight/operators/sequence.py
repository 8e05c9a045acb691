"""Sequential temporal algorithms, each with its state local to a bounded group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.functions import numeric as N
from cuelight.functions.text import strip
from cuelight.operators.ordered import time_chunk, top_k, with_position, with_previous
from cuelight.operators.sampling import draw_key, unit
from cuelight.operators.spacing import spaced
from cuelight.session import reliable


def suppress(
    pool: DataFrame, k: int, window: float = 1.5, key: str = "kf_id", by=("query_id",), seed: str | None = None,
) -> DataFrame:
    """Greedy suppression in rank order: a row goes when a kept row of its video is nearer than ``window``.

    pool: by, rank, video_id, key, pts_time and more, which stays on the rows. Seeds (a boolean column) are kept
    whatever is near them and come first. Suppression never crosses videos, so
    each (query, video) is folded on its own; a pool is a top-k list, which
    bounds the fold. Suppressed rows are not replaced.
    """
    seeded = F.col(seed) if seed else F.lit(False)
    rest = [c for c in pool.columns if c not in (*by, "video_id")]
    item = F.struct(
        (~seeded).alias("free"), F.col("rank").alias("rank"), F.col(key).alias("id"), F.col("pts_time").alias("p"),
        F.struct(*rest).alias("row"),
    )
    groups = pool.groupBy(*by, "video_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    kind = groups.schema["_items"].dataType.simpleString()

    def step(kept, x):
        close = F.exists(kept, lambda y: F.abs(y["p"] - x["p"]) < window)
        return F.when(x["free"] & close, kept).otherwise(F.concat(kept, F.array(x)))

    kept = groups.withColumn("_kept", F.aggregate("_items", F.array().cast(kind), step)).select(
        *by, "video_id", F.explode("_kept").alias("_k")
    )
    rows = kept.select(*by, "video_id", "_k.row.*", F.col("_k.free").alias("_free")).withColumnRenamed("rank", "pool_rank")
    return top_k(rows, list(by), [F.asc("_free"), F.asc("pool_rank"), F.asc(key)], k).drop("_free")


def with_neighbours(segments: DataFrame, chunk_rows: float = 4096.0) -> DataFrame:
    """Segments with their position in the video (by segment_id, then start)."""
    return with_position(
        segments, ["video_id"], ["segment_id", "start_sec"], time_chunk("segment_id", chunk_rows), "position"
    )


def context_windows(
    candidates: DataFrame, segments: DataFrame, reach: int = 1, max_gap: float = 8.0, keys=("query_id",),
) -> DataFrame:
    """Each candidate with the window of its neighbours: bounds, frames, count and stitched text.

    candidates: keys, rank, video_id, segment_id, start_sec, end_sec, ...
    segments: with ``position``, start_frame, end_frame.
    A candidate meets 2 * reach + 1 positions by an equi-join. A candidate whose
    segment is not in the table is its own window if the table has its video.
    """
    id_cols = [*keys, "rank"]
    anchors = candidates.join(
        segments.select("video_id", "segment_id", "position"), ["video_id", "segment_id"]
    )
    visits = anchors.select(
        *id_cols, "video_id", F.struct(*candidates.columns).alias("_row"),
        F.explode(F.sequence(F.col("position") - reach, F.col("position") + reach)).alias("position"),
    )
    piece = F.struct(
        "start_sec", "position", "end_sec", "start_frame", "end_frame", strip("text").alias("text")
    )
    gathered = (
        visits.join(segments, ["video_id", "position"])
        .groupBy(*id_cols).agg(F.array_sort(F.collect_list(piece)).alias("_w"), F.first("_row").alias("_row"))
    )
    w = F.col("_w")

    def say(x, i):
        before = F.when(i > 0, F.element_at(w, i)["end_sec"]).otherwise(x["start_sec"])
        pause = x["start_sec"] - before > max_gap
        return F.when(pause, F.concat(F.format_string("... [%.1fs] ... ", x["start_sec"]), x["text"])).otherwise(x["text"])

    stitched = strip(F.regexp_replace(F.array_join(F.transform(w, say), " "), r"\s+", " "))
    last = F.element_at(w, -1)
    found = gathered.select(
        "_row.*", w[0]["start_sec"].alias("win_start"), last["end_sec"].alias("win_end"),
        F.size(w).cast("bigint").alias("num_segments"), w[0]["start_frame"].alias("start_frame"),
        last["end_frame"].alias("end_frame"), stitched.alias("context"),
    )
    alone = candidates.join(segments.select("video_id", "segment_id"), ["video_id", "segment_id"], "left_anti").join(
        segments.select("video_id").distinct(), "video_id", "left_semi")
    own = {c: F.col(c) if c in candidates.columns else F.lit(d) for c, d in (("start_frame", 0), ("end_frame", 0), ("text", ""))}
    kinds = dict(found.dtypes)
    return found.unionByName(alone.select(
        *candidates.columns, F.col("start_sec").alias("win_start"), F.col("end_sec").alias("win_end"), F.lit(1).cast("bigint").alias("num_segments"),
        *[own[c].cast(kinds[c]).alias(c) for c in ("start_frame", "end_frame") if c not in candidates.columns],
        strip(F.regexp_replace(F.coalesce(own["text"], F.lit("")), r"\s+", " ")).alias("context")))


def expand_and_dedup(
    candidates: DataFrame, segments: DataFrame, reach: int = 1, max_windows: int = 4, max_gap: float = 8.0,
    overlap: float = 0.35, keys=("query_id",),
) -> DataFrame:
    """Accept candidates in rank order unless an accepted window of the video covers ``overlap`` of them.

    The candidates of a query are a top-k list, so the fold per (query, video) is short.
    """
    wide = context_windows(candidates, segments, reach, max_gap, keys)
    rest = [c for c in wide.columns if c not in keys]
    item = F.struct("rank", "start_sec", "end_sec", "win_start", "win_end", F.struct(*rest).alias("row"))
    groups = wide.groupBy(*keys, "video_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    kind = groups.schema["_items"].dataType.simpleString()

    def step(kept, x):
        def covers(y):
            shared = F.least(x["end_sec"], y["win_end"]) - F.greatest(x["start_sec"], y["win_start"])
            own = F.greatest(F.lit(1.0), x["end_sec"] - x["start_sec"])
            return (shared > 0) & (shared / own >= overlap)

        return F.when(F.exists(kept, covers), kept).otherwise(F.concat(kept, F.array(x)))

    accepted = groups.select(*keys, F.explode(F.aggregate("_items", F.array().cast(kind), step)).alias("_k")).select(*keys, "_k.row.*")
    return top_k(accepted, list(keys), [F.asc("rank")], max_windows, "window_no")


def align(
    events: DataFrame, keyframes: DataFrame, top_videos: int = 10, chunk_rows: int = 4096,
) -> DataFrame:
    """Best strictly increasing keyframes for an ordered list of event vectors, per query and video.

    events: query_id, event_no (0-based), embedding; keyframes: video_id, n, frame_idx, embedding.
    Videos are first ranked by their best keyframe against the mean event, then
    the exact alignment of the ``top_videos`` is one (max, +) matrix per chunk
    of a timeline and one fold over a timeline's matrices.
    """
    from cuelight.operators import dense as D
    from cuelight.operators.maxplus import alignments

    means = D.mean_vectors(events, ["query_id"])
    best = D.topk(means, keyframes, 1, "kf_id", group="video_id")
    videos = top_k(best.select("query_id", "video_id", "dense"), ["query_id"],
                   [F.desc("dense"), F.asc("video_id")], top_videos, "video_rank").select("query_id", "video_id")
    packed = events.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("event_no", "embedding"))).alias("_ev"))
    frames = (
        keyframes.select("video_id", "n", "frame_idx", "embedding").join(videos, "video_id").join(packed, "query_id")
        .select("query_id", "video_id", "n", "frame_idx", F.transform("_ev", lambda e: N.dot(e["embedding"], F.col("embedding"))).alias("_s"))
    )
    return alignments(frames, ["query_id", "video_id"], chunk_rows)


def shots(
    frames: DataFrame, threshold: float = 0.35, min_frames: int = 3, chunk_rows: float = 4096.0, fps: float = 25.0,
) -> DataFrame:
    """Shots over a table of frame histograms: video_id, frame_no (0-based, dense), hist.

    A cut is a drop of the correlation with the frame before by more than
    ``threshold`` once the current shot has ``min_frames``; close cuts are
    decided chunk by chunk (:mod:`cuelight.operators.spacing`).
    """
    chunk = time_chunk("frame_no", chunk_rows)
    seen = with_previous(frames, ["video_id"], ["frame_no"], chunk, ["hist"])
    drop = F.lit(1.0) - correlation(F.col("prev.hist"), F.col("hist"))
    cuts = reliable(seen.filter(drop > threshold).select("video_id", "frame_no"))
    starts = frames.groupBy("video_id").agg(F.lit(0).cast("bigint").alias("frame_no"))
    candidates = cuts.unionByName(starts).distinct().withColumn("_no", F.col("frame_no"))
    accepted = reliable(spaced(candidates, "frame_no", "_no", min_frames, max(chunk_rows, min_frames + 1.0)).drop("_no"))
    ends = frames.groupBy("video_id").agg((F.max("frame_no") + 1).alias("_len"))
    back = with_previous(
        accepted.withColumn("_neg", -F.col("frame_no")), ["video_id"], ["_neg"], F.floor(F.col("_neg") / chunk_rows),
        ["frame_no"], "next",
    ).drop("_neg")
    pieces = back.join(ends, "video_id").select(
        "video_id", F.col("frame_no").alias("start_frame"), F.coalesce(F.col("next.frame_no"), F.col("_len")).alias("_stop"),
        F.col("next").isNull().alias("_tail"), "_len",
    )
    # only the tail can be too short; it stays when it is the whole video
    kept = pieces.filter(~F.col("_tail") | (F.col("_stop") - F.col("start_frame") >= min_frames) | (F.col("start_frame") == 0))
    numbered = with_position(kept, ["video_id"], ["start_frame"], time_chunk("start_frame", chunk_rows), "_no")
    return numbered.select(
        "video_id", (F.col("_no") - 1).alias("shot_id"), "start_frame", (F.col("_stop") - 1).alias("end_frame"),
        F.greatest(F.lit(0.0), (F.col("_stop") - 1 - F.col("start_frame")) / F.lit(float(fps))).alias("duration_sec"),
    )


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays on the score grid; 1 when a side is constant."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    centred = lambda v: N.let(
        total(v) / F.size(v).cast("double"), lambda m: F.transform(v, lambda x: x - m))
    product = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))

    def of(s):
        va, vb = product(s["a"], s["a"]), product(s["b"], s["b"])
        return F.when((va > 0) & (vb > 0), N.on_grid(product(s["a"], s["b"]) / F.sqrt(va * vb))).otherwise(F.lit(1.0))

    pair = F.struct(centred(N.as_doubles(a)).alias("a"), centred(N.as_doubles(b)).alias("b"))
    return F.when(a.isNotNull() & b.isNotNull(), N.let(pair, of))


def prune_static(
    frames: DataFrame, min_gap: float = 0.5, similar: float = 0.96, chunk_width: float = 60.0,
) -> DataFrame:
    """Drop a frame less than ``min_gap`` after the last kept frame that correlates more than ``similar`` with it.

    frames: video_id, frame_no, pts_time, hist. A task holds the frames of ``chunk_width`` seconds, 1,500 at 25 frames a second.
    """
    return spaced(frames, "pts_time", "frame_no", min_gap, chunk_width, "hist", similar).select("video_id", "frame_no", "pts_time")


def shot_samples(shot_rows: DataFrame, fps: float = 25.0) -> DataFrame:
    """Frames to sample from each shot, by its length: one row per sample."""
    s, e, t = F.col("start_frame"), F.col("end_frame"), F.col("duration_sec")
    span = e - s
    whole = lambda x: F.floor(x).cast("bigint")
    first, last = s + whole(span * F.lit(0.10)), s + F.least(span, whole(span * F.lit(0.90)))
    step = max(1, int(3.0 * fps))
    between = F.when(
        first + step < last, F.sequence(first + step, last - 1, F.lit(step).cast("bigint"))
    ).otherwise(F.array().cast("array<bigint>"))
    picks = (
        F.when(e <= s, F.array(s))
        .when(t < 1.5, F.array(s + whole(span / 2)))
        .when(t <= 5.0, F.array(s + whole(span / 4), s + whole(span * 3 / 4)))
        .otherwise(F.concat(F.array(first, s + whole(span / 2), last), between))
    )
    return shot_rows.withColumn("sample_frame", F.explode(F.array_sort(F.array_distinct(picks))))


def neighbour_flood(centres: DataFrame, keys, total: int = 100, step: int = 1) -> DataFrame:
    """``total`` frames outward from a centre: c, c-1, c+1, ...; negative frames are skipped. Each row of ``centres`` is a centre, worked off where it lies."""
    away = F.sequence(F.lit(1), F.lit(total))
    d = F.concat(F.array(F.lit(0)), F.flatten(F.transform(away, lambda x: F.array(-x, x))))
    frame = lambda x: F.col("frame_idx") + x * step
    kept = F.slice(F.filter(d, lambda x: (frame(x) >= 0) | (x == 0)), 1, total)
    return (
        centres.select(*keys, "video_id", "frame_idx", F.posexplode(kept).alias("_i", "_d"))
        .select(*keys, "video_id", frame(F.col("_d")).alias("frame"), (F.col("_i") + 1).cast("bigint").alias("row_no"))
    )


def clip_grid(start, end, n: int = 6) -> Column:
    """``n`` evenly spaced times from start to end, at least 0.1 s apart end to end."""
    lo = F.greatest(F.lit(0.0), F.col(start))
    hi = F.greatest(lo + 0.1, F.col(end))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.when(i == n - 1, hi).otherwise(lo + i * ((hi - lo) / F.lit(float(n - 1)))),
    )


def every(duration_frames, fps, seconds: float = 3.0) -> Column:
    """Frames at every ``seconds`` of a video."""
    step = F.greatest(F.lit(1), F.floor(F.lit(seconds) * fps)).cast("bigint")
    return F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), duration_frames - 1).cast("bigint"), step)


def clip_range_error(start, end) -> Column:
    """Why a requested clip is unusable: missing, not_a_number, not_finite or inverted; null when it is fine."""
    s, e = F.col(start), F.col(end)
    a, b = s.try_cast("double"), e.try_cast("double")
    odd = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        F.when(s.isNull() | e.isNull(), "missing")
        .when(a.isNull() | b.isNull(), "not_a_number")
        .when(odd(a) | odd(b), "not_finite")
        .when((a < 0) | (b <= a), "inverted")
    )


def sample_times(videos: DataFrame, tries: int = 8, seed: int = 0) -> DataFrame:
    """``tries`` repeatable sample times per video inside 10-90 % of it and 1 s from both ends.

    videos: video_id, n_frames, fps. Videos under 3 s or 30 frames are skipped.
    """
    length = F.col("n_frames") / F.col("fps")
    lo, hi = F.greatest(F.lit(1.0), length * 0.10), F.least(length - 1.0, length * 0.90)
    usable = videos.filter((F.col("n_frames") >= 30) & (F.col("fps") > 0) & (length >= 3.0))
    share = unit(draw_key(F.lit(seed), "video_id", "try_no"))
    return usable.withColumn("try_no", F.explode(F.sequence(F.lit(1), F.lit(tries)))).withColumn(
        "pts_time", lo + share * (hi - lo))
