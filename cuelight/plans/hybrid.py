"""Keyframe ranking by smoothed vectors, detected objects and video metadata; transcript fusion to keyframes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.functions import numeric as N
from cuelight.operators import dense as D
from cuelight.operators import fusion as X
from cuelight.operators import intervals as I
from cuelight.operators import lexical as L
from cuelight.operators.ordered import gaussian, top_k
from cuelight.operators.transcripts import entity_boost
from cuelight.session import reliable


def smoothed(keyframes: DataFrame, sigma: float = 1.5, radius: int = 2) -> DataFrame:
    """Keyframes with vectors smoothed along their video: dot products then are smoothed scores."""
    vectors = keyframes.withColumn("embedding", N.as_doubles("embedding"))
    return gaussian(vectors, ["video_id"], "n", "embedding", "_s", radius, sigma, vector=True).drop("embedding").withColumnRenamed("_s", "embedding")


def metadata_boost(queries: DataFrame, pieces: DataFrame, k: int = 100) -> DataFrame:
    """query_id, video_id, meta: video BM25 over the best of the query."""
    hits = L.okapi(queries, pieces, k)
    best = hits.groupBy("query_id").agg(F.max("score").alias("_m"))
    return hits.join(best, "query_id").select("query_id", "video_id", (F.col("score") / F.col("_m")).alias("meta"))


def hybrid(
    queries: DataFrame, keyframes: DataFrame, objects: DataFrame, pieces: DataFrame, w_dense: float = 0.70,
    w_object: float = 0.15, w_meta: float = 0.15, smooth: bool = True, shot_dedup: bool = True, k: int = 100,
) -> DataFrame:
    """query_id, rank, kf_id, video_id, pts_time, score.

    Metadata boosts are a short list per query and are added inside the scan.
    Object hits are joined in; all other rows are ordered by dense plus
    metadata, so the best ``pool`` of those suffice. With shot dedup the pool is
    k times the fullest bucket, which always holds k different buckets.
    """
    frames = smoothed(keyframes) if smooth else keyframes
    meta = reliable(metadata_boost(queries, pieces))
    pool = k
    if shot_dedup:
        fullest = keyframes.groupBy("video_id", F.floor(F.col("pts_time") / 2.5)).count().agg(F.max("count")).head()[0]
        pool = k * (fullest or 1)
    boost = meta.select("query_id", "video_id", (F.col("meta") * (w_meta / w_dense)).alias("boost"))
    best = D.topk(queries, frames, pool, boost=boost).select("query_id", "kf_id")
    hits = reliable(entity_boost(queries, objects, keyframes))
    pairs = best.unionByName(hits.select("query_id", "kf_id")).distinct()
    scored = (
        D.score_pairs(pairs, queries, frames.select("kf_id", "video_id", "pts_time", "embedding"))
        .join(keyframes.select("kf_id", "video_id", "pts_time"), "kf_id")
        .join(hits, ["query_id", "kf_id"], "left").join(meta, ["query_id", "video_id"], "left")
        .withColumn("score", N.on_grid(
            F.col("dense") * w_dense + F.coalesce("object", F.lit(0.0)) * w_object + F.coalesce("meta", F.lit(0.0)) * w_meta
        ))
        .select("query_id", "kf_id", "video_id", "pts_time", "score")
    )
    if shot_dedup:
        return X.shot_buckets(scored, k)
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("kf_id")], k)


def keyframe_speech(segment_hits: DataFrame, keyframes: DataFrame, window: float = 3.0) -> DataFrame:
    """Fused segment hits over the best of the query, mapped to keyframes near them: max and its text."""
    best = segment_hits.groupBy("query_id").agg(F.max("fused").alias("_m"))
    norm = segment_hits.join(best, "query_id").select(
        "query_id", "video_id", "start_sec", "end_sec", "text", N.maxnorm("fused", "_m").alias("score"), F.col("rank").alias("hit_rank"))
    pairs = I.point_in_interval(norm, keyframes.select("video_id", "kf_id", "pts_time"), window)
    return I.best_per_point(pairs, ["query_id", "kf_id"])
