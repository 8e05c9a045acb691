"""Search refined by marked keyframes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.functions.text import strip
from cuelight.operators import dense as D
from cuelight.operators import fusion as X
from cuelight.operators import intervals as I
from cuelight.operators import sequence as S
from cuelight.plans import search as P
from cuelight.session import reliable

#: bonus at a mark, seconds around it in which the bonus falls, and the bonus of its video beyond them
NEAR_BONUS, REACH, FAR_BONUS = 0.25, 45.0, 0.08


def refine(
    queries: DataFrame, marks: DataFrame, corpus: P.Corpus, dim: int, keywords: DataFrame | None = None,
    weights: tuple[float, float] | None = None, top: int = 100, window: float = 5.0, alpha: float = 0.65, beta: float = 0.35,
) -> DataFrame:
    """Ranked keyframes after feedback.

    marks: query_id, mark_no, video_id, frame_idx, pts_time, pinned. Marked
    keyframes come first with score 1, pinned ones before all. keywords: as of
    ``search``.

    The bonus of the marks is added to the dense scores where they are made, with
    the evidence of speech and keywords; marked keyframes leave the scan whatever
    their score.
    """
    kf = corpus.keyframes
    queries = P.with_intent(queries)
    positives = reliable(I.nearest_row(marks, kf, ["query_id", "mark_no"]))
    vectors = positives.join(kf.select("kf_id", "embedding"), "kf_id")
    moved = reliable(D.rocchio(queries, vectors, dim, alpha, beta))
    speech = reliable(P.lexical_evidence(queries, corpus, window, calibration="max"))
    pool_size = 4 * top

    if keywords is not None:
        keywords = reliable(P.usable_keywords(keywords, queries))
    own = marks.groupBy("query_id").agg(F.collect_list(F.struct("video_id", "pts_time")).alias("marks"))
    packed = P.pack_queries(moved, None, kf, keywords).join(own, "query_id", "left").join(fixed_route(queries, weights), "query_id")
    extra = P.keyword_scores(keywords, corpus) if keywords is not None else None
    best = D.fused_topk(
        packed, kf, P.all_evidence(speech, extra, positives), pool_size, by_lead=keywords is not None, bonus=(NEAR_BONUS, REACH, FAR_BONUS))
    fused = reliable(best.join(kf.select("kf_id", "video_id", "pts_time", "fps", "frame_idx"), "kf_id"))
    pool = fused.filter(F.col("rank") <= pool_size)
    seeds = positives.groupBy("query_id", "kf_id").agg(F.min("mark_no").alias("mark_no"))
    seeded = (
        fused.join(seeds, ["query_id", "kf_id"]).withColumn("rank", F.col("mark_no").cast("int")).drop("mark_no").withColumn("seed", F.lit(True))
        .unionByName(pool.join(seeds.select("query_id", "kf_id"), ["query_id", "kf_id"], "left_anti").withColumn("seed", F.lit(False)))
    )
    ranked = reliable(S.suppress(seeded, top, 2.0, seed="seed"))
    ranked = reliable(P.with_texts(ranked, speech, keywords, corpus.docs))
    shown = ranked.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.col("fused")))
    pins = marks.filter("pinned").select("query_id", F.col("mark_no").alias("pin_no"), "video_id", "frame_idx", F.col("pts_time").alias("_pin_t"))
    final = X.pinned_first(shown.select("query_id", "rank", "video_id", "frame_idx", "score"), pins, top)
    details = shown.select("query_id", "video_id", "frame_idx", "kf_id", "pts_time", "dense", "norm", "speech", "speech_text", "exact_text")
    out = final.join(details, ["query_id", "video_id", "frame_idx"], "left").join(
        pins.select("query_id", "video_id", "frame_idx", "_pin_t").distinct(), ["query_id", "video_id", "frame_idx"], "left"
    ).withColumn("pts_time", F.coalesce("_pin_t", "pts_time")).drop("_pin_t")
    spoken = I.active_segment(out, corpus.segments, ["query_id", "rank"])
    pin_text = F.when(F.col("spoken") != "", F.concat(F.lit("Pinned Match · "), F.col("spoken"))).otherwise(F.lit("Pinned Match"))
    text = F.when(F.col("is_pinned"), pin_text).otherwise(F.coalesce("exact_text", "speech_text", "spoken"))
    return spoken.withColumn("matched_speech", text).select(
        "query_id", "rank", "video_id", "frame_idx", "pts_time", "score", "is_pinned", "matched_speech"
    )


def fixed_route(queries: DataFrame, weights: tuple[float, float] | None) -> DataFrame:
    """Feedback uses the intent's weights as they are: no evidence gate. Chosen weights are clamped to 0..1."""
    if weights is not None:
        d, s = (max(0.0, min(1.0, float(w))) for w in weights)
        return queries.select("query_id", F.lit(d).alias("w_dense"), F.lit(s).alias("w_speech"))
    visual = strip(F.coalesce("text", F.lit(""))) == ""
    return queries.select(
        "query_id", F.when(visual, 0.85).otherwise(F.col("intent.w_dense")).alias("w_dense"),
        F.when(visual, 0.15).otherwise(F.col("intent.w_speech")).alias("w_speech"),
    )

