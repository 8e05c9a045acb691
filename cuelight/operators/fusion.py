"""Score fusion, gates, reranking, keywords and feedback bonuses over hit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.functions import numeric as N
from cuelight.functions.text import strip
from cuelight.operators.ordered import top_k


def segment_key() -> list[Column]:
    """Segments are the same when video and bounds agree to a hundredth of a second."""
    cents = lambda c: F.floor(F.col(c) * 100.0 + 0.5).cast("bigint")
    return [F.col("query_id"), F.col("video_id"), cents("start_sec").alias("start_cs"), cents("end_sec").alias("end_cs")]


def _dedup(hits: DataFrame, score: str, prefix: str) -> DataFrame:
    """One hit per key: the later (lower) one overwrites."""
    keyed = hits.select(*segment_key(), "rank", F.struct(F.col(score).alias("score"), "start_sec", "end_sec", "text").alias("_h"))
    return keyed.groupBy("query_id", "video_id", "start_cs", "end_cs").agg(F.max_by("_h", "rank").alias(prefix))


def fuse_lists(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Full outer union of two ranked hit lists on the segment key; a missing score is 0.

    Both lists: query_id, rank, video_id, start_sec, end_sec, text, score (already calibrated).
    """
    keys = ["query_id", "video_id", "start_cs", "end_cs"]
    both = _dedup(lexical, "score", "_l").join(_dedup(semantic, "score", "_s"), keys, "full_outer")
    pick = lambda f: F.coalesce(F.col(f"_l.{f}"), F.col(f"_s.{f}")).alias(f)
    return both.select(
        *keys, pick("start_sec"), pick("end_sec"), pick("text"),
        F.coalesce("_l.score", F.lit(0.0)).alias("bm25"), F.coalesce("_s.score", F.lit(0.0)).alias("semantic"),
        F.col("_l").isNotNull().alias("in_lexical"), F.col("_s").isNotNull().alias("in_semantic"),
    )


def calibrate_max(hits: DataFrame, score: str = "score") -> DataFrame:
    """Score over the best score of the query. Hit lists are short, so the window is bounded."""
    w = Window.partitionBy("query_id")
    return hits.withColumn(score, N.maxnorm(score, F.max(score).over(w)))


def calibrate_minmax(hits: DataFrame, score: str = "score") -> DataFrame:
    w = Window.partitionBy("query_id")
    return hits.withColumn(score, N.minmax(score, F.min(score).over(w), F.max(score).over(w)))


def weighted_norm(
    lexical: DataFrame, semantic: DataFrame, w_lex: float = 0.5, w_sem: float = 0.5, k: int = 200,
    queries: DataFrame | None = None, scorer=None, head: int = 30,
) -> DataFrame:
    """Fused hits; with a ``scorer`` (see :func:`rerank`) and ``queries`` (query_id, query) the first ``head`` are rescored."""
    fused = fuse_lists(calibrate_max(lexical), calibrate_minmax(semantic)).withColumn(
        "fused", N.on_grid(F.col("bm25") * w_lex + F.col("semantic") * w_sem)
    )
    return _ranked(fused, k, queries, scorer, head)


def reciprocal_rank(
    lexical: DataFrame, semantic: DataFrame, w_lex: float = 0.5, w_sem: float = 0.5, k: int = 200,
    rrf_k: float = 60.0, absent: int = 1000, queries: DataFrame | None = None, scorer=None, head: int = 30,
) -> DataFrame:
    """Hits by their ranks in both lists; ``queries``, ``scorer`` and ``head`` as in :func:`weighted_norm`."""
    fused = fuse_lists(calibrate_max(lexical), calibrate_minmax(semantic))
    order = lambda s: [F.desc(s), F.asc("video_id"), F.asc("start_cs"), F.asc("end_cs")]

    def list_rank(member, score):
        w = Window.partitionBy("query_id", member).orderBy(*order(score))
        return F.when(F.col(member), F.row_number().over(w)).otherwise(F.lit(absent))

    ranked = fused.withColumn("rank_lex", list_rank("in_lexical", "bm25")).withColumn(
        "rank_sem", list_rank("in_semantic", "semantic")
    )
    score = F.lit(w_lex) / (F.lit(rrf_k) + F.col("rank_lex")) + F.lit(w_sem) / (F.lit(rrf_k) + F.col("rank_sem"))
    return _ranked(ranked.withColumn("fused", N.on_grid(score)), k, queries, scorer, head)


def _ranked(fused: DataFrame, k: int, queries: DataFrame | None = None, scorer=None, head: int = 30) -> DataFrame:
    """The first ``k`` hits. Only the head is scored anew; it is ordered by its new scores and the tail follows as it was."""
    order = [F.desc("fused"), F.asc("video_id"), F.asc("start_cs"), F.asc("end_cs")]
    if scorer is None:
        return top_k(fused, ["query_id"], order, k)
    ranked = top_k(fused, ["query_id"], order, max(k, head))
    first = ranked.filter(F.col("rank") <= head).withColumnRenamed("fused", "dense").join(queries.select("query_id", "query"), "query_id")
    rescored = rerank(first, scorer, head, "start_cs").withColumnRenamed("rerank_score", "fused").select(*ranked.columns)
    return rescored.unionByName(ranked.filter(F.col("rank") > head)).filter(F.col("rank") <= k)


def rerank(candidates: DataFrame, scorer, k: int, tie: str = "segment_id") -> DataFrame:
    """Candidates rescored by ``scorer(query, text)`` (a column function or a pandas UDF).

    A null score means that the scorer failed for the row; when it failed for a
    whole query its candidates keep their dense order and score.
    """
    q, t = strip("query"), strip("text")
    scored = candidates.withColumn("_r", scorer(q, t).cast("double"))
    w = Window.partitionBy("query_id")
    failed = F.max(F.col("_r").isNull().cast("int")).over(w) == 1
    with_score = scored.withColumn("rerank_score", F.when(failed, F.col("dense")).otherwise(F.col("_r"))).drop("_r")
    return top_k(
        with_score.withColumnRenamed("rank", "dense_rank"), ["query_id"],
        [F.desc("rerank_score"), F.asc("dense_rank"), F.asc(tie)], k,
    )


def rerank_head(ranked: DataFrame, new_score: Column, n: int = 30) -> DataFrame:
    """Only the first ``n`` rows are reordered by the new score; the tail follows as it was."""
    head = F.col("rank") <= n
    w = Window.partitionBy("query_id").orderBy(
        F.desc(head), F.desc(F.when(head, new_score)), F.asc("rank")
    )
    return ranked.withColumn("new_rank", F.row_number().over(w))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the distinct query tokens that the text has: a scorer without a model."""
    from cuelight.functions.text import tokenize

    q = F.array_distinct(tokenize(query))
    return F.size(F.array_intersect(q, tokenize(text))) / F.greatest(F.lit(1), F.size(q))


def gate(category, max_speech) -> Column:
    """Weights and label of a balanced query by the strength of its speech evidence."""
    strong = F.col(max_speech) >= 0.50
    named = lambda d, s, label: F.struct(
        F.lit(d).alias("w_dense"), F.lit(s).alias("w_speech"), label.alias("label"))
    balanced = F.col(category) == "balanced_multimodal"
    return F.when(
        balanced & strong, named(0.30, 0.70, F.lit("Strong Speech Match"))
    ).when(balanced, named(0.70, 0.30, F.lit("Balanced Multimodal")))


def binary_gate(max_speech, threshold: Column) -> Column:
    open_ = F.col(max_speech) >= threshold
    return F.struct(
        F.when(open_, 0.70).otherwise(1.0).alias("w_dense"), F.when(open_, 0.30).otherwise(0.0).alias("w_speech")
    )


def adaptive(category, max_speech) -> Column:
    """Benchmark routing: text and speech intents by their weights, the rest by evidence."""
    pair = lambda d, s: F.struct(F.lit(d).alias("w_dense"), F.lit(s).alias("w_speech"))
    return (
        F.when(F.col(category) == "visual_entity_text_grounded", pair(0.25, 0.75))
        .when(F.col(category) == "speech_dialogue_grounded", pair(0.20, 0.80))
        .when(F.col(max_speech) >= 0.50, pair(0.30, 0.70))
        .otherwise(pair(0.70, 0.30))
    )


def exact_keyword_scores(keywords: DataFrame, docs: DataFrame, keyframes: DataFrame, window: float = 3.0, gain: float = 1.5) -> DataFrame:
    """Keyframes near a document that contains the keyword score ``gain`` x weight, summed over keywords.

    keywords: query_id, kw_no, keyword, weight.
    """
    from cuelight.operators.intervals import point_in_interval
    from cuelight.operators.lexical import phrase_hits

    usable = keywords.filter((strip("keyword") != "") & (F.col("weight") > 0))
    hits = phrase_hits(usable, docs)
    return (
        point_in_interval(hits, keyframes.select("video_id", "kf_id", "pts_time"), window)
        .groupBy("query_id", "kw_no", "kf_id").agg(F.max(F.col("weight") * gain).alias("_s"))
        .groupBy("query_id", "kf_id").agg(F.sum("_s").alias("keyword_score"))
    )


def pooled_scenes(scene_scores: DataFrame, whole: DataFrame) -> DataFrame:
    """Per (query, keyframe): 0.35 x whole + 0.65 x (0.70 max + 0.30 mean of the two best scenes).

    scene_scores: query_id, scene_no, kf_id, norm; whole: query_id, kf_id, norm.
    """
    best2 = F.slice(F.sort_array(F.collect_list("norm"), asc=False), 1, 2)
    pooled = scene_scores.groupBy("query_id", "kf_id").agg(
        best2.alias("_b"), F.max(F.struct("norm", (-F.col("scene_no")).alias("neg"))).alias("_m")
    )
    pool = F.col("_b")[0] * 0.70 + (F.col("_b")[0] + F.col("_b")[1]) / 2.0 * 0.30
    return pooled.filter(F.size("_b") == 2).join(
        whole.select("query_id", "kf_id", F.col("norm").alias("_w")), ["query_id", "kf_id"]
    ).select(
        "query_id", "kf_id", (F.col("_w") * 0.35 + pool * 0.65).alias("norm"), (-F.col("_m.neg")).alias("best_scene")
    )


def proximity_bonus(marks: DataFrame, keyframes: DataFrame, reach: float = 45.0) -> DataFrame:
    """Bonus per (query, keyframe) of a marked video: up to 0.25 near a mark, 0.08 elsewhere in it."""
    d = F.abs(F.col("pts_time") - F.col("_p"))
    bonus = F.when(d <= reach, F.lit(0.25) * (F.lit(1.0) - d / F.lit(reach))).otherwise(F.lit(0.08))
    m = marks.select("query_id", "video_id", F.col("pts_time").alias("_p"))
    return (
        keyframes.select("video_id", "kf_id", "pts_time").join(m, "video_id")
        .groupBy("query_id", "kf_id").agg(F.max(bonus).alias("bonus"))
    )


def pinned_first(results: DataFrame, pinned: DataFrame, k: int) -> DataFrame:
    """Pinned rows on top with score 1, other rows after them without repeats, cut to ``k``.

    results: query_id, rank, video_id, frame_idx, score; pinned: query_id, pin_no, video_id, frame_idx.
    """
    frame = ["query_id", "video_id", "frame_idx"]
    rest = results.join(pinned.select(*frame), frame, "left_anti").select(
        *frame, "score", F.lit(1).alias("_tier"), F.col("rank").cast("bigint").alias("_no")
    )
    top = pinned.select(*frame, F.lit(1.0).alias("score"), F.lit(0).alias("_tier"), F.col("pin_no").cast("bigint").alias("_no"))
    both = top.unionByName(rest)
    return top_k(both, ["query_id"], [F.asc("_tier"), F.asc("_no")], k).drop("_no").withColumn(
        "is_pinned", F.col("_tier") == 0
    ).drop("_tier")


def shot_buckets(ranked: DataFrame, k: int, width: float = 2.5) -> DataFrame:
    """One row per (video, time bucket) by score, then the best of the rest up to ``k``.

    ranked: query_id, kf_id, video_id, pts_time, score.
    """
    w = Window.partitionBy("query_id", "video_id", F.floor(F.col("pts_time") / width)).orderBy(F.desc("score"), F.asc("kf_id"))
    seen = ranked.withColumn("_again", (F.row_number().over(w) > 1).cast("int"))
    return top_k(seen, ["query_id"], [F.asc("_again"), F.desc("score"), F.asc("kf_id")], k).drop("_again")


def semantic_keyword_scores(
    keywords: DataFrame, docs: DataFrame, keyframes: DataFrame, w_dense: float, w_speech: float, window: float = 3.0, k: int = 200,
) -> DataFrame:
    """Every keyframe's weighted keyword score: calibrated cosine plus BM25 of documents near it.

    keywords: query_id, kw_no, keyword, weight, embedding. The output has a row
    per query and keyframe, as the score itself is defined for all of them.
    """
    from cuelight.operators import dense as D
    from cuelight.operators import lexical as L
    from cuelight.operators.intervals import best_per_point, point_in_interval

    usable = keywords.filter((strip("keyword") != "") & (F.col("weight") > 0))
    keyed = usable.withColumn("_k", F.to_json(F.struct("query_id", "kw_no")))
    vectors = keyed.select(F.col("_k").alias("query_id"), "embedding")
    dense = D.all_scores(vectors, keyframes).join(D.ranges(vectors, keyframes), "query_id").select(
        "query_id", "kf_id", N.minmax("dense", "lo", "hi").alias("_d"))
    hits = L.bm25(keyed.select(F.col("_k").alias("query_id"), F.col("keyword").alias("text")), docs, k).join(docs, "doc_id")
    near = point_in_interval(
        calibrate_max(hits).withColumnRenamed("rank", "hit_rank").drop("doc_id", "source"),
        keyframes.select("video_id", "kf_id", "pts_time"), window)
    speech = best_per_point(near, ["query_id", "kf_id"]).select("query_id", "kf_id", F.col("score").alias("_a"))
    fused = F.col("_d") * w_dense + F.coalesce("_a", F.lit(0.0)) * w_speech
    rows = dense.join(speech, ["query_id", "kf_id"], "left").withColumnRenamed("query_id", "_k")
    return (
        rows.join(keyed.select("_k", "query_id", "weight"), "_k")
        .groupBy("query_id", "kf_id").agg(F.sum(F.col("weight") * fused).alias("keyword_score"))
    )
