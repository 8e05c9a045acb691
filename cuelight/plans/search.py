"""Batch search: every stage works on all queries at once.

The dense side is never a queries x keyframes table: keyframes are scored in
blocks with the evidence that falls on them, and only a pool per query leaves a
block. Equal fused scores are ordered by dense score, then by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.functions import numeric as N
from cuelight.functions import text as T
from cuelight.functions.text import strip
from cuelight.operators import blockmax as BM
from cuelight.operators import dense as D
from cuelight.operators import fusion as X
from cuelight.operators import intervals as I
from cuelight.operators import lexical as L
from cuelight.operators import sequence as S
from cuelight.session import reliable


@dataclass
class Corpus:
    """Prepared tables.

    keyframes: kf_id, video_id, n, pts_time, fps, frame_idx, embedding
    docs: doc_id, video_id, start_sec, end_sec, text, source ('asr' or 'ocr')
    segments: video_id, segment_id, position, start_sec, end_sec, start_frame,
    end_frame, text, and embedding when semantic search is wanted
    index: the index of ``docs`` when it is stored, in blocks or plain
    """

    keyframes: DataFrame
    docs: DataFrame
    segments: DataFrame
    semantic: bool = False
    index: BM.BlockIndex | L.Index | None = None


def with_intent(queries: DataFrame) -> DataFrame:
    return queries.withColumn("intent", T.intent("text"))


def lexical_evidence(queries: DataFrame, corpus: Corpus, window: float, k: int = 300, calibration: str = "ocr") -> DataFrame:
    """query_id, kf_id, score, text from BM25 hits. calibration: 'ocr' (boosts screen text), 'plain' or 'max'."""
    if isinstance(corpus.index, BM.BlockIndex):
        hits = BM.search(queries, corpus.index, k)
    else:
        hits = L.search_index(queries, corpus.index, k) if corpus.index else L.bm25(queries, corpus.docs, k)
    hits = hits.join(corpus.docs, "doc_id")
    if calibration == "ocr":
        hits = hits.join(queries.select("query_id", F.col("intent.w_ocr").alias("_w")), "query_id")
        hits = hits.withColumn("score", N.saturate("score", "source", "_w"))
    elif calibration == "plain":
        hits = hits.withColumn("score", N.saturate("score"))
    else:
        hits = X.calibrate_max(hits)
    pairs = I.point_in_interval(
        hits.select("query_id", "video_id", "start_sec", "end_sec", "text", "score", F.col("rank").alias("hit_rank")),
        corpus.keyframes.select("video_id", "kf_id", "pts_time"), window,
    )
    return I.best_per_point(pairs, ["query_id", "kf_id"])


def semantic_hits(queries: DataFrame, corpus: Corpus, k: int = 300) -> DataFrame:
    """query_id, rank, segment columns, dense: nearest segments by text vector."""
    keyed = corpus.segments.withColumn("_key", F.struct("video_id", "segment_id").cast("string"))
    by_text = queries.select("query_id", F.col("text_vector").alias("embedding"))
    hits = D.topk(by_text, keyed, k, "_key").select("query_id", "_key", "dense", "rank")
    return hits.join(keyed.drop("embedding"), "_key").drop("_key")


def semantic_evidence(queries: DataFrame, corpus: Corpus, window: float, scorer=None, k: int = 300) -> DataFrame:
    """query_id, kf_id, score, text from semantic hits, reranked and expanded when there is a scorer."""
    hits = semantic_hits(queries, corpus, k)
    if scorer is None:
        windows = hits.select(
            "query_id", "video_id", "start_sec", "end_sec", "text", N.linear_clip("dense").alias("score"),
            F.col("rank").alias("hit_rank"),
        )
    else:
        texts = queries.select("query_id", F.col("text").alias("query"))
        reranked = X.rerank(hits.filter("rank <= 30").join(texts, "query_id"), scorer, 30)
        wide = S.expand_and_dedup(
            reranked.select("query_id", "rank", "video_id", "segment_id", "start_sec", "end_sec", "rerank_score"),
            corpus.segments.drop("embedding"), max_windows=15,
        )
        windows = wide.select(
            "query_id", "video_id", F.col("win_start").alias("start_sec"), F.col("win_end").alias("end_sec"),
            F.col("context").alias("text"), N.clip("rerank_score").alias("score"), F.col("rank").alias("hit_rank"),
        )
    pairs = I.point_in_interval(windows, corpus.keyframes.select("video_id", "kf_id", "pts_time"), window)
    return I.best_per_point(pairs, ["query_id", "kf_id"])


def merge_evidence(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Larger score; lexical text is kept, semantic text fills gaps only."""
    a = lexical.select("query_id", "kf_id", F.col("score").alias("_a"), F.col("text").alias("_ta"))
    b = semantic.select("query_id", "kf_id", F.col("score").alias("_b"), F.col("text").alias("_tb"))
    return a.join(b, ["query_id", "kf_id"], "full_outer").select(
        "query_id", "kf_id", F.greatest("_a", "_b").alias("score"), F.coalesce("_ta", "_tb").alias("text")
    )


def usable_keywords(keywords: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, kw_no, keyword, weight, exact, embedding of the keywords that count: not blank, of positive weight, of one of ``queries``.

    Without a column ``exact`` all are exact phrases; where it is null the keyword is semantic.
    """
    exact = F.coalesce("exact", F.lit(False)) if "exact" in keywords.columns else F.lit(True)
    vector = N.as_doubles("embedding") if "embedding" in keywords.columns else F.lit(None).cast("array<double>")
    return (
        keywords.filter((strip("keyword") != "") & (F.col("weight") > 0)).join(queries.select("query_id"), "query_id", "left_semi")
        .select("query_id", "kw_no", "keyword", F.col("weight").cast("double").alias("weight"), exact.alias("exact"), vector.alias("embedding"))
    )


def phrase_keywords(keywords: DataFrame) -> DataFrame:
    """query_id, kw_no, weight, _phrase of the exact keywords."""
    return keywords.filter("exact").select("query_id", "kw_no", "weight", F.lower(strip("keyword")).alias("_phrase"))


def keyword_scores(keywords: DataFrame, corpus: Corpus, window: float = 3.0, k: int = 200, gain: float = 1.5) -> DataFrame:
    """query_id, kf_id, kw_speech, kw_no, exact: what keywords add to keyframes near documents, numbers only.

    An exact phrase adds ``gain`` x weight near the documents that contain it. A phrase may be a common word of many queries, so its
    keyframes are found once, without texts, and then dealt to its queries. A semantic keyword adds its weight times the BM25 score
    of a document over that of its best one; its dense part is added in the scan of the vectors.
    """
    points = corpus.keyframes.select("video_id", "kf_id", "pts_time")
    asked = phrase_keywords(keywords)
    spans = L.phrases_in(asked.select("_phrase"), corpus.docs).select("_phrase", "video_id", "start_sec", "end_sec")
    near = I.point_in_interval(spans, points, window).select("_phrase", "kf_id").distinct()
    exact = near.join(asked, "_phrase").select("query_id", "kf_id", F.lit(0.0).alias("kw_speech"), "kw_no", (F.col("weight") * gain).alias("exact"))
    keyed = keywords.filter("not exact").withColumn("_k", F.to_json(F.struct("query_id", "kw_no")))
    terms = keyed.select(F.col("_k").alias("query_id"), F.col("keyword").alias("text"))
    hits = X.calibrate_max(L.bm25(terms, corpus.docs, k).join(corpus.docs, "doc_id")).select(
        "query_id", "video_id", "start_sec", "end_sec", F.lit("").alias("text"), "score", F.col("rank").alias("hit_rank"))
    spoken = I.best_per_point(I.point_in_interval(hits, points, window), ["query_id", "kf_id"]).withColumnRenamed("query_id", "_k")
    return exact.unionByName(spoken.join(keyed.select("_k", "query_id", "weight"), "_k").groupBy("query_id", "kf_id").agg(
        F.sum(F.col("weight") * F.col("score")).alias("kw_speech")).withColumn("kw_no", F.lit(0)).withColumn("exact", F.lit(0.0)))


def phrase_texts(rows: DataFrame, keywords: DataFrame, docs: DataFrame, window: float = 3.0) -> DataFrame:
    """query_id, kf_id, exact_text: the last document near a row that contains the last of its query's phrases there.

    rows: query_id, kf_id, video_id, pts_time.
    """
    asked = rows.select("query_id", "kf_id", "video_id", "pts_time").join(phrase_keywords(keywords), "query_id")
    near = I.point_in_interval(docs.select("doc_id", "video_id", "start_sec", "end_sec", "text"), asked, window)
    last = F.max(F.struct("kw_no", "doc_id", "text")).alias("_t")
    return near.filter(F.contains(F.lower("text"), F.col("_phrase"))).groupBy("query_id", "kf_id").agg(last).select(
        "query_id", "kf_id", F.concat(F.lit('🔤 [EXACT] "'), "_t.text", F.lit('"')).alias("exact_text"))


def keyword_evidence(keywords: DataFrame, corpus: Corpus, window: float = 3.0, k: int = 200, gain: float = 1.5) -> DataFrame:
    """query_id, kf_id, exact, kw_speech, exact_text of every keyframe that a keyword reaches: ``keyword_scores`` with texts."""
    scores = reliable(keyword_scores(keywords, corpus, window, k, gain))
    each = scores.groupBy("query_id", "kf_id", "kw_no").agg(F.max("exact").alias("exact"), F.sum("kw_speech").alias("kw_speech"))
    summed = each.groupBy("query_id", "kf_id").agg(F.sum("exact").alias("exact"), F.sum("kw_speech").alias("kw_speech"))
    reached = summed.filter("exact > 0").join(corpus.keyframes.select("kf_id", "video_id", "pts_time"), "kf_id")
    return summed.join(phrase_texts(reached, keywords, corpus.docs, window), ["query_id", "kf_id"], "left")


def all_evidence(speech: DataFrame, extra: DataFrame | None = None, kept: DataFrame | None = None) -> DataFrame:
    """Evidence as :func:`cuelight.operators.dense.fused_topk` takes it: speech, ``keyword_scores`` and rows to be kept."""

    def part(df: DataFrame, **has) -> DataFrame:
        none = {"speech": F.lit(0.0), "kw_speech": F.lit(0.0), "kw_no": F.lit(0), "exact": F.lit(0.0), "kept": F.lit(0.0)} | has
        return df.select("query_id", "kf_id", *[c.cast("double").alias(n) for n, c in none.items()])

    rows = part(speech, speech=F.col("score"))
    if extra is not None:
        rows = rows.unionByName(part(extra, **{c: F.col(c) for c in ("kw_speech", "kw_no", "exact")}))
    if kept is not None:
        rows = rows.unionByName(part(kept.select("query_id", "kf_id").distinct(), kept=F.lit(1.0)))
    return rows


def with_texts(rows: DataFrame, speech: DataFrame, keywords: DataFrame | None, docs: DataFrame) -> DataFrame:
    """Adds speech_text and exact_text to result rows."""
    said = speech.select("query_id", "kf_id", F.col("text").alias("speech_text"))
    rows = rows.join(said, ["query_id", "kf_id"], "left")
    if keywords is None:
        return rows.withColumn("exact_text", F.lit(None).cast("string"))
    return rows.join(phrase_texts(rows.filter("exact > 0"), keywords, docs), ["query_id", "kf_id"], "left")


def pack_queries(queries: DataFrame, scenes: DataFrame | None, keyframes: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """query_id, whole, scenes, keywords: vectors with their score ranges over all keyframes (one scan).

    keywords: as of ``usable_keywords``; a semantic keyword without a vector has no dense part.
    """

    def part(df: DataFrame, kind: int, no: Column, weight: Column) -> DataFrame:
        numbered = F.struct("query_id", F.lit(kind).alias("kind"), no.cast("int").alias("no"))
        return df.select(numbered.alias("_k"), N.as_doubles("embedding").alias("embedding"), weight.alias("weight"))

    parts = part(queries, 0, F.lit(0), F.lit(1.0))
    if scenes is not None:
        parts = parts.unionByName(part(scenes.join(queries.select("query_id"), "query_id", "left_semi"), 1, F.col("scene_no"), F.lit(1.0)))
    if keywords is not None:
        parts = parts.unionByName(part(keywords.filter("not exact and embedding is not null"), 2, F.col("kw_no"), F.col("weight")))
    vectors = parts.withColumn("query_id", F.to_json("_k"))
    spans = D.ranges(vectors, keyframes)
    packed = vectors.join(spans, "query_id").select(
        "_k.query_id", "_k.kind", F.struct("_k.no", F.struct(F.col("embedding").alias("v"), "lo", "hi", "weight").alias("s")).alias("_s")
    )

    def gathered(kind: int) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("_s")))), lambda x: x["s"])

    return reliable(packed.groupBy("query_id").agg(
        F.max_by("_s.s", -F.col("kind")).alias("whole"), gathered(1).alias("scenes"), gathered(2).alias("keywords")
    ))


def candidates(packed: DataFrame, corpus: Corpus, speech: DataFrame, pool: int) -> DataFrame:
    """query_id, kf_id, norm, kw, dense, best_scene, speech, speech_text for all rows that can enter a pool."""
    best = reliable(D.pooled_topk(packed, corpus.keyframes, pool))
    pairs = speech.select("query_id", "kf_id")
    rest = pairs.join(best.select("query_id", "kf_id"), ["query_id", "kf_id"], "left_anti")
    scored = best.unionByName(D.pooled_pairs(rest, packed, corpus.keyframes))
    return with_speech(scored, speech)


def with_speech(rows: DataFrame, speech: DataFrame) -> DataFrame:
    return rows.join(
        speech.select("query_id", "kf_id", F.col("score").alias("speech"), F.col("text").alias("speech_text")),
        ["query_id", "kf_id"], "left",
    ).withColumn("speech", F.coalesce("speech", F.lit(0.0)))


def pool_order() -> list[Column]:
    return [F.desc("fused"), F.desc("dense"), F.asc("kf_id")]


def max_speech(queries: DataFrame, speech: DataFrame) -> DataFrame:
    best = speech.groupBy("query_id").agg(F.max("score").alias("max_speech"))
    return queries.select("query_id").join(best, "query_id", "left").na.fill(0.0, ["max_speech"])


def search(
    queries: DataFrame, corpus: Corpus, scenes: DataFrame | None = None, keywords: DataFrame | None = None,
    scorer=None, weights: tuple[float, float] | None = None, top: int = 100, window: float = 5.0,
) -> DataFrame:
    """Ranked keyframes for every query.

    queries: query_id, text, embedding (and text_vector for semantic search);
    scenes: query_id, scene_no, scene, embedding of queries with several scenes;
    keywords: query_id, kw_no, keyword, weight, exact, embedding (of those that
    are not exact phrases). Without ``weights`` (dense, speech; clamped to 0..1)
    the intent of a query and its speech evidence choose them. A blank query has
    no results.

    Keywords are more lists to one sum: speech parts and phrases meet their
    keyframes block by block in the scan of the vectors, where the dense parts are
    added. Texts are joined to the result rows alone.
    """
    top = max(1, min(1000, top))
    window = max(0.5, min(30.0, window))
    queries = with_intent(queries.filter(strip(F.coalesce("text", F.lit(""))) != ""))
    if weights is not None:  # chosen weights leave no boost to screen text
        queries = queries.withColumn("intent", F.col("intent").withField("w_ocr", F.lit(0.0)))
    speech = lexical_evidence(queries, corpus, window)
    if corpus.semantic:
        speech = merge_evidence(speech, semantic_evidence(queries, corpus, window, scorer))
    # the evidence is a bounded hit list per query; cut here, its many readers do not repeat the search
    speech = reliable(speech)
    if keywords is not None:
        keywords = reliable(usable_keywords(keywords, queries))
    packed = pack_queries(queries, scenes, corpus.keyframes, keywords)
    extra = keyword_scores(keywords, corpus) if keywords is not None else None
    routed = reliable(route(queries, speech, weights))
    best = D.fused_topk(
        packed.join(routed.select("query_id", "w_dense", "w_speech"), "query_id"), corpus.keyframes, all_evidence(speech, extra), 4 * top,
        by_lead=keywords is not None)
    pool = best.join(routed.select("query_id", "label"), "query_id").join(
        corpus.keyframes.select("kf_id", "video_id", "pts_time", "fps", "frame_idx"), "kf_id"
    )
    rows = reliable(with_texts(reliable(S.suppress(pool, top, 1.5)), speech, keywords, corpus.docs))
    spoken = I.active_segment(rows, corpus.segments, ["query_id", "kf_id"])
    out = spoken.withColumn("matched_speech", F.coalesce("exact_text", "speech_text", "spoken"))
    if scenes is not None:
        named = scenes.select("query_id", F.col("scene_no").cast("int").alias("best_scene"), "scene")
        out = out.join(named, ["query_id", "best_scene"], "left").withColumn("matched_scene", F.coalesce("scene", F.lit("")))
    else:
        out = out.withColumn("matched_scene", F.lit(""))
    return out.select(
        "query_id", "rank", "video_id", "kf_id", "frame_idx", "fps", "pts_time", F.col("dense").alias("raw_dense"),
        F.col("norm").alias("norm_dense"), "speech", F.col("fused").alias("score"), "matched_speech", "matched_scene", "label",
    )


def route(queries: DataFrame, speech: DataFrame, weights: tuple[float, float] | None) -> DataFrame:
    """query_id, w_dense, w_speech, label."""
    if weights is not None:
        d, s = (max(0.0, min(1.0, float(w))) for w in weights)
        return queries.select("query_id", F.lit(d).alias("w_dense"), F.lit(s).alias("w_speech"), F.lit("Manual Mode").alias("label"))
    with_max = queries.select("query_id", "intent").join(max_speech(queries, speech), "query_id").withColumn("category", F.col("intent.category"))
    fixed = F.struct("intent.w_dense", "intent.w_speech", "intent.label")
    return with_max.withColumn("_g", F.coalesce(X.gate("category", "max_speech"), fixed)).select("query_id", "_g.*")

