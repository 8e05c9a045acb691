"""Configuration sweep: evidence once per query, every configuration on top of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.functions import lexicon as lx
from cuelight.functions import numeric as N
from cuelight.operators import evaluation as E
from cuelight.operators import fusion as X
from cuelight.operators import intervals as I
from cuelight.operators import sequence as S
from cuelight.operators.ordered import top_k
from cuelight.plans import search as P
from cuelight.session import reliable

POOL, TOP = 200, 50


def evidence(queries: DataFrame, corpus: P.Corpus, scenes: DataFrame | None = None, scorer=None, window: float = 5.0):
    """(candidates, max speech per query) for all configurations."""
    queries = P.with_intent(queries)
    speech = P.lexical_evidence(queries, corpus, window, calibration="plain")
    if corpus.semantic:
        speech = P.merge_evidence(speech, P.semantic_evidence(queries, corpus, window, scorer))
    speech = reliable(speech)
    packed = P.pack_queries(queries, scenes, corpus.keyframes)
    return reliable(P.candidates(packed, corpus, speech, POOL)), P.max_speech(queries, speech)


def configured(best_speech: DataFrame, configs=lx.BENCHMARK_CONFIGS) -> DataFrame:
    """query_id, config, w_dense, w_speech: fixed weights, or a gate on the speech evidence."""
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("config"), F.lit(d).cast("double").alias("d"), F.lit(s).cast("double").alias("s"),
            F.lit(t).cast("double").alias("t"),
        ) for name, d, s, t in configs
    ])
    each = best_speech.withColumn("_c", F.explode(rows))
    gate = X.binary_gate("max_speech", F.col("_c.t"))
    return each.select(
        "query_id", "_c.config", F.coalesce("_c.d", gate["w_dense"]).alias("w_dense"),
        F.coalesce("_c.s", gate["w_speech"]).alias("w_speech"),
    )


def ranked(cand: DataFrame, routed: DataFrame, keyframes: DataFrame) -> DataFrame:
    """query_id, config, rank, video_id, kf_id, pts_time, frame_idx, score after suppression."""
    fused = cand.join(routed, "query_id").withColumn(
        "fused", N.on_grid(F.col("w_dense") * F.col("norm") + F.col("w_speech") * F.col("speech")))
    pool = top_k(fused, ["query_id", "config"], P.pool_order(), POOL).join(
        keyframes.select("kf_id", "video_id", "pts_time", "frame_idx"), "kf_id")
    return S.suppress(pool, TOP, 1.5, by=("query_id", "config")).withColumnRenamed("fused", "score")


def per_query(queries: DataFrame, results: DataFrame, truth: DataFrame, configs=lx.BENCHMARK_CONFIGS) -> DataFrame:
    """Metrics of each (query, configuration); queries: query_id, category."""
    hits = I.judged_hits(results, truth)
    grid = queries.withColumn("config", F.explode(F.array(*[F.lit(c[0]) for c in configs])))
    return E.first_hits(hits, grid, ("query_id", "config"))


def sweep(queries: DataFrame, corpus: P.Corpus, truth: DataFrame, scenes: DataFrame | None = None, scorer=None) -> DataFrame:
    """Overall and per-category metrics of every configuration."""
    cand, best = evidence(queries, corpus, scenes, scorer)
    results = ranked(cand, configured(best), corpus.keyframes)
    return E.rollup_by_category(per_query(queries.select("query_id", "category"), results, truth))
