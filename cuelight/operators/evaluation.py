"""Evaluation against relevance judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.functions.text import strip

CUTOFFS = (1, 5, 20, 50, 100)


def _at_cutoffs(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """R@k as the best score among the first k predictions, and the mean of the five."""
    cols = [
        F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("r"))), F.lit(0.0)).alias(f"r_at_{k}") for k in CUTOFFS
    ]
    found = scored.filter(F.col("rank") <= 100).groupBy("query_id").agg(*cols)
    all_queries = truth.select("query_id").distinct().join(found, "query_id", "left").na.fill(
        0.0, [f"r_at_{k}" for k in CUTOFFS]
    )
    final = sum((F.col(f"r_at_{k}") for k in CUTOFFS), F.lit(0.0)) / len(CUTOFFS)
    return all_queries.withColumn("final_score", final)


def kis(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """runs: query_id, rank, video_id, frame_idx; truth: query_id, video_id, intervals array<struct<s,e>>."""
    t = truth.select("query_id", F.col("video_id").alias("_v"), "intervals")
    hit = (F.col("video_id") == F.col("_v")) & F.exists(
        "intervals", lambda i: F.col("frame_idx").between(i["s"], i["e"])
    )
    scored = runs.join(t, "query_id").withColumn("r", F.when(hit, 1.0).otherwise(0.0))
    return _at_cutoffs(scored, truth)


def sequences(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the events inside their intervals. runs: query_id, rank, video_id, frames array<bigint>."""
    t = truth.select("query_id", F.col("video_id").alias("_v"), "intervals")
    n = F.size("intervals")
    inside = F.zip_with(
        "frames", "intervals", lambda f, i: F.when(f.between(i["s"], i["e"]), 1.0).otherwise(0.0)
    )
    share = F.aggregate(inside, F.lit(0.0), lambda a, x: a + x) / n
    fits = (F.col("video_id") == F.col("_v")) & (F.size("frames") == n) & (n > 0)
    scored = runs.join(t, "query_id").withColumn("r", F.when(fits, share).otherwise(0.0))
    return _at_cutoffs(scored, truth)


def answers(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """Frame in the interval and the normalised answer among the accepted ones."""
    t = truth.select("query_id", F.col("video_id").alias("_v"), "s", "e", F.col("answers").alias("_a"))
    accepted = F.transform("_a", lambda a: F.lower(strip(a)))
    hit = (
        (F.col("video_id") == F.col("_v")) & F.col("frame_idx").between(F.col("s"), F.col("e"))
        & F.array_contains(accepted, F.lower(strip(F.coalesce("answer", F.lit("")))))
    )
    scored = runs.join(t, "query_id").withColumn("r", F.when(hit, 1.0).otherwise(0.0))
    return _at_cutoffs(scored, truth)


def mean_of(parts: list[DataFrame]) -> DataFrame:
    """Mean over all queries of several task types."""
    cols = [f"r_at_{k}" for k in CUTOFFS] + ["final_score"]
    whole = parts[0].select(*cols)
    for p in parts[1:]:
        whole = whole.unionByName(p.select(*cols))
    return whole.agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n_queries"))


def first_hits(hits: DataFrame, queries: DataFrame, keys=("query_id",)) -> DataFrame:
    """First hit rank per key and the metrics that follow from it; queries without a hit score 0.

    hits: keys, rank (rows that match a judgement).
    """
    first = hits.groupBy(*keys).agg(F.min("rank").cast("bigint").alias("first_hit"))
    r = F.col("first_hit")
    out = queries.join(first, list(keys), "left")
    for k in (1, 5, 10, 25, 50):
        out = out.withColumn(f"r{k}", F.when(r <= k, 1.0).otherwise(0.0))
    return out.withColumn("mrr", F.coalesce(F.lit(1.0) / r, F.lit(0.0))).withColumn(
        "ndcg5", F.when(r <= 5, F.lit(1.0) / F.log2(r + 1)).otherwise(0.0)
    )


METRICS = ("r1", "r5", "r10", "r25", "r50", "mrr", "ndcg5")


def means(per_query: DataFrame, by=("config",), metrics=METRICS) -> DataFrame:
    return per_query.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n_queries"))


def rollup_by_category(per_query: DataFrame, metrics=("r1", "r5", "r10", "r25", "mrr")) -> DataFrame:
    """Overall and per category for each configuration, with the share of the dataset."""
    rolled = per_query.rollup("config", "category").agg(
        *[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"),
        F.grouping_id().alias("_g"),
    ).filter(F.col("_g") < 3)
    totals = per_query.groupBy("config").agg(F.count(F.lit(1)).alias("_all"))
    return rolled.join(totals, "config").select(
        "config", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("category")).alias("category"), "n",
        (F.col("n") / F.col("_all") * 100.0).alias("pct"), *metrics,
    )


def abstentions(queries: DataFrame, results: DataFrame, negatives: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Per unanswerable query: top score, whether it abstains, whether the top result is a trap."""
    from cuelight.operators.intervals import judged_hits

    top = results.filter("rank = 1")
    trapped = judged_hits(top, negatives).select("query_id").distinct().withColumn("_trap", F.lit(True))
    best = top.groupBy("query_id").agg(F.max("score").alias("top_score"))
    return (
        queries.join(best, "query_id", "left").join(trapped, "query_id", "left")
        .withColumn("top_score", F.coalesce("top_score", F.lit(0.0)))
        .withColumn("abstained", F.col("top_score") < threshold)
        .withColumn("hit_hard_negative", F.coalesce("_trap", F.lit(False)))
        .drop("_trap")
    )


def abstention_rates(per_query: DataFrame) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return per_query.agg(
        F.count(F.lit(1)).alias("n"), rate("abstained").alias("no_answer_accuracy"),
        (F.lit(1.0) - rate("abstained")).alias("false_positive_rate"),
        rate("hit_hard_negative").alias("hard_negative_trap_rate"), F.avg("top_score").alias("avg_top_score"),
    )


def routing_log(per_config: DataFrame) -> DataFrame:
    """One row per query with a map from configuration to its metrics."""
    m = F.struct("first_hit", "r1", "r5", "r10", "r25", "mrr")
    return per_config.groupBy("query_id", "predicted_category", "confidence", "max_speech", "w_dense", "w_speech").agg(
        F.map_from_entries(F.collect_list(F.struct("config", m))).alias("metrics")
    )
