"""Transcript tables: validation of generated text, refined rows, profiles, sampling, work lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.functions import lexicon as lx
from cuelight.functions import text as T
from cuelight.functions.text import strip
from cuelight.operators.ordered import time_chunk, with_position

MARKED = r"(?s)\[SEGMENT\s+(\d+)\]\s*(.*?)(?=\[SEGMENT\s+\d+\]|\z)"
TAGGED = r"(?s)<SEGMENT_(\d+)>\s*(.*?)\s*</SEGMENT_\1>"


def _blocks(raw, pattern: str) -> Column:
    """array<struct<id, text>> in the order of the text."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    ids = F.regexp_extract_all(raw, F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(raw, F.lit(pattern), F.lit(2))
    return F.zip_with(ids, texts, lambda i, t: F.struct(
        i.cast("bigint").alias("id"), F.regexp_replace(t, r"^\s+|\s+$", "").alias("text")))


def marked_blocks(raw) -> Column:
    return _blocks(raw, MARKED)


def tagged_blocks(raw) -> Column:
    return _blocks(raw, TAGGED)


def id_differences(found: Column, expected: Column) -> Column:
    """struct(missing, extra, duplicates, out_of_order) of two id sequences."""
    distinct = F.array_distinct(found)
    missing = F.array_sort(F.array_except(expected, found))
    extra = F.array_sort(F.array_except(found, expected))
    repeated = F.array_sort(F.filter(distinct, lambda i: F.size(F.filter(found, lambda j: j == i)) > 1))
    same_set = (F.size(missing) == 0) & (F.size(extra) == 0) & (F.size(repeated) == 0)
    return F.struct(
        missing.alias("missing"), extra.alias("extra"), repeated.alias("duplicates"),
        (same_set & (found != expected)).alias("out_of_order"),
    )


def validate_generated(outputs: DataFrame, originals: DataFrame) -> DataFrame:
    """Check generated transcripts against their originals.

    outputs: video_id, raw_output; originals: video_id, segment_no (0-based), text.
    reason is null for a valid transcript; the ratios and counts then hold.
    A transcript that starts with a marker has no preamble: phrases behind the
    marker are its text, and a first marker other than 0 is an id mismatch.
    """
    text = strip("text")
    base = originals.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars"), F.sum(T.word_count(text)).alias("words")
    )
    head = F.lower(F.substring("raw_output", 1, 120))
    chatty = F.lit(False)
    for phrase in lx.CHAT_PREAMBLES:
        chatty = chatty | F.contains(head, F.lit(phrase))
    b = F.col("blocks")
    ids = F.transform(b, lambda x: x["id"])
    expected = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).otherwise(
        F.array().cast("array<bigint>"))
    reason = (
        F.when(strip(F.coalesce("raw_output", F.lit(""))) == "", "empty")
        .when(chatty & ~F.rlike(head, F.lit(r"^\[segment (0|[1-9]\d*)\]")), "preamble")
        .when(F.size(b) == 0, "no_markers")
        .when(F.col("ids") != expected, "id_mismatch")
    )
    checked = (
        outputs.join(base, "video_id", "left").na.fill(0, ["n", "chars", "words"])
        .withColumn("blocks", marked_blocks("raw_output")).withColumn("ids", ids)
        .withColumn("reason", reason).withColumn("diff", id_differences(F.col("ids"), expected))
    )
    blocks = checked.filter("reason is null").select("video_id", F.explode("blocks").alias("_b")).select(
        "video_id", F.col("_b.id").alias("segment_no"), F.col("_b.text").alias("refined"))
    changed = (
        blocks.join(originals.select("video_id", "segment_no", text.alias("_o")), ["video_id", "segment_no"])
        .groupBy("video_id").agg(
            F.sum(F.when(F.col("_o") != F.col("refined"), 1).otherwise(0)).alias("changed_count"),
            F.sum(F.length("refined")).alias("_rc"), F.sum(T.word_count("refined")).alias("_rw"),
        )
    )
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return checked.join(changed, "video_id", "left").select(
        "video_id", "reason", "n", F.size("blocks").cast("bigint").alias("n_found"), "diff",
        F.coalesce(F.col("_rc") / one("chars"), F.lit(1.0)).alias("char_ratio"),
        F.coalesce(F.col("_rw") / one("words"), F.lit(1.0)).alias("word_ratio"),
        F.coalesce("changed_count", F.lit(0)).cast("bigint").alias("changed_count"),
    ).withColumn("suspicious", ~F.col("char_ratio").between(0.65, 1.35))


def validate_tagged(outputs: DataFrame) -> DataFrame:
    """The tag variant. outputs: video_id, raw_output, n_expected."""
    b = F.col("blocks")
    found = F.transform(b, lambda x: x["id"])
    need = F.when(
        F.col("n_expected") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n_expected").cast("bigint") - 1)
    ).otherwise(F.array().cast("array<bigint>"))
    return outputs.withColumn("blocks", tagged_blocks("raw_output")).withColumn(
        "error",
        F.when(F.size(b) != F.col("n_expected"), "segment_count_mismatch")
        .when(F.size(F.array_except(need, found)) > 0, "missing_segment_index"),
    )


def refined_rows(originals: DataFrame, refined: DataFrame) -> DataFrame:
    """Segments with their refined text where there is one; others pass through unchanged."""
    text = strip(F.coalesce("text", F.lit("")))
    return originals.join(
        refined.select("video_id", "segment_no", F.col("refined").alias("_r")), ["video_id", "segment_no"], "left"
    ).withColumn("original_text", text).withColumn("refined_text", F.coalesce("_r", text)).drop("_r", "text")


def profile_videos(segments: DataFrame, prompt_words: int = 0) -> DataFrame:
    """Per video: segments, words and the estimated tokens of its prompt (two marker words per segment)."""
    estimate = lambda w: (F.floor(w * F.lit(1.35)) + 10).cast("bigint")
    return segments.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum(T.word_count(strip("text"))).alias("words")
    ).withColumn(
        "tokens_est", estimate(F.lit(prompt_words)) + estimate(F.col("words") + F.col("n_segments") * 2)
    )


def profile_corpus(videos: DataFrame, long_tokens: int = 6000) -> DataFrame:
    return videos.agg(
        F.count(F.lit(1)).alias("n_videos"), F.sum("n_segments").alias("n_segments"), F.sum("words").alias("words"),
        F.sum("tokens_est").alias("tokens_est"), F.avg("words").alias("avg_words"), F.avg("tokens_est").alias("avg_tokens"),
        F.avg("n_segments").alias("avg_segments"), F.count_if(F.col("words") == 0).alias("n_empty"),
        F.count_if(F.col("tokens_est") > long_tokens).alias("n_long"),
    )


#: fixed values: percentiles of the short-to-median stratum and the target of the average stratum
SHORT_PERCENTILES = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.48, 0.50]
AVERAGE_WORDS = 1565


def validation_subset(videos: DataFrame, size: int = 30) -> DataFrame:
    """Stratified pick by word count: percentiles, the ten nearest to the average, every fifth from the top."""
    spoken = videos.filter("words > 0").select("video_id", "words")
    ranked = with_position(spoken, [], ["words", "video_id"], None, "pos")
    n = spoken.agg(F.count(F.lit(1))).scalar()
    pos = F.col("pos")
    any_of = lambda places: reduce(lambda x, y: x | y, [pos == p for p in places])
    short = any_of([F.floor(n * p).cast("bigint") + 1 for p in SHORT_PERCENTILES])
    from_top = any_of([n - i * 5 for i in range(10)])
    short_rows = ranked.filter(short).select("video_id", "words", F.lit(0).alias("_s"), pos.alias("_o"))
    long_rows = ranked.filter(from_top).select("video_id", "words", F.lit(2).alias("_s"), pos.alias("_o"))
    nearest = ranked.orderBy(F.abs(F.col("words") - AVERAGE_WORDS), "words", "video_id").limit(10).select(
        "video_id", "words", F.lit(1).alias("_s"), pos.alias("_o"))
    first = short_rows.unionByName(nearest).unionByName(long_rows).groupBy("video_id", "words").agg(
        F.min(F.struct("_s", "_o")).alias("_at"))
    # at most 30 rows are left here
    w = Window.orderBy("_at")
    return first.withColumn("pick_no", F.row_number().over(w)).filter(F.col("pick_no") <= size).select(
        "video_id", "words", F.col("pick_no").cast("bigint").alias("pick_no"))


def manifest_report(manifest: DataFrame) -> DataFrame:
    done = F.contains("status", F.lit("completed"))
    when_done = lambda c: F.when(done, F.col(c))
    return manifest.agg(
        F.count(F.lit(1)).alias("n_videos"), F.count_if(done).alias("n_success"), F.count_if(~done).alias("n_failed"),
        F.coalesce(F.avg(when_done("latency_sec")), F.lit(0.0)).alias("avg_latency"),
        F.coalesce(F.avg(when_done("total_tokens")), F.lit(0.0)).alias("avg_tokens"),
        F.coalesce(F.sum(when_done("total_tokens")), F.lit(0)).alias("total_tokens"),
    )


def pending(items: DataFrame, *done: DataFrame, key: str = "video_id") -> DataFrame:
    for d in done:
        items = items.join(d.select(key).distinct(), key, "left_anti")
    return items


def shard(items: DataFrame, n: int, key: str = "video_id") -> DataFrame:
    """Deterministic 1-of-n split by position in key order, positions counted in ranges of the order."""
    numbered = with_position(items, [], [key], None, "_pos")
    return numbered.withColumn("shard", F.pmod(F.col("_pos") - 1, F.lit(n)).cast("bigint")).drop("_pos")


def concat_text(pieces: DataFrame, key: str, order: str, part_rows: int = 1000, text: str = "text") -> DataFrame:
    """Texts of a key joined by blanks in order, in parts of bounded length.

    A key may own a third of the corpus; its text is then many rows (part_no),
    which tokenise and count to the same totals.
    """
    part = F.floor(F.col(order) / part_rows).cast("bigint")
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), " ")
    return pieces.groupBy(key, part.alias("part_no")).agg(joined.alias("text"))


def object_scores(detections: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Best score per (entity, video, keyframe); rows without a usable score are skipped."""
    score = F.col("score").try_cast("double")
    return (
        detections.withColumn("score", score).filter(F.col("score") >= min_score)
        .groupBy(F.lower(strip("entity")).alias("entity"), "video_id", "keyframe")
        .agg(F.max("score").alias("score"))
    )


def object_lists(detections: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Detections per keyframe as an array (a picture has few)."""
    d = detections.withColumn("score", F.col("score").try_cast("double")).filter(F.col("score") >= min_score)
    return d.groupBy("video_id", "keyframe").agg(
        F.array_sort(F.collect_list(F.struct(strip("entity").alias("entity"), "score"))).alias("detections"))


def entity_boost(queries: DataFrame, objects: DataFrame, keyframes: DataFrame) -> DataFrame:
    """query_id, kf_id, object: summed scores of the query's tokens on a keyframe over the query's best."""
    tokens = queries.select("query_id", F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "")).alias("entity"))
    hits = (
        tokens.groupBy("query_id", "entity").agg(F.count(F.lit(1)).alias("_q"))
        .join(objects, "entity")
        .join(keyframes.select("video_id", "keyframe", "kf_id"), ["video_id", "keyframe"])
        .groupBy("query_id", "kf_id").agg(F.sum(F.col("score") * F.col("_q")).alias("_s"))
    )
    best = hits.groupBy("query_id").agg(F.max("_s").alias("_m"))
    return hits.join(best, "query_id").filter("_m > 0").select("query_id", "kf_id", (F.col("_s") / F.col("_m")).alias("object"))
