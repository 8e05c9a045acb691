"""Readers: files in the layouts that users have, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.functions.text import strip
from cuelight.operators.ordered import text_runs, with_position
from cuelight.sources.arrays import read_vectors

_SEGMENT = (
    "video_id string, segment_id bigint, start_sec double, start double, end_sec double, end double, "
    "start_frame bigint, end_frame bigint, text string, cleaned_text string, refined_text string"
)

def _fields(spec: str) -> str:
    return ",".join(":".join(f.strip().split(" ", 1)) for f in spec.split(","))


_TRANSCRIPT = (
    ", ".join(f.strip() for f in _SEGMENT.split(",") if not f.strip().startswith("video_id"))
    + f", segments array<struct<{_fields(_SEGMENT)}>>, _corrupt_record string"
)


def stem(path_col="_metadata.file_path"):
    """Name of a file without folders and extension."""
    name = F.url_decode(F.regexp_replace(F.substring_index(F.col(path_col), "/", -1), r"\+", "%2B"))
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def _transcript_files(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    raw = spark.read.schema(_TRANSCRIPT).option("mode", "PERMISSIVE").option("multiLine", multiline).json(path)
    return raw if "video_id" in raw.columns else raw.withColumn("video_id", stem())


def _flatten(raw: DataFrame) -> DataFrame:
    flat_cols = [c for c in raw.columns if c not in ("segments", "_corrupt_record")]
    lists = raw.filter("segments is null and _corrupt_record is null").select(*flat_cols)
    wrapped = raw.filter("segments is not null").select("video_id", F.explode("segments").alias("_s")).select(
        "video_id", *[F.col(f"_s.{c}").alias(c) for c in flat_cols if c != "video_id"]
    )
    return lists.unionByName(wrapped)


def read_transcripts(
    spark: SparkSession, refined: str | None, raw: str | None, multiline: bool = True, flavour: str = "lexical",
) -> DataFrame:
    """Timed segments; the refined file of a video wins over its raw file.

    flavour 'lexical': text is refined, else cleaned, else plain; a broken
    refined file hides the video. flavour 'semantic': refined files use refined,
    else plain text, raw files cleaned, else plain; a broken refined file falls
    back to the raw one.
    """
    parts, taken = [], None
    if refined:
        files = _transcript_files(spark, refined, multiline)
        # the corrupt column may not be read alone, hence the (always true) look at the text
        broken = F.col("_corrupt_record").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) >= 0)
        whole = files.groupBy("video_id").agg(F.max(broken).alias("_bad"))
        good = files.join(whole.filter("not _bad"), "video_id", "left_semi")
        parts.append(_flatten(good).withColumn("is_refined", F.lit(True)))
        taken = (whole if flavour == "lexical" else whole.filter("not _bad")).select("video_id")
    if raw:
        files = _transcript_files(spark, raw, multiline)
        if taken is not None:
            files = files.join(taken, "video_id", "left_anti")
        parts.append(_flatten(files.filter("_corrupt_record is null")).withColumn("is_refined", F.lit(False)))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return normalise_segments(rows, flavour)


def normalise_segments(rows: DataFrame, flavour: str = "lexical") -> DataFrame:
    """One field chain for all spellings of text and bounds; blank rows are dropped."""
    nothing = F.lit(None).cast("string")
    if flavour == "lexical":
        text = T.segment_text("refined_text", "cleaned_text", "text")
    else:
        text = F.when(F.col("is_refined"), T.segment_text("refined_text", nothing, "text")).otherwise(
            T.segment_text(nothing, "cleaned_text", "text"))
    return (
        rows.withColumn("_t", text)
        .withColumn("_s", T.segment_start("start_sec", "start"))
        .withColumn("_e", T.segment_end("end_sec", "end", "_s"))
        .filter(F.col("_t") != "")
        .select(
            "video_id", "segment_id", F.col("_s").alias("start_sec"), F.col("_e").alias("end_sec"),
            F.coalesce("start_frame", F.lit(0)).alias("start_frame"), F.coalesce("end_frame", F.lit(0)).alias("end_frame"),
            F.col("_t").alias("text"), "is_refined",
        )
    )


def read_ocr(spark: SparkSession, path: str, fps: float = 25.0, wholetext: bool = True, named: bool = False) -> DataFrame:
    """Screen text: maps {"f_<frame>": text}. A key without a number is at second 0.

    One map per video file, or with ``wholetext`` off one map per line in a
    folder per video (video_id=...), for videos too long for one map. With
    ``named`` a line is {"video_id": ..., "frames": map}, in any files: for more
    videos than the driver can list.
    """
    if named:
        maps = spark.read.schema("video_id string, frames map<string,string>").json(path)
        return ocr_lines(maps.select("video_id", F.explode("frames").alias("key", "text")), fps)
    whole = spark.read.text(path, wholetext=wholetext)
    if "video_id" not in whole.columns:
        whole = whole.withColumn("video_id", stem())
    lines = whole.select("video_id", F.explode(F.from_json("value", "map<string,string>")).alias("key", "_t"))
    return ocr_lines(lines.withColumnRenamed("_t", "text"), fps)


def ocr_lines(rows: DataFrame, fps: float = 25.0) -> DataFrame:
    frame = F.replace(F.col("key"), F.lit("f_"), F.lit("")).try_cast("bigint")
    return rows.withColumn("text", strip("text")).filter("text != ''").withColumn(
        "t_sec", F.coalesce(frame / F.lit(float(fps)), F.lit(0.0))
    )


def ocr_documents(lines: DataFrame) -> DataFrame:
    """Runs of equal lines as documents with source 'ocr'."""
    return text_runs(lines, tie="key").select("video_id", "start_sec", "end_sec", "text", F.lit("ocr").alias("source"))


def union_documents(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """Speech and screen text in one table; ``source`` is never null."""
    cols = ["video_id", "start_sec", "end_sec", "text"]
    return segments.select(*cols, F.lit("asr").alias("source")).unionByName(runs.select(*cols, F.lit("ocr").alias("source")))


def read_frame_map(spark: SparkSession, path: str) -> DataFrame:
    """Frame maps, one CSV per video, with ``row_no`` in file order."""
    raw = (
        spark.read.option("header", True).schema("n bigint, pts_time double, fps double, frame_idx double").csv(path)
        .transform(lambda d: d if "video_id" in d.columns else d.withColumn("video_id", stem())).withColumn("frame_idx", F.col("frame_idx").cast("bigint"))
    )
    return with_position(raw, ["video_id"], ["n"], F.floor(F.col("n") / 4096), "row_no")


def read_detections(spark: SparkSession, path: str, named: bool = False) -> DataFrame:
    """Detections, one JSON per keyframe in a folder per video: one row per box.

    With ``named`` a line is the JSON of one keyframe with its video_id and
    keyframe, in any files: for more keyframes than the driver can list.
    """
    schema = (
        "detection_class_entities array<string>, detection_boxes array<array<double>>, detection_scores array<string>"
    )
    if named:
        return detection_rows(spark.read.schema(f"video_id string, keyframe string, {schema}").json(path))
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select("*", "_metadata.file_path")
    parts = F.split("file_path", "/")
    named = raw.withColumn("video_id", F.element_at(parts, -2)).withColumn("keyframe", stem("file_path"))
    return detection_rows(named)


def detection_rows(raw: DataFrame) -> DataFrame:
    """One row per box from the parallel arrays of a keyframe; incomplete boxes are skipped."""
    zipped = F.arrays_zip("detection_class_entities", "detection_boxes", "detection_scores")
    return raw.select("video_id", "keyframe", F.explode(zipped).alias("_d")).select(
        "video_id", "keyframe", F.col("_d.detection_class_entities").alias("entity"),
        F.col("_d.detection_boxes").alias("box"), F.col("_d.detection_scores").try_cast("double").alias("score"),
    ).filter("entity is not null and box is not null and score is not null")


def read_metadata(spark: SparkSession, path: str, named: bool = False) -> DataFrame:
    """Media info, one JSON per video; keywords and tags are a list or a scalar.

    With ``named`` a line is the JSON of one video with its video_id, in any
    files: for more videos than the driver can list.
    """
    if named:
        return metadata_rows(spark.read.text(path).withColumn("video_id", F.get_json_object("value", "$.video_id")))
    whole = spark.read.text(path, wholetext=True).withColumn("video_id", stem())
    return metadata_rows(whole)


def metadata_rows(rows: DataFrame, value: str = "value") -> DataFrame:
    def words(name):
        raw = F.get_json_object(value, f"$.{name}")
        return F.coalesce(F.array_join(F.from_json(raw, "array<string>"), " "), raw, F.lit(""))

    plain = lambda name: F.coalesce(F.get_json_object(value, f"$.{name}"), F.lit(""))
    return rows.select(
        "video_id", plain("title").alias("title"), plain("description").alias("description"),
        words("keywords").alias("keywords"), words("tags").alias("tags"),
    )


def metadata_pieces(meta: DataFrame, segments: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """All text of the videos in ``meta`` as pieces: (video_id, text)."""
    pieces = meta.select("video_id", F.concat_ws(" ", "title", "keywords", "tags", "description").alias("text"))
    for extra in (segments, lines):
        if extra is not None:
            pieces = pieces.unionByName(
                extra.select("video_id", "text").join(meta.select("video_id").distinct(), "video_id", "left_semi"))
    return pieces


def attach_metadata(vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """Vectors (video_id, pos, embedding) with their sidecar rows by position and a running ``global_idx``.

    A missing sidecar row is frame 6 * pos at 0.2 * pos seconds.
    """
    m = meta.select("video_id", "pos", F.col("frame_idx").alias("_f"), F.col("pts_time").alias("_p"))
    joined = vectors.join(m, ["video_id", "pos"], "left").select(
        *vectors.columns, F.coalesce("_f", F.col("pos") * 6).cast("bigint").alias("frame_idx"),
        F.coalesce("_p", F.col("pos") * F.lit(0.2)).alias("pts_time"),
    )
    return global_positions(joined)


def global_positions(rows: DataFrame) -> DataFrame:
    """Running 0-based position over videos in name order, without one task for all rows."""
    return with_position(rows, [], ["video_id", "pos"], None, "global_idx").withColumn("global_idx", F.col("global_idx") - 1)


def read_embeddings(spark: SparkSession, path: str, meta: DataFrame) -> DataFrame:
    """Vectors from array files (:mod:`cuelight.sources.arrays`) with their sidecar rows."""
    return attach_metadata(read_vectors(spark, path), meta)


def list_keyframe_files(spark: SparkSession, path: str) -> DataFrame:
    """Keyframe pictures per video in name order: only names are read, never pixels."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("video_id"), "path", F.element_at(parts, -1).alias("name"))
    w = Window.partitionBy("video_id").orderBy("name")  # one row per picture of a video, names only
    return named.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))


def attach_keyframe_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Path and name by position; a missing file has no path and the name %04d of its position."""
    f = files.select("video_id", "pos", "path", T.file_stem("path").alias("_n"))
    return rows.join(f, ["video_id", "pos"], "left").select(
        *rows.columns, F.coalesce("path", F.lit("")).alias("keyframe_path"),
        F.coalesce("_n", F.format_string("%04d", F.col("pos") + 1)).alias("keyframe"),
    )


_PLACE = "struct<video_id:string,segment_id:bigint,start_sec:double,end_sec:double,keyframe_indices:array<bigint>,reason:string>"
_QUERY = (
    "query_id string, query string, language string, category string, difficulty string, answerability string, "
    f"relevant_segments array<{_PLACE}>, hard_negative_segments array<{_PLACE}>"
)


def read_judgements(spark: SparkSession, path: str, answerable_only: bool = True) -> DataFrame:
    rows = spark.read.schema(_QUERY).json(path).filter("query is not null")
    return answerable(rows) if answerable_only else rows


def answerable(rows: DataFrame) -> DataFrame:
    no = F.coalesce(F.col("category") == "UNANSWERABLE", F.lit(False)) | F.coalesce(
        F.col("answerability") == "unanswerable", F.lit(False))
    return rows.filter(~no)


def truth_table(judgements: DataFrame, column: str = "relevant_segments") -> DataFrame:
    return judgements.select("query_id", F.explode(column).alias("_s")).select(
        "query_id", "_s.video_id", F.coalesce("_s.start_sec", F.lit(-1.0)).alias("start_sec"),
        F.coalesce("_s.end_sec", F.lit(-1.0)).alias("end_sec"),
        F.coalesce("_s.keyframe_indices", F.array().cast("array<bigint>")).alias("frames"),
    )


def read_query_package(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.url_decode(F.col("_metadata.file_path")).alias("path"), "value")
    return query_package(whole)


def query_package(files: DataFrame) -> DataFrame:
    """Queries (query_id, prompt, mode) from package files (path, value).

    JSON: an array of strings or objects, an object that holds the array under
    queries, data or items, or a map from key to value. Everything else is the
    text of one query; of text files with the same id the last path wins.
    """
    f = files.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", "")).filter("value != ''")
    is_json = F.lower("path").endswith(".json") & F.try_parse_json("value").isNotNull()
    j = f.filter(is_json).withColumn("v", F.parse_json("value"))
    shape = lambda c: F.schema_of_variant(c)
    as_list = F.when(shape(F.col("v")).startswith("ARRAY"), F.col("v"))
    for name in ("queries", "data", "items"):
        as_list = F.coalesce(as_list, F.when(
            shape(F.variant_get("v", f"$.{name}", "variant")).startswith("ARRAY"), F.variant_get("v", f"$.{name}", "variant")))
    j = j.withColumn("_list", as_list).withColumn("base", T.query_id("path"))
    items = files.sparkSession.sql(
        "select path, base, e.pos, cast(null as string) as key, e.value as item from {package}, lateral variant_explode(_list) e "
        "where _list is not null union all "
        "select path, base, e.pos, e.key, e.value from {package}, lateral variant_explode(v) e where _list is null", package=j)
    text_of = lambda name: F.nullif(F.try_variant_get("item", f"$.{name}", "string"), F.lit(""))
    is_text = shape(F.col("item")) == "STRING"
    plain = F.when(is_text, F.col("item").cast("string"))
    numbered = F.concat_ws("_", "base", (F.col("pos") + 1).cast("string"))
    qid = F.coalesce(F.col("key"), F.when(~is_text, F.coalesce(text_of("id"), text_of("query_id"), text_of("name"))), numbered)
    prompt = F.coalesce(
        plain, F.when(F.col("key").isNull(), F.coalesce(text_of("prompt"), text_of("query"), text_of("text"), text_of("description"))),
        text_of("prompt"), text_of("text"), F.to_json("item"))
    from_json = items.select("path", F.regexp_replace(qid, r"\s+", "_").alias("query_id"), strip(prompt).alias("prompt"),
                             F.when(~is_text, text_of("mode")).alias("_m"), F.when(F.col("key").isNull() & ~is_text, text_of("type")).alias("_t"))
    from_json = from_json.select("path", "query_id", "prompt", F.coalesce(
        "_m", T.query_mode(F.concat_ws(" ", "query_id", "_t"), "prompt")).alias("mode"))
    texts = f.filter(~is_json).select("path", T.query_id("path").alias("query_id"), F.col("value").alias("prompt"),
                                      T.query_mode("path", "value").alias("mode"))
    last = texts.groupBy("query_id").agg(F.max_by(F.struct("path", "prompt", "mode"), "path").alias("_l")).select(
        "_l.path", "query_id", "_l.prompt", "_l.mode")
    return from_json.unionByName(last)


def read_transcript_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'start | end | first frame | last frame | text'; other lines are dropped."""
    lines = spark.read.text(path)
    return parse_transcript_lines(lines if "video_id" in lines.columns else lines.withColumn("video_id", stem()))


def parse_transcript_lines(lines: DataFrame) -> DataFrame:
    f = F.transform(F.split(strip("value"), r"\|", 5), lambda x: strip(x))
    parsed = lines.withColumn("_f", f).filter(F.size("_f") == 5).select(
        *[c for c in lines.columns if c != "value"],
        F.col("_f")[0].try_cast("double").alias("start_sec"), F.col("_f")[1].try_cast("double").alias("end_sec"),
        F.col("_f")[2].try_cast("bigint").alias("start_frame"), F.col("_f")[3].try_cast("bigint").alias("end_frame"),
        F.col("_f")[4].alias("text"),
    )
    return parsed.filter("start_sec is not null and end_sec is not null and start_frame is not null and end_frame is not null")
