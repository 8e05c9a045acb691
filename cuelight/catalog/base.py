"""Registry of queries, the tables they read, and the same tables as SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions import numeric as N
from cuelight.operators.ordered import text_runs, with_position

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def r6(x) -> Column:
    """Six decimals by the same arithmetic in both engines."""
    c = F.col(x) if isinstance(x, str) else x
    return F.floor(c * 1e6 + 0.5) / 1e6


def R(expr: str) -> str:
    return f"(floor(({expr}) * 1e6 + 0.5e0) / 1e6)"


def G(expr: str) -> str:
    """The score grid in SQL."""
    return f"(floor(({expr}) * 1e9 + 0.5e0) / 1e9)"


def stripped(sql: str) -> str:
    """``trim(x)`` of the SQL as the removal of all white space at the ends, not of blanks only."""
    out, at = [], 0
    for m in re.finditer(r"(?<![\w.])trim\(", sql):
        if m.start() < at:
            continue
        depth, end, quoted = 1, m.end(), False
        while depth:
            c = sql[end]
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            end += 1
        out += [sql[at : m.start()], "trim(", stripped(sql[m.end() : end - 1]), ", ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"]
        at = end
    return "".join(out) + sql[at:]


def doubles(sql: str) -> str:
    """Decimal literals of the SQL as doubles."""
    return re.sub(r"(?<![\w.'%\\])(\d+\.\d+)(?![\de.'])", r"\1e0", sql)


def query(name: str, sql: str | None = None):
    """Register a query (a function of :class:`Tables`) and its oracle."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = stripped(with_views(sql))
        return fn

    return add


class Tables:
    """The driver tables and the logical tables made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    #: tables of long texts, with their key
    HEAVY = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}

    def __getitem__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in self.HEAVY and not df.isStreaming:
            # one small file is one task; a table with splits enough is left as it lies
            cores = self.spark.sparkContext.defaultParallelism
            if len(df.inputFiles()) == 1 and self._megabytes(df) < 128:
                return df.repartition(cores, self.HEAVY[name])
        return df

    @staticmethod
    def _megabytes(df: DataFrame) -> float:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 2**20

    def scratch(self) -> str:
        """A new folder for files that a query writes and reads back."""
        from cuelight.session import shared_folder

        return f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"

    #: folders of the block indexes written so far, by application and input
    _INDEXES: dict[tuple[str, str], str] = {}

    def cell_index(self):
        """The cells of the keyframe vectors, trained and written once per application and read by every search."""
        from cuelight.operators.cells import read_cells, write_cells

        place = (self.spark.sparkContext.applicationId, f"{self.dir}#cells")
        if place not in self._INDEXES:
            folder = self.scratch()
            write_cells(self.keyframes, folder)
            self._INDEXES[place] = folder
        return read_cells(self.spark, self._INDEXES[place])

    def block_index(self):
        """The block index of ``docs``, written once per application and read by every search."""
        from cuelight.operators.blockmax import block_index
        from cuelight.sources.writers import read_block_index, write_block_index

        key = self.spark.sparkContext.applicationId, self.dir
        if key not in self._INDEXES:
            path = self.scratch()
            write_block_index(block_index(self.docs), path, self.spark.sparkContext.defaultParallelism)
            self._INDEXES[key] = path
        return read_block_index(self.spark, self._INDEXES[key])

    def gram_index(self):
        """The trigrams of ``docs``, written once per application."""
        from cuelight.operators.grams import read_gram_index, write_gram_index

        place = (self.spark.sparkContext.applicationId, f"{self.dir}#grams")
        if place not in self._INDEXES:
            folder = self.scratch()
            write_gram_index(self.docs, folder)
            self._INDEXES[place] = folder
        return read_gram_index(self.spark, self._INDEXES[place])

    @cached_property
    def keyframes(self) -> DataFrame:
        e = self["embeddings"].select(
            F.concat(F.lit("v"), "label").alias("video_id"), F.col("vec_id").alias("kf_id"), "embedding")
        numbered = with_position(e, ["video_id"], ["kf_id"], F.floor(F.col("kf_id") / 4096), "n")
        pts = (F.col("n") - 1) * F.lit(1.5)
        return numbered.select(
            "video_id", "kf_id", "n", pts.alias("pts_time"), F.lit(25.0).alias("fps"),
            F.floor(pts * 25.0).cast("bigint").alias("frame_idx"), F.format_string("%04d", "n").alias("keyframe"), "embedding",
        )

    @cached_property
    def segments(self) -> DataFrame:
        c = self["conversations"].withColumn("video_id", F.concat(F.lit("v"), F.col("conv_id") % 10))
        s = with_position(c, ["video_id"], ["conv_id", "turn"], F.floor(F.col("conv_id") / 512), "_p")
        sid = F.col("_p") - 1
        return s.select(
            "video_id", sid.alias("segment_id"), F.col("_p").alias("position"), (sid * 2.0).alias("start_sec"),
            (sid * 2.0 + 1.5).alias("end_sec"), (sid * 50).alias("start_frame"), (sid * 50 + 37).alias("end_frame"), "text",
            "conv_id", "turn", "role",
        )

    @cached_property
    def ocr_lines(self) -> DataFrame:
        return self["events"].select(
            F.concat(F.lit("v"), "user_id").alias("video_id"), F.col("event_id").alias("line_id"), hours("ts").alias("t_sec"),
            F.col("event_type").alias("text"),
        )

    @cached_property
    def ocr_runs(self) -> DataFrame:
        return text_runs(self.ocr_lines, chunk_width=24.0)

    @cached_property
    def docs(self) -> DataFrame:
        cols = ["video_id", "start_sec", "end_sec", "text"]
        asr = self.segments.select(F.concat_ws("#", F.lit("a"), "video_id", "segment_id").alias("doc_id"), *cols, F.lit("asr").alias("source"))
        ocr = self.ocr_runs.select(F.concat_ws("#", F.lit("o"), "video_id", "run_id").alias("doc_id"), *cols, F.lit("ocr").alias("source"))
        return asr.unionByName(ocr)

    @cached_property
    def queries(self) -> DataFrame:
        return (
            self["benchmark"].join(self["embeddings"], F.col("item_id") == F.col("vec_id"))
            .select(F.col("item_id").alias("query_id"), "text", N.as_doubles("embedding").alias("embedding"))
        )

    @cached_property
    def lex_queries(self) -> DataFrame:
        return self["benchmark"].select(F.col("item_id").alias("query_id"), "text")

    @cached_property
    def text_vectors(self) -> DataFrame:
        return self.queries.select("query_id", letter_profile("text").alias("embedding"))

    @cached_property
    def segment_vectors(self) -> DataFrame:
        return self.segments.select(
            F.concat_ws("#", "video_id", F.format_string("%08d", "segment_id")).alias("seg_key"), "video_id", "segment_id",
            "start_sec", "end_sec", "text", letter_profile("text").alias("embedding"))

    @cached_property
    def qrels(self) -> DataFrame:
        """Documents that contain a benchmark passage (planted), found in one pass over the documents."""
        from cuelight.operators.lexical import phrase_hits

        kw = self["benchmark"].select(F.col("item_id").alias("query_id"), F.col("text").alias("keyword"))
        exact = phrase_hits(kw, self["documents"].select("doc_id", "text"))
        return exact.filter(F.contains("text", F.col("keyword"))).select("query_id", "doc_id")

    @cached_property
    def video_pieces(self) -> DataFrame:
        return self["documents"].select(F.replace(F.col("source"), F.lit("src"), F.lit("v")).alias("video_id"), "doc_id", "text")

    @cached_property
    def detections(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self["events"].select(
            F.concat(F.lit("v"), "user_id").alias("video_id"), F.format_string("%04d", k).alias("keyframe"),
            F.col("event_type").alias("entity"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("score"), F.col("event_id"),
        )

    @cached_property
    def truth(self) -> DataFrame:
        return self.keyframes.join(self["benchmark"], F.col("item_id") == F.col("kf_id")).select(
            F.col("item_id").alias("query_id"), "video_id", (F.col("pts_time") - 1.5).alias("start_sec"),
            (F.col("pts_time") + 1.5).alias("end_sec"), F.array("frame_idx").alias("frames"),
        )

    @cached_property
    def marks(self) -> DataFrame:
        """Two marks per query: the next keyframe exactly, and a point near the one after it."""
        k = self.keyframes.select("kf_id", "video_id", "frame_idx", "pts_time")
        b = self["benchmark"].select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("mark_no"))
        m = b.join(k, F.col("query_id") + F.col("mark_no") == F.col("kf_id"))
        second = F.col("mark_no") == 2
        return m.select(
            "query_id", "mark_no", "video_id", F.when(second, F.col("frame_idx") + 1).otherwise(F.col("frame_idx")).alias("frame_idx"),
            F.when(second, F.col("pts_time") + 0.4).otherwise(F.col("pts_time")).alias("pts_time"),
            (~second & (F.col("query_id") % 2 == 0)).alias("pinned"),
        )

    @cached_property
    def keywords(self) -> DataFrame:
        """Two phrases per query: its second word and the type of the event with its number."""
        b = self["benchmark"].select("item_id", F.element_at(F.split("text", " "), 2).alias("_w"))
        e = self["events"].select("event_id", "event_type")
        return b.join(e, F.col("item_id") == F.col("event_id")).select(
            F.col("item_id").alias("query_id"),
            F.posexplode(F.array("_w", "event_type")).alias("kw_no", "keyword"),
        ).withColumn("weight", F.when(F.col("kw_no") == 0, 1.0).otherwise(0.5))

    @cached_property
    def mixed_keywords(self) -> DataFrame:
        """Per query its second word as an exact phrase and, as a semantic keyword, that word with the type of the query's event and the vector of keyframe q + 7."""
        b = self["benchmark"].select("item_id", F.element_at(F.split("text", " "), 2).alias("_w"))
        e = self["events"].select("event_id", "event_type")
        v = self["embeddings"].select("vec_id", N.as_doubles("embedding").alias("_v"))
        rows = b.join(e, F.col("item_id") == F.col("event_id")).join(v, F.col("item_id") + 7 == F.col("vec_id"))
        exact = F.struct(F.lit(0).alias("kw_no"), F.col("_w").alias("keyword"), F.lit(0.5).alias("weight"), F.lit(True).alias("exact"),
                         F.lit(None).cast("array<double>").alias("embedding"))
        semantic = F.struct(F.lit(1).alias("kw_no"), F.concat_ws(" ", "_w", "event_type").alias("keyword"), F.lit(0.8).alias("weight"),
                            F.lit(None).cast("boolean").alias("exact"), F.col("_v").alias("embedding"))
        return rows.select(F.col("item_id").alias("query_id"), F.explode(F.array(exact, semantic)).alias("_k")).select("query_id", "_k.*")

    @cached_property
    def object_queries(self) -> DataFrame:
        e = self["events"].select("event_id", "event_type")
        return self.queries.join(e, F.col("query_id") == F.col("event_id")).select(
            "query_id", F.concat_ws(" ", "text", "event_type").alias("text"), "embedding")

    @cached_property
    def scenes(self) -> DataFrame:
        """Scenes of the benchmark texts; the vector of scene i of query q is that of keyframe q + i + 1."""
        from cuelight.functions.text import subscenes

        s = self["benchmark"].select(F.col("item_id").alias("query_id"), F.posexplode(subscenes("text")).alias("scene_no", "scene"))
        e = self["embeddings"].select("vec_id", N.as_doubles("embedding").alias("embedding"))
        return s.join(e, F.col("query_id") + F.col("scene_no") + 1 == F.col("vec_id")).select("query_id", "scene_no", "scene", "embedding")

    @cached_property
    def event_vectors(self) -> DataFrame:
        """Three events per query: the vectors of keyframes q, q + 10 and q + 20."""
        b = self["benchmark"].select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("event_no"))
        e = self["embeddings"].select("vec_id", N.as_doubles("embedding").alias("embedding"))
        return b.join(e, F.col("query_id") + F.col("event_no") * 10 == F.col("vec_id")).select("query_id", "event_no", "embedding")


def hours(ts: str) -> Column:
    """Hours since 2024-01-01 of a timestamp without time zone."""
    micros = (
        F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")).cast("bigint") * 86_400_000_000
        + F.hour(ts).cast("bigint") * 3_600_000_000 + F.minute(ts).cast("bigint") * 60_000_000
        + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    )
    return micros / F.lit(3.6e9)


def letter_counts(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return N.let(F.lower(c), lambda t: F.transform(
        letters, lambda x: (F.length(t) - F.length(F.replace(t, x, F.lit("")))).cast("double")))


def letter_profile(text) -> Column:
    """Unit vector of letter counts: a text encoder that SQL can express too."""
    return N.normalize(letter_counts(text))


def sql_letter_counts(text: str) -> str:
    letters = ",".join(f"'{x}'" for x in LETTERS)
    return f"list_transform([{letters}], lambda x: (length(lower({text})) - length(replace(lower({text}), x, '')))::DOUBLE)"


def sql_dot(a: str, b: str) -> str:
    return G(f"list_dot_product({a}, {b})")


def sql_tokens(text: str) -> str:
    return (
        f"list_filter(string_split_regex(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), "
        "lambda t: t <> '' AND t <> '_')"
    )


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


VIEWS = {
    "keyframes": """
  SELECT 'v' || label AS video_id, vec_id AS kf_id, n, (n-1)*1.5 AS pts_time, 25.0 AS fps,
         CAST(floor((n-1)*37.5) AS BIGINT) AS frame_idx, printf('%04d', n) AS keyframe, embedding::DOUBLE[] AS embedding
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)""",
    "segments": """
  SELECT 'v' || (conv_id % 10) AS video_id, sid AS segment_id, sid + 1 AS position, sid*2.0 AS start_sec, sid*2.0+1.5 AS end_sec,
         sid*50 AS start_frame, sid*50+37 AS end_frame, text, conv_id, turn, role
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) - 1 AS sid FROM conversations)""",
    "ocr_lines": """
  SELECT 'v' || user_id AS video_id, event_id AS line_id,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3.6e9 AS t_sec, event_type AS text
  FROM events""",
    "ocr_flags": """
  SELECT *, CASE WHEN lag(text) OVER w = text AND t_sec <= lag(t_sec) OVER w + 3.0 + 3.0 THEN 0 ELSE 1 END AS is_new
  FROM ocr_lines WINDOW w AS (PARTITION BY video_id ORDER BY t_sec, line_id)""",
    "ocr_numbered": """
  SELECT *, sum(is_new) OVER (PARTITION BY video_id ORDER BY t_sec, line_id ROWS UNBOUNDED PRECEDING) AS run_id FROM ocr_flags""",
    "ocr_runs": """
  SELECT video_id, run_id::BIGINT AS run_id, min(t_sec) AS start_sec, max(t_sec) + 3.0 AS end_sec, min(text) AS text, count(*) AS n_lines
  FROM ocr_numbered GROUP BY video_id, run_id""",
    "docs": """
  SELECT 'a#' || video_id || '#' || segment_id AS doc_id, video_id, start_sec, end_sec, text, 'asr' AS source FROM segments
  UNION ALL SELECT 'o#' || video_id || '#' || run_id, video_id, start_sec, end_sec, text, 'ocr' FROM ocr_runs""",
    "queries": """
  SELECT item_id AS query_id, b.text, e.embedding::DOUBLE[] AS embedding FROM benchmark b JOIN embeddings e ON item_id = vec_id""",
    "lex_queries": "SELECT item_id AS query_id, text FROM benchmark",
    "seg_counts": f"SELECT *, {sql_letter_counts('text')} AS c FROM segments",
    "segment_vectors": """
  SELECT video_id || '#' || printf('%08d', segment_id) AS seg_key, video_id, segment_id, start_sec, end_sec, text,
         CASE WHEN list_dot_product(c, c) > 0 THEN list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) ELSE c END AS embedding
  FROM seg_counts""",
    "text_counts": f"SELECT query_id, {sql_letter_counts('text')} AS c FROM queries",
    "text_vectors": """
  SELECT query_id, CASE WHEN list_dot_product(c, c) > 0 THEN list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) ELSE c END AS embedding
  FROM text_counts""",
    "qrels": "SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "video_pieces": "SELECT replace(source, 'src', 'v') AS video_id, doc_id, text FROM documents",
    "detections": """
  SELECT 'v' || user_id AS video_id, printf('%04d', json_extract_string(props, '$.k')::INT) AS keyframe, event_type AS entity,
         least(1.0, value / 100.0) AS score, event_id FROM events""",
    "truth": """
  SELECT item_id AS query_id, video_id, pts_time - 1.5 AS start_sec, pts_time + 1.5 AS end_sec, [frame_idx] AS frames
  FROM keyframes JOIN benchmark ON item_id = kf_id""",
    "marks": """
  SELECT item_id AS query_id, mark_no, video_id, CASE WHEN mark_no = 2 THEN frame_idx + 1 ELSE frame_idx END AS frame_idx,
         CASE WHEN mark_no = 2 THEN pts_time + 0.4 ELSE pts_time END AS pts_time, (mark_no = 1 AND item_id % 2 = 0) AS pinned
  FROM (SELECT item_id, unnest([1, 2]) AS mark_no FROM benchmark) b JOIN keyframes k ON b.item_id + b.mark_no = k.kf_id""",
    "keywords": """
  SELECT item_id AS query_id, kw_no, CASE WHEN kw_no = 0 THEN string_split(b.text, ' ')[2] ELSE event_type END AS keyword,
         CASE WHEN kw_no = 0 THEN 1.0 ELSE 0.5 END AS weight
  FROM (SELECT item_id, text, unnest([0, 1]) AS kw_no FROM benchmark) b JOIN events e ON item_id = event_id""",
    "mixed_keywords": """
  SELECT item_id AS query_id, string_split(b.text, ' ')[2] AS exact_word, concat_ws(' ', string_split(b.text, ' ')[2], event_type) AS keyword,
         v.embedding::DOUBLE[] AS embedding
  FROM benchmark b JOIN events e ON item_id = event_id JOIN embeddings v ON item_id + 7 = v.vec_id""",
    "object_queries": """
  SELECT query_id, q.text || ' ' || event_type AS text, embedding FROM queries q JOIN events ON query_id = event_id""",
    "event_vectors": """
  SELECT item_id AS query_id, event_no, embedding::DOUBLE[] AS embedding
  FROM (SELECT item_id, unnest([0, 1, 2]) AS event_no FROM benchmark) b JOIN embeddings e ON b.item_id + b.event_no * 10 = e.vec_id""",
}


def _scene_views() -> None:
    from cuelight.functions import lexicon as lx

    joints = "|".join(lx.SCENE_CONNECTIVES)
    VIEWS["scene_parts"] = rf"""
  SELECT item_id AS query_id, list_filter(list_transform(
           string_split_regex(text, '(?i)[.\n;]|\b(?:{joints})\b'),
           lambda p: trim(regexp_replace(p, '^[,:;\-\s]+|[,:;\-\s]+$', '', 'g'))),
         lambda p: length(p) >= 12 AND NOT list_contains({sql_list(lx.SCENE_STOP_PHRASES)}, lower(p))) AS parts FROM benchmark"""
    VIEWS["scenes"] = """
  SELECT p.query_id, p.scene_no, p.scene, e.embedding::DOUBLE[] AS embedding
  FROM (SELECT query_id, unnest(parts) AS scene, unnest(range(len(parts))) AS scene_no FROM scene_parts) p
  JOIN embeddings e ON p.query_id + p.scene_no + 1 = e.vec_id"""
    # dense scores of all keyframes, calibrated and pooled over scenes
    VIEWS["dense_all"] = f"""
  SELECT query_id, kf_id, video_id, n, pts_time, frame_idx, {sql_dot('q.embedding', 'k.embedding')} AS dense FROM queries q, keyframes k"""
    VIEWS["dense_norm"] = """
  SELECT *, (dense - min(dense) OVER (PARTITION BY query_id)) / greatest(1e-6, max(dense) OVER (PARTITION BY query_id)
         - min(dense) OVER (PARTITION BY query_id)) AS norm FROM dense_all"""
    VIEWS["scene_all"] = f"""
  SELECT query_id, scene_no, kf_id, {sql_dot('s.embedding', 'k.embedding')} AS dense FROM scenes s, keyframes k"""
    VIEWS["scene_norm"] = """
  SELECT *, (dense - min(dense) OVER w) / greatest(1e-6, max(dense) OVER w - min(dense) OVER w) AS norm
  FROM scene_all WINDOW w AS (PARTITION BY query_id, scene_no)"""
    VIEWS["scene_pool"] = """
  SELECT query_id, kf_id, max(norm) AS top1, list_sort(list(norm), 'DESC')[2] AS top2, arg_max(scene_no, (norm, -scene_no)) AS best_scene,
         count(*) AS n_scenes FROM scene_norm GROUP BY query_id, kf_id"""
    VIEWS["pooled"] = f"""
  SELECT d.query_id, d.kf_id, d.video_id, d.pts_time, d.frame_idx, d.dense, CASE WHEN n_scenes > 1 THEN best_scene ELSE -1 END AS best_scene,
         {G('CASE WHEN n_scenes > 1 THEN norm * 0.35 + (top1 * 0.70 + (top1 + top2) / 2.0 * 0.30) * 0.65 ELSE norm END')} AS norm
  FROM dense_norm d LEFT JOIN scene_pool s USING (query_id, kf_id)"""


_scene_views()


def _bm25_views() -> None:
    """BM25 of the benchmark texts over the timed docs, and its mapping to keyframes."""
    from cuelight.functions import lexicon as lx

    stop = sql_list(lx.STOPWORDS)
    # keywords of the full search: dense parts, speech parts, exact phrases with the text that they show
    VIEWS["kw_dense"] = f"""
  SELECT query_id, kf_id, {G('0.8 * ((d - min(d) OVER w) / greatest(1e-6, max(d) OVER w - min(d) OVER w))')} AS kw
  FROM (SELECT query_id, kf_id, {sql_dot('m.embedding', 'k.embedding')} AS d FROM mixed_keywords m, keyframes k) WINDOW w AS (PARTITION BY query_id)"""
    VIEWS["kw_tokens"] = f"SELECT query_id, {sql_tokens('keyword')} AS toks FROM mixed_keywords"
    VIEWS["kw_terms"] = f"""
  SELECT query_id, term, count(*) AS qtf FROM (
    SELECT query_id, unnest(CASE WHEN len(list_filter(toks, lambda t: NOT list_contains({stop}, t))) = 0 THEN toks
           ELSE list_filter(toks, lambda t: NOT list_contains({stop}, t)) END) AS term FROM kw_tokens) GROUP BY query_id, term"""
    VIEWS["kw_spoken"] = f"""
  SELECT query_id, kf_id, max(0.8 * (score / greatest(1e-6, mx))) AS kw_speech FROM (
    SELECT *, max(score) OVER (PARTITION BY query_id) AS mx FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT query_id, doc_id, {G('sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * (dl / greatest(1e-6, avgdl)))))')} AS score
        FROM kw_terms JOIN doc_tf USING (term) JOIN doc_df USING (term), doc_stats GROUP BY query_id, doc_id)) WHERE rank <= 200) h
  JOIN docs d USING (doc_id) JOIN keyframes k ON d.video_id = k.video_id AND pts_time BETWEEN start_sec - 3.0 AND end_sec + 3.0 GROUP BY query_id, kf_id"""
    VIEWS["kw_exact"] = """
  SELECT query_id, kf_id, 0.5 * 1.5 AS exact, '🔤 [EXACT] "' || arg_max(d.text, d.doc_id) || '"' AS exact_text
  FROM mixed_keywords m JOIN docs d ON contains(lower(d.text), lower(exact_word))
  JOIN keyframes k ON d.video_id = k.video_id AND k.pts_time BETWEEN d.start_sec - 3.0 AND d.end_sec + 3.0 GROUP BY query_id, kf_id"""
    VIEWS["q_tokens"] = f"SELECT item_id AS query_id, {sql_tokens('text')} AS toks FROM benchmark"
    VIEWS["q_terms"] = f"""
  SELECT query_id, term, count(*) AS qtf FROM (
    SELECT query_id, unnest(CASE WHEN len(list_filter(toks, lambda t: NOT list_contains({stop}, t))) = 0 THEN toks
           ELSE list_filter(toks, lambda t: NOT list_contains({stop}, t)) END) AS term FROM q_tokens) GROUP BY query_id, term"""
    for name, source in (("doc", "docs"), ("lex", "documents")):
        VIEWS[f"{name}_tokens"] = f"SELECT doc_id, {sql_tokens('text')} AS toks FROM {source} WHERE trim(text) <> ''"
        VIEWS[f"{name}_tf"] = f"""
  SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM {name}_tokens) GROUP BY doc_id, term, dl"""
        VIEWS[f"{name}_df"] = f"SELECT term, count(*) AS df FROM {name}_tf GROUP BY term"
        VIEWS[f"{name}_stats"] = f"SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM {name}_tokens"
        VIEWS[f"{name}_bm25"] = f"""
  SELECT query_id, doc_id, {G('sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * (dl / greatest(1e-6, avgdl)))))')} AS score
  FROM q_terms JOIN {name}_tf USING (term) JOIN {name}_df USING (term), {name}_stats GROUP BY query_id, doc_id"""
        VIEWS[f"{name}_ranked"] = f"""
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_bm25"""
        VIEWS[f"{name}_hits"] = f"SELECT * FROM {name}_ranked WHERE rank <= 300"
        VIEWS[f"{name}_deep"] = f"SELECT * FROM {name}_ranked WHERE rank <= 400"


_bm25_views()


def with_views(sql: str) -> str:
    """The SQL with exactly the views that it needs, in order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    recursive = "RECURSIVE " if re.search(r"\bRECURSIVE\b", sql) else ""
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql)
    own = body != sql
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    if not needed:
        return doubles(sql)
    if own:
        return doubles(f"WITH {recursive}{views},\n{body}")
    return doubles(f"WITH {recursive}{views}\n{sql}")
