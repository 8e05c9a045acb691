"""Filters, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelight.catalog.base import G, R, Tables, query, r6, sql_dot, sql_tokens
from cuelight.functions import numeric as N
from cuelight.functions import text as T
from cuelight.functions.text import strip
from cuelight.operators import dense as D
from cuelight.operators import evaluation as E
from cuelight.operators import fusion as X
from cuelight.operators import intervals as I
from cuelight.operators import blockmax as BM
from cuelight.operators import grams as GR
from cuelight.operators import lexical as L
from cuelight.operators import transcripts as TR
from cuelight.operators.ordered import top_k
from cuelight.session import reliable

B = "bigint"


# ---------------------------------------------------------------- filters

@query("flt_nonblank", "SELECT doc_id, text FROM (SELECT doc_id, regexp_replace(text, '[a-zA-Z]', '', 'g') AS text FROM documents) WHERE trim(text) <> ''")
def _(t: Tables):
    return t["documents"].select("doc_id", F.regexp_replace("text", "[a-zA-Z]", "").alias("text")).filter(strip("text") != "")


@query("flt_confidence", """
SELECT event_id, event_type AS entity, try_cast(s AS DOUBLE) AS score FROM (
  SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'n/a' ELSE (value / 100.0)::VARCHAR END AS s FROM events) WHERE try_cast(s AS DOUBLE) >= 0.3""")
def _(t):
    s = F.when(F.col("event_type") == "error", "n/a").otherwise((F.col("value") / 100.0).cast("string"))
    return t["events"].select("event_id", F.col("event_type").alias("entity"), s.try_cast("double").alias("score")).filter("score >= 0.3")


@query("flt_phrase", """
SELECT k.query_id, kw_no::BIGINT AS kw_no, doc_id FROM keywords k JOIN docs d ON contains(lower(d.text), lower(trim(k.keyword)))""")
def _(t):
    return L.phrase_hits(t.keywords, t.docs).select("query_id", F.col("kw_no").cast(B).alias("kw_no"), "doc_id")


@query("flt_phrase_index", """
SELECT k.query_id, kw_no::BIGINT AS kw_no, doc_id FROM keywords k JOIN docs d ON contains(lower(d.text), lower(trim(k.keyword)))""")
def _(t):
    return GR.phrase_hits(t.keywords, t.gram_index()).select("query_id", F.col("kw_no").cast(B).alias("kw_no"), "doc_id")


@query("flt_video", "SELECT video_id, kf_id FROM keyframes WHERE contains(lower(video_id), 'v3')")
def _(t):
    return t.keyframes.filter(F.contains(F.lower("video_id"), F.lower(F.lit("V3")))).select("video_id", "kf_id")


_ANSWERABLE = """SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'UNANSWERABLE' WHEN quality = 1 THEN 'DIRECT' END AS category,
  CASE WHEN quality = 0 THEN 'unanswerable' END AS answerability FROM labels l"""


@query("flt_answerable", f"""
SELECT doc_id, category FROM ({_ANSWERABLE}) WHERE coalesce(category, '') <> 'UNANSWERABLE' AND coalesce(answerability, '') <> 'unanswerable'""")
def _(t):
    from cuelight.sources.readers import answerable

    q = t["labels"].select(
        "doc_id", F.when(F.col("toxic") == 1, "UNANSWERABLE").when(F.col("quality") == 1, "DIRECT").alias("category"),
        F.when(F.col("quality") == 0, "unanswerable").alias("answerability"))
    return answerable(q).select("doc_id", "category")


_POINTS = "SELECT query_id, k.video_id, k.pts_time, k.frame_idx FROM lex_queries JOIN keyframes k ON query_id = kf_id"


def _points(t):
    k = t.keyframes.select("kf_id", "video_id", "pts_time", "frame_idx")
    return t.lex_queries.select("query_id").join(k, F.col("query_id") == F.col("kf_id")).drop("kf_id")


@query("flt_near_window", f"""
SELECT p.query_id, s.video_id, segment_id, CASE WHEN abs(start_sec - pts_time) <= 45.0 OR abs(end_sec - pts_time) <= 45.0
  OR pts_time BETWEEN start_sec AND end_sec THEN 1 ELSE 0 END::BIGINT AS is_near FROM ({_POINTS}) p JOIN segments s USING (video_id)""")
def _(t):
    out = I.near_flags(_points(t), t.segments, ["query_id"])
    return out.select("query_id", "video_id", "segment_id", F.col("is_near").cast("int").cast(B).alias("is_near"))


@query("flt_ocr_context", f"""
SELECT query_id, video_id, line_id, is_near::BIGINT AS is_near FROM (
  SELECT p.query_id, o.video_id, line_id, CASE WHEN abs(t_sec - pts_time) <= 2.0 THEN 1 ELSE 0 END AS is_near,
    max(CASE WHEN abs(t_sec - pts_time) <= 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS has_any,
    row_number() OVER (PARTITION BY query_id ORDER BY t_sec, line_id) AS rn
  FROM ({_POINTS}) p JOIN ocr_lines o USING (video_id)) WHERE is_near = 1 OR (has_any = 0 AND rn <= 30)""")
def _(t):
    out = I.screen_context(_points(t), t.ocr_lines, ["query_id"], window=2.0)
    return out.select("query_id", "video_id", "line_id", F.col("is_near").cast("int").cast(B).alias("is_near"))


@query("flt_clip_range", """
SELECT event_id, CASE WHEN s IS NULL OR e IS NULL THEN 'missing' WHEN try_cast(s AS DOUBLE) IS NULL OR try_cast(e AS DOUBLE) IS NULL THEN 'not_a_number'
  WHEN NOT isfinite(s::DOUBLE) OR NOT isfinite(e::DOUBLE) THEN 'not_finite' WHEN s::DOUBLE < 0 OR e::DOUBLE <= s::DOUBLE THEN 'inverted' ELSE 'ok' END AS code
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'soon' WHEN 'error' THEN 'NaN' ELSE value::VARCHAR END AS s,
  json_extract_string(props, '$.k') AS e FROM events)""")
def _(t):
    from cuelight.operators.sequence import clip_range_error

    kind = F.col("event_type")
    s = F.when(kind == "view", None).when(kind == "click", "soon").when(kind == "error", "NaN").otherwise(F.col("value").cast("string"))
    e = t["events"].select("event_id", s.alias("s"), F.get_json_object("props", "$.k").alias("e"))
    return e.select("event_id", F.coalesce(clip_range_error("s", "e"), F.lit("ok")).alias("code"))


@query("flt_sample_range", f"""
WITH v AS (SELECT video_id, max(frame_idx) AS nf, max(frame_idx) / max(fps) AS len FROM keyframes GROUP BY 1),
r AS (SELECT video_id, len, unnest(range(1, 9)) AS try_no FROM v WHERE nf >= 30 AND len >= 3.0)
SELECT video_id, try_no::INT AS try_no, {R("greatest(1.0, len * 0.10) + ('0x' || md5('11:' || video_id || ':' || try_no)[1:8])::BIGINT / 4294967296.0 * (least(len - 1.0, len * 0.90) - greatest(1.0, len * 0.10))")} AS pts_time FROM r""")
def _(t):
    from cuelight.operators.sequence import sample_times

    videos = t.keyframes.groupBy("video_id").agg(F.max("frame_idx").alias("n_frames"), F.max("fps").alias("fps"))
    return sample_times(videos, tries=8, seed=11).select("video_id", "try_no", r6("pts_time").alias("pts_time"))


_SCORED = f"SELECT query_id, kf_id, video_id, pts_time, frame_idx, dense AS score, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, kf_id) AS rank FROM dense_all"


@query("flt_no_answer", f"""
SELECT q.query_id, {R('coalesce(top, 0.0)')} AS top_score, CASE WHEN coalesce(top, 0.0) < 0.35 THEN 1 ELSE 0 END::BIGINT AS abstained FROM lex_queries q
LEFT JOIN (SELECT query_id, max(score) AS top FROM ({_SCORED}) WHERE kf_id <> query_id GROUP BY query_id) USING (query_id)""")
def _(t):
    hits = D.topk(t.queries, t.keyframes, 2).filter(F.col("kf_id") != F.col("query_id"))
    top = hits.groupBy("query_id").agg(F.max("dense").alias("top"))
    s = F.coalesce("top", F.lit(0.0))
    return t.lex_queries.select("query_id").join(top, "query_id", "left").select(
        "query_id", r6(s).alias("top_score"), (s < 0.35).cast("int").cast(B).alias("abstained"))


# ---------------------------------------------------------------- joins

@query("jn_postings", f"""
SELECT query_id, doc_id, term, qtf, tf FROM q_terms JOIN lex_tf USING (term)""")
def _(t):
    q = L.query_terms(t.lex_queries)
    tf = L.term_frequencies(L.tokens_of(t["documents"]), vocabulary=q.select("term").distinct())
    return tf.join(q, "term").select("query_id", "doc_id", "term", "qtf", "tf")


@query("jn_interval_keyframe", """
SELECT doc_id, k.video_id, kf_id FROM docs d JOIN keyframes k ON d.video_id = k.video_id AND pts_time BETWEEN start_sec - 5.0 AND end_sec + 5.0""")
def _(t):
    return I.point_in_interval(t.docs, t.keyframes.select("video_id", "kf_id", "pts_time"), 5.0).select("doc_id", "video_id", "kf_id")


_CLIPS = "SELECT query_id, video_id, pts_time + 20.0 AS clip_start, pts_time + 45.0 AS clip_end FROM (" + _POINTS + ")"


def _clips(t):
    return _points(t).select("query_id", "video_id", (F.col("pts_time") + 20.0).alias("clip_start"), (F.col("pts_time") + 45.0).alias("clip_end"))


@query("jn_interval_overlap", f"""
SELECT query_id, video_id, segment_id, ov::BIGINT AS overlaps FROM (
  SELECT c.query_id, s.video_id, segment_id, CASE WHEN start_sec <= clip_end + 3.0 AND end_sec >= clip_start - 3.0 THEN 1 ELSE 0 END AS ov,
    max(CASE WHEN start_sec <= clip_end + 3.0 AND end_sec >= clip_start - 3.0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS has_any,
    row_number() OVER (PARTITION BY query_id ORDER BY start_sec, segment_id) AS rn
  FROM ({_CLIPS}) c JOIN segments s USING (video_id)) WHERE ov = 1 OR (has_any = 0 AND rn <= 20)""")
def _(t):
    s = t.segments.select("video_id", "segment_id", "start_sec", "end_sec")
    return I.clip_context(_clips(t), s, ["query_id"]).select("query_id", "video_id", "segment_id", F.col("overlaps").cast("int").cast(B).alias("overlaps"))


_LEX_SEG = """SELECT h.query_id, h.rank, d.video_id, d.start_sec, d.end_sec, d.text, h.score FROM doc_deep h JOIN docs d USING (doc_id)"""
_SEM_SEG = f"""SELECT query_id, video_id, start_sec, end_sec, text, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seg_key) AS rank FROM (
  SELECT q.query_id, s.seg_key, s.video_id, s.start_sec, s.end_sec, s.text, {sql_dot('q.embedding', 's.embedding')} AS score FROM text_vectors q, segment_vectors s)) WHERE rank <= 400"""
SQL_LISTS = f"""lexh AS ({_LEX_SEG}), semh AS ({_SEM_SEG}),
lexn AS (SELECT *, score / greatest(1e-6, max(score) OVER (PARTITION BY query_id)) AS s FROM lexh),
semn AS (SELECT *, (score - min(score) OVER (PARTITION BY query_id)) / greatest(1e-6, max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) AS s FROM semh),
lexk AS (SELECT query_id, video_id, floor(start_sec * 100.0 + 0.5)::BIGINT AS start_cs, floor(end_sec * 100.0 + 0.5)::BIGINT AS end_cs,
  arg_max(s, rank) AS s, arg_max(start_sec, rank) AS start_sec, arg_max(end_sec, rank) AS end_sec, arg_max(text, rank) AS text FROM lexn GROUP BY ALL),
semk AS (SELECT query_id, video_id, floor(start_sec * 100.0 + 0.5)::BIGINT AS start_cs, floor(end_sec * 100.0 + 0.5)::BIGINT AS end_cs,
  arg_max(s, rank) AS s, arg_max(start_sec, rank) AS start_sec, arg_max(end_sec, rank) AS end_sec, arg_max(text, rank) AS text FROM semn GROUP BY ALL),
uni AS (SELECT query_id, video_id, start_cs, end_cs, coalesce(l.s, 0.0) AS bm25, coalesce(m.s, 0.0) AS semantic, l.s IS NOT NULL AS in_l, m.s IS NOT NULL AS in_s,
  coalesce(l.start_sec, m.start_sec) AS start_sec, coalesce(l.end_sec, m.end_sec) AS end_sec, coalesce(l.text, m.text) AS text
  FROM lexk l FULL JOIN semk m USING (query_id, video_id, start_cs, end_cs))"""


def lists(t, top_k: int = 200):
    """The lexical and the semantic hit list of every benchmark text over the segments, twice as deep as the result."""
    # three passes read the documents, so they are put in order once
    docs = reliable(t.docs)
    lex = L.bm25(t.lex_queries, docs, 2 * top_k).join(docs, "doc_id")
    sem = D.topk(t.text_vectors, t.segment_vectors, 2 * top_k, "seg_key").select("query_id", "seg_key", F.col("dense").alias("score"), "rank").join(
        t.segment_vectors.drop("embedding"), "seg_key")
    cols = ["query_id", "rank", "video_id", "start_sec", "end_sec", "text", "score"]
    return lex.select(*cols), sem.select(*cols)


@query("jn_fuse_full", f"WITH {SQL_LISTS} SELECT query_id, video_id, start_cs, end_cs, {R('bm25')} AS bm25, {R('semantic')} AS semantic FROM uni")
def _(t):
    lex, sem = lists(t)
    f = X.fuse_lists(X.calibrate_max(lex), X.calibrate_minmax(sem))
    return f.select("query_id", "video_id", "start_cs", "end_cs", r6("bm25").alias("bm25"), r6("semantic").alias("semantic"))


@query("st_key_union", f"WITH {SQL_LISTS} SELECT query_id, video_id, start_cs, end_cs, in_l::INT::BIGINT AS in_lexical, in_s::INT::BIGINT AS in_semantic FROM uni")
def _(t):
    lex, sem = lists(t)
    flag = lambda c: F.col(c).cast("int").cast(B).alias(c)
    return X.fuse_lists(lex, sem).select("query_id", "video_id", "start_cs", "end_cs", flag("in_lexical"), flag("in_semantic"))


_SHIFTED = "SELECT kf_id, video_id, pts_time + 30.0 AS pts_time FROM keyframes"
SQL_SPOKEN = """SELECT {keys}, arg_min(txt, (tier, d, start_sec, segment_id)) AS spoken FROM (
  SELECT {pkeys}, 0 AS tier, 0.0 AS d, start_sec, segment_id, s.text AS txt FROM {points} p JOIN segments s ON p.video_id = s.video_id
    AND p.pts_time BETWEEN start_sec - 1.5 AND end_sec + 1.5
  UNION ALL SELECT {pkeys}, 1, abs((start_sec + end_sec) / 2.0 - p.pts_time), start_sec, segment_id, '[' || printf('%.1f', start_sec) || 's] ' || s.text
  FROM {points} p JOIN segments s ON p.video_id = s.video_id AND abs((start_sec + end_sec) / 2.0 - p.pts_time) <= 15.0) GROUP BY {keys}"""


@query("jn_asof_active", f"""
WITH pts AS ({_SHIFTED}), sp AS ({SQL_SPOKEN.format(keys='kf_id', pkeys='p.kf_id', points='pts')})
SELECT kf_id, coalesce(spoken, '') AS spoken FROM pts LEFT JOIN sp USING (kf_id)""")
def _(t):
    p = t.keyframes.select("kf_id", "video_id", (F.col("pts_time") + 30.0).alias("pts_time"))
    return I.active_segment(p, t.segments, ["kf_id"]).select("kf_id", "spoken")


SQL_POSITIVE = """SELECT query_id, mark_no, arg_min(kf_id, (miss, d, kf_id)) AS kf_id FROM (
  SELECT m.query_id, m.mark_no, k.kf_id, CASE WHEN k.frame_idx = m.frame_idx THEN 0 ELSE 1 END AS miss,
    CASE WHEN k.frame_idx = m.frame_idx THEN 0.0 ELSE abs(k.pts_time - m.pts_time) END AS d FROM marks m JOIN keyframes k USING (video_id)) GROUP BY ALL"""


@query("jn_nearest_keyframe", f"SELECT query_id, mark_no::BIGINT AS mark_no, kf_id FROM ({SQL_POSITIVE})")
def _(t):
    return I.nearest_row(t.marks, t.keyframes, ["query_id", "mark_no"]).select("query_id", F.col("mark_no").cast(B).alias("mark_no"), "kf_id")


def _cents(sql: str) -> str:
    """C{x} as x rounded to a hundredth."""
    while "C{" in sql:
        a = sql.rindex("C{")
        b = sql.index("}", a)
        sql = f"{sql[:a]}(floor(({sql[a + 2:b]}) * 100.0 + 0.5) / 100.0){sql[b + 1:]}"
    return sql


@query("jn_shot_snap", _cents("""
WITH pts AS (SELECT event_id, 'v' || (user_id % 12) AS video_id, value / 4.0 AS p FROM events),
b AS (SELECT video_id, pts_time, frame_idx FROM keyframes),
x AS (SELECT event_id, pts.video_id, p, max(b.pts_time) AS last, max(CASE WHEN b.pts_time <= p THEN b.pts_time END) AS prev,
  min(CASE WHEN b.pts_time >= p THEN b.pts_time END) AS nxt FROM pts LEFT JOIN b USING (video_id) GROUP BY ALL),
y AS (SELECT *, CASE WHEN last IS NULL THEN greatest(0.0, C{p - 1.5}) ELSE greatest(C{coalesce(prev, 0.0)}, C{p - 1.5}) END AS s,
  CASE WHEN last IS NULL THEN C{p + 1.5} ELSE least(C{coalesce(nxt, last)}, C{p + 1.5}) END AS e0 FROM x),
z AS (SELECT event_id, video_id, s AS start_sec, CASE WHEN last IS NOT NULL AND e0 <= s THEN C{s + 1.5} ELSE e0 END AS end_sec FROM y)
SELECT z.event_id, z.video_id, """ + R("start_sec") + """ AS start_sec, """ + R("end_sec") + """ AS end_sec, coalesce(string_agg(frame_idx::VARCHAR, ',' ORDER BY pts_time), '') AS frames
FROM z LEFT JOIN b ON z.video_id = b.video_id AND b.pts_time BETWEEN start_sec AND end_sec GROUP BY ALL"""))
def _(t):
    p = t["events"].select("event_id", F.concat(F.lit("v"), F.col("user_id") % 12).alias("video_id"), (F.col("value") / 4.0).alias("pts_time"))
    s = I.shot_bounds(p, t.keyframes, ["event_id"])
    return s.select("event_id", "video_id", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"),
                    F.array_join(F.transform("frames", lambda f: f.cast("string")), ",").alias("frames"))


@query("jn_exclude_windows", """
SELECT event_id FROM (SELECT event_id, 'v' || user_id AS video_id, value AS p FROM events) e
WHERE NOT EXISTS (SELECT 1 FROM truth w WHERE w.video_id = e.video_id AND e.p BETWEEN w.start_sec - 5.0 AND w.end_sec + 5.0)""")
def _(t):
    p = t["events"].select("event_id", F.concat(F.lit("v"), "user_id").alias("video_id"), F.col("value").alias("pts_time"))
    return I.outside_windows(p, t.truth, ["event_id"]).select("event_id")


_HITS = f"""SELECT DISTINCT r.query_id, r.rank, r.kf_id FROM ({_SCORED}) r JOIN truth g ON r.query_id = g.query_id AND r.video_id = g.video_id
  AND (list_contains(g.frames, r.frame_idx) OR (g.start_sec >= 0 AND g.end_sec >= 0 AND r.pts_time >= 0 AND r.pts_time BETWEEN g.start_sec AND g.end_sec)) WHERE r.rank <= 50"""


def scored(t, k=50):
    return D.topk(t.queries, t.keyframes, k).join(t.keyframes.select("kf_id", "video_id", "pts_time", "frame_idx"), "kf_id").select(
        "query_id", "rank", "kf_id", "video_id", "pts_time", "frame_idx", F.col("dense").alias("score"))


@query("jn_gt_hit", f"SELECT query_id, rank::BIGINT AS rank, kf_id FROM ({_HITS})")
def _(t):
    return I.judged_hits(scored(t), t.truth).select("query_id", F.col("rank").cast(B).alias("rank"), "kf_id")


@query("jn_hard_negative", f"""
SELECT q.query_id, CASE WHEN EXISTS (SELECT 1 FROM ({_SCORED}) r JOIN marks m ON r.query_id = m.query_id AND r.video_id = m.video_id
  AND r.pts_time BETWEEN m.pts_time - 40.0 AND m.pts_time + 40.0 WHERE r.rank = 1 AND r.query_id = q.query_id) THEN 1 ELSE 0 END::BIGINT AS trapped FROM lex_queries q""")
def _(t):
    neg = _traps(t)
    hit = I.judged_hits(scored(t, 1), neg).select("query_id").distinct().withColumn("trapped", F.lit(1).cast(B))
    return t.lex_queries.select("query_id").join(hit, "query_id", "left").na.fill(0, ["trapped"])


def _traps(t):
    return t.marks.select("query_id", "video_id", F.greatest(F.lit(0.0), F.col("pts_time") - 40.0).alias("start_sec"),
                          (F.col("pts_time") + 40.0).alias("end_sec"), F.array().cast("array<bigint>").alias("frames"))


@query("jn_hard_negative_mining", """
SELECT DISTINCT g.query_id, s.video_id, s.segment_id FROM truth g JOIN segments s ON g.video_id = s.video_id AND s.start_sec <= g.end_sec + 30.0 AND s.end_sec >= g.start_sec - 30.0
WHERE NOT (s.start_sec <= g.end_sec AND s.end_sec >= g.start_sec)""")
def _(t):
    return I.hard_negatives(t.truth, t.segments).select("query_id", "video_id", "segment_id")


SQL_OBJ = """obj AS (SELECT lower(trim(entity)) AS entity, video_id, keyframe, max(score) AS score FROM detections WHERE score >= 0.3 GROUP BY ALL),
otok AS (SELECT query_id, entity, count(*) AS q FROM (SELECT query_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS entity FROM object_queries) GROUP BY ALL),
ohit AS (SELECT query_id, kf_id, sum(score * q) AS s FROM otok JOIN obj USING (entity) JOIN keyframes USING (video_id, keyframe) GROUP BY ALL),
onorm AS (SELECT query_id, kf_id, s / max(s) OVER (PARTITION BY query_id) AS object FROM ohit)"""


@query("jn_object_entity", f"WITH {SQL_OBJ} SELECT query_id, kf_id, {R('object')} AS object FROM onorm")
def _(t):
    return TR.entity_boost(t.object_queries, TR.object_scores(t.detections), t.keyframes).select("query_id", "kf_id", r6("object").alias("object"))


SQL_OKAPI = f"""ptok AS (SELECT video_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS toks FROM video_pieces),
plen AS (SELECT video_id, sum(len(toks)) AS dl FROM ptok GROUP BY 1), pstat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM plen),
ptf AS (SELECT video_id, term, count(*) AS tf FROM (SELECT video_id, unnest(toks) AS term FROM ptok) GROUP BY ALL),
pidf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM ptf GROUP BY 1), pstat),
pfloor AS (SELECT avg(idf) * 0.25 AS f FROM pidf),
pq AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM QUERIES_HERE) GROUP BY ALL),
pscore AS (SELECT query_id, video_id, {G('sum(qtf * CASE WHEN idf < 0 THEN f ELSE idf END * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * (dl / avgdl))))')} AS score
  FROM pq JOIN pidf USING (term) JOIN ptf USING (term) JOIN plen USING (video_id), pstat, pfloor GROUP BY ALL),
pmeta AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS rank FROM pscore WHERE score > 0) WHERE rank <= 100)"""


@query("ag_bm25_okapi", f"WITH {SQL_OKAPI.replace('QUERIES_HERE', 'lex_queries')} SELECT query_id, video_id, rank::BIGINT AS rank, {R('score')} AS score FROM pmeta WHERE rank <= 50")
def _(t):
    return L.okapi(t.lex_queries, t.video_pieces, 50).select("query_id", "video_id", F.col("rank").cast(B).alias("rank"), r6("score").alias("score"))


@query("jn_video_metadata", f"""
WITH {SQL_OKAPI.replace('QUERIES_HERE', 'lex_queries')} SELECT query_id, kf_id, {R('score / m')} AS meta
FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM pmeta) JOIN keyframes USING (video_id)""")
def _(t):
    from cuelight.plans.hybrid import metadata_boost

    return metadata_boost(t.lex_queries, t.video_pieces).join(t.keyframes.select("video_id", "kf_id"), "video_id").select("query_id", "kf_id", r6("meta").alias("meta"))


def _frame_map(t):
    return t.keyframes.select("video_id", F.col("n").alias("row_no"), (F.col("n") * 2 - 1).alias("n"), "pts_time", "fps", "frame_idx")


@query("jn_frame_info", """
SELECT e.event_id, coalesce(n * 2 - 1, k + 1) AS n, coalesce(pts_time, k::DOUBLE) AS pts_time, coalesce(fps, 30.0) AS fps, coalesce(frame_idx, k * 30) AS frame_idx
FROM (SELECT event_id, 'v' || user_id AS video_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events) e LEFT JOIN keyframes m ON e.video_id = m.video_id AND e.k = m.n - 1""")
def _(t):
    w = t["events"].select("event_id", F.concat(F.lit("v"), "user_id").alias("video_id"), F.get_json_object("props", "$.k").cast(B).alias("position"))
    return I.frame_info(w, _frame_map(t)).drop("position", "video_id")


@query("jn_frame_by_name", """
WITH w AS (SELECT event_id, 'v' || user_id AS video_id, CASE WHEN event_type = 'error' THEN 1 ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events),
m AS (SELECT video_id, n AS row_no, n * 2 - 1 AS n, frame_idx FROM keyframes), sz AS (SELECT video_id, count(*) AS c FROM m GROUP BY 1)
SELECT event_id, coalesce(x.frame_idx, y.frame_idx, k * 30) AS frame_idx FROM w LEFT JOIN m x ON w.video_id = x.video_id AND w.k = x.n
LEFT JOIN sz ON w.video_id = sz.video_id LEFT JOIN m y ON w.video_id = y.video_id AND y.row_no = least(k, c)""")
def _(t):
    name = F.when(F.col("event_type") == "error", "cover.jpg").otherwise(F.concat(F.lpad(F.get_json_object("props", "$.k"), 3, "0"), F.lit(".jpg")))
    w = t["events"].select("event_id", F.concat(F.lit("v"), "user_id").alias("video_id"), name.alias("name"))
    return I.frame_by_name(w, _frame_map(t)).select("event_id", "frame_idx")


@query("jn_context_neighbours", """
SELECT a.video_id, a.segment_id, b.segment_id AS neighbour FROM segments a JOIN segments b ON a.video_id = b.video_id AND b.position BETWEEN a.position - 1 AND a.position + 1""")
def _(t):
    s = t.segments.select("video_id", "segment_id", "position")
    visits = s.withColumn("position", F.explode(F.sequence(F.col("position") - 1, F.col("position") + 1)))
    return visits.join(s.withColumnRenamed("segment_id", "neighbour"), ["video_id", "position"]).select("video_id", "segment_id", "neighbour")


SQL_SEM = f"""semr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, seg_key) AS rank FROM (
  SELECT q.query_id, s.*, {sql_dot('q.embedding', 's.embedding')} AS dense FROM text_vectors q, (SELECT * EXCLUDE (embedding), embedding FROM segment_vectors) s))"""
SQL_RERANK = f"""{SQL_SEM}, rr0 AS (SELECT s.query_id, s.video_id, s.segment_id, s.start_sec, s.end_sec, s.text, s.dense, s.rank AS dense_rank,
  len(list_intersect(list_distinct(qt), list_distinct(dt))) / greatest(1, len(list_distinct(qt))) AS rerank_score FROM (
    SELECT s.*, {sql_tokens('trim(q.text)')} AS qt, {sql_tokens('trim(s.text)')} AS dt FROM semr s JOIN lex_queries q USING (query_id) WHERE rank <= 30) s),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, dense_rank) AS rank FROM rr0)"""


def reranked(t, k=30):
    sem = D.topk(t.text_vectors, t.segment_vectors, 30, "seg_key").select("query_id", "seg_key", "dense", "rank").join(
        t.segment_vectors.drop("embedding"), "seg_key")
    with_query = sem.join(t.lex_queries.withColumnRenamed("text", "query"), "query_id")
    return X.rerank(with_query, X.overlap_score, k)


@query("rt_rerank", f"WITH {SQL_RERANK} SELECT query_id, video_id, segment_id, rank::BIGINT AS rank, {R('rerank_score')} AS rerank_score, {R('dense')} AS dense FROM rr WHERE rank <= 5")
def _(t):
    return reranked(t, 5).select("query_id", "video_id", "segment_id", F.col("rank").cast(B).alias("rank"), r6("rerank_score").alias("rerank_score"), r6("dense").alias("dense"))


@query("jn_rank_shift", f"WITH {SQL_RERANK} SELECT query_id, video_id, segment_id, (dense_rank - rank)::BIGINT AS shift FROM rr")
def _(t):
    return reranked(t).select("query_id", "video_id", "segment_id", (F.col("dense_rank") - F.col("rank")).cast(B).alias("shift"))


# ---------------------------------------------------------------- aggregates

@query("ag_tf", "SELECT doc_id, term, tf FROM lex_tf")
def _(t):
    return L.term_frequencies(L.tokens_of(t["documents"])).select("doc_id", "term", "tf")


@query("ag_df_avgdl", f"SELECT term, df, n_docs, {R('avgdl')} AS avgdl FROM doc_df, doc_stats")
def _(t):
    i = L.build_index(t.docs)
    c = i.corpus.select(F.struct("n_docs", "avgdl")).scalar()
    return i.term_stats.select("term", "df", c["n_docs"].alias("n_docs"), r6(c["avgdl"]).alias("avgdl"))


@query("ag_bm25", f"SELECT query_id, doc_id, rank::BIGINT AS rank, {R('score')} AS score FROM lex_hits")
def _(t):
    return L.bm25(t.lex_queries, t["documents"]).select("query_id", "doc_id", F.col("rank").cast(B).alias("rank"), r6("score").alias("score"))


@query("tk_bm25", "SELECT query_id, doc_id, rank::BIGINT AS rank FROM doc_hits")
def _(t):
    return L.bm25(t.lex_queries, t.docs).select("query_id", "doc_id", F.col("rank").cast(B).alias("rank"))


@query("tk_block_max", f"SELECT query_id, doc_id, rank::BIGINT AS rank, {R('score')} AS score FROM doc_hits WHERE rank <= 10")
def _(t):
    # from the stored index, whose blocks below a query's threshold are not opened
    found = BM.search(t.lex_queries, t.block_index(), 10)
    return found.select("query_id", "doc_id", F.col("rank").cast(B).alias("rank"), r6("score").alias("score"))


@query("ag_concat_text", """
SELECT video_id, floor(doc_id / 1000.0)::BIGINT AS part_no, string_agg(text, ' ' ORDER BY doc_id) AS text FROM video_pieces GROUP BY ALL""")
def _(t):
    return TR.concat_text(t.video_pieces, "video_id", "doc_id")


SQL_BEST = """SELECT query_id, kf_id, max(s) AS score, arg_max(text, (s, -rank)) AS text FROM (
  SELECT h.query_id, k.kf_id, h.score / (25.0 + h.score) AS s, h.rank, d.text FROM doc_hits h JOIN docs d USING (doc_id)
  JOIN keyframes k ON d.video_id = k.video_id AND pts_time BETWEEN start_sec - 5.0 AND end_sec + 5.0) WHERE s > 0 GROUP BY ALL"""


@query("ag_max_per_keyframe", f"SELECT query_id, kf_id, {R('score')} AS score, text FROM ({SQL_BEST})")
def _(t):
    from cuelight.plans.search import Corpus, lexical_evidence

    # the search and the texts of its hits read documents that are put in order once
    out = lexical_evidence(t.lex_queries, Corpus(t.keyframes, reliable(t.docs), t.segments), 5.0, calibration="plain")
    return out.select("query_id", "kf_id", r6("score").alias("score"), "text")


SQL_SEMBEST = """SELECT query_id, kf_id, max(s) AS score, arg_max(text, (s, -rank)) AS text FROM (
  SELECT h.query_id, k.kf_id, least(greatest((dense - 0.70) / 0.20, 0.0), 1.0) AS s, h.rank, h.text FROM semr h
  JOIN keyframes k ON h.video_id = k.video_id AND pts_time BETWEEN start_sec - 5.0 AND end_sec + 5.0 WHERE h.rank <= 300) WHERE s > 0 GROUP BY ALL"""


@query("ag_text_precedence", f"""
WITH {SQL_SEM}, a AS ({SQL_BEST}), b AS ({SQL_SEMBEST})
SELECT query_id, kf_id, {R('greatest(coalesce(a.score, 0.0), coalesce(b.score, 0.0))')} AS score, coalesce(a.text, b.text) AS text FROM a FULL JOIN b USING (query_id, kf_id)""")
def _(t):
    from cuelight.plans.search import Corpus, lexical_evidence, merge_evidence, semantic_evidence

    q = t.lex_queries.join(t.text_vectors.withColumnRenamed("embedding", "text_vector"), "query_id")
    c = Corpus(t.keyframes, reliable(t.docs), t.segments.join(t.segment_vectors.select("video_id", "segment_id", "embedding"), ["video_id", "segment_id"]), True)
    out = merge_evidence(lexical_evidence(q, c, 5.0, calibration="plain"), semantic_evidence(q, c, 5.0))
    return out.select("query_id", "kf_id", r6("score").alias("score"), "text")


@query("ag_object_max", f"""
SELECT lower(trim(entity)) AS entity, video_id, keyframe, {R('max(score)')} AS score FROM detections WHERE score >= 0.3 GROUP BY ALL""")
def _(t):
    return TR.object_scores(t.detections).withColumn("score", r6("score"))


@query("ag_object_list", f"""
SELECT video_id, keyframe, count(*) AS n, string_agg(entity, ',' ORDER BY entity, score) AS entities FROM detections WHERE score >= 0.3 GROUP BY ALL""")
def _(t):
    d = TR.object_lists(t.detections)
    return d.select("video_id", "keyframe", F.size("detections").cast(B).alias("n"), F.array_join(F.transform("detections", lambda x: x["entity"]), ",").alias("entities"))


@query("ag_video_max", f"SELECT query_id, video_id, {R('max(dense)')} AS best FROM dense_all GROUP BY ALL")
def _(t):
    return D.topk(t.queries, t.keyframes, 1, group="video_id").select("query_id", "video_id", r6("dense").alias("best"))


SQL_MEAN = """SELECT {key}, list(m / CASE WHEN nn > 1e-12 THEN nn ELSE 1.0 END ORDER BY p) AS embedding FROM (
  SELECT {key}, p, m, sqrt(sum(m * m) OVER (PARTITION BY {key})) AS nn FROM (
    SELECT {key}, p, avg(x) AS m FROM (SELECT {key}, unnest(range(len(embedding))) AS p, unnest(embedding) AS x FROM {src}) GROUP BY ALL)) GROUP BY {key}"""


@query("ag_mean_vector", f"""
SELECT video_id, p::BIGINT AS p, {R('x')} AS x FROM (SELECT video_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS x FROM ({SQL_MEAN.format(key='video_id', src='keyframes')}))""")
def _(t):
    m = D.mean_vectors(t.keyframes, ["video_id"])
    return m.select("video_id", F.posexplode("embedding").alias("p", "x")).select("video_id", F.col("p").cast(B).alias("p"), r6("x").alias("x"))


SQL_FIRST = f"""fh AS (SELECT query_id, min(rank) AS first_hit FROM ({_HITS}) GROUP BY 1),
fm AS (SELECT q.query_id, first_hit, CASE WHEN length(q.text) > 200 THEN 'long' ELSE 'short' END AS category,
  CASE WHEN first_hit <= 1 THEN 1.0 ELSE 0.0 END AS r1, CASE WHEN first_hit <= 5 THEN 1.0 ELSE 0.0 END AS r5, CASE WHEN first_hit <= 10 THEN 1.0 ELSE 0.0 END AS r10,
  CASE WHEN first_hit <= 25 THEN 1.0 ELSE 0.0 END AS r25, CASE WHEN first_hit <= 50 THEN 1.0 ELSE 0.0 END AS r50, coalesce(1.0 / first_hit, 0.0) AS mrr,
  CASE WHEN first_hit <= 5 THEN 1.0 / log2(first_hit + 1) ELSE 0.0 END AS ndcg5 FROM lex_queries q LEFT JOIN fh USING (query_id))"""


def categories(t):
    return t.lex_queries.select("query_id", F.when(F.length("text") > 200, "long").otherwise("short").alias("category"))


def first_hits(t):
    return E.first_hits(I.judged_hits(scored(t), t.truth), categories(t))


_M = ["r1", "r5", "r10", "r25", "r50", "mrr", "ndcg5"]


@query("ev_first_hit", f"WITH {SQL_FIRST} SELECT query_id, first_hit, category, {', '.join(f'{R(m)} AS {m}' for m in _M)} FROM fm")
def _(t):
    return first_hits(t).select("query_id", "first_hit", "category", *[r6(m).alias(m) for m in _M])


@query("ag_eval_mean", f"WITH {SQL_FIRST} SELECT category, count(*) AS n_queries, {', '.join(f'{R(f'avg({m})')} AS {m}' for m in _M)} FROM fm GROUP BY 1")
def _(t):
    return E.means(first_hits(t), ("category",)).select("category", "n_queries", *[r6(m).alias(m) for m in _M])


@query("ag_eval_rollup", f"""
WITH {SQL_FIRST} SELECT 'dense' AS config, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS n,
  {R('count(*) * 100.0 / (SELECT count(*) FROM fm)')} AS pct, {', '.join(f'{R(f'avg({m})')} AS {m}' for m in ('r1', 'r5', 'r10', 'r25', 'mrr'))} FROM fm GROUP BY ROLLUP(category)""")
def _(t):
    out = E.rollup_by_category(first_hits(t).withColumn("config", F.lit("dense")))
    return out.select("config", "category", "n", r6("pct").alias("pct"), *[r6(m).alias(m) for m in ("r1", "r5", "r10", "r25", "mrr")])


@query("ag_no_answer", f"""
WITH r AS (SELECT * FROM ({_SCORED}) WHERE kf_id <> query_id), top AS (SELECT query_id, max(score) AS s FROM r GROUP BY 1),
tr AS (SELECT DISTINCT x.query_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kf_id) AS rk FROM r) x JOIN marks m
  ON x.query_id = m.query_id AND x.video_id = m.video_id AND x.pts_time BETWEEN greatest(0.0, m.pts_time - 40.0) AND m.pts_time + 40.0 WHERE rk = 1)
SELECT count(*) AS n, {R('avg(CASE WHEN coalesce(s, 0.0) < 0.35 THEN 1.0 ELSE 0.0 END)')} AS no_answer_accuracy,
  {R('avg(CASE WHEN coalesce(s, 0.0) < 0.35 THEN 0.0 ELSE 1.0 END)')} AS false_positive_rate,
  {R('avg(CASE WHEN tr.query_id IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS hard_negative_trap_rate, {R('avg(coalesce(s, 0.0))')} AS avg_top_score
FROM lex_queries q LEFT JOIN top USING (query_id) LEFT JOIN tr ON q.query_id = tr.query_id""")
def _(t):
    r = D.topk(t.queries, t.keyframes, 2).filter(F.col("kf_id") != F.col("query_id")).join(
        t.keyframes.select("kf_id", "video_id", "pts_time", "frame_idx"), "kf_id").drop("rank").withColumnRenamed("dense", "score")
    top = top_k(r, ["query_id"], [F.desc("score"), F.asc("kf_id")], 1)
    out = E.abstention_rates(E.abstentions(t.lex_queries.select("query_id"), top, _traps(t)))
    return out.select("n", *[r6(c).alias(c) for c in out.columns if c != "n"])


SQL_PROFILE = r"""vid AS (SELECT video_id, count(*) AS n_segments, sum(w)::BIGINT AS words, (floor(100 * 1.35) + 10 + floor((sum(w) + count(*) * 2) * 1.35) + 10)::BIGINT AS tokens_est FROM (
  SELECT video_id, len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) AS w FROM SEGS) GROUP BY 1)"""


@query("ag_corpus_stats", f"""
WITH {SQL_PROFILE.replace('SEGS', 'segments')} SELECT count(*) AS n_videos, sum(n_segments)::BIGINT AS n_segments, sum(words)::BIGINT AS words, sum(tokens_est)::BIGINT AS tokens_est,
  {R('avg(words)')} AS avg_words, {R('avg(tokens_est)')} AS avg_tokens, {R('avg(n_segments)')} AS avg_segments,
  count(*) FILTER (words = 0) AS n_empty, count(*) FILTER (tokens_est > 6000) AS n_long FROM vid""")
def _(t):
    out = TR.profile_corpus(TR.profile_videos(t.segments, 100))
    return out.select(*[r6(c).alias(c) if c.startswith("avg") else c for c in out.columns])


@query("ag_video_facet", f"SELECT query_id, video_id, count(*) AS n FROM ({_SCORED}) WHERE rank <= 50 GROUP BY ALL")
def _(t):
    return scored(t).groupBy("query_id", "video_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query("ag_query_progress", f"""
SELECT mode, count(*) AS n, count(*) FILTER (saved) AS n_saved FROM (
  SELECT d.doc_id, CASE WHEN doc_id % 7 = 0 THEN 'qa' WHEN doc_id % 7 = 1 THEN 'trake' ELSE 'kis' END AS mode, l.doc_id IS NOT NULL AS saved
  FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY mode""")
def _(t):
    d = F.col("doc_id")
    name = F.concat(d.cast("string"), F.when(d % 7 == 0, "-qa").when(d % 7 == 1, "_trake").otherwise(""), F.lit(".txt"))
    saved = t["labels"].select("doc_id", F.lit("saved").alias("status"))
    q = t["documents"].select("doc_id", T.query_mode(name, F.lit("")).alias("mode")).join(saved, "doc_id", "left")
    return q.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "saved").alias("n_saved"))


@query("ag_manifest_report", f"""
SELECT count(*) AS n_videos, count(*) FILTER (ok) AS n_success, count(*) FILTER (NOT ok) AS n_failed, {R('coalesce(avg(CASE WHEN ok THEN value END), 0.0)')} AS avg_latency,
  {R('coalesce(avg(CASE WHEN ok THEN k END), 0.0)')} AS avg_tokens, coalesce(sum(CASE WHEN ok THEN k END), 0)::BIGINT AS total_tokens
FROM (SELECT event_type <> 'error' AS ok, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""")
def _(t):
    m = t["events"].select(
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "completed_empty").otherwise("completed").alias("status"),
        F.col("value").alias("latency_sec"), F.get_json_object("props", "$.k").cast(B).alias("total_tokens"))
    out = TR.manifest_report(m)
    return out.select("n_videos", "n_success", "n_failed", r6("avg_latency").alias("avg_latency"), r6("avg_tokens").alias("avg_tokens"), "total_tokens")


# ---------------------------------------------------------------- the end-to-end slice

@query("ev_lexical_slice", f"""
WITH hits AS (SELECT query_id, doc_id, rank FROM lex_hits WHERE rank <= 10),
fh AS (SELECT h.query_id, min(rank) AS first_hit FROM hits h JOIN qrels USING (query_id, doc_id) GROUP BY 1)
SELECT query_id, first_hit, {R('CASE WHEN first_hit <= 1 THEN 1.0 ELSE 0.0 END')} AS r1, {R('CASE WHEN first_hit <= 5 THEN 1.0 ELSE 0.0 END')} AS r5, {R('coalesce(1.0 / first_hit, 0.0)')} AS mrr
FROM (SELECT DISTINCT query_id FROM qrels) LEFT JOIN fh USING (query_id)""")
def _(t):
    hits = L.bm25(t.lex_queries, t["documents"], 10)
    # the judgements take a scan of all texts and are read twice
    qrels = reliable(t.qrels)
    judged = hits.join(qrels, ["query_id", "doc_id"], "left_semi")
    out = E.first_hits(judged, qrels.select("query_id").distinct())
    return out.select("query_id", "first_hit", r6("r1").alias("r1"), r6("r5").alias("r5"), r6("mrr").alias("mrr"))
