"""Windows, top-k, sets, vectors, fusion, search and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelight.catalog.base import G, R, Tables, letter_counts, letter_profile, query, r6, sql_dot, sql_letter_counts, sql_tokens
from cuelight.catalog.relational import (
    _SCORED, SQL_BEST, SQL_LISTS, SQL_MEAN, SQL_OBJ, SQL_OKAPI, SQL_POSITIVE, SQL_PROFILE, SQL_RERANK, SQL_SEM, SQL_SEMBEST,
    SQL_SPOKEN, lists, reranked, scored,
)
from cuelight.functions import lexicon as lx
from cuelight.functions import numeric as N
from cuelight.operators import cells as C
from cuelight.operators import dense as D
from cuelight.operators import fusion as X
from cuelight.operators import intervals as I
from cuelight.operators import lexical as L
from cuelight.operators import sequence as S
from cuelight.operators import transcripts as TR
from cuelight.operators.ordered import gaussian, prefix_max, top_k, with_position
from cuelight.session import reliable

B = "bigint"
big = lambda c: F.col(c).cast(B).alias(c)
six = lambda c: r6(c).alias(c)


# ---------------------------------------------------------------- windows

@query("wn_rank", f"SELECT query_id, kf_id, rank::BIGINT AS rank, {R('score')} AS score FROM ({_SCORED}) WHERE rank <= 100")
def _(t: Tables):
    return scored(t, 100).select("query_id", "kf_id", big("rank"), six("score"))


_W = N.gaussian_weights()


@query("wn_gauss", f"""
SELECT query_id, kf_id, {R(' + '.join(f'{w!r} * coalesce(' + ', '.join(f'{"lag" if d < 0 else "lead"}(dense, {k}) OVER w' for k in range(abs(d), 0, -1)) + (', ' if d else '') + 'dense)' for d, w in zip(range(-2, 3), _W)))} AS smooth
FROM dense_all WINDOW w AS (PARTITION BY query_id, video_id ORDER BY n)""")
def _(t):
    s = D.all_scores(t.queries, t.keyframes, ("kf_id", "video_id", "n"))
    return gaussian(s, ["query_id", "video_id"], "n", "dense", "smooth").select("query_id", "kf_id", six("smooth"))


@query("wn_ocr_runs", f"SELECT video_id, run_id, {R('start_sec')} AS start_sec, {R('end_sec')} AS end_sec, text, n_lines FROM ocr_runs")
def _(t):
    return t.ocr_runs.select("video_id", "run_id", six("start_sec"), six("end_sec"), "text", "n_lines")


@query("wn_subscene_pool", f"SELECT query_id, kf_id, {R('norm * 0.35 + (top1 * 0.70 + (top1 + top2) / 2.0 * 0.30) * 0.65')} AS norm, best_scene::BIGINT AS best_scene FROM dense_norm JOIN scene_pool USING (query_id, kf_id) WHERE n_scenes > 1")
def _(t):
    kf = t.keyframes
    keyed = t.scenes.select(F.to_json(F.struct("query_id", "scene_no")).alias("query_id"), "embedding", F.struct("query_id", "scene_no").alias("k"))
    sc = D.all_scores(keyed, kf).join(D.ranges(keyed, kf), "query_id").join(keyed.select("query_id", "k"), "query_id").select(
        F.col("k.query_id").alias("query_id"), F.col("k.scene_no").alias("scene_no"), "kf_id", N.minmax("dense", "lo", "hi").alias("norm"))
    whole = D.all_scores(t.queries, kf).join(D.ranges(t.queries, kf), "query_id").select("query_id", "kf_id", N.minmax("dense", "lo", "hi").alias("norm"))
    return X.pooled_scenes(sc, whole).select("query_id", "kf_id", six("norm"), big("best_scene"))


SQL_RAW = f"rawr AS ({_SCORED})"


@query("wn_shot_bucket", f"""
WITH {SQL_RAW}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, floor(pts_time / 2.5) ORDER BY score DESC, kf_id) > 1 AS again FROM rawr WHERE rank <= 200)
SELECT query_id, kf_id, rank::BIGINT AS rank FROM (SELECT query_id, kf_id, row_number() OVER (PARTITION BY query_id ORDER BY again, score DESC, kf_id) AS rank FROM b) WHERE rank <= 180""")
def _(t):
    return X.shot_buckets(scored(t, 200).drop("rank"), 180).select("query_id", "kf_id", big("rank"))


@query("wn_running_max", f"""
SELECT query_id, kf_id, {R('max(dense) OVER (PARTITION BY query_id, video_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')} AS before FROM dense_all""")
def _(t):
    s = D.all_scores(t.queries, t.keyframes, ("kf_id", "video_id", "n"))
    return prefix_max(s, ["query_id", "video_id"], ["n"], F.floor(F.col("n") / 4096), "dense", "before").select("query_id", "kf_id", six("before"))


@query("wn_neighbour_text", r"""
WITH p AS (SELECT 'c' || conv_id AS video_id, turn AS segment_id, turn * 2.0 + CASE WHEN turn >= 3 THEN 20.0 ELSE 0.0 END AS start_sec, text FROM conversations),
q AS (SELECT *, start_sec + 1.5 AS end_sec, row_number() OVER (PARTITION BY video_id ORDER BY segment_id) AS position FROM p),
j AS (SELECT a.video_id, a.segment_id, b.start_sec, b.position, trim(b.text) AS text, lag(b.end_sec) OVER (PARTITION BY a.video_id, a.segment_id ORDER BY b.start_sec, b.position) AS prev
  FROM q a JOIN q b ON a.video_id = b.video_id AND b.position BETWEEN a.position - 1 AND a.position + 1)
SELECT video_id, segment_id, trim(regexp_replace(string_agg(CASE WHEN start_sec - prev > 8.0 THEN '... [' || printf('%.1f', start_sec) || 's] ... ' ELSE '' END || text, ' ' ORDER BY start_sec, position), '\s+', ' ', 'g')) AS context
FROM j GROUP BY ALL""")
def _(t):
    k = F.col("turn")
    start = k * 2.0 + F.when(k >= 3, 20.0).otherwise(0.0)
    s = t["conversations"].select(F.concat(F.lit("c"), "conv_id").alias("video_id"), k.alias("segment_id"), start.alias("start_sec"),
                                  (start + 1.5).alias("end_sec"), k.alias("start_frame"), k.alias("end_frame"), "text")
    s = S.with_neighbours(s)
    cand = s.select(F.lit(0).alias("query_id"), F.lit(1).alias("rank"), "video_id", "segment_id", "start_sec", "end_sec")
    cand = cand.withColumn("rank", F.struct("video_id", "segment_id"))
    return S.context_windows(cand, s).select("video_id", "segment_id", "context")


@query("wn_global_idx", "SELECT video_id, kf_id, row_number() OVER (ORDER BY video_id, n) - 1 AS global_idx FROM keyframes")
def _(t):
    from cuelight.sources.readers import global_positions

    k = t.keyframes.select("video_id", "kf_id", (F.col("n") - 1).alias("pos"))
    return global_positions(k).select("video_id", "kf_id", "global_idx")


@query("wn_query_ids", "SELECT doc_id, printf('vis_raw_%04d', (SELECT count(*) FROM benchmark) + row_number() OVER (ORDER BY doc_id)) AS query_id FROM documents")
def _(t):
    n = t["benchmark"].agg(F.count(F.lit(1))).scalar()
    p = with_position(t["documents"].select("doc_id"), [], ["doc_id"], F.floor(F.col("doc_id") / 65536), "p")
    return p.select("doc_id", F.format_string("vis_raw_%04d", F.col("p") + n).alias("query_id"))


_PCT = "[" + ", ".join(str(p) for p in TR.SHORT_PERCENTILES) + "]"


@query("wn_percentile_pick", f"""
WITH s AS (SELECT 'd' || doc_id AS video_id, text FROM documents), {SQL_PROFILE.replace('SEGS', 's')},
r AS (SELECT video_id, words, row_number() OVER (ORDER BY words, video_id) AS pos, count(*) OVER () AS n FROM vid WHERE words > 0),
a AS (SELECT video_id, words, 0 AS s, pos AS o FROM r WHERE list_contains(list_transform({_PCT}, lambda p: floor(n * p)::BIGINT + 1), pos)
  UNION ALL SELECT * FROM (SELECT video_id, words, 1, pos FROM r ORDER BY abs(words - 1565), words, video_id LIMIT 10)
  UNION ALL SELECT video_id, words, 2, pos FROM r WHERE list_contains(list_transform(range(10), lambda i: n - i * 5), pos)),
f AS (SELECT video_id, words, min((s, o)) AS place FROM a GROUP BY ALL)
SELECT video_id, words, pick_no FROM (SELECT video_id, words, row_number() OVER (ORDER BY place) AS pick_no FROM f) WHERE pick_no <= 30""")
def _(t):
    v = TR.profile_videos(t["documents"].select(F.concat(F.lit("d"), "doc_id").alias("video_id"), "text"))
    return TR.validation_subset(v)


# ---------------------------------------------------------------- top-k and sets

@query("tk_dense", f"SELECT query_id, kf_id, rank::BIGINT AS rank FROM ({_SCORED}) WHERE rank <= 100")
def _(t):
    return D.topk(t.queries, t.keyframes, 100).select("query_id", "kf_id", big("rank"))


@query("tk_pool", f"SELECT query_id, kf_id, rank::BIGINT AS rank FROM ({_SCORED}) WHERE rank <= 400")
def _(t):
    return D.topk(t.queries, t.keyframes, 400).select("query_id", "kf_id", big("rank"))


@query("tk_rerank_head", f"""
WITH {SQL_RAW} SELECT query_id, kf_id, row_number() OVER (PARTITION BY query_id ORDER BY rank <= 30 DESC, CASE WHEN rank <= 30 THEN -abs(pts_time - 30.0) END DESC, rank) AS new_rank FROM rawr WHERE rank <= 100""")
def _(t):
    return X.rerank_head(scored(t, 100), -F.abs(F.col("pts_time") - 30.0)).select("query_id", "kf_id", big("new_rank"))


@query("tk_pad", f"""
WITH {SQL_RAW}, p AS (SELECT query_id, rank, kf_id FROM rawr WHERE rank <= 10 AND score > 0.2),
n AS (SELECT query_id, max(rank) AS n FROM p GROUP BY 1),
s AS (SELECT query_id, unnest(range(1, 101)) AS row_no FROM lex_queries)
SELECT s.query_id, row_no, coalesce(kf_id, -1) AS kf_id FROM s LEFT JOIN n USING (query_id) LEFT JOIN p ON p.query_id = s.query_id AND p.rank = least(row_no, n)""")
def _(t):
    from cuelight.operators.submission import pad

    p = scored(t, 10).filter("score > 0.2").select("query_id", "rank", "kf_id")
    return pad(p, t.lex_queries, {"kf_id": F.lit(-1).cast(B)})


@query("tk_sample", """
WITH v AS (SELECT video_id, count(*) AS n FROM keyframes GROUP BY 1),
d AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('7:' || video_id), video_id) AS draw_no FROM v) WHERE draw_no <= 16)
SELECT * FROM (SELECT video_id, draw_no, row_number() OVER (ORDER BY draw_no) AS pick_no FROM d WHERE n % 2 = 0) WHERE pick_no <= 4""")
def _(t):
    from cuelight.operators.sampling import first_successes

    # a video with an even number of keyframes stands for one whose query could be made
    videos = t.keyframes.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    return first_successes(videos, [], "video_id", 4, F.col("n") % 2 == 0, seed=7).select("video_id", big("draw_no"), big("pick_no"))


@query("tk_pinned_first", f"""
WITH {SQL_RAW}, res AS (SELECT query_id, rank, video_id, frame_idx, score FROM rawr WHERE rank <= 50), pins AS (SELECT * FROM marks WHERE pinned)
SELECT query_id, video_id, frame_idx, {R('score')} AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, no) AS rank FROM (
    SELECT query_id, video_id, frame_idx, 1.0 AS score, 0 AS tier, mark_no AS no FROM pins
    UNION ALL SELECT query_id, video_id, frame_idx, score, 1, rank FROM res r WHERE NOT EXISTS (
      SELECT 1 FROM pins p WHERE p.query_id = r.query_id AND p.video_id = r.video_id AND p.frame_idx = r.frame_idx))) WHERE rank <= 50""")
def _(t):
    pins = t.marks.filter("pinned").withColumnRenamed("mark_no", "pin_no")
    return X.pinned_first(scored(t), pins, 50).select("query_id", "video_id", "frame_idx", six("score"), big("rank"))


@query("st_video_union", "SELECT video_id FROM keyframes UNION SELECT video_id FROM segments UNION SELECT video_id FROM ocr_lines")
def _(t):
    v = lambda d: d.select("video_id")
    return v(t.keyframes).union(v(t.segments)).union(v(t.ocr_lines)).distinct()


@query("st_docs_union", f"SELECT video_id, {R('start_sec')} AS start_sec, {R('end_sec')} AS end_sec, text, source FROM docs")
def _(t):
    from cuelight.sources.readers import union_documents

    return union_documents(t.segments, t.ocr_runs).select("video_id", six("start_sec"), six("end_sec"), "text", "source")


@query("st_exclude_done", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark)""")
def _(t):
    return TR.pending(t["documents"].select("doc_id"), t["labels"], t["benchmark"].select(F.col("item_id").alias("doc_id")), key="doc_id")


_SEQ = """WITH s AS (SELECT conv_id, list(CASE WHEN role = 'system' THEN turn + 100 WHEN turn = 5 THEN 4 ELSE turn END ORDER BY turn) AS found, range(count(*)) AS expected FROM conversations GROUP BY 1),
d AS (SELECT *, list_sort(list_distinct(list_filter(expected, lambda i: NOT list_contains(found, i)))) AS missing, list_sort(list_distinct(list_filter(found, lambda i: NOT list_contains(expected, i)))) AS extra,
  list_sort(list_distinct(list_filter(found, lambda i: len(list_filter(found, lambda j: j = i)) > 1))) AS dup FROM s)"""


@query("st_id_diff", _SEQ + """ SELECT conv_id, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra, array_to_string(dup, ',') AS duplicates,
  CASE WHEN len(missing) + len(extra) + len(dup) = 0 AND found <> expected THEN 1 ELSE 0 END::BIGINT AS out_of_order FROM d""")
def _(t):
    turn = F.col("turn")
    ident = F.when(F.col("role") == "system", turn + 100).when(turn == 5, 4).otherwise(turn).cast(B)
    s = t["conversations"].groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", ident.alias("i")))).alias("f")).select(
        "conv_id", F.transform("f", lambda x: x["i"]).alias("found"), F.sequence(F.lit(0).cast(B), F.size("f").cast(B) - 1).alias("expected"))
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return s.select("conv_id", TR.id_differences(F.col("found"), F.col("expected")).alias("d")).select(
        "conv_id", text("d.missing").alias("missing"), text("d.extra").alias("extra"), text("d.duplicates").alias("duplicates"),
        F.col("d.out_of_order").cast("int").cast(B).alias("out_of_order"))


@query("st_submission_merge", f"""
WITH {SQL_RAW}, fl AS (SELECT query_id, unnest(range(0, 20)) AS pos, video_id, frame_idx + unnest(range(0, 20)) AS frame_idx FROM marks WHERE mark_no = 2 AND query_id % 3 = 0),
u AS (SELECT query_id, 1 AS tier, mark_no AS pos, video_id, frame_idx FROM marks WHERE pinned UNION ALL SELECT query_id, 2, mark_no, video_id, frame_idx FROM marks
  UNION ALL SELECT query_id, 3, rank, video_id, frame_idx FROM rawr WHERE rank <= 100),
f AS (SELECT query_id, video_id, frame_idx, min((tier, pos)) AS place FROM u WHERE query_id NOT IN (SELECT query_id FROM fl) GROUP BY ALL
  UNION ALL SELECT query_id, video_id, frame_idx, (0, pos) FROM fl)
SELECT query_id, row_no, video_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, video_id, frame_idx) AS row_no FROM f) WHERE row_no <= 100""")
def _(t):
    from cuelight.operators.submission import merge_sources

    m = t.marks
    flood = m.filter((F.col("mark_no") == 2) & (F.col("query_id") % 3 == 0)).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn(
        "frame_idx", F.col("frame_idx") + F.col("pos"))
    at = lambda d, c: d.withColumn("pos", F.col(c).cast("int"))
    return merge_sources(flood, at(m.filter("pinned"), "mark_no"), at(m, "mark_no"), at(scored(t, 100), "rank"))


# ---------------------------------------------------------------- vectors

@query("vc_normalize", f"""
SELECT vec_id, p::BIGINT AS p, {R('x')} AS x FROM (SELECT vec_id, unnest(range(len(v))) AS p, unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS x
  FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3.0 + 0.25) AS v FROM embeddings))""")
def _(t):
    v = F.transform(N.as_doubles("embedding"), lambda x: x * 3.0 + 0.25)
    e = t["embeddings"].select("vec_id", N.normalize(v).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("p", "x")).select("vec_id", big("p"), six("x"))


@query("vc_cosine_topk", f"SELECT query_id, kf_id, rank::BIGINT AS rank, {R('score')} AS dense FROM ({_SCORED}) WHERE rank <= 20")
def _(t):
    return D.topk(t.queries, t.keyframes, 20).select("query_id", "kf_id", big("rank"), six("dense"))


@query("vc_all_scores", f"SELECT query_id, kf_id, {R('dense')} AS dense FROM dense_all")
def _(t):
    return D.all_scores(t.queries, t.keyframes).select("query_id", "kf_id", six("dense"))


@query("vc_ivf_topk", f"SELECT query_id, kf_id, rank::BIGINT AS rank, {R('score')} AS dense FROM ({_SCORED}) WHERE rank <= 20")
def _(t):
    # from the stored cells: probing goes on until the next bound is below the 20th score
    return C.search_cells(t.queries, t.cell_index(), 20).select("query_id", "kf_id", big("rank"), six("dense"))


@query("vc_ivf_all_cells", f"SELECT query_id, kf_id, rank::BIGINT AS rank, {R('score')} AS dense FROM ({_SCORED}) WHERE rank <= 20")
def _(t):
    # every cell probed: the exact result
    return D.ivf_topk(t.queries, t.keyframes, 20, n_list=16, n_probe=16).select("query_id", "kf_id", big("rank"), six("dense"))


@query("vc_event_mean_rank", f"""
WITH m AS ({SQL_MEAN.format(key='query_id', src='event_vectors')}), s AS (SELECT m.query_id, video_id, max({sql_dot('m.embedding', 'k.embedding')}) AS best FROM m, keyframes k GROUP BY ALL)
SELECT query_id, video_id, rank, {R('best')} AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, video_id) AS rank FROM s) WHERE rank <= 5""")
def _(t):
    best = D.topk(D.mean_vectors(t.event_vectors, ["query_id"]), t.keyframes, 1, group="video_id").drop("rank")
    return top_k(best, ["query_id"], [F.desc("dense"), F.asc("video_id")], 5).select("query_id", "video_id", big("rank"), r6("dense").alias("best"))


SQL_ROCCHIO = f"""pos AS ({SQL_POSITIVE}), pv AS (SELECT pos.query_id, k.embedding FROM pos JOIN keyframes k USING (kf_id)),
pm AS ({SQL_MEAN.format(key='query_id', src='pv')}),
bl AS (SELECT q.query_id, list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i] * 0.65 + pm.embedding[i] * 0.35) AS v FROM queries q JOIN pm USING (query_id)),
moved AS (SELECT query_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS embedding FROM bl)"""


@query("vc_rocchio", f"WITH {SQL_ROCCHIO} SELECT query_id, p::BIGINT AS p, {R('x')} AS x FROM (SELECT query_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS x FROM moved)")
def _(t):
    p = I.nearest_row(t.marks, t.keyframes, ["query_id", "mark_no"]).join(t.keyframes.select("kf_id", "embedding"), "kf_id")
    return D.rocchio(t.queries, p, 64).select("query_id", F.posexplode("embedding").alias("p", "x")).select("query_id", big("p"), six("x"))


@query("vc_local_argmax", f"""
WITH {SQL_RAW}, p AS (SELECT query_id, kf_id AS point_id, video_id, pts_time + 0.7 AS pts, frame_idx + 17 AS start_frame FROM rawr WHERE rank <= 5),
s AS (SELECT p.query_id, p.point_id, arg_max(k.frame_idx, (sc, -k.frame_idx)) AS frame_idx, max(sc) AS score, arg_max(k.pts_time, (sc, -k.frame_idx)) AS pts_time FROM (
  SELECT p.*, k.*, {sql_dot('q.embedding', 'k.embedding')} AS sc FROM p JOIN (SELECT video_id, frame_idx, pts_time, embedding FROM keyframes) k ON p.video_id = k.video_id AND abs(p.pts - k.pts_time) <= 8.0 JOIN queries q ON q.query_id = p.query_id) x GROUP BY ALL)
SELECT p.query_id, p.point_id, coalesce(s.frame_idx, start_frame) AS frame_idx, {R('coalesce(score, 0.0)')} AS score, {R('coalesce(pts_time, pts)')} AS pts_time FROM p LEFT JOIN s USING (query_id, point_id)""".replace(
    "SELECT p.query_id, p.point_id, arg_max(k.frame_idx, (sc, -k.frame_idx)) AS frame_idx, max(sc) AS score, arg_max(k.pts_time, (sc, -k.frame_idx)) AS pts_time FROM (",
    "SELECT query_id, point_id, arg_max(f, (sc, -f)) AS frame_idx, max(sc) AS score, arg_max(pt, (sc, -f)) AS pts_time FROM (").replace(
    "SELECT p.*, k.*, ", "SELECT p.query_id, p.point_id, k.frame_idx AS f, k.pts_time AS pt, "))
def _(t):
    p = scored(t, 5).select("query_id", F.col("kf_id").alias("point_id"), "video_id", (F.col("pts_time") + 0.7).alias("pts"), (F.col("frame_idx") + 17).alias("start_frame"))
    f = t.keyframes.select("video_id", "frame_idx", "pts_time", "embedding")
    return D.local_argmax(p, f, t.queries).select("query_id", "point_id", "frame_idx", six("score"), six("pts_time"))


@query("vc_near_dup_neighbours", f"""
SELECT query_id, kf_id, rank, {R('dense')} AS dense FROM (SELECT a.vec_id AS query_id, b.vec_id AS kf_id, {sql_dot('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} AS dense,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {sql_dot('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5""")
def _(t):
    return D.near_duplicates(t.keyframes, 5).select("query_id", "kf_id", big("rank"), six("dense"))


# ---------------------------------------------------------------- fusion and search

_ORDER = "fused DESC, video_id, start_cs, end_cs"


@query("rt_weighted_norm", f"""
WITH {SQL_LISTS}, f AS (SELECT *, {G('bm25 * 0.5 + semantic * 0.5')} AS fused FROM uni)
SELECT query_id, video_id, start_cs, end_cs, rank, {R('fused')} AS fused FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank FROM f) WHERE rank <= 200""")
def _(t):
    return X.weighted_norm(*lists(t)).select("query_id", "video_id", "start_cs", "end_cs", big("rank"), six("fused"))


@query("rt_fused_rerank", f"""
WITH {SQL_LISTS}, f AS (SELECT *, {G('bm25 * 0.5 + semantic * 0.5')} AS fused FROM uni),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank FROM f) WHERE rank <= 200),
n AS (SELECT * EXCLUDE (fused), len(list_intersect(list_distinct(qt), list_distinct(dt))) / greatest(1, len(list_distinct(qt))) AS fused FROM (
  SELECT r.*, {sql_tokens('trim(q.text)')} AS qt, {sql_tokens('trim(r.text)')} AS dt FROM r JOIN lex_queries q USING (query_id) WHERE rank <= 30))
SELECT query_id, video_id, start_cs, end_cs, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, rank) AS rank, {R('fused')} AS fused FROM n
UNION ALL SELECT query_id, video_id, start_cs, end_cs, rank, {R('fused')} AS fused FROM r WHERE rank > 30""")
def _(t):
    asked = t.lex_queries.select("query_id", F.col("text").alias("query"))
    return X.weighted_norm(*lists(t), queries=asked, scorer=X.overlap_score).select("query_id", "video_id", "start_cs", "end_cs", big("rank"), six("fused"))


@query("rt_rrf", f"""
WITH {SQL_LISTS}, r AS (SELECT *, CASE WHEN in_l THEN row_number() OVER (PARTITION BY query_id, in_l ORDER BY bm25 DESC, video_id, start_cs, end_cs) ELSE 1000 END AS rl,
  CASE WHEN in_s THEN row_number() OVER (PARTITION BY query_id, in_s ORDER BY semantic DESC, video_id, start_cs, end_cs) ELSE 1000 END AS rs FROM uni),
f AS (SELECT *, {G('0.5 / (60.0 + rl) + 0.5 / (60.0 + rs)')} AS fused FROM r)
SELECT query_id, video_id, start_cs, end_cs, rank, {R('fused')} AS fused FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank FROM f) WHERE rank <= 200""")
def _(t):
    return X.reciprocal_rank(*lists(t)).select("query_id", "video_id", "start_cs", "end_cs", big("rank"), six("fused"))


@query("rt_keyframe_speech", f"""
WITH {SQL_LISTS}, f AS (SELECT *, {G('bm25 * 0.5 + semantic * 0.5')} AS fused FROM uni),
h AS (SELECT *, fused / greatest(1e-6, max(fused) OVER (PARTITION BY query_id)) AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank FROM f) WHERE rank <= 200)
SELECT query_id, kf_id, {R('max(s)')} AS score, arg_max(text, (s, -rank)) AS text FROM h JOIN keyframes k ON h.video_id = k.video_id AND pts_time BETWEEN start_sec - 3.0 AND end_sec + 3.0 WHERE s > 0 GROUP BY ALL""")
def _(t):
    from cuelight.plans.hybrid import keyframe_speech

    return keyframe_speech(X.weighted_norm(*lists(t)), t.keyframes).select("query_id", "kf_id", six("score"), "text")


_SMOOTH = " + ".join(f"{w!r} * {c}[i]" for c, w in zip(("a2", "a1", "e", "b1", "b2"), _W))
SQL_SMOOTHED = f"""nb AS (SELECT kf_id, video_id, pts_time, embedding AS e, coalesce(lag(embedding, 2) OVER w, lag(embedding, 1) OVER w, embedding) AS a2, coalesce(lag(embedding, 1) OVER w, embedding) AS a1,
  coalesce(lead(embedding, 1) OVER w, embedding) AS b1, coalesce(lead(embedding, 2) OVER w, lead(embedding, 1) OVER w, embedding) AS b2 FROM keyframes WINDOW w AS (PARTITION BY video_id ORDER BY n)),
smk AS (SELECT kf_id, video_id, pts_time, list_transform(range(1, len(e) + 1), lambda i: {_SMOOTH}) AS v FROM nb)"""


@query("rt_hybrid3", f"""
WITH {SQL_OBJ}, {SQL_OKAPI.replace('QUERIES_HERE', 'object_queries')}, {SQL_SMOOTHED}, sm AS (SELECT query_id, kf_id, video_id, pts_time, {sql_dot('q.embedding', 'v')} AS dense FROM queries q, smk),
mt AS (SELECT query_id, video_id, score / max(score) OVER (PARTITION BY query_id) AS meta FROM pmeta),
f AS (SELECT query_id, kf_id, video_id, pts_time, {G('dense * 0.70 + coalesce(object, 0.0) * 0.15 + coalesce(meta, 0.0) * 0.15')} AS score
  FROM sm LEFT JOIN onorm USING (query_id, kf_id) LEFT JOIN mt USING (query_id, video_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, floor(pts_time / 2.5) ORDER BY score DESC, kf_id) > 1 AS again FROM f)
SELECT query_id, kf_id, rank, {R('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY again, score DESC, kf_id) AS rank FROM b) WHERE rank <= 100""")
def _(t):
    from cuelight.plans.hybrid import hybrid

    out = hybrid(t.object_queries, t.keyframes, TR.object_scores(t.detections), t.video_pieces)
    return out.select("query_id", "kf_id", big("rank"), six("score"))


# the speech evidence of the full search: BM25 with the screen-text boost, then semantic windows
SQL_EVIDENCE = f"""{SQL_SEM}, ev_a AS ({SQL_BEST.replace('h.score / (25.0 + h.score) AS s', "CASE WHEN d.source = 'ocr' THEN least(1.0, h.score / (15.0 + h.score) * CASE WHEN i.w_ocr > 0 THEN 1.5 + 2.0 * i.w_ocr ELSE 1.2 END) ELSE h.score / (25.0 + h.score) END AS s").replace('FROM doc_hits h', 'FROM doc_hits h JOIN INTENT i ON h.query_id = i.query_id')}),
ev_b AS ({SQL_SEMBEST}), speech AS (SELECT query_id, kf_id, greatest(coalesce(a.score, 0.0), coalesce(b.score, 0.0)) AS score, coalesce(a.text, b.text) AS text FROM ev_a a FULL JOIN ev_b b USING (query_id, kf_id)),
ev_max AS (SELECT q.query_id, coalesce(max(score), 0.0) AS max_speech FROM lex_queries q LEFT JOIN speech USING (query_id) GROUP BY 1)"""


def _intent_sql():
    from cuelight.catalog.text import _intent_case

    return f"intents AS (SELECT item_id AS query_id, {_intent_case(0)} AS category, {_intent_case(1)} AS label, {_intent_case(2)} AS w_dense, {_intent_case(3)} AS w_speech, {_intent_case(4)} AS w_ocr FROM benchmark)"


SQL_EVIDENCE = f"{_intent_sql()}, {SQL_EVIDENCE.replace('INTENT', 'intents')}"
SQL_ROUTE = """routed AS (SELECT i.query_id, CASE WHEN category <> 'balanced_multimodal' THEN w_dense WHEN max_speech >= 0.50 THEN 0.30 ELSE 0.70 END AS wd,
  CASE WHEN category <> 'balanced_multimodal' THEN w_speech WHEN max_speech >= 0.50 THEN 0.70 ELSE 0.30 END AS ws,
  CASE WHEN category <> 'balanced_multimodal' THEN label WHEN max_speech >= 0.50 THEN 'Strong Speech Match' ELSE 'Balanced Multimodal' END AS label
  FROM intents i JOIN ev_max USING (query_id))"""


def corpus(t, semantic=True):
    """The prepared tables, written once before the queries read them."""
    from cuelight.plans.search import Corpus

    seg = t.segments
    if semantic:
        seg = seg.withColumn("embedding", letter_profile("text"))
    return Corpus(reliable(t.keyframes), reliable(t.docs), reliable(seg), semantic)


def full_queries(t):
    return t.queries.join(t.text_vectors.withColumnRenamed("embedding", "text_vector"), "query_id")


def evidence(t):
    from cuelight.plans import search as P

    q, c = P.with_intent(full_queries(t)), corpus(t)
    return q, reliable(P.merge_evidence(P.lexical_evidence(q, c, 5.0), P.semantic_evidence(q, c, 5.0)))


@query("rt_gate", f"WITH {SQL_EVIDENCE}, {SQL_ROUTE} SELECT query_id, wd AS w_dense, ws AS w_speech, label FROM routed")
def _(t):
    from cuelight.plans import search as P

    return P.route(*evidence(t), None)


_T = [0.20, 0.30, 0.40, 0.50]


@query("rt_binary_gate", f"""
WITH {SQL_EVIDENCE} SELECT query_id, t AS threshold, CASE WHEN max_speech >= t THEN 0.70 ELSE 1.0 END AS w_dense, CASE WHEN max_speech >= t THEN 0.30 ELSE 0.0 END AS w_speech
FROM (SELECT *, unnest({_T}) AS t FROM ev_max)""")
def _(t):
    from cuelight.plans import search as P

    best = P.max_speech(*evidence(t)).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in _T])))
    return best.select("query_id", "threshold", X.binary_gate("max_speech", F.col("threshold")).alias("g")).select("query_id", "threshold", "g.*")


@query("rt_adaptive", f"""
WITH {SQL_EVIDENCE} SELECT query_id, CASE category WHEN 'visual_entity_text_grounded' THEN 0.25 WHEN 'speech_dialogue_grounded' THEN 0.20 ELSE CASE WHEN max_speech >= 0.50 THEN 0.30 ELSE 0.70 END END AS w_dense,
  CASE category WHEN 'visual_entity_text_grounded' THEN 0.75 WHEN 'speech_dialogue_grounded' THEN 0.80 ELSE CASE WHEN max_speech >= 0.50 THEN 0.70 ELSE 0.30 END END AS w_speech
FROM intents JOIN ev_max USING (query_id)""")
def _(t):
    from cuelight.plans import search as P

    q, s = evidence(t)
    best = P.max_speech(q, s).join(q.select("query_id", F.col("intent.category").alias("category")), "query_id")
    return best.select("query_id", X.adaptive("category", "max_speech").alias("w")).select("query_id", "w.*")


SQL_KEYWORD = """kwh AS (SELECT k.query_id, k.kw_no, f.kf_id, max(k.weight * 1.5) AS s FROM keywords k JOIN docs d ON contains(lower(d.text), lower(trim(k.keyword)))
  JOIN keyframes f ON d.video_id = f.video_id AND f.pts_time BETWEEN d.start_sec - 3.0 AND d.end_sec + 3.0 GROUP BY ALL),
kw AS (SELECT query_id, kf_id, sum(s) AS keyword_score FROM kwh GROUP BY ALL)"""


@query("rt_keyword_exact", f"WITH {SQL_KEYWORD} SELECT query_id, kf_id, {R('keyword_score')} AS keyword_score FROM kw")
def _(t):
    return X.exact_keyword_scores(t.keywords, t.docs, t.keyframes).select("query_id", "kf_id", six("keyword_score"))


@query("rt_keyword_semantic", f"""
WITH h AS (SELECT *, score / greatest(1e-6, max(score) OVER (PARTITION BY query_id)) AS s FROM doc_ranked WHERE rank <= 200),
a AS (SELECT query_id, kf_id, max(s) AS s FROM h JOIN docs d USING (doc_id) JOIN keyframes k ON d.video_id = k.video_id AND pts_time BETWEEN start_sec - 3.0 AND end_sec + 3.0 GROUP BY ALL)
SELECT query_id, kf_id, {R('0.8 * (0.70 * norm + 0.30 * coalesce(s, 0.0))')} AS keyword_score FROM dense_norm LEFT JOIN a USING (query_id, kf_id)""")
def _(t):
    kw = t.queries.select("query_id", F.lit(0).alias("kw_no"), F.col("text").alias("keyword"), F.lit(0.8).alias("weight"), "embedding")
    return X.semantic_keyword_scores(kw, t.docs, t.keyframes, 0.70, 0.30).select("query_id", "kf_id", six("keyword_score"))


SQL_SEARCH = f"""{SQL_EVIDENCE}, {SQL_ROUTE},
fu AS (SELECT p.*, coalesce(s.score, 0.0) AS speech, coalesce(exact_text, s.text) AS stext, label, {G('norm + coalesce(kw, 0.0)')} AS lead,
    {G('wd * (norm + coalesce(kw, 0.0)) + ws * (coalesce(s.score, 0.0) + coalesce(kw_speech, 0.0)) + coalesce(exact, 0.0)')} AS fused
  FROM pooled p JOIN routed USING (query_id) LEFT JOIN speech s USING (query_id, kf_id) LEFT JOIN kw_dense USING (query_id, kf_id)
  LEFT JOIN kw_spoken USING (query_id, kf_id) LEFT JOIN kw_exact USING (query_id, kf_id)),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, lead DESC, dense DESC, kf_id) AS prank FROM fu) WHERE prank <= 200),
ordd AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY prank) AS i FROM pool),
nms AS (SELECT query_id, video_id, 0::BIGINT AS i, []::DOUBLE[] AS kept, NULL::BIGINT AS kf_id, false AS ok FROM (SELECT DISTINCT query_id, video_id FROM ordd)
  UNION ALL SELECT o.query_id, o.video_id, o.i, CASE WHEN len(list_filter(n.kept, lambda p: abs(p - o.pts_time) < 1.5)) > 0 THEN n.kept ELSE list_append(n.kept, o.pts_time) END, o.kf_id,
    len(list_filter(n.kept, lambda p: abs(p - o.pts_time) < 1.5)) = 0 FROM nms n JOIN ordd o ON o.query_id = n.query_id AND o.video_id = n.video_id AND o.i = n.i + 1),
fin AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY prank) AS rank FROM pool p JOIN (SELECT query_id, kf_id FROM nms WHERE ok) USING (query_id, kf_id)) WHERE rank <= 50),
sp AS ({SQL_SPOKEN.format(keys='query_id, kf_id', pkeys='p.query_id, p.kf_id', points='fin')})"""


@query("rt_search", f"""
WITH RECURSIVE {SQL_SEARCH} SELECT f.query_id, f.rank, f.kf_id, f.frame_idx, {R('f.dense')} AS raw_dense, {R('norm')} AS norm_dense, {R('speech')} AS speech, {R('fused')} AS score,
  coalesce(stext, spoken, '') AS matched_speech, coalesce(s.scene, '') AS matched_scene, label FROM fin f LEFT JOIN sp USING (query_id, kf_id) LEFT JOIN scenes s ON s.query_id = f.query_id AND s.scene_no = f.best_scene""")
def _(t):
    from cuelight.plans.search import search

    out = search(full_queries(t), corpus(t), scenes=t.scenes, keywords=t.mixed_keywords, top=50)
    return out.select("query_id", big("rank"), "kf_id", "frame_idx", six("raw_dense"), six("norm_dense"), six("speech"), six("score"), "matched_speech", "matched_scene", "label")


@query("rt_proximity_bonus", f"""
SELECT query_id, kf_id, {R('max(CASE WHEN abs(k.pts_time - m.pts_time) <= 45.0 THEN 0.25 * (1.0 - abs(k.pts_time - m.pts_time) / 45.0) ELSE 0.08 END)')} AS bonus FROM marks m JOIN keyframes k USING (video_id) GROUP BY ALL""")
def _(t):
    return X.proximity_bonus(t.marks, t.keyframes).select("query_id", "kf_id", six("bonus"))


@query("rt_refine", f"""
WITH RECURSIVE {_intent_sql()}, {SQL_ROCCHIO},
da AS (SELECT m.query_id, k.kf_id, k.video_id, k.pts_time, k.frame_idx, {sql_dot('m.embedding', 'k.embedding')} AS dense FROM moved m, keyframes k),
bo AS (SELECT query_id, kf_id, max(CASE WHEN abs(k.pts_time - m.pts_time) <= 45.0 THEN 0.25 * (1.0 - abs(k.pts_time - m.pts_time) / 45.0) ELSE 0.08 END) AS bonus FROM marks m JOIN keyframes k USING (video_id) GROUP BY ALL),
sb AS (SELECT query_id, kf_id, max(s) AS score, arg_max(text, (s, -rank)) AS text FROM (SELECT h.query_id, k.kf_id, h.rank, d.text, h.score / greatest(1e-6, mx) AS s
  FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS mx FROM doc_hits) h JOIN docs d USING (doc_id) JOIN keyframes k ON d.video_id = k.video_id AND pts_time BETWEEN start_sec - 5.0 AND end_sec + 5.0) WHERE s > 0 GROUP BY ALL),
nm AS (SELECT d.*, least(greatest((dense - min(dense) OVER w) / greatest(1e-6, max(dense) OVER w - min(dense) OVER w) + coalesce(bonus, 0.0), 0.0), 1.0) AS norm FROM da d LEFT JOIN bo USING (query_id, kf_id) WINDOW w AS (PARTITION BY query_id)),
fu AS (SELECT n.*, coalesce(exact_text, s.text) AS stext, {G('norm + coalesce(kw, 0.0)')} AS lead,
    {G('i.w_dense * (norm + coalesce(kw, 0.0)) + i.w_speech * (coalesce(s.score, 0.0) + coalesce(kw_speech, 0.0)) + coalesce(exact, 0.0)')} AS fused
  FROM nm n JOIN intents i USING (query_id) LEFT JOIN sb s USING (query_id, kf_id) LEFT JOIN kw_dense USING (query_id, kf_id)
  LEFT JOIN kw_spoken USING (query_id, kf_id) LEFT JOIN kw_exact USING (query_id, kf_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, lead DESC, dense DESC, kf_id) AS prank FROM fu),
sd AS (SELECT query_id, kf_id, min(mark_no) AS mark_no FROM pos GROUP BY ALL),
pool AS (SELECT r.*, s.mark_no IS NOT NULL AS seed, coalesce(s.mark_no, prank) AS ord FROM rk r LEFT JOIN sd s USING (query_id, kf_id) WHERE prank <= 160 OR s.mark_no IS NOT NULL),
ordd AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY NOT seed, ord) AS i FROM pool),
nms AS (SELECT query_id, video_id, 0::BIGINT AS i, []::DOUBLE[] AS kept, NULL::BIGINT AS kf_id, false AS ok FROM (SELECT DISTINCT query_id, video_id FROM ordd)
  UNION ALL SELECT o.query_id, o.video_id, o.i, CASE WHEN NOT o.seed AND len(list_filter(n.kept, lambda p: abs(p - o.pts_time) < 2.0)) > 0 THEN n.kept ELSE list_append(n.kept, o.pts_time) END, o.kf_id,
    o.seed OR len(list_filter(n.kept, lambda p: abs(p - o.pts_time) < 2.0)) = 0 FROM nms n JOIN ordd o ON o.query_id = n.query_id AND o.video_id = n.video_id AND o.i = n.i + 1),
rs AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY NOT seed, ord, kf_id) AS rank FROM pool p JOIN (SELECT query_id, kf_id FROM nms WHERE ok) USING (query_id, kf_id)) WHERE rank <= 40),
pins AS (SELECT * FROM marks WHERE pinned),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, no) AS rank FROM (
  SELECT query_id, video_id, frame_idx, pts_time, 1.0 AS score, 0 AS tier, mark_no AS no, NULL AS stext FROM pins
  UNION ALL SELECT query_id, video_id, frame_idx, pts_time, CASE WHEN seed THEN 1.0 ELSE fused END, 1, rank, stext FROM rs r WHERE NOT EXISTS (
    SELECT 1 FROM pins p WHERE p.query_id = r.query_id AND p.video_id = r.video_id AND p.frame_idx = r.frame_idx))) WHERE rank <= 40),
sp AS ({SQL_SPOKEN.format(keys='query_id, rank', pkeys='p.query_id, p.rank', points='fin')})
SELECT query_id, rank, video_id, frame_idx, {R('pts_time')} AS pts_time, {R('score')} AS score, (tier = 0)::INT::BIGINT AS is_pinned,
  CASE WHEN tier = 0 THEN CASE WHEN coalesce(spoken, '') <> '' THEN 'Pinned Match · ' || spoken ELSE 'Pinned Match' END ELSE coalesce(stext, spoken, '') END AS matched_speech FROM fin LEFT JOIN sp USING (query_id, rank)""")
def _(t):
    from cuelight.plans.feedback import refine

    out = refine(t.queries, t.marks, corpus(t, False), 64, keywords=t.mixed_keywords, top=40)
    return out.select("query_id", big("rank"), "video_id", "frame_idx", six("pts_time"), six("score"), F.col("is_pinned").cast("int").cast(B).alias("is_pinned"), "matched_speech")


@query("rt_context_block")
def _(t):
    from cuelight.plans.context import context_block

    clips = t.truth.select("query_id", "video_id", F.col("start_sec").alias("clip_start"), (F.col("end_sec") + 10.0).alias("clip_end"))
    cand = reranked(t, 10).select("query_id", "rank", "video_id", "segment_id", "start_sec", "end_sec", "rerank_score")
    return context_block(clips, t.segments, t.ocr_lines, cand)


@query("rt_video_context", """
SELECT q.query_id, count(*) AS n_segments, count(*) FILTER (abs(start_sec - pts_time) <= 45.0 OR abs(end_sec - pts_time) <= 45.0 OR pts_time BETWEEN start_sec AND end_sec) AS n_near,
  (SELECT count(*) FROM ocr_lines o WHERE o.video_id = k.video_id) AS n_lines,
  (SELECT CASE WHEN count(*) FILTER (abs(t_sec - k.pts_time) <= 45.0) > 0 THEN count(*) FILTER (abs(t_sec - k.pts_time) <= 45.0) ELSE least(30, count(*)) END FROM ocr_lines o WHERE o.video_id = k.video_id) AS n_shown
FROM lex_queries q JOIN keyframes k ON q.query_id = k.kf_id JOIN segments s ON s.video_id = k.video_id GROUP BY q.query_id, k.video_id, k.pts_time""")
def _(t):
    from cuelight.plans.context import video_context

    p = t.truth.select("query_id", "video_id", (F.col("start_sec") + 1.5).alias("pts_time"))
    return video_context(p, t.segments, t.ocr_lines, ["query_id"])


# ---------------------------------------------------------------- sequences

@query("sq_nms", f"""
WITH RECURSIVE {SQL_RAW}, pool AS (SELECT * FROM rawr WHERE rank <= 200), ordd AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS i FROM pool),
nms AS (SELECT query_id, video_id, 0::BIGINT AS i, []::DOUBLE[] AS kept, NULL::BIGINT AS kf_id, false AS ok FROM (SELECT DISTINCT query_id, video_id FROM ordd)
  UNION ALL SELECT o.query_id, o.video_id, o.i, CASE WHEN len(list_filter(n.kept, lambda p: abs(p - o.pts_time) < 4.0)) > 0 THEN n.kept ELSE list_append(n.kept, o.pts_time) END, o.kf_id,
    len(list_filter(n.kept, lambda p: abs(p - o.pts_time) < 4.0)) = 0 FROM nms n JOIN ordd o ON o.query_id = n.query_id AND o.video_id = n.video_id AND o.i = n.i + 1)
SELECT query_id, kf_id, new_rank AS rank FROM (SELECT p.query_id, p.kf_id, row_number() OVER (PARTITION BY p.query_id ORDER BY p.rank) AS new_rank FROM pool p JOIN (SELECT query_id, kf_id FROM nms WHERE ok) USING (query_id, kf_id)) WHERE new_rank <= 50""")
def _(t):
    return S.suppress(scored(t, 200), 50, 4.0).select("query_id", "kf_id", big("rank"))


@query("sq_expand_dedup", rf"""
WITH RECURSIVE {SQL_RERANK}, cand AS (SELECT r.query_id, r.rank, r.video_id, r.segment_id, r.start_sec, r.end_sec, s.position FROM rr r JOIN segments s USING (video_id, segment_id)),
win AS (SELECT c.query_id, c.rank, min(s.start_sec) AS ws, arg_max(s.end_sec, s.start_sec) AS we, count(*) AS num_segments, trim(regexp_replace(string_agg(trim(s.text), ' ' ORDER BY s.start_sec), '\s+', ' ', 'g')) AS context
  FROM cand c JOIN segments s ON c.video_id = s.video_id AND s.position BETWEEN c.position - 1 AND c.position + 1 GROUP BY ALL),
ordd AS (SELECT c.*, ws, we, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS i FROM cand c JOIN win USING (query_id, rank)),
f AS (SELECT query_id, video_id, 0::BIGINT AS i, []::STRUCT(s DOUBLE, e DOUBLE)[] AS kept, NULL::BIGINT AS rank, false AS ok FROM (SELECT DISTINCT query_id, video_id FROM ordd)
  UNION ALL SELECT query_id, video_id, i, CASE WHEN hit THEN kept ELSE list_append(kept, {{'s': ws, 'e': we}}) END, rank, NOT hit FROM (
    SELECT o.*, f.kept, len(list_filter(f.kept, lambda k: least(o.end_sec, k.e) - greatest(o.start_sec, k.s) > 0 AND (least(o.end_sec, k.e) - greatest(o.start_sec, k.s)) / greatest(1.0, o.end_sec - o.start_sec) >= 0.35)) > 0 AS hit
    FROM f JOIN ordd o ON o.query_id = f.query_id AND o.video_id = f.video_id AND o.i = f.i + 1)),
acc AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS window_no FROM f WHERE ok)
SELECT query_id, rank, window_no, {R('ws')} AS win_start, {R('we')} AS win_end, num_segments, context FROM acc JOIN win USING (query_id, rank) WHERE window_no <= 4""")
def _(t):
    cand = reranked(t).select("query_id", "rank", "video_id", "segment_id", "start_sec", "end_sec", "rerank_score")
    return S.expand_and_dedup(cand, t.segments).select("query_id", big("rank"), big("window_no"), six("win_start"), six("win_end"), "num_segments", "context")


@query("sq_align", f"""
WITH m AS ({SQL_MEAN.format(key='query_id', src='event_vectors')}), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, video_id) AS r FROM (
  SELECT m.query_id, video_id, max({sql_dot('m.embedding', 'k.embedding')}) AS best FROM m, keyframes k GROUP BY ALL)) WHERE r <= 5),
s AS (SELECT v.query_id, v.video_id, k.n, k.frame_idx, {', '.join(sql_dot(f'e{i}.embedding', 'k.embedding') + f' AS s{i}' for i in range(3))} FROM v JOIN keyframes k USING (video_id)
  {' '.join(f'JOIN event_vectors e{i} ON e{i}.query_id = v.query_id AND e{i}.event_no = {i}' for i in range(3))}),
d0 AS (SELECT *, {{'score': s0, 'at': -n, 'path': [frame_idx]}} AS dp FROM s),
d1 AS (SELECT * EXCLUDE (dp), {{'score': s1 + b.score, 'at': -n, 'path': list_append(b.path, frame_idx)}} AS dp FROM (SELECT *, max(dp) OVER (PARTITION BY query_id, video_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d0) WHERE b IS NOT NULL),
d2 AS (SELECT * EXCLUDE (dp), {{'score': s2 + b.score, 'at': -n, 'path': list_append(b.path, frame_idx)}} AS dp FROM (SELECT * EXCLUDE (b), max(dp) OVER (PARTITION BY query_id, video_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d1) WHERE b IS NOT NULL)
SELECT query_id, video_id, {R('max(dp).score / 3.0')} AS score, array_to_string(max(dp).path, ',') AS frames FROM d2 GROUP BY ALL""")
def _(t):
    a = S.align(t.event_vectors, t.keyframes, 5)
    return a.select("query_id", "video_id", six("score"), F.array_join(F.transform("frames", lambda f: f.cast("string")), ",").alias("frames"))


def _sql_corr(a, b):
    mean = lambda v: f"(list_sum({v}) / len({v}))"
    da, db = f"list_transform({a}, lambda x: x - {mean(a)})", f"list_transform({b}, lambda x: x - {mean(b)})"
    return f"CASE WHEN list_dot_product({da}, {da}) > 0 AND list_dot_product({db}, {db}) > 0 THEN {G(f'list_dot_product({da}, {db}) / sqrt(list_dot_product({da}, {da}) * list_dot_product({db}, {db}))')} ELSE 1.0 END"


@query("sq_shot_segments", f"""
WITH RECURSIVE fr AS (SELECT video_id, n - 1 AS frame_no, embedding AS h, lag(embedding) OVER (PARTITION BY video_id ORDER BY n) AS ph FROM keyframes),
cut AS (SELECT video_id, frame_no, coalesce(1.0 - {_sql_corr('ph', 'h')} > 0.35, false) AS c FROM fr),
f AS (SELECT DISTINCT video_id, 0::BIGINT AS frame_no, 0::BIGINT AS st, false AS emit, 0::BIGINT AS es FROM fr
  UNION ALL SELECT c.video_id, c.frame_no, CASE WHEN c.c AND c.frame_no - f.st >= 3 THEN c.frame_no ELSE f.st END, c.c AND c.frame_no - f.st >= 3, f.st FROM f JOIN cut c ON c.video_id = f.video_id AND c.frame_no = f.frame_no + 1),
ln AS (SELECT video_id, max(frame_no) + 1 AS len FROM fr GROUP BY 1),
sh AS (SELECT video_id, es AS s, frame_no - 1 AS e FROM f WHERE emit UNION ALL SELECT f.video_id, st, len - 1 FROM f JOIN ln ON f.video_id = ln.video_id AND f.frame_no = len - 1 WHERE len - st >= 3 OR st = 0)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY s) - 1 AS shot_id, s AS start_frame, e AS end_frame, {R('greatest(0.0, (e - s) / 25.0)')} AS duration_sec FROM sh""")
def _(t):
    return S.shots(_histograms(t)).select("video_id", "shot_id", "start_frame", "end_frame", six("duration_sec"))


def _histograms(t):
    return t.keyframes.select("video_id", (F.col("n") - 1).alias("frame_no"), N.as_doubles("embedding").alias("hist"))


_RANGES = "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS s, json_extract_string(props, '$.k')::BIGINT + floor(value * 10.0)::BIGINT AS e FROM events"


@query("sq_shot_samples", f"""
WITH r AS (SELECT *, e - s AS span, (e - s) / 25.0 AS d FROM ({_RANGES})),
p AS (SELECT event_id, CASE WHEN e <= s THEN [s] WHEN d < 1.5 THEN [s + span // 2] WHEN d <= 5.0 THEN [s + span // 4, s + 3 * span // 4]
  ELSE list_concat([s + floor(span * 0.10)::BIGINT, s + span // 2, s + floor(span * 0.90)::BIGINT], range(s + floor(span * 0.10)::BIGINT + 75, s + floor(span * 0.90)::BIGINT, 75)) END AS picks FROM r)
SELECT event_id, sample_frame FROM (SELECT DISTINCT event_id, unnest(picks) AS sample_frame FROM p)""")
def _(t):
    k = F.get_json_object("props", "$.k").cast(B)
    r = t["events"].select("event_id", k.alias("start_frame"), (k + F.floor(F.col("value") * 10.0)).cast(B).alias("end_frame"))
    r = r.withColumn("duration_sec", (F.col("end_frame") - F.col("start_frame")) / 25.0)
    return S.shot_samples(r).select("event_id", "sample_frame")


@query("sq_prune_static", f"""
WITH RECURSIVE fr AS (SELECT 'v' || (conv_id % 10) AS video_id, conv_id * 8 + turn AS frame_no, conv_id * 10.0 + turn * 0.2 AS pts_time, {sql_letter_counts('text')} AS h FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pts_time, frame_no) AS i FROM fr),
f AS (SELECT video_id, i, pts_time AS kp, h AS kh, frame_no, pts_time, true AS keep FROM o WHERE i = 1
  UNION ALL SELECT video_id, i, CASE WHEN twin THEN kp ELSE pts_time END, CASE WHEN twin THEN kh ELSE h END, frame_no, pts_time, NOT twin FROM (
    SELECT o.video_id, o.i, o.frame_no, o.pts_time, o.h, f.kp, f.kh, o.pts_time - f.kp < 0.5 AND {_sql_corr('f.kh', 'o.h')} > 0.96 AS twin FROM f JOIN o ON o.video_id = f.video_id AND o.i = f.i + 1))
SELECT video_id, frame_no, {R('pts_time')} AS pts_time FROM f WHERE keep""")
def _(t):
    f = t["conversations"].select(F.concat(F.lit("v"), F.col("conv_id") % 10).alias("video_id"), (F.col("conv_id") * 8 + F.col("turn")).alias("frame_no"),
                                  (F.col("conv_id") * 10.0 + F.col("turn") * 0.2).alias("pts_time"), letter_counts("text").alias("hist"))
    return S.prune_static(f).select("video_id", "frame_no", six("pts_time"))


@query("sq_neighbor_flood", """
WITH d AS (SELECT kf_id, video_id, frame_idx, unnest(range(-100, 101)) AS d FROM keyframes)
SELECT kf_id, video_id, frame, row_no FROM (SELECT kf_id, video_id, frame_idx + d AS frame, row_number() OVER (PARTITION BY kf_id ORDER BY abs(d), d) AS row_no FROM d WHERE frame_idx + d >= 0) WHERE row_no <= 100""")
def _(t):
    return S.neighbour_flood(t.keyframes.select("kf_id", "video_id", "frame_idx"), ["kf_id"])


@query("sq_sample_grid", """
WITH c AS (SELECT kf_id, greatest(0.0, pts_time - 2.0) AS lo, greatest(greatest(0.0, pts_time - 2.0) + 0.1, pts_time + 2.0) AS hi FROM keyframes)
SELECT kf_id, i::BIGINT AS i, round_even(CASE WHEN i = 5 THEN hi ELSE lo + i * ((hi - lo) / 5.0) END * 25.0, 0)::BIGINT AS frame FROM (SELECT *, unnest(range(6)) AS i FROM c)""")
def _(t):
    k = t.keyframes.select("kf_id", (F.col("pts_time") - 2.0).alias("a"), (F.col("pts_time") + 2.0).alias("b"))
    return k.select("kf_id", F.posexplode(S.clip_grid("a", "b")).alias("i", "t")).select("kf_id", big("i"), F.bround(F.col("t") * 25.0, 0).cast(B).alias("frame"))


@query("sq_event_marks", """
SELECT user_id, string_agg(k::VARCHAR, ',' ORDER BY k) AS frames FROM (SELECT DISTINCT user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1""")
def _(t):
    # frames of one user, repeats dropped before they are gathered
    e = t["events"].select("user_id", F.get_json_object("props", "$.k").cast(B).alias("k")).distinct()
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: x.cast("string")), ",").alias("frames"))
