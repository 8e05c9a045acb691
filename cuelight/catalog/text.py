"""Scalar functions over the driver texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelight.catalog.base import G, R, Tables, query, r6, sql_dot, sql_list, sql_tokens
from cuelight.functions import lexicon as lx
from cuelight.functions import numeric as N
from cuelight.functions import text as T
from cuelight.functions.text import strip


@query("fn_tokenize", f"""
SELECT doc_id, len(toks)::BIGINT AS n_tokens, array_to_string(toks, ' ') AS tokens FROM (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents)""")
def _(t: Tables):
    d = t["documents"].select("doc_id", T.tokenize("text").alias("k"))
    return d.select("doc_id", F.size("k").cast("bigint").alias("n_tokens"), F.array_join("k", " ").alias("tokens"))


@query("fn_tokenize_word", r"""
SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') AS tokens FROM documents""")
def _(t):
    return t["documents"].select("doc_id", F.array_join(T.tokenize_words("text"), " ").alias("tokens"))


@query("fn_stopwords", f"""
SELECT doc_id, array_to_string(CASE WHEN len(kept) = 0 THEN toks ELSE kept END, ' ') AS tokens FROM (
  SELECT doc_id, toks, list_filter(toks, lambda t: NOT list_contains({sql_list(lx.STOPWORDS)}, t)) AS kept FROM lex_tokens)""")
def _(t):
    d = t["documents"].filter(strip("text") != "")
    return d.select("doc_id", F.array_join(T.drop_stopwords(T.tokenize("text")), " ").alias("tokens"))


def _clean_sql(col: str) -> str:
    out = f"trim({col})"
    for p in lx.QUERY_BOILERPLATE[:-1]:
        out = f"trim(regexp_replace({out}, '(?i){p}', ''))"
    # the last rule needs a lookahead that RE2 lacks: the compound check is a CASE instead
    guard = "(?i)^cảnh\\s+(sát|báo|giác|quan|vật|sắc)($|[^\\p{L}\\p{N}_])"
    return f"CASE WHEN regexp_matches({out}, '{guard}') THEN {out} ELSE trim(regexp_replace({out}, '(?i)^cảnh\\s+', '')) END"


@query("fn_clean_query", f"""
SELECT doc_id, {_clean_sql('p')} AS cleaned FROM (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'tìm video về ' WHEN 1 THEN 'Cảnh sát ' WHEN 2 THEN 'cảnh ' ELSE '' END || text AS p FROM documents)""")
def _(t):
    head = (F.when(F.col("doc_id") % 4 == 0, "tìm video về ").when(F.col("doc_id") % 4 == 1, "Cảnh sát ")
            .when(F.col("doc_id") % 4 == 2, "cảnh ").otherwise(""))
    return t["documents"].select("doc_id", T.clean_query(F.concat(head, "text")).alias("cleaned"))


_DICT = ", ".join(f"{{'k': '{k}', 'v': '{v}'}}" for k, v in lx.PHRASE_DICTIONARY)


@query("fn_dict_translate", f"""
SELECT doc_id, CASE WHEN len(hits) > 0 THEN array_to_string(list_transform(hits, lambda h: h.v), ' ') ELSE text END AS translated
FROM (SELECT doc_id, text, list_filter([{_DICT}], lambda h: contains(lower(text), h.k)) AS hits FROM documents)""")
def _(t):
    return t["documents"].select("doc_id", T.dictionary_translate("text").alias("translated"))


@query("fn_prompt_ensemble", """
SELECT item_id AS query_id, i::BIGINT AS prompt_no, CASE i WHEN 0 THEN text WHEN 1 THEN 'a photo of ' || text
  WHEN 2 THEN 'a video frame showing ' || text WHEN 3 THEN 'a scene of ' || text ELSE text || ' in high quality' END AS prompt
FROM (SELECT item_id, text, unnest(range(CASE WHEN text = '' THEN 1 ELSE 5 END)) AS i FROM benchmark)""")
def _(t):
    return t["benchmark"].select(F.col("item_id").alias("query_id"), F.posexplode(T.prompts("text")).alias("p", "prompt")).select(
        "query_id", F.col("p").cast("bigint").alias("prompt_no"), "prompt")


@query("fn_subscenes", """
SELECT query_id, scene_no::BIGINT AS scene_no, scene FROM (
  SELECT query_id, unnest(parts) AS scene, unnest(range(len(parts))) AS scene_no FROM scene_parts)""")
def _(t):
    return t["benchmark"].select(F.col("item_id").alias("query_id"), F.posexplode(T.subscenes("text")).alias("p", "scene")).select(
        "query_id", F.col("p").cast("bigint").alias("scene_no"), "scene")


def _intent_case(field: int) -> str:
    value = lambda rule: repr(lx.INTENTS[rule][field]) if isinstance(lx.INTENTS[rule][field], str) else f"{lx.INTENTS[rule][field]}"
    quoted = lx.QUOTED.replace("'", "''")
    return (
        f"CASE WHEN regexp_matches(text, '{quoted}') THEN {value('quoted')} "
        f"WHEN regexp_matches(lower(text), '{lx.whole_word(lx.OCR_CUES)}') THEN {value('ocr')} "
        f"WHEN regexp_matches(lower(text), '{lx.whole_word(lx.SPEECH_CUES)}') THEN {value('speech')} "
        f"WHEN regexp_matches(lower(text), '{lx.whole_word(lx.VISUAL_CUES)}') THEN {value('visual')} ELSE {value('balanced')} END"
    )


_MIX = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'chữ ' WHEN 1 THEN 'phỏng vấn ' WHEN 2 THEN 'xe màu ' ELSE '' END || text AS text FROM documents"""


@query("fn_intent", f"""
SELECT doc_id, {_intent_case(0)} AS category, {_intent_case(1)} AS label, {_intent_case(2)} AS w_dense, {_intent_case(3)} AS w_speech,
  {_intent_case(4)} AS w_ocr, {_intent_case(5)} AS confidence FROM ({_MIX})""")
def _(t):
    head = (F.when(F.col("doc_id") % 5 == 0, "chữ ").when(F.col("doc_id") % 5 == 1, "phỏng vấn ")
            .when(F.col("doc_id") % 5 == 2, "xe màu ").otherwise(""))
    return t["documents"].select("doc_id", T.intent(F.concat(head, "text")).alias("i")).select("doc_id", "i.*")


_FILES = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pack/kis/' WHEN 1 THEN 'QA/' WHEN 2 THEN 'a b/' WHEN 3 THEN './trake/' WHEN 4 THEN '__MACOSX/' ELSE '' END
  || source || ' ' || doc_id || CASE doc_id % 7 WHEN 0 THEN '-qa' WHEN 1 THEN '_trake' ELSE '' END || '.txt' AS path, text FROM documents"""


def _files(t):
    d = F.col("doc_id")
    folder = (F.when(d % 6 == 0, "pack/kis/").when(d % 6 == 1, "QA/").when(d % 6 == 2, "a b/").when(d % 6 == 3, "./trake/")
              .when(d % 6 == 4, "__MACOSX/").otherwise(""))
    mark = F.when(d % 7 == 0, "-qa").when(d % 7 == 1, "_trake").otherwise("")
    return t["documents"].select("doc_id", F.concat(folder, "source", F.lit(" "), d.cast("string"), mark, F.lit(".txt")).alias("path"), "text")


def _mode_sql() -> str:
    out = "CASE "
    for m in lx.MODES:
        marks = [f"contains(lower(path), '{x}')" for x in (f"-{m}", f"_{m}", f"/{m}/")] + [
            f"ends_with(lower(path), '{m}.{e}')" for e in ("txt", "csv", "json")]
        out += f"WHEN {' OR '.join(marks)} THEN '{m}' "
    for m, cues in lx.MODE_PROMPT_CUES.items():
        out += f"WHEN regexp_matches(lower(text), '{'|'.join(cues)}') THEN '{m}' "
    return out + "ELSE 'kis' END"


@query("fn_query_mode", f"SELECT doc_id, {_mode_sql()} AS mode FROM ({_FILES})")
def _(t):
    return _files(t).select("doc_id", T.query_mode("path", "text").alias("mode"))


@query("fn_query_id", f"""
SELECT doc_id, regexp_replace(CASE WHEN parent IN ('kis', 'qa', 'trake') AND NOT contains(lower(base), parent) THEN parent || '-' || base ELSE base END, '\\s+', '_', 'g') AS query_id
FROM (SELECT doc_id, regexp_replace(parts[-1], '\\.[^/.]+$', '') AS base, CASE WHEN len(parts) > 1 THEN lower(parts[-2]) END AS parent
  FROM (SELECT doc_id, list_filter(string_split(path, '/'), lambda p: p <> '' AND p <> '.' AND NOT starts_with(p, '__MACOSX')) AS parts FROM ({_FILES})))""")
def _(t):
    return _files(t).select("doc_id", T.query_id("path").alias("query_id"))


@query("fn_video_id", r"""
SELECT page_id, regexp_replace(string_split(trim(url), '/')[-1], '[^a-zA-Z0-9_\-]', '', 'g') AS safe_id,
  CASE WHEN strpos(substr(b, 2), '.') > 0 THEN regexp_replace(b, '\.[^.]*$', '') ELSE b END AS stem
FROM (SELECT page_id, url, string_split(trim(url), '/')[-1] AS b FROM pages)""")
def _(t):
    return t["pages"].select("page_id", T.safe_video_id("url").alias("safe_id"), T.file_stem("url").alias("stem"))


@query("fn_csv_escape", r"""
SELECT doc_id, CASE WHEN regexp_matches(cut, '[,"]') THEN '"' || replace(cut, '"', '""') || '"' ELSE cut END AS field
FROM (SELECT doc_id, substr(trim(translate(text, chr(13) || chr(10), '  ')), 1, 100) AS cut FROM documents)""")
def _(t):
    return t["documents"].select("doc_id", T.csv_field("text").alias("field"))


@query("fn_asr_field_chain", """
SELECT conv_id, turn, trim(coalesce(refined, cleaned, text)) AS text, coalesce(s1, s2, 0.0) AS start_sec, coalesce(e1, e2, coalesce(s1, s2, 0.0) + 1.0) AS end_sec FROM (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'refined ' || text END AS refined, CASE WHEN role = 'assistant' THEN 'cleaned ' || text END AS cleaned, text,
    CASE WHEN turn % 2 = 0 THEN turn * 2.0 END AS s1, CASE WHEN turn % 3 = 0 THEN turn * 3.0 END AS s2,
    CASE WHEN turn % 2 = 0 THEN turn * 2.0 + 1.5 END AS e1, CASE WHEN turn % 5 = 0 THEN turn * 5.0 END AS e2 FROM conversations)""")
def _(t):
    k = F.col("turn")
    raw = t["conversations"].select(
        "conv_id", "turn", F.when(F.col("role") == "user", F.concat(F.lit("refined "), "text")).alias("refined"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("cleaned "), "text")).alias("cleaned"), "text",
        F.when(k % 2 == 0, k * 2.0).alias("s1"), F.when(k % 3 == 0, k * 3.0).alias("s2"),
        F.when(k % 2 == 0, k * 2.0 + 1.5).alias("e1"), F.when(k % 5 == 0, k * 5.0).alias("e2"))
    start = T.segment_start("s1", "s2")
    return raw.select("conv_id", "turn", T.segment_text("refined", "cleaned", "text").alias("text"), start.alias("start_sec"),
                      T.segment_end("e1", "e2", start).alias("end_sec"))


@query("fn_frames", """
SELECT video_id, segment_id, round_even(start_sec * 25.0, 0)::BIGINT AS start_frame, round_even(coalesce(e, start_sec + 3.0) * 25.0, 0)::BIGINT AS end_frame
FROM (SELECT *, CASE WHEN role <> 'system' THEN end_sec END AS e FROM segments)""")
def _(t):
    s = t.segments
    end = F.coalesce(F.when(F.col("role") != "system", F.col("end_sec")), F.col("start_sec") + 3.0)
    return s.select("video_id", "segment_id", T.frame_of("start_sec").alias("start_frame"), T.frame_of(end).alias("end_frame"))


@query("fn_calib_minmax", f"SELECT query_id, kf_id, {R('norm')} AS norm FROM dense_norm")
def _(t):
    from cuelight.operators import dense as D

    spans = D.ranges(t.queries, t.keyframes)
    return D.all_scores(t.queries, t.keyframes).join(spans, "query_id").select(
        "query_id", "kf_id", r6(N.minmax("dense", "lo", "hi")).alias("norm"))


@query("fn_calib_maxnorm", f"""
SELECT query_id, doc_id, {R('score / greatest(1e-6, max(score) OVER (PARTITION BY query_id))')} AS norm FROM doc_hits""")
def _(t):
    from cuelight.operators.fusion import calibrate_max
    from cuelight.operators.lexical import bm25

    return calibrate_max(bm25(t.lex_queries, t.docs)).select("query_id", "doc_id", r6("score").alias("norm"))


@query("fn_calib_saturate", f"""
SELECT event_id, {R("value / (25.0 + value)")} AS speech,
  {R("CASE WHEN event_type = 'view' THEN least(1.0, value / (15.0 + value) * 1.2) ELSE value / (25.0 + value) END")} AS plain_ocr,
  {R("CASE WHEN event_type = 'view' THEN least(1.0, value / (15.0 + value) * (1.5 + 0.60 * 2.0)) ELSE value / (25.0 + value) END")} AS boosted_ocr
FROM events""")
def _(t):
    e = t["events"].withColumn("source", F.when(F.col("event_type") == "view", "ocr").otherwise("asr"))
    return e.select("event_id", r6(N.saturate("value")).alias("speech"), r6(N.saturate("value", "source")).alias("plain_ocr"),
                    r6(N.saturate("value", "source", 0.60)).alias("boosted_ocr"))


@query("fn_calib_linear_clip", f"""
SELECT event_id, {R("least(greatest((value / 100.0 - 0.70) / 0.20, 0.0), 1.0)")} AS cosine, {R("least(greatest(value / 100.0, 0.0), 1.0)")} AS clipped FROM events""")
def _(t):
    x = F.col("value") / 100.0
    return t["events"].select("event_id", r6(N.linear_clip(x)).alias("cosine"), r6(N.clip(x)).alias("clipped"))


@query("fn_sigmoid", f"SELECT event_id, {R('1.0 / (1.0 + exp(-(value - 50.0) / 20.0))')} AS p FROM events")
def _(t):
    return t["events"].select("event_id", r6(N.sigmoid((F.col("value") - 50.0) / 20.0)).alias("p"))


@query("fn_token_estimate", r"""
SELECT doc_id, (floor(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) * 1.35) + 10)::BIGINT AS tokens_est FROM documents""")
def _(t):
    return t["documents"].select("doc_id", T.token_estimate("text").alias("tokens_est"))


@query("fn_box_xywh", f"""
SELECT vec_id, {R('e[2]')} AS x, {R('e[1]')} AS y, {R('greatest(0.0, e[4] - e[2])')} AS w, {R('greatest(0.0, e[3] - e[1])')} AS h
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def _(t):
    b = t["embeddings"].select("vec_id", N.box_xywh(N.as_doubles("embedding")).alias("b"))
    return b.select("vec_id", *[r6(F.col("b")[i]).alias(c) for i, c in enumerate("xywh")])


@query("fn_param_clamp", f"""
SELECT event_id, greatest(1, least(1000, coalesce(try_cast(k AS BIGINT), 100)))::BIGINT AS top_k,
  {R("greatest(0.5, least(30.0, coalesce(try_cast(v AS DOUBLE), 5.0)))")} AS window_sec,
  {R("CASE WHEN try_cast(v AS DOUBLE) IS NULL OR try_cast(k AS DOUBLE) IS NULL THEN 0.85 ELSE least(greatest(v::DOUBLE / 100.0, 0.0), 1.0) END")} AS w_dense,
  {R("CASE WHEN try_cast(v AS DOUBLE) IS NULL OR try_cast(k AS DOUBLE) IS NULL THEN 0.15 ELSE least(greatest(k::DOUBLE / 50.0, 0.0), 1.0) END")} AS w_speech
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN event_type ELSE value::VARCHAR END AS v,
  CASE WHEN event_type = 'view' THEN 'many' ELSE json_extract_string(props, '$.k') END AS k FROM events)""")
def _(t):
    e = t["events"].select(
        "event_id", F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("value").cast("string")).alias("v"),
        F.when(F.col("event_type") == "view", "many").otherwise(F.get_json_object("props", "$.k")).alias("k"))
    w = N.clamp_weights(F.col("v").try_cast("double") / 100.0, F.col("k").try_cast("double") / 50.0)
    return e.select("event_id", N.clamp_int("k", 1, 1000, 100).alias("top_k"), r6(N.clamp_double("v", 0.5, 30.0, 5.0)).alias("window_sec"),
                    r6(w["w_dense"]).alias("w_dense"), r6(w["w_speech"]).alias("w_speech"))


def _strip_sql(col: str) -> str:
    out = col
    for p in lx.BANNED_PREFIXES:
        out = (f"CASE WHEN starts_with(lower({out}), '{p}') THEN regexp_replace(substr({out}, {len(p) + 1}), '^[ :,.\\-]+|[ :,.\\-]+$', '', 'g') ELSE {out} END")
    return out


@query("fn_prefix_strip", f"""
SELECT doc_id, {_strip_sql('p')} AS query FROM (
  SELECT doc_id, trim(CASE doc_id % 3 WHEN 0 THEN 'Trong video: ' WHEN 1 THEN 'Hình ảnh - đoạn phim, ' ELSE '' END || text) AS p FROM documents) WHERE length(p) >= 6""")
def _(t):
    head = F.when(F.col("doc_id") % 3 == 0, "Trong video: ").when(F.col("doc_id") % 3 == 1, "Hình ảnh - đoạn phim, ").otherwise("")
    return t["documents"].select("doc_id", T.strip_banned_prefixes(F.concat(head, "text")).alias("query")).filter("query is not null")
