"""Small literal cases, most of them with known numbers."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.operators import dense as D
from cuelight.operators import evaluation as E
from cuelight.operators import fusion as X
from cuelight.operators import intervals as I
from cuelight.operators import lexical as L
from cuelight.operators import ordered as O
from cuelight.operators import sequence as S
from cuelight.operators import submission as SB
from cuelight.operators import transcripts as TR


def one(spark, **cols):
    return spark.range(1).select(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in cols.items()]).head()


def unit_vectors(n, d, seed=0):
    m = np.random.default_rng(seed).normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def frames(spark, m, video=lambda i: "v"):
    rows = [(i, video(i), i + 1, float(i), 25.0, 30 * i, [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "kf_id long, video_id string, n long, pts_time double, fps double, frame_idx long, embedding array<double>")


def asked(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id long, embedding array<double>")


@pytest.mark.parametrize("text,want", [
    ("Xin chào, a _ b_c! 42", ["xin", "chào", "a", "b_c", "42"]), ("", []), ("_ _", []), ("đĩa bát", ["đĩa", "bát"]),
])
def test_tokenize(spark, text, want):
    assert one(spark, t=T.tokenize(F.lit(text))).t == want


@pytest.mark.parametrize("text,want", [
    ("tìm video về con mèo", "con mèo"), ("cảnh sát giao thông", "cảnh sát giao thông"), ("Cảnh biển", "biển"),
    ("hãy tìm người đàn ông", "người đàn ông"),
])
def test_clean_query(spark, text, want):
    assert one(spark, t=T.clean_query(F.lit(text))).t == want


@pytest.mark.parametrize("text,category", [
    ('dòng "Hà Nội" trên tường', "visual_entity_text_grounded"), ("biển hiệu quán", "visual_entity_text_grounded"),
    ("cô ấy nói về mùa xuân", "speech_dialogue_grounded"), ("chiếc xe màu đỏ", "visual_scene_object"), ("bầu cử quốc hội", "balanced_multimodal"),
])
def test_intent(spark, text, category):
    assert one(spark, i=T.intent(F.lit(text))).i.category == category


def test_prompts_and_translation(spark):
    r = one(spark, p=T.prompts(F.lit("a cat")), e=T.prompts(F.lit("")), d=T.dictionary_translate(F.lit("Con Mèo và chó")), n=T.dictionary_translate(F.lit("xyz")))
    assert len(r.p) == 5 and r.p[1] == "a photo of a cat" and r.e == [""]
    assert r.d == "dog cat" and r.n == "xyz"


def test_names_and_csv(spark):
    r = one(spark, a=T.query_id(F.lit("pack/KIS/my query.txt")), b=T.query_id(F.lit("x/kis-1.txt")), c=T.query_mode(F.lit("q_qa.txt"), F.lit("")),
            d=T.file_stem(F.lit("a/L01_V028.mp4")), e=T.csv_field(F.lit('say "hi", you\n')), f=T.safe_video_id(F.lit("../x y!.mp4")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("kis-my_query", "kis-1", "qa", "L01_V028", '"say ""hi"", you"', "xymp4")


def test_bm25_matches_formula(spark):
    docs = spark.createDataFrame([(0, "red car red"), (1, "blue car"), (2, "green tree"), (3, " ")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "red car car"), (1, "nothing")], "query_id long, text string")
    got = {r.doc_id: r.score for r in L.bm25(q, docs).collect()}
    n, avg = 3, (3 + 2 + 2) / 3
    idf = lambda df: np.log((n - df + 0.5) / (df + 0.5) + 1)
    tfn = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got[0] == pytest.approx(idf(1) * tfn(2, 3) + 2 * idf(2) * tfn(1, 3), abs=1e-8)
    assert got[1] == pytest.approx(2 * idf(2) * tfn(1, 2), abs=1e-8) and set(got) == {0, 1}


def test_top_documents_build_no_index(spark, monkeypatch):
    """tk_bm25 counts the terms of its queries alone; slices of the documents change nothing."""
    from cuelight import catalog

    def built(*_):
        raise AssertionError("all terms of all documents are counted")

    run = lambda: sorted(map(tuple, catalog.queries()["tk_bm25"](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(L, "build_index", built)
    want = run()
    monkeypatch.setattr(L, "SCORES", 64)
    assert len(want) > 0 and run() == want


def test_stored_index_gives_the_same(spark, tmp_path):
    from cuelight.sources.writers import read_index, write_index

    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} common") for i in range(30)], "doc_id long, text string")
    q = spark.createDataFrame([(0, "w1 common"), (1, "w4")], "query_id long, text string")
    write_index(L.build_index(docs), str(tmp_path))
    a = sorted(map(tuple, L.search_index(q, read_index(spark, str(tmp_path)), 7).collect()))
    assert a == sorted(map(tuple, L.bm25(q, docs, 7).collect())) and len(a) == 13


def test_frequent_term_of_a_stored_index(spark, tmp_path):
    """A term of every document lies in several files, documents cut by batches are whole again, no pair of query and document is shuffled."""
    from cuelight.sources.writers import read_index, write_index

    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 700} common common") for i in range(4000)], "doc_id long, text string").repartition(6)
    q = spark.createDataFrame([(0, "w1 common"), (1, "w4 w4 common"), (2, "nowhere")], "query_id long, text string")
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {c: spark.conf.get(c) for c in names}
    try:
        for c, v in names.items():
            spark.conf.set(c, v)
        write_index(L.build_index(docs), str(tmp_path))
        index = read_index(spark, str(tmp_path))
        common = index.postings.filter("term = 'common'")
        assert common.select(F.input_file_name()).distinct().count() > 1 and common.filter("tf = 2").count() == 4000
        found = L.search_index(q, index, 30)
        assert "keys=[query_id" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, L.bm25(q, docs, 30).collect()))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_many_phrases_equal_few(spark):
    docs = spark.createDataFrame([(i, f"Alpha b{i} gamma") for i in range(40)], "doc_id long, text string")
    kw = spark.createDataFrame([(i, f"B{i} g") for i in range(40)] + [(99, "alpha")], "query_id long, keyword string")
    many = {(r.query_id, r.doc_id) for r in L.phrase_hits(kw, docs).collect()}
    want = {(i, i) for i in range(40)} | {(99, i) for i in range(40)}
    assert many == want
    assert {(r.query_id, r.doc_id) for r in L.phrase_hits(kw.filter("query_id > 30"), docs).collect()} == {p for p in want if p[0] > 30}


def test_phrases_by_trigrams(spark, tmp_path, monkeypatch):
    from cuelight.operators import grams as GR

    monkeypatch.setattr(GR, "FOLDERS", 3)
    texts = [f"Boat {i} at SEA" for i in range(60)] + ["", None, "se", "red\nboat", "Größe und Maß", "a\U0001f600b\U0001f600c", "Boat 7 at SEA"]
    docs = spark.createDataFrame([(None if i == 65 else i % 64, x, "extra") for i, x in enumerate(texts)], "doc_id long, text string, block string").drop("block")
    asked = ["boat 7", " At Sea ", "d\nb", "SE", "", "  ", None, "größe", "boat 7 by", "zzz", "b\U0001f600c", "aaaa", "e", "boat 7"]
    kw = spark.createDataFrame(list(enumerate(asked)), "query_id long, keyword string")
    GR.write_gram_index(docs, str(tmp_path), block_docs=8)
    index = GR.read_gram_index(spark, str(tmp_path))
    got = sorted((r.query_id, r.text) for r in GR.phrase_hits(kw, index).collect())
    want = sorted((i, x) for i, k in enumerate(asked) if k and k.strip() for x in texts if x is not None and k.strip().lower() in x.lower())
    assert got == want
    # only documents with the rarest trigrams are compared
    few = GR.candidates(spark.createDataFrame([("boat 7",), ("boat 7 by",), ("at sea",)], "_phrase string"), index).groupBy("_phrase").count().collect()
    assert {r["_phrase"]: r["count"] for r in few} == {"boat 7": 2, "at sea": 61}


def test_stored_terms_grow_with_their_batches(spark, tmp_path):
    from cuelight.functions import text as T
    from cuelight.streaming import terms as TS

    rows = [(i % 7, f"w{i % 3} w{i % 5} common common") for i in range(30)] + [(0, " "), (8, None), (9, ""), (None, "w1 lost")] + [(20 + i, f"rare{i} w4") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(0, "w1 common"), (1, "w4 lost"), (2, "none")], "query_id long, text string")
    for i in range(3):
        docs.filter(F.pmod(F.xxhash64("text"), F.lit(3)) == i).write.mode("append").parquet(str(tmp_path / "in"))

    def run(name, **how):
        arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        TS.append_terms(arriving, str(tmp_path / name), str(tmp_path / f"{name}_ck"), **how).awaitTermination()
        return TS.read_terms(spark, str(tmp_path / name))

    def seen(stored):
        return sorted(map(tuple, stored.term_stats().collect())), [(n, round(x, 9)) for n, x in stored.index().corpus.collect()]

    stored = run("terms")
    assert stored.new_pairs.select("batch").distinct().count() >= 2
    whole = docs.filter(T.strip("text") != "").groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    once = L.build_index(whole)
    want = sorted(map(tuple, once.term_stats.collect())), [(n, round(x, 9)) for n, x in once.corpus.collect()]
    assert seen(stored) == want
    hits = lambda df: sorted((r.query_id, r["rank"], -1 if r.doc_id is None else r.doc_id, round(r.score, 6)) for r in df.collect())
    assert hits(TS.search_terms(queries, stored, 20)) == hits(L.bm25(queries, whole, 20))
    # a batch whose commit was lost runs again and adds nothing
    last = max((tmp_path / "terms_ck/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink()
    assert seen(run("terms")) == want
    pieces = run("pieces", tokenizer=T.tokenize_words, blank=True)
    got = hits(TS.okapi_terms(queries, pieces, 20))
    assert got and got == hits(L.okapi(queries, docs, 20, "doc_id"))
    assert pieces.new_keys.agg(F.sum("n_docs")).head()[0] == 30  # 27, two without a text, one without a key


def test_self_query_returns_itself(spark):
    m = unit_vectors(100, 64)
    kf = frames(spark, m, lambda i: f"v{i // 10}")
    top = D.topk(asked(spark, [m[5], m[7]]), kf, 5).filter("rank = 1").orderBy("query_id").collect()
    assert [r.kf_id for r in top] == [5, 7] and top[0].dense == pytest.approx(1.0)


def test_topk_ties_groups_and_passes(spark, monkeypatch):
    m = np.repeat(unit_vectors(4, 8), 5, axis=0)
    kf = frames(spark, m, lambda i: f"v{i % 2}").repartition(7)
    q = asked(spark, unit_vectors(9, 8, 3))
    whole = sorted((r.query_id, r.rank, r.kf_id, r.lo, r.hi) for r in D.topk(q, kf, 6).collect())
    for qi, v in enumerate(unit_vectors(9, 8, 3)):
        s = np.floor(m @ v * 1e9 + 0.5) / 1e9
        best = sorted(range(20), key=lambda i: (-s[i], i))[:6]
        assert [x[2] for x in whole if x[0] == qi] == best
    monkeypatch.setattr(D, "PASS_ROWS", 2)
    assert whole == sorted((r.query_id, r.rank, r.kf_id, r.lo, r.hi) for r in D.topk(q, kf, 6).collect())
    per = D.topk(q, kf, 2, group="video_id").groupBy("query_id", "video_id").count().collect()
    assert len(per) == 18 and all(r["count"] == 2 for r in per)


def test_ivf_recall_and_near_duplicates(spark):
    m = unit_vectors(300, 16)
    kf = frames(spark, m)
    q = asked(spark, m[:20])
    exact = {(r.query_id, r.kf_id) for r in D.topk(q, kf, 5).collect()}
    near = {(r.query_id, r.kf_id) for r in D.ivf_topk(q, kf, 5, n_list=10, n_probe=5).collect()}
    assert len(exact & near) / len(exact) > 0.6
    full = {(r.query_id, r.rank, r.kf_id) for r in D.near_duplicates(kf, 3, block_rows=37).collect()}
    s = np.floor(m @ m.T * 1e9 + 0.5) / 1e9
    for i in (0, 17, 299):
        best = sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:3]
        assert [k for _, _, k in sorted(x for x in full if x[0] == i)] == best
    celled = {(r.query_id, r.kf_id) for r in D.near_duplicates(kf, 3, block_rows=50, mode="cells", n_list=6, n_probe=6).collect()}
    assert celled == {(a, c) for a, _, c in full}


def test_align_is_increasing_and_best(spark):
    m = unit_vectors(50, 32)
    ev = spark.createDataFrame([(0, i, [float(x) for x in m[k]]) for i, k in enumerate((10, 20, 30))], "query_id long, event_no int, embedding array<double>")
    r = S.align(ev, frames(spark, m), chunk_rows=7).collect()
    assert [list(x.frames) for x in r] == [[300, 600, 900]] and r[0].score == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("n", [17, 40])
def test_align_takes_any_number_of_events(spark, n):
    m = unit_vectors(60, 32)
    ev = spark.createDataFrame([(0, i, [float(x) for x in m[i]]) for i in range(n)], "query_id long, event_no int, embedding array<double>")
    r = S.align(ev, frames(spark, m), chunk_rows=16).collect()
    assert [list(x.frames) for x in r] == [[30 * i for i in range(n)]]


@pytest.mark.parametrize("seed", range(6))
def test_alignment_matrices_against_brute_force(seed):
    from itertools import combinations

    from cuelight.operators.maxplus import chunk_matrix, fold

    rng = np.random.default_rng(seed)
    scores = rng.integers(-3, 4, (11, 3)).astype(np.int64)  # few values, many ties
    at = np.arange(1, 12)
    want = max(((sum(int(scores[t, e]) for e, t in enumerate(p)), tuple(-at[t] for t in reversed(p)), p) for p in combinations(range(11), 3)))
    for width in (1, 2, 4, 11):
        parts = [chunk_matrix(scores[k : k + width], at[k : k + width], at[k : k + width] * 10) for k in range(0, 11, width)]
        total, where, frames = fold(iter(parts), 3)
        assert (total, where) == (want[0], [int(at[t]) for t in want[2]]) and frames == [10 * w for w in where]
    assert fold(iter([chunk_matrix(scores[:2], at[:2], at[:2])]), 3) is None


def test_candidates_without_a_segment_are_their_own_window(spark):
    seg = spark.createDataFrame([("v", i, i + 1, 2.0 * i, 2.0 * i + 1.5, 50 * i, 50 * i + 37, f" t{i}\n") for i in range(4)],
                                "video_id string, segment_id long, position long, start_sec double, end_sec double, start_frame long, end_frame long, text string")
    cand = spark.createDataFrame([(0, 1, "v", 1, 2.0, 3.5), (0, 2, "v", 99, 50.0, 51.0), (0, 3, "x", 1, 2.0, 3.5)],
                                 "query_id long, rank int, video_id string, segment_id long, start_sec double, end_sec double")
    got = {r["rank"]: (r.win_start, r.win_end, r.num_segments, r.context) for r in S.context_windows(cand, seg).collect()}
    assert got == {1: (0.0, 5.5, 3, "t0 t1 t2"), 2: (50.0, 51.0, 1, "")}


def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([("\t \n",), (" a\tb\r\n",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(T.strip("x")).collect()] == ["", "a\tb", "", None]
    docs = spark.createDataFrame([(0, "one two"), (1, "\n"), (2, "\t \n")], "doc_id long, text string")
    assert {r.doc_id for r in L.tokens_of(docs).collect()} == {0}


def test_suppression_invariants(spark):
    rng = np.random.default_rng(1)
    rows = [(0, i + 1, f"v{rng.integers(3)}", i, float(rng.uniform(0, 40)), 0.0) for i in range(120)]
    pool = spark.createDataFrame(rows, "query_id long, rank int, video_id string, kf_id long, pts_time double, score double")
    kept = S.suppress(pool, 1000, 2.0).collect()
    for a in kept:
        assert all(a.kf_id == b.kf_id or a.video_id != b.video_id or abs(a.pts_time - b.pts_time) >= 2.0 for b in kept)
    ids = {k.kf_id for k in kept}
    for _, rank, v, i, p, _ in rows:
        if i not in ids:
            assert any(k.video_id == v and abs(k.pts_time - p) < 2.0 and k.pool_rank < rank for k in kept)


def test_text_runs_over_chunks(spark):
    lines = [("v", i, float(t), x) for i, (t, x) in enumerate([(0, "A"), (3, "A"), (9, "A"), (15.5, "A"), (16, "B"), (17, "A"), (23, "A")])]
    df = spark.createDataFrame(lines, "video_id string, line_id long, t_sec double, text string")
    for width in (2.0, 1000.0):
        got = [(r.start_sec, r.end_sec, r.text, r.n_lines) for r in O.text_runs(df, chunk_width=width).orderBy("run_id").collect()]
        assert got == [(0.0, 12.0, "A", 3), (15.5, 18.5, "A", 1), (16.0, 19.0, "B", 1), (17.0, 26.0, "A", 2)]


def test_chunked_primitives_do_not_depend_on_chunks(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i, float((i * 7) % 11)) for i in range(60)], "k string, i long, x double")
    res = []
    for c in (3, 1000):
        chunk = F.floor(F.col("i") / c)
        p = O.with_position(df, ["k"], ["i"], chunk)
        p = O.with_previous(p, ["k"], ["i"], chunk, ["x"])
        p = O.running_sum(p, ["k"], ["i"], chunk, "x", "s")
        p = O.prefix_max(p, ["k"], ["i"], chunk, "x", "m")
        p = O.gaussian(p, ["k"], "pos", "x", "g", chunk_rows=c)
        res.append(sorted((r.k, r.pos, r.prev and r.prev.x, r.s, r.m, round(r.g, 9)) for r in p.collect()))
    assert res[0] == res[1]
    xs = [float((i * 7) % 11) for i in range(60) if i % 3 == 0]
    w = np.exp(-0.5 * (np.arange(-2, 3) / 1.5) ** 2)
    want = np.convolve(np.pad(xs, 2, mode="edge"), w / w.sum(), mode="valid")
    assert [r[5] for r in res[0] if r[0] == "b"] == pytest.approx(list(want), abs=1e-8)


def test_interval_joins_over_bins(spark):
    seg = spark.createDataFrame([("v", 0, 10.0, 200.0, "x"), ("v", 1, 300.0, 301.0, "y")], "video_id string, segment_id long, start_sec double, end_sec double, text string")
    pts = spark.createDataFrame([("v", i, float(i)) for i in range(0, 400, 5)], "video_id string, kf_id long, pts_time double")
    got = sorted((r.segment_id, r.kf_id) for r in I.point_in_interval(seg, pts, 5.0).collect())
    assert got == [(0, i) for i in range(5, 206, 5)] + [(1, 295), (1, 300), (1, 305)]
    spoken = {r.kf_id: r.spoken for r in I.active_segment(pts, seg, ["kf_id"]).collect()}
    assert spoken[100] == "x" and spoken[310] == "[300.0s] y" and spoken[350] == ""
    clips = spark.createDataFrame([(0, "v", 190.0, 310.0)], "q long, video_id string, clip_start double, clip_end double")
    assert I.interval_overlap(clips, seg, 0.0, bin_sec=20.0).count() == 2


def test_shot_bounds(spark):
    b = spark.createDataFrame([("v", t, int(t * 25)) for t in (0.0, 4.0, 5.0, 20.0)], "video_id string, pts_time double, frame_idx long")
    p = spark.createDataFrame([(0, "v", 4.5), (1, "v", 30.0), (2, "none", 1.0), (3, "v", 12.0)], "i long, video_id string, pts_time double")
    got = {r.i: (r.start_sec, r.end_sec, list(r.frames)) for r in I.shot_bounds(p, b, ["i"]).collect()}
    assert got == {0: (4.0, 5.0, [100, 125]), 1: (28.5, 30.0, []), 2: (0.0, 2.5, []), 3: (10.5, 13.5, [])}


def test_metrics(spark):
    runs = spark.createDataFrame([(0, i + 1, "a", 505 if i == 2 else 1) for i in range(100)], "query_id long, rank int, video_id string, frame_idx long")
    truth = spark.sql("select 0L query_id, 'a' video_id, array(named_struct('s', 500L, 'e', 510L)) intervals")
    r = E.kis(runs, truth).head()
    assert (r.r_at_1, r.r_at_5, r.final_score) == (0.0, 1.0, pytest.approx(0.8))
    seq = spark.sql("select 0L query_id, 1 rank, 'a' video_id, array(101L, 156L, 203L, 251L) frames")
    t = spark.sql("select 0L query_id, 'a' video_id, array(named_struct('s',95L,'e',105L), named_struct('s',145L,'e',155L), named_struct('s',195L,'e',205L), named_struct('s',245L,'e',255L)) intervals")
    assert E.sequences(seq, t).head().final_score == pytest.approx(0.75)
    qa = spark.sql("select 0L query_id, 1 rank, 'a' video_id, 850L frame_idx, ' Blue ' answer")
    t = spark.sql("select 0L query_id, 'a' video_id, 800L s, 900L e, array('red', 'BLUE') answers")
    assert E.answers(qa, t).head().final_score == 1.0


def test_submission_rows_and_validation(spark):
    q = spark.sql("select 'q1' query_id union all select 'q2'")
    preds = spark.sql("select 'q1' query_id, 1 rank, 'path/L01_V028.mp4' video_id, 12.5D frame_idx, 'a, \"b\"' answer")
    rows = SB.format_qa(preds, q).orderBy("query_id", "row_no").collect()
    assert len(rows) == 200 and rows[0].line == 'L01_V028,12,"a, ""b"""' and rows[150].line == "L21_V001,0,"
    lines = SB.format_qa(preds, q).select(F.col("query_id").alias("file"), "row_no", "line")
    assert SB.validate(lines, "qa").count() == 0
    bad = spark.createDataFrame([("f", 1, "video_id,frame"), ("f", 2, "a/b.mp4,3"), ("f", 3, "L1,9,5,7")], "file string, row_no long, line string")
    assert {(r.row_no, r.error) for r in SB.validate(bad).collect()} == {
        (1, "header_row"), (1, "frame_not_integer"), (2, "file_extension"), (2, "path_separator"), (3, "not_chronological")}


@pytest.mark.parametrize("shot,n", [((0, 30, 1.0), 1), ((0, 90, 3.0), 2), ((0, 600, 20.0), 3)])
def test_shot_samples(spark, shot, n):
    df = spark.createDataFrame([shot], "start_frame long, end_frame long, duration_sec double")
    got = [r.sample_frame for r in S.shot_samples(df, 30.0).collect()]
    assert (len(got) == n if n < 3 else len(got) >= 3) and got == sorted(got) and all(0 <= g <= shot[1] for g in got)


def test_shots_fold(spark):
    rng = np.random.default_rng(0)
    rows = [("v", i, [float(x) for x in (rng.normal(size=8) if i in (4, 5, 9, 20) else np.arange(8))]) for i in range(22)]
    df = spark.createDataFrame(rows, "video_id string, frame_no long, hist array<double>")
    corr = [None] + [np.corrcoef(rows[i - 1][2], rows[i][2])[0, 1] for i in range(1, 22)]
    want, start = [], 0
    for i in range(1, 22):
        if 1 - corr[i] > 0.35 and i - start >= 3:
            want.append((start, i - 1))
            start = i
    if 22 - start >= 3:
        want.append((start, 21))
    for rows_per_chunk in (4.0, 100.0):
        assert [(r.start_frame, r.end_frame) for r in S.shots(df, chunk_rows=rows_per_chunk).orderBy("start_frame").collect()] == want


def test_generated_transcripts(spark):
    o = spark.createDataFrame([("a", i, f"text {i}") for i in range(2)] + [("b", i, "x") for i in range(2)], "video_id string, segment_no long, text string")
    out = spark.createDataFrame([("a", "[SEGMENT 0]\ntext 0\n\n[SEGMENT 1] other"), ("b", "Here is it [SEGMENT 0] x")], "video_id string, raw_output string")
    r = {x.video_id: x for x in TR.validate_generated(out, o).collect()}
    assert r["a"].reason is None and r["a"].changed_count == 1 and r["b"].reason == "preamble"
    tag = spark.sql("select 'a' video_id, '<SEGMENT_0>\nx\n</SEGMENT_0>\n<SEGMENT_2>\ny\n</SEGMENT_2>' raw_output, 2 n_expected")
    assert TR.validate_tagged(tag).head().error == "missing_segment_index"
    assert TR.validate_tagged(tag.withColumn("n_expected", F.lit(3))).head().error == "segment_count_mismatch"


def test_a_phrase_behind_the_first_marker_is_no_preamble(spark):
    o = spark.createDataFrame([(v, i, "x") for v in "abcd" for i in range(2)], "video_id string, segment_no long, text string")
    out = spark.createDataFrame(
        [("a", "[SEGMENT 1]\nthere is more"), ("b", "[SEGMENT 0] here is\n[SEGMENT 1] x"), ("c", "Here is [SEGMENT 1] x"), ("d", "[SEGMENTS] here is")],
        "video_id string, raw_output string")
    got = {x.video_id: x.reason for x in TR.validate_generated(out, o).collect()}
    assert got == {"a": "id_mismatch", "b": None, "c": "preamble", "d": "preamble"}


def test_flood_is_worked_off_where_the_centre_lies(spark):
    c = spark.createDataFrame([(1, "v", 1), (2, "v", 50), (3, "w", -4)], "kf_id long, video_id string, frame_idx long")
    out = S.neighbour_flood(c, ["kf_id"], 5, 2)
    got = {k: [r.frame for r in sorted(rows, key=lambda r: r.row_no)] for k, rows in itertools.groupby(out.orderBy("kf_id").collect(), lambda r: r.kf_id)}
    assert got == {1: [1, 3, 5, 7, 9], 2: [50, 48, 52, 46, 54], 3: [-4, 0, 2, 4, 6]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_documents_are_scored_where_they_lie(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(["a", "b", "c"][: i % 3 + 1] * (i % 5 + 1))) for i in range(60)], "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame([(1, "b c c"), (2, "a"), (3, "z")], "query_id long, text string")
    found = L.bm25(q, docs, 7)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no posting is shuffled
    want = sorted(map(tuple, L.search_index(q, L.build_index(docs), 7).collect()))
    monkeypatch.setattr(L, "SCORES", 12)
    assert sorted(map(tuple, found.collect())) == want == sorted(map(tuple, L.bm25(q, docs, 7).collect())) and len(want) == 14


def test_pinned_and_buckets(spark):
    res = spark.createDataFrame([(0, i + 1, "v", 10 * i, 0.5) for i in range(5)], "query_id long, rank int, video_id string, frame_idx long, score double")
    pin = spark.createDataFrame([(0, 1, "v", 30)], "query_id long, pin_no int, video_id string, frame_idx long")
    assert [r.frame_idx for r in X.pinned_first(res, pin, 4).orderBy("rank").collect()] == [30, 0, 10, 20]
    rk = spark.createDataFrame([(0, i, "v", i * 1.0, 1.0 - i / 10) for i in range(6)], "query_id long, kf_id long, video_id string, pts_time double, score double")
    assert [r.kf_id for r in X.shot_buckets(rk, 4).orderBy("rank").collect()] == [0, 3, 5, 1]


def test_rerank_falls_back_to_dense(spark):
    from cuelight.hooks import pair_scorer

    c = spark.createDataFrame([(0, i + 1, i, "q", f"t{i}", 1.0 - i / 10) for i in range(4)], "query_id long, rank int, segment_id long, query string, text string, dense double")
    good = X.rerank(c, pair_scorer(lambda q, t: [float(x[1:]) for x in t]), 2).orderBy("rank").collect()
    assert [r.segment_id for r in good] == [3, 2]

    def broken(q, t):
        raise RuntimeError("no model")

    bad = X.rerank(c, pair_scorer(broken), 2).orderBy("rank").collect()
    assert [r.segment_id for r in bad] == [0, 1] and bad[0].rerank_score == 1.0


def test_block_index_skips_and_gives_the_same(spark, tmp_path):
    from cuelight.operators import blockmax as BM
    from cuelight.sources.writers import read_block_index, write_block_index

    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(400)])
    weight = 1.0 / np.arange(1, 401)
    docs = [(i, " ".join(rng.choice(words, size=rng.integers(1, 80), p=weight / weight.sum()))) for i in range(3000)]
    docs += [(3000 + i, docs[17][1]) for i in range(40)] + [(5000, " "), (5001, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame([(0, "w0 w1 w350"), (1, "w120 w7 w7"), (2, "w399"), (3, "nowhere"), (4, docs.filter("doc_id = 17").first().text), (5, "")],
                              "query_id long, text string")
    write_block_index(BM.block_index(docs, block_docs=16), str(tmp_path), 3)
    index = read_block_index(spark, str(tmp_path))
    for k in (1, 10, 300):
        want = sorted(map(tuple, L.bm25(q, docs, k).collect()))
        assert sorted(map(tuple, BM.search(q, index, k).collect())) == want
    _, blocks = BM.rounds(q, index, 10, block_docs=16)
    total, opened = blocks.filter("query_id in (0, 4)").agg(F.count(F.lit(1)), F.count_if("opened")).first()
    assert 0 < opened < 0.75 * total
    # bounds come from two columns of a block
    plan = BM.bounds(BM._weights(q, index), index)._jdf.queryExecution().executedPlan().toString()
    assert "max_tf" in plan and "postings" not in plan


def test_blocks_fill_by_their_own_length(spark, tmp_path):
    """Documents of one word do not thin out the blocks of long ones; blocks are scored whole when a join turns into a broadcast."""
    from cuelight.operators import blockmax as BM
    from cuelight.sources.writers import read_block_index, write_block_index

    rng = np.random.default_rng(11)
    docs = [(i, "view") for i in range(4000)] + [(5000 + i, " ".join(f"w{x}" for x in rng.integers(0, 60, 64 + i % 20))) for i in range(300)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame([(0, "w1 w2 w3 w4"), (1, "w5 view"), (2, "w9 w9 w30 w31 w32")], "query_id long, text string")
    write_block_index(BM.block_index(docs, block_docs=16), str(tmp_path), 3)
    index = read_block_index(spark, str(tmp_path))
    assert index.blocks.filter("min_dl > 1").select("block").distinct().count() == 300 // 16
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        scores, _ = BM.rounds(q, index, 20, block_docs=16)
        assert "keys=[query_id, doc_id" not in scores._jdf.queryExecution().executedPlan().toString().replace("L,", ",")
        assert sorted(map(tuple, L.rank_hits(scores, 20).collect())) == sorted(map(tuple, L.bm25(q, docs, 20).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_pruning_over_chunks(spark):
    rng = np.random.default_rng(5)
    looks = rng.normal(size=(4, 6))
    rows = []
    for v, fps, n in (("a", 25.0, 900), ("b", 3.0, 120), ("c", 1.0, 1)):
        look = 0
        for i in range(n):
            if rng.random() < 0.08:
                look = int(rng.integers(4))
            # constant frames, jumps in time and many static stretches
            rows.append((v, i, 7.0 * (i > n // 2) + i / fps, [0.5] * 6 if rng.random() < 0.01 else [float(x) for x in looks[look] + rng.normal(size=6) * 0.1]))
    want, last = set(), {}
    for v, i, t, h in rows:
        if v in last and t - last[v][0] < 0.5:
            a, b = np.array(last[v][1]), np.array(h)
            if (np.corrcoef(a, b)[0, 1] if a.std() > 1e-12 and b.std() > 1e-12 else 1.0) > 0.96:
                continue
        last[v] = (t, h)
        want.add((v, i))
    df = spark.createDataFrame(rows, "video_id string, frame_no long, pts_time double, hist array<double>").repartition(5)
    assert 50 < len(want) < 700
    for width in (0.7, 3.0, 60.0):
        assert {(r.video_id, r.frame_no) for r in S.prune_static(df, chunk_width=width).collect()} == want


def test_draws_do_not_depend_on_the_order_of_rows(spark):
    from cuelight.operators.sampling import bottom_k, first_successes

    rows = spark.createDataFrame([(f"g{i % 3 if i % 2 else 0}", i) for i in range(900)], "g string, id long")
    a = sorted(map(tuple, bottom_k(rows.repartition(7), ["g"], "id", 20, 3).collect()))
    assert a == sorted(map(tuple, bottom_k(rows.orderBy(F.desc("id")), ["g"], "id", 20, 3).collect()))
    assert len(a) == 60 and len({x[1] for x in a}) == 60
    drawn = {r.id: r.draw_no for r in bottom_k(rows, [], "id", 40, 3).collect()}
    picked = first_successes(rows, [], "id", 10, F.col("id") % 3 == 0, seed=3).orderBy("pick_no").collect()
    want = sorted((i for i in drawn if i % 3 == 0), key=drawn.get)[:10]
    assert [r.id for r in picked] == want and [r.pick_no for r in picked] == list(range(1, len(want) + 1))
    assert bottom_k(rows.filter("g = 'g1'"), ["g"], "id", 10_000).count() == rows.filter("g = 'g1'").count()


def test_an_empty_submission_is_an_error(spark):
    from cuelight.operators.submission import validate

    lines = spark.createDataFrame([("a", 1, " "), ("a", 2, None), ("b", 1, "L1,5"), ("b", 2, "")], "file string, row_no long, line string")
    assert [tuple(r) for r in validate(lines).collect()] == [("a", 0, "empty_file")]


def test_chosen_feedback_weights_are_clamped(spark):
    from cuelight.plans.feedback import fixed_route

    r = fixed_route(spark.createDataFrame([(1,)], "query_id long"), (1.7, -2)).first()
    assert (r.w_dense, r.w_speech) == (1.0, 0.0)


def test_fusion_with_a_reranked_head(spark):
    from cuelight.operators import fusion as X

    cols = "query_id long, rank int, video_id string, start_sec double, end_sec double, text string, score double"
    lex = spark.createDataFrame([(q, i + 1, "v", float(i), i + 1.0, f"w{i}", 10.0 - i) for q in (0, 1) for i in range(6)], cols)
    sem = spark.createDataFrame([(0, 1, "v", 9.0, 10.0, "w9", 0.5)], cols)
    queries = spark.createDataFrame([(0, "a"), (1, "b")], "query_id long, query string")
    # longer start, higher score; the whole of query 1 fails
    score = lambda q, t: F.when(q == "a", F.substring(t, 2, 1).cast("double"))
    for fuse in (X.weighted_norm, X.reciprocal_rank):
        plain = {(r.query_id, r["rank"]): r.text for r in fuse(lex, sem).collect()}
        rows = fuse(lex, sem, queries=queries, scorer=score, head=4, k=6).collect()
        got = {(r.query_id, r["rank"]): r.text for r in rows}
        first = sorted((plain[0, i] for i in range(1, 5)), reverse=True)
        assert [got[0, i] for i in range(1, 5)] == first and [got[0, i] for i in (5, 6)] == [plain[0, i] for i in (5, 6)]
        assert all(got[1, i] == plain[1, i] for i in range(1, 7)) and len(rows) == 12


def test_keyword_lists_are_added_in_the_scan(spark):
    """Best rows by norm + weighted keyword scores, whole and per own video, equal to scoring everything."""
    from cuelight.plans import search as P

    rng = np.random.default_rng(11)
    vectors = np.repeat(rng.normal(size=(60, 6)), 2, axis=0)  # every row twice: ties
    kf = spark.createDataFrame([(i, f"v{i % 4}", vectors[i].tolist()) for i in range(120)], "kf_id bigint, video_id string, embedding array<double>")
    q, kw = rng.normal(size=(3, 6)), rng.normal(size=(3, 2, 6))
    queries = spark.createDataFrame([(i, q[i].tolist()) for i in range(3)], "query_id bigint, embedding array<double>")
    rows = [(i, j, "word", 0.5 + j, None, kw[i, j].tolist()) for i in range(2) for j in range(2)]
    rows += [(0, 5, "said", 1.0, True, None), (0, 6, "  ", 1.0, False, kw[0, 0].tolist()), (1, 7, "x", 0.0, False, kw[0, 0].tolist()), (9, 0, "y", 1.0, False, kw[0, 0].tolist())]
    keywords = spark.createDataFrame(rows, "query_id bigint, kw_no int, keyword string, weight double, exact boolean, embedding array<double>")
    usable = P.usable_keywords(keywords, queries)
    assert sorted((r.query_id, r.kw_no, r.exact) for r in usable.collect()) == [(0, 0, False), (0, 1, False), (0, 5, True), (1, 0, False), (1, 1, False)]
    packed = P.pack_queries(queries, None, kf, usable).join(
        spark.createDataFrame([(0, ["v1"]), (1, ["v0", "v3"])], "query_id bigint, groups array<string>"), "query_id", "left")

    def calibrated(x):
        s = np.floor(vectors @ x * 1e9 + 0.5) / 1e9
        return s, (s - s.min()) / (s.max() - s.min())

    def want(i, flat, inside):
        dense, norm = calibrated(q[i])
        parts = sum(((0.5 + j) * calibrated(kw[i, j])[1] for j in range(2)), np.zeros(120)) if i < 2 else np.zeros(120)
        lead = np.round(np.clip(norm + flat, 0, 1) + parts, 8)
        return sorted((n for n in range(120) if inside(n)), key=lambda n: (-lead[n], -dense[n], n))[:7]

    found = D.pooled_topk(packed, kf.repartition(5), 7).collect()
    for i in range(3):
        assert {r.kf_id for r in found if r.query_id == i} == set(want(i, 0.0, lambda n: True))
    own = D.pooled_topk(packed, kf.repartition(5), 7, group="video_id", flat=0.4).collect()
    for i, videos in enumerate([(1,), (0, 3), ()]):
        expected = {n for v in videos for n in want(i, 0.4, lambda n, v=v: n % 4 == v)}
        assert {r.kf_id for r in own if r.query_id == i} == expected
    pairs = D.pooled_pairs(spark.createDataFrame([(r.query_id, r.kf_id) for r in found], "query_id bigint, kf_id bigint"), packed, kf)
    key = lambda rows: sorted((r.query_id, r.kf_id, r.dense, r.norm, r.kw) for r in rows)
    assert np.allclose(key(found), key(pairs.collect()), atol=3e-9)


def test_evidence_meets_vectors_in_blocks(spark, monkeypatch):
    """Pools equal to scoring every pair, over several blocks and slices, with ties, marks, kept rows and keywords of one number."""
    from cuelight.plans import search as P

    monkeypatch.setattr(D, "BLOCK_ROWS", 50)
    monkeypatch.setattr(D, "SLICE_ROWS", 16)
    rng = np.random.default_rng(5)
    m = np.repeat(rng.normal(size=(100, 5)), 2, axis=0)
    kf = spark.createDataFrame(
        [(i, f"v{i % 3}", float(i), m[i].tolist()) for i in range(200)], "kf_id bigint, video_id string, pts_time double, embedding array<double>")
    q = rng.normal(size=(3, 5))
    queries = spark.createDataFrame([(i, q[i].tolist()) for i in range(3)], "query_id bigint, embedding array<double>")
    extra = spark.createDataFrame(
        [(0, "v1", 30.0, 0.9, 0.1), (1, "v2", 100.0, 0.4, 0.6), (2, None, None, 1.0, 0.0)],
        "query_id bigint, video_id string, pts_time double, w_dense double, w_speech double")
    marks = F.when(F.col("video_id").isNotNull(), F.array(F.struct("video_id", "pts_time")))
    packed = P.pack_queries(queries, None, kf).join(extra.withColumn("marks", marks).drop("video_id", "pts_time"), "query_id")
    speech = [(i, int(n), float(x), "said") for i in range(2) for n, x in zip(rng.choice(200, 40, replace=False), rng.random(40))]
    words = [(i, n, 0.25, no, 0.5 + no) for i in range(3) for n in range(0, 200, 2 + i) for no in (0, 1)] + [(0, 0, 0.0, 1, 0.2), (9, 3, 1.0, 0, 9.0), (0, 777, 1.0, 0, 9.0)]
    evidence = P.all_evidence(
        spark.createDataFrame(speech, "query_id bigint, kf_id bigint, score double, text string"),
        spark.createDataFrame(words, "query_id bigint, kf_id bigint, kw_speech double, kw_no int, exact double"),
        spark.createDataFrame([(2, 7)], "query_id bigint, kf_id bigint"))
    assert "text" not in evidence.columns
    rows = D.fused_topk(packed, kf, evidence, 6, by_lead=True, bonus=(0.25, 45.0, 0.08)).collect()
    said = {(i, n): x for i, n, x, _ in speech}
    grid = lambda x: np.floor(x * 1e9 + 0.5) / 1e9
    for i, (video, at, d, s) in enumerate([(1, 30.0, 0.9, 0.1), (2, 100.0, 0.4, 0.6), (None, 0.0, 1.0, 0.0)]):
        dense = grid(m @ q[i])
        norm = grid((dense - dense.min()) / (dense.max() - dense.min()))
        far = np.abs(np.arange(200) - at)
        bonus = np.where(np.arange(200) % 3 == video, np.where(far <= 45, 0.25 * (1 - far / 45), 0.08), 0.0) if video else 0.0
        norm = np.clip(norm + bonus, 0, 1)
        hit = np.arange(200) % (2 + i) == 0
        fused = grid(d * norm + s * (np.array([said.get((i, n), 0.0) for n in range(200)]) + 0.5 * hit) + 2.0 * hit)
        best = sorted(range(200), key=lambda n: (-fused[n], -grid(norm)[n], -dense[n], n))
        got = {r["rank"]: (r.kf_id, round(r.fused, 6)) for r in rows if r.query_id == i and r["rank"] <= 6}
        assert got == {k + 1: (n, round(float(fused[n]), 6)) for k, n in enumerate(best[:6])}
    assert [(r.query_id, r["rank"] > 6) for r in rows if r.kept] == [(2, True)] and len(rows) == 19


def test_keyword_evidence(spark):
    from cuelight.plans import search as P

    docs = spark.createDataFrame(
        [(1, "a", 0.0, 4.0, "red boat at sea", "asr"), (2, "a", 2.0, 5.0, "A RED BOAT", "ocr"), (3, "b", 0.0, 2.0, "harbour", "asr")],
        "doc_id bigint, video_id string, start_sec double, end_sec double, text string, source string")
    kf = spark.createDataFrame([(1, "a", 1.0), (2, "a", 7.5), (3, "b", 30.0)], "kf_id bigint, video_id string, pts_time double")
    kw = spark.createDataFrame(
        [(1, 0, "red boat", 2.0, True), (1, 1, "sea", 1.0, True), (1, 2, "boat harbour", 0.5, False)],
        "query_id bigint, kw_no int, keyword string, weight double, exact boolean")
    rows = {r.kf_id: r for r in P.keyword_evidence(kw, P.Corpus(kf, docs, None)).collect()}
    assert set(rows) == {1, 2}
    assert rows[1].exact == 4.5 and rows[1].exact_text == '🔤 [EXACT] "red boat at sea"'  # the last phrase decides the text
    assert rows[2].exact == 3.0 and rows[2].exact_text == '🔤 [EXACT] "A RED BOAT"'  # 7.5 is within 3 s of the second document alone
    assert 0 < rows[2].kw_speech <= 0.5
    empty = kw.filter("query_id > 5")
    assert P.keyword_evidence(empty, P.Corpus(kf, docs, None)).count() == 0


def clustered(n, groups, d, seed=0, spread=0.05):
    rng = np.random.default_rng(seed)
    m = unit_vectors(groups, d, seed)[rng.integers(groups, size=n)] + rng.normal(size=(n, d)) * spread
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def brute_neighbours(m, k, at_least=-np.inf):
    s = np.floor(m @ m.T * 1e9 + 0.5) / 1e9
    return {(i, j) for i in range(len(m)) for j in sorted((j for j in range(len(m)) if j != i and s[i, j] >= at_least), key=lambda j: (-s[i, j], j))[:k]}


def test_stored_cells_stop_at_the_bound(spark, tmp_path):
    from cuelight.operators import cells as C

    m = clustered(1500, 30, 16, 3)
    m[700:720] = m[0]  # ties over the kth place
    kf, q = frames(spark, m), asked(spark, np.vstack([m[:12], unit_vectors(4, 16, 9)]))
    C.write_cells(kf, str(tmp_path / "x"), 40)
    index = C.read_cells(spark, str(tmp_path / "x"))
    key = lambda df: sorted((r.query_id, r["rank"], r.kf_id, r.dense) for r in df.collect())
    want = key(D.topk(q, kf, 5))
    opened = []
    inner = C.opened_rows
    C.opened_rows = lambda rows, ids: opened.append(len(list(ids))) or inner(rows, ids)
    try:
        assert key(C.search_cells(q.filter("query_id < 12"), index, 5, n_probe=2)) == [x for x in want if x[0] < 12]
        assert opened[0] <= 24 and sum(opened) < len(index.ids) * 1.5  # far from every round reading all cells
        assert key(C.search_cells(q, index, 5)) == want
        assert C.search_cells(q.filter("query_id > 99"), index, 5).count() == 0
    finally:
        C.opened_rows = inner
    plan = C.opened_rows(index.rows, [1, 2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan or "PartitionFilters: [cast(cell" in plan


def test_neighbours_by_bounds(spark):
    from cuelight.operators import cells as C

    m = clustered(600, 25, 12, 5)
    m[50:60] = m[0]
    kf = frames(spark, m)
    pairs = lambda df: {(r.query_id, r.kf_id) for r in df.collect()}
    assert pairs(D.near_duplicates(kf, 3, block_rows=64)) == brute_neighbours(m, 3)
    assert pairs(D.near_duplicates(kf, 3, block_rows=64, n_list=12, n_probe=1)) == brute_neighbours(m, 3)
    assert pairs(D.near_duplicates(kf, 4, at_least=0.97)) == brute_neighbours(m, 4, 0.97)
    few = unit_vectors(4, 12)
    assert pairs(D.near_duplicates(frames(spark, few), 9)) == brute_neighbours(few, 9)
    assert D.near_duplicates(kf.limit(0), 3).count() == 0
    # pairs compared where groups lie apart and new rows bring new groups: far less than sixteen times as many for four times
    # the rows (inside one group, and where groups overlap, the bounds exclude little and growth is quadratic)
    compared = []
    for n in (600, 2400):
        v = clustered(n, n // 24, 12, 5, 0.02)
        rows = frames(spark, v).select(F.col("kf_id").alias("_key"), "embedding")
        cells = C.pivot_cells(rows)
        kth = float(np.median(np.sort(v @ v.T, axis=1)[:, -4]))
        seen = C.visits(rows.withColumn("kth", F.lit(kth)), cells, 0, len(cells.ids), -1.0).groupBy("cell").count()
        sizes = cells.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
        compared.append(seen.join(sizes, "cell").agg(F.sum(F.col("count") * F.col("size"))).head()[0])
    assert compared[0] < 600**2 / 3 and compared[1] < compared[0] * 10, compared


def test_neighbours_of_one_group_are_copied_by_block(spark, monkeypatch):
    from cuelight.operators import cells as C

    m = unit_vectors(500, 16, 4)
    m[40:60] = m[0]  # ties over the kth place
    kf = frames(spark, m)
    pairs = lambda df: {(r.query_id, r.kf_id) for r in df.collect()}
    met, inner = [], C.meet_in_blocks
    monkeypatch.setattr(C, "meet_in_blocks", lambda rows, *rest: met.append(rows.count()) or inner(rows, *rest))
    assert pairs(D.near_duplicates(kf, 3, block_rows=90, n_probe=1)) == brute_neighbours(m, 3)
    monkeypatch.setattr(C, "SLICE_NUMBERS", 700)
    monkeypatch.setattr(C, "BLOCK_BYTES", 16 * 8 * 120)
    assert pairs(D.near_duplicates(kf, 30, block_rows=200, n_probe=1)) == brute_neighbours(m, 30)  # no kth score at first
    assert pairs(D.near_duplicates(kf, 4, n_probe=1, at_least=0.1)) == brute_neighbours(m, 4, 0.1)
    assert len(met) == 3 and min(met) > 400
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    assert [b.num_rows for b in C.slices([batch], 2)] == [350, 350, 300]


def test_recall_of_default_cells(spark):
    m = clustered(3000, 60, 16, 7)
    kf = frames(spark, m)
    q = asked(spark, m[:100])
    exact = {(r.query_id, r.kf_id) for r in D.topk(q, kf, 5).collect()}
    assert len(exact & {(r.query_id, r.kf_id) for r in D.ivf_topk(q, kf, 5).collect()}) >= 0.9 * len(exact)
    full = {(r.query_id, r.kf_id) for r in D.near_duplicates(kf, 3).collect()}
    assert len(full & {(r.query_id, r.kf_id) for r in D.near_duplicates(kf, 3, mode="cells").collect()}) >= 0.9 * len(full)


def test_lists_read_the_documents_once(spark):
    """The counts, the scores and the texts of the hits read one stored table of documents."""
    from cuelight.catalog.base import Tables
    from cuelight.catalog.relational import lists

    tables = Tables(spark, "/root/testdata/sf0.001")
    assert any("events" in f for f in tables.docs.inputFiles())
    lex, _ = lists(tables)
    assert not any("events" in f for f in lex.inputFiles()) and lex.count() > 0


def test_evidence_reads_the_documents_once(spark):
    """Screen text comes from the events: the evidence per keyframe reads it from one stored table of documents."""
    from cuelight import catalog

    for name in ("ag_max_per_keyframe", "ag_text_precedence"):
        out = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        assert not any("events" in f for f in out.inputFiles()) and out.count() > 0


def test_bm25_cuts_the_texts_into_words_once(spark, tmp_path):
    """What is scored are stored counts; the slice stores its judgements too, so neither reads a text again."""
    from cuelight import catalog

    rows = [(i, " ".join(["rare"] * (i % 3) + ["common", "_", f"w{i}"])) for i in range(40)] + [(40, " \t"), (41, None), (42, "...")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    q = spark.createDataFrame([(1, "rare common"), (2, "w7 w7"), (3, "absent")], "query_id long, text string")
    found = L.bm25(q, spark.read.parquet(str(tmp_path / "docs")), 5)
    assert found.inputFiles() == []
    got = {i: [r.doc_id for r in sorted(found.collect(), key=lambda r: r["rank"]) if r.query_id == i] for i in (1, 2, 3)}
    assert got == {1: [2, 5, 8, 11, 14], 2: [7], 3: []}
    out = catalog.queries()["ev_lexical_slice"](spark, "/root/testdata/sf0.001")
    assert not any("documents" in f for f in out.inputFiles()) and out.count() == 3


def test_bm25_sums_no_pairs_of_query_and_document(spark):
    """Scores are summed inside the document: no aggregation over (query, document) pairs is left in the plan."""
    docs = spark.createDataFrame([(i, "common " * (i % 4)) for i in range(30)], "doc_id long, text string")
    q = spark.createDataFrame([(i, "common word") for i in range(4)], "query_id long, text string")
    found = L.bm25(q, docs, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan
    assert sorted(r.doc_id for r in found.collect()) == sorted([3, 7, 11] * 4)
