"""Readers on files in the layouts that users have, and the streams."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelight.operators.ordered import text_runs
from cuelight.sources import readers as RD
from cuelight.streaming import jobs as J


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_transcripts(spark, tmp_path):
    put(tmp_path / "raw/A.json", [{"start": 1, "end": 2, "text": "raw a"}])
    put(tmp_path / "raw/B.json", {"segments": [{"start_sec": 3.0, "text": "b", "cleaned_text": "clean b"}, {"text": "  "}]})
    put(tmp_path / "raw/C.json", [{"text": "c"}])
    put(tmp_path / "ref/A.json", [{"start_sec": 1.0, "end_sec": 2.5, "refined_text": "fine a", "text": "raw a"}])
    put(tmp_path / "ref/C.json", "{broken")
    get = lambda f: sorted((r.video_id, r.start_sec, r.end_sec, r.text) for r in RD.read_transcripts(
        spark, str(tmp_path / "ref"), str(tmp_path / "raw"), flavour=f).collect())
    assert get("lexical") == [("A", 1.0, 2.5, "fine a"), ("B", 3.0, 4.0, "clean b")]
    assert get("semantic") == [("A", 1.0, 2.5, "fine a"), ("B", 3.0, 4.0, "clean b"), ("C", 0.0, 1.0, "c")]


def test_small_files(spark, tmp_path):
    put(tmp_path / "ocr/A.json", {"f_50": " hi ", "bad": "x", "f_75": ""})
    assert sorted((r.video_id, r.t_sec, r.text) for r in RD.read_ocr(spark, str(tmp_path / "ocr")).collect()) == [("A", 0.0, "x"), ("A", 2.0, "hi")]
    put(tmp_path / "map/A.csv", "n,pts_time,fps,frame_idx\n1,0.0,25.0,0\n2,1.5,25.0,37\n")
    assert [(r.video_id, r.row_no, r.frame_idx) for r in RD.read_frame_map(spark, str(tmp_path / "map")).orderBy("n").collect()] == [("A", 1, 0), ("A", 2, 37)]
    put(tmp_path / "obj/A/0001.json", {"detection_class_entities": ["Car", "Dog"], "detection_boxes": [[0, 0, 1, 1], [0, 0, 1, 1]], "detection_scores": ["0.9", "n/a"]})
    assert [tuple(r)[:3] for r in RD.read_detections(spark, str(tmp_path / "obj/*")).select("video_id", "keyframe", "entity").collect()] == [("A", "0001", "Car")]
    put(tmp_path / "meta/A.json", {"title": "t", "keywords": ["a", "b"], "tags": "c"})
    assert tuple(RD.read_metadata(spark, str(tmp_path / "meta")).head()) == ("A", "t", "", "a b", "c")
    put(tmp_path / "q.jsonl", '{"query_id":"1","query":"x","relevant_segments":[{"video_id":"A","start_sec":1,"end_sec":2}]}\n\n{"query_id":"2","query":"y","answerability":"unanswerable"}\n')
    assert [tuple(r)[:3] for r in RD.truth_table(RD.read_judgements(spark, str(tmp_path / "q.jsonl"))).collect()] == [("1", "A", 1.0)]


def test_query_package(spark, tmp_path):
    put(tmp_path / "a.json", ["first", {"id": "my id", "text": "second", "mode": "qa"}])
    put(tmp_path / "b.json", {"items": [{"query": "third"}]})
    put(tmp_path / "c.json", {"k-trake": "fourth", "k5": {"prompt": "fifth"}})
    put(tmp_path / "qa/one.txt", " sixth ")
    got = {(r.query_id, r.prompt, r.mode) for r in RD.read_query_package(spark, str(tmp_path)).collect()}
    assert got == {("a_1", "first", "kis"), ("my_id", "second", "qa"), ("b_1", "third", "kis"), ("k-trake", "fourth", "trake"), ("k5", "fifth", "kis"),
                   ("qa-one", "sixth", "qa")}


def runs_of(spark, stream, folder, **how):
    """The runs of ``stream`` are added to the folder; the rows kept in state are returned, by state."""
    with J.rocksdb_state(spark):
        q = J.stream_text_runs(stream, **how).writeStream.format("parquet").option("path", str(folder / "out")).option(
            "checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_streamed_runs_equal_batch_runs(spark, tmp_path):
    rows = [("v", i, t, x) for i, (t, x) in enumerate([(0.0, "A"), (3.0, "A"), (9.0, "A"), (16.0, "A"), (17.0, "B"), (18.0, "A"), (400.0, "Z"), (800.0, "Z")])]
    schema = "video_id string, line_id long, t_sec double, text string"
    df = spark.createDataFrame(rows, schema)
    for i in range(4):
        df.filter(F.floor(F.col("line_id") / 2) == i).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    runs_of(spark, stream, tmp_path, delay=500.0)
    got = {(r.start_sec, r.end_sec, r.text, r.n_lines) for r in spark.read.schema(J.RUN_SCHEMA).parquet(str(tmp_path / "out")).collect()}
    want = {(r.start_sec, r.end_sec, r.text, r.n_lines) for r in text_runs(df).collect()}
    assert got <= want and {g for g in got if g[0] < 100} == {w for w in want if w[0] < 100}


def test_runs_go_on_after_a_restart_with_few_lines_in_state(spark, tmp_path):
    schema = "video_id string, line_id long, t_sec double, text string"
    rows = [("v", i, i * 1.0, "AB"[i // 7 % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, schema)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    for part in range(4):  # the query ends and starts again after each part
        df.filter(F.floor(F.col("line_id") / 100) == part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        runs_of(spark, stream, tmp_path, delay=20.0)
        waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "ck"))
        assert waiting.count() == 20  # the lines of the last 20 seconds, whatever came before
    J.end_of_video(df).distinct().coalesce(1).write.mode("append").json(str(tmp_path / "in"), ignoreNullFields=False)
    runs_of(spark, stream, tmp_path, delay=20.0)
    columns = ["video_id", "start_sec", "end_sec", "text", "n_lines"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect()))
    assert got == sorted(map(tuple, text_runs(df).select(columns).collect())) and len(got) == 58
    assert spark.read.format("statestore").option("stateVarName", "progress").load(str(tmp_path / "ck")).count() == 0


def test_a_silent_video_is_closed_by_its_timer(spark, tmp_path):
    schema = "video_id string, line_id long, t_sec double, text string"
    rows = [("v", 0, 0.0, "A"), ("v", 1, 2.0, "A"), ("w", 2, 0.0, "C")]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    with J.rocksdb_state(spark):  # a trigger that goes on: timers need batches after the last line
        q = J.stream_text_runs(stream, silence=1.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    got, until = set(), time.time() + 60
    while len(got) < 2 and time.time() < until and q.exception() is None:
        q.awaitTermination(2)
        got = {(r.video_id, r.start_sec, r.text, r.n_lines) for r in spark.read.schema(J.RUN_SCHEMA).parquet(str(tmp_path / "out")).collect()}
    q.stop()
    assert got == {("v", 0.0, "A", 2), ("w", 0.0, "C", 1)}


def test_pending_work_runs_once(spark, tmp_path):
    def run():
        items = spark.readStream.schema("video_id string").json(str(tmp_path / "in"))
        seen = lambda d: d.withColumn("status", F.when(F.col("video_id") == "bad", "failed").otherwise("completed"))
        J.process_pending(items, str(tmp_path / "out"), str(tmp_path / "man"), str(tmp_path / "ck"), seen).awaitTermination()
        return sorted(r.video_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(tmp_path / "in/1.json", '{"video_id":"a"}\n{"video_id":"bad"}\n')
    assert run() == ["a"]
    put(tmp_path / "in/2.json", '{"video_id":"a"}\n{"video_id":"b"}\n')
    assert run() == ["a", "b"]


def test_failed_work_is_tried_again(spark, tmp_path):
    def run(good):
        items = spark.readStream.schema("video_id string, n int").json(str(tmp_path / "in"))
        seen = lambda d: d.withColumn("status", F.when(F.col("video_id").isin(*good), "completed").otherwise("failed"))
        J.process_pending(items, str(tmp_path / "out"), str(tmp_path / "man"), str(tmp_path / "ck"), seen).awaitTermination()
        return sorted((r.video_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(tmp_path / "in/1.json", '{"video_id":"a","n":1}\n{"video_id":"b","n":2}\n')
    assert run(["a"]) == [("a", 1)]
    assert run(["a"]) == [("a", 1)]
    assert run(["a", "b"]) == [("a", 1), ("b", 2)]
    assert run(["a", "b"]) == [("a", 1), ("b", 2)]


def test_an_unreadable_manifest_is_no_empty_one(spark, tmp_path):
    put(tmp_path / "man/part-0.parquet", "no parquet")
    with pytest.raises(Exception) as failure:
        J._read_or_none(spark, str(tmp_path / "man"))
    assert "PATH_NOT_FOUND" not in str(failure.value)
    assert J._read_or_none(spark, str(tmp_path / "none")) is None


def test_late_videos_and_ends_of_streams(spark, tmp_path):
    rows = [("v", 0, 0.0, "A"), ("v", 1, 3000.0, "B"), ("w", 2, 0.0, "C"), ("w", 3, 2.0, "C"), ("v", 4, 3001.0, "B")]
    schema = "video_id string, line_id long, t_sec double, text string"
    df = spark.createDataFrame(rows, schema)
    for i in (0, 2, 4):
        df.filter(f"line_id between {i} and {i + 1}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    J.end_of_video(df).distinct().coalesce(1).write.mode("append").json(str(tmp_path / "in"), ignoreNullFields=False)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
    runs_of(spark, stream, tmp_path)
    got = {(r.video_id, r.start_sec, r.n_lines) for r in spark.read.schema(J.RUN_SCHEMA).parquet(str(tmp_path / "out")).collect()}
    assert got == {("v", 0.0, 1), ("v", 3000.0, 2), ("w", 0.0, 2)}


def test_array_files(spark, tmp_path, monkeypatch):
    from cuelight.sources import arrays as AR

    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(70, 3)).astype(np.float32), rng.integers(0, 9, size=(5, 3))
    np.save(tmp_path / "a b.npy", a)
    np.save(tmp_path / "v2.npy", b)  # integers
    np.save(tmp_path / "one.npy", a[0].astype(np.float16))
    np.save(tmp_path / "none.npy", np.zeros((0, 3), dtype=np.float32))
    (tmp_path / "notes.txt").write_text("no vectors")
    monkeypatch.setattr(AR, "TASK_BYTES", 300)
    assert len(AR.ArrayReader(str(tmp_path)).partitions()) > 3  # a large file is several tasks
    rows = {(r.video_id, r.pos): r.embedding for r in AR.read_vectors(spark, str(tmp_path)).collect()}
    assert set(rows) == {("a b", i) for i in range(70)} | {("v2", i) for i in range(5)} | {("one", 0)}
    assert all(np.array_equal(np.float32(rows["a b", i]), a[i]) for i in range(70)) and rows["v2", 4] == b[4].tolist()
    picked = AR.read_vectors(spark, str(tmp_path)).filter(F.col("video_id").isin("v2", "one", "zz"))
    assert picked.count() == 6
    reader = AR.ArrayReader(str(tmp_path))
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    assert list(reader.pushFilters([In(("video_id",), ("v2", "one")), GreaterThan(("pos",), 3), EqualTo(("video_id",), "v2")])) == [GreaterThan(("pos",), 3)]
    assert {f[1] for p in reader.partitions() for f in p.value} == {"v2"}
    np.save(tmp_path / "bad.npy", np.asfortranarray(a[:4]))
    with pytest.raises(Exception, match="not a matrix"):
        AR.read_vectors(spark, str(tmp_path)).collect()


def test_vectors_with_sidecars_round_trip(spark, tmp_path):
    from cuelight.sources import arrays as AR
    from cuelight.sources import readers as RD

    rows = [(v, i, [float(i), 1.0]) for v in ("v1", "v2") for i in range(23)]
    AR.write_vectors(spark.createDataFrame(rows, "video_id string, pos bigint, embedding array<double>"), str(tmp_path), 10)
    assert sorted(p.name for p in (tmp_path / "v1").iterdir()) == ["0.npy", "10.npy", "20.npy"]
    meta = spark.createDataFrame([("v1", 2, 99, 7.5)], "video_id string, pos bigint, frame_idx bigint, pts_time double")
    out = {(r.video_id, r.pos): r for r in RD.read_embeddings(spark, str(tmp_path), meta).collect()}
    assert len(out) == 46 and out["v2", 22].embedding == [22.0, 1.0] and out["v2", 22].global_idx == 45
    assert (out["v1", 2].frame_idx, out["v1", 2].pts_time) == (99, 7.5) and (out["v1", 3].frame_idx, out["v1", 3].pts_time) == (18, pytest.approx(0.6))


def test_an_index_grows_by_batches(spark, tmp_path):
    rng = np.random.default_rng(5)
    schema = "video_id string, pos long, kf_id long, embedding array<float>"
    rows = [(f"v{i % 2}", i, i // 2, rng.normal(size=4).tolist()) for i in range(60)]  # every kf_id twice

    def run(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        J.append_vectors(stream, str(tmp_path / "index"), str(tmp_path / "ck"), 3).awaitTermination()
        return spark.read.parquet(str(tmp_path / "index/vectors")).orderBy("global_idx").collect()

    run(rows[:40])
    stored = run(rows[40:])
    order = sorted(rows[:40], key=lambda r: (r[0], r[1])) + sorted(rows[40:], key=lambda r: (r[0], r[1]))
    assert [(r.global_idx, r.video_id, r.pos, r.kf_id) for r in stored] == [(i, *r[:3]) for i, r in enumerate(order)]
    centers = np.array([r.center for r in spark.read.parquet(str(tmp_path / "index/cells")).orderBy("cell").collect()])
    near = np.argmax(np.array([r.embedding for r in stored]) @ centers.T, axis=1)
    assert [r.cell for r in stored] == near.tolist()


def test_many_keyframes_and_videos_share_files(spark, tmp_path):
    put(tmp_path / "obj/part.json", '{"video_id":"A","keyframe":"0001","detection_class_entities":["Car","Dog"],"detection_boxes":[[0,0,1,1],[0,0,1,1]],"detection_scores":["0.5","n/a"]}\n'
        '{"video_id":"B","keyframe":"0007","detection_class_entities":["Cat"],"detection_boxes":[[0,0,1,1]],"detection_scores":["0.25"]}\n')
    got = RD.read_detections(spark, str(tmp_path / "obj"), named=True).select("video_id", "keyframe", "entity", "score").collect()
    assert sorted(map(tuple, got)) == [("A", "0001", "Car", 0.5), ("B", "0007", "Cat", 0.25)]
    put(tmp_path / "ocr/part.json", '{"video_id":"A","frames":{"f_50":" hi ","f_x":"x"}}\n{"video_id":"B","frames":{"f_25":"yo","f_26":" "}}\n')
    got = RD.read_ocr(spark, str(tmp_path / "ocr"), named=True).select("video_id", "t_sec", "text").collect()
    assert sorted(map(tuple, got)) == [("A", 0.0, "x"), ("A", 2.0, "hi"), ("B", 1.0, "yo")]
    put(tmp_path / "meta/part.txt", '{"video_id":"1","title":"t","description":"a\\nb","keywords":["k","l"]}\n{"video_id":"2","keywords":"k"}\n')
    got = RD.read_metadata(spark, str(tmp_path / "meta"), named=True).collect()
    assert sorted(map(tuple, got)) == [("1", "t", "a\nb", "k l", ""), ("2", "", "", "k", "")]


def test_file_queries_write_files_by_task_not_by_row(spark, tmp_path, monkeypatch):
    from cuelight import catalog
    from cuelight.catalog.base import Tables

    table = "/root/testdata/sf0.001"
    for name in ("src_objects", "src_metadata", "src_ocr"):
        monkeypatch.setattr(Tables, "scratch", lambda self, name=name: str(tmp_path / name))
        assert catalog.queries()[name](spark, table).count() > 0
        assert len([f for f in (tmp_path / name).rglob("*") if f.is_file() and f.suffix in (".json", ".txt")]) <= 8
