"""Incremental jobs: work lists, index growth, screen-text runs and counters on Structured Streaming."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cuelight.functions import numeric as N


def process_pending(
    items: DataFrame, output: str, manifest: str, checkpoint: str, process: Callable[[DataFrame], DataFrame],
    key: str = "video_id",
) -> StreamingQuery:
    """Process new items once and record their status.

    ``items`` is a stream; the checkpoint remembers what was read. ``process``
    returns the items with a ``status``. Completed rows go to ``output``, every
    outcome to ``manifest``, both in a folder per batch, so a batch that is
    replayed after a failure overwrites itself. Items already completed in the
    manifest are skipped. Failed items are kept as they came, in ``failed`` beside
    the manifest, and are processed again when the job starts, before new items.
    """
    spark, waiting = items.sparkSession, manifest.rstrip("/") + "_failed"

    def completed(df: DataFrame) -> DataFrame:
        return df.filter(F.startswith("status", F.lit("completed")))

    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        result = process(df).persist()
        try:
            completed(result).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
            failed = result.filter(~F.startswith("status", F.lit("completed"))).select(key)
            df.join(failed.distinct(), key, "left_semi").write.mode("overwrite").parquet(f"{waiting}/batch={batch_id}")
            result.select(key, "status").write.mode("overwrite").parquet(f"{manifest}/batch={batch_id}")
        finally:
            result.unpersist()
            df.unpersist()

    def again() -> None:
        failed, outcomes = _read_or_none(spark, waiting), _read_or_none(spark, manifest)
        if failed is None or outcomes is None:
            return
        latest = failed.groupBy(key).agg(F.max_by(F.struct(*[c for c in failed.columns if c not in (key, "batch")]), F.abs("batch")).alias("_item"))
        todo = latest.select(key, "_item.*").join(completed(outcomes).select(key).distinct(), key, "left_anti")
        if not todo.isEmpty():
            # runs before the stream count down from -1, the stream's batches up from 0
            write(todo, (outcomes.agg(F.min("batch")).head()[0] if outcomes.filter("batch < 0").head(1) else 0) - 1)

    def batch(df: DataFrame, batch_id: int) -> None:
        done = _read_or_none(df.sparkSession, manifest)
        if done is not None:
            finished = completed(done).filter(F.col("batch") != batch_id)
            df = df.join(finished.select(key).distinct(), key, "left_anti")
        write(df, batch_id)

    again()
    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read_or_none(spark, path: str) -> DataFrame | None:
    """The table, or None if there is none yet; any other failure to read it is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_vectors(vectors: DataFrame, path: str, checkpoint: str, n_list: int = 100) -> StreamingQuery:
    """Append vector batches (video_id, pos, kf_id, embedding) to a stored index.

    Cells are trained on the first batch and stored; ``global_idx`` continues
    where the batches before ended.
    """
    from cuelight.operators.dense import _nearest_cells, ivf_cell_count, ivf_cells
    from cuelight.sources.readers import global_positions

    def batch(df: DataFrame, batch_id: int) -> None:
        import numpy as np

        spark = df.sparkSession
        cells = _read_or_none(spark, f"{path}/cells")
        if cells is None:
            _, model = ivf_cells(df, ivf_cell_count(df.count(), n_list))
            rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
            spark.createDataFrame(rows, "cell int, center array<double>").write.mode("overwrite").parquet(f"{path}/cells")
            cells = spark.read.parquet(f"{path}/cells")
        centers = np.array([r["center"] for r in cells.orderBy("cell").collect()])  # n_list rows at most
        stored = _read_or_none(spark, f"{path}/vectors")
        start = 0
        if stored is not None:
            start = stored.filter(F.col("batch") != batch_id).agg(F.coalesce(F.max("global_idx") + 1, F.lit(0))).head()[0]
        numbered = global_positions(df).withColumn("global_idx", F.col("global_idx") + start)
        homes = _nearest_cells(numbered.select(F.col("global_idx").alias("_key"), N.as_doubles("embedding").alias("embedding")), centers, 1)
        placed = numbered.join(homes.select(F.col("_key").alias("global_idx"), "cell"), "global_idx")  # kf_id may come twice, its place not
        placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors/batch={batch_id}")

    return vectors.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RUN_SCHEMA = "video_id string, start_sec double, end_sec double, text string, n_lines bigint"
_PROGRESS = "text string, start_sec double, last_sec double, n_lines bigint, passed double, newest double, earliest double"
_NEVER = float("-inf")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which list states and timers need; the session's own choice is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stream_text_runs(lines: DataFrame, hold: float = 3.0, delay: float = 10.0, silence: float | None = None) -> DataFrame:
    """Runs of equal screen text over a stream (video_id, line_id, t_sec, text). Start its query inside :func:`rocksdb_state`.

    Every video has its own progress: its lines wait in state until its newest line is ``delay`` seconds ahead, then extend the open run
    or close it, so videos may come in any order and at any time. Lines further behind the newest of their own video are dropped. A line
    with a null text (:func:`end_of_video`) ends its video: all that waits is worked off and the open run is closed. The same happens,
    by a timer, to a video without a line for ``silence`` seconds of processing time (None: it is waited for); only its progress is kept.
    Timers need a trigger that goes on: with them a query of the available data alone does not end.
    """
    return lines.groupBy("video_id").transformWithStateInPandas(
        TextRuns(hold, delay, silence), RUN_SCHEMA, "Append", "None" if silence is None else "ProcessingTime")


def end_of_video(lines: DataFrame) -> DataFrame:
    """The end of each video of ``lines``, to be sent with or after its last lines."""
    return lines.select("video_id", F.lit(None).cast("bigint").alias("line_id"), F.lit(None).cast("double").alias("t_sec"), F.lit(None).cast("string").alias("text"))


class TextRuns(StatefulProcessor):
    """The open run and the progress of a video are one value; the lines that wait are a list of their own.

    Only lines less than ``delay`` behind the newest wait. The list is read when its earliest line is due and appended to otherwise.
    """

    def __init__(self, hold: float, delay: float, silence: float | None):
        self.gap, self.hold, self.delay, self.silence = hold + hold, hold, delay, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", _PROGRESS)
        self.waiting = handle.getListState("waiting", "t double, line bigint, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.progress.get()
        *run, passed, newest, earliest = known or (None, None, None, 0, _NEVER, _NEVER, None)
        fresh, ended = [], False
        for pdf in rows:
            real = pdf[pdf.text.notna()]
            ended |= len(real) < len(pdf)
            real = real[real.t_sec > passed]
            fresh.extend(zip(real.t_sec.tolist(), map(int, real.line_id.tolist()), real.text.tolist()))
        fresh.sort()
        newest = max(newest, fresh[-1][0]) if fresh else newest
        mark = float("inf") if ended else newest - self.delay
        if earliest is not None and earliest <= mark:
            fresh = sorted([*fresh, *map(tuple, self.waiting.get())])
            self.waiting.clear()
            earliest = None
        due = bisect_right(fresh, mark, key=lambda line: line[0])
        closed = self._fold(key[0], run, fresh[:due])
        rest = fresh[due:]
        if rest:
            self.waiting.appendList(rest)
            earliest = rest[0][0] if earliest is None else min(earliest, rest[0][0])
        # nothing that can still arrive joins a run whose gap has passed
        if run[0] is not None and run[2] + self.gap < mark and (earliest is None or earliest > run[2] + self.gap):
            closed.append(self._close(key[0], run))
        if ended and known:
            self.progress.clear()
        elif not ended:
            self.progress.update((*run, max(passed, mark), newest, earliest))
        if self.silence is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.silence * 1000))
        if closed:
            yield _runs(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        *run, passed, newest, _ = self.progress.get()
        closed = self._fold(key[0], run, sorted(map(tuple, self.waiting.get())))
        self.waiting.clear()
        if run[0] is not None:
            closed.append(self._close(key[0], run))
        self.progress.update((*run, newest, newest, None))
        if closed:
            yield _runs(closed)

    def _fold(self, video: str, run: list, lines: list) -> list:
        """The runs that ``lines`` close; ``run`` (text, start, last, lines) is the open one before and after."""
        closed = []
        for t, _, text in lines:
            if text == run[0] and t <= run[2] + self.gap:
                run[2:] = max(run[2], t), run[3] + 1
                continue
            if run[0] is not None:
                closed.append(self._close(video, run))
            run[:] = text, t, t, 1
        return closed

    def _close(self, video: str, run: list) -> tuple:
        text, start, last, n = run
        run[:] = None, None, None, 0
        return video, start, last + self.hold, text, n


def _runs(closed: list) -> pd.DataFrame:
    return pd.DataFrame(closed, columns=["video_id", "start_sec", "end_sec", "text", "n_lines"])


def running_metrics(per_query: DataFrame) -> DataFrame:
    """Counters per configuration over a stream of (config, r1, r5, mrr); use complete or update mode."""
    return per_query.groupBy("config").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r1").alias("r1"), F.avg("r5").alias("r5"), F.avg("mrr").alias("mrr"))
