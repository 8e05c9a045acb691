"""Ordered events on a timeline as products of matrices over (max, +).

A chunk of a timeline is an upper triangular matrix: entry (i, j) is the best total of events i .. j-1 on strictly increasing frames of
the chunk. The product of two chunks' matrices is the matrix of both, so chunks are worked on alone and one fold over a timeline's
matrices gives its best alignment, however many events there are. Totals are whole numbers of 1e-9, so their order of addition does
not matter; among equal totals the last event's earliest frame wins, then the one before, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = 1e9
#: entries (i, j) with i < j of the matrix, row by row: total or null, and the frames and their positions
CELLS = "cells array<struct<total:bigint,at:array<bigint>,frames:array<bigint>>>"


def chunk_matrix(scores: np.ndarray, at: np.ndarray, frames: np.ndarray) -> list[tuple | None]:
    """Cells of a chunk with whole scores (frame, event), its frames in order of their positions ``at``."""
    n_frames, n_events = scores.shape
    place, cells = np.arange(n_frames), []
    for i in range(n_events):
        best, first = np.zeros(n_frames, np.int64), []
        for j in range(i, n_events):
            # the total with event j on each frame; event j needs j - i frames before it
            skip = j - i
            if skip >= n_frames:
                cells.append(None)
                continue
            total = scores[skip:, j] + (best[skip - 1 : -1] if skip else 0)
            best = np.full(n_frames, np.iinfo(np.int64).min // 2)
            best[skip:] = np.maximum.accumulate(total)
            risen = np.ones(len(total), bool)
            risen[1:] = best[skip + 1 :] > best[skip:-1]
            top = np.zeros(n_frames, np.int64)
            top[skip:] = np.maximum.accumulate(np.where(risen, place[skip:], 0))
            first.append(top)
            t, path = n_frames, []
            for level in reversed(first):
                t = int(level[t - 1])
                path.append(t)
            path.reverse()
            cells.append((int(best[-1]), at[path].tolist(), frames[path].tolist()))
    return cells


def _better(a: tuple, b: tuple | None) -> bool:
    return b is None or a[0] > b[0] or (a[0] == b[0] and a[1][::-1] < b[1][::-1])


def start(n_events: int) -> list:
    """Nothing aligned yet: the best total, positions and frames of the first 0, 1, ... events."""
    return [(0, [], []), *[None] * n_events]


def step(state: list, cells: list) -> list:
    """The state after one more chunk."""
    new, at = list(state), 0
    for i in range(len(state) - 1):
        for j in range(i + 1, len(state)):
            cell, at = cells[at], at + 1
            if cell is None or state[i] is None:
                continue
            found = state[i][0] + cell[0], state[i][1] + list(cell[1]), state[i][2] + list(cell[2])
            if _better(found, new[j]):
                new[j] = found
    return new


def fold(matrices: Iterator[list], n_events: int) -> tuple | None:
    """The best alignment of all events over the chunks in order: total, positions, frames."""
    return reduce(step, matrices, start(n_events))[n_events]


def alignments(frames: DataFrame, keys: list[str], chunk_rows: int = 4096) -> DataFrame:
    """keys, score (mean over events) and frames of the best alignment of each key.

    frames: keys, n (position), frame_idx, ``_s`` (array: the score of each event on this frame). Keys with fewer frames than events
    have no row.
    """
    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)

    def matrix(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        scores = np.rint(np.stack(rows["_s"].to_numpy()) * GRID).astype(np.int64)
        cells = chunk_matrix(scores, rows["n"].to_numpy(), rows["frame_idx"].to_numpy())
        return pd.DataFrame([[*key, scores.shape[1], [c and dict(zip(("total", "at", "frames"), c)) for c in cells]]])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come by key and chunk, so only the state of one timeline is held
        names, key, state = [*keys, "score", "frames"], None, []

        def done() -> list:
            found = state[-1] if key is not None else None
            return [[*key, found[0] / GRID / (len(state) - 1), found[2]]] if found else []

        for batch in batches:
            out = []
            for *own, n_events, cells in zip(*[batch[c].tolist() for c in (*keys, "n_events", "cells")]):
                if own != key:
                    out += done()
                    key, state = own, start(n_events)
                state = step(state, [c and (c["total"], c["at"], c["frames"]) for c in cells])
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(done(), columns=names)

    cut = frames.withColumn("_chunk", F.floor(F.col("n") / chunk_rows).cast("bigint"))
    chunks = cut.groupBy(*keys, "_chunk").applyInPandas(matrix, f"{kinds}, _chunk bigint, n_events int, {CELLS}")
    in_order = chunks.repartition(*keys).sortWithinPartitions(*keys, "_chunk")
    return in_order.mapInPandas(best, f"{kinds}, score double, frames array<bigint>")
