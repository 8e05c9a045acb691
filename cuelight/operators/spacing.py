"""Greedy rules along a timeline as chunks that map an entry state to an exit state.

A row goes when it comes less than ``gap`` after the row kept last (and looks like it). What a chunk keeps depends on earlier rows only
through the row kept last, and only if that lies within ``gap`` of the chunk's start. So each chunk tells for every such row, and for
none, which row it keeps last; the few rows near its start are copied from the chunk before. The maps are composed along the timeline,
a few numbers a chunk, and then each chunk is walked once more from its true entry. No task holds more rows than a chunk and its copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAR = -(1 << 62)


def _walk(at: np.ndarray, unit: np.ndarray | None, own: np.ndarray, starts: list[int], gap: float, similar: float) -> list[list[int]]:
    """Rows kept from each start (a row's place, or -1 for none), for rows in order; walks that meet go on as one."""
    last, kept = list(starts), [[] for _ in starts]
    for r in np.flatnonzero(own).tolist():
        goes: dict[int, bool] = {}
        for s, k in enumerate(last):
            if k not in goes:
                near = k >= 0 and at[r] - at[k] < gap
                goes[k] = bool(near and (unit is None or _like(unit[k], unit[r]) > similar))
            if not goes[k]:
                last[s] = r
                kept[s].append(r)
    return kept


def _like(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson correlation of centred rows of length one, on the score grid; 1 when a side is constant."""
    return round(float(a @ b), 9) if a.any() and b.any() else 1.0


def _units(hists: pd.Series) -> np.ndarray:
    m = np.stack(hists.to_numpy()).astype(float)
    m -= m.mean(axis=1, keepdims=True)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def spaced(rows: DataFrame, at: str, row: str, gap: float, width: float, hist: str | None = None, similar: float = 0.0) -> DataFrame:
    """The rows (video_id, at, row) that stay: each at least ``gap`` after the row kept before it, or unlike it.

    ``row`` numbers the rows of a video (integers, in the order of equal ``at``); ``width`` is a chunk's, over ``gap``. With ``hist`` a
    near row goes only if its array correlates more than ``similar`` with that of the row kept last.
    """
    if width <= gap:
        raise ValueError("a chunk must be wider than the gap")
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("video_id", at, row)}
    chunk = F.floor(F.col(at) / F.lit(float(width))).cast("bigint")
    cols = ["video_id", at, row, *([hist] if hist else [])]
    homes = rows.select(*cols, chunk.alias("_home"))
    ahead = ((F.col("_home") + 1) * F.lit(float(width)) - F.col(at)) <= F.lit(float(gap) * 1.001)
    copies = homes.withColumn("_chunk", F.explode(F.when(ahead, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))))

    def read(part: pd.DataFrame):
        part = part.sort_values([at, row], kind="stable").reset_index(drop=True)
        own = (part["_home"] == part["_chunk"]).to_numpy()
        return part, own, part[at].to_numpy(), _units(part[hist]) if hist else None

    def exits(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, own, t, unit = read(part)
        if not own.any():
            return pd.DataFrame([], columns=range(4))
        starts = [-1, *np.flatnonzero(~own).tolist()]
        number = part[row].to_numpy()
        # without an entry the first row stays, so only a near entry can pass through
        ends = [(k[-1] if k else s) for s, k in zip(starts, _walk(t, unit, own, starts, gap, similar))]
        return pd.DataFrame([[*key, FAR if s < 0 else int(number[s]), int(number[e])] for s, e in zip(starts, ends)])

    def entries(key: tuple, maps: pd.DataFrame) -> pd.DataFrame:
        out, state = [], FAR
        for c, m in maps.groupby("_chunk", sort=True):
            exit_of = dict(zip(m["entry"].tolist(), m["exit"].tolist()))
            state = state if state in exit_of else FAR
            out.append([*key, int(c), state])
            state = exit_of[state]
        return pd.DataFrame(out)

    def kept(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, own, t, unit = read(part)
        entry = np.flatnonzero(~own & (part[row] == part["entry"]).to_numpy())
        stay = _walk(t, unit, own, [int(entry[0]) if len(entry) else -1], gap, similar)[0]
        return part.loc[stay, ["video_id", at, row]]

    maps = copies.groupBy("video_id", "_chunk").applyInPandas(exits, f"video_id {kind['video_id']}, _chunk bigint, entry bigint, exit bigint")
    known = maps.groupBy("video_id").applyInPandas(entries, f"video_id {kind['video_id']}, _chunk bigint, entry bigint")
    return copies.join(known, ["video_id", "_chunk"]).groupBy("video_id", "_chunk").applyInPandas(
        kept, f"video_id {kind['video_id']}, `{at}` {kind[at]}, `{row}` {kind[row]}")
