"""Cells of vectors with bounds.

A cell has a center, the largest distance of a row from it and the largest norm
of a row. Both give a bound for the score of any of its rows, so cells below
the kth score found so far stay closed and the result is that of scoring
everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions import numeric as N
from cuelight.operators import dense as D
from cuelight.operators.ordered import top_k
from cuelight.session import reliable

#: covers the rounding of distances and of the score grid
SLACK = 1e-6
#: numbers of one slice of a table of bounds, and bytes of one block of vectors
SLICE_NUMBERS, BLOCK_BYTES = 1 << 20, 32 << 20


@dataclass
class Cells:
    """rows: cell, key, embedding; the arrays have one entry per cell."""

    rows: DataFrame
    ids: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    norms: np.ndarray


def bounds(vectors: np.ndarray, cells: Cells) -> np.ndarray:
    """Upper bounds of the scores of vectors with the rows of cells: by the ball around the center, and by the triangle inequality."""
    dots = vectors @ cells.centers.T
    own = np.linalg.norm(vectors, axis=1)[:, None]
    apart = np.sqrt(np.maximum(0.0, own**2 + (cells.centers**2).sum(axis=1) - 2.0 * dots))
    gap = np.maximum(0.0, apart - cells.radii)
    best = np.minimum(dots + own * cells.radii, (own**2 + cells.norms**2 - gap**2) / 2.0)
    return best + SLACK * (1.0 + own * cells.norms)


def measured(rows: DataFrame, centers: np.ndarray) -> Cells:
    """The cells of ``rows`` (cell, key, embedding) with their radii and norms, one row per cell and task combined."""

    def scan(batches):
        radii, norms = np.full(len(centers), -1.0), np.zeros(len(centers))
        for batch in batches:
            if batch.num_rows:
                v, cell = D._matrix(batch.column("embedding")), batch.column("cell").to_numpy()
                np.maximum.at(radii, cell, np.linalg.norm(v - centers[cell], axis=1))
                np.maximum.at(norms, cell, np.linalg.norm(v, axis=1))
        ids = np.flatnonzero(radii >= 0.0)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(radii[ids]), pa.array(norms[ids])], ["cell", "radius", "norm"])

    parts = rows.select("cell", "embedding").mapInArrow(scan, "cell int, radius double, norm double")
    found = sorted(parts.groupBy("cell").agg(F.max("radius"), F.max("norm")).collect())  # one row per cell
    ids = np.array([r[0] for r in found], dtype=np.int64)
    return Cells(rows, ids, centers[ids], np.array([r[1] for r in found]), np.array([r[2] for r in found]))


def write_cells(corpus: DataFrame, path: str, n_list: int = 100, key: str = "kf_id") -> None:
    """Trains the centers once and stores the rows under a folder per cell."""
    celled, model = D.ivf_cells(corpus.select(key, N.as_doubles("embedding").alias("embedding")), D.ivf_cell_count(corpus.count(), n_list), key)
    # a crowded cell is split into several files by the adaptive plan
    celled.select("cell", key, "embedding").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    spark = corpus.sparkSession
    c = measured(_stored(spark, path, key), np.array(model.clusterCenters()))
    spark.createDataFrame(
        [(int(i), x.tolist(), float(r), float(n)) for i, x, r, n in zip(c.ids, c.centers, c.radii, c.norms)],
        "cell int, center array<double>, radius double, norm double",
    ).write.parquet(f"{path}/cells")


def read_cells(spark: SparkSession, path: str, key: str = "kf_id") -> Cells:
    """A stored index; the cells (``n_list`` at most) are read by the driver, the rows by nobody yet."""
    found = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])
    dim = len(found[0]["center"]) if found else 1
    return Cells(
        _stored(spark, path, key), np.array([r["cell"] for r in found], dtype=np.int64),
        np.array([r["center"] for r in found], dtype=np.float64).reshape(-1, dim),
        np.array([r["radius"] for r in found]), np.array([r["norm"] for r in found]),
    )


def _stored(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").select(F.col("cell").cast("int").alias("cell"), key, "embedding")


def search_cells(queries: DataFrame, cells: Cells, k: int, n_probe: int = 8, key: str = "kf_id") -> DataFrame:
    """query_id, key, dense, rank: the exact best ``k`` rows.

    A query opens cells in the order of their bounds, ``n_probe`` first and twice
    as many in each later round, until the bound of the next one is below its
    kth score. A round reads the folders of its cells alone. The driver holds
    the queries of one pass and their bounds.
    """
    schema = f"query_id {D._typed(queries, 'query_id')}, `{key}` {D._typed(cells.rows, key)}, dense double"

    def one_pass(rows: list) -> DataFrame:
        ids, q = D._query_block(rows)
        limits = bounds(q, cells) if ids else np.zeros((0, len(cells.ids)))
        order = np.argsort(-limits, axis=1, kind="stable")
        limits = np.take_along_axis(limits, order, axis=1)
        kth = dict.fromkeys(ids, -np.inf)
        found, done, step = None, 0, max(1, n_probe)
        while found is None or done < len(cells.ids):
            part = slice(done, done + step)
            wanted = limits[:, part] >= np.array([kth[i] for i in ids])[:, None]
            if found is not None and not wanted.any():
                break
            visits: dict[int, np.ndarray] = {
                int(cells.ids[c]): np.flatnonzero(((order[:, part] == c) & wanted).any(axis=1)) for c in np.unique(order[:, part][wanted])}
            now = _open(cells.rows, visits, ids, q, k, key, schema)
            both = now if found is None else found.drop("rank").unionByName(now)
            found = reliable(top_k(both, ["query_id"], [F.desc("dense"), F.asc(key)], k))
            full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("dense").alias("kth")).filter(F.col("n") >= k)
            kth.update({r["query_id"]: r["kth"] for r in full.collect()})
            done, step = done + step, step * 2
        return found

    return D.in_passes(queries.select("query_id", "embedding"), "query_id", D.PASS_ROWS, one_pass)


def opened_rows(rows: DataFrame, cell_ids) -> DataFrame:
    return rows.filter(F.col("cell").isin([int(c) for c in cell_ids]))


def _open(rows: DataFrame, visits: dict, ids: list, q: np.ndarray, k: int, key: str, schema: str) -> DataFrame:
    """Best ``k`` rows per task of each query in the cells that it visits."""
    id_type, key_type = pa.array(ids[:1]).type, D._arrow(rows, key)

    def scan(batches):
        best: dict = {}
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            for c in np.unique(cell):
                at, mine = np.flatnonzero(cell == c), visits.get(int(c), ())
                part = batch.take(pa.array(at))
                keys = np.array(part.column(key).to_pylist())
                s = D._grid(q[mine] @ D._matrix(part.column("embedding")).T) if len(mine) else ()
                for i, score in zip(mine, s):
                    best[i] = D._keep(best.get(i), score, keys, None, k)
        for i, (score, keys, _) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i]] * len(score), id_type), pa.array(keys.tolist(), key_type), pa.array(score)], ["query_id", key, "dense"])

    return opened_rows(rows, visits).mapInArrow(scan, schema)


def pivot_cells(rows: DataFrame, n_list: int = 4096) -> Cells:
    """Rows (key, embedding) with the nearest of about 4 sqrt(N) pivots, which are the rows of least hashes.

    The pivots travel with the tasks, so ``n_list`` bounds their number (38 MB at
    1152 dimensions); beyond a million rows cells grow with the data.
    """
    key = rows.columns[0]
    n_pivots = max(1, min(n_list, int(np.ceil(4.0 * np.sqrt(rows.count())))))
    pivots = rows.orderBy(F.xxhash64(key), key).limit(n_pivots).collect()  # n_list rows at most
    centers = np.array([r["embedding"] for r in pivots], dtype=np.float64) if pivots else np.zeros((0, 1))
    sizes = (centers**2).sum(axis=1) / 2.0

    def scan(batches):
        for batch in slices(batches, len(centers)):
            near = (D._matrix(batch.column("embedding")) @ centers.T - sizes).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns], ["cell", *batch.schema.names])

    homes = rows.mapInArrow(scan, f"cell int, `{key}` {D._typed(rows, key)}, embedding array<double>")
    return measured(reliable(homes), centers)


def slices(batches, width: int):
    """The batches in pieces whose table of ``width`` numbers per row stays at about 8 MB."""
    step = max(1, SLICE_NUMBERS // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _lowest(batch: pa.RecordBatch, at_least: float) -> np.ndarray:
    return np.maximum(batch.column("kth").fill_null(-np.inf).to_numpy(zero_copy_only=False), at_least)


def visits(rows: DataFrame, cells: Cells, first: int, last: int, at_least: float) -> DataFrame:
    """cell, key, embedding: each row at the cells of places ``first`` to ``last`` by bound that its kth score leaves open.

    rows: key, embedding, kth (null: fewer than k neighbours are known).
    """
    key = rows.columns[0]
    cells = Cells(None, cells.ids, cells.centers, cells.radii, cells.norms)  # what travels with the tasks

    def scan(batches):
        for batch in slices(batches, len(cells.ids)):
            limits = bounds(D._matrix(batch.column("embedding")), cells)
            order = np.argsort(-limits, axis=1, kind="stable")[:, first:last]
            row, place = np.nonzero(np.take_along_axis(limits, order, axis=1) >= _lowest(batch, at_least)[:, None])
            picked = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.ids[order[row, place]].astype(np.int32)), picked.column(0), picked.column(1)], ["cell", key, "embedding"])

    return rows.mapInArrow(scan, f"cell int, `{key}` {D._typed(rows, key)}, embedding array<double>")


def open_cells(rows: DataFrame, cells: Cells, at_least: float) -> DataFrame:
    """``rows`` (key, embedding, kth) with ``n_open``, the number of cells that the kth score leaves open."""
    cells = Cells(None, cells.ids, cells.centers, cells.radii, cells.norms)

    def scan(batches):
        for batch in slices(batches, len(cells.ids)):
            n = (bounds(D._matrix(batch.column("embedding")), cells) >= _lowest(batch, at_least)[:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int32))], [*batch.schema.names, "n_open"])

    key = rows.columns[0]
    return rows.mapInArrow(scan, f"`{key}` {D._typed(rows, key)}, embedding array<double>, kth double, n_open int")


def meet_in_blocks(rows: DataFrame, homes: DataFrame, dim: int, k: int, key: str, block_rows: int, at_least: float) -> DataFrame:
    """query_id, key, dense: the best ``k`` other rows of each row per block of the homes; every row meets every block once.

    rows: _key, embedding, kth; homes: _key, embedding. A block is as large as
    ``BLOCK_BYTES`` allow and the tasks are many enough, so a row is copied as
    seldom as can be; scores exist in slices.
    """
    most, tasks = max(1, BLOCK_BYTES // (8 * dim)), 3 * homes.sparkSession.sparkContext.defaultParallelism
    sizes = [rows.count(), homes.count()]
    parts, limits = [max(1, -(-n // most)) for n in sizes], [max(1, -(-n // block_rows)) for n in sizes]
    while parts[0] * parts[1] < tasks and any(p < m for p, m in zip(parts, limits)):
        side = min((i for i in (0, 1) if parts[i] < limits[i]), key=lambda i: parts[i])
        parts[side] += 1

    def cut(df: DataFrame, own: str, other: str, n_own: int, n_other: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("_key"), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.array(*map(F.lit, range(n_other)))))
        return placed.repartition(parts[0] * parts[1], "_a", "_b").groupBy("_a", "_b")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out_q, out_k, out_s = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        if a.num_rows and b.num_rows:
            b = b.sort_by("_key")
            ka, kb = np.array(a.column("_key").to_pylist()), np.array(b.column("_key").to_pylist())
            va, vb = (D._matrix(t.column("embedding").combine_chunks()) for t in (a, b))
            known = _lowest(a, at_least)
            step, n = max(1, 2 * SLICE_NUMBERS // len(kb)), len(kb)
            own = np.searchsorted(kb, ka, "left"), np.searchsorted(kb, ka, "right")
            for at in range(0, len(ka), step):
                s = va[at : at + step] @ vb.T
                for i in np.flatnonzero(own[0][at : at + step] < own[1][at : at + step]):
                    s[i, own[0][at + i] : own[1][at + i]] = -np.inf
                low = known[at : at + step].copy()
                for i in np.flatnonzero(np.isneginf(low)) if n > k else ():
                    low[i] = np.partition(s[i], n - k)[n - k]
                # the grid moves a score by half a step at most
                i, j = np.nonzero((s >= (low - 2.0 / N.GRID)[:, None]) & np.isfinite(s))
                score = D._grid(s[i, j])
                order = np.lexsort((j, -score, i))  # homes are sorted by key
                i, j, score = i[order], j[order], score[order]
                place = np.arange(len(i)) - np.searchsorted(i, i, "left")
                best = (place < k) & (score >= at_least)
                out_q.append(at + i[best])
                out_k.append(j[best])
                out_s.append(score[best])
        take = lambda t, x: t.column("_key").combine_chunks().take(pa.array(np.concatenate(x)))
        return pa.table({"query_id": take(a, out_q), key: take(b, out_k), "dense": np.concatenate(out_s)})

    kind = D._typed(homes, "_key")
    left = rows.select("_key", "embedding", "kth").toDF("_key", "embedding", "kth")
    return (
        cut(left, "_a", "_b", *parts).cogroup(cut(homes.select("_key", "embedding"), "_b", "_a", *parts[::-1]))
        .applyInArrow(compare, f"query_id {kind}, `{key}` {kind}, dense double")
    )


def neighbours(corpus: DataFrame, k: int, key: str, block_rows: int, n_list: int, n_probe: int, at_least: float = -np.inf) -> DataFrame:
    """The exact ``k`` nearest other rows of every row with a score of ``at_least``.

    A row first meets the cells of its highest bounds; the kth score found there
    closes all cells whose bound is below it. It then meets the cells that are
    still open if they are few, and otherwise all rows, block by block.

    What is compared follows the data: rows of groups that lie apart meet their
    own group alone. Inside a group of many dimensions the bounds exclude little,
    and a table that is one such group is compared in all pairs; a row is copied
    once per block then, not once per cell.
    """
    rows = corpus.select(F.col(key).alias("_key"), N.as_doubles("embedding").alias("embedding"))
    cells = pivot_cells(rows, n_list)
    homes, n = cells.rows, len(cells.ids)
    best = lambda df: top_k(df.filter(F.col("dense") >= at_least), ["query_id"], [F.desc("dense"), F.asc(key)], k)
    asked = homes.select("_key", "embedding").withColumn("kth", F.lit(None).cast("double"))
    found = best(D.meet_in_cells(visits(asked, cells, 0, n_probe, at_least), homes, k, key, block_rows))
    if n <= n_probe:
        return reliable(found)
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("_key"), F.col("dense").alias("kth"))
    asked = reliable(open_cells(homes.select("_key", "embedding").join(full, "_key", "left"), cells, at_least))
    few, many = asked.filter(F.col("n_open") <= 8 * n_probe), asked.filter(F.col("n_open") > 8 * n_probe)
    # either meets all that is open again, so nothing of the first round is needed but its kth scores
    now = D.meet_in_cells(visits(few.drop("n_open"), cells, 0, n, at_least), homes, k, key, block_rows)
    if not many.isEmpty():
        now = now.unionByName(meet_in_blocks(many, homes, cells.centers.shape[1], k, key, block_rows, at_least))
    return reliable(best(now))
