"""Order-dependent primitives that never put one long timeline into one task.

A timeline (all rows of one key) may be a third of the table. Each function
therefore takes a ``chunk``: an expression that grows with the order (for
example ``floor(t / 3600)``), splits a key into pieces, computes inside
(key, chunk), and carries the result of earlier chunks over from a summary with
one row per (key, chunk).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


def time_chunk(t: Column | str, width: float) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / F.lit(float(width)))


def _local(keys, order):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def _earlier(keys):
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def with_position(df: DataFrame, keys, order, chunk: Column, name: str = "pos") -> DataFrame:
    """1-based position of each row in its key; without keys, in the whole table (``chunk`` is then not used)."""
    if not keys:
        return _position_in_table(df, order, name)
    cut = df.withColumn(CHUNK, chunk)
    offsets = (
        cut.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)))
        .drop("_n")
    )
    return (
        cut.withColumn("_rn", F.row_number().over(_local(keys, order)))
        .join(offsets, [*keys, CHUNK])
        .withColumn(name, (F.col("_rn") + F.col("_off")).cast("bigint"))
        .drop("_rn", "_off", CHUNK)
    )


def _position_in_table(df: DataFrame, order, name: str) -> DataFrame:
    """Positions over all rows: ranges of the order are numbered on their own and moved by the rows of the ranges before, one number
    per partition."""
    from cuelight.session import reliable

    cut = reliable(df.repartitionByRange(*order).withColumn(CHUNK, F.spark_partition_id()))
    counts = {r[CHUNK]: r["count"] for r in cut.groupBy(CHUNK).count().collect()}
    before, total = [], 0
    for part in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(part, 0)
    offsets = F.array(*[F.lit(n).cast("bigint") for n in before])
    return cut.withColumn(name, F.row_number().over(_local([], order)) + F.element_at(offsets, F.col(CHUNK) + 1)).drop(CHUNK)


def with_previous(df: DataFrame, keys, order, chunk: Column, cols, name: str = "prev") -> DataFrame:
    """``name``: struct of ``cols`` of the row before, null at the start of a key."""
    cut = df.withColumn(CHUNK, chunk)
    row = F.struct(*cols)
    edges = (
        cut.groupBy(*keys, CHUNK).agg(F.max_by(row, F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(CHUNK)))
        .drop("_last")
    )
    return (
        cut.withColumn("_here", F.lag(row).over(_local(keys, order)))
        .join(edges, [*keys, CHUNK])
        .withColumn(name, F.coalesce("_here", "_carry"))
        .drop("_here", "_carry", CHUNK)
    )


def running_sum(df: DataFrame, keys, order, chunk: Column, value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` inside a key."""
    cut = df.withColumn(CHUNK, chunk)
    sums = (
        cut.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_s"))
        .withColumn("_off", F.coalesce(F.sum("_s").over(_earlier(keys)), F.lit(0)))
        .drop("_s")
    )
    here = F.sum(value).over(_local(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return (
        cut.withColumn("_here", here)
        .join(sums, [*keys, CHUNK])
        .withColumn(name, F.col("_here") + F.col("_off"))
        .drop("_here", "_off", CHUNK)
    )


def prefix_max(df: DataFrame, keys, order, chunk: Column, value: str, name: str) -> DataFrame:
    """Largest ``value`` of all rows strictly before a row, null at the start of a key."""
    cut = df.withColumn(CHUNK, chunk)
    tops = (
        cut.groupBy(*keys, CHUNK).agg(F.max(value).alias("_m"))
        .withColumn("_carry", F.max("_m").over(_earlier(keys)))
        .drop("_m")
    )
    here = F.max(value).over(_local(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return (
        cut.withColumn("_here", here)
        .join(tops, [*keys, CHUNK])
        .withColumn(name, F.greatest("_here", "_carry"))
        .drop("_here", "_carry", CHUNK)
    )


def neighbours(df: DataFrame, keys, pos: str, radius: int, value: str, chunk_rows: int = 4096) -> DataFrame:
    """Adds ``_w``: the values at pos-radius .. pos+radius, edges repeated.

    Rows near a chunk border are copied into the chunk next door, so every chunk
    is a group of bounded size.
    """
    home = F.floor(F.col(pos) / chunk_rows)
    spread = F.array_distinct(F.array(
        F.floor((F.col(pos) - radius) / chunk_rows), home, F.floor((F.col(pos) + radius) / chunk_rows)
    ))
    copies = df.withColumn("_home", home).withColumn(CHUNK, F.explode(spread))
    w = Window.partitionBy(*keys, CHUNK).orderBy(pos)
    here = F.col(value)

    def reach(step, fn):
        # the row `d` steps away, else the farthest row there is on that side
        return F.coalesce(*[fn(value, d).over(w) for d in range(step, 0, -1)], here)

    window = [reach(d, F.lag) for d in range(radius, 0, -1)] + [here] + [
        reach(d, F.lead) for d in range(1, radius + 1)
    ]
    return (
        copies.withColumn("_w", F.array(*window))
        .filter(F.col("_home") == F.col(CHUNK))
        .drop("_home", CHUNK)
    )


def gaussian(
    df: DataFrame, keys, pos: str, value: str, name: str, radius: int = 2, sigma: float = 1.5,
    vector: bool = False, chunk_rows: int = 4096,
) -> DataFrame:
    """Centred Gaussian smoothing along the positions of a key, edges repeated.

    With ``vector`` the value is an array and is smoothed element by element.
    Smoothing commutes with the dot product, so smoothing the N vectors once
    replaces smoothing Q x N scores.
    """
    from cuelight.functions.numeric import gaussian_weights

    weights = gaussian_weights(radius, sigma)
    out = neighbours(df, keys, pos, radius, value, chunk_rows)
    w = F.col("_w")
    if vector:
        parts = [F.transform(w[i], (lambda k: lambda x: x * F.lit(k))(k)) for i, k in enumerate(weights)]
        total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)
    else:
        total = reduce(lambda a, b: a + b, [w[i] * F.lit(k) for i, k in enumerate(weights)])
    return out.withColumn(name, total).drop("_w")


def text_runs(
    lines: DataFrame, key: str = "video_id", t: str = "t_sec", tie: str = "line_id", text: str = "text",
    hold: float = 3.0, chunk_width: float = 3600.0,
) -> DataFrame:
    """Merge neighbouring lines of the same text (gaps and islands).

    A line stays on screen for ``hold`` seconds; it joins the run before it when
    the texts agree and it starts at most ``hold`` after that run ends.
    """
    chunk = time_chunk(t, chunk_width)
    seen = with_previous(lines, [key], [t, tie], chunk, [text, t])
    joins = (F.col(text) == F.col(f"prev.{text}")) & (F.col(t) <= F.col(f"prev.{t}") + hold + hold)
    flagged = seen.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).drop("prev")
    runs = running_sum(flagged, [key], [t, tie], chunk, "_new", "run_id")
    return (
        runs.groupBy(key, "run_id")
        .agg(
            F.min(t).alias("start_sec"), (F.max(t) + hold).alias("end_sec"),
            F.first(text).alias("text"), F.count(F.lit(1)).alias("n_lines"),
        )
        .withColumn("run_id", F.col("run_id").cast("bigint"))
    )


def top_k(df: DataFrame, keys, order, k, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank.

    Spark limits each map task to k rows per key before the shuffle
    (WindowGroupLimit), so a hot key moves k rows per task at most.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
