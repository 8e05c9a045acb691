"""Draws without replacement by the least hashes, repeatable on any engine and any order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.operators.ordered import top_k


def draw_key(*parts) -> Column:
    """md5 of the parts joined by colons: a portable hash."""
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def unit(key: Column) -> Column:
    """A number from 0 up to 1 from the first eight digits of a key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32)


def bottom_k(rows: DataFrame, by: list[str], id: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each group (of the table without ``by``), with ``draw_no`` in the order of the draw.

    A task keeps the n least hashes of a group and sketches merge, so a group of any size sends n rows a task. ``id`` differs in every
    row of a group.
    """
    keyed = rows.withColumn("_key", draw_key(F.lit(seed), id))
    return top_k(keyed, by, [F.asc("_key"), F.asc(id)], n, "draw_no").drop("_key")


def first_successes(rows: DataFrame, by: list[str], id: str, n: int, success: Column, spare: int = 4, seed: int = 0) -> DataFrame:
    """``spare`` times ``n`` rows are drawn; the first n of them that succeed stay, with ``draw_no`` and ``pick_no``.

    ``success`` is only worked out for the rows drawn.
    """
    drawn = bottom_k(rows, by, id, spare * n, seed)
    return top_k(drawn.filter(success), by, [F.asc("draw_no")], n, "pick_no")
