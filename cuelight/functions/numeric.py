"""Score calibration, vectors and other arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
#: Dense scores are kept on this grid. It is finer than float32, and copies of a
#: vector tie exactly on it whatever kernel computed their dot products.
GRID = 1e9


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def on_grid(x, grid: float = GRID) -> Column:
    return F.floor(_c(x) * F.lit(grid) + F.lit(0.5)) / F.lit(grid)


def minmax(x, lo, hi) -> Column:
    return (_c(x) - _c(lo)) / F.greatest(F.lit(EPS), _c(hi) - _c(lo))


def maxnorm(x, hi) -> Column:
    return _c(x) / F.greatest(F.lit(EPS), _c(hi))


def saturate(score, source=None, w_ocr=None) -> Column:
    """b/(25+b); on-screen text gets b/(15+b) times a boost, at most 1."""
    b = _c(score)
    speech = b / (b + F.lit(25.0))
    if source is None:
        return speech
    w = F.lit(0.0) if w_ocr is None else (F.lit(float(w_ocr)) if isinstance(w_ocr, (int, float)) else _c(w_ocr))
    boost = F.when(w > 0, F.lit(1.5) + w * 2.0).otherwise(F.lit(1.2))
    return F.when(_c(source) == "ocr", F.least(F.lit(1.0), b / (b + F.lit(15.0)) * boost)).otherwise(speech)


def linear_clip(x, lo: float = 0.70, width: float = 0.20) -> Column:
    return F.least(F.greatest((_c(x) - lo) / width, F.lit(0.0)), F.lit(1.0))


def clip(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def box_xywh(box) -> Column:
    """[ymin, xmin, ymax, xmax] as [xmin, ymin, width, height]."""
    b = _c(box)
    return F.array(
        b[1], b[0], F.greatest(F.lit(0.0), b[3] - b[1]), F.greatest(F.lit(0.0), b[2] - b[0])
    )


def clamp_int(text, lo: int, hi: int, default: int) -> Column:
    value = F.expr("null") if text is None else _c(text).try_cast("bigint")
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(value, F.lit(default)))).cast("bigint")


def clamp_double(text, lo: float, hi: float, default: float) -> Column:
    value = _c(text).try_cast("double")
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.coalesce(value, F.lit(float(default)))))


def clamp_weights(w_dense, w_speech) -> Column:
    """Both weights in [0, 1], or the default pair when either is unusable."""
    d, s = _c(w_dense).try_cast("double"), _c(w_speech).try_cast("double")
    good = d.isNotNull() & s.isNotNull()
    return F.when(
        good, F.struct(clip(d).alias("w_dense"), clip(s).alias("w_speech"))
    ).otherwise(F.struct(F.lit(0.85).alias("w_dense"), F.lit(0.15).alias("w_speech")))


def gaussian_weights(radius: int = 2, sigma: float = 1.5) -> list[float]:
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def as_doubles(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    """Dot product on the grid, summed left to right in double."""
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return on_grid(F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x))


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    Inside a lambda Catalyst evaluates an outer expression again for every
    element; an array of one element binds it.
    """
    return F.transform(F.array(value), body)[0]


def normalize(v, floor: float = 0.0) -> Column:
    """Unit vector; a vector with norm at or under ``floor`` stays as it is."""
    def scaled(v):
        return let(norm(v), lambda n: F.when(n > floor, F.transform(v, lambda x: x / n)).otherwise(v))

    return let(as_doubles(v), scaled)


def blend(a, b, alpha: float, beta: float) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * alpha + y * beta)
