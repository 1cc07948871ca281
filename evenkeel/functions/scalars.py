"""Column expressions: dates, one-hot arrays, probability arrays, clamps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(col, fmt: str | None = None) -> Column:
    """Timestamp of a text column; text that is no date gives null."""
    return F.try_to_timestamp(_col(col), F.lit(fmt)) if fmt else F.try_to_timestamp(_col(col))


def fallback(*cols) -> Column:
    """First value that is not null."""
    return F.coalesce(*[_col(c) for c in cols])


def date_parts(col) -> dict[str, Column]:
    """Month, day and weekday (Monday = 0)."""
    c = _col(col)
    return {"month": F.month(c), "day": F.dayofmonth(c), "weekday": F.weekday(c)}


def day_diff(end, start) -> Column:
    """Whole calendar days from ``start`` to ``end``; may be negative."""
    return F.datediff(_col(end), _col(start))


def clamp(col, low: float, high: float) -> Column:
    return F.greatest(F.least(_col(col), F.lit(high)), F.lit(low))


def onehot(code, levels: int) -> Column:
    """Array of zeros with a one at position ``code``; an unknown code gives zeros."""
    c = _col(code)
    return F.transform(
        F.sequence(F.lit(0), F.lit(levels - 1)),
        lambda i: F.when(c == i, F.lit(1.0)).otherwise(F.lit(0.0)),
    )


def onehot_to_label(values) -> Column:
    """Position of the largest entry, counted from 0; the first one on ties."""
    arr = F.array(*[_col(c) for c in values]) if isinstance(values, (list, tuple)) else _col(values)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def softmax(scores) -> Column:
    s = _col(scores)
    top = F.array_max(s)
    powers = F.transform(s, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def sample_category(weights, u) -> Column:
    """First position whose running sum passes ``u`` times the total weight."""
    w, u = _col(weights), _col(u)
    target = u * F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x)
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("code"))

    def step(acc, x):
        mass = acc["mass"] + x
        return F.struct(
            mass.alias("mass"),
            F.when(mass <= target, acc["code"] + 1).otherwise(acc["code"]).alias("code"),
        )

    code = F.aggregate(w, start, step, lambda acc: acc["code"])
    return F.least(code, F.size(w) - 1).cast("int")


def interpolate(x, y, gap) -> Column:
    """x + gap * (y - x), for numbers or for arrays when ``x`` is an array column name."""
    return _col(x) + _col(gap) * (_col(y) - _col(x))


def interpolate_arrays(x, y, gap) -> Column:
    g = _col(gap)
    return F.zip_with(_col(x), _col(y), lambda a, b: a + g * (b - a))


# Coefficients of the error function, Abramowitz & Stegun formula 7.1.26.
ERF_SCALE = 0.3275911
ERF_TERMS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z) -> Column:
    """Standard normal distribution function, absolute error below 1e-7."""
    z = _col(z)
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_SCALE) * x)
    poly: Column = F.lit(0.0)
    for term in reversed(ERF_TERMS):
        poly = (poly + F.lit(term)) * t
    half_tail = F.lit(0.5) * poly * F.exp(-x * x)
    return F.when(z >= 0, F.lit(1.0) - half_tail).otherwise(half_tail)


def level_code(col, levels: Sequence) -> Column:
    """Position of a value in a short fixed list; null when it is not there."""
    found = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(col)) - 1
    return F.when(found >= 0, found.cast("int"))
