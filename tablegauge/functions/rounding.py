"""Half-to-even rounding on doubles, and guarded percentages.

``rint(x * 10^n) / 10^n`` is what array libraries do for ``round(x, n)``.  It stays inside generated code,
where ``bround`` on a double goes through a decimal object per row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_even(col: Column, digits: int) -> Column:
    scale = float(10 ** digits)
    return F.rint(col.cast("double") * F.lit(scale)) / F.lit(scale)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, NULL when ``whole`` is zero (ANSI mode raises otherwise)."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return round_even(ratio(part, whole) * F.lit(100.0), digits)
