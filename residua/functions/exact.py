"""Sums of doubles that are the same in every order of the rows.

Floating-point addition depends on the order, and with it on partitions and
retries.  Here each value is cut into whole numbers on a fixed grid (a
leading part in units of 2**90, six parts of 30 bits below it), which decimals
add without rounding; the seven sums are put together at the end.  Bits below
2**-90 are cut off each value.  Values of 2**143 and more, infinities and NaN
are added as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = float(1 << 30)
PARTS, LEADING = 7, float(1 << 90)
LARGEST = LEADING * (1 << 53)


def exact_sum(value) -> Column:
    """Aggregate: the sum of a double column, independent of the order; null without a value."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    fits = F.abs(x) < LARGEST                     # false for NaN too
    rest, parts = F.abs(x) / LEADING, []
    for _ in range(PARTS):
        parts.append(F.floor(rest))
        rest = (rest - parts[-1]) * PART          # both steps are exact: powers of two, and leading bits removed
    sums = [F.sum(F.when(fits, (F.signum(x) * p).cast("decimal(18,0)"))).cast("double") for p in parts]
    total = F.lit(0.0)
    for s in reversed(sums):
        total = total / PART + F.coalesce(s, F.lit(0.0))
    plain = F.sum(F.when(x.isNotNull() & ~fits, x))
    return F.when(F.count(x) > 0, total * LEADING + F.coalesce(plain, F.lit(0.0)))


def exact_avg(value) -> Column:
    """Aggregate: the mean by :func:`exact_sum`."""
    x = F.col(value) if isinstance(value, str) else value
    return F.try_divide(exact_sum(x), F.count(x))
