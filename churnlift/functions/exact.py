"""Order-independent sums of doubles as mergeable native aggregates.

A value is split into whole numbers that add up without rounding: the whole
part, the millionths, and what is left of it (at most half a millionth) in two
limbs of 40 bits down to 2**-100.  Each part is an ordinary SUM, so a partial
sum is a few numbers and neither the order of the rows nor the partitioning
changes a bit of the result.  Values on a grid of six decimals, the usual
measurement, leave nothing for the limbs and sum up like decimals; 1e-9 beside
1e13 is kept.  Values of 2**33 and more are split to within 1e-22; finite values
below 2**62 in magnitude; NULL and NaN are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col

MILLION = 1_000_000
#: Below this magnitude value * 10**6 is a whole number that a double holds.
HELD = 2.0 ** 33
HIGH, LOW = 2.0 ** 60, 2.0 ** 40


def _value(c) -> Column:
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def exact_double_sum(c) -> Column:
    """SUM of a double column, NULL for a group without values."""
    x = _value(c)
    whole = F.floor(x)
    fraction = x - whole.cast("double")
    millionths = F.rint(fraction * float(MILLION)).cast("bigint")
    # the double nearest to the grid value: nothing is left where the value is on the grid
    near = (whole * MILLION + millionths).cast("double") / float(MILLION)
    left = F.when(F.abs(x) < HELD, x - near).otherwise(fraction - millionths.cast("double") / float(MILLION)) * HIGH
    high = F.floor(left)
    low = F.floor((left - high.cast("double")) * LOW)

    def total(part: Column) -> Column:
        return F.coalesce(F.sum(part.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    grid = (total(whole) * F.lit(MILLION).cast("decimal(7,0)") + total(millionths)) / F.lit(MILLION).cast("decimal(7,0)")
    rest = total(high).cast("double") / HIGH + total(low).cast("double") / (HIGH * LOW)
    return F.when(F.count(x) > 0, grid.cast("double") + rest)


def exact_double_avg(c) -> Column:
    """Mean of the values that are not NULL or NaN."""
    return F.try_divide(exact_double_sum(c), F.count(_value(c)).cast("double"))
