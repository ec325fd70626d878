"""Sums that don't depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Holds the shortest decimal of a double below 1e10 to 18 places; sums of it hold 1e10 rows.
EXACT = "decimal(28,18)"


def exact_mean(value: Column) -> Column:
    """Mean of doubles, added as decimals: sums of doubles differ in their last digits with the order in which tasks end.

    Groups with a value that EXACT can't hold (infinite, not a number, 1e10 or more) get the plain mean.
    """
    value = value.cast("double")
    exact = F.when(~F.isnan(value), value).try_cast(EXACT)
    mean = F.try_divide(F.try_sum(exact), F.count(exact)).cast("double")
    return F.when(F.count(value) == F.count(exact), mean).otherwise(F.avg(value))
