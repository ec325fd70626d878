"""A value that an expression uses many times, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is bound as a lambda's variable: written out, it would be computed at each use, in a lambda for each element."""
    return F.transform(F.array(value), lambda x: body(x))[0]
