"""Use a computed value more than once without computing it more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``. The value is worked out once per row; a plain reuse of a
    Column would repeat it wherever Spark does not find the common part, as in the
    branches of a condition or in lambda functions.
    """
    return F.transform(F.array(value), body)[0]
