"""First records per key, and limits in order of first appearance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(records: DataFrame, key: str = "repo", order: str = "seq") -> DataFrame:
    """The record of each key that comes first by ``order``, which must be unique.

    Only (key, order) is aggregated, combined before the shuffle, so a key with
    most of the records costs one row per task. The full records are matched on
    ``order``, which spreads evenly.
    """
    firsts = records.groupBy(key).agg(F.min(order).alias(order)).select(order)
    return records.join(firsts, order, "left_semi")


def first_n_keys(
    records: DataFrame, n: int | None, key: str = "repo", order: str = "seq"
) -> DataFrame:
    """First records of the ``n`` keys that appear first; None keeps all, 0 none."""
    if n is None:
        return first_per_key(records, key, order)
    firsts = records.groupBy(key).agg(F.min(order).alias(order)).select(order)
    return records.join(firsts.orderBy(order).limit(n), order, "left_semi")


def batch_rounded_limit(
    records: DataFrame, n: int | None, batch_size: int = 50, key: str = "repo", order: str = "seq"
) -> DataFrame:
    """As ``first_n_keys``, with ``n`` rounded up to whole batches."""
    rounded = None if n is None else math.ceil(n / batch_size) * batch_size
    return first_n_keys(records, rounded, key, order)
