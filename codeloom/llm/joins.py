"""Joins in which no key is one task's work, however many rows have it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold more than one in so many rows are matched by broadcast; there are fewer of them.
SHARE = 10_000


def match_keys(rows: DataFrame, table: DataFrame, on: list[str], n_rows: str, share: int = SHARE) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each key once and in ``n_rows`` how many
    of ``rows`` have it.

    A key with more than one in ``share`` of the rows is matched by broadcast (fewer than
    ``share`` keys can be), so that it stays spread; the others meet in a shuffle, in which
    none of them weighs more than that.
    """
    total = rows.count()
    hot = F.col(n_rows) * share > total
    new = [c for c in table.columns if c not in on]
    marked = rows.join(F.broadcast(table.where(hot).withColumn("__hot", F.lit(True))), on, "left")
    rest = marked.where("__hot IS NULL").select(*rows.columns).join(table.where(~hot), on)
    return marked.where("__hot").select(*rows.columns, *new).unionByName(rest.select(*rows.columns, *new))
