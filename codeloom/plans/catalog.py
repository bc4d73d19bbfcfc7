"""All registered queries."""

from __future__ import annotations

from codeloom.plans import chunks, evaluation, ingest, search, stream  # noqa: F401 - they register
from codeloom.plans.registry import ORACLES, QUERIES, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
