"""All queries of the library (without the training-text operators)."""

from __future__ import annotations

from . import ORACLES, QUERIES
from ..operators import analytics, assist, chunking, classify, costs, evidence, retrieval, tools  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
