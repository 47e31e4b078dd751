"""The registry: queries by name with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a (spark, sf_dir) function under its name; ``{name}`` in the SQL stands for a model table."""

    def keep(f):
        from ..sources.tables import MODEL_SQL

        QUERIES[f.__name__] = f
        if sql:
            out = sql
            for name, text in MODEL_SQL.items():
                out = out.replace("{" + name + "}", text)
            ORACLES[f.__name__] = out
        return f

    return keep
