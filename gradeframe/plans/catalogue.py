"""Registry of named queries: a Spark builder and (where SQL can say it) a DuckDB twin.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame; the SQL twin
runs on DuckDB over the same parquet tables. Output rules so both sides hash
alike: flags are ints, doubles are rounded to 6 digits, arrays are joined to
text in a defined order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "overall_stats"


def register(name: str, sql: str | None = None):
    """Decorator: register a query builder under ``name`` with its oracle SQL."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and turn booleans into ints (result-hash rules)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _load_all() -> None:
    # Importing the modules fills the registry.
    from . import q_compare, q_corpus, q_history, q_passk, q_pyjobs, q_scans, q_stats, q_text  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)
