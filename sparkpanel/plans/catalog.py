"""Query catalog: every operator bound to the test tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` is the
equivalent DuckDB SQL over the same parquet views (omitted where the result
is not expressible in SQL, e.g. model fits).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every query module (each registers itself)."""
    from . import q_pairs, q_quality  # noqa: F401
    for mod in ("q_clean", "q_schema", "q_metrics", "q_drift", "q_features",
                "q_models", "q_registry", "q_io"):
        try:
            __import__(f"{__package__}.{mod}")
        except ModuleNotFoundError as exc:
            if exc.name != f"{__package__}.{mod}":
                raise
