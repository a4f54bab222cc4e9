"""Named queries: each is ``fn(spark, sf_dir) -> DataFrame`` plus, where SQL can
express it, an independent DuckDB oracle over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.plans.oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn`` under ``name``; ``oracle`` is DuckDB SQL using ``views`` as CTEs."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle, *views)
        return fn

    return deco


def r6(c) -> Column:
    """Round doubles to 6 places so the oracle comparison is exact."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def load_all() -> None:
    """Import every query module (registration happens at import)."""
    from revlens.plans import (  # noqa: F401
        q_quality, q_text, q_absa, q_metrics, q_models, q_misc,
    )
