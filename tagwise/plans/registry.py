"""Registry of named queries: ``(spark, sf_dir) -> DataFrame`` plus oracle SQL.

Each plan module registers its queries with :func:`register`; the oracle SQL (a
DuckDB string over the raw test tables) sits next to the Spark plan. Queries that
SQL cannot express register without SQL and are covered by unit tests instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class QuerySpec:
    name: str
    fn: QueryFn
    sql: str | None
    covers: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, sql: str | None = None, covers: str = "") -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql, tuple(covers.split()))
        return fn
    return deco


def load_all() -> dict[str, QuerySpec]:
    """Import every plan module so its queries register."""
    import importlib

    for mod in PLAN_MODULES:
        importlib.import_module(f"{__package__}.{mod}")
    return REGISTRY


PLAN_MODULES = ["q_stats", "q_labels", "q_text", "q_splits", "q_metrics", "q_spans", "q_features", "q_vectors", "q_prompts", "q_sources", "q_stream", "q_models"]
