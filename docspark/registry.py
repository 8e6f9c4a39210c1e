"""Registry that keeps each query together with its equivalent SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}
MODULES = (
    "docspark.operators.catalog",
    "docspark.functions.scalars",
    "docspark.operators.files",
    "docspark.operators.chunking",
    "docspark.operators.similarity",
    "docspark.operators.search",
    "docspark.operators.layout",
    "docspark.operators.detectors",
    "docspark.operators.embedding",
    "docspark.operators.spelling",
    "docspark.operators.correctors",
    "docspark.operators.reports",
    "docspark.operators.content",
    "docspark.plans.flows",
    "docspark.streaming.jobs",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` gives the same rows where SQL can express them."""

    def add(run: Query) -> Query:
        _FOUND[name] = (run, sql)
        return run

    return add


def load() -> dict[str, tuple[Query, str | None]]:
    for module in MODULES:
        importlib.import_module(module)
    return dict(_FOUND)
