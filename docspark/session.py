"""Configuration from the environment with defaults and checks, and the session built from it."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """Environment variables DOCSPARK_<FIELD> override the defaults."""

    store: str = "parquet"
    embedding_dimension: int = 1536
    batch_size: int = 300
    chunk_size: int = 500
    max_chunk_size: int = 2000
    min_chunk_size: int = 100
    max_file_size: int = 100 << 20
    min_file_size: int = 1024
    similarity_threshold: float = 0.25
    search_limit: int = 100
    max_results: int = 20

    @classmethod
    def from_environment(cls, environment: dict[str, str] | None = None) -> Config:
        given = os.environ if environment is None else environment
        found = {f.name: type(f.default)(given[key]) for f in fields(cls) if (key := f"DOCSPARK_{f.name.upper()}") in given}
        return cls(**found).validated()

    def validated(self) -> Config:
        wrong = [name for name, bad in {
            "store": not self.store, "batch_size": self.batch_size <= 0, "embedding_dimension": self.embedding_dimension <= 0, "file sizes": self.min_file_size >= self.max_file_size,
            "chunk sizes": not self.min_chunk_size <= self.chunk_size <= self.max_chunk_size, "similarity_threshold": not 0 <= self.similarity_threshold <= 1,
        }.items() if bad]
        if wrong:
            raise ValueError(f"invalid configuration: {', '.join(wrong)}")
        return self


def session(name: str = "docspark", **options: str) -> SparkSession:
    """A session with adaptive execution, UTC, Arrow and skew handling on; ``options`` override."""
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    } | options
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
