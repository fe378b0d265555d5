"""How a query plan is registered: one line of DataFrame code and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quillstone import registry
from quillstone.sources.tables import Tables


def plan(name: str, build: Callable[[Tables], DataFrame], oracle: str | None = None) -> None:
    registry.query(name, oracle)(lambda spark, sf_dir: build(Tables(spark, sf_dir)))
