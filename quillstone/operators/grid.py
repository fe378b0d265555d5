"""One paged grid for every table: search, id filters, named quick filters, sort switch, count, page."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 100


@dataclass(frozen=True)
class Grid:
    search: tuple[str, ...]
    key: str
    filters: dict[str, object] = field(default_factory=dict)
    quick: dict[str, str] = field(default_factory=dict)
    #: Name to (column, descending).
    sorts: dict[str, tuple[str, bool]] = field(default_factory=dict)


def page(df: DataFrame, grid: Grid, text: str = "", quick: str | None = None, sort: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    """The rows of one page with total_rows; size is clamped to 1..100, and -1 means all. Pages count from 1."""
    if text:
        df = df.filter(reduce(lambda a, b: a | b, (F.lower(c).contains(text.lower()) for c in grid.search)))
    for column, value in grid.filters.items():
        df = df.filter(F.col(column) == value)
    if quick in grid.quick:
        df = df.filter(grid.quick[quick])
    total = df.agg(F.count("*").alias("total_rows"))  # one row
    column, descending = grid.sorts.get(sort, (grid.key, False))
    df = df.orderBy(F.desc(column) if descending else F.asc(column), grid.key)
    if size != -1:
        size = max(1, min(LARGEST, size))
        df = df.offset((max(1, number) - 1) * size).limit(size)
    return df.crossJoin(F.broadcast(total))
