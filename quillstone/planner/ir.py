"""A query as data: what rewrites work on, and what compiles to a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.planner.graph import join_path
from quillstone.sources.tables import Tables

OPS = {"=", "!=", "<", "<=", ">", ">=", "in", "not in", "like", "is null", "is not null"}
FUNCTIONS = {"count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    values: tuple = ()

    def compiled(self) -> Column:
        c = F.col(self.column)
        v = self.values[0] if self.values else None
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op}")
        if self.op == "in":
            return c.isin(*self.values)
        if self.op == "not in":
            return ~c.isin(*self.values)
        if self.op == "like":
            return F.lower(c).contains(str(v).lower())
        if self.op == "is null":
            return c.isNull()
        if self.op == "is not null":
            return c.isNotNull()
        return {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[self.op]


@dataclass(frozen=True)
class Measure:
    function: str
    column: str
    alias: str

    def compiled(self) -> Column:
        return FUNCTIONS[self.function]("*" if self.column == "*" else self.column).alias(self.alias)


@dataclass(frozen=True)
class QueryIR:
    source: str
    #: Further tables; how they join follows from foreign keys.
    tables: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    filters: tuple[Predicate, ...] = ()
    group: tuple[str, ...] = ()
    measures: tuple[Measure, ...] = ()
    having: tuple[Predicate, ...] = ()
    #: (column, descending)
    order: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False
    #: Set by rewrites that may have changed the question.
    lossy: bool = False
    confidence: float = 1.0

    def but(self, **changes) -> QueryIR:
        return replace(self, **changes)


def compiled(query: QueryIR, tables: Tables) -> DataFrame:
    df, joined = getattr(tables, query.source), {query.source}
    for target in query.tables:
        for edge in join_path(query.source, target):
            new = edge.target if edge.target not in joined else edge.table
            if new in joined:
                continue
            df = df.join(getattr(tables, new), F.col(edge.column) == F.col(edge.target_column))
            joined.add(new)
    for p in query.filters:
        df = df.filter(p.compiled())
    if query.measures:
        aggregates = [m.compiled() for m in query.measures]
        df = df.groupBy(*query.group).agg(*aggregates) if query.group else df.agg(*aggregates)
    elif query.columns:
        df = df.select(*query.columns)
    for p in query.having:
        df = df.filter(p.compiled())
    if query.distinct:
        df = df.distinct()
    if query.order:
        df = df.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in query.order))
    if query.offset:
        df = df.offset(query.offset)
    return df if query.limit is None else df.limit(query.limit)
