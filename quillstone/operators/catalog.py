"""The catalogue as rows: tables, columns, relationships, value probes, schema differences, redaction by lineage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.sources.tables import FOREIGN_KEYS, Tables

LOOKUP_ROWS, ENUM_VALUES = 500, 12
REDACTED = "[REDACTED]"
#: Columns whose names hint at keys, free text or personal data are no enumerations.
SKIPPED_HINTS = ("name", "key", "id", "text", "url", "html", "comment", "props")


def _rows(t: Tables, rows: list, schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


def tables(t: Tables, like: str = "", hidden: frozenset[str] = frozenset()) -> DataFrame:
    """The tables that the folder holds, listed through Hadoop's file system, so in any store that Spark reads."""
    names = sorted(n for n in t.names() if like.lower() in n and n not in hidden)
    return _rows(t, [(n,) for n in names], "table_name string")


def columns(t: Tables, table: str, sensitive: frozenset[str] = frozenset()) -> DataFrame:
    fields = [(f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(getattr(t, table).schema, 1) if f.name not in sensitive]
    return _rows(t, fields, "column_name string, data_type string, nullable boolean, ordinal bigint")


def column_type(t: Tables, table: str, column: str, sensitive: frozenset[str] = frozenset()) -> DataFrame:
    return columns(t, table, sensitive).filter(F.col("column_name") == column).select("column_name", "data_type")


def relationships(t: Tables, one: str, other: str) -> DataFrame:
    found = [(k.table, k.column, k.target, k.target_column) for k in FOREIGN_KEYS if {k.table, k.target} == {one, other}]
    return _rows(t, found, "from_table string, from_column string, to_table string, to_column string")


def schema_diff(t: Tables, known: dict[str, list[str]], names: list[str]) -> DataFrame:
    """Columns added to or removed from what was known."""
    now = {(n, c) for n in names for c in getattr(t, n).columns}
    then = {(n, c) for n, cs in known.items() for c in cs}
    rows = [("added", *x) for x in sorted(now - then)] + [("removed", *x) for x in sorted(then - now)]
    return _rows(t, rows, "change string, table_name string, column_name string")


_CTE = re.compile(r"(?:\bwith\b(?:\s+recursive)?|,)\s*(\w+)\s*(?:\([^()]*\)\s*)?as\s*\(", re.I)
_SOURCE = re.compile(r"\b(?:from|join)\s+(?:\w+\.)?[`\[\"]?(\w+)[`\]\"]?(?:\s+(?:as\s+)?(?!on\b|where\b|join\b|left\b|right\b|inner\b|full\b|cross\b|group\b|order\b|having\b|limit\b|union\b|using\b)(\w+))?", re.I)
_QUALIFIED = re.compile(r"\b(\w+)\.[`\[\"]?(\w+)")


def drift(t: Tables, stored: dict[str, str]) -> DataFrame:
    """stored: id to SQL. Tables after FROM or JOIN, and qualified columns of tables that exist, which are not there (any more).
    Names of common table expressions are none; unqualified columns can't be told."""
    known, found = {}, set()

    def live(name: str) -> set[str] | None:
        if name not in known:
            known[name] = {c.lower() for c in getattr(t, name).columns} if name in t.names() else None
        return known[name]

    for key, sql in stored.items():
        text = re.sub(r"'(?:[^']|'')*'", "''", sql)
        own = {m.lower() for m in _CTE.findall(text)}
        alias = {}
        for table, short in _SOURCE.findall(text):
            table = table.lower()
            if table in own:
                continue
            if live(table) is None:
                found.add((key, table, None))
            alias |= {table: table} | ({short.lower(): table} if short else {})
        for short, column in _QUALIFIED.findall(text):
            table = alias.get(short.lower())
            if table and live(table) is not None and column.lower() not in live(table):
                found.add((key, table, column.lower()))
    return _rows(t, sorted(found, key=str), "query string, table_name string, column_name string")


def sample_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.select(F.col(column).alias("value")).dropna().distinct().orderBy("value").limit(n)


def lookup_values(df: DataFrame, column: str, most: int = LOOKUP_ROWS) -> DataFrame:
    """All values of a small table's label; none if the table is larger."""
    if df.limit(most + 1).count() > most:
        return df.select(F.col(column).alias("value")).limit(0)
    return df.select(F.col(column).alias("value")).filter(F.length("value") >= 2).distinct()


def inline_enums(df: DataFrame, most: int = ENUM_VALUES) -> DataFrame:
    """(column, value) of text columns with few values: one pass of sketches, then the exact values of those that pass."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and not any(f.name.lower().endswith(h) for h in SKIPPED_HINTS)]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    sketch = df.agg(*(F.approx_count_distinct(n).alias(n) for n in names)).first()
    likely = [n for n in names if sketch[n] <= 2 * most]
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(n).alias("value")) for n in likely))).alias("p")) if likely else None
    if pairs is None:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    values = pairs.select("p.*").dropna().distinct()
    few = values.groupBy("column_name").agg(F.count("*").alias("n")).filter(F.col("n").between(1, most))
    return values.join(few.select("column_name"), "column_name", "left_semi")


def origins(df: DataFrame) -> dict[str, set[str]]:
    """Each output column's base columns, from the analysed plan, so that renaming hides nothing."""
    plan = df._jdf.queryExecution().optimizedPlan()
    known: dict[str, set[str]] = {}

    def refs(expression) -> set[str]:
        found, it = set(), expression.references().iterator()
        while it.hasNext():
            a = it.next()
            found |= known.get(a.exprId().toString(), {a.name()})
        return found

    def walk(node) -> None:
        children = node.children().iterator()
        while children.hasNext():
            walk(children.next())
        expressions = node.expressions().iterator()
        while expressions.hasNext():
            e = expressions.next()
            if e.getClass().getSimpleName() == "Alias":
                known[e.exprId().toString()] = refs(e.child())

    walk(plan)
    out, it = {}, plan.output().iterator()
    for name in df.columns:
        a = it.next()
        out[name] = known.get(a.exprId().toString(), {a.name()})
    return out


def redacted(df: DataFrame, blocked: set[str]) -> DataFrame:
    """Columns that come from a blocked column hold a fixed text."""
    low = {b.lower() for b in blocked}
    hit = {name for name, base in origins(df).items() if low & {b.lower() for b in base}}
    return df.select(*((F.lit(REDACTED).alias(n) if n in hit else F.col(n)) for n in df.columns))
