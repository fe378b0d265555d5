"""Guarded execution: redaction around a cost gate around a cache around a read with a row cap."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from quillstone.operators.catalog import REDACTED, origins

ROWS, TTL_S, CACHED_ROWS, CACHED_RESULTS, TIMEOUT_S = 1000, 60.0, 10_000, 200, 30.0


@dataclass(frozen=True)
class Result:
    columns: tuple[str, ...] = ()
    rows: tuple[tuple, ...] = ()
    truncated: bool = False
    elapsed_s: float = 0.0
    cache_hit: bool = False
    gated: bool = False
    estimated_bytes: int = 0
    redacted: int = 0
    error: str = ""


Run = Callable[[DataFrame, str], Result]


def read_only(rows: int = ROWS, timeout_s: float = TIMEOUT_S) -> Run:
    """Collects at most `rows` rows and one more to tell whether there are more; stops its jobs after the timeout."""
    import threading

    def run(df: DataFrame, key: str) -> Result:
        spark, began = df.sparkSession, time.monotonic()
        tag = f"read-{hashlib.md5(key.encode()).hexdigest()[:12]}"
        timer = threading.Timer(timeout_s, lambda: spark.interruptTag(tag))
        spark.addTag(tag)
        timer.start()
        try:
            found = [tuple(r) for r in df.limit(rows + 1).collect()]
        except Exception as e:
            return Result(error=str(e).split("\n")[0][:300], elapsed_s=time.monotonic() - began)
        finally:
            timer.cancel()
            spark.removeTag(tag)
        return Result(tuple(df.columns), tuple(found[:rows]), len(found) > rows, time.monotonic() - began)

    return run


@dataclass
class Cache:
    inner: Run
    ttl_s: float = TTL_S
    most_rows: int = CACHED_ROWS
    most_results: int = CACHED_RESULTS
    clock: Callable[[], float] = time.monotonic
    held: dict[str, tuple[float, Result]] = field(default_factory=dict)

    def __call__(self, df: DataFrame, key: str) -> Result:
        key = hashlib.sha256(key.encode()).hexdigest()
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.ttl_s:
            return replace(self.held[key][1], cache_hit=True)
        found = self.inner(df, key)
        self.held = {k: v for k, v in self.held.items() if now - v[0] < self.ttl_s}
        if not found.error and len(found.rows) <= self.most_rows:
            while len(self.held) >= self.most_results:
                self.held.pop(min(self.held, key=lambda k: self.held[k][0]))
            self.held[key] = (now, found)
        return found


def largest_bytes(df: DataFrame) -> int:
    """The largest estimate of any node: the root of an aggregate says nothing about its input."""

    def walk(node) -> int:
        most, it = int(str(node.stats().sizeInBytes())), node.children().iterator()
        while it.hasNext():
            most = max(most, walk(it.next()))
        return most

    return walk(df._jdf.queryExecution().optimizedPlan())


def cost_gate(inner: Run, most_bytes: int | None = None) -> Run:
    """Off without a limit. A query whose cost can't be told is let through."""

    def run(df: DataFrame, key: str) -> Result:
        try:
            cost = largest_bytes(df)
        except Exception:
            return inner(df, key)
        if most_bytes is not None and cost > most_bytes:
            return Result(gated=True, estimated_bytes=cost, error="too costly")
        return replace(inner(df, key), estimated_bytes=cost)

    return run


def redacting(inner: Run, blocked: set[str]) -> Run:
    """Values of columns that come from a blocked column, whatever their names, are replaced."""

    def run(df: DataFrame, key: str) -> Result:
        low = {b.lower() for b in blocked}
        hit = {i for i, (_, base) in enumerate(origins(df).items()) if low & {b.lower() for b in base}}
        found = inner(df, key)
        rows = tuple(tuple(REDACTED if i in hit and v is not None else v for i, v in enumerate(r)) for r in found.rows)
        return replace(found, rows=rows, redacted=sum(v == REDACTED for r in rows for v in r))

    return run


def chain(blocked: set[str] = frozenset(), most_bytes: int | None = None, rows: int = ROWS, clock=time.monotonic) -> Run:
    return redacting(cost_gate(Cache(read_only(rows), clock=clock), most_bytes), set(blocked))


def ask_sql(spark: SparkSession, sql: str, run: Run, args: dict | None = None) -> Result:
    return run(spark.sql(sql, args=args or {}), sql + repr(sorted((args or {}).items())))


def as_markdown(result: Result, most: int = 50) -> str:
    """A table of at most `most` rows; nulls as (null), pipes escaped."""
    cell = lambda v: "(null)" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(result.columns) + " |", "|" + "---|" * len(result.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in result.rows[:most]]
    if len(result.rows) > most or result.truncated:
        lines.append(f"({len(result.rows)} rows{' or more' if result.truncated else ''}; {min(most, len(result.rows))} shown)")
    return "\n".join(lines)
