"""Grading of answers against gold: multisets with column-subset tolerance, axes, facets."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from quillstone.planner.execute import Result


def cell(v) -> str:
    """Numbers to four digits, dates in ISO form, text trimmed and lower-cased, null a token of its own."""
    if v is None:
        return "<null>"
    if isinstance(v, bool):
        return str(int(v))
    text = v.isoformat() if hasattr(v, "isoformat") else str(v).strip().lower()
    try:
        number = float(text)
    except ValueError:
        return text
    return text if math.isnan(number) or math.isinf(number) else f"{round(number, 4) + 0.0:g}"


def bag(row) -> tuple[str, ...]:
    return tuple(sorted(map(cell, row)))


def equal(a: Result, b: Result) -> bool:
    """The same rows as often, whatever the order and names of rows and columns."""
    return Counter(map(bag, a.rows)) == Counter(map(bag, b.rows))


def covers(wide: Result, narrow: Result) -> bool:
    """Each row of `narrow` pairs with a row of `wide` of its own that holds its cells, and no row of `wide` is left."""
    if len(wide.rows) != len(narrow.rows):
        return False
    left = [Counter(map(cell, r)) for r in wide.rows]
    for row in sorted((Counter(map(cell, r)) for r in narrow.rows), key=lambda c: -sum(c.values())):
        at = next((i for i, c in enumerate(left) if row <= c), None)
        if at is None:
            return False
        left.pop(at)
    return True


def matches(answer: Result, gold: Result) -> bool:
    return equal(answer, gold) or covers(answer, gold) or covers(gold, answer)


@dataclass(frozen=True)
class Gold:
    scalar: float | None = None
    rows: int | None = None
    least_rows: int | None = None
    most_rows: int | None = None
    result: Result | None = None
    invalid: bool = False


def graded(answer: Result | None, gold: Gold, relative: float = 0.001) -> str:
    """'pass', 'fail', 'abstained' or 'ungraded'. An abstention passes only where a refusal is expected."""
    if gold.invalid:
        return "pass" if answer is None or answer.error else "fail"
    if answer is None or answer.error:
        return "abstained"
    checks = []
    if gold.scalar is not None:
        numbers = [float(v) for v in (answer.rows[0] if answer.rows else ()) if isinstance(v, (int, float))]
        checks.append(any(math.isclose(v, gold.scalar, rel_tol=relative, abs_tol=1e-9) for v in numbers))
    if gold.rows is not None:
        checks.append(len(answer.rows) == gold.rows)
    if gold.least_rows is not None:
        checks.append(len(answer.rows) >= gold.least_rows)
    if gold.most_rows is not None:
        checks.append(len(answer.rows) <= gold.most_rows)
    if gold.result is not None:
        checks.append(matches(answer, gold.result))
    if not checks:
        return "ungraded"
    return "pass" if all(checks) else "fail"


#: What SQL says for an operation.
OPERATIONS = {"count": r"\bcount\s*\(", "sum": r"\bsum\s*\(", "avg": r"\bavg\s*\(", "min": r"\bmin\s*\(", "max": r"\bmax\s*\(", "group": r"\bgroup\s+by\b", "having": r"\bhaving\b", "order": r"\border\s+by\b", "top": r"\b(?:limit|top)\b", "distinct": r"\bdistinct\b", "join": r"\bjoin\b", "union": r"\bunion\b", "window": r"\bover\s*\(", "exists": r"\bexists\b|\bin\s*\(\s*select\b", "recursive": r"\brecursive\b", "case": r"\bcase\b"}


def facets(sql: str, entity: str | None = None, operations: tuple[str, ...] = (), limit: int | None = None, filters: tuple[tuple[str, str], ...] = ()) -> list[str]:
    """What the SQL lacks of what was expected."""
    missing = []
    if entity and not re.search(rf"\b(?:from|join)\s+[`\"\[]?{re.escape(entity)}\b", sql, re.I):
        missing.append(f"entity {entity}")
    missing += [f"operation {o}" for o in operations if not re.search(OPERATIONS[o], sql, re.I)]
    if limit is not None and not re.search(rf"\b(?:limit|top)\s*\(?\s*{limit}\b", sql, re.I):
        missing.append(f"limit {limit}")
    missing += [f"filter {c}" for c, v in filters if not (re.search(rf"\b{re.escape(c)}\b", sql, re.I) and v.lower() in sql.lower())]
    return missing
