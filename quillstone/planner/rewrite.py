"""Repairs of a query against what the question grounds, in an order that matters. Each returns a new query."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from quillstone.planner.ir import Measure, Predicate, QueryIR, compiled
from quillstone.sources.tables import FOREIGN_KEYS, PRIMARY_KEYS


@dataclass(frozen=True)
class Grounding:
    """What a question says: words, values by column, ids, whether it speaks of time."""

    words: frozenset[str] = frozenset()
    values: dict[str, tuple] = field(default_factory=dict)
    ids: frozenset[int] = frozenset()
    temporal: bool = False
    locale: str = "en"

    def grounds(self, column: str, value) -> bool:
        return any(str(v).lower() == str(value).lower() for v in self.values.get(column, ())) or str(value).lower() in self.words


def _keep(query: QueryIR, test) -> QueryIR:
    return query.but(filters=tuple(p for p in query.filters if test(p)))


def strip_status(q: QueryIR, g: Grounding) -> QueryIR:
    """Status or state filters that the question did not ask for."""
    bad = lambda p: re.search(r"(status|state)$", p.column, re.I) and p.op in ("=", "!=") and not g.grounds(p.column, p.values[0])
    return _keep(q, lambda p: not bad(p))


def strip_flags(q: QueryIR, g: Grounding) -> QueryIR:
    """is_x = 0 or 1 where x is no word of the question; soft-delete flags stay."""

    def asked(p: Predicate) -> bool:
        m = re.fullmatch(r"(?:\w_)?is_?(\w+)", p.column, re.I)
        if not m or p.op != "=" or p.values[0] not in (0, 1, True, False) or "delete" in p.column.lower():
            return True
        return m[1].lower() in g.words

    return _keep(q, asked)


def strip_foreign_keys(q: QueryIR, g: Grounding) -> QueryIR:
    """Integer equality on a foreign key whose id is not in the question; never on primary keys."""
    foreign = {k.column for k in FOREIGN_KEYS} - {c for cs in PRIMARY_KEYS.values() if len(cs) == 1 for c in cs}
    return _keep(q, lambda p: not (p.column in foreign and p.op == "=" and isinstance(p.values[0], int) and p.values[0] not in g.ids and not g.grounds(p.column, p.values[0])))


def strip_clock(q: QueryIR, g: Grounding) -> QueryIR:
    """Date filters where a value was grounded but nothing temporal."""
    if g.temporal or not g.values:
        return q
    return _keep(q, lambda p: not re.search(r"(date|_at|ts)$", p.column, re.I))


def inject_values(q: QueryIR, g: Grounding) -> QueryIR:
    """Grounded values that the query lacks; they replace filters on the same column that conflict. Two or more become IN."""
    if q.group:
        return q
    for column, values in g.values.items():
        rest = tuple(p for p in q.filters if p.column != column)
        p = Predicate(column, "=", values) if len(values) == 1 else Predicate(column, "in", tuple(values))
        q = q.but(filters=(*rest, p))
    return q


def fix_grain(q: QueryIR, g: Grounding, labels: dict[str, str]) -> QueryIR:
    """A label as the only key of an aggregate is preceded by its table's primary key: labels repeat."""
    if len(q.group) == 1 and q.measures and q.group[0] in labels:
        return q.but(group=(labels[q.group[0]], *q.group))
    return q


def resolve_contradictions(q: QueryIR, g: Grounding) -> QueryIR:
    """Two different equalities on a column: the grounded one stays, else the first."""
    chosen: dict[str, Predicate] = {}
    for p in q.filters:
        if p.op == "=" and (p.column not in chosen or (g.grounds(p.column, p.values[0]) and not g.grounds(p.column, chosen[p.column].values[0]))):
            chosen[p.column] = p
    return _keep(q, lambda p: p.op != "=" or chosen[p.column] is p)


def twin(column: str, known: set[str], locale: str = "en") -> str | None:
    """The locale's twin of a column that does not exist: name to name_en or name_ar, and back."""
    stem = re.sub(r"_?(en|ar)$", "", column, flags=re.I)
    for suffix in (locale, "en", "ar"):
        for form in (f"{stem}_{suffix}", f"{stem}{suffix.title()}"):
            if form in known:
                return form
    return stem if stem in known else None


def repair_columns(q: QueryIR, known: set[str], locale: str = "en") -> QueryIR:
    """Unknown columns become their twins; those without one are dropped, which is lossy."""
    lossy = q.lossy

    def fix(column: str) -> str | None:
        nonlocal lossy
        if column == "*" or column in known:
            return column
        found = twin(column, known, locale)
        lossy = lossy or found is None
        return found

    filters = tuple(Predicate(c, p.op, p.values) for p in q.filters if (c := fix(p.column)))
    measures = tuple(Measure(m.function, c, m.alias) for m in q.measures if (c := fix(m.column)))
    made = {m.alias for m in measures}
    q = q.but(filters=filters, measures=measures, columns=tuple(c for x in q.columns if (c := fix(x))), group=tuple(c for x in q.group if (c := fix(x))), order=tuple((c, d) for x, d in q.order if (c := x if x in made else fix(x))))
    return q.but(lossy=lossy, confidence=min(q.confidence, 0.5) if lossy else q.confidence)


def resolved(q: QueryIR, tables, g: Grounding, most: int = 8) -> tuple[QueryIR, DataFrame] | str:
    """The query with the columns that the analyser can't resolve repaired, and its rows; or why there is none. Each error names
    a column and those it might have been: its twin among all known ones takes its place, else it is stripped. If a filter
    that held a literal goes and the question grounds nothing, the answer would be to another question, so there is none."""
    known = {c for name in (q.source, *q.tables) for c in getattr(tables, name).columns}
    for _ in range(most):
        try:
            return q, compiled(q, tables)
        except AnalysisException as e:
            if not (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                return f"it can't be resolved: {e.getCondition()}"
            said = e.getMessageParameters()
        bad = said["objectName"].split(".")[-1].strip("`")
        likely = {x.strip().split(".")[-1].strip("`") for x in said.get("proposal", "").split(",")} - {""}
        found = twin(bad, likely, g.locale) or twin(bad, known, g.locale)
        if found == bad:
            found = None
        dropped = [p for p in q.filters if p.column == bad]
        rename = lambda c: found if c == bad else c  # noqa: B023, E731
        keep = lambda c: found is not None or c != bad  # noqa: B023, E731
        if found is None and dropped and not g.values and not g.ids:
            return f"there is no column {bad} to compare with {dropped[0].values[0]!r}"
        q = q.but(
            filters=tuple(Predicate(rename(p.column), p.op, p.values) for p in q.filters if keep(p.column)),
            measures=tuple(Measure(m.function, rename(m.column), m.alias) for m in q.measures if keep(m.column)),
            columns=tuple(rename(c) for c in q.columns if keep(c)),
            group=tuple(rename(c) for c in q.group if keep(c)),
            order=tuple((rename(c), d) for c, d in q.order if keep(c)),
        )
        if found is None:
            q = q.but(lossy=True, confidence=min(q.confidence, 0.5))
    return "too many columns are unknown"


def repaired(q: QueryIR, g: Grounding, labels: dict[str, str] | None = None) -> QueryIR:
    for rule in (strip_status, strip_flags, strip_foreign_keys, strip_clock, inject_values):
        q = rule(q, g)
    return resolve_contradictions(fix_grain(q, g, labels or {}), g)
