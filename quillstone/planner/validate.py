"""Read-only SQL under a policy, decided on plans: an allow list of node classes, tables that exist, columns by lineage."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import SparkSession

#: Logical plan nodes that only read. Everything else, known or not, is refused.
READING = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Limit Offset Distinct Deduplicate Join Union Intersect Except SubqueryAlias CTERelationDef CTERelationRef WithCTE UnresolvedWith UnresolvedRelation UnresolvedHaving UnresolvedInlineTable "
    "LogicalRelation LocalRelation OneRowRelation Window WithWindowDefinition Expand Generate Pivot Unpivot GroupingSets View Tail Sample UnionLoop UnionLoopRef Range LateralJoin ResolvedInlineTable UnresolvedSubqueryColumnAliases PlanWithUnresolvedIdentifier UnresolvedTableValuedFunction UnresolvedTVFAliases RebalancePartitions".split()
)
_LEAK = re.compile(r"\{\{|\}\}|<\w+>|```|^\s*[\[{]")


def _like(name: str, patterns) -> bool:
    return any(fnmatch.fnmatch(name.lower(), p.lower()) for p in patterns)


@dataclass(frozen=True)
class Policy:
    """Two levels: a table of `hidden` does not exist for anyone; one of `unqueried` may be listed and described, but not read
    by queries. Names or patterns with * and ?. blocked: patterns of columns (table.column) that must not be read."""

    hidden: frozenset[str] = frozenset()
    blocked: tuple[str, ...] = ()
    unqueried: frozenset[str] = frozenset()

    def allows(self, table: str) -> bool:
        return bool(table.strip()) and not _like(table, self.hidden)

    def queryable(self, table: str) -> bool:
        return self.allows(table) and not _like(table, self.unqueried)

    def blocks(self, table: str, column: str) -> bool:
        return _like(f"{table}.{column}", self.blocked)


@dataclass(frozen=True)
class Verdict:
    ok: bool
    reason: str = ""


def _nodes(plan):
    """The plan's nodes, subqueries and common table expressions included."""
    yield plan
    for group in (plan.children(), plan.innerChildren()):
        it = group.iterator()
        while it.hasNext():
            child = it.next()
            if hasattr(child, "innerChildren") and child.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans.logical") or "Relation" in child.getClass().getSimpleName() or "analysis.Unresolved" in child.getClass().getName():
                yield from _nodes(child)
    it = plan.expressions().iterator()
    while it.hasNext():
        yield from _subplans(it.next())


def _subplans(expression):
    if "SubqueryExpression" in {c.getSimpleName() for c in _supers(expression.getClass())}:
        yield from _nodes(expression.plan())
    it = expression.children().iterator()
    while it.hasNext():
        yield from _subplans(it.next())


def _supers(cls):
    while cls is not None:
        yield cls
        cls = cls.getSuperclass()


def validate(spark: SparkSession, sql: str, tables: set[str], policy: Policy = Policy()) -> Verdict:  # noqa: B008
    if _LEAK.search(sql):
        return Verdict(False, "it holds a placeholder or JSON")
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        return Verdict(False, f"it does not parse: {e.getCondition()}")
    except Exception as e:  # the parser's errors reach Python as they are
        return Verdict(False, f"it does not parse: {str(e)[:120]}")
    for node in _nodes(parsed):
        name = node.getClass().getSimpleName()
        if name not in READING:
            return Verdict(False, f"{name} is not allowed")
    try:
        analysed = spark.sql(sql)._jdf.queryExecution().analyzed()
    except AnalysisException as e:
        return Verdict(False, f"it can't be resolved: {e.getCondition()}")
    read = {}
    for node in _nodes(analysed):
        name = node.getClass().getSimpleName()
        if name == "SubqueryAlias" and node.identifier().name() in tables:
            it = node.output().iterator()
            while it.hasNext():
                a = it.next()
                read[a.exprId().toString()] = (node.identifier().name(), a.name())
    used = {t for t, _ in read.values()}
    for t in used:
        if not policy.queryable(t):
            return Verdict(False, f"table {t} is not allowed")
    for node in _nodes(analysed):
        if node.getClass().getSimpleName() in ("SubqueryAlias", "View", "LogicalRelation"):
            continue
        it = node.expressions().iterator()
        while it.hasNext():
            refs = it.next().references().iterator()
            while refs.hasNext():
                found = read.get(refs.next().exprId().toString())
                if found and policy.blocks(*found):
                    return Verdict(False, f"column {found[0]}.{found[1]} is not allowed")
    return Verdict(True)
