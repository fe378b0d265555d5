import datetime

from quillstone.planner.execute import Result
from quillstone.planner.grading import Gold, cell, covers, equal, facets, graded
from quillstone.planner.schema import cues, inferred, linked_tables, linked_values, singular, trigram
from quillstone.sources.tables import PRIMARY_KEYS, ForeignKey, Tables


def r(*rows):
    return Result(("x",) * len(rows[0] if rows else ()), tuple(rows))


def test_cells():
    assert [cell(v) for v in (None, 1, 1.00001, "2.50", " Ab ", True, datetime.date(2024, 1, 2))] == ["<null>", "1", "1", "2.5", "ab", "1", "2024-01-02"]


def test_multisets():
    assert equal(r((1, "A"), (2, None)), r((None, 2.0), ("a", 1)))
    assert not equal(r((1,), (1,)), r((1,)))
    assert covers(r((1, "a", 9), (2, "b", 8)), r(("b",), ("a",)))
    assert not covers(r((1, "a")), r(("a", 2)))


def test_axes():
    assert graded(r((5, "x")), Gold(scalar=5.001)) == "pass" and graded(r((5,)), Gold(scalar=6)) == "fail"
    assert graded(None, Gold(scalar=5)) == "abstained" and graded(None, Gold(invalid=True)) == "pass"
    assert graded(r((1,)), Gold()) == "ungraded" and graded(r((1,), (2,)), Gold(least_rows=1, most_rows=2, rows=2)) == "pass"
    assert graded(r((1,)), Gold(result=r((1.0, "label")))) == "pass"


def test_facets():
    sql = "SELECT TOP 5 c, count(*) FROM [Orders] WHERE status = 'Open' GROUP BY c"
    assert facets(sql, "orders", ("count", "group"), 5, (("status", "open"),)) == []
    assert facets(sql, "customer", ("sum",), 6) == ["entity customer", "operation sum", "limit 6"]


def test_roles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    region, customer, orders = (inferred(n, getattr(t, n).schema) for n in ("region", "customer", "orders"))
    assert region.is_lookup and region.label == "r_name" and not customer.is_lookup
    assert not customer.is_person and orders.dates == {"created": "o_orderdate"} and not orders.is_bridge


def test_persons(spark, sf_dir):
    """A table of persons is one that three others point at."""
    keys = tuple(ForeignKey(n, "c", "customer", "c_custkey") for n in ("a", "b", "d"))
    schema = Tables(spark, sf_dir).customer.schema
    assert inferred("customer", schema, keys).is_person and not inferred("customer", schema, keys[:2]).is_person


def test_linking():
    names = set(PRIMARY_KEYS)
    assert linked_tables("which customers placed orders in which nations", names) >= {"customer", "orders", "nation"}
    assert linked_tables("suppliers per region", names) == {"supplier", "nation", "region"}
    assert linked_tables("hello there", names) == set()
    assert singular("categories") == "category" and trigram("abc", "ABC") == 1
    index = {"BUILDING": "c_mktsegment", "1-URGENT": "o_orderpriority", "Open": "status"}
    assert linked_values("building customers with 1-urgent orders", index) == {"BUILDING": "c_mktsegment", "1-URGENT": "o_orderpriority"}
    assert linked_values("machinery to open", index) == {}
    assert linked_values("bulding", index) in ({}, {"BUILDING": "c_mktsegment"})


def test_cues():
    assert cues("highest daily sales not shipped") == {"superlative", "granularity", "negation", "lifecycle"}
