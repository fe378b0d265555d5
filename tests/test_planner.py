import pytest

from quillstone.planner import dialect as D
from quillstone.planner import execute as E
from quillstone.planner import guards as G
from quillstone.planner import rewrite as W
from quillstone.planner.graph import closure, join_path
from quillstone.planner.ir import Measure, Predicate, QueryIR, compiled
from quillstone.planner.questions import ask, shape_of
from quillstone.planner.validate import Policy, validate
from quillstone.sources.tables import PRIMARY_KEYS, Tables


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    tables.register()
    return tables


def test_paths():
    assert [k.column for k in join_path("lineitem", "region")] in (["l_orderkey", "o_custkey", "c_nationkey", "n_regionkey"], ["l_suppkey", "s_nationkey", "n_regionkey"])
    assert closure({"orders", "nation"}) == {"orders", "customer", "nation"}
    with pytest.raises(ValueError):
        join_path("orders", "events")


def test_rewrites():
    g = W.Grounding(frozenset({"open", "orders"}), {"o_orderpriority": ("1-URGENT", "2-HIGH")}, frozenset({7}))
    q = QueryIR("orders", filters=(Predicate("o_orderstatus", "=", ("F",)), Predicate("is_active", "=", (1,)), Predicate("is_deleted", "=", (0,)), Predicate("o_custkey", "=", (9,)), Predicate("o_orderdate", ">", ("2000-01-01",)), Predicate("o_orderpriority", "=", ("5-LOW",))))
    assert [(p.column, p.op) for p in W.repaired(q, g).filters] == [("is_deleted", "="), ("o_orderpriority", "in")]
    assert [p.values for p in W.strip_foreign_keys(QueryIR("orders", filters=(Predicate("o_custkey", "=", (7,)),)), g).filters] == [(7,)]
    grain = W.fix_grain(QueryIR("part", group=("p_name",), measures=(Measure("count", "*", "n"),)), g, {"p_name": "p_partkey"})
    assert grain.group == ("p_partkey", "p_name")
    two = QueryIR("orders", filters=(Predicate("x", "=", ("a",)), Predicate("x", "=", ("open",))))
    assert [p.values for p in W.resolve_contradictions(two, g).filters] == [("open",)]
    fixed = W.repair_columns(QueryIR("t", columns=("name", "gone"), filters=(Predicate("name", "=", (1,)),)), {"name_en", "name_ar"}, "ar")
    assert fixed.columns == ("name_ar",) and fixed.lossy and fixed.confidence == 0.5


def test_unresolved_columns(spark, t, tmp_path):
    """Repaired from the analyser's error: a locale's twin, else stripped, else given up."""
    g = W.Grounding(locale="ar")
    spark.createDataFrame([(1, "a", "b")], "r_regionkey int, name_en string, name_ar string").write.parquet(str(tmp_path / "region.parquet"))
    own = Tables(spark, str(tmp_path))
    q, rows = W.resolved(QueryIR("region", columns=("name", "gone"), filters=(Predicate("name", "=", ("b",)),)), own, g)
    assert q.columns == ("name_ar",) and q.lossy and q.confidence == 0.5 and rows.collect()[0].name_ar == "b"
    q, rows = W.resolved(QueryIR("region", columns=("name_en",)), own, g)
    assert not q.lossy and rows.count() == 1
    lost = QueryIR("region", columns=("name_en",), filters=(Predicate("colour", "=", ("red",)),))
    assert "colour" in W.resolved(lost, own, g)
    q, _ = W.resolved(lost, own, W.Grounding(values={"name_en": ("a",)}))
    assert q.lossy and q.filters == ()


def test_asks_back(t):
    unclear = ask("show me the total", t, {})
    assert unclear.query is None and "orders" in unclear.clarify and "customer" in unclear.clarify
    assert "priority" in ask("orders by colour", t, {}).clarify and ask("delete all orders", t, {}).clarify == ""


def test_two_levels_of_access(spark, t):
    policy = Policy(hidden=frozenset({"supp*"}), unqueried=frozenset({"events"}))
    assert not policy.allows("supplier") and policy.allows("events") and not policy.queryable("events") and policy.queryable("orders")
    assert not validate(spark, "SELECT * FROM events", set(PRIMARY_KEYS), policy).ok
    assert validate(spark, "SELECT o_orderkey FROM orders", set(PRIMARY_KEYS), policy).ok


def test_dialect(spark, t):
    sql = D.spark_sql("SELECT TOP 3 [o_orderkey], ISNULL(o_orderstatus, 'LEN(x)') AS s FROM [orders] ORDER BY o_orderkey;")
    assert sql == "SELECT `o_orderkey`, coalesce(o_orderstatus, 'LEN(x)') AS s FROM `orders` ORDER BY o_orderkey LIMIT 3"
    assert spark.sql(sql).count() == 3
    assert D.spark_sql("SELECT a FROM b ORDER BY a OFFSET 5 ROWS FETCH NEXT 2 ROWS ONLY").endswith("LIMIT 2 OFFSET 5")
    inner = D.spark_sql("SELECT count(*) AS n FROM (SELECT TOP (4) o_orderkey FROM orders ORDER BY o_orderkey) x WHERE o_orderkey IN (SELECT TOP 2 o_orderkey FROM orders ORDER BY o_orderkey)")
    assert inner.count("LIMIT") == 2 and spark.sql(inner).first().n == 2
    both = D.spark_sql("SELECT TOP 1 o_orderkey FROM orders UNION ALL SELECT TOP 2 o_orderkey FROM orders")
    assert spark.sql(both).count() == 3
    for bad in ("SELECT TOP 5 PERCENT a FROM b", "SELECT TOP 5 WITH TIES a FROM b", "SELECT DATEDIFF(eon, a, b) FROM c", "SELECT (a FROM b"):
        with pytest.raises(D.Unsupported):
            D.spark_sql(bad)


@pytest.mark.parametrize(
    ("x", "want"),
    [
        ("DATEDIFF(month, CAST('2021-01-31' AS DATE), CAST('2021-02-01' AS DATE))", 1),
        ("DATEDIFF(yy, CAST('2020-12-31' AS DATE), CAST('2021-01-01' AS DATE))", 1),
        ("DATEDIFF(quarter, CAST('2021-03-31' AS DATE), CAST('2021-04-01' AS DATE))", 1),
        ("DATEDIFF(hour, CAST('2021-01-01 00:59:00' AS DATETIME2), CAST('2021-01-01 01:01:00' AS DATETIME))", 1),
        ("DATEDIFF(wk, CAST('2025-01-05' AS DATE), CAST('2025-01-06' AS DATE))", 1),
        ("DATEDIFF(day, CAST('2021-01-01 23:59:00' AS DATETIME), GETDATE())", -7093),
        ("FORMAT(DATEADD(month, DATEDIFF(month, 0, CAST('2021-02-17' AS DATE)), 0), 'yyyy-MM-dd')", "2021-02-01"),
        ("FORMAT(CAST('2021-02-17' AS DATE), 'yyyy-MM') + '/' + CONVERT(NVARCHAR(20), 7)", "2021-02/7"),
        ("CONVERT(VARCHAR(10), CAST('2021-02-17' AS DATE), 103)", "17/02/2021"),
        ("FORMAT(1234.5, 'N2')", "1,234.50"),
        ("IIF(LEN('ab  ') = 2, N'it''s', 'x')", "it's"),
        ("CAST(EOMONTH(DATEFROMPARTS(2021, 2, 3)) AS NVARCHAR(MAX))", "2021-02-28"),
        ("1 + CAST('2' AS INT)", 3),
    ],
)
def test_dialect_values(spark, x, want):
    assert spark.sql(D.spark_sql(f"SELECT {x} AS v", "2001-08-01")).first().v == want


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT count(*) FROM orders",
        "WITH a AS (SELECT * FROM orders), b AS (SELECT * FROM a) SELECT max(o_totalprice) FROM b",
        "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) FROM orders",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r",
        "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    ],
)
def test_accepted(spark, t, sql):
    assert validate(spark, sql, set(PRIMARY_KEYS)).ok


@pytest.mark.parametrize(
    "sql",
    ["DROP TABLE orders", "INSERT INTO orders SELECT * FROM orders", "DELETE FROM orders", "SELECT 1; SELECT 2", "SELECT {{x}}", "CREATE TABLE x AS SELECT 1", "SET spark.x = 1", "SELECT nothing FROM orders", "SELECT * FROM missing", "```sql SELECT 1"],
)
def test_rejected(spark, t, sql):
    assert not validate(spark, sql, set(PRIMARY_KEYS)).ok


def test_policy(spark, t):
    policy = Policy(frozenset({"supplier"}), ("customer.c_acct*",))
    check = lambda sql: validate(spark, sql, set(PRIMARY_KEYS), policy).ok
    assert check("SELECT c_name FROM customer")
    for sql in ("SELECT * FROM customer", "SELECT x FROM (SELECT c_acctbal AS x FROM customer) y", "SELECT c_name FROM customer ORDER BY c_acctbal", "SELECT c_name FROM customer WHERE c_acctbal > 0", "WITH a AS (SELECT c_acctbal + 1 AS z FROM customer) SELECT z FROM a", "SELECT s_name FROM supplier"):
        assert not check(sql), sql


def test_chain(spark, t):
    now = [0.0]
    run = E.chain({"c_name"}, rows=5, clock=lambda: now[0])
    first = E.ask_sql(spark, "SELECT c_custkey, upper(c_name) AS x FROM customer ORDER BY 1", run)
    assert first.truncated and len(first.rows) == 5 and {r[1] for r in first.rows} == {"[REDACTED]"} and first.redacted == 5
    assert E.ask_sql(spark, "SELECT c_custkey, upper(c_name) AS x FROM customer ORDER BY 1", run).cache_hit
    now[0] = 61.0
    assert not E.ask_sql(spark, "SELECT c_custkey, upper(c_name) AS x FROM customer ORDER BY 1", run).cache_hit
    assert E.ask_sql(spark, "SELECT count(*) FROM lineitem", E.chain(most_bytes=10)).gated
    assert E.ask_sql(spark, "SELECT c_custkey FROM customer WHERE c_custkey = :k", run, {"k": 3}).rows == ((3,),)
    assert E.as_markdown(E.Result(("a",), ((None,), ("x|y",)))).splitlines()[2:] == ["| (null) |", "| x\\|y |"]


def test_guards():
    for asked in ("get rid of old orders", "purge the log", "nuke everything", "mark order 7 as paid", "set status = closed", "assign tickets to Ann", "drp all tables", "update order 7 to closed", "أضف عميل", "insert a row"):
        assert G.wants_write(asked), asked
    for asked in ("which orders were updated", "how many created this month", "show settings", "list marked orders", "orders without assigned agents"):
        assert not G.wants_write(asked), asked
    assert G.decomposed("how many orders and how many parts")[0] == "parallel"
    assert G.decomposed("orders and also parts side by side")[0] == "single"
    assert G.wants_write("Delete all orders") and G.wants_write("drop table x") and not G.wants_write("how many deleted orders")
    now = [0.0]
    limiter = G.RateLimiter(2, 60, lambda: now[0])
    assert [limiter.admits("a") for _ in range(3)] == [True, True, False]
    now[0] = 60.0
    assert limiter.admits("a") and limiter.admits("b")
    budget = G.RetryBudget(1)
    assert budget.take() and not budget.take()
    assert G.in_scope(0, 0) and not G.in_scope(0.1, 0.1) and G.in_scope(0.6, 0)
    assert G.decomposed("list customers then count their orders")[0] == "sequential"
    assert G.decomposed("how many orders? how many parts")[0] == "parallel"
    assert G.decomposed("orders by status also per priority")[0] == "single"


def test_votes():
    r = lambda *rows: E.Result(("a",), tuple((x,) for x in rows))
    assert G.vote([r(1), r(2.00001), r(2.0)]) == 1
    assert G.vote([r(1, 2), r(2, 1), r(3)]) == 0
    assert G.vote([r(1), r(2)]) == 0
    assert G.vote([E.Result(error="x"), r(2), r(3, 4)], [False, True, False]) == 2
    assert G.vote([E.Result(error="x")]) is None


def test_compiled_joins(t):
    df = compiled(QueryIR("orders", ("region",), group=("r_name",), measures=(Measure("count", "*", "n"),)), t)
    assert {r.r_name for r in df.collect()} <= {r.r_name for r in t.region.collect()} and sum(r.n for r in df.collect()) == t.orders.count()


@pytest.mark.parametrize(
    ("question", "sql"),
    [
        ("how many orders", "SELECT count(*) FROM orders"),
        ("how many orders by status", "SELECT o_orderstatus, count(*) FROM orders GROUP BY 1"),
        ("how many urgent orders", "SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT'"),
        ("average price of orders per priority", "SELECT o_orderpriority, avg(o_totalprice) FROM orders GROUP BY 1"),
        ("number of orders in 1998", "SELECT count(*) FROM orders WHERE year(o_orderdate) = 1998"),
        ("top 3 customers by balance", "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 3"),
        ("how many orders per region", "SELECT r_regionkey, r_name, count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    ],
)
def test_questions(t, duck, question, sql):
    answer = ask(question, t)
    if "top" in question:
        assert [r.c_custkey for r in answer.data.collect()] == [r[0] for r in duck.sql(sql).fetchall()]
        return
    value = lambda v: round(v, 4) if isinstance(v, float) else v
    assert sorted(tuple(map(value, r)) for r in answer.data.collect()) == sorted(tuple(map(value, r)) for r in duck.sql(sql).fetchall())


@pytest.mark.parametrize("question", ["what is the weather", "delete all orders", "orders by moonphase", "x" * 3000])
def test_abstains(t, question):
    assert ask(question, t, {}).abstained


def test_shapes():
    asked = {"how many tickets do we have": "count", "count of overdue bills": "count", "top 5 customers by total billed amount": "topn", "highest spending customers": "topn", "orders this year vs last": "compare", "orders by month": "timeseries", "average price of parts": "aggregate", "details of customer 7": "lookup", "see ord-123": "lookup", "customers with their orders": "join", "list parts": "filter", "كم عدد الطلبات": "count", "أعلى العملاء": "topn"}
    assert {q: shape_of(q) for q in asked} == asked
