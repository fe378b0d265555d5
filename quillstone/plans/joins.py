"""Joins, set operations, subqueries, common table expressions, lookups and multi-part questions."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.plans.shapes import plan

c = F.col

plan(
    "joi_inner",
    lambda t: t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name"),
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
)
plan(
    "joi_left_count",
    lambda t: t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_lines")),
    "SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
)
plan(
    "joi_right",
    lambda t: t.lineitem.filter("l_quantity > 49").join(t.orders, c("o_orderkey") == c("l_orderkey"), "right").select("o_orderkey", "l_linenumber"),
    "SELECT o_orderkey, l_linenumber FROM (SELECT * FROM lineitem WHERE l_quantity > 49) RIGHT JOIN orders ON o_orderkey = l_orderkey",
)
plan(
    "joi_full",
    lambda t: t.documents.select("doc_id", "lang").join(t.labels.select(c("doc_id").alias("label_id"), "quality"), c("doc_id") == c("label_id"), "full"),
    "SELECT d.doc_id, lang, l.doc_id AS label_id, quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
)
# Each row meets one other of its table at most.
plan(
    "joi_self",
    lambda t: t.conversations.alias("a").join(t.conversations.alias("b"), (c("a.conv_id") == c("b.conv_id")) & (c("a.turn") == c("b.turn") + 1)).select(c("a.conv_id").alias("conv_id"), c("a.turn").alias("turn"), c("a.role").alias("role"), c("b.role").alias("role_before")),
    "SELECT a.conv_id, a.turn, a.role, b.role AS role_before FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1",
)
# The shape itself is a Cartesian product; region has five rows.
plan("joi_cross", lambda t: t.region.crossJoin(t.nation.select("n_name")).select("r_name", "n_name"), "SELECT r_name, n_name FROM region CROSS JOIN nation")
plan(
    "joi_anti",
    lambda t: t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id"),
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
plan("joi_semi", lambda t: t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
plan(
    "joi_3hop",
    lambda t: t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n")),
    "SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
)
plan(
    "joi_4hop",
    lambda t: t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    .join(t.customer, c("o_custkey") == c("c_custkey"))
    .join(t.nation, c("c_nationkey") == c("n_nationkey"))
    .join(t.region, c("n_regionkey") == c("r_regionkey"))
    .groupBy("r_name")
    .agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue")),
    "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
plan(
    "joi_latest_per_key",
    lambda t: t.customer.join(t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("last")), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "last.o_orderkey", "last.o_totalprice"),
    "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey",
)
_TIERS = ((1, 0.0, 10.0), (2, 10.0, 25.0), (3, 25.0, None))


def _tiers(t):
    # Three fixed tiers: a broadcast range join.
    tiers = t.spark.createDataFrame(_TIERS, "tier bigint, from_unit double, to_unit double")
    inside = (c("l_quantity") >= c("from_unit")) & (c("to_unit").isNull() | (c("l_quantity") < c("to_unit")))
    return t.lineitem.join(F.broadcast(tiers), inside).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("units"))


plan(
    "joi_range",
    _tiers,
    "SELECT CAST(tier AS BIGINT) AS tier, count(*) AS n, round(sum(l_quantity), 2) AS units FROM lineitem JOIN (VALUES (1, 0.0, 10.0), (2, 10.0, 25.0), (3, 25.0, NULL)) AS v(tier, f, u) ON l_quantity >= f AND (u IS NULL OR l_quantity < u) GROUP BY 1",
)
plan(
    "joi_semi_composite",
    lambda t: t.lineitem.join(t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber")), ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber", "l_quantity"),
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, max(l_linenumber)) FROM lineitem GROUP BY l_orderkey)",
)

# Set operations
_URGENT, _BIG = "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'", "SELECT o_custkey FROM orders WHERE o_totalprice > 450000"


def _urgent(t):
    return t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey")


def _big(t):
    return t.orders.filter("o_totalprice > 450000").select("o_custkey")


plan("set_union", lambda t: _urgent(t).union(_big(t)).distinct(), f"{_URGENT} UNION {_BIG}")
plan("set_union_all", lambda t: _urgent(t).unionByName(_big(t)), f"{_URGENT} UNION ALL {_BIG}")
plan("set_intersect", lambda t: _urgent(t).intersect(_big(t)), f"{_URGENT} INTERSECT {_BIG}")
plan("set_except", lambda t: _urgent(t).subtract(_big(t)), f"{_URGENT} EXCEPT {_BIG}")


# Subqueries and common table expressions, as SQL over the registered tables
def _sql(name: str, *tables: str, spark_sql: str, oracle: str | None = None) -> None:
    def build(t):
        t.register(*tables)
        return t.spark.sql(spark_sql)

    plan(name, build, oracle or spark_sql)


_sql("sub_scalar", "orders", spark_sql="SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS above_mean FROM orders")
_sql("sub_correlated", "orders", "customer", spark_sql="SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest FROM customer")
_sql("sub_in", "orders", "customer", spark_sql="SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
_sql("sub_derived", "orders", spark_sql="SELECT o_orderstatus, max(n) AS most FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey) x GROUP BY o_orderstatus")
_sql("cte_single", "orders", spark_sql="WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus")
_sql(
    "cte_multi",
    "orders",
    "customer",
    spark_sql="WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey, s FROM spent WHERE s > 1000000) SELECT c_name, round(s, 2) AS spent FROM top JOIN customer ON o_custkey = c_custkey",
)
# No table has a parent column; nations form a binary tree by key: the parent of n > 0 is n div 2 (0 and 1 hang on 0).
# Depth is bounded, so a cycle would end too.
_sql(
    "cte_recursive_down",
    "nation",
    spark_sql="WITH RECURSIVE tree(n_nationkey, depth) AS (SELECT CAST(1 AS INT), CAST(0 AS BIGINT) UNION ALL SELECT n.n_nationkey, depth + 1 FROM tree JOIN nation n ON n.n_nationkey >= 2 AND n.n_nationkey DIV 2 = tree.n_nationkey WHERE depth < 10) SELECT n_nationkey, depth FROM tree",
    oracle="WITH RECURSIVE tree(n_nationkey, depth) AS (SELECT CAST(1 AS INT), CAST(0 AS BIGINT) UNION ALL SELECT n.n_nationkey, depth + 1 FROM tree JOIN nation n ON n.n_nationkey >= 2 AND n.n_nationkey // 2 = tree.n_nationkey WHERE depth < 10) SELECT n_nationkey, depth FROM tree",
)
_sql(
    "cte_recursive_up",
    "nation",
    spark_sql="WITH RECURSIVE up(start, node, depth) AS (SELECT n_nationkey, n_nationkey, CAST(0 AS BIGINT) FROM nation UNION ALL SELECT start, CAST(node DIV 2 AS INT), depth + 1 FROM up WHERE node > 1 AND depth < 10) SELECT start, max(depth) AS depth FROM up GROUP BY start",
    oracle="WITH RECURSIVE up(start, node, depth) AS (SELECT n_nationkey, n_nationkey, CAST(0 AS BIGINT) FROM nation UNION ALL SELECT start, CAST(node // 2 AS INT), depth + 1 FROM up WHERE node > 1 AND depth < 10) SELECT start, max(depth) AS depth FROM up GROUP BY start",
)

# Lookups and text predicates
plan("txt_like", lambda t: t.part.filter(F.lower("p_name").contains("a")).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a%'")
plan(
    "txt_multi_column",
    lambda t: t.part.filter(reduce(lambda a, b: a | b, (F.lower(x).contains("br") for x in ("p_name", "p_brand", "p_type")))).select("p_partkey"),
    "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%br%' OR lower(p_brand) LIKE '%br%' OR lower(p_type) LIKE '%br%'",
)
plan("lkp_natural_key", lambda t: t.nation.filter(c("n_nationkey") == 7).select("n_name"), "SELECT n_name FROM nation WHERE n_nationkey = 7")
plan("lkp_surrogate", lambda t: t.orders.filter(c("o_orderkey") == 42).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42")
plan(
    "lkp_composite",
    lambda t: t.conversations.filter((c("conv_id") == 3) & (c("turn") == 1)).select("conv_id", "turn", "role"),
    "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn = 1",
)

# Questions of several parts
PARTS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey"}


def _parallel(t):
    """Independent sub-questions, whose one-row answers are fetched at the same time, each by a job of its own."""

    def ask(name):
        return name, getattr(t, name).count()

    with ThreadPoolExecutor(len(PARTS)) as pool:
        return t.spark.createDataFrame(list(pool.map(ask, PARTS)), "part string, answer bigint")


plan("mul_parallel", _parallel, " UNION ALL ".join(f"SELECT '{n}' AS part, count(*) AS answer FROM {n}" for n in PARTS))
plan(
    "mul_sequential",
    lambda t: t.orders.join(t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select(c("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n")),
    "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) GROUP BY o_custkey",
)
plan(
    "mul_conjunctive",
    lambda t: t.customer.filter("c_mktsegment = 'BUILDING'").join(t.orders.filter("o_orderstatus = 'O'"), c("c_custkey") == c("o_custkey"), "left_semi").join(t.nation.filter("n_regionkey = 1"), c("c_nationkey") == c("n_nationkey"), "left_semi").select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
)
plan(
    "scope_filter",
    lambda t: t.orders.filter((c("o_orderpriority") == "1-URGENT") | (c("o_custkey") == 7)).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_custkey = 7",
)


def latest_per_key(df, keys, order):
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


plan(
    "latest_per_page",
    lambda t: latest_per_key(t.orders.join(t.customer.orderBy("c_custkey").limit(20).select(c("c_custkey").alias("o_custkey")), "o_custkey", "left_semi"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey"),
    "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
