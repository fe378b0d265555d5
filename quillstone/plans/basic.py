"""Projection, predicates, aggregation, grouping, order and limits."""


from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions.semantics import boundary_diff, contains_fold, ratio
from quillstone.operators.percentiles import continuous_percentiles, top_percent
from quillstone.plans.shapes import plan

c = F.col
BIG = "bigint"


def _flagship(t):
    joined = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(F.broadcast(t.nation), c("c_nationkey") == c("n_nationkey"))
    by_nation = joined.groupBy("n_nationkey", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("n_orders"))
    return by_nation.orderBy(F.desc("revenue"), "n_nationkey").limit(5).select("n_name", "revenue", "n_orders")


# nation has 25 rows by definition of the schema, so its broadcast is bounded.
plan("flagship", _flagship, "SELECT n_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name ORDER BY revenue DESC, n_nationkey LIMIT 5")

# Projection
plan("scan_table", lambda t: t.nation, "SELECT * FROM nation")
plan("scan_documents", lambda t: t.documents.select("doc_id", "source", F.length("text").cast(BIG).alias("chars")), "SELECT doc_id, source, CAST(length(text) AS BIGINT) AS chars FROM documents")
plan("sel_all", lambda t: t.customer, "SELECT * FROM customer")
plan("sel_columns", lambda t: t.customer.select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer")
plan("sel_distinct", lambda t: t.orders.select("o_orderstatus", "o_orderpriority").distinct(), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
plan("sel_computed", lambda t: t.orders.select("o_orderkey", F.year("o_orderdate").cast(BIG).alias("order_year")), "SELECT o_orderkey, year(o_orderdate) AS order_year FROM orders")

# Predicates
_O, _OS = ("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE "
for _name, _predicate, _sql in (
    ("flt_eq", lambda: c("o_orderstatus") == "F", "o_orderstatus = 'F'"),
    ("flt_neq", lambda: c("o_orderstatus") != "F", "o_orderstatus <> 'F'"),
    ("flt_between", lambda: c("o_totalprice").between(1000, 50000), "o_totalprice BETWEEN 1000 AND 50000"),
    ("flt_gt", lambda: boundary_diff("day", F.lit("2000-01-01").cast("timestamp_ntz"), c("o_orderdate")) > 365, "date_diff('day', TIMESTAMP '2000-01-01', o_orderdate) > 365"),
    ("flt_lt", lambda: c("o_totalprice") < 20000, "o_totalprice < 20000"),
    ("flt_in", lambda: c("o_orderpriority").isin("1-URGENT", "2-HIGH"), "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("flt_not_in", lambda: ~c("o_orderpriority").isin("1-URGENT", "2-HIGH"), "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    ("flt_like", lambda: contains_fold(c("o_orderpriority"), "URG"), "lower(o_orderpriority) LIKE '%urg%'"),
    ("flt_starts", lambda: c("o_orderpriority").startswith("1"), "starts_with(o_orderpriority, '1')"),
    ("flt_ends", lambda: c("o_orderpriority").endswith("LOW"), "ends_with(o_orderpriority, 'LOW')"),
    ("flt_and", lambda: (c("o_orderstatus") == "O") & (c("o_totalprice") > 100000), "o_orderstatus = 'O' AND o_totalprice > 100000"),
    ("flt_or", lambda: (c("o_orderstatus") == "P") | (c("o_totalprice") < 5000), "o_orderstatus = 'P' OR o_totalprice < 5000"),
    ("flt_not", lambda: ~((c("o_orderstatus") == "O") | (c("o_orderstatus") == "F")), "NOT (o_orderstatus = 'O' OR o_orderstatus = 'F')"),
):
    plan(_name, lambda t, p=_predicate: t.orders.filter(p()).select(*_O), _OS + _sql)

_BARE = "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber IS "


def _orders_lines(t):
    return t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", "l_linenumber")


plan("flt_null", lambda t: _orders_lines(t).filter(c("l_linenumber").isNull()), _BARE + "NULL")
plan("flt_not_null", lambda t: _orders_lines(t).filter(c("l_linenumber").isNotNull()), _BARE + "NOT NULL")
plan(
    "flt_exists",
    lambda t: t.orders.join(t.lineitem.filter("l_returnflag = 'R'"), c("o_orderkey") == c("l_orderkey"), "left_semi").select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
)
plan(
    "flt_not_exists",
    lambda t: t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey"), "left_anti").select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)

# Aggregation
for _name, _agg, _sql in (
    ("agg_count", lambda: F.count("*").alias("n"), "count(*) AS n"),
    ("agg_count_filter", lambda: F.count_if(c("o_orderstatus") == "F").alias("n"), "count(*) FILTER (o_orderstatus = 'F') AS n"),
    ("agg_count_distinct", lambda: F.count_distinct("o_custkey").alias("n"), "count(DISTINCT o_custkey) AS n"),
    ("agg_sum", lambda: F.round(F.sum("o_totalprice"), 2).alias("total"), "round(sum(o_totalprice), 2) AS total"),
    ("agg_avg", lambda: F.round(F.avg("o_totalprice"), 4).alias("mean"), "round(avg(o_totalprice), 4) AS mean"),
    ("agg_min", lambda: F.min("o_totalprice").alias("least"), "min(o_totalprice) AS least"),
    ("agg_max", lambda: F.max("o_totalprice").alias("most"), "max(o_totalprice) AS most"),
    ("agg_stddev", lambda: F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"), "round(stddev_samp(o_totalprice), 4) AS sd"),
    ("agg_percentage", lambda: ratio(F.count_if(c("o_orderstatus") == "F"), F.count("*")).alias("percent"), "round(100.0 * count(*) FILTER (o_orderstatus = 'F') / nullif(count(*), 0), 4) AS percent"),
):
    plan(_name, lambda t, a=_agg: t.orders.agg(a()), f"SELECT {_sql} FROM orders")
for _name, _alias, _share in (("agg_median", "median", 0.5), ("agg_p95", "p95", 0.95)):
    plan(
        _name,
        lambda t, a=_alias, p=_share: continuous_percentiles(t.orders, [], "o_totalprice", {a: p}).withColumn(a, F.round(a, 4)),
        f"SELECT round(quantile_cont(o_totalprice, {_share}), 4) AS {_alias} FROM orders",
    )
plan(
    "agg_string_agg",
    lambda t: t.nation.groupBy("n_regionkey").agg(F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)").alias("nations")),
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey",
)
plan(
    "agg_conditional",
    lambda t: t.orders.groupBy("o_orderpriority").agg(*(F.sum(F.when(c("o_orderstatus") == s, 1).otherwise(0)).alias(f"n_{s.lower()}") for s in "FOP")),
    "SELECT o_orderpriority, " + ", ".join(f"CAST(sum(CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{s.lower()}" for s in "FOP") + " FROM orders GROUP BY o_orderpriority",
)
plan(
    "agg_avg_of_counts",
    lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 4).alias("mean_orders")),
    "SELECT round(avg(n), 4) AS mean_orders FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)",
)
_AGES = (("d30", 0, 30), ("d90", 31, 90), ("d365", 91, 365), ("older", 366, 100000))
plan(
    "agg_age_buckets",
    lambda t: t.orders.select(boundary_diff("day", c("o_orderdate"), F.lit("2001-08-01").cast("timestamp_ntz")).alias("age")).agg(*(F.count_if(c("age").between(a, b)).alias(n) for n, a, b in _AGES)),
    "SELECT " + ", ".join(f"count(*) FILTER (age BETWEEN {a} AND {b}) AS {n}" for n, a, b in _AGES) + " FROM (SELECT date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') AS age FROM orders)",
)



def _sum():
    return F.round(F.sum("o_totalprice"), 2).alias("total")


# Grouping
_SQL = "round(sum(o_totalprice), 2) AS total"
plan("grp_single", lambda t: t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), _sum()), f"SELECT o_orderstatus, count(*) AS n, {_SQL} FROM orders GROUP BY o_orderstatus")
plan("grp_multi", lambda t: t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(_sum()), f"SELECT o_orderstatus, o_orderpriority, {_SQL} FROM orders GROUP BY ALL")
plan("grp_having", lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 15"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
for _name, _how, _sql in (("grp_rollup", "rollup", "ROLLUP (o_orderstatus, o_orderpriority)"), ("grp_cube", "cube", "CUBE (o_orderstatus, o_orderpriority)")):
    plan(
        _name,
        lambda t, how=_how: getattr(t.orders, how)("o_orderstatus", "o_orderpriority").agg(_sum(), F.grouping("o_orderstatus").cast(BIG).alias("g")),
        f"SELECT o_orderstatus, o_orderpriority, {_SQL}, CAST(grouping(o_orderstatus) AS BIGINT) AS g FROM orders GROUP BY {_sql}",
    )
plan(
    "grp_grouping_sets",
    lambda t: t.orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(_sum()),
    f"SELECT o_orderstatus, o_orderpriority, {_SQL} FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
)
plan(
    "grp_pivot",
    lambda t: t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0),
    "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY o_orderpriority",
)

# Order and limits
plan("ord_asc", lambda t: t.customer.orderBy("c_acctbal", "c_custkey").select("c_custkey", "c_acctbal"), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
plan("ord_desc", lambda t: t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_acctbal"), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
plan("ord_multi", lambda t: t.customer.orderBy("c_mktsegment", F.desc("c_acctbal")).select("c_custkey", "c_mktsegment", "c_acctbal"), "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC")
plan("ord_computed", lambda t: t.orders.orderBy(F.month("o_orderdate"), "o_orderkey").select("o_orderkey", F.month("o_orderdate").cast(BIG).alias("m")), "SELECT o_orderkey, month(o_orderdate) AS m FROM orders ORDER BY m, o_orderkey")
plan("lim_top", lambda t: t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select(*_O), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
plan("lim_bottom", lambda t: t.orders.orderBy("o_totalprice", "o_orderkey").limit(10).select(*_O), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
plan("lim_offset", lambda t: t.orders.orderBy("o_orderkey").offset(20).limit(10).select(*_O), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")


plan(
    "lim_percent",
    lambda t: top_percent(t.orders, 5, "o_totalprice", "o_orderkey").select(*_O),
    "SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= ceil(count(*) OVER () * 5 / 100)",
)


def _rank():
    return F.when(c("o_orderpriority") == "1-URGENT", 0).when(c("o_orderpriority") == "2-HIGH", 1).otherwise(2)


plan(
    "ord_custom_rank",
    lambda t: t.orders.join(t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped")), c("o_orderkey") == c("l_orderkey"), "left").orderBy(_rank(), c("shipped").asc_nulls_last(), "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority", "shipped"),
    "SELECT o_orderkey, o_orderpriority, shipped FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, shipped NULLS LAST, o_orderkey LIMIT 25",
)


def _first():
    return Window.partitionBy("g", F.lower("name")).orderBy("id")



plan(
    "grp_distinct_top",
    lambda t: t.part.select(c("p_brand").alias("g"), c("p_name").alias("name"), c("p_partkey").alias("id")).withColumn("d", F.row_number().over(_first())).filter("d = 1").withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("id"))).filter("r <= 6").select("g", "name", "id"),
    "SELECT g, name, id FROM (SELECT p_brand AS g, p_name AS name, p_partkey AS id FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) = 1) QUALIFY row_number() OVER (PARTITION BY g ORDER BY id) <= 6",
)
plan(
    "dup_detect",
    lambda t: t.part.groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1"),
    "SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
)
