"""Window functions and temporal shapes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions.semantics import AS_OF_ORDERS, boundary_diff, bucket, half_open
from quillstone.operators.percentiles import continuous_percentiles, nearest_ranks
from quillstone.plans.shapes import plan

c = F.col
BIG = "bigint"
_BY = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def _by():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


def _to_date():
    return _by().rowsBetween(Window.unboundedPreceding, 0)


def _priced():
    return Window.partitionBy("o_orderpriority").orderBy("o_custkey")


for _name, _value, _sql in (
    ("win_row_number", lambda: F.row_number().over(_by()).cast(BIG), f"row_number() OVER ({_BY})"),
    ("win_rank", lambda: F.rank().over(_priced()).cast(BIG), "rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey)"),
    ("win_dense_rank", lambda: F.dense_rank().over(_priced()).cast(BIG), "dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey)"),
    ("win_lag", lambda: F.lag("o_totalprice").over(_by()), f"lag(o_totalprice) OVER ({_BY})"),
    ("win_lead", lambda: F.lead("o_totalprice").over(_by()), f"lead(o_totalprice) OVER ({_BY})"),
    ("win_running_total", lambda: F.round(F.sum("o_totalprice").over(_to_date()), 2), f"round(sum(o_totalprice) OVER ({_BY} ROWS UNBOUNDED PRECEDING), 2)"),
    ("win_moving_avg", lambda: F.round(F.avg("o_totalprice").over(_by().rowsBetween(-6, 0)), 4), f"round(avg(o_totalprice) OVER ({_BY} ROWS 6 PRECEDING), 4)"),
    ("win_ntile", lambda: F.ntile(4).over(_by()).cast(BIG), f"ntile(4) OVER ({_BY})"),
):
    plan(_name, lambda t, v=_value: t.orders.select("o_orderkey", v().alias("v")), f"SELECT o_orderkey, {_sql} AS v FROM orders")
plan(
    "win_topk_per_group",
    lambda t: t.orders.groupBy("o_orderpriority", "o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("s"), "o_custkey"))).filter("r <= 3").select("o_orderpriority", "o_custkey", "s"),
    "SELECT o_orderpriority, o_custkey, s FROM (SELECT o_orderpriority, o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY s DESC, o_custkey) <= 3",
)
plan(
    "win_percentile",
    lambda t: continuous_percentiles(t.orders, ["o_orderpriority"], "o_totalprice", {"p90": 0.9}).withColumn("p90", F.round("p90", 4)),
    "SELECT DISTINCT o_orderpriority, round(quantile_cont(o_totalprice, 0.9) OVER (PARTITION BY o_orderpriority), 4) AS p90 FROM orders",
)

# Absolute and relative periods: half-open ranges that reach the scan as pushed filters.
_D = "o_orderdate"
for _name, _from, _to in (
    ("tim_day", "1998-03-02", "1998-03-03"),
    ("tim_range", "1998-01-15", "1998-02-16"),
    ("tim_month", "1999-05-01", "1999-06-01"),
    ("tim_quarter", "1999-04-01", "1999-07-01"),
    ("tim_year", "1997-01-01", "1998-01-01"),
    ("tim_since", "2001-01-01", "9999-01-01"),
    ("tim_before", "0001-01-01", "1995-06-01"),
    ("tim_today", "2001-08-01", "2001-08-02"),
    ("tim_yesterday", "2001-07-31", "2001-08-01"),
    ("tim_last_n", "2001-05-01", "2001-08-01"),
    ("tim_this", "2001-07-01", "2001-10-01"),
    ("tim_last", "2001-04-01", "2001-07-01"),
):
    plan(
        _name,
        lambda t, a=_from, b=_to: t.orders.filter(half_open(c(_D), a, b)).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")),
        f"SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE {_D} >= TIMESTAMP '{_from}' AND {_D} < TIMESTAMP '{_to}'",
    )
plan(
    "tim_vs",
    lambda t: t.orders.agg(*(F.count_if(F.year(_D) == y).alias(f"y{y}") for y in (1999, 2000))),
    "SELECT count(*) FILTER (year(o_orderdate) = 1999) AS y1999, count(*) FILTER (year(o_orderdate) = 2000) AS y2000 FROM orders",
)


def _growth(months: int):
    """Months are a few hundred rows, so the window over all of them is small."""

    def build(t):
        by_month = t.orders.groupBy(bucket("month", c(_D)).alias("m")).agg(F.count("*").alias("n"))
        return by_month.withColumn("before", F.lag("n", months).over(Window.orderBy("m"))).select("m", "n", F.round(100.0 * (c("n") - c("before")) / c("before"), 4).alias("growth"))

    return build


for _name, _months in (("tim_yoy", 12), ("tim_mom", 1)):
    plan(_name, _growth(_months), f"SELECT m, n, round(100.0 * (n - lag(n, {_months}) OVER (ORDER BY m)) / lag(n, {_months}) OVER (ORDER BY m), 4) AS growth FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1)")
for _unit in ("day", "week", "month", "quarter"):
    plan(
        f"tim_bucket_{_unit}",
        lambda t, u=_unit: t.orders.groupBy(bucket(u, c(_D)).alias("bucket")).agg(F.count("*").alias("n")),
        f"SELECT CAST(date_trunc('{_unit}', o_orderdate) AS DATE) AS bucket, count(*) AS n FROM orders GROUP BY 1",
    )
plan(
    "tim_duration",
    lambda t: t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).agg(*(F.round(F.avg(boundary_diff(u, c(_D), c("l_shipdate"))), 4).alias(f"mean_{u}s") for u in ("hour", "day", "week", "month", "quarter", "year"))),
    "SELECT " + ", ".join(f"round(avg(date_diff('{u}', o_orderdate, l_shipdate)), 4) AS mean_{u}s" for u in ("hour", "day", "month", "quarter", "year")) + ", round(avg(date_diff('day', date_trunc('week', o_orderdate), date_trunc('week', l_shipdate)) / 7), 4) AS mean_weeks" + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)


def _trace_percentiles(t):
    stats = t.events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    ranks = nearest_ranks(t.events, ["event_type"], "value", {"median": 0.5, "p95": 0.95})
    return stats.join(ranks, "event_type")


plan(
    "trace_percentiles",
    _trace_percentiles,
    "SELECT event_type, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, list_sort(list(value))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS median, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type",
)
assert AS_OF_ORDERS == "2001-08-01"  # the relative periods above are spelled out for this day
