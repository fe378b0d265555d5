"""Fixed analytics: dashboards, reports, quality signals, run and trace statistics, wide views, paged grids."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions.semantics import bucket, rate
from quillstone.operators.grid import Grid, page
from quillstone.plans.shapes import plan
from quillstone.sources.files import json_rows

c = F.col
_DAY = "TIMESTAMP '2001-08-01'"

_KPIS = {"total": "true", "open": "o_orderstatus = 'O'", "filled": "o_orderstatus = 'F'", "partial": "o_orderstatus = 'P'", "urgent": "o_orderpriority = '1-URGENT'", "high": "o_orderpriority = '2-HIGH'", "large": "o_totalprice > 200000", "small": "o_totalprice < 10000", "recent": "o_orderdate >= TIMESTAMP_NTZ '2001-01-01'", "urgent_open": "o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'"}
plan("dash_kpis", lambda t: t.orders.agg(*(F.expr(f"count_if({p})").alias(f"n_{n}") for n, p in _KPIS.items())), "SELECT " + ", ".join(f"count(*) FILTER ({p.replace('_NTZ', '')}) AS n_{n}" for n, p in _KPIS.items()) + " FROM orders")
plan(
    "dash_rates",
    lambda t: t.orders.groupBy("o_orderpriority").agg(rate(F.count_if(c("o_orderstatus").isin("F", "P")), F.count("*")).alias("done_rate")),
    "SELECT o_orderpriority, CASE WHEN count(*) = 0 THEN 0.0 ELSE round_even(100.0 * count(*) FILTER (o_orderstatus IN ('F', 'P')) / count(*), 1) END AS done_rate FROM orders GROUP BY o_orderpriority",
)
plan(
    "dash_breakdown",
    lambda t: t.documents.join(t.labels, "doc_id", "left").groupBy(F.coalesce(c("quality").cast("string"), F.lit("Unknown")).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label"),
    "SELECT coalesce(CAST(quality AS VARCHAR), 'Unknown') AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
)


def _zero_filled(t):
    days = t.spark.sql("SELECT explode(sequence(DATE '2001-07-26', DATE '2001-08-01')) AS day")
    counts = t.orders.filter("o_orderdate >= TIMESTAMP_NTZ '2001-07-26'").groupBy(c("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


plan("dash_zero_filled", _zero_filled, "SELECT CAST(d AS DATE) AS day, count(o_orderkey) AS n FROM range(TIMESTAMP '2001-07-26', TIMESTAMP '2001-08-02', INTERVAL 1 DAY) r(d) LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY 1")
plan(
    "dash_top5",
    lambda t: t.part.groupBy(F.coalesce(F.nullif("p_type", F.lit("")), F.lit("Unassigned")).alias("area")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "area").limit(5),
    "SELECT coalesce(nullif(p_type, ''), 'Unassigned') AS area, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, area LIMIT 5",
)
plan(
    "dash_recent",
    lambda t: t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5).join(t.customer, c("o_custkey") == c("c_custkey"), "left").join(t.nation, c("c_nationkey") == c("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name"),
    "SELECT o_orderkey, c_name, n_name FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5) LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
)


def swapped_range(df, col, first, last):
    """Days first to last, both included, given in either order."""
    first, last = min(first, last), max(first, last)
    after = F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")
    return df.filter((c(col) >= F.lit(first).cast("timestamp_ntz")) & (c(col) < after))


plan("rep_range", lambda t: swapped_range(t.orders, "o_orderdate", "1999-03-31", "1999-02-01").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-02-01' AND o_orderdate < TIMESTAMP '1999-04-01'")
_DIMENSIONS = ("o_orderstatus", "o_orderpriority", "c_mktsegment", "n_name", "r_name")


def _by_dimension(t):
    """All five breakdowns from one pass: grouping sets, not five scans."""
    wide = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    sets = wide.groupingSets([[d] for d in _DIMENSIONS], *_DIMENSIONS).agg(F.count("*").alias("n"), *(F.grouping(d).alias(f"g_{d}") for d in _DIMENSIONS))
    which = F.coalesce(*(F.when(c(f"g_{d}") == 0, d) for d in _DIMENSIONS))
    value = F.coalesce(*(F.when(c(f"g_{d}") == 0, c(d)) for d in _DIMENSIONS))
    return sets.select(which.alias("dimension"), value.alias("value"), "n")


_WIDE = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
plan("rep_by_dimension", _by_dimension, " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM {_WIDE} GROUP BY 2" for d in _DIMENSIONS))
plan(
    "rep_monthly_trend",
    lambda t: t.orders.filter("o_orderdate >= TIMESTAMP_NTZ '2001-02-01'").groupBy(F.year("o_orderdate").cast("bigint").alias("y"), F.month("o_orderdate").cast("bigint").alias("m")).agg(F.count("*").alias("n")),
    "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-02-01' GROUP BY ALL",
)


def _latest_run(t):
    """The runs of an order are its lines: the highest successful one, and the number of all."""
    runs = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_runs"), F.max(F.when(c("l_linestatus") == "F", c("l_linenumber"))).alias("l_linenumber"))
    return t.lineitem.join(runs, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity", "n_runs")


plan(
    "ins_latest_run",
    _latest_run,
    "SELECT l_orderkey, l_linenumber, l_quantity, n_runs FROM lineitem JOIN (SELECT l_orderkey, count(*) AS n_runs, max(l_linenumber) FILTER (l_linestatus = 'F') AS l_linenumber FROM lineitem GROUP BY l_orderkey) USING (l_orderkey, l_linenumber)",
)
_REASONS = {"no_label": "quality IS NULL", "low_quality": "quality = 0", "toxic": "toxic = 1", "short": "n_chars < 100", "unknown_language": "lang NOT IN ('en', 'de', 'fr', 'es')"}


def _reasons(t):
    found = F.array_compact(F.array(*(F.when(F.expr(p), n) for n, p in _REASONS.items())))
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.array_join(found, ",").alias("reasons"), F.size(found).cast("bigint").alias("n")).filter("n > 0")


plan("ins_review_reasons", _reasons, "SELECT * FROM (SELECT doc_id, array_to_string(r, ',') AS reasons, CAST(len(r) AS BIGINT) AS n FROM (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in _REASONS.items()) + "], lambda x: x IS NOT NULL) AS r FROM documents LEFT JOIN labels USING (doc_id))) WHERE n > 0")
plan(
    "ins_overview",
    lambda t: t.documents.join(t.labels, "doc_id", "left").agg(F.count("*").alias("n"), F.count("quality").alias("n_labelled"), F.count_if(c("toxic") == 1).alias("n_toxic"), F.count_if((c("quality") == 1) & (c("toxic") == 0)).alias("n_good"), F.round(F.avg("n_chars"), 4).alias("mean_chars")),
    "SELECT count(*) AS n, count(quality) AS n_labelled, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (quality = 1 AND toxic = 0) AS n_good, round(avg(n_chars), 4) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id)",
)
plan(
    "ins_patterns",
    lambda t: t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count_if(c("toxic") == 1).alias("n_toxic")).orderBy(F.desc("n_toxic"), "source").limit(5),
    "SELECT source, count(*) FILTER (toxic = 1) AS n_toxic FROM documents JOIN labels USING (doc_id) GROUP BY source ORDER BY n_toxic DESC, source LIMIT 5",
)
plan(
    "ins_trend",
    lambda t: t.events.groupBy(bucket("day", c("ts")).alias("day")).agg(F.count("*").alias("n"), F.count_if(c("event_type") == "error").alias("n_flagged")),
    "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_flagged FROM events GROUP BY 1",
)


def _share(t):
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("n"))  # a row for each type
    return counts.select("event_type", "n", F.round(100.0 * c("n") / F.sum("n").over(Window.partitionBy()), 4).alias("percent"))


plan("trace_share", _share, "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM events GROUP BY event_type")


def _repeats(t):
    """Three examples by smallest id, without gathering a group: each next smallest is an aggregate over ranked rows."""
    keyed = t.part.select(F.lower(F.trim("p_name")).alias("k"), "p_partkey")
    sizes = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("p_partkey"))).filter("r <= 3")
    return sizes.join(ranked.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("examples")), "k")


plan(
    "trace_repeats",
    _repeats,
    "SELECT lower(trim(p_name)) AS k, count(*) AS n, array_to_string(list_sort(list(p_partkey))[1:3], ',') AS examples FROM part GROUP BY 1 HAVING count(*) > 1",
)


def _anomalies(t):
    mean = t.events.agg((3 * F.avg("value")).alias("most"))  # one row
    found = F.array_compact(F.array(F.when(c("value") > c("most"), "slow"), F.when(c("event_type") == "error", "error"), F.when(F.get_json_object("props", "$.k").cast("int") < 2, "low")))
    return t.events.crossJoin(F.broadcast(mean)).select("event_id", F.array_join(found, ",").alias("reasons"), F.size(found).cast("bigint").alias("n")).filter("n > 0").orderBy(F.desc("n"), "event_id")


plan(
    "trace_anomalies",
    _anomalies,
    "SELECT * FROM (SELECT event_id, array_to_string(r, ',') AS reasons, CAST(len(r) AS BIGINT) AS n FROM (SELECT event_id, list_filter([CASE WHEN value > 3 * (SELECT avg(value) FROM events) THEN 'slow' END, CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 2 THEN 'low' END], lambda x: x IS NOT NULL) AS r FROM events)) WHERE n > 0",
)
plan(
    "json_group",
    lambda t: t.events.groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")),
    "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1",
)
plan(
    "json_project",
    lambda t: t.events.select("event_id", F.posexplode(json_rows(F.concat(F.lit('[{"own": "'), "event_type", F.lit('"}, '), "props", F.lit("]")))).alias("row", "m")).select("event_id", F.col("row").cast("bigint").alias("row"), F.explode("m").alias("name", "value")),
    """SELECT event_id, CAST(0 AS BIGINT) AS row, 'own' AS name, event_type AS value FROM events
UNION ALL SELECT event_id, 1, name, substr(json_extract_string(props, '$.' || name), 1, 250) FROM (SELECT event_id, props, unnest(json_keys(props)[1:20]) AS name FROM events)""",
)
plan(
    "trace_issues",
    lambda t: t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<(h1|nav|article|footer|script|style|table)\b"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10),
    r"SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<(h1|nav|article|footer|script|style|table)\b', 1)) AS tag FROM pages) GROUP BY tag ORDER BY n DESC, tag LIMIT 10",
)


def _latest_previous(t):
    w = Window.partitionBy("o_custkey")
    ranked = t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("r"))
    return ranked.groupBy("o_custkey").agg(F.max(F.when(c("r") == 1, c("o_orderkey"))).alias("latest"), F.max(F.when(c("r") == 2, c("o_orderkey"))).alias("previous"), F.count("*").alias("n"))


plan(
    "case_latest_prev",
    _latest_previous,
    "SELECT o_custkey, max(o_orderkey) FILTER (r = 1) AS latest, max(o_orderkey) FILTER (r = 2) AS previous, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) GROUP BY o_custkey",
)
plan(
    "eval_breakdown",
    lambda t: t.documents.join(t.labels, "doc_id").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(c("quality") == 1).alias("passed"), F.round(100.0 * F.count_if(c("quality") == 1) / F.count("*"), 1).alias("percent")),
    "SELECT lang, source, count(*) AS n, count(*) FILTER (quality = 1) AS passed, round(100.0 * count(*) FILTER (quality = 1) / count(*), 1) AS percent FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
)


def _trust():
    return F.when(c("quality").isNull(), "ungraded").when((c("quality") == 1) & (c("toxic") == 0), "correct").when((c("quality") == 1) & (c("toxic") == 1), "confident_wrong").when(c("n_chars") < 200, "honest_abstain").otherwise("over_cautious")


plan(
    "eval_trust",
    lambda t: t.documents.join(t.labels, "doc_id", "left").groupBy(_trust().alias("verdict")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN quality IS NULL THEN 'ungraded' WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 AND toxic = 1 THEN 'confident_wrong' WHEN n_chars < 200 THEN 'honest_abstain' ELSE 'over_cautious' END AS verdict, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
)


def _robustness(t):
    """Pass rate per language and its drop against English."""
    by = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.avg(c("quality").cast("double")).alias("p"))
    base = by.filter("lang = 'en'").select(c("p").alias("base"))  # one row
    return by.crossJoin(F.broadcast(base)).select("lang", F.round("p", 4).alias("pass_rate"), F.round(c("base") - c("p"), 4).alias("drop"))


plan("eval_robustness", _robustness, "WITH b AS (SELECT lang, avg(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, round(p, 4) AS pass_rate, round((SELECT p FROM b WHERE lang = 'en') - p, 4) AS \"drop\" FROM b")
_RATES = (("view", 0.5, 1.0), ("click", 0.25, 0.75), ("*", 1.0, 2.0))


def _costs(t):
    rates = F.broadcast(t.spark.createDataFrame(_RATES, "model string, per_in double, per_out double"))  # a fixed few
    by_type = t.events.groupBy("event_type").agg(F.sum("value").alias("units"), F.count("*").alias("calls"))
    both = by_type.join(rates, (c("model") == c("event_type")) | (c("model") == "*"))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.when(c("model") == "*", 1).otherwise(0)))).filter("r = 1")
    return best.select("event_type", F.round(c("units") / 1000 * c("per_in") + c("calls") / 1000 * c("per_out"), 4).alias("cost"))


plan(
    "cost_estimate",
    _costs,
    "SELECT event_type, round(units / 1000 * per_in + calls / 1000 * per_out, 4) AS cost FROM (SELECT event_type, sum(value) AS units, count(*) AS calls FROM events GROUP BY event_type) JOIN (VALUES ('view', 0.5, 1.0), ('click', 0.25, 0.75), ('*', 1.0, 2.0)) v(model, per_in, per_out) ON model = event_type OR model = '*' QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY model = '*') = 1",
)
_GRID = Grid(search=("c_name", "c_mktsegment"), filters={"c_nationkey": 3}, quick={"rich": "c_acctbal > 0"}, sorts={"balance": ("c_acctbal", True)}, key="c_custkey")
plan(
    "grid_page",
    lambda t: page(t.customer, _GRID, text="cust", quick="rich", sort="balance", number=1, size=10).select("c_custkey", "c_name", "total_rows"),
    "SELECT c_custkey, c_name, count(*) OVER () AS total_rows FROM customer WHERE (lower(c_name) LIKE '%cust%' OR lower(c_mktsegment) LIKE '%cust%') AND c_nationkey = 3 AND c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
)


def _wide(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).cast("bigint").alias("days"))
    return (
        t.orders.join(t.customer, c("o_custkey") == c("c_custkey"), "left")
        .join(t.nation, c("c_nationkey") == c("n_nationkey"), "left")
        .join(t.region, c("n_regionkey") == c("r_regionkey"), "left")
        .join(lines, c("o_orderkey") == c("l_orderkey"), "left")
        .select("o_orderkey", "c_name", F.length(F.rtrim("c_mktsegment")).cast("bigint").alias("segment_len"), "n_name", "r_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "days")
    )


plan(
    "view_wide",
    _wide,
    "SELECT o_orderkey, c_name, CAST(length(rtrim(c_mktsegment)) AS BIGINT) AS segment_len, n_name, r_name, coalesce(n_lines, 0) AS n_lines, days FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, date_diff('day', min(l_shipdate), max(l_shipdate)) AS days FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey",
)
_MEASURES = {f"n_{s.lower()}": f"o_orderstatus = '{s}'" for s in "FOP"} | {f"n_{p[0]}": f"o_orderpriority = '{p}'" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")} | {"n_large": "o_totalprice > 200000", "n_small": "o_totalprice <= 20000"}


def _entity(t):
    joined = t.customer.join(t.orders.filter("o_totalprice > 5000"), c("c_custkey") == c("o_custkey"), "left")
    measures = [F.expr(f"count_if({p})").alias(n) for n, p in _MEASURES.items()]
    return joined.groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("n"), F.count_distinct("c_custkey").alias("n_customers"), *measures, F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.round(F.sum("o_totalprice"), 2).alias("total"))


plan(
    "view_entity_performance",
    _entity,
    "SELECT c_mktsegment, count(o_orderkey) AS n, count(DISTINCT c_custkey) AS n_customers, " + ", ".join(f"count(*) FILTER ({p}) AS {n}" for n, p in _MEASURES.items()) + ", round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 5000 GROUP BY c_mktsegment",
)


def _agents(t):
    """Correlated scalar subqueries as one grouped join for each measured table."""
    supplied = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n_lines"), F.count_if(c("l_returnflag") == "R").alias("n_returned"), F.max("l_shipdate").alias("last"))
    return t.supplier.join(supplied, c("s_suppkey") == c("l_suppkey"), "left").select("s_suppkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_returned", F.lit(0)).alias("n_returned"), "last")


plan(
    "view_agent_performance",
    _agents,
    "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_lines, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS n_returned, (SELECT max(l_shipdate) FROM lineitem WHERE l_suppkey = s_suppkey) AS last FROM supplier",
)
plan(
    "trace_retention_keep",
    lambda t: t.events.filter(c("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id", "ts"),
    "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15'",
)
