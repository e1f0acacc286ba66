"""Relational queries: joins, aggregation, shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import relational as R
from millrace.plans.tables import sql, table


def revenue_by_region(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return (
        t("lineitem")
        .filter(F.col("l_shipdate") >= "1995-01-01")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name")
        .agg(
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
            F.count(F.lit(1)).alias("n_items"),
            F.countDistinct("c_custkey").alias("n_customers"),
        )
    )


def pricing_summary(spark, d):
    items = table(spark, d, "lineitem").where(F.col("l_shipdate") <= "1998-09-02")
    return R.aggregate(items, ["l_returnflag", "l_linestatus"], {"sum_qty": R.Agg("l_quantity", "sum"), "avg_price": "round(avg(l_extendedprice), 4)", "n": R.Agg("l_quantity", "count"), "max_discount": R.Agg("l_discount", "max"), "parts": R.Agg("l_partkey", "count_distinct")})


def aggregate_all_functions(spark, d):
    e = table(spark, d, "events").withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    out = R.aggregate(e, ["event_type"], {f: R.Agg("x", f, order="event_id") for f in ("sum", "min", "max", "count", "count_distinct", "first", "last")} | {"mean": "round(avg(x), 6)", "any_high": "bool_or(value > 19)", "all_low": "bool_and(value < 100)"})
    return out.withColumn("sum", F.round("sum", 4))


_EVENT_AGG = """WITH e AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS x FROM events)
SELECT event_type, round(coalesce(sum(x), 0), 4) AS "sum", min(x) AS "min", max(x) AS "max", count(x) AS "count", count(DISTINCT x) AS count_distinct,
 (list(x ORDER BY event_id))[1] AS "first", (list(x ORDER BY event_id DESC))[1] AS "last", round(avg(x), 6) AS mean, bool_or(value > 19) AS any_high, bool_and(value < 100) AS all_low
FROM e GROUP BY event_type"""


def _joined(how):
    def run(spark, d):
        left = sql(spark, d, "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING'", "customer")
        right = sql(spark, d, "SELECT o_custkey AS k, CAST(count(*) AS STRING) AS name FROM orders WHERE o_totalprice > 450000 GROUP BY o_custkey", "orders")
        return R.join(left, right, ["k"], how)

    return run


_L = "(SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING') l"
_R = "(SELECT o_custkey AS k, CAST(count(*) AS STRING) AS name FROM orders WHERE o_totalprice > 450000 GROUP BY o_custkey) r"
_BOTH = "coalesce(l.k, r.k) AS k, l.name AS name, r.name AS name_right"


def theta_join(spark, d):
    left = table(spark, d, "supplier").alias("l")
    return R.join(left, table(spark, d, "part"), "l.s_acctbal > r.p_retailprice * 5 AND l.s_nationkey = r.p_size", "inner").select("s_suppkey", "p_partkey")


def null_equal_join(spark, d):
    left = sql(spark, d, "SELECT c_custkey AS id, nullif(c_nationkey, 3) AS k FROM customer", "customer")
    right = sql(spark, d, "SELECT nullif(n_nationkey, 3) AS k, n_name FROM nation", "nation")
    return R.join(left, right, ["k"], "left", null_equal=True).withColumn("k", F.col("k").cast("string"))


def lookup_first(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return R.lookup(table(spark, d, "customer").select("c_custkey"), orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], ["o_orderkey"], ["o_orderdate", "o_orderkey"])


def price_bands(spark, d):
    bands = spark.createDataFrame([(0.0, 100000.0, "low"), (100000.0, 300000.0, "middle"), (300000.0, 1e9, "high")], "lo double, hi double, band string")
    found = R.bucketed_range_lookup(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), bands.withColumn("hi", F.least("hi", F.lit(2e6))), "o_totalprice", "lo", "hi", ["band"], 100_000)
    return R.aggregate(found, ["band"], {"n": "count(*)"})


def name_prefixes(spark, d):
    prefixes = spark.createDataFrame([("small", "S"), ("red", "R"), ("re", "E")], "p string, code string")
    found = R.prefix_lookup(table(spark, d, "part").select("p_partkey", "p_name"), prefixes, "p_name", "p", ["code"], ["p_partkey"])
    return found.select("p_partkey", "code")


def dedup_first(spark, d):
    return R.deduplicate(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], ["event_id"])


def normalized_parts(spark, d):
    dirty = sql(spark, d, "SELECT p_partkey, concat('  ', upper(p_name), '   x-', p_brand, ' ') AS a, CASE WHEN p_size % 5 = 0 THEN ' N/A ' ELSE p_type END AS b FROM part", "part")
    return R.normalize(dirty, {"a": R.NormalizeRule(case="lower"), "b": R.NormalizeRule(case="title", nulls=("n/a",))})


def pivot_status(spark, d):
    return R.pivot(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "o_orderkey", "count", ["F", "O", "P"])


def unpivot_prices(spark, d):
    return R.unpivot(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "measure", "rate")


def order_rank(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.window_calc(o, {"rank": F.rank(), "before": F.lag("o_totalprice")}, ["o_custkey"], ["o_totalprice", "o_orderkey"])


def top_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.top_k(o, 2, [F.desc("o_totalprice"), "o_orderkey"], ["o_custkey"])


def top_overall(spark, d):
    return R.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 20, [F.desc("o_totalprice"), "o_orderkey"])


def cube_orders(spark, d):
    return R.rollup(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], {"n": "count(*)"}, cube=True)


def rollup_orders(spark, d):
    return R.rollup(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], {"n": "count(*)"})


def set_operations(spark, d):
    a = sql(spark, d, "SELECT DISTINCT o_custkey AS k FROM orders", "orders")
    b = sql(spark, d, "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'", "customer")
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("op"), "n")
    return one(a.union(b), "union_all").union(one(a.union(b).distinct(), "union")).union(one(a.intersect(b), "intersect")).union(one(a.subtract(b), "except"))


def segment_mart(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return R.mart(j, ["c_mktsegment"], {"orders": "count(*)", "revenue": "round(sum(o_totalprice), 2)"})


def discount_ratio(spark, d):
    items = table(spark, d, "lineitem").withColumn("cut", F.col("l_extendedprice") * F.col("l_discount"))
    return R.metric(items, "ratio", "ratio", dimensions=["l_returnflag"], numerator="cut", denominator="l_extendedprice").withColumn("ratio", F.round("ratio", 8))


def staged_customers(spark, d):
    return R.staging(table(spark, d, "customer"), {"c_custkey": "id", "c_name": "name"}, F.lit("2024-01-01"))


def casts(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("t"))
    return R.cast(R.rename(c, {"t": "balance"}), {"balance": "int", "c_custkey": "string"}, lenient=True).withColumn("balance", F.col("balance").isNull())


QUERIES = {
    "revenue_by_region": (
        revenue_by_region,
        """SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_items, count(DISTINCT c_custkey) AS n_customers
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_shipdate >= DATE '1995-01-01' GROUP BY r_name""",
    ),
    "pricing_summary": (pricing_summary, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(l_quantity) AS n, max(l_discount) AS max_discount, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL"),
    "aggregate_all_functions": (aggregate_all_functions, _EVENT_AGG),
    **{f"join_{how}": (_joined(how), f"SELECT {_BOTH} FROM {_L} {how.upper()} JOIN {_R} ON l.k = r.k") for how in ("inner", "left", "right", "full")},
    "join_left_semi": (_joined("left_semi"), f"SELECT l.k, l.name FROM {_L} SEMI JOIN {_R} ON l.k = r.k"),
    "join_left_anti": (_joined("left_anti"), f"SELECT l.k, l.name FROM {_L} ANTI JOIN {_R} ON l.k = r.k"),
    "join_right_semi": (_joined("right_semi"), f"SELECT r.k, r.name FROM {_R} SEMI JOIN {_L} ON l.k = r.k"),
    "join_right_anti": (_joined("right_anti"), f"SELECT r.k, r.name FROM {_R} ANTI JOIN {_L} ON l.k = r.k"),
    "join_theta": (theta_join, "SELECT s_suppkey, p_partkey FROM supplier JOIN part ON s_acctbal > p_retailprice * 5 AND s_nationkey = p_size"),
    "join_null_equal": (null_equal_join, "SELECT CAST(l.k AS VARCHAR) AS k, l.id, r.n_name FROM (SELECT c_custkey AS id, nullif(c_nationkey, 3) AS k FROM customer) l LEFT JOIN (SELECT nullif(n_nationkey, 3) AS k, n_name FROM nation) r ON l.k IS NOT DISTINCT FROM r.k"),
    "lookup_first_match": (lookup_first, "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) AS o_orderkey FROM customer"),
    "range_lookup": (price_bands, "SELECT band, count(*) AS n FROM orders LEFT JOIN (VALUES (0.0, 100000.0, 'low'), (100000.0, 300000.0, 'middle'), (300000.0, 2e6, 'high')) b(lo, hi, band) ON o_totalprice BETWEEN lo AND hi GROUP BY band"),
    "prefix_lookup": (name_prefixes, "SELECT p_partkey, code FROM part LEFT JOIN (VALUES ('small', 'S'), ('red', 'R'), ('re', 'E')) b(p, code) ON starts_with(p_name, p)"),
    "deduplicate_first": (dedup_first, "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1"),
    "normalize_text": (normalized_parts, "SELECT p_partkey, lower(p_name) || ' x-' || lower(p_brand) AS a, CASE WHEN p_size % 5 = 0 THEN NULL ELSE upper(p_type[1]) || lower(p_type[2:]) END AS b FROM part"),
    "pivot_status": (pivot_status, "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS \"F\", nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS \"O\", nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS \"P\" FROM orders GROUP BY 1"),
    "unpivot_rates": (unpivot_prices, "SELECT l_orderkey, l_linenumber, 'l_discount' AS measure, l_discount AS rate FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem"),
    "window_rank": (order_rank, "SELECT o_orderkey, o_custkey, o_totalprice, CAST(rank() OVER w AS INTEGER) AS rank, lag(o_totalprice) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"),
    "top_k_by_group": (top_orders, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "top_k": (top_overall, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "cube": (cube_orders, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "rollup": (rollup_orders, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "set_operations": (
        set_operations,
        """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT 'union_all' AS op, (SELECT count(*) FROM (SELECT k FROM a UNION ALL SELECT k FROM b)) AS n UNION ALL
SELECT 'union', (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) UNION ALL
SELECT 'intersect', (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) UNION ALL
SELECT 'except', (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b))""",
    ),
    "mart_by_segment": (segment_mart, "SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "metric_ratio": (discount_ratio, "SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 8) AS ratio FROM lineitem GROUP BY 1"),
    "staging_model": (staged_customers, "SELECT c_custkey AS id, c_name AS name, '2024-01-01' AS _loaded_at FROM customer"),
    "cast_and_rename": (casts, "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_acctbal AS VARCHAR) LIKE '%.%' AS balance FROM customer"),
}
