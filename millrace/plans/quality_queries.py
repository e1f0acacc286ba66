"""Data-quality, feature and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import features as X, learning as L, quality as Q
from millrace.plans.tables import NEW, OLD, new_customers, old_customers, sql, table

_HOLES = "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS balance, c_mktsegment AS segment FROM customer"


def profile(spark, d):
    return Q.profile(sql(spark, d, _HOLES, "customer"), ["balance", "segment"]).select("name", "observed", "nulls", "distinct_values")


def top_values(spark, d):
    return Q.top_values(table(spark, d, "part"), "p_brand", 5)


def statistics(spark, d):
    out = Q.statistics(table(spark, d, "orders"), ["o_totalprice", "o_custkey"])
    return out.select("name", *[F.round(c, 4).alias(c) if c != "n" else F.col(c) for c in out.columns if c != "name"])


def null_rates(spark, d):
    return Q.null_rates(sql(spark, d, _HOLES, "customer"), {"balance": 0.2, "segment": 0.0}).withColumn("rate", F.round("rate", 8))


def freshness(spark, d):
    out = Q.freshness(table(spark, d, "events"), "ts", 86400, F.to_timestamp_ntz(F.lit("2024-01-31 12:00:00")))
    return out.select(F.round("age_seconds", 3).alias("age_seconds"), "passed")


def row_count(spark, d):
    return Q.row_count(table(spark, d, "orders"), 100, 10**9)


def orphans(spark, d):
    facts = sql(spark, d, "SELECT o_orderkey, nullif(o_custkey, 5) AS k FROM orders", "orders")
    dims = sql(spark, d, f"SELECT id FROM ({OLD}) o", "customer")
    return Q.orphans(facts, "k", dims, "id").select("o_orderkey")


def reconcile(spark, d):
    return Q.reconcile(new_customers(spark, d), old_customers(spark, d), ["id"], ["segment", "nation"])


def count_anomaly(spark, d):
    daily = table(spark, d, "events").where("event_type <> 'error' OR day(ts) <> 9").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    out = Q.count_anomaly(daily, "day", "n", 7, 0.1)
    return out.select("day", "n", F.round("expected", 6).alias("expected"), F.round("deviation", 6).alias("deviation"), "is_anomaly")


def width_bins(spark, d):
    return X.bin_equal_width(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", 7)


def quantile_bins(spark, d):
    return X.bin_quantile(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", 5)


def hashed(spark, d):
    x = sql(spark, d, "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer", "customer")
    return X.hash_columns(x, ["segment"])


def date_parts(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return X.date_parts(e, "ts", ["year", "month", "day", "hour", "weekday", "quarter"]).drop("ts")


def derived(spark, d):
    x = table(spark, d, "part").select("p_partkey", (F.col("p_size") - 25).alias("p_size"), "p_retailprice")
    out = X.derive(x, {"half": "p_size / 2", "third": "p_size // 3", "rest": "p_size % 3", "middle": "-5 < p_size <= 5", "double": "half * 4 + 1"})
    return out.select("p_partkey", "half", F.col("third").cast("long").alias("third"), F.col("rest").cast("long").alias("rest"), "middle", "double")


def token_counts(spark, d):
    return X.token_count(table(spark, d, "conversations"), "text").select("conv_id", "turn", "token_count")


def cleaned(spark, d):
    return X.clean_strings(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"])


def scaled(spark, d):
    out = L.scale(table(spark, d, "part").select("p_partkey", "p_size"), ["p_size"])
    return out.select("p_partkey", F.round("p_size_scaled", 6).alias("p_size_scaled"))


def imputed(spark, d):
    out = L.impute(sql(spark, d, _HOLES, "customer"), ["balance"], "median")
    return out.select("c_custkey", F.round("balance", 4).alias("balance"))


def encoded(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = L.target_encode(L.frequency_encode(L.one_hot(o, "o_orderpriority", ["2-HIGH"]), "o_orderpriority"), "o_orderpriority", "o_totalprice")
    return out.select("o_orderkey", F.col("o_orderpriority_2-HIGH").alias("high"), F.round("o_orderpriority_frequency", 8).alias("frequency"), F.round("o_orderpriority_target", 2).alias("target"))


_SCORED = "SELECT doc_id, quality AS y, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS p, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)"


def confusion(spark, d):
    return L.binary_report(sql(spark, d, _SCORED, "labels", "documents"), "y", "p").select("tp", "fp", "fn", "tn", *[F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def roc_auc(spark, d):
    return L.auc(sql(spark, d, _SCORED, "labels", "documents"), "y", "s").withColumn("auc", F.round("auc", 8))


def regression(spark, d):
    o = sql(spark, d, "SELECT l_extendedprice AS y, l_quantity * 3000 AS p FROM lineitem", "lineitem")
    return L.regression_report(o, "y", "p").select(*[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")])


def drift(spark, d):
    a, b = (table(spark, d, "lineitem").where(f"l_returnflag = '{f}'") for f in "AN")
    psi = L.stability_index(a, b, "l_quantity", [10.0, 20.0, 30.0, 40.0])
    return psi.select(F.round("psi", 8).alias("psi")).withColumn("test", F.lit("psi")).select("test", F.col("psi").alias("value")).union(L.largest_gap(a, b, "l_quantity").select(F.lit("ks"), F.round("ks", 8)))


def backtest(spark, d):
    out = L.backtest_windows(table(spark, d, "events").select("event_id", "ts"), "ts", ["2024-01-10", "2024-01-20"], 5, 7)
    return out.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


_DAILY = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type <> 'error' OR day(ts) <> 9 GROUP BY 1"
_P = ", ".join(f"round(quantile_cont(v, {r}), 4) AS {n}" for n, r in {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}.items())

QUERIES = {
    "profile": (profile, f"WITH x AS ({_HOLES}) SELECT 'balance' AS name, count(balance) AS observed, count(*) - count(balance) AS nulls, count(DISTINCT balance) AS distinct_values FROM x UNION ALL SELECT 'segment', count(segment), count(*) - count(segment), count(DISTINCT segment) FROM x"),
    "top_values": (top_values, "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5"),
    "statistics": (statistics, f"WITH x AS (SELECT 'o_totalprice' AS name, o_totalprice AS v FROM orders UNION ALL SELECT 'o_custkey', o_custkey::DOUBLE FROM orders) SELECT name, count(v) AS n, round(min(v), 4) AS least, round(max(v), 4) AS largest, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, {_P} FROM x GROUP BY name"),
    "null_rates": (null_rates, f"WITH x AS ({_HOLES}) SELECT 'balance' AS \"column\", round(avg((balance IS NULL)::INT), 8) AS rate, 0.2::DOUBLE AS threshold, avg((balance IS NULL)::INT) <= 0.2 AS passed FROM x UNION ALL SELECT 'segment', avg((segment IS NULL)::INT), 0.0, avg((segment IS NULL)::INT) <= 0 FROM x"),
    "freshness": (freshness, "SELECT round((epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(ts))) / 1000000, 3) AS age_seconds, epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(ts)) <= 86400000000 AS passed FROM events"),
    "row_count": (row_count, "SELECT count(*) AS rows, count(*) BETWEEN 100 AND 1000000000 AS passed FROM orders"),
    "referential_orphans": (orphans, "SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_custkey, 5) AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)"),
    "reconcile": (reconcile, f"SELECT coalesce(s.id, t.id) AS id, CASE WHEN t.id IS NULL THEN 'added' WHEN s.id IS NULL THEN 'removed' WHEN s.segment <> t.segment OR s.nation <> t.nation THEN 'changed' ELSE 'matched' END AS change FROM ({NEW}) s FULL JOIN ({OLD}) t ON s.id = t.id"),
    "count_anomaly": (count_anomaly, f"WITH e AS (SELECT day, n, avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m FROM ({_DAILY})) SELECT day, n, round(m, 6) AS expected, round(abs(n - m) / m, 6) AS deviation, coalesce(abs(n - m) / m > 0.1, false) AS is_anomaly FROM e"),
    "bin_equal_width": (width_bins, "SELECT p_partkey, p_size, CAST(least(floor((p_size - lo) / ((hi - lo) / 7)) + 1, 7) AS INTEGER) AS p_size_bin FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)"),
    "bin_quantile": (quantile_bins, "WITH s AS (SELECT list(p_size ORDER BY p_size) AS v, count(*) AS n FROM part) SELECT p_partkey, p_size, CAST(1 + (p_size >= v[n // 5 + 1])::INT + (p_size >= v[2 * n // 5 + 1])::INT + (p_size >= v[3 * n // 5 + 1])::INT + (p_size >= v[4 * n // 5 + 1])::INT AS INTEGER) AS p_size_bin FROM part, s"),
    "hash_columns": (hashed, "SELECT c_custkey, sha256(coalesce(nullif(c_mktsegment, 'BUILDING'), 'None')) AS segment FROM customer"),
    "date_parts": (date_parts, "SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month, CAST(day(ts) AS INTEGER) AS ts_day, CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(isodow(ts) - 1 AS INTEGER) AS ts_weekday, CAST(quarter(ts) AS INTEGER) AS ts_quarter FROM events"),
    "derived_columns": (derived, "WITH x AS (SELECT p_partkey, p_size - 25 AS s FROM part) SELECT p_partkey, s / 2 AS half, CAST(floor(s / 3) AS BIGINT) AS third, CAST(s - 3 * floor(s / 3) AS BIGINT) AS rest, -5 < s AND s <= 5 AS middle, s / 2 * 4 + 1 AS double FROM x"),
    "token_count": (token_counts, r"SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS token_count FROM conversations"),
    "clean_strings": (cleaned, "SELECT p_partkey, replace(lower(p_brand), '#', '') AS p_brand FROM part"),
    "scale_standard": (scaled, "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size_scaled FROM part"),
    "impute_median": (imputed, f"WITH x AS ({_HOLES}) SELECT c_custkey, round(coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM x)), 4) AS balance FROM x"),
    "encode_categories": (encoded, "WITH x AS (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n, sum(o_totalprice) OVER (PARTITION BY o_orderpriority) AS s, count(*) OVER () AS a, avg(o_totalprice) OVER () AS m FROM orders) SELECT o_orderkey, (o_orderpriority = '2-HIGH')::INTEGER AS high, round(n / a, 8) AS frequency, round((s + 10 * m) / (n + 10), 2) AS target FROM x"),
    "binary_report": (confusion, f"WITH x AS ({_SCORED}), c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM x) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c"),
    "roc_auc": (roc_auc, f"WITH x AS ({_SCORED}) SELECT round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END), 8) AS auc FROM x a, x b WHERE a.y = 1 AND b.y = 0"),
    "regression_report": (regression, "SELECT round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(1 - avg((y - p) ** 2) / var_pop(y), 4) AS r2 FROM (SELECT l_extendedprice AS y, l_quantity * 3000 AS p FROM lineitem)"),
    "drift": (
        drift,
        """WITH x AS (SELECT l_returnflag AS f, l_quantity AS v, (v >= 10)::INT + (v >= 20)::INT + (v >= 30)::INT + (v >= 40)::INT AS b FROM lineitem),
p AS (SELECT b, count(*) FILTER (f = 'A') / (SELECT count(*) FROM x WHERE f = 'A') AS e, count(*) FILTER (f = 'N') / (SELECT count(*) FROM x WHERE f = 'N') AS a FROM x GROUP BY b),
k AS (SELECT v, sum(count(*) FILTER (f = 'A')) OVER (ORDER BY v) / (SELECT count(*) FROM x WHERE f = 'A') AS e, sum(count(*) FILTER (f = 'N')) OVER (ORDER BY v) / (SELECT count(*) FROM x WHERE f = 'N') AS a FROM x WHERE f IN ('A', 'N') GROUP BY v)
SELECT 'psi' AS test, round(sum((a - e) * ln(a / e)), 8) AS value FROM p UNION ALL SELECT 'ks', round(max(abs(e - a)), 8) FROM k""",
    ),
    "backtest_windows": (backtest, "WITH c AS (SELECT * FROM (VALUES (0, TIMESTAMP '2024-01-10'), (1, TIMESTAMP '2024-01-20')) v(fold, cut)) SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN ts < cut THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM events, c WHERE ts >= cut - INTERVAL 7 DAY AND ts < cut + INTERVAL 5 DAY GROUP BY ALL"),
}
