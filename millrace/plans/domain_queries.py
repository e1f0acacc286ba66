"""Clinical, production and evaluation queries over the event and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import clinical as C, learning as L, production as P
from millrace.plans.tables import sql, table


def vitals(spark, d):
    out = C.vital_summary(table(spark, d, "events"), "user_id", "event_type", "value", "event_id")
    return out.withColumn("mean", F.round("mean", 6))


def encounters(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    out = C.timeline(e, "user_id", "ts", ["event_id"])
    return out.select("event_id", "encounter", F.col("days_since_first").cast("long").alias("days_since_first"), F.coalesce("days_since_last", F.lit(-1)).cast("long").alias("days_since_last"))


def pseudonyms(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.pseudonym(F.col("c_name"), "salt").alias("alias"))


def units(spark, d):
    table_ = spark.createDataFrame([("view", "std", 2.0), ("click", "std", 0.5), ("click", "other", 9.0)], "from_unit string, to_unit string, factor double")
    out = C.convert_units(table(spark, d, "events").select("event_id", "event_type", "value"), table_, "value", "event_type", "std")
    return out.withColumn("value", F.round("value", 6))


def adverse_counts(spark, d):
    return C.event_counts(table(spark, d, "events"), "user_id", "event_type", ["error", "signup"])


def emergent(spark, d):
    e = table(spark, d, "events")
    out = C.treatment_emergent(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), e.where("event_type = 'signup' AND value > 40"), "user_id", "ts", "ts")
    return out.select("event_id", "is_emergent")


def arms(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey % 2 AS arm", "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS outcome", "o_orderpriority <> '1-URGENT' AS kept")
    return C.risk_by_arm(o, "arm", "outcome", "kept").withColumn("risk", F.round("risk", 8))


def variability(spark, d):
    e = table(spark, d, "events").withColumn("rr", F.col("value") * 20 + 500)
    return C.heart_rate_variability(e, ["user_id"], "event_id", "rr").select("user_id", *[F.round(c, 5).alias(c) for c in ("sdnn", "rmssd", "pnn50", "rate")])


def glucose(spark, d):
    return C.time_in_range(table(spark, d, "events"), ["user_id"], "value", 5.0, 30.0).select("user_id", *[F.round(c, 5).alias(c) for c in ("mean", "std", "in_range", "below", "above")])


def categories(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.upper(F.substring("p_name", 1, 1)), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".1")).alias("code"))
    return p.select("p_partkey", C.code_category(F.col("code")).alias("category"), C.all_valid(F.array("code")).alias("valid"))


def forecasts(spark, d):
    wells = sql(spark, d, "SELECT s_suppkey AS well, s_acctbal + 10000 AS q, 0.1 + s_suppkey % 7 * 0.1 AS d, CAST(s_suppkey % 3 * 0.5 AS DOUBLE) AS b FROM supplier", "supplier")
    return P.forecast(wells, "well", "q", "d", "b", 24).withColumn("rate", F.round("rate", 4))


def gaps(spark, d):
    out = P.downtimes(table(spark, d, "events").select("user_id", "ts"), ["user_id"], "ts", 36)
    return out.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), F.round("hours", 6).alias("hours"))


def corrosion(spark, d):
    a = sql(spark, d, "SELECT o_custkey AS f, avg(o_totalprice) AS depth FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey", "orders")
    b = sql(spark, d, "SELECT o_custkey AS f, avg(o_totalprice) AS depth FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey", "orders")
    rates = P.corrosion_rates(a, b, "f", "depth", 2.5)
    return rates.select("f", F.round("rate", 4).alias("rate"), F.round(P.inspection_risk(F.col("rate"), F.lit(3.0), 50_000.0), 6).alias("risk"))


def emitted(spark, d):
    factors = spark.createDataFrame([("view", 2.0), ("error", 25.0)], "source string, factor double")
    return P.emissions(table(spark, d, "events"), factors, "event_type", "value", 0.0192).withColumn("co2e", F.round("co2e", 4))


def logs(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("value"))
    v = F.col("value")
    porosity = P.density_porosity(2.0 + v / 200, 2.65, 1.0)
    return e.select("event_id", *[F.round(P.shale_volume(v, 5.0, 40.0, m), 6).alias(m) for m in ("linear", "larionov_older", "larionov_tertiary", "clavier", "steiber")], F.round(porosity, 6).alias("porosity"), F.round(P.water_saturation(v + 1, F.greatest(porosity, F.lit(0.05)), 0.1), 6).alias("saturation"))


def coverage(spark, d):
    return P.coverage(table(spark, d, "events"), ["user_id"], "value", 10.0).withColumn("coverage", F.round("coverage", 8))


def path(spark, d):
    survey = sql(spark, d, "SELECT user_id AS well, event_id AS md, CAST(event_id % 90 AS DOUBLE) AS inc, CAST(event_id % 360 AS DOUBLE) AS azi FROM events", "events")
    return P.well_path(survey, ["well"], "md", "inc", "azi").select("md", *[(F.round(c, 2) + 0.0).alias(c) for c in ("north", "east", "tvd")])


def ranking(spark, d):
    r = sql(spark, d, "SELECT o_custkey AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders", "orders")
    return L.ranking_report(r, "q", "r", "y", 5).select(*[F.round(c, 8).alias(c) for c in ("ndcg", "mrr", "map", "precision")])


_PRED = "SELECT doc_id, lang, quality AS y, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS p, least(n_chars / 8000.0D, 1.0D) AS s FROM labels JOIN documents USING (doc_id)"


def fairness(spark, d):
    out = L.rates_by_group(sql(spark, d, _PRED, "labels", "documents"), "lang", "y", "p")
    return out.select("lang", "n", *[F.round(F.coalesce(c, F.lit(-1.0)), 8).alias(c) for c in ("positive_rate", "true_positive_rate", "false_positive_rate")])


def calibrated(spark, d):
    return L.calibration(sql(spark, d, _PRED, "labels", "documents"), "y", "s", 5).select("bin", "n", F.round("mean_probability", 8).alias("mean_probability"), F.round("observed", 8).alias("observed"))


def forecast_errors(spark, d):
    e = table(spark, d, "events").withColumn("p", F.col("value") * 0.9 + 1)
    return L.forecast_report(e, ["user_id"], "event_id", "value", "p").select("user_id", *[F.round(c, 6).alias(c) for c in ("mape", "smape", "mase")])


def weights(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("t"))
    return L.tf_idf(c, "id", "t").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("top"))


def lags(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    return L.lag_features(e, ["user_id"], ["event_id"], ["value"], [1, 7]).drop("user_id", "value")


_DPRED = _PRED.replace("8000.0D", "8000.0").replace("1.0D", "1.0")
_ROUND5 = lambda pairs: ", ".join(f"round({e}, 5) AS {n}" for n, e in pairs.items())
_I = "greatest(0.0, least(1.0, (value - 5) / 35))"

QUERIES = {
    "vital_summary": (vitals, "SELECT user_id, event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS largest, arg_max(value, event_id) AS last, count(value) AS n FROM events GROUP BY ALL"),
    "encounter_timeline": (encounters, "SELECT event_id, row_number() OVER w AS encounter, date_diff('day', min(ts) OVER (PARTITION BY user_id), ts) AS days_since_first, coalesce(date_diff('day', lag(ts) OVER w, ts), -1) AS days_since_last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "pseudonyms": (pseudonyms, "SELECT c_custkey, sha256('salt|' || c_name)[1:16] AS alias FROM customer"),
    "unit_conversion": (units, "SELECT event_id, 'std' AS event_type, round(value * CASE event_type WHEN 'view' THEN 2.0 WHEN 'click' THEN 0.5 ELSE 1.0 END, 6) AS value FROM events"),
    "adverse_event_counts": (adverse_counts, "SELECT user_id, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'signup') AS signup FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1"),
    "treatment_emergent": (emergent, "SELECT event_id, coalesce(ts >= (SELECT min(ts) FROM events x WHERE x.user_id = e.user_id AND event_type = 'signup' AND value > 40), false) AS is_emergent FROM events e WHERE event_type = 'error'"),
    "trial_risk": (arms, "SELECT o_custkey % 2 AS arm, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 8) AS risk FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1"),
    "heart_rate_variability": (variability, f"WITH r AS (SELECT user_id, value * 20 + 500 AS rr, value * 20 + 500 - lag(value * 20 + 500) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) SELECT user_id, {_ROUND5({'sdnn': 'stddev_samp(rr)', 'rmssd': 'sqrt(avg(d * d))', 'pnn50': 'avg((abs(d) > 50)::INT)', 'rate': '60000 / avg(rr)'})} FROM r GROUP BY 1"),
    "time_in_range": (glucose, f"SELECT user_id, {_ROUND5({'mean': 'avg(value)', 'std': 'stddev_samp(value)', 'in_range': '100 * avg((value BETWEEN 5 AND 30)::INT)', 'below': '100 * avg((value < 5)::INT)', 'above': '100 * avg((value > 30)::INT)'})} FROM events GROUP BY 1"),
    "code_rollup": (categories, r"SELECT p_partkey, upper(p_name[1]) || lpad(CAST(p_size AS VARCHAR), 2, '0') AS category, regexp_matches(upper(p_name[1]) || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.1', '^[A-TV-Z][0-9][0-9AB]\.?[0-9A-TV-Z]{0,4}$') AS valid FROM part"),
    "decline_forecast": (forecasts, "WITH w AS (SELECT s_suppkey AS well, s_acctbal + 10000 AS q, 0.1::DOUBLE + s_suppkey % 7 * 0.1::DOUBLE AS d, s_suppkey % 3 * 0.5::DOUBLE AS b FROM supplier) SELECT well, CAST(m AS INTEGER) AS month, round(CASE WHEN b = 0 THEN q * exp(-d * m / 12) ELSE q / pow(1 + b * d * m / 12, 1 / b) END, 4) AS rate FROM w, range(1, 25) r(m)"),
    "downtime_gaps": (gaps, "WITH g AS (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS s, ts FROM events) SELECT user_id, epoch_us(s) AS start, round((epoch_us(ts) - epoch_us(s)) / 3.6e9, 6) AS hours FROM g WHERE (epoch_us(ts) - epoch_us(s)) / 3.6e9 > 36"),
    "corrosion_risk": (corrosion, "WITH a AS (SELECT o_custkey AS f, avg(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS f, avg(o_totalprice) AS x FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT f, round((b.x - a.x) / 2.5, 4) AS rate, round(least((b.x - a.x) / 2.5 / 50000, 1) * 3, 6) AS risk FROM a JOIN b USING (f)"),
    "emissions": (emitted, "SELECT event_type, round(sum(value * CASE event_type WHEN 'view' THEN 2.0 WHEN 'error' THEN 25.0 ELSE 1.0 END * 0.0192), 4) AS co2e, count(*) AS events FROM events GROUP BY 1"),
    "well_logs": (logs, f"SELECT event_id, round({_I}, 6) AS linear, round(0.33 * (pow(2.0, 2 * {_I}) - 1), 6) AS larionov_older, round(0.083 * (pow(2.0, 3.7 * {_I}) - 1), 6) AS larionov_tertiary, round(1.7 - sqrt(3.38 - pow({_I} + 0.7, 2)), 6) AS clavier, round({_I} / (3 - 2 * {_I}), 6) AS steiber, round((2.65 - (2.0 + value / 200)) / 1.65, 6) AS porosity, round(least(1.0, sqrt(0.1 / (pow(greatest((2.65 - (2.0 + value / 200)) / 1.65, 0.05), 2) * (value + 1)))), 6) AS saturation FROM events"),
    "protection_coverage": (coverage, "SELECT user_id, round(avg((value < 10)::INT), 8) AS coverage FROM events GROUP BY 1"),
    "well_path": (
        path,
        """WITH s AS (SELECT user_id AS well, event_id AS md, radians((event_id % 90)::DOUBLE) AS i, radians((event_id % 360)::DOUBLE) AS a FROM events),
p AS (SELECT *, lag(i) OVER w AS i0, lag(a) OVER w AS a0, md - lag(md) OVER w AS l FROM s WINDOW w AS (PARTITION BY well ORDER BY md)), b AS (SELECT *, acos(greatest(-1.0, least(1.0, cos(i - i0) - sin(i0) * sin(i) * (1 - cos(a - a0))))) AS b FROM p),
f AS (SELECT *, CASE WHEN b < 1e-9 THEN 1.0 ELSE 2 / b * tan(b / 2) END * l / 2 AS f FROM b)
SELECT md, round(coalesce(sum(f * (sin(i0) * cos(a0) + sin(i) * cos(a))) OVER w, 0), 2) + 0.0 AS north, round(coalesce(sum(f * (sin(i0) * sin(a0) + sin(i) * sin(a))) OVER w, 0), 2) + 0.0 AS east, round(coalesce(sum(f * (cos(i0) + cos(i))) OVER w, 0), 2) + 0.0 AS tvd FROM f WINDOW w AS (PARTITION BY well ORDER BY md)""",
    ),
    "ranking_report": (
        ranking,
        """WITH r AS (SELECT o_custkey AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, (o_orderstatus = 'F')::INT AS y FROM orders), s AS (SELECT *, sum(y) OVER (PARTITION BY q ORDER BY r) AS seen FROM r),
p AS (SELECT q, sum(y / log2(r + 1)) FILTER (r <= 5) AS dcg, min(r) FILTER (r <= 5 AND y = 1) AS first, sum(y * seen / r) FILTER (r <= 5) AS ap, sum(y) FILTER (r <= 5) AS hits, least(sum(y), 5) AS best FROM s GROUP BY q)
SELECT round(avg(CASE WHEN best > 0 THEN dcg / list_sum(list_transform(range(1, best::BIGINT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END), 8) AS ndcg, round(avg(coalesce(1 / first, 0)), 8) AS mrr, round(avg(CASE WHEN best > 0 THEN ap / best ELSE 0 END), 8) AS map, round(avg(hits / 5), 8) AS precision FROM p""",
    ),
    "fairness_audit": (fairness, f"WITH x AS ({_DPRED}) SELECT lang, count(*) AS n, round(avg(p), 8) AS positive_rate, round(coalesce(avg(p) FILTER (y = 1), -1), 8) AS true_positive_rate, round(coalesce(avg(p) FILTER (y = 0), -1), 8) AS false_positive_rate FROM x GROUP BY 1"),
    "calibration": (calibrated, f"WITH x AS ({_DPRED}) SELECT CAST(least(floor(s * 5), 4) AS INTEGER) AS bin, count(*) AS n, round(avg(s), 8) AS mean_probability, round(avg(y), 8) AS observed FROM x GROUP BY 1"),
    "forecast_report": (forecast_errors, "WITH x AS (SELECT user_id, value AS a, value * 0.9 + 1 AS p, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS n FROM events) SELECT user_id, round(avg(abs(a - p) / nullif(abs(a), 0)), 6) AS mape, round(avg(2 * abs(a - p) / nullif(abs(a) + abs(p), 0)), 6) AS smape, round(avg(abs(a - p)) / avg(n), 6) AS mase FROM x GROUP BY 1"),
    "tf_idf": (weights, "WITH t AS (SELECT conv_id * 1000 + turn AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM conversations), c AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), i AS (SELECT term, ln((1 + (SELECT count(*) FROM conversations)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1) SELECT id, count(*) AS n, round(max(tf * idf), 6) AS top FROM c JOIN i USING (term) GROUP BY 1"),
    "lag_features": (lags, "SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 7) OVER w AS value_lag_7 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
}
