"""Event and time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import timeseries as S
from millrace.plans.tables import table


def sessions(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return S.sessionize(e, ["user_id"], "ts", 600, ["event_id"]).drop("ts")


def funnel(spark, d):
    return S.funnel(table(spark, d, "events").where("value > 15"), "user_id", "event_type", ["view", "click", "signup"]).withColumn("conversion", F.round("conversion", 8))


def cohorts(spark, d):
    out = S.cohorts(table(spark, d, "events"), "user_id", "ts", "value", 7, "sum")
    return out.select("cohort", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("first_seen"), "period", "users", F.round("metric", 4).alias("metric"))


def resample(kind):
    return lambda spark, d: S.resample(table(spark, d, "events"), "ts", "value", 3600, kind, "event_id").withColumn("value", F.round("value", 6))


def rolling(kind):
    return lambda spark, d: S.rolling(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "ts", "value", 5, kind, ["user_id"], ["event_id"]).select("event_id", F.round("rolling", 6).alias("rolling"))


def late(spark, d):
    # arrival in an order that disagrees with the event's time
    e = table(spark, d, "events").select("user_id", F.expr("event_id + (event_id * 7919) % 13 * 20").alias("k"), "event_id", "ts", "value")
    e = e.withColumn("arrival", F.col("k") * 100000 + F.col("event_id"))
    return S.late_events(e, "arrival", "ts", "value", 86400, 3600, ["user_id"]).withColumn("value", F.round("value", 4))


def windowed(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return S.windowed_deduplicate(e, ["user_id", "event_type"], "ts", 2880, "event_id").select("event_id")


_US = "epoch_us(ts)"
_ROLL = {"mean": "avg(value)", "sum": "sum(value)", "std": "stddev_pop(value)", "max": "max(value)"}
_RE = {"mean": "avg(value)", "sum": "sum(value)", "first": "arg_min(value, event_id)", "last": "arg_max(value, event_id)"}

QUERIES = {
    "sessionize": (
        sessions,
        f"""WITH g AS (SELECT *, CASE WHEN {_US} - lag({_US}) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 36000000000 THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS k FROM g)
SELECT event_id, user_id, CAST(user_id AS VARCHAR) || '_' || CAST(k AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS session_seq FROM s""",
    ),
    "funnel": (
        funnel,
        """WITH u AS (SELECT user_id, max(event_type = 'view') AS a, max(event_type = 'click') AS b, max(event_type = 'signup') AS c FROM events WHERE value > 15 GROUP BY 1),
n AS (SELECT count(*) FILTER (a) AS x, count(*) FILTER (a AND b) AS y, count(*) FILTER (a AND b AND c) AS z FROM u)
SELECT 1::BIGINT AS step, 'view' AS event, x AS users, NULL::DOUBLE AS conversion FROM n UNION ALL
SELECT 2, 'click', y, round(y / nullif(x, 0), 8) FROM n UNION ALL SELECT 3, 'signup', z, round(z / nullif(y, 0), 8) FROM n""",
    ),
    "cohort_retention": (
        cohorts,
        f"""WITH f AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first_seen FROM events)
SELECT strftime(first_seen, '%Y-%m-%d') AS cohort, epoch_us(first_seen) AS first_seen, CAST(floor(({_US} - epoch_us(first_seen)) / 604800000000) AS BIGINT) AS period,
 count(DISTINCT user_id) AS users, round(sum(value), 4) AS metric FROM f GROUP BY f.first_seen, 3""",
    ),
    **{f"resample_{k}": (resample(k), f"SELECT CAST(floor({_US} / 3600000000) AS BIGINT) * 3600 AS bucket, round({_RE[k]}, 6) AS value FROM events GROUP BY 1") for k in _RE},
    **{f"rolling_{k}": (rolling(k), f"SELECT event_id, round({_ROLL[k]} OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events") for k in _ROLL},
    "late_events": (
        late,
        f"""WITH a AS (SELECT user_id, (event_id + (event_id * 7919) % 13 * 20) * 100000 + event_id AS arrival, {_US} AS t, value FROM events),
m AS (SELECT *, CAST(floor(t / 86400000000) AS BIGINT) * 86400 AS bucket, t < max(t) OVER (PARTITION BY user_id ORDER BY arrival) - 3600000000 AS is_late FROM a),
r AS (SELECT *, sum(value) OVER (PARTITION BY user_id, bucket ORDER BY arrival) AS running FROM m)
SELECT user_id, 'event' AS kind, arrival, bucket, round(value, 4) AS value, is_late FROM r UNION ALL
SELECT user_id, 'correction', max(arrival), bucket, round(arg_max(running, arrival), 4), true FROM r WHERE is_late GROUP BY user_id, bucket""",
    ),
    "windowed_deduplicate": (
        windowed,
        """WITH RECURSIVE k AS (
 SELECT user_id, event_type, arg_min(event_id, ts) AS event_id, min(ts) AS ts FROM events GROUP BY 1, 2
 UNION ALL
 SELECT k.user_id, k.event_type, arg_min(e.event_id, e.ts), min(e.ts) FROM k JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 2880 MINUTE GROUP BY k.user_id, k.event_type, k.event_id
) SELECT event_id FROM k""",
    ),
}
