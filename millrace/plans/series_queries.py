"""Queries of series: filters and Kalman estimates, per user and over one order of all events; fitted declines, sample entropy, autoregression and alignment."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from millrace.operators import declines as D, filters as R, lagged as G
from millrace.plans.tables import sql, table

#: Coefficients of many digits: results do not lie on the border of rounding.
_B, _A = (math.sqrt(2) / 7, math.sqrt(3) / 6, math.sqrt(5) / 19), (1.0, -math.sqrt(7) / 5, math.sqrt(11) / 16)
_Q, _R = 0.5, 4.0


def _values(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value")


def _shown(df, *names):
    return df.select("event_id", *[F.round(n, 6).alias(n) for n in names])


def filtered(by):
    return lambda spark, d: _shown(R.recursive_filter(_values(spark, d), "value", ["ts", "event_id"], [(_B, _A)], by), "filtered")


def causal_lowpass(spark, d):
    """A first-order Butterworth filter in two sections' worth of state: two of them in a row."""
    once = R.butterworth("lowpass", 1.0, 1, 8.0)
    return _shown(R.recursive_filter(_values(spark, d), "value", ["ts", "event_id"], once + once, ["user_id"]), "filtered")


def kalman(spark, d):
    return _shown(R.kalman_filter(_values(spark, d), "value", ["ts", "event_id"], _Q, _R, ["user_id"]), "estimate", "variance")


def smoother(spark, d):
    return _shown(R.kalman_smoother(_values(spark, d), "value", ["ts", "event_id"], by=["user_id"]), "smoothed", "smoothed_variance")


_RATES = "SELECT user_id, CAST(event_id % 400 AS DOUBLE) AS days, value + 5 AS value FROM events"
# Curves without noise: a fit gives back what made them.
_PLANTED = "SELECT c_custkey, 50.0 + c_custkey % 97 AS qi, (1 + c_custkey % 9) / 2000.0 AS d, (10 + c_custkey % 80) / 100.0 AS b FROM customer"


def straight(method):
    def run(spark, d):
        out = D.straight_decline(sql(spark, d, _RATES, "events"), ["user_id"], "days", "value", method)
        return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("qi", "di_per_year", "b")])

    return run


def hyperbolic(spark, d):
    curve = F.expr("CAST(qi AS DOUBLE) * pow(1 + CAST(b AS DOUBLE) * CAST(d AS DOUBLE) * days, -1 / CAST(b AS DOUBLE))")
    wells = sql(spark, d, _PLANTED, "customer").withColumn("days", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("days", F.col("days") * 30.0)
    out = D.hyperbolic_decline(wells.select("c_custkey", "days", curve.alias("q")), ["c_custkey"], "days", "q")
    return out.select("c_custkey", *[F.round(c, 4).alias(c) for c in ("qi", "di_per_year", "b")], "converged")


def entropies(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "x"))
    return G.sample_entropy(rows, ["vec_id"], ["at"], "x", 2, 0.05).withColumn("sample_entropy", F.round(F.col("sample_entropy") + 0.0, 6))


def autoregressive(method):
    def run(spark, d):
        out = G.autoregression(_values(spark, d), ["user_id"], ["ts", "event_id"], "value", 2, method)
        return out.select("user_id", "n", *[F.round(F.get("coefficients", F.lit(i)), 6).alias(f"a{i + 1}") for i in (0, 1)])

    return run


_SHIFTED = "SELECT user_id, event_id, ts, value - 10 AS r, coalesce(lead(value - 10, CAST(3 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS t FROM events"


def lags(spark, d):
    out = G.best_lag(sql(spark, d, _SHIFTED, "events"), ["user_id"], ["ts", "event_id"], "r", "t", 5)
    return out.select("user_id", "lag", F.round("score", 4).alias("score"))


def spectra(spark, d):
    """All parts of every user's series, which sum to it."""
    out = G.singular_spectrum(_values(spark, d), ["user_id"], ["ts", "event_id"], "value", 4, 4)
    return out.groupBy("user_id", "n").agg(F.round(F.sum("part"), 6).alias("total"), F.count(F.lit(1)).alias("parts")).drop("n")


_ORDERED = "o AS MATERIALIZED (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


def _recursion(state: str, first: str, step: str, shown: str) -> str:
    """SQL of a recursion by user: columns of the state, their first values of o, and their next ones of r and o."""
    return f"WITH RECURSIVE {_ORDERED}, r(user_id, event_id, i, {state}) AS (SELECT user_id, event_id, i, {first} FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, {step} FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) {shown}"


_NEXT = "{b0} * {x} + {b1} * x1 + {b2} * x2 - {a1} * y1 - {a2} * y2"
_COEFFICIENTS = {"b0": _B[0], "b1": _B[1], "b2": _B[2], "a1": _A[1], "a2": _A[2]}
_STEP = _NEXT.format(x="o.value", **_COEFFICIENTS)


def _kalman_sql(q: float, r: float, start: str) -> tuple[str, str, str]:
    """State (m, p), first values and step of the scalar filter; the prior variance is 1."""
    gain = lambda p: f"(({p} + {q}) / ({p} + {q} + {r}))"
    one = gain("1.0::DOUBLE")
    return "m, p", f"{start} + {one} * (value - {start}), (1 - {one}) * (1.0::DOUBLE + {q})", f"r.m + {gain('r.p')} * (o.value - r.m), (1 - {gain('r.p')}) * (r.p + {q})"


# A one-pole low-pass with unit gain at zero and none at half the rate: both coefficients of the numerator are equal.
_POLE = "((1 - tan(pi() / 8)) / (1 + tan(pi() / 8)))"
_HALF = f"((1 - {_POLE}) / 2)"
_ONE = f"{_HALF} * (o.value + x1) + {_POLE} * y1"

QUERIES = {
    "recursive_filter": (
        filtered(["user_id"]),
        _recursion("x1, x2, y1, y2", f"value, 0.0::DOUBLE, {_B[0]} * value, 0.0::DOUBLE", f"o.value, x1, {_STEP}, y1", "SELECT event_id, round(y1, 6) AS filtered FROM r"),
    ),
    "recursive_filter_whole": (
        filtered([]),
        f"""WITH RECURSIVE l AS MATERIALIZED (SELECT list(value ORDER BY ts, event_id) AS v, list(event_id ORDER BY ts, event_id) AS e FROM events),
r(i, x1, x2, y1, y2) AS (SELECT 1, v[1], 0.0::DOUBLE, {_B[0]} * v[1], 0.0::DOUBLE FROM l WHERE len(v) > 0 UNION ALL SELECT i + 1, v[i + 1], x1, {_NEXT.format(x="v[i + 1]", **_COEFFICIENTS)}, y1 FROM r, l WHERE i < len(v))
SELECT e[i] AS event_id, round(y1, 6) AS filtered FROM r, l""",
    ),
    "causal_lowpass": (
        causal_lowpass,
        _recursion("x1, y1, z1", f"value, {_HALF} * value, {_HALF} * {_HALF} * value", f"o.value, {_ONE}, {_HALF} * ({_ONE} + y1) + {_POLE} * z1", "SELECT event_id, round(z1, 6) AS filtered FROM r"),
    ),
    "kalman_filter": (kalman, _recursion(*_kalman_sql(_Q, _R, "value"), "SELECT event_id, round(m, 6) AS estimate, round(p, 6) AS variance FROM r")),
    "kalman_smoother": (
        smoother,
        _recursion(*_kalman_sql(0.01, 1.0, "0.0::DOUBLE"), """, n AS (SELECT user_id, max(i) AS n FROM r GROUP BY 1),
s(user_id, event_id, i, m, p) AS (SELECT r.* FROM r JOIN n ON r.user_id = n.user_id AND r.i = n.n UNION ALL
SELECT r.user_id, r.event_id, r.i, r.m + r.p / (r.p + 0.01) * (s.m - r.m), r.p + pow(r.p / (r.p + 0.01), 2) * (s.p - r.p - 0.01) FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i - 1)
SELECT event_id, round(m, 6) AS smoothed, round(p, 6) AS smoothed_variance FROM s"""),
    ),
    "decline_exponential": (straight("exponential"), f"SELECT user_id, round(exp(regr_intercept(ln(value + 1e-9), days)), 6) AS qi, round(-365 * regr_slope(ln(value + 1e-9), days), 6) AS di_per_year, 0.0::DOUBLE AS b FROM ({_RATES}) WHERE value + 1e-9 > 0 GROUP BY 1"),
    "decline_harmonic": (straight("harmonic"), f"SELECT user_id, round(1 / greatest(regr_intercept(1 / (value + 1e-9), days), 1e-9), 6) AS qi, round(365 * regr_slope(1 / (value + 1e-9), days) / greatest(regr_intercept(1 / (value + 1e-9), days), 1e-9), 6) AS di_per_year, 1.0::DOUBLE AS b FROM ({_RATES}) GROUP BY 1"),
    "decline_hyperbolic": (hyperbolic, f"SELECT c_custkey, round(qi, 4)::DOUBLE AS qi, round(d * 365, 4)::DOUBLE AS di_per_year, round(b, 4)::DOUBLE AS b, true AS converged FROM ({_PLANTED})"),
    "sample_entropy": (
        entropies,
        """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), m AS (SELECT vec_id, count(*) FILTER (near) AS matches, count(*) FILTER (near AND i <= len(x) - 3 AND j <= len(x) - 3 AND abs(x[i + 2] - x[j + 2]) < 0.05::DOUBLE) AS longer
FROM (SELECT *, greatest(abs(x[i] - x[j]), abs(x[i + 1] - x[j + 1])) < 0.05::DOUBLE AS near FROM v, range(1, 63) a(i), range(1, 63) b(j) WHERE i <> j) GROUP BY 1)
SELECT vec_id, matches, longer, CASE WHEN matches = 0 THEN 0.0 WHEN longer = 0 THEN 'inf'::DOUBLE ELSE round(-ln(longer / matches) + 0.0, 6) END AS sample_entropy FROM m""",
    ),
    **{
        f"autoregression_{k}": (
            autoregressive(k),
            f"""WITH w AS (SELECT user_id, value AS x, lag(value) OVER o AS y, lag(value, 2) OVER o AS z FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, count(*) AS n, {moments} FROM w GROUP BY 1) SELECT user_id, n, round((q * a - r * b) / (p * q - r * r), 6) AS a1, round((p * b - r * a) / (p * q - r * r), 6) AS a2 FROM s""",
        )
        for k, moments in (
            ("ols", "sum(y * y) FILTER (z IS NOT NULL) AS p, sum(z * z) AS q, sum(y * z) AS r, sum(x * y) FILTER (z IS NOT NULL) AS a, sum(x * z) AS b"),
            ("yule_walker", "sum(x * x) AS p, sum(x * x) AS q, sum(x * y) AS r, sum(x * y) AS a, sum(x * z) AS b"),
        )
    },
    "singular_spectrum": (spectra, "SELECT user_id, round(value, 6) AS total, 4 AS parts FROM events QUALIFY count(*) OVER (PARTITION BY user_id) >= 4"),
    "best_lag": (
        lags,
        f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ({_SHIFTED})), c AS (SELECT a.user_id, l AS lag, sum(CASE WHEN b.r IS NOT NULL THEN b.r * a.t ELSE 0 END) AS s FROM o a CROSS JOIN range(-5, 6) k(l) LEFT JOIN o b ON b.user_id = a.user_id AND b.i = a.i + l GROUP BY 1, 2)
SELECT user_id, arg_max(lag, (s, -lag)) AS lag, round(max(s), 4) AS score FROM c GROUP BY 1""",
    ),
}
