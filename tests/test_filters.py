"""Recursive filters and Kalman estimates, against the recursions step by step."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import filters


def iir(x, b, a):
    y = []
    for n in range(len(x)):
        y.append((sum(b[k] * x[n - k] for k in range(len(b)) if n >= k) - sum(a[k] * y[n - k] for k in range(1, len(a)) if n >= k)) / a[0])
    return y


def kalman(z, q, r, start, p):
    m, out = z[0] if start is None else start, []
    for x in z:
        p += q
        gain = p / (p + r)
        m, p = m + gain * (x - m), (1 - gain) * p
        out.append((m, p))
    return out


def smoother(z, q, r, start, p):
    found = kalman(z, q, r, start, p)
    out = [found[-1]]
    for m, p in found[-2::-1]:
        g = p / (p + q)
        out.append((m + g * (out[-1][0] - m), p + g * g * (out[-1][1] - p - q)))
    return out[::-1]


@pytest.fixture(scope="module")
def series(spark):
    """One series with most rows, some of a row or two, a null series, and rows without a value."""
    rng = random.Random(4)
    rows = [("hot", float(i), rng.gauss(0, 3)) for i in range(900)] + [(f"s{k % 40}", 10.0 * k, rng.gauss(0, 3)) for k in range(70)] + [(None, float(k), float(k)) for k in range(5)] + [("none", 1.0, None)]
    rows += [("hot", i + 0.5, None) for i in range(0, 900, 50)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id string, at double, v double").repartition(7).cache()


def own(series):
    by = {}
    for r in sorted(series.collect(), key=lambda r: r.at):
        if r.v is not None:
            by.setdefault(r.id, []).append(r)
    return by


def checked(got, series, expected, names):
    rows = {(r.id, r.at): r for r in got.collect()}
    assert len(rows) == series.count()
    for key, found in own(series).items():
        for r, e in zip(found, expected([r.v for r in found]), strict=True):
            for name, x in zip(names, np.atleast_1d(e), strict=True):
                assert rows[key, r.at][name] == pytest.approx(x, rel=1e-9, abs=1e-9)
    assert all(r[n] is None for r in rows.values() if r.v is None for n in names)


FILTERS = {"gain": ([2.0], [4.0]), "mean": ([0.3], [1, -0.7]), "second": ([1, 0.5, 0.25], [2, -1.1, 0.6]), "moving": ([1, 2, 3, 4], [1]), "poles": ([1], [1, 0.2, -0.3, 0.1])}


@pytest.mark.parametrize("name", FILTERS)
def test_filters(spark, series, name):
    b, a = FILTERS[name]
    checked(filters.recursive_filter(series, "v", ["at"], [(b, a)], ["id"]), series, lambda x: iir(x, b, a), ["filtered"])


def test_sections_follow_each_other(spark, series):
    two = [FILTERS["second"], FILTERS["poles"]]
    checked(filters.recursive_filter(series, "v", ["at"], two, ["id"], "y"), series, lambda x: iir(iir(x, *two[0]), *two[1]), ["y"])


def test_one_series_over_many_ranges(spark):
    rows = spark.range(20_000).select("id", F.sin(F.col("id") * 0.7).alias("v"))
    got = [r.filtered for r in filters.recursive_filter(rows, "v", ["id"], [FILTERS["second"]]).orderBy("id").collect()]
    assert got == pytest.approx(iir([math.sin(i * 0.7) for i in range(20_000)], *FILTERS["second"]), rel=1e-9, abs=1e-9)
    parts = filters.recursive_filter(rows, "v", ["id"], [FILTERS["second"]]).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and max(p["count"] for p in parts) < 10_000


def test_batches_do_not_matter(spark, series):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "3")
    try:
        checked(filters.kalman_filter(series, "v", ["at"], 0.2, 0.5, ["id"]), series, lambda x: kalman(x, 0.2, 0.5, None, 1.0), ["estimate", "variance"])
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("start", [None, 0.0, 5.0])
def test_kalman(spark, series, start):
    checked(filters.kalman_filter(series, "v", ["at"], 0.05, 2.0, ["id"], start, 3.0), series, lambda x: kalman(x, 0.05, 2.0, start, 3.0), ["estimate", "variance"])
    checked(filters.kalman_smoother(series, "v", ["at"], 0.05, 2.0, ["id"], start, 3.0), series, lambda x: smoother(x, 0.05, 2.0, start, 3.0), ["smoothed", "smoothed_variance"])


def test_empty_and_wrong(spark, series):
    empty = series.limit(0)
    assert filters.kalman_smoother(empty, "v", ["at"], by=["id"]).collect() == []
    assert filters.exponential_smoothing(empty, "v", ["at"], 0.3).columns == ["id", "at", "v", "smoothed"]
    for b, a in (([], [1]), ([1], []), ([1], [0, 1]), ([float("nan")], [1])):
        with pytest.raises(ValueError):
            filters.recursive_filter(series, "v", ["at"], [(b, a)])
    for q, r in ((0, 1), (1, -1)):
        with pytest.raises(ValueError):
            filters.kalman_filter(series, "v", ["at"], q, r)


def gain(sections, f, rate):
    z = np.exp(2j * np.pi * f / rate)
    return abs(np.prod([np.polyval(b, z) / np.polyval(a, z) * z ** (len(a) - len(b)) for b, a in sections]))


@pytest.mark.parametrize("order", range(1, 8))
@pytest.mark.parametrize("kind,cutoff,flat,gone", [("lowpass", 10.0, 0.0, 50.0), ("highpass", 10.0, 50.0, 0.0), ("bandpass", (8.0, 20.0), None, 0.0), ("bandpass", (2.0, 40.0), None, 50.0), ("bandstop", (8.0, 20.0), 0.0, None), ("bandstop", (8.0, 20.0), 50.0, None)])
def test_butterworth(kind, cutoff, flat, gone, order):
    sections = filters.butterworth(kind, cutoff, order, 100.0)
    assert all(len(a) <= 3 and np.all(np.abs(np.roots(a)) < 1) for _, a in sections)
    for edge in np.atleast_1d(cutoff):
        assert gain(sections, edge, 100.0) == pytest.approx(math.sqrt(0.5), rel=1e-6)
    centre = 100 / math.pi * math.atan(math.sqrt(math.prod(math.tan(math.pi * e / 100) for e in np.atleast_1d(cutoff)))) if len(np.atleast_1d(cutoff)) > 1 else None
    assert gain(sections, centre if flat is None else flat, 100.0) == pytest.approx(1, rel=1e-6)
    assert gain(sections, centre if gone is None else gone, 100.0) == pytest.approx(0, abs=1e-5)
    for f in (3.0, 9.0, 15.0, 33.0):  # |H|^2 = 1 / (1 + x^2n)
        w, e = math.tan(math.pi * f / 100), [math.tan(math.pi * c / 100) for c in np.atleast_1d(cutoff)]
        x = w / e[0] if kind == "lowpass" else e[0] / w if kind == "highpass" else (w * w - e[0] * e[1]) / (w * (e[1] - e[0]))
        x = 1 / x if kind == "bandstop" else x
        assert gain(sections, f, 100.0) ** 2 == pytest.approx(1 / (1 + x ** (2 * order)), rel=1e-6)


def test_wrong_designs():
    for kind, cutoff, order in (("lowpass", 60.0, 2), ("lowpass", 0.0, 2), ("allpass", 1.0, 2), ("bandpass", 5.0, 2), ("bandstop", (9.0, 8.0), 2), ("highpass", 5.0, 0)):
        with pytest.raises(ValueError):
            filters.butterworth(kind, cutoff, order, 100.0)
