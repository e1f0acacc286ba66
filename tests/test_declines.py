"""Decline curves: planted ones are found, noisy ones are least squares."""

import math
import random

import numpy as np
import pytest

from millrace.operators import declines as D

ROWS = "well string, t double, q double"


def curve(qi, d, b, t):
    return qi * (1 + b * d * t) ** (-1 / b)


@pytest.fixture(scope="module")
def wells():
    rng = random.Random(5)
    planted = {f"w{k}": (rng.uniform(10, 5000), rng.uniform(0.0002, 0.01), rng.uniform(0.05, 0.95)) for k in range(40)}
    planted["hot"] = (800.0, 0.003, 0.4)
    rows = [(w, 30.0 * i, curve(*p, 30.0 * i)) for w, p in planted.items() for i in range(600 if w == "hot" else 60)]
    rows += [(None, 30.0 * i, curve(90.0, 0.002, 0.3, 30.0 * i)) for i in range(50)]
    rows += [("one", 0.0, 7.0), ("gap", 0.0, None), ("gap", None, 5.0), ("w0", None, 1.0), ("w0", 3.0, None), ("few", 0.0, 9.0), ("few", 10.0, 8.0), ("few", 20.0, 7.0)]
    rng.shuffle(rows)
    return planted, rows


def test_planted_curves_are_found(spark, wells):
    planted, rows = wells
    got = {r.well: r for r in D.hyperbolic_decline(spark.createDataFrame(rows, ROWS), ["well"], "t", "q").collect()}
    assert set(got) == {*planted, None, "one", "gap", "few"}
    for well, (qi, d, b) in [*planted.items(), (None, (90.0, 0.002, 0.3))]:
        r = got[well]
        assert r.converged and (r.qi, r.di_per_year, r.b) == (pytest.approx(qi, rel=1e-6), pytest.approx(d * 365, rel=1e-6), pytest.approx(b, rel=1e-6)), well
    assert (got["one"].qi, got["one"].di_per_year, got["one"].b, got["one"].converged) == (7.0, 0.0, 0.0, False)
    assert (got["gap"].qi, got["gap"].converged, got["gap"].sse) == (0.0, False, None)
    assert not got["few"].converged and got["few"].b == 0.0


@pytest.mark.parametrize("whole,together", [(100_000, 100_000), (100_000, 1), (100, 130), (0, 1)])
def test_wells_are_fitted_whole_or_by_rounds(spark, monkeypatch, whole, together):
    monkeypatch.setattr(D, "WHOLE", whole)
    monkeypatch.setattr(D, "TOGETHER", together)
    planted = {f"w{k}": (10.0 + k, 0.0005 * (k + 1), 0.1 + 0.1 * k) for k in range(6)}
    rows = [(w, 30.0 * i, curve(*p, 30.0 * i)) for w, p in planted.items() for i in range(160 if w == "w3" else 40)] + [("few", 0.0, 9.0), ("few", 10.0, 8.0)]
    got = {r.well: r for r in D.hyperbolic_decline(spark.createDataFrame(rows, ROWS).repartition(3), ["well"], "t", "q").collect()}
    assert set(got) == {*planted, "few"} and not got["few"].converged
    for well, (qi, d, b) in planted.items():
        assert got[well].converged and (got[well].qi, got[well].di_per_year, got[well].b) == pytest.approx((qi, d * 365, b), rel=1e-6)


def test_noisy_curves_are_least_squares(spark):
    """At the minimum the residuals are orthogonal to every free derivative, and no neighbour is better."""
    rng = random.Random(6)
    rows = [(f"n{k}", 30.0 * i, curve(100.0 + k, 0.002, 0.5, 30.0 * i) * (1 + rng.gauss(0, 0.03))) for k in range(15) for i in range(80)]
    rows += [("steep", 10.0 * i, 100 * math.exp(-0.01 * 10 * i)) for i in range(60)]  # exponential: b goes to its bound
    own = {}
    for w, t, q in rows:
        own.setdefault(w, []).append((t, q))
    for r in D.hyperbolic_decline(spark.createDataFrame(rows, ROWS), ["well"], "t", "q").collect():
        t, q = np.array(own[r.well]).T
        sse = lambda p: float(((q - curve(*p, t)) ** 2).sum())
        at = (r.qi, r.di_per_year / 365, r.b)
        assert r.converged and r.sse == pytest.approx(sse(at), rel=1e-6, abs=1e-12)
        for i in range(3):
            for f in (0.999, 1.001):
                p = list(at)
                p[i] = min(max(p[i] * f, D.LOW[i]), D.HIGH[i])
                assert sse(p) >= sse(at) * (1 - 1e-9) - 1e-9
        if r.well == "steep":
            assert r.b < 1e-3 and r.di_per_year == pytest.approx(3.65, rel=1e-3)


def test_straight_lines(spark):
    rows = [("e", 10.0 * i, 50 * math.exp(-0.004 * 10 * i)) for i in range(30)] + [("h", 10.0 * i, 50 / (1 + 0.004 * 10 * i)) for i in range(30)] + [("one", 5.0, 3.0), ("same", 5.0, 3.0), ("same", 5.0, 5.0), ("none", None, None)]
    df = spark.createDataFrame(rows, ROWS)
    got = {r.well: (r.qi, r.di_per_year, r.b) for r in D.straight_decline(df, ["well"], "t", "q", "exponential").collect()}
    assert got["e"] == (pytest.approx(50, rel=1e-6), pytest.approx(1.46, rel=1e-6), 0.0)
    assert (got["one"], got["same"], got["none"]) == ((3.0, 0.0, 0.0), (4.0, 0.0, 0.0), (0.0, 0.0, 0.0))
    got = {r.well: (r.qi, r.di_per_year, r.b) for r in D.straight_decline(df, ["well"], "t", "q", "harmonic").collect()}
    assert got["h"] == (pytest.approx(50, rel=1e-6), pytest.approx(1.46, rel=1e-6), 1.0)
    assert D.hyperbolic_decline(df.limit(0), ["well"], "t", "q").collect() == []
    with pytest.raises(ValueError):
        D.straight_decline(df, ["well"], "t", "q", "cubic")
