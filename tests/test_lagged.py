"""Sample entropy, autoregression and alignment against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import blocks
from millrace.operators import lagged as G

ROWS = "id string, at long, x double, y double"


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(9)
    rows = [("hot", i, math.sin(i / 3) + rng.gauss(0, 0.2), 0.0) for i in range(260)]
    rows += [(f"s{k}", i, rng.choice([0.0, 0.5, 1.0, 7.5]), 0.0) for k in range(6) for i in range(rng.randint(1, 30))]
    rows += [("flat", i, 1.0, 1.0) for i in range(12)] + [(None, i, float(i % 3), 0.0) for i in range(20)] + [("none", 0, None, 1.0), ("far", 0, -1e9, 0.0), ("far", 1, 1e9, 0.0), ("far", 2, 1e9, 0.0)]
    rng.shuffle(rows)
    return rows


def own(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], [])
        if r[2] is not None:
            out[r[0]].append(r)
    return out


def phi(x, m, tolerance):
    return sum(1 for i in range(len(x) - m) for j in range(len(x) - m) if i != j and max(abs(x[i + k] - x[j + k]) for k in range(m)) < tolerance)


@pytest.mark.parametrize("length,tolerance,size,group", [(2, 0.3, 4096, 512), (1, 0.5, 50, 16), (3, 0.6, 64, 7)])
def test_sample_entropy(spark, series, monkeypatch, length, tolerance, size, group):
    monkeypatch.setattr(blocks, "SIZE", size)
    monkeypatch.setattr(G, "GROUP", group)
    got = {r.id: r for r in G.sample_entropy(spark.createDataFrame(series, ROWS), ["id"], ["at"], "x", length, tolerance).collect()}
    assert set(got) == set(own(series))
    for key, rows in own(series).items():
        x = [r[2] for r in rows]
        n, more = phi(x, length, tolerance), phi(x, length + 1, tolerance)
        assert (got[key].matches, got[key].longer) == (n, more), key
        assert got[key].sample_entropy == pytest.approx(0.0 if not n else math.inf if not more else -math.log(more / n))


@pytest.mark.parametrize("size", [4096, 40])
def test_autoregression(spark, series, monkeypatch, size):
    monkeypatch.setattr(blocks, "SIZE", size)
    df = spark.createDataFrame(series, ROWS)
    for lags in (1, 3):
        for method in ("yule_walker", "ols"):
            got = {r.id: r for r in G.autoregression(df, ["id"], ["at"], "x", lags, method).collect()}
            for key, rows in own(series).items():
                x = np.array([r[2] for r in rows])
                assert got[key].n == len(x)
                if len(x) <= lags:
                    assert got[key].coefficients is None and got[key].variance is None
                    continue
                past = np.array([[x[n - k] for k in range(1, lags + 1)] for n in range(lags, len(x))])
                if method == "ols":
                    a = np.linalg.lstsq(past.T @ past, past.T @ x[lags:], rcond=None)[0]
                else:
                    r = np.array([x[: len(x) - k] @ x[k:] for k in range(lags + 1)])
                    a = np.linalg.lstsq(np.array([[r[abs(i - j)] for j in range(lags)] for i in range(lags)]), r[1:], rcond=None)[0]
                if key in ("hot", "s0", "s1", "s2"):
                    assert got[key].coefficients == pytest.approx(list(a), rel=1e-6, abs=1e-9)
                c = np.array(got[key].coefficients)
                assert got[key].variance == pytest.approx(np.var(x[lags:] - past @ c), rel=1e-6, abs=1e-6 * max(1, float(x @ x)))


@pytest.mark.parametrize("size", [4096, 64])
def test_planted_lags(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "SIZE", size)
    rng = random.Random(3)
    rows, planted = [], {"a": 0, "b": 7, "c": -12, "d": 20}
    for key, lag in planted.items():
        x = [rng.gauss(0, 1) for _ in range(150)]
        rows += [(key, n, x[n], x[n + lag] if 0 <= n + lag < 150 else 0.0) for n in range(150)]
    df = spark.createDataFrame(rows, ROWS)
    got = {r.id: r for r in G.best_lag(df, ["id"], ["at"], "x", "y", 20).collect()}
    assert {k: r.lag for k, r in got.items()} == planted
    moved = {}
    for r in G.aligned(df, ["id"], ["at"], "x", "y", 20).orderBy("n").collect():
        moved.setdefault(r.key, []).append((r.reference, r.aligned))
    for key, lag in planted.items():
        pairs = moved[f'{{"id":"{key}"}}']
        x, y = [p[0] for p in pairs], [r[3] for r in rows if r[0] == key]
        assert [p[1] for p in pairs] == [y[n - lag] if 0 <= n - lag < 150 else 0.0 for n in range(150)]
        assert got[key].score == pytest.approx(sum(x[n + lag] * y[n] for n in range(150) if 0 <= n + lag < 150))


def test_nothing_and_wrong_calls(spark, series):
    empty = spark.createDataFrame([], ROWS)
    assert G.sample_entropy(empty, ["id"], ["at"], "x").collect() == []
    assert G.autoregression(empty, ["id"], ["at"], "x", 2).collect() == []
    assert G.best_lag(empty, ["id"], ["at"], "x", "y", 2).collect() == []
    for call in (lambda: G.sample_entropy(empty, ["id"], ["at"], "x", 0), lambda: G.sample_entropy(empty, ["id"], ["at"], "x", 2, 0.0), lambda: G.autoregression(empty, ["id"], ["at"], "x", 2, "burg"), lambda: G.best_lag(empty, ["id"], ["at"], "x", "y", 0)):
        with pytest.raises(ValueError):
            call()


def ssa(x, window, count):
    columns = len(x) - window + 1
    u, s, vt = np.linalg.svd(np.array([x[i : i + window] for i in range(columns)]).T, full_matrices=False)
    out = []
    for k in range(min(count, len(s))):
        one, total, held = s[k] * np.outer(u[:, k], vt[k]), np.zeros(len(x)), np.zeros(len(x))
        for c in range(columns):
            total[c : c + window] += one[:, c]
            held[c : c + window] += 1
        out.append(total / held)
    return np.array(out)


@pytest.mark.parametrize("size", [4096, 32])
def test_singular_spectrum(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "SIZE", size)
    rng = random.Random(12)
    series = {k: [10 * math.sin(i / (3 + k)) + 3 * math.cos(i) + 0.1 * i + rng.gauss(0, 0.3) for i in range(70 + 15 * k)] for k in range(3)} | {7: [1.0, 2.0, 4.0], 8: [1.0, 2.0]}
    rows = [(str(k), i, v, 0.0) for k, x in series.items() for i, v in enumerate(x)] + [("0", 900, None, 0.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ROWS)
    found = {}
    for r in G.singular_spectrum(df, ["id"], ["at"], "x", 3, 3).orderBy("n").collect():
        found.setdefault((r.id, r.component), []).append(r.part)
    assert {k for k, _ in found} == {"0", "1", "2", "7"}
    for k in ("0", "1", "2", "7"):
        assert np.sum([found[k, c] for c in range(3)], axis=0) == pytest.approx(series[int(k)], abs=1e-9)
    got = {}
    for r in G.singular_spectrum(df, ["id"], ["at"], "x", 12, 2).orderBy("n").collect():
        got.setdefault((r.id, r.component), []).append(r.part)
    for k in range(3):
        for c, part in enumerate(ssa(np.array(series[k]), 12, 2)):
            assert got[str(k), c] == pytest.approx(list(part), abs=1e-7)
    assert G.singular_spectrum(df.limit(0), ["id"], ["at"], "x", 3, 1).collect() == []
    for bad in ((1, 1), (3, 4), (3, 0)):
        with pytest.raises(ValueError):
            G.singular_spectrum(df, ["id"], ["at"], "x", *bad)


def test_spectra_of_windows_as_long_as_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SIZE", 8)
    rng = random.Random(3)
    # A window's rows lie in up to three blocks; one series is as long as the window, one shorter, one has no name.
    series = {None: 30, "a": 9, "b": 8, "c": 61, "d": 3}
    series = {k: [4 * math.sin(i / 2) + rng.gauss(0, 1) for i in range(n)] for k, n in series.items()}
    rows = [(k, i, v, 0.0) for k, x in series.items() for i, v in enumerate(x)]
    # Equal rows count each; rows without a value do not.
    rows += [("e", i // 2, float(i // 2 % 5), 0.0) for i in range(24)] + [("e", 4, None, 0.0), ("f", 1, None, 0.0), (None, 3, None, 0.0)]
    series["e"] = [float(i // 2 % 5) for i in range(24)]
    rng.shuffle(rows)
    made = G.singular_spectrum(spark.createDataFrame(rows, ROWS), ["id"], ["at"], "x", 9, 2)
    got = {}
    for r in made.orderBy("n").collect():
        got.setdefault((r.id, r.component), []).append((r.value, r.part))
    assert set(got) == {(k, c) for k in (None, "a", "c", "e") for c in (0, 1)}
    for k in (None, "a", "c", "e"):
        for c, part in enumerate(ssa(np.array(series[k]), 9, 2)):
            assert [v for v, _ in got[k, c]] == series[k]
            assert [p for _, p in got[k, c]] == pytest.approx(list(part), abs=1e-7)
    # Parts are whole within their block: no sums by place go through a shuffle, and no windows meet their bases.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [n#" not in plan and plan.count("Join Inner") == 3


def test_spectra_keep_the_columns_of_their_series(spark):
    x = [1.0, 3.0, 2.0, 5.0, 4.0]
    rows = [(k, [k], i, v) for k in (1, 2, None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, many array<int>, at long, x double")
    # Times that differ by less than JSON shows are one series, whose rows come for each of them.
    df = df.withColumn("ts", F.timestamp_micros(F.coalesce("k", F.lit(3)).cast("long")))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    for by, each in ((["k"], 1), (["many"], 1), (["k", "many"], 1), (["ts"], 3), ([], 1)):
        made = G.singular_spectrum(df, by, ["k", "at"], "x", 3, 3)
        assert made.columns == [*by, "n", "value", "component", "part"]
        assert [f.dataType for f in made.schema.fields[: len(by)]] == [df.schema[c].dataType for c in by]
        got = made.collect()
        assert len(got) == 15 * 3 * each
        assert {str([r[c] for c in by]) for r in got} == {str([r[c] for c in by]) for r in df.collect()}
        # The result itself is not joined, unless a column cannot go through Arrow as it is.
        assert ("Join" in plan(made).split("MapInArrow")[0]) == ("many" in by)
