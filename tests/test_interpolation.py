"""Interpolated values of tables against every section."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import production as P


@pytest.mark.parametrize("part", [100_000, 7])
def test_interpolated(spark, monkeypatch, part):
    monkeypatch.setattr(P, "PART", part)
    rng = random.Random(3)
    table = {f: sorted((float(x), rng.uniform(0, 9)) for x in rng.sample(range(30), 6)) for f in (0, 1, None)}
    asked = [(i, rng.choice([0, 1, 2, None]), rng.choice([rng.uniform(-3, 33), float(rng.randrange(30))])) for i in range(150)]
    known = spark.createDataFrame([(f, x, y) for f, points in table.items() for x, y in points] + [(0, 3.5, None)], "f long, x double, y double")
    got = {r.id: r.value for r in P.interpolated(spark.createDataFrame(asked, "id long, f long, at double"), ["f"], "at", known, "x", "y", "value").collect()}
    assert len(got) == len(asked)
    for i, f, at in asked:
        points = table.get(f)
        if not points:
            assert got[i] is None
            continue
        low, high = [p for p in points if p[0] <= at], [p for p in points if p[0] > at]
        a, b = (low or high[:1])[-1], (high or low[-1:])[0]
        expected = a[1] if a == b or not low else a[1] + (b[1] - a[1]) * (at - a[0]) / (b[0] - a[0])
        assert got[i] == pytest.approx(expected, rel=1e-12)


def test_rows_of_one_fluid_take_no_square_of_time(spark):
    """Half a million rows of one fluid; looking ahead from each through all that follow would not end in an hour."""
    asked = spark.range(500_000).select("id", F.lit(0).cast("long").alias("f"), (F.col("id") % 997 / 10).alias("at"))
    known = spark.createDataFrame([(0, 0.0, 0.0), (0, 50.0, 100.0), (0, 99.6, 199.2)], "f long, x double, y double")
    got = P.interpolated(asked, ["f"], "at", known, "x", "y", "value")
    assert got.where(F.abs(F.col("value") - 2 * F.col("at")) > 1e-9).isEmpty()
