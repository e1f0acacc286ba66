"""Anomaly scores, clusters and recommendations of planted structure."""

import random

import numpy as np
import pytest

from millrace.operators import models as M

ROWS = "id long, a double, b double"


@pytest.fixture(scope="module")
def points():
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 2)) for i in range(1500)]
    return rows + [(9000 + k, 12.0 + k, -9.0 - 3 * k) for k in range(5)] + [(9100, None, 1.0), (9101, float("nan"), 1.0), (9102, float("inf"), 1.0)]


def test_planted_outliers_come_first_on_every_run(spark, points):
    made = []
    for parts in (1, 5):
        shuffled = random.Random(parts).sample(points, len(points))
        got = M.anomaly_scores(spark.createDataFrame(shuffled, ROWS).repartition(parts), ["id"], ["a", "b"], trees=40, sample=64)
        made.append({r.id: r.anomaly for r in got.collect()})
    assert made[0] == made[1] and len(made[0]) == len(points)
    assert {i for i, s in made[0].items() if s is None} == {9100, 9101, 9102}
    ranked = sorted((s, i) for i, s in made[0].items() if s is not None)[::-1]
    assert {i for _, i in ranked[:5]} == {9000, 9001, 9002, 9003, 9004} and ranked[4][0] > 0.6
    assert np.median([s for s, _ in ranked]) < 0.5


def test_trees_are_bounded_and_part_their_sample(spark, points):
    grown = M.isolation_trees(spark.createDataFrame(points, ROWS), ["id"], ["a", "b"], trees=5, sample=32).toPandas()
    for _, own in grown.groupby("tree"):
        leaves = own[own["feature"] < 0]
        assert leaves["size"].sum() == 32 and own["depth"].max() <= 5 and len(own) <= 63
    same = spark.createDataFrame([(i, 1.0, 1.0) for i in range(50)], ROWS)
    assert {round(r.anomaly, 6) for r in M.anomaly_scores(same, ["id"], ["a", "b"], 3, 10).collect()} == {0.5}
    assert M.anomaly_scores(same.limit(0), ["id"], ["a", "b"], 3, 10).collect() == []
    assert [r.anomaly for r in M.anomaly_scores(same.where("id = 3"), ["id"], ["a", "b"], 3, 10).collect()] == [None]


def test_clusters(spark):
    rng = random.Random(1)
    rows = [(i, [0.0, 50.0, 9.0][i % 3] + rng.gauss(0, 0.3), [0.0, 1.0, 900.0][i % 3] + rng.gauss(0, 0.3)) for i in range(300)] + [(900, None, 1.0)]
    got = {r.id: r.cluster for r in M.clusters(spark.createDataFrame(rows, ROWS), ["a", "b"], 3).collect()}
    assert len(got) == 301 and got[900] is None
    assert len({(i % 3, got[i]) for i in range(300)}) == 3


def test_recommendations(spark):
    rng = random.Random(2)
    rows = [(u, i, 5.0 if u % 2 == i % 2 else 1.0) for u in range(40) for i in range(30) if rng.random() < 0.6] + [(None, 1, 5.0)]
    got = M.recommendations(spark.createDataFrame(rows, "u int, i int, r double"), "u", "i", "r", 5).collect()
    assert len(got) == 200 and {r.place for r in got} == {1, 2, 3, 4, 5}
    assert all(r.i % 2 == r.u % 2 and r.score > 4 for r in got)
