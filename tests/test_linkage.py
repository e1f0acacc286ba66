"""Blocks of similar values and combined keys against every comparison; rolling statistics and windows over one order."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import learning as L, linkage as K, timeseries as S


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def names():
    rng = random.Random(8)
    bases = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 14))) for _ in range(25)]
    made = [None, "", "A", "none", "None"]
    for _ in range(130):
        b = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2])):
            b[rng.randrange(len(b))] = rng.choice(["", "x", "b", "Ab"])
        made.append("".join(b))
    return list(enumerate(made, 3))


@pytest.mark.parametrize("group", [1000, 4])
@pytest.mark.parametrize("prefix,threshold", [(1, 0.8), (1, 0.5), (2, 1.0)])
def test_fuzzy_pairs(spark, names, monkeypatch, group, prefix, threshold):
    monkeypatch.setattr(K, "GROUP", group)
    values = {}
    for i, v in names:
        values.setdefault("none" if v is None else v.lower(), []).append(i)
    score = lambda a, b: 1.0 if not a and not b else 1 - edit(a, b) / max(len(a), len(b))
    expected = {(*sorted((p[0], q[0])), round(score(a, b), 9)) for (a, p), (b, q) in itertools.combinations(values.items(), 2) if a[:prefix] == b[:prefix] and score(a, b) >= threshold}
    expected |= {(own[0], i, 1.0) for own in values.values() for i in own[1:]}
    got = K.fuzzy_pairs(spark.createDataFrame(names, "id long, v string"), "id", "v", prefix, threshold).collect()
    assert len(got) == len(expected) and {(r.a, r.b, round(r.score, 9)) for r in got} == expected


def test_fuzzy_pairs_of_jaro_winkler_do_not_depend_on_groups(spark, names, monkeypatch):
    df = spark.createDataFrame(names, "id long, v string")
    every = K.fuzzy_pairs(df, "id", "v", 1, -1.0, "jaro_winkler").collect()  # lengths rule nothing out
    for group in (1000, 3):
        monkeypatch.setattr(K, "GROUP", group)
        got = K.fuzzy_pairs(df, "id", "v", 1, 0.92, "jaro_winkler").collect()
        assert sorted(map(tuple, got)) == sorted(tuple(r) for r in every if r.score >= 0.92)


def test_link_candidates(spark):
    rng = random.Random(2)
    rows = lambda n: [(i, rng.choice([None, 1, 2]), rng.choice([None, *range(9)]), rng.choice("ab")) for i in range(n)]
    left, right = rows(60), rows(70)
    fields = [K.Field("x", 0.9, 0.3), K.Field("y", 0.95, 0.1), K.Field("z", 0.7, 0.5)]
    weigh = lambda f, same: math.log2(f.m / f.u) if same else math.log2((1 - f.m) / (1 - f.u))
    score = lambda a, b: sum(weigh(f, a[i] is not None and a[i] == b[i]) for i, f in enumerate(fields, 1))
    kind = "id long, x long, y long, z string"
    for review in (-1.5, 0.5, 2.0, 9.0):
        got = K.link_candidates(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), fields, ("id", "id"), 4.0, review).collect()
        expected = sorted((a[0], b[0], round(score(a, b), 9), "match" if score(a, b) >= 4 else "review") for a in left for b in right if score(a, b) >= review)
        assert sorted((r.left_id, r.right_id, round(r.score, 9), r.status) for r in got) == expected
    with pytest.raises(ValueError):
        K.link_candidates(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), fields, ("id", "id"), 4.0, -99.0)


def test_pairs_of_few_values_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(K, "PAIRS", 64)
    monkeypatch.setattr(K, "SIDE", 5)
    rng = random.Random(4)
    rows = lambda n: [(i, rng.choice([None, 1, 2]), rng.choice([None, *range(5)])) for i in range(n)]
    left, right = rows(50), rows(90)
    fields = [K.Field("x", 0.9, 0.3), K.Field("y", 0.95, 0.1)]
    weigh = lambda f, same: math.log2(f.m / f.u) if same else math.log2((1 - f.m) / (1 - f.u))
    same = lambda a, b: [a[i] is not None and a[i] == b[i] for i in (1, 2)]
    kind = "id long, x long, y long"
    frames = [spark.createDataFrame(r, kind) for r in (left, right)]
    every = [(a[0], b[0], sum(map(weigh, fields, same(a, b))), any(same(a, b))) for a in left for b in right]
    name = lambda s: "match" if s >= 4 else "review" if s >= 0 else "non_match"
    found = K.link(*frames, fields, ("id", "id"), 4.0, 0.0)
    assert sorted(map(tuple, found.collect())) == sorted((i, j, s, name(s)) for i, j, s, agree in every if agree)
    assert found.select(F.spark_partition_id()).distinct().count() > 8
    found = K.link_candidates(*frames, fields, ("id", "id"), 4.0, 1.0).collect()
    assert sorted(map(tuple, found)) == sorted((i, j, s, name(s)) for i, j, s, _ in every if s >= 1.0)


@pytest.mark.parametrize("block,size", [(8192, 3), (10, 7), (4, 9)])
def test_rolling_over_all_rows(spark, monkeypatch, block, size):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(block)
    v = [rng.choice([None, rng.uniform(0, 9)]) for _ in range(57)]
    rows = list(enumerate(v))
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "at long, v double").repartition(5)
    got = {r["at"]: r.rolling for r in S.rolling(df, "at", "v", size, "sum").collect()}
    assert len(got) == len(rows)
    for i in range(len(v)):
        own = [x for x in v[max(0, i - size + 1) : i + 1] if x is not None]
        assert got[i] == (pytest.approx(sum(own)) if own else None)


def test_equal_places_are_dealt_to_ranges(spark):
    from millrace.functions.ranges import numbered

    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        rows = spark.range(4000).select("id", F.lit(1).alias("same"))
        got = numbered(rows, ["same"], "n")
        assert sorted(r.n for r in got.collect()) == list(range(1, 4001))
        assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 2500
    finally:
        spark.conf.unset(name)


def test_walk_forward_takes_its_first_rows(spark):
    rows = spark.range(100).select((F.col("id") * 37 % 100).alias("at"))
    got = sorted((r.step, r.role, r["at"]) for r in L.walk_forward(rows, ["at"], 5, 2, 3).collect())
    assert got == sorted([(s, "train", s * 2 + i) for s in range(3) for i in range(5)] + [(s, "test", s * 2 + 5 + i) for s in range(3) for i in range(2)])
    with pytest.raises(ValueError):
        L.walk_forward(rows, ["at"], 95, 2, 3)
