"""Walks within a budget against a plain walk."""

import random
from collections import defaultdict

import pytest

from millrace.operators import graphs as G

EDGES = "edge long, a string, b string, type string"


def adjacency(edges, direction, types, there):
    out, into = defaultdict(list), defaultdict(list)
    for e, a, b, kind in sorted(edges, key=lambda x: x[0]):
        if a is not None and b is not None and (types is None or kind in types):
            out[a].append((e, b))
            into[b].append((e, a))
    pick = {"out": lambda n: out[n], "in": lambda n: into[n], "both": lambda n: out[n] + into[n]}[direction]
    return lambda n: [x for x in pick(n) if there is None or x[1] in there]


def walk(edges, starts, depth, fanout, nodes, direction, types, there):
    near = adjacency(edges, direction, types, there)
    seen, links = {}, set()
    for s in sorted({s for s in starts if s is not None and (there is None or s in there)})[:nodes]:
        seen[s] = 0
    front = list(seen)
    for d in range(1, depth + 1):
        fresh = []
        for n in front:
            for e, other in near(n)[:fanout]:
                if other not in seen and len(seen) < nodes:
                    seen[other] = d
                    fresh.append(other)
                if other in seen:
                    links.add(e)
        front = fresh
        if not front:
            break
    return [(n, d, i + 1) for i, (n, d) in enumerate(seen.items())], links


def path(edges, source, target, depth, fanout, direction, types, there):
    near = adjacency(edges, direction, types, there)
    if source == target:
        return [source]
    seen, front = {source}, [[source]]
    for _ in range(depth):
        fresh = []
        for p in front:
            for _, other in near(p[-1])[:fanout]:
                if other == target:
                    return [*p, other]
                if other not in seen:
                    seen.add(other)
                    fresh.append([*p, other])
        front = fresh
    return None


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(6)
    ids = [f"n{i}" for i in range(80)]
    made = [(rng.choice(ids), rng.choice(ids), rng.choice(["likes", "knows", None])) for _ in range(170)]
    made += [("hub", f"leaf{i}", "likes") for i in range(300)] + [(f"leaf{i}", f"n{i % 80}", "knows") for i in range(0, 300, 7)]
    made += [("n1", "n1", "likes"), ("n1", "n2", "likes"), ("n1", "n2", "likes"), (None, "n3", "likes"), ("n3", None, "knows"), ("gone", "n4", "likes"), ("n4", "gone", "knows")]
    rng.shuffle(made)
    return [(i, *e) for i, e in enumerate(made)]


CASES = [(2, 3, 1000, "both", None, False), (3, 10, 40, "out", None, False), (4, 2, 7, "in", ["likes"], True), (3, 1000, 60, "both", ["knows", "likes"], True), (6, 1, 5000, "both", None, True), (2, 5, 1, "both", None, False), (1, 50, 30, "both", ["none"], False)]


@pytest.mark.parametrize("depth,fanout,nodes,direction,types,listed", CASES)
def test_expand(spark, graph, depth, fanout, nodes, direction, types, listed):
    there = {f"n{i}" for i in range(75)} | {"hub"} | {f"leaf{i}" for i in range(290)} if listed else None
    starts = ["n1", "hub", "n7", "n79", "nowhere", None, "n1"]
    table = spark.createDataFrame(graph, EDGES)
    vertices = spark.createDataFrame([(v,) for v in sorted(there)], "id string") if listed else None
    seen, links = G.expand(table, spark.createDataFrame([(s,) for s in starts], "id string"), depth, fanout, nodes, direction, types, vertices)
    expected, followed = walk(graph, starts, depth, fanout, nodes, direction, types, there)
    assert sorted(map(tuple, seen.collect()), key=lambda r: r[2]) == expected
    assert sorted(r.edge for r in links.collect()) == sorted(followed)


@pytest.mark.parametrize("source,target,depth,fanout,direction,types", [("n1", "n40", 6, 50, "both", None), ("n1", "n40", 2, 1, "both", None), ("hub", "n35", 3, 400, "out", None), ("n1", "n1", 1, 1, "out", None), ("n35", "hub", 5, 400, "in", ["likes", "knows"]), ("n1", "nowhere", 3, 9, "both", None)])
def test_paths(spark, graph, source, target, depth, fanout, direction, types):
    got = G.bounded_path(spark.createDataFrame(graph, EDGES), source, target, depth, fanout, direction, types)
    assert got == path(graph, source, target, depth, fanout, direction, types, None)


def test_a_hub_of_many_edges(spark):
    rows = spark.range(10_000).selectExpr("id AS edge", "'hub' AS a", "concat('x', id) AS b", "'t' AS type")
    seen, links = G.expand(rows, spark.createDataFrame([("hub",)], "id string"), 2, 25, 100)
    assert sorted(r.id for r in seen.collect()) == sorted(["hub"] + [f"x{i}" for i in range(25)]) and links.count() == 25
    import io
    from contextlib import redirect_stdout

    front = spark.createDataFrame([("hub", 1)], "id string, place long")
    with redirect_stdout(io.StringIO()) as plan:
        G._neighbours(front, G._adjacent(rows, "both", None, None), 25).explain()
    assert "WindowGroupLimit" in plan.getvalue() and "Partial" in plan.getvalue()


def test_nothing_and_wrong_bounds(spark):
    none = spark.createDataFrame([], EDGES)
    seen, links = G.expand(none, spark.createDataFrame([], "id string"), 2, 2, 2)
    assert seen.collect() == [] and links.collect() == []
    seen, _ = G.expand(none, spark.createDataFrame([("a",)], "id string"), 2, 2, 2)
    assert [tuple(r) for r in seen.collect()] == [("a", 0, 1)]
    for bad in ((0, 1, 1), (1, -1, 1), (1, 1, 2.5)):
        with pytest.raises(ValueError):
            G.expand(none, none.selectExpr("a AS id"), *bad)
    with pytest.raises(ValueError):
        G.expand(none, none.selectExpr("a AS id"), 1, 1, 1, "up")
