"""Queries of bounded walks over the graph of suppliers and parts; their SQL spells the steps out."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import graphs as G
from millrace.plans.tables import sql

_EDGES = "SELECT l_orderkey * 10 + l_linenumber AS edge, 's' || l_suppkey AS a, 'p' || l_partkey AS b, l_returnflag AS type FROM lineitem"
_STARTS = "SELECT 's' || s_suppkey AS id FROM supplier WHERE s_suppkey % 10 = 3"
_DEPTH, _FANOUT, _NODES, _TYPES = 3, 6, 400, ["N", "R"]


def _expanded(spark, d):
    return G.expand(sql(spark, d, _EDGES, "lineitem"), sql(spark, d, _STARTS, "supplier"), _DEPTH, _FANOUT, _NODES, "both", _TYPES)


def nodes(spark, d):
    return _expanded(spark, d)[0]


def links(spark, d):
    return _expanded(spark, d)[1]


def whole(spark, d):
    """Along the edges alone, without a bound that matters: suppliers, all their parts, and no further."""
    edges = sql(spark, d, _EDGES, "lineitem")
    seen, _ = G.expand(edges, sql(spark, d, _STARTS, "supplier"), 2, 1_000_000_000, 1_000_000_000, "out")
    return seen.groupBy("distance").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"))


def _walk() -> str:
    kinds = ", ".join(f"'{t}'" for t in _TYPES)
    steps = [f"e AS ({_EDGES}), j AS (SELECT a AS node, b AS other, 0 AS back, edge FROM e WHERE type IN ({kinds}) UNION ALL SELECT b, a, 1, edge FROM e WHERE type IN ({kinds}))"]
    steps.append(f"s0 AS (SELECT id, 0 AS distance, row_number() OVER (ORDER BY id) AS place FROM ({_STARTS}) QUALIFY place <= {_NODES})")
    steps.append("f0 AS (SELECT * FROM s0)")
    for k in range(1, _DEPTH + 1):
        steps.append(f"c{k} AS (SELECT place, row_number() OVER (PARTITION BY node ORDER BY back, edge) AS number, other, edge FROM j JOIN f{k - 1} ON node = id QUALIFY number <= {_FANOUT})")
        steps.append(f"m{k} AS (SELECT other AS id, min((place, number)) AS spot FROM c{k} WHERE other NOT IN (SELECT id FROM s{k - 1}) GROUP BY other)")
        steps.append(f"f{k} AS (SELECT id, {k} AS distance, row_number() OVER (ORDER BY spot) + (SELECT count(*) FROM s{k - 1}) AS place FROM m{k} QUALIFY place <= {_NODES})")
        steps.append(f"s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM f{k})")
    return "WITH " + ", ".join(steps)


QUERIES = {
    "graph_expansion": (nodes, f"{_walk()} SELECT * FROM s{_DEPTH}"),
    "graph_expansion_edges": (links, f"{_walk()} SELECT DISTINCT edge FROM ({' UNION ALL '.join(f'SELECT * FROM c{k}' for k in range(1, _DEPTH + 1))}) WHERE other IN (SELECT id FROM s{_DEPTH})"),
    "graph_expansion_whole": (whole, f"WITH e AS ({_EDGES}), s AS ({_STARTS}), p AS (SELECT count(DISTINCT b) AS n FROM e WHERE a IN (SELECT id FROM s)), c AS (SELECT count(*) AS n FROM s) SELECT 0 AS distance, n, n AS last FROM c UNION ALL SELECT 1, p.n, p.n + c.n FROM p, c"),
}
