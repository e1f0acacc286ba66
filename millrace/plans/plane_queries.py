"""Queries of points against lines and polygons; their SQL compares every pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import geometry as G
from millrace.plans.tables import sql

_CUSTOMERS = "SELECT c_custkey, c_nationkey, CAST(c_acctbal AS DOUBLE) / 100 AS x, c_custkey * 37 % 1000 / 10.0 + 0.003 AS y FROM customer"
_PARTS = "SELECT p_partkey, p_partkey * 7 % 1000 / 10.0 + 0.013 AS x, CAST(p_retailprice AS DOUBLE) % 100 + 0.017 AS y FROM part"
_CORNERS = "SELECT s_nationkey % 4 AS id, s_suppkey, CAST(s_acctbal AS DOUBLE) / 100 AS x, s_suppkey * 53 % 1000 / 10.0 AS y FROM supplier"
# A twelve-cornered star around a place of each nation.
_ANGLE = "pi() * {i} / 6"
_STAR = "{c}(" + _ANGLE + ") * (6 + (n_nationkey * 7 + {i} * 5) % 11) + {at}"
_AT = ("(n_nationkey % 5 * 20 + 10)", "(floor(n_nationkey / 5) * 20 + 10)")


def _doubles(df):
    return df.withColumns({c: F.col(c).cast("double") for c in ("x", "y")})


def nearest(spark, d):
    lines = _doubles(sql(spark, d, _CORNERS, "supplier")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.array("x", "y").alias("p")))).alias("v"))
    out = G.nearest_line(_doubles(sql(spark, d, _CUSTOMERS, "customer")), lines.select("id", F.col("v.p").alias("v")), "x", "y", "id", "v", 1.0)
    return out.select("c_custkey", "nearest_id", F.round("distance", 6).alias("distance"), "within_buffer")


def _stars(spark, d):
    corner = ", ".join(_STAR.format(c=c, i="i", at=at) for c, at in zip(("cos", "sin"), _AT, strict=True))
    return sql(spark, d, f"SELECT n_nationkey AS id, transform(sequence(0, 11), i -> array({corner})) AS v FROM nation", "nation")


def within(spark, d):
    out = G.within_boundary(_doubles(sql(spark, d, _CUSTOMERS, "customer")), _stars(spark, d), "x", "y", "c_nationkey", "id", "v", 5.0)
    return out.select("c_custkey", "within_buffer")


def inside(buffer):
    return lambda spark, d: G.inside_polygons(_doubles(sql(spark, d, _PARTS, "part")), _stars(spark, d), "x", "y", "id", "v", buffer).select("p_partkey", "polygon_id")


def _measure(x: str, y: str) -> str:
    along = f"greatest(0.0, least(1.0, CASE WHEN ax = zx AND ay = zy THEN 0 ELSE (({x} - ax) * (zx - ax) + ({y} - ay) * (zy - ay)) / ((zx - ax) * (zx - ax) + (zy - ay) * (zy - ay)) END))"
    return f"sqrt(pow({x} - ax - {along} * (zx - ax), 2) + pow({y} - ay - {along} * (zy - ay), 2))"


_VERTEX = ", ".join(f"CAST({_STAR.format(c=c, i=i, at=at)} AS DOUBLE) AS {p}{k}" for p, i in (("a", "i"), ("z", "((i + 1) % 12)")) for c, at, k in zip(("cos", "sin"), _AT, "xy", strict=True))
_EDGES = f"e AS (SELECT n_nationkey AS id, {_VERTEX} FROM nation, range(12) r(i))"
_INSIDE = "count(*) FILTER ((ay > y) <> (zy > y) AND x < (zx - ax) * (y - ay) / (zy - ay) + ax) % 2 = 1"

QUERIES = {
    "nearest_line": (
        nearest,
        f"""WITH p AS ({_CUSTOMERS}), s AS (SELECT id, x AS ax, y AS ay, lead(x) OVER w AS zx, lead(y) OVER w AS zy FROM ({_CORNERS}) WINDOW w AS (PARTITION BY id ORDER BY s_suppkey) QUALIFY zx IS NOT NULL),
m AS (SELECT c_custkey, id, {_measure("x", "y")} AS d FROM p, s) SELECT c_custkey, arg_min(id, (d, id)) AS nearest_id, round(min(d), 6) AS distance, min(d) <= 1.0 AS within_buffer FROM m GROUP BY 1""",
    ),
    "within_boundary": (within, f"WITH p AS ({_CUSTOMERS}), {_EDGES} SELECT c_custkey, {_INSIDE} OR min({_measure('x', 'y')}) < 5.0 AS within_buffer FROM p JOIN e ON id = c_nationkey GROUP BY 1"),
    **{f"inside_polygons{'_buffered' if b else ''}": (inside(b), f"WITH p AS ({_PARTS}), {_EDGES} SELECT p_partkey, id AS polygon_id FROM p, e GROUP BY 1, 2, x, y HAVING {_INSIDE} OR min({_measure('x', 'y')}) < {b}") for b in (0.0, 2.5)},
}
