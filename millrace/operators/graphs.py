"""Walks of a graph within a budget: so deep, so many neighbours a node, so many nodes in all."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from millrace.functions.ranges import numbered
from millrace.functions.storage import written


def _checked(**bounds: int) -> None:
    for name, value in bounds.items():
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise ValueError(f"{name} must be a positive whole number")


def _adjacent(edges: DataFrame, direction: str, types: Sequence[str] | None, vertices: DataFrame | None) -> DataFrame:
    """(node, other, back, edge) of edges (edge, a, b, type) that may be followed; back: against their direction."""
    if direction not in ("out", "in", "both"):
        raise ValueError("the direction is out, in or both")
    kept = edges if types is None else edges.where(F.col("type").isin(list(types)))
    ways = [kept.select(F.col(p).alias("node"), F.col(q).alias("other"), F.lit(back).alias("back"), "edge") for p, q, back, name in (("a", "b", 0, "out"), ("b", "a", 1, "in")) if direction in (name, "both")]
    out = (ways[0].union(ways[1]) if len(ways) > 1 else ways[0]).where("node IS NOT NULL AND other IS NOT NULL")
    return out if vertices is None else out.join(vertices.select(F.col("id").alias("other")).distinct(), "other", "left_semi")


def _neighbours(front: DataFrame, adjacent: DataFrame, fanout: int) -> DataFrame:
    """(place, number, node, other, edge): the first neighbours of each node of the front, along its edges first, in the order of edge ids.

    A hub's edges are cut to the fan-out by every task that reads them, before they meet.
    """
    met = adjacent.join(front.select(F.col("id").alias("node"), "place"), "node")
    number = F.row_number().over(Window.partitionBy("node").orderBy("back", "edge"))
    return met.withColumn("number", number).where(F.col("number") <= fanout).select("place", "number", "node", "other", "edge")


def expand(edges: DataFrame, starts: DataFrame, depth: int, fanout: int, nodes: int, direction: str = "both", types: Sequence[str] | None = None, vertices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the neighbourhood of ``starts`` that a breadth-first walk finds within its budget.

    edges: (edge, a, b, type), edge ids unique; starts: (id); vertices: (id) of the nodes there are (none: all that edges name). Of each
    node the first ``fanout`` neighbours count: along its edges, then against them, by edge id. Nodes are taken in one order, the starts by
    id and others by their finder's place and number, until there are ``nodes``. Returns (id, distance, place) with places
    from 1, and (edge) of the followed edges between nodes taken. Null ids are no nodes; no starts give no rows.
    """
    _checked(depth=depth, fanout=fanout, nodes=nodes)
    adjacent = _adjacent(edges, direction, types, vertices)
    seeds = starts.select("id").where("id IS NOT NULL").distinct()
    seeds = seeds if vertices is None else seeds.join(vertices.select("id").distinct(), "id", "left_semi")
    front = written(numbered(seeds, ["id"], "place").where(F.col("place") <= nodes).withColumn("distance", F.lit(0)).select("id", "distance", "place"))
    seen, taken, followed = front, front.count(), None
    for d in range(1, depth + 1):
        found = written(_neighbours(front, adjacent, fanout))
        followed = found if followed is None else followed.union(found)
        if taken < nodes:
            first = found.groupBy(F.col("other").alias("id")).agg(F.min(F.struct("place", "number")).alias("at"))
            fresh = first.join(seen.select("id"), "id", "left_anti")
            front = numbered(fresh, ["at"], "n").where(F.col("n") <= nodes - taken)
            front = written(front.select("id", F.lit(d).alias("distance"), (F.col("n") + taken).alias("place")))
            seen, more = seen.union(front), front.count()
            taken += more
            if not more:
                break
        else:
            break
    links = followed.join(seen.select(F.col("id").alias("other")), "other", "left_semi").select("edge").distinct()
    return seen, links


def bounded_path(edges: DataFrame, source: Any, target: Any, depth: int, fanout: int, direction: str = "both", types: Sequence[str] | None = None, vertices: DataFrame | None = None) -> list[Any] | None:
    """The nodes of the first shortest path of at most ``depth`` steps, found as ``expand`` walks; None if there is none.

    Only the path itself comes to the driver, a step at a time.
    """
    _checked(depth=depth, fanout=fanout)
    if source == target:
        return [source]
    adjacent = _adjacent(edges, direction, types, vertices)
    front = edges.sparkSession.range(1).select(F.lit(source).cast(dict((f.name, f.dataType) for f in edges.schema.fields)["a"]).alias("id"), F.lit(1).cast("long").alias("place"))
    seen, steps = front.select("id"), []
    for _ in range(depth):
        found = written(_neighbours(front, adjacent, fanout))
        first = found.groupBy(F.col("other").alias("id")).agg(F.min(F.struct("place", "number", "node")).alias("at"))
        fresh = written(numbered(first.join(seen, "id", "left_anti"), ["at"], "place").select("id", F.col("at.node").alias("before"), "place"))
        steps.append(fresh)
        if not fresh.where(F.col("id") == F.lit(target)).isEmpty():
            path = [target]
            for step in reversed(steps):
                path.append(step.where(F.col("id") == F.lit(path[-1])).first()["before"])
            return path[::-1]
        if fresh.isEmpty():
            return None
        front, seen = fresh, seen.union(fresh.select("id"))
    return None
