"""Points against lines and polygons in the plane, by equi-joins on grid cells.

A grid's cells are numbered pairs (cx, cy) of squares of one size. Shapes are put into every cell that their points of interest can lie
in, points only into their own. Cells that hold very many points are dealt to parts, each of which meets the cell's shapes by itself.
Coordinates that are null, infinite or not a number place no point, and break a line or polygon's edge out of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.storage import written

#: Points of a cell that meet its shapes in one part.
HOT = 20_000
#: Cells along the longer side of a polygon.
ACROSS = 32
#: Comparisons of a point with a part of a line that cost as much as one copy of the part, and copies of parts for each part and point at most.
COPY, COPIES = 50.0, 16
#: Reach of a cell beyond what arithmetic in doubles may lose.
_MARGIN = 1 + 1e-9


def _finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        c = c.cast("double")
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(out, F.lit(False))


def _edges(shapes: DataFrame, ids: str, vertices: str, closed: bool) -> DataFrame:
    """(shape, ax, ay, bx, by): from each vertex to the next; of closed shapes from the last to the first too."""
    corner = shapes.select(F.col(ids).alias("shape"), F.col(vertices).alias("v")).where(F.size("v") > 0)
    after = lambda i: F.get("v", (i + 1) % F.size("v"))
    pairs = corner.select("shape", F.size("v").alias("n"), F.posexplode(F.transform("v", lambda p, i: F.struct(p.alias("a"), after(i).alias("b")))).alias("i", "e"))
    kept = pairs if closed else pairs.where(F.col("i") < F.col("n") - 1)
    numbers = kept.select("shape", *[F.get(F.col(f"e.{p}"), F.lit(k)).cast("double").alias(f"{p}{c}") for p in "ab" for k, c in enumerate("xy")])
    return numbers.where(_finite(*[F.col(c) for c in ("ax", "ay", "bx", "by")]))


def _distance(x: Column, y: Column) -> Column:
    """From a point to the edge (ax, ay)-(bx, by)."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = dx * dx + dy * dy
    along = F.when(length > 0, ((x - F.col("ax")) * dx + (y - F.col("ay")) * dy) / length).otherwise(0.0)
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(x - F.col("ax") - along * dx, y - F.col("ay") - along * dy)


def _cell(v: Column, size: Column) -> Column:
    return F.floor(v / size).cast("long")


def _touched(edges: DataFrame, size: Column, reach: Column) -> DataFrame:
    """``edges`` once for each cell that holds a point within ``reach`` of the edge, cx and cy (and few others)."""
    far = reach * _MARGIN + size * 1e-9
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = edges.withColumn("cx", F.explode(F.sequence(_cell(low - far, size), _cell(high + far, size))))
    # The part of the edge that is near the column of cells, and how high and low it gets there.
    dx = F.col("bx") - F.col("ax")
    at = lambda x: F.when(dx != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("ax")) / dx)))
    left, right = F.col("cx") * size - far, (F.col("cx") + 1) * size + far
    height = lambda t, other: F.col("ay") + F.coalesce(t, other) * (F.col("by") - F.col("ay"))
    one, two = height(at(left), F.lit(0.0)), height(at(right), F.lit(1.0))
    return columns.withColumn("cy", F.explode(F.sequence(_cell(F.least(one, two) - far, size), _cell(F.greatest(one, two) + far, size))))


def _met(points: DataFrame, shapes: DataFrame, on: list[str]) -> DataFrame:
    """Points with the shapes in their cells; cells of more than ``HOT`` points in parts of as many."""
    crowded = written(points.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("__k")).where("__k > 1"))
    k = F.coalesce("__k", F.lit(1))
    dealt = points.join(crowded, on, "left").withColumn("__k", F.pmod(F.xxhash64("__row"), k).cast("int"))
    copied = shapes.join(crowded, on, "left").withColumn("__k", F.explode(F.sequence(F.lit(0), k - 1)))
    return dealt.join(copied, [*on, "__k"])


def nearest_line(points: DataFrame, lines: DataFrame, x: str, y: str, line: str, vertices: str, buffer: float) -> DataFrame:
    """``points`` with nearest_id, distance and within_buffer: the line that comes nearest, by its straight parts.

    lines: ids and arrays of [x, y] vertices; a line of one vertex has no part. Ties go to the least id. Without any line:
    null, 0.0 and false; a point without finite coordinates: three nulls. Lines stand in the cells that they pass through. A point takes the best part of its own cell
    and, if that is further than the cell's border, looks in all cells within that distance; points in cells without a line
    look again in cells of four times the size, until the grid is one cell.
    """
    if not buffer > 0:
        raise ValueError("the buffer must be positive")
    # 0.0 and -0.0 are one place, as for the joins on it.
    at = lambda c: F.when(_finite(F.col(c)), F.col(c).cast("double") + 0.0)
    rows = points.withColumns({"__x": at(x), "__y": at(y)})
    parts = written(_edges(lines, line, vertices, closed=False).dropDuplicates())
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    ends = lambda a, b, p: [F.min(a).alias(f"{p}0"), F.max(b).alias(f"{p}1")]
    grid = parts.agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("length"), *ends(F.least("ax", "bx"), F.greatest("ax", "bx"), "x"), *ends(F.least("ay", "by"), F.greatest("ay", "by"), "y")).first()
    kind = lines.schema[line].dataType
    if not grid["n"]:
        none = F.when(_finite(F.col(x), F.col(y)), F.lit(0.0))
        return points.select(*points.columns, F.lit(None).cast(kind).alias("nearest_id"), none.alias("distance"), (none > 0).alias("within_buffer"))
    # Points of one place are looked for once.
    placed = written(rows.where("__x IS NOT NULL AND __y IS NOT NULL").select(F.col("__x").alias("x"), F.col("__y").alias("y")).distinct().withColumn("__row", F.monotonically_increasing_id()))
    most = [F.percentile_approx(p, [0.02, 0.98]).alias(f"{p}q") for p in "xy"]
    own = placed.agg(F.count(F.lit(1)).alias("m"), *ends("x", "x", "x"), *ends("y", "y", "y"), *most).first()
    reach = max([0.0] + [max(grid[f"{p}1"], own[f"{p}1"]) - min(grid[f"{p}0"], own[f"{p}0"]) for p in "xy" if own["m"]])
    # Cells as small as pays: each halves the parts that a point meets, and doubles the copies of the parts.
    across = [own[f"{p}q"][1] - own[f"{p}q"][0] if own["m"] else 0.0 for p in "xy"]
    size = max(math.sqrt(COPY * across[0] * across[1] / max(own["m"], 1)), grid["length"] / (COPIES * (grid["n"] + own["m"])), reach / 1e6) or max(reach, 1.0)
    best_of = lambda asked, cells: _met(asked, cells, ["cx", "cy"]).groupBy("__row").agg(F.min(F.struct(_distance(F.col("x"), F.col("y")).alias("d"), "shape")).alias("best"))
    found, pending = [], placed
    while True:
        s = F.lit(size)
        cells = written(_touched(parts, s, F.lit(0.0)))
        cell = {"cx": _cell(F.col("x"), s), "cy": _cell(F.col("y"), s)}
        tried = written(pending.join(best_of(pending.withColumns(cell), cells), "__row", "left"))
        seen = tried.where("best IS NOT NULL").withColumn("far", F.col("best.d") * _MARGIN + s * 1e-9)
        first, last = [{p: _cell(F.col(p) + sign * F.col("far"), s) for p in "xy"} for sign in (-1, 1)]
        within = (first["x"] == last["x"]) & (first["y"] == last["y"])
        wide = seen.where(~within).withColumn("cx", F.explode(F.sequence(first["x"], last["x"]))).withColumn("cy", F.explode(F.sequence(first["y"], last["y"])))
        found += [seen.select("__row", "best"), best_of(wide.select("__row", "x", "y", "cx", "cy"), cells)]
        pending = tried.where("best IS NULL").select("__row", "x", "y")
        if pending.isEmpty():
            break
        # One cell of all: its corners may lie anywhere, so it is moved over everything.
        if size > 2 * reach:
            found.append(best_of(pending.withColumns({"cx": F.lit(0), "cy": F.lit(0)}), parts.withColumns({"cx": F.lit(0), "cy": F.lit(0)})))
            break
        size *= 4
    whole_found = found[0]
    for more in found[1:]:
        whole_found = whole_found.union(more)
    nearest = whole_found.groupBy("__row").agg(F.min("best").alias("best")).join(placed, "__row").select(F.col("x").alias("__x"), F.col("y").alias("__y"), "best")
    return rows.join(nearest, ["__x", "__y"], "left").select(*points.columns, F.col("best.shape").alias("nearest_id"), F.col("best.d").alias("distance"), (F.col("best.d") <= buffer).alias("within_buffer"))


def _banded(polygons: DataFrame, ids: str, vertices: str, buffer: float) -> tuple[DataFrame, DataFrame]:
    """Stored (shape, size, x0, y0, x1, y1) of polygons of three vertices and more, and their edges with size.

    size: of the cells, a power of two, so that polygons of like extent share a grid.
    """
    edges = _edges(polygons.where(F.size(vertices) >= 3), ids, vertices, closed=True)
    ends = {"x0": F.min("ax") - buffer, "y0": F.min("ay") - buffer, "x1": F.max("ax") + buffer, "y1": F.max("ay") + buffer}
    boxes = edges.groupBy("shape").agg(*[c.alias(n) for n, c in ends.items()])
    across = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9))
    sized = written(boxes.withColumn("size", F.pow(F.lit(2.0), F.ceil(F.log2(across / ACROSS)))))
    return sized, written(edges.join(sized.select("shape", "size"), "shape"))


def _measured(asked: DataFrame, edges: DataFrame, buffer: float) -> DataFrame:
    """(__row, shape, inside, gap) of points (__row, shape, size, x, y): whether a ray to the right crosses the polygon's edges an odd number of times, and the
    distance of the nearest edge where it may be less than the buffer. Points meet only the edges of their row of cells."""
    far = buffer * _MARGIN
    rows = edges.withColumn("cy", F.explode(F.sequence(_cell(F.least("ay", "by") - far, F.col("size")), _cell(F.greatest("ay", "by") + far, F.col("size")))))
    points = asked.withColumn("cy", _cell(F.col("y"), F.col("size")))
    met = _met(points, rows.drop("size"), ["shape", "cy"])
    straddles = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    crosses = straddles & (F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    crosses = F.when(straddles, crosses).otherwise(F.lit(False))
    near = met.groupBy("__row", "shape").agg((F.count_if(crosses) % 2 == 1).alias("inside"), F.min(_distance(F.col("x"), F.col("y"))).alias("gap"))
    return near


def within_boundary(points: DataFrame, boundaries: DataFrame, x: str, y: str, boundary: str, ids: str, vertices: str, buffer: float = 0.0) -> DataFrame:
    """``points`` with within_buffer: whether each lies in the boundary that it names, or less than ``buffer`` from its edge.

    points: with ``boundary``, the id of a row of ``boundaries`` (unique ``ids``, vertices as [x, y] arrays). A boundary without
    vertices holds everything, one of one or two vertices nothing; null if a boundary is not known or a coordinate not finite.
    """
    if not buffer >= 0:
        raise ValueError("the buffer must not be negative")
    rows = written(points.withColumn("__row", F.monotonically_increasing_id()))
    sized, edges = _banded(boundaries, ids, vertices, buffer)
    placed = rows.select("__row", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(boundary).alias("shape")).where(_finite(F.col("x"), F.col("y")))
    asked = placed.join(sized.select("shape", "size"), "shape")
    within = _measured(asked, edges, buffer).where(F.col("inside") | (F.col("gap") < buffer)).select("__row", F.lit(True).alias("__in"))
    known = boundaries.select(F.col(ids).alias("__shape"), (F.coalesce(F.size(vertices), F.lit(0)) <= 0).alias("__open"))
    both = rows.join(within, "__row", "left").join(known, F.col(boundary) == F.col("__shape"), "left")
    answer = F.when(F.col("__shape").isNotNull() & _finite(F.col(x), F.col(y)), F.coalesce("__in", "__open"))
    return both.select(*points.columns, answer.alias("within_buffer"))


def inside_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, ids: str, vertices: str, buffer: float = 0.0) -> DataFrame:
    """A row for each point and each polygon that holds it, or comes nearer than ``buffer``: ``points`` with polygon_id.

    Each polygon marks the cells of its grid as edge or inside; all others lie outside and meet nothing. Points in inside cells are
    done; those in edge cells are measured. Polygons of fewer than three vertices hold nothing; points in none give no row.
    """
    if not buffer >= 0:
        raise ValueError("the buffer must not be negative")
    rows = written(points.withColumn("__row", F.monotonically_increasing_id()))
    sized, edges = _banded(polygons, ids, vertices, buffer)
    size = F.col("size")
    on_edge = _touched(edges, size, F.lit(float(buffer))).select("shape", "size", "cx", "cy").distinct()
    span = lambda lo, hi: F.explode(F.sequence(_cell(F.col(lo), size), _cell(F.col(hi), size)))
    grid = sized.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1")).select("shape", "size", "cx", "cy")
    others = written(grid.join(on_edge, ["shape", "size", "cx", "cy"], "left_anti").withColumn("__row", F.monotonically_increasing_id()))
    centres = others.select("__row", "shape", "size", ((F.col("cx") + 0.5) * size).alias("x"), ((F.col("cy") + 0.5) * size).alias("y"))
    full = others.join(_measured(centres, edges, 0.0).where("inside").select("__row"), "__row", "left_semi")
    cells = written(on_edge.withColumn("edge", F.lit(True)).union(full.select("shape", "size", "cx", "cy", F.lit(False))))
    # A point is looked up once in each size of grid that polygons have: some dozens at most, as sizes are powers of two.
    sizes = [r["size"] for r in sized.select("size").distinct().collect()]
    placed = rows.select("__row", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(_finite(F.col("x"), F.col("y")))
    looked = placed.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]) if sizes else F.array().cast("array<double>")))
    looked = looked.withColumns({"cx": _cell(F.col("x"), size), "cy": _cell(F.col("y"), size)})
    met = written(_met(looked, cells, ["size", "cx", "cy"]).select("__row", "x", "y", "size", "shape", "edge"))
    measured = _measured(met.where("edge").drop("edge"), edges, buffer).where(F.col("inside") | (F.col("gap") < buffer))
    pairs = met.where("NOT edge").select("__row", "shape").union(measured.select("__row", "shape"))
    return rows.join(pairs, "__row").select(*points.columns, F.col("shape").alias("polygon_id"))
