"""Polygons against cells: burning, area weights, polygon means with completeness, statistics around sites.

A polygon's cells are found strip by strip: its rings go once to each strip of STRIP rows that it reaches, and a strip's
cells come back from arrays. What is joined afterwards are cells, never rings.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envgrid.functions import geo
from envgrid.operators.grid import GridSpec, latest_wins
from envgrid.sources.stages import stage

STRIP = 256
#: Smaller shares of a cell are rounding, not area.
LEAST_SHARE = 1e-9


def strips(polygons: DataFrame, grid: GridSpec, rings: str = "rings") -> DataFrame:
    """Each polygon with the strips of rows that its bounding box reaches within the grid: columns strip (first row), c0 and c1."""
    box = polygons.withColumn("_b", geo.bounds(rings))
    r0, r1, c0, c1 = grid.row(F.col("_b.y1")), grid.row(F.col("_b.y0")), grid.col(F.col("_b.x0")), grid.col(F.col("_b.x1"))
    seen = (r1 >= 0) & (r0 <= grid.ny - 1) & (c1 >= 0) & (c0 <= grid.nx - 1)
    first, last = F.greatest(r0, F.lit(0)), F.least(r1, F.lit(grid.ny - 1))
    return box.where(seen).withColumn("strip", F.explode(F.sequence(first, last, F.lit(STRIP)))).withColumn("_n", F.least(F.lit(STRIP), last - F.col("strip") + 1)).withColumn("c0", F.greatest(c0, F.lit(0))).withColumn("c1", F.least(c1, F.lit(grid.nx - 1))).drop("_b")


def strip_cells(polygons: DataFrame, grid: GridSpec, keep: Sequence[str], cells: Callable[[np.ndarray, int, int, int], np.ndarray], rings: str = "rings") -> DataFrame:
    """(keep, row, col, value) of the cells of each polygon for which cells(edges, first row, rows, columns) is above 0."""
    rows = strips(polygons, grid, rings).select(*keep, F.col(rings).alias("_rings"), "strip", "_n", "c0", "c1")
    types = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            for k, (shape, top, n, c0, c1) in enumerate(zip(*(batch.column(c) for c in ("_rings", "strip", "_n", "c0", "c1")), strict=True)):
                top, n, c0, c1 = (v.as_py() for v in (top, n, c0, c1))
                e = geo.edges(shape.as_py())
                e = np.c_[(e[:, 0] - grid.x0) / grid.res - c0, (grid.y1 - e[:, 1]) / grid.res, (e[:, 2] - grid.x0) / grid.res - c0, (grid.y1 - e[:, 3]) / grid.res]
                found = cells(e, top, n, c1 - c0 + 1)
                r, c = np.nonzero(found > 0)
                take = pa.array(np.full(len(r), k))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).take(take) for x in keep), pa.array((r + top).astype(np.int32)), pa.array((c + c0).astype(np.int32)), pa.array(found[r, c].astype(float))], names=[*keep, "row", "col", "value"])

    return rows.mapInArrow(run, "".join(f"`{c}` {types[c]}, " for c in keep) + "row int, col int, value double")


def centre_cells(polygons: DataFrame, grid: GridSpec, keep: Sequence[str], rings: str = "rings") -> DataFrame:
    """(keep, row, col) of the cells whose centre lies in a polygon."""
    return strip_cells(polygons, grid, keep, geo.strip_centres, rings).drop("value")


def burn(polygons: DataFrame, grid: GridSpec, value: str, order: str, rings: str = "rings") -> DataFrame:
    """(row, col, value) of the cells whose centre lies in a polygon; of overlapping ones the last in order."""
    both = polygons.select(F.col(value).alias("_value"), F.col(order).alias("_order"), rings)
    return latest_wins(centre_cells(both, grid, ["_value", "_order"], rings).withColumnRenamed("_value", "value"), "_order")


def inside_any(cells: DataFrame, polygons: DataFrame, grid: GridSpec, rings: str = "rings") -> DataFrame:
    """The cells whose centre lies in at least one polygon: a union of polygons without merging their outlines."""
    return cells.join(dissolved(polygons, grid, rings), ["row", "col"], "left_semi")


def dissolved(polygons: DataFrame, grid: GridSpec, rings: str = "rings") -> DataFrame:
    """(row, col) of one region made of many polygons."""
    return centre_cells(polygons.select(rings), grid, [], rings).distinct()


def cell_weights(polygons: DataFrame, grid: GridSpec, key: str, rings: str = "rings") -> DataFrame:
    """(key, row, col, area, poly_area): the area of each polygon within each cell, above 0."""
    sized = polygons.select(key, rings, F.abs(geo.polygon_area(rings)).alias("poly_area"))

    def areas(e: np.ndarray, top: int, rows: int, cols: int) -> np.ndarray:
        a = geo.strip_areas(e, top, rows, cols)
        return np.where(a > LEAST_SHARE, a, 0.0)

    return strip_cells(sized, grid, [key, "poly_area"], areas, rings).select(key, "row", "col", (F.col("value") * grid.res**2).alias("area"), "poly_area")


def points_inside(points: DataFrame, polygons: DataFrame, grid: GridSpec, key: str, rings: str = "rings", x: str = "x", y: str = "y") -> DataFrame:
    """points with the key of each polygon that they lie in (null if in none).

    Points meet polygons by their cell. In cells that a polygon covers in whole the answer is known; only points in cells
    of its boundary are held against its rings, which join by the polygon's key. Points that are equal, or have missing
    columns, stay rows of their own: each gets a number first. A point without coordinates lies in no polygon.
    """
    covered = cell_weights(polygons, grid, key, rings).select("row", "col", F.col(key).alias("_key"), (F.col("area") >= grid.res**2 * (1 - LEAST_SHARE)).alias("_whole"))
    rows = stage(points.withColumn("_n", F.monotonically_increasing_id()), "points")
    at = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("_n", F.col(x).alias("_x"), F.col(y).alias("_y"), grid.row(F.col(y)).alias("row"), grid.col(F.col(x)).alias("col"))
    met = at.join(covered, ["row", "col"])
    edge = met.where(~F.col("_whole")).join(polygons.select(F.col(key).alias("_key"), F.col(rings).alias("_rings")), "_key").where(geo.contains_point("_rings", "_x", "_y"))
    hit = met.where("_whole").select("_n", "_key").unionByName(edge.select("_n", "_key"))
    return rows.join(hit, "_n", "left").select(*points.columns, F.col("_key").alias(key))


def boxes_that_meet(boxes: DataFrame, polygons: DataFrame, grid: GridSpec, key: str, box: str, rings: str = "rings") -> DataFrame:
    """(box, key): the boxes (x0, y0, x1, y1) and polygons that share area within the grid.

    Both list the cells that they reach. A box that reaches a cell of a polygon's inside meets it; the other pairs, of
    boundary cells alone, are held against the rings, which join by the polygon's key.
    """
    covered = cell_weights(polygons, grid, key, rings).select("row", "col", key, (F.col("area") >= grid.res**2 * (1 - LEAST_SHARE)).alias("_whole"))
    within = lambda v, n: F.greatest(F.lit(0), F.least(v, F.lit(n - 1)))
    last = lambda v: (F.ceil(v) - 1).cast("int")
    rows = F.sequence(within(grid.row(F.col("y1")), grid.ny), within(F.greatest(grid.row(F.col("y1")), last((grid.y1 - F.col("y0")) / grid.res)), grid.ny))
    cols = F.sequence(within(grid.col(F.col("x0")), grid.nx), within(F.greatest(grid.col(F.col("x0")), last((F.col("x1") - grid.x0) / grid.res)), grid.nx))
    listed = boxes.select(box, "x0", "y0", "x1", "y1", F.explode(rows).alias("row")).select("*", F.explode(cols).alias("col"))
    pairs = listed.join(covered, ["row", "col"]).groupBy(box, key).agg(F.bool_or("_whole").alias("_whole"), *[F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    edge = pairs.where(~F.col("_whole")).join(polygons.select(key, F.col(rings).alias("_rings")), key).where(geo.meets_box("_rings", "x0", "y0", "x1", "y1"))
    return pairs.where("_whole").select(box, key).unionByName(edge.select(box, key))


#: Levels between the cells around a point that hold its nearest edge and the cells that are told apart by their distance.
FINER = 5


def edge_pieces(polygons: DataFrame, res: float, top: int, rings: str = "rings") -> DataFrame:
    """(level, cx, cy, ax, ay, bx, by): the edges cut by the cells that they run through, of size res * 2^level for each level up to top."""
    names = ["level", "cx", "cy", "ax", "ay", "bx", "by"]

    def run(batches):
        for batch in batches:
            for shape in batch.column(rings):
                e = geo.edges(shape.as_py())
                for level in range(top + 1):
                    size = res * 2.0**level
                    cut = geo.cut_by_lines(geo.cut_by_lines(e / size, 1), 0)
                    at = np.floor((cut[:, :2] + cut[:, 2:]) / 2).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), level, np.int32)), pa.array(at[:, 0]), pa.array(at[:, 1]), *(pa.array(cut[:, k] * size) for k in range(4))], names=names)

    return polygons.select(rings).mapInArrow(run, "level int, cx bigint, cy bigint, ax double, ay double, bx double, by double")


def nearest_distance(points: DataFrame, polygons: DataFrame, key: str, res: float, rings: str = "rings", x: str = "x", y: str = "y") -> DataFrame:
    """(key, distance) of each point to the nearest polygon, 0 inside; null without coordinates or polygons. key tells points apart.

    Edges are walked through the cells of a quadtree's levels, each of which doubles the one before. A point looks at all levels
    at once for the lowest whose cells around it hold an edge; no nearest edge is farther than the cells around it two levels above. Of
    the cells FINER levels below these only the ones that are nearer than the nearest one's far corner can hold it, and only their pieces of edges are measured.
    """
    todo = stage(points.select(key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), "points")
    box = polygons.select(geo.bounds(rings).alias("b")).select("b.*")
    ends = [f(F.col(c)).alias(c) for f, cs in ((F.min, ("x0", "y0")), (F.max, ("x1", "y1"))) for c in cs]
    far = box.agg(*ends).crossJoin(todo.agg(*[f(c).alias(f"p{n}") for n, f, c in (("x0", F.min, "_x"), ("x1", F.max, "_x"), ("y0", F.min, "_y"), ("y1", F.max, "_y"))])).first()  # one row each
    if far["x0"] is None or far["px0"] is None:
        return todo.select(key, F.lit(None).cast("double").alias("distance"))
    extent = max(max(far[f"{c}1"], far[f"p{c}1"]) - min(far[f"{c}0"], far[f"p{c}0"]) for c in "xy")
    top = max(0, math.ceil(math.log2(max(1.0, extent / res))))
    shapes = stage(polygons.select(rings).withColumn("_id", F.monotonically_increasing_id()), "shapes")
    pieces = stage(edge_pieces(shapes, res, top, rings), "pieces")
    frame = GridSpec(far["x0"], far["y1"], res, max(1, int((far["x1"] - far["x0"]) / res) + 1), max(1, int((far["y1"] - far["y0"]) / res) + 1))
    inner = points_inside(todo, shapes, frame, "_id", rings, "_x", "_y").where("_id IS NOT NULL").select(key).distinct().withColumn("_in", F.lit(0.0))
    held = stage(pieces.select("level", "cx", "cy").distinct(), "cells")
    size = lambda level: F.lit(float(res)) * F.pow(F.lit(2.0), level)
    nine = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("q")

    def around(df: DataFrame, level: str) -> DataFrame:
        """df nine times, with each of the cells (cx, cy) of the level around the point."""
        return df.select("*", nine).select(*df.columns, *[(F.floor(F.col(v) / size(F.col(level))) + F.col(f"q.{k}")).cast("long").alias(c) for v, k, c in (("_x", "i", "cx"), ("_y", "j", "cy"))])

    levels = around(todo.select("*", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")), "level")
    lowest = levels.join(held, ["level", "cx", "cy"]).groupBy(key, "_x", "_y").agg((F.min("level") + 2).alias("up"))
    ups = F.when(F.col("level") == 0, F.sequence(F.lit(2), F.lit(FINER))).otherwise(F.array(F.col("level") + FINER))
    below = held.select("*", F.explode(ups).alias("up")).select("up", F.expr("shiftright(cx, up - level)").alias("px"), F.expr("shiftright(cy, up - level)").alias("py"), "level", "cx", "cy")
    above = around(lowest, "up").withColumnsRenamed({"cx": "px", "cy": "py"})
    cells = above.join(below, ["up", "px", "py"])
    low, high = (lambda c: F.col(c) * size(F.col("level"))), (lambda c: (F.col(c) + 1) * size(F.col("level")))
    apart = lambda v, c: F.greatest(low(c) - F.col(v), F.lit(0.0), F.col(v) - high(c))
    reach = lambda v, c: F.greatest(F.col(v) - low(c), high(c) - F.col(v))
    sized = cells.select(key, "_x", "_y", "level", "cx", "cy", F.hypot(apart("_x", "cx"), apart("_y", "cy")).alias("_near"), F.hypot(reach("_x", "cx"), reach("_y", "cy")).alias("_far"))
    left = sized.withColumn("_most", F.min("_far").over(Window.partitionBy(key))).where(F.col("_near") <= F.col("_most") * (1 + 1e-9)).select(key, "_x", "_y", "level", "cx", "cy")
    t = "greatest(0D, least(1D, coalesce(((_x - ax) * (bx - ax) + (_y - ay) * (by - ay)) / nullif(power(bx - ax, 2) + power(by - ay, 2), 0D), 0D)))"
    away = F.expr(f"sqrt(power(_x - ax - {t} * (bx - ax), 2) + power(_y - ay - {t} * (by - ay), 2))")
    found = left.join(pieces, ["level", "cx", "cy"]).groupBy(key).agg(F.min(away).alias("_d"))
    return todo.select(key).join(inner, key, "left").join(found, key, "left").select(key, F.coalesce("_in", "_d").alias("distance"))


def polygon_means(field: DataFrame, weights: DataFrame, keys: Sequence[str], poly: str, value: str = "value") -> DataFrame:
    """Area-weighted mean over the given cells of each polygon, and the share of the polygon that they cover."""
    joined = field.join(weights, ["row", "col"])
    have = F.sum(F.when(F.col(value).isNotNull(), F.col("area")))
    return joined.groupBy(*keys, poly).agg((F.sum(F.col("area") * F.col(value)) / F.nullif(have, F.lit(0.0))).alias("mean"), (F.coalesce(have, F.lit(0.0)) / F.max("poly_area")).alias("cover_frac"))


def valid_hours(hourly: DataFrame, weights: DataFrame, keys: Sequence[str], poly: str, time: str = "time", value: str = "value") -> DataFrame:
    """Hours in which at least one covered cell of the polygon has a value."""
    return hourly.join(weights.select("row", "col", poly), ["row", "col"]).groupBy(*keys, poly).agg(F.countDistinct(F.when(F.col(value).isNotNull(), F.col(time))).alias("n_hours"))


def site_statistics(sites: DataFrame, cells: DataFrame, grid: GridSpec, radii: Sequence[float], circle: bool, value: str = "value") -> DataFrame:
    """(site, radius, n, median, mean) of the cells around each site, within a circle or a box.

    Each site lists the cells of its window from the largest radius, and these are joined on (row, col).
    """
    reach = int(max(radii) / grid.res) + 1
    span = F.sequence(F.lit(-reach), F.lit(reach))
    near = sites.withColumn("row", F.explode(F.transform(span, lambda k: grid.row(F.col("y")) + k))).withColumn("col", F.explode(F.transform(span, lambda k: grid.col(F.col("x")) + k)))
    near = near.withColumn("_dx", F.abs(grid.x(F.col("col")) - F.col("x"))).withColumn("_dy", F.abs(grid.y(F.col("row")) - F.col("y"))).withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    inside = (F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") <= F.col("radius") * F.col("radius")) if circle else (F.col("_dx") <= F.col("radius")) & (F.col("_dy") <= F.col("radius"))
    return near.where(inside).join(cells, ["row", "col"]).groupBy("site", "radius").agg(F.count(value).alias("n"), F.median(value).alias("median"), F.avg(value).alias("mean"))


def focal_median(points: DataFrame, cells: DataFrame, radius: int, value: str = "value") -> DataFrame:
    """Median of the disk of cells around each point's cell, as a whole number; -1 where none is given."""
    offsets = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    disk = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets]))
    near = points.select("id", F.col("row").alias("_r"), F.col("col").alias("_c"), disk.alias("q")).select("id", (F.col("_r") + F.col("q.a")).alias("row"), (F.col("_c") + F.col("q.b")).alias("col"))
    return near.join(cells, ["row", "col"], "left").groupBy("id").agg(F.coalesce(F.median(value), F.lit(-1.0)).cast("int").alias("median"))


def interior_cells(polygons: DataFrame, grid: GridSpec, key: str, margin: float, rings: str = "rings") -> DataFrame:
    """Cells of each polygon whose centre is at least margin from its boundary: strips less the intervals near an edge."""
    def cells(e: np.ndarray, top: int, rows: int, cols: int) -> np.ndarray:
        return geo.strip_centres(e, top, rows, cols) & ~geo.strip_near(e, top, rows, cols, margin / grid.res)

    return strip_cells(polygons, grid, [key], cells, rings).drop("value")


def line_walks(lines: DataFrame, grid: GridSpec, key: str, points: str = "points") -> DataFrame:
    """(key, k, row, col, len): the cells that each line (array of x, y) runs through, in order, with its exact length in each."""
    rows = lines.select(key, points)

    def run(batches):
        for batch in batches:
            for i, line in enumerate(batch.column(points)):
                p = np.array([(v["x"], v["y"]) for v in line.as_py() or []], float).reshape(-1, 2)
                if len(p) < 2:
                    continue
                e = np.c_[(p[:-1, 0] - grid.x0) / grid.res, (grid.y1 - p[:-1, 1]) / grid.res, (p[1:, 0] - grid.x0) / grid.res, (grid.y1 - p[1:, 1]) / grid.res]
                cut = geo.cut_by_lines(geo.cut_by_lines(e, 1), 0)
                length = np.hypot(*(cut[:, 2:] - cut[:, :2]).T) * grid.res
                cut, length = cut[length > 0], length[length > 0]
                at = np.floor((cut[:, :2] + cut[:, 2:]) / 2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.full(len(cut), i))), pa.array(np.arange(len(cut))), pa.array(at[:, 1]), pa.array(at[:, 0]), pa.array(length)], names=[key, "k", "row", "col", "len"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, k bigint, row int, col int, len double")


def line_crossings(patch_cells: DataFrame, lines: DataFrame, grid: GridSpec, key: str = "line", points: str = "points") -> DataFrame:
    """(key, label, length, crossings) of each line within each patch of cells (row, col, label): its exact length, and how often it enters.

    Lines are walked cell by cell in tasks; what is joined are cells. A patch is entered at each piece whose predecessor on the line isn't in it.
    """
    inside = line_walks(lines, grid, key, points).join(patch_cells, ["row", "col"])
    before = inside.select(key, "label", (F.col("k") + 1).alias("k"), F.lit(1).alias("_in"))
    return inside.join(before, [key, "label", "k"], "left").groupBy(key, "label").agg(F.sum("len").alias("length"), F.sum(F.when(F.col("_in").isNull(), 1).otherwise(0)).alias("crossings"))
