"""Cells and grids: nearest cells, alignment, block means, masks, morphology, patches.

A layer is (row, col, value). Regular grids are joined on integer arithmetic, never by distance over all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envgrid.sources.stages import stage, unstage


@dataclass(frozen=True)
class GridSpec:
    """A regular grid, rows from the top: x0 and y1 are its left and upper edge."""

    x0: float
    y1: float
    res: float
    nx: int
    ny: int

    def col(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.res).cast("int")

    def row(self, y: Column) -> Column:
        return F.floor((self.y1 - y) / self.res).cast("int")

    def x(self, col: Column) -> Column:
        return self.x0 + (col + 0.5) * self.res

    def y(self, row: Column) -> Column:
        return self.y1 - (row + 0.5) * self.res

    def inside(self, row: Column, col: Column) -> Column:
        return row.between(0, self.ny - 1) & col.between(0, self.nx - 1)


def nearest_index(x: Column, first: float, step: float, n: int | None = None) -> Column:
    """Place of the nearest of the values first, first + step, …; with n clipped to the grid. Half-way goes to the even place."""
    k = F.rint((x - first) / step).cast("int")
    return k if n is None else F.least(F.greatest(k, F.lit(0)), F.lit(n - 1))


def nearest_on_axis(points: DataFrame, axis: DataFrame, x: str, at: str, place: str) -> DataFrame:
    """Nearest value of a sorted irregular axis: each axis value owns the stretch between the midpoints to its neighbours.

    The axis must be a grid's (its length is bounded by the grid, not the points), so its stretches are broadcast.
    """
    w = Window.orderBy(at)
    own = axis.select(place, ((F.col(at) + F.lag(at).over(w)) / 2).alias("_lo"), ((F.col(at) + F.lead(at).over(w)) / 2).alias("_hi"))
    inside = (F.col("_lo").isNull() | (points[x] > F.col("_lo"))) & (F.col("_hi").isNull() | (points[x] <= F.col("_hi")))
    return points.join(F.broadcast(own), inside).drop("_lo", "_hi")


def block_mean(layer: DataFrame, k: int, least: int = 1, ny: int | None = None, nx: int | None = None) -> DataFrame:
    """Mean of k x k blocks with at least ``least`` values; with ny and nx, partial blocks at the far edges are left out."""
    if ny is not None and nx is not None:
        layer = layer.where((F.col("row") < ny // k * k) & (F.col("col") < nx // k * k))
    return layer.groupBy(F.expr(f"row div {k}").alias("row"), F.expr(f"col div {k}").alias("col")).agg(F.when(F.count("value") >= least, F.avg("value")).alias("value"), F.count("value").alias("n"))


def area_average(layer: DataFrame, source: GridSpec, target: GridSpec) -> DataFrame:
    """(row, col, value, covered) on a target grid of any size and place: the mean of the source cells by the area that they share, and the share of the target cell that cells with a value cover.

    Shared areas are products of shared lengths, so rows are summed up first and columns after them; each source cell
    goes to the target rows that it reaches and what is left of it to the target columns.
    """
    def reached(df: DataFrame, at: str, first: float, size: float, start: float, step: float, n: int, sign: int) -> DataFrame:
        """df once for each target place that its source place reaches, with the length that they share."""
        lo = sign * (first - start) + F.col(at) * size  # measured from the target's edge
        a, b = F.greatest(F.lit(0), F.floor(lo / step + 1e-9)), F.least(F.lit(n - 1), F.ceil((lo + size) / step - 1e-9) - 1)
        far = df.where(a <= b).withColumn("_lo", lo).select("*", F.explode(F.sequence(a.cast("int"), b.cast("int"))).alias("_at"))
        return far.withColumn("_len", F.least(F.col("_lo") + size, (F.col("_at") + 1) * step) - F.greatest("_lo", F.col("_at") * step)).drop(at, "_lo").withColumnRenamed("_at", at)

    rows = reached(layer.where(F.col("value").isNotNull()).select("row", "col", "value"), "row", source.y1, source.res, target.y1, target.res, target.ny, -1)
    summed = rows.groupBy("row", "col").agg(F.sum(F.col("value") * F.col("_len")).alias("_v"), F.sum("_len").alias("_w"))
    both = reached(summed, "col", source.x0, source.res, target.x0, target.res, target.nx, 1)
    whole = F.sum(F.col("_w") * F.col("_len"))
    return both.groupBy("row", "col").agg((F.sum(F.col("_v") * F.col("_len")) / whole).alias("value"), (whole / target.res**2).alias("covered"))


def gather_coarse(fine: DataFrame, coarse: DataFrame, k: int, keep: Sequence[str]) -> DataFrame:
    """Each fine cell with the values of the coarse cell (k times as wide) that it lies in."""
    at = fine.withColumn("_r", F.expr(f"row div {k}")).withColumn("_c", F.expr(f"col div {k}"))
    other = coarse.select(F.col("row").alias("_r"), F.col("col").alias("_c"), *keep)
    return at.join(other, ["_r", "_c"], "left").drop("_r", "_c")


def bilinear(points: DataFrame, layer: DataFrame, y: str = "fy", x: str = "fx", key: Sequence[str] = ("id",)) -> DataFrame:
    """Value at fractional cell coordinates from the four cells around; missing ones are left out of the weights."""
    corners = points.select(*key, F.floor(y).alias("r0"), F.floor(x).alias("c0"), (F.col(y) - F.floor(y)).alias("dy"), (F.col(x) - F.floor(x)).alias("dx"))
    four = corners.select(*key, F.explode(F.array(*[F.struct((F.col("r0") + a).cast("int").alias("row"), (F.col("c0") + b).cast("int").alias("col"), ((F.col("dy") if a else 1 - F.col("dy")) * (F.col("dx") if b else 1 - F.col("dx"))).alias("w")) for a in (0, 1) for b in (0, 1)])).alias("q")).select(*key, "q.*")
    hit = four.join(layer.select("row", "col", "value"), ["row", "col"])
    return hit.groupBy(*key).agg((F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum(F.when(F.col("value").isNotNull(), F.col("w"))), F.lit(0.0))).alias("value"))


def stack(layers: dict[str, DataFrame]) -> DataFrame:
    """Layers of one grid side by side, on every cell that one has; one shuffle of all, none for each layer."""
    long = None
    for name, df in layers.items():
        part = df.select("row", "col", F.lit(name).alias("_layer"), F.col("value").cast("double").alias("value"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy("row", "col").agg(*[F.max(F.when(F.col("_layer") == n, F.col("value"))).alias(n) for n in layers])


def first_wins(df: DataFrame, order: str, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Of overlapping tiles the value of the first that has one."""
    return df.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.min_by("value", order).alias("value"))


def latest_wins(df: DataFrame, order: str, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Of overlapping polygons the value of the one burnt last."""
    return df.groupBy(*keys).agg(F.max_by("value", order).alias("value"))


def box_counts(layer: DataFrame, mask: Column, k: int) -> DataFrame:
    """Adds n_box: cells of the (2k+1) squared window around that the mask holds for; one pass along rows, one along columns."""
    along = Window.partitionBy("row").orderBy("col").rangeBetween(-k, k)
    across = Window.partitionBy("col").orderBy("row").rangeBetween(-k, k)
    return layer.withColumn("_m", F.when(mask, 1).otherwise(0)).withColumn("_s", F.sum("_m").over(along)).withColumn("n_box", F.sum("_s").over(across)).drop("_m", "_s")


def solid_cells(layer: DataFrame, mask: Column, k: int, stride: tuple[int, int] = (1, 1)) -> DataFrame:
    """Cells on the stride whose whole window fulfils the mask; the first in row order is a site for sampling."""
    n = (2 * k + 1) ** 2
    return box_counts(layer, mask, k).where((F.col("n_box") == n) & (F.col("row") % stride[0] == 0) & (F.col("col") % stride[1] == 0))


STRETCH = 64
CROSS = ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))


def _around(cells: DataFrame) -> DataFrame:
    return cells.select(F.explode(F.array(*[F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col")) for a, b in CROSS])).alias("q")).select("q.row", "q.col")


def erode(cells: DataFrame) -> DataFrame:
    """Cells whose four neighbours are set as well; outside the set counts as not set."""
    return _around(cells).groupBy("row", "col").agg(F.count("*").alias("_n")).where(F.col("_n") == 5).select("row", "col")


def dilate(cells: DataFrame, ny: int | None = None, nx: int | None = None) -> DataFrame:
    """Cells that are set or beside one; within the frame, if it is given."""
    out = _around(cells).distinct()
    return out if ny is None else out.where(F.col("row").between(0, ny - 1) & F.col("col").between(0, nx - 1))


def opening(cells: DataFrame, times: int = 1, ny: int | None = None, nx: int | None = None) -> DataFrame:
    for _ in range(times):
        cells = erode(cells)
    for _ in range(times):
        cells = dilate(cells, ny, nx)
    return cells


def closing(cells: DataFrame, times: int = 1, ny: int | None = None, nx: int | None = None) -> DataFrame:
    for _ in range(times):
        cells = dilate(cells, ny, nx)
    for _ in range(times):
        cells = erode(cells)
    return cells


def components(cells: DataFrame) -> DataFrame:
    """(row, col, label) of 4-connected patches; the label is the least run number of the patch.

    Cells are first merged into runs along their row, then runs that touch spread the least label, with a jump to the
    label's own label in each round; every round is staged, so the lineage stays short and nothing is recomputed.
    """
    w = Window.partitionBy("row").orderBy("col")
    runs = cells.select("row", "col", (F.col("col") - F.row_number().over(w)).alias("g")).groupBy("row", "g").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    runs = stage(runs.select("row", "a", "b", (F.col("row").cast("long") * (1 << 31) + F.col("a")).alias("run")), "runs")
    # runs meet where they share a stretch of columns, so a row of many runs isn't paired with all of the next
    part = F.explode(F.sequence(F.expr(f"a div {STRETCH}"), F.expr(f"b div {STRETCH}"))).alias("part")
    upper = runs.select("row", part, "a", "b", "run")
    lower = runs.select((F.col("row") - 1).alias("row"), part, F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("run").alias("near"))
    touch = upper.join(lower, ["row", "part"]).where("a <= b2 AND a2 <= b").select("run", "near").distinct()
    edges = stage(touch.unionByName(touch.select(F.col("near").alias("run"), F.col("run").alias("near"))), "touch")
    at = labels = stage(runs.select("run", F.col("run").alias("label")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("run").alias("near"), "label"), "near").groupBy("run").agg(F.min("label").alias("heard"))
        moved = labels.join(heard, "run", "left").select("run", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        own = labels.select(F.col("run").alias("label"), F.col("label").alias("next"))
        jumped = stage(moved.join(own, "label").select("run", "old", F.col("next").alias("label")), "labels")
        unstage(at)
        at, labels = jumped, jumped.select("run", "label")
        if jumped.where("old <> label").isEmpty():
            break
    return runs.join(labels, "run").select("row", F.explode(F.sequence("a", "b")).alias("col"), "label")


def patches(labelled: DataFrame, layer: DataFrame, cell_area: float, least_area: float, means: Sequence[str]) -> DataFrame:
    """Patches of at least least_area with their area and the mean of each layer column."""
    out = labelled.join(layer.select("row", "col", *means), ["row", "col"], "left").groupBy("label").agg((F.count("*") * cell_area).alias("area"), *[F.avg(c).alias(f"mean_{c}") for c in means])
    return out.where(F.col("area") >= least_area)
