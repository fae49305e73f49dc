"""Soil, forest and wet ground: attribute tables and layers to summaries of a region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envgrid.functions.scalars import capacity_mm, drainage_ordinal, forest_group
from envgrid.operators import grid as cells
from envgrid.operators import zonal
from envgrid.operators.index import class_totals
from envgrid.sources import io


def soil_units(texts: DataFrame) -> DataFrame:
    """(mukey, muname, drainage, capacity) from header-row tables of map units: drainage 1 (dry) to 7 (wet), capacity of the root zone in mm."""
    u = io.header_rows(texts, ["mukey", "muname", "drainagecl", "aws100", "aws25"])
    return u.select("mukey", "muname", drainage_ordinal(F.col("drainagecl")).alias("drainage"), capacity_mm(io.numeric("aws100"), io.numeric("aws25")).alias("capacity"))


def soil_layers(units: DataFrame, polygons: DataFrame, spec: cells.GridSpec, order: str = "mukey", rings: str = "rings") -> DataFrame:
    """(row, col, mukey, muname, drainage, capacity) of the cells in the map units' polygons (mukey, rings)."""
    return zonal.burn(polygons, spec, "mukey", order, rings).withColumnRenamed("value", "mukey").join(units, "mukey").select("row", "col", "mukey", "muname", "drainage", "capacity")


def soil_summary(layers: DataFrame, spec: cells.GridSpec, by: str = "drainage", top: int | None = None) -> DataFrame:
    """Area, mean capacity and share of each drainage class, or of the largest map units."""
    return class_totals(layers.withColumn("_a", F.lit(float(spec.res**2))), by, "_a", "capacity", top)


def forest_summary(codes: DataFrame, share: DataFrame, cell_area: float, least: float = 0.0, top: int | None = None) -> DataFrame:
    """(forest, area, mean_attr, pct) of the type groups of a code layer, with the mean of another layer where it is above ``least``."""
    named = codes.where("value IS NOT NULL").select("row", "col", forest_group(F.col("value").cast("int")).alias("forest"), F.lit(float(cell_area)).alias("_a"))
    other = share.select("row", "col", F.when(F.col("value") > least, F.col("value")).alias("_s"))
    return class_totals(named.join(other, ["row", "col"], "left"), "forest", "_a", "_s", top)


def wet_patches(layer: DataFrame, wet: Column, spec: cells.GridSpec, least_area: float, water: DataFrame, line: Sequence[tuple[float, float]], radius: int = 5, reach: float = 4.0) -> DataFrame:
    """(label, area, mean, row, col, median, distance, length) of the patches of wet ground.

    The mask is opened once and closed twice, patches are labelled and small ones left out; row and col are of the patch's
    middle, median is that of the disk of cells around it, distance goes from it to the nearest water, and length is that
    of the line within the patch.
    """
    mask = cells.closing(cells.opening(layer.where(wet).select("row", "col")), 2)
    labelled = cells.components(mask)
    found = cells.patches(labelled, layer, spec.res**2, least_area, ["value"]).withColumnRenamed("mean_value", "mean")
    middle = labelled.groupBy("label").agg(F.floor(F.avg("row")).cast("int").alias("row"), F.floor(F.avg("col")).cast("int").alias("col"))
    some = found.join(middle, "label")
    at = some.select(F.col("label").alias("id"), "row", "col", spec.x(F.col("col")).alias("x"), spec.y(F.col("row")).alias("y"))
    median = zonal.focal_median(at, layer, radius).withColumnRenamed("id", "label")
    distance = zonal.nearest_distance(at, water, "id", reach).withColumnRenamed("id", "label")
    way = layer.sparkSession.createDataFrame([(0, [{"x": float(x), "y": float(y)} for x, y in line])], "line int, points array<struct<x:double,y:double>>")
    length = zonal.line_crossings(labelled, way, spec).select("label", "length")
    return some.join(median, "label").join(distance, "label").join(length, "label", "left").select("label", "area", "mean", "row", "col", "median", "distance", F.coalesce("length", F.lit(0.0)).alias("length"))
