"""Scored layers as display tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envgrid.functions.scalars import palette_index, twin_byte
from envgrid.operators.grid import GridSpec
from envgrid.operators.zonal import dissolved


def display_table(layer: DataFrame, source: GridSpec, region: DataFrame, display: GridSpec, lo: float, hi: float, levels: int, rings: str = "rings") -> DataFrame:
    """(row, col, twin, palette) of the display grid's cells whose centre lies in the region's polygons.

    Each has the value of the source cell that its centre is in, as a byte of 1 to 255 over lo to hi and as one of the
    palette's levels; both are 0 where there is no value.
    """
    cells = dissolved(region, display, rings)
    at = cells.select("row", "col", source.row(display.y(F.col("row"))).alias("_r"), source.col(display.x(F.col("col"))).alias("_c"))
    found = at.join(layer.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value"), ["_r", "_c"], "left")
    return found.select("row", "col", twin_byte(F.col("value"), lo, hi).alias("twin"), palette_index(F.col("value"), lo, hi, levels).alias("palette"))
