"""Statistics of the neighbourhood of every cell, at several radii, by sliding histograms.

Cells are dealt into tiles, each with a margin of its neighbours' cells as wide as the largest radius, so a tile's work is bounded
whatever the layer. Within a tile all rows slide from column to column together: a step takes one edge of the neighbourhood out of each
row's histogram and adds the other, and the middle ranks are found in two levels of bins. A cell costs as many
updates as its neighbourhood has rows, not as many as it has cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 128


def half_widths(radius: float, circle: bool) -> np.ndarray:
    """Cells to either side in the rows -radius to radius of a neighbourhood, by their centres' distance."""
    r = int(np.floor(radius))
    dy = np.arange(-r, r + 1)
    return np.floor(np.sqrt(radius * radius - dy * dy) + 1e-9).astype(np.int64) if circle else np.full(2 * r + 1, r)


def slide(values: np.ndarray, margin: int, radius: float, circle: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, median, mean) of the neighbourhoods of all cells of an array but its margin; missing cells are NaN."""
    half = half_widths(radius, circle)
    r, rows, cols = len(half) // 2, values.shape[0] - 2 * margin, values.shape[1] - 2 * margin
    given = ~np.isnan(values)
    distinct, rank = np.unique(values[given], return_inverse=True)
    n, median, total = np.zeros((rows, cols), np.int64), np.full((rows, cols), np.nan), np.zeros((rows, cols))
    if not len(distinct):
        return n, median, total * np.nan
    place = np.full(values.shape, -1, np.int64)
    place[given] = rank
    wide = int(np.ceil(np.sqrt(len(distinct))))  # values in a bin
    fine, coarse = np.zeros((rows, wide * wide + wide), np.int32), np.zeros((rows, wide + 1), np.int32)
    line = np.arange(rows)[:, None] + margin + np.arange(-r, r + 1)[None, :]  # each row's rows
    own = np.repeat(np.arange(rows), 2 * r + 1).reshape(rows, -1)

    def change(column: np.ndarray, by: int, in_rows: np.ndarray | slice = slice(None)) -> None:
        k, o = place[line[:, in_rows], column[None, :]], own[:, in_rows]
        some = k >= 0
        np.add.at(fine, (o[some], k[some]), by)
        np.add.at(coarse, (o[some], k[some] // wide), by)

    def at_rank(want: np.ndarray) -> np.ndarray:
        """The value of each row's histogram at a rank from 0."""
        upto = np.cumsum(coarse, axis=1)
        bin_ = np.minimum((upto <= want[:, None]).sum(axis=1), wide)  # a row without values has none
        rest = want - np.where(bin_ > 0, upto[np.arange(rows), bin_ - 1], 0)
        inside = np.cumsum(fine[np.arange(rows)[:, None], bin_[:, None] * wide + np.arange(wide)[None, :]], axis=1)
        return distinct[np.minimum(bin_ * wide + (inside <= rest[:, None]).sum(axis=1), len(distinct) - 1)]

    for step in range(-int(half.max()), int(half.max()) + 1):  # the first column's neighbourhood
        some = np.flatnonzero(np.abs(step) <= half)
        change(np.full(len(some), margin + step), 1, some)
    for c in range(cols):
        if c:
            change(margin + c - 1 - half, -1)
            change(margin + c + half, 1)
        count = coarse.sum(axis=1)
        n[:, c] = count
        low, high = at_rank(np.maximum(0, (count - 1) // 2)), at_rank(np.maximum(0, count // 2))
        median[:, c] = np.where(count > 0, low + (high - low) * 0.5, np.nan)
    sums = np.concatenate([np.zeros((values.shape[0], 1)), np.cumsum(np.where(given, values, 0.0), axis=1)], axis=1)
    for k, w in enumerate(half):
        band = sums[margin + k - r : margin + k - r + rows]
        total += band[:, margin + w + 1 : margin + w + 1 + cols] - band[:, margin - w : margin - w + cols]
    with np.errstate(invalid="ignore", divide="ignore"):
        return n, median, np.where(n > 0, total / n, np.nan)


def focal_statistics(cells: DataFrame, radii: Sequence[float], circle: bool = True, value: str = "value") -> DataFrame:
    """(row, col, radius, n, median, mean) of the cells within each radius (in cells) of every cell of (row, col, value), its own included; missing values don't count."""
    reach = int(max(np.floor(r) for r in radii))
    tile = lambda c, d: F.floor((F.col(c) + d) / TILE).cast("int")
    spread = lambda c: F.explode(F.sequence(tile(c, -reach), tile(c, reach)))
    dealt = cells.select("row", "col", F.col(value).cast("double").alias("value")).withColumn("tr", spread("row")).withColumn("tc", spread("col"))

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[0]) * TILE, int(key[1]) * TILE
        r, c = df["row"].to_numpy() - top, df["col"].to_numpy() - left
        mine = (r >= 0) & (r < TILE) & (c >= 0) & (c < TILE)
        r, c, v = r + reach, c + reach, df["value"].to_numpy(float)
        if not mine.any():
            return pd.DataFrame({k: [] for k in ("row", "col", "radius", "n", "median", "mean")})
        values = np.full((TILE + 2 * reach,) * 2, np.nan)
        values[r, c] = v
        at, out = (r[mine] - reach, c[mine] - reach), []
        for radius in radii:
            n, median, mean = slide(values, reach, radius, circle)
            out.append(pd.DataFrame({"row": at[0] + top, "col": at[1] + left, "radius": float(radius), "n": n[at], "median": median[at], "mean": mean[at]}))
        return pd.concat(out)

    done = dealt.groupBy("tr", "tc").applyInPandas(run, "row int, col int, radius double, n bigint, median double, mean double")
    return done.select("row", "col", "radius", "n", *[F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("median", "mean")])
