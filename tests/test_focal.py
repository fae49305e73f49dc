"""Sliding histograms against each neighbourhood by itself."""

import numpy as np
import pytest

from envgrid.operators import focal


@pytest.mark.parametrize(("radius", "circle"), [(0, True), (1.5, True), (3, True), (5, False), (2, False)])
def test_slide(radius, circle):
    rng = np.random.default_rng(int(radius * 10))
    v = rng.integers(0, 9, (23, 30)) / 4
    v[rng.random(v.shape) < 0.3] = np.nan
    v[:12, :14] = np.nan
    n, median, mean = focal.slide(v, 6, radius, circle)
    for r in range(6, 17):
        for c in range(6, 24):
            dy, dx = np.meshgrid(np.arange(23) - r, np.arange(30) - c, indexing="ij")
            near = (dy * dy + dx * dx <= radius * radius) if circle else (np.abs(dy) <= radius) & (np.abs(dx) <= radius)
            x = v[near & ~np.isnan(v)]
            got = (n[r - 6, c - 6], median[r - 6, c - 6], mean[r - 6, c - 6])
            assert got == pytest.approx((len(x), np.median(x) if len(x) else np.nan, x.mean() if len(x) else np.nan), nan_ok=True), (r, c)


def test_tiles_meet(spark):
    """Cells on both sides of tile borders, negative places, and a cell alone."""
    rng = np.random.default_rng(1)
    rows = [(r, c, None if (r + c) % 7 == 0 else float(rng.integers(0, 50))) for r in range(122, 135) for c in (*range(-6, 5), *range(125, 131))] + [(900, 900, None), (901, 950, 3.0)]
    df = spark.createDataFrame(rows, "row int, col int, value double")
    at = {(r, c): v for r, c, v in rows}
    got = {(x["row"], x["col"], x["radius"]): (x["n"], x["median"], x["mean"]) for x in focal.focal_statistics(df, [1, 3.2]).collect()}
    assert len(got) == 2 * len(rows)
    for (r, c, radius), x in got.items():
        near = [v for (a, b), v in at.items() if (a - r) ** 2 + (b - c) ** 2 <= radius**2 and v is not None]
        assert x == ((len(near), pytest.approx(np.median(near)), pytest.approx(np.mean(near))) if near else (0, None, None))
    assert focal.focal_statistics(df.limit(0), [2]).count() == 0
