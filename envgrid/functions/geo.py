"""Projections and ring functions as columns; exact areas and centres of cells as arrays.

A polygon is array<array<struct<x,y>>>, each ring closed. Outer rings run clockwise, holes counter-clockwise.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def to_mercator(lon: Column, lat: Column, radius: float = 6378137.0) -> tuple[Column, Column]:
    """Spherical Mercator (3857)."""
    return F.radians(lon) * radius, F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * radius


def from_mercator(x: Column, y: Column, radius: float = 6378137.0) -> tuple[Column, Column]:
    return F.degrees(x / radius), F.degrees(2 * F.atan(F.exp(y / radius)) - F.pi() / 2)


def to_utm(lon: Column, lat: Column, zone: int = 19) -> tuple[Column, Column]:
    """UTM north on WGS84 by the Krüger series to the third order."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, al in enumerate(alpha, 1):
        x = x + al * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + al * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + k0 * big_a * x, k0 * big_a * y


def to_lambert(lon: Column, lat: Column, lat1: float, lat2: float, lat0: float, lon0: float, x0: float = 0.0, y0: float = 0.0, a: float = 6370000.0, f: float = 0.0) -> tuple[Column, Column]:
    """Lambert conformal conic with one or two standard parallels, on a sphere (f = 0) or an ellipsoid."""
    e = math.sqrt(2 * f - f * f)

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def t(p: float) -> float:
        return math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)

    p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
    n = math.sin(p1) if lat1 == lat2 else math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    big_f = m(p1) / (n * t(p1) ** n)
    r0 = a * big_f * t(p0) ** n
    s = e * F.sin(F.radians(lat))
    tc = F.tan(F.pi() / 4 - F.radians(lat) / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    r, theta = a * big_f * F.pow(tc, F.lit(n)), n * F.radians(lon - lon0)
    return x0 + r * F.sin(theta), y0 + r0 - r * F.cos(theta)


def to_mass_mainland(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG 26986."""
    return to_lambert(lon, lat, 42.683333333333334, 41.71666666666667, 41.0, -71.5, 200000.0, 750000.0, 6378137.0, 1 / 298.257222101)


def to_hrrr(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The forecast grid's Lambert projection on its sphere."""
    return to_lambert(lon, lat, 38.5, 38.5, 38.5, -97.5, a=6371229.0)


def signed_area(ring: str) -> Column:
    """Shoelace area of the SQL expression of a ring, positive if counter-clockwise."""
    return F.expr(f"aggregate(sequence(1, greatest(1, size({ring}) - 1)), 0D, (s, k) -> s + coalesce(get({ring}, k - 1).x * get({ring}, k).y - get({ring}, k).x * get({ring}, k - 1).y, 0D)) / 2")


def polygon_area(rings: str) -> Column:
    """Outer rings less holes: the clockwise areas count, the others are taken off."""
    return F.expr(
        f"aggregate({rings}, 0D, (t, r) -> t - aggregate(sequence(1, greatest(1, size(r) - 1)), 0D, (s, k) -> s + coalesce(get(r, k - 1).x * get(r, k).y - get(r, k).x * get(r, k - 1).y, 0D)) / 2)"
    )


def ring_roles(rings: str) -> Column:
    """array<struct<ring, outer>>: Esri's convention, clockwise rings are outer."""
    return F.expr(f"transform({rings}, r -> struct(r AS ring, aggregate(sequence(1, greatest(1, size(r) - 1)), 0D, (s, k) -> s + coalesce(get(r, k - 1).x * get(r, k).y - get(r, k).x * get(r, k - 1).y, 0D)) < 0 AS outer))")


def line_length(points: str) -> Column:
    return F.expr(f"aggregate(sequence(1, greatest(1, size({points}) - 1)), 0D, (s, k) -> s + coalesce(sqrt(power(get({points}, k).x - get({points}, k - 1).x, 2) + power(get({points}, k).y - get({points}, k - 1).y, 2)), 0D))")


def contains_point(rings: str, x: str, y: str) -> Column:
    """Even-odd rule over all rings, holes included."""
    crosses = (
        f"((get(r, k - 1).y > {y}) <> (get(r, k).y > {y})) AND {x} < (get(r, k).x - get(r, k - 1).x) * ({y} - get(r, k - 1).y) / nullif(get(r, k).y - get(r, k - 1).y, 0) + get(r, k - 1).x"
    )
    return F.expr(f"aggregate({rings}, 0, (n, r) -> n + aggregate(sequence(1, greatest(1, size(r) - 1)), 0, (m, k) -> m + if(coalesce({crosses}, false), 1, 0))) % 2 = 1")


def boundary_distance(rings: str, x: str, y: str) -> Column:
    """Distance of a point to the nearest ring segment."""
    seg = f"""(p, q) -> sqrt(power({x} - (p.x + greatest(0D, least(1D, coalesce((({x} - p.x) * (q.x - p.x) + ({y} - p.y) * (q.y - p.y)) / nullif(power(q.x - p.x, 2) + power(q.y - p.y, 2), 0D), 0D))) * (q.x - p.x)), 2)
        + power({y} - (p.y + greatest(0D, least(1D, coalesce((({x} - p.x) * (q.x - p.x) + ({y} - p.y) * (q.y - p.y)) / nullif(power(q.x - p.x, 2) + power(q.y - p.y, 2), 0D), 0D))) * (q.y - p.y)), 2))"""
    return F.expr(f"array_min(flatten(transform({rings}, r -> zip_with(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1), {seg}))))")


def polygon_distance(rings: str, x: str, y: str) -> Column:
    """0 inside, else the distance to the boundary."""
    return F.when(contains_point(rings, x, y), 0.0).otherwise(boundary_distance(rings, x, y))


def bounds(rings: str) -> Column:
    """struct<x0, y0, x1, y1> of a polygon."""
    flat = f"flatten({rings})"
    return F.expr(f"named_struct('x0', array_min(transform({flat}, p -> p.x)), 'y0', array_min(transform({flat}, p -> p.y)), 'x1', array_max(transform({flat}, p -> p.x)), 'y1', array_max(transform({flat}, p -> p.y)))")


def polygon_valid(rings: str) -> Column:
    """There is a ring, all are closed and have four points or more, and the area is above 0."""
    closed = F.expr(f"coalesce(size({rings}), 0) > 0 AND NOT exists({rings}, r -> size(r) < 4 OR get(r, 0).x <> get(r, size(r) - 1).x OR get(r, 0).y <> get(r, size(r) - 1).y)")
    return F.coalesce(closed & (F.abs(polygon_area(rings)) > 0), F.lit(False))


def wkt_rings(wkt: str) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON text."""
    return F.expr(
        f"transform(regexp_extract_all({wkt}, '\\\\(([^()]+)\\\\)', 1), r -> transform(split(r, ','), p -> named_struct('x', cast(split(trim(p), '\\\\s+')[0] AS double), 'y', cast(split(trim(p), '\\\\s+')[1] AS double))))"
    )


def meets_box(rings: str, x0: str, y0: str, x1: str, y1: str) -> Column:
    """A polygon and a box share area: an edge runs through the box, or none does and the box's middle is inside."""
    def span(c: str, lo: str, hi: str) -> tuple[str, str]:
        """Least and greatest place along p to q, from 0 to 1, between two limits of an axis."""
        d = f"(q.{c} - p.{c})"
        at = [f"(({b}) - p.{c}) / {d}" for b in (lo, hi)]
        flat = f"p.{c} > {lo} AND p.{c} < {hi}"
        return f"if({d} = 0D, if({flat}, 0D, 1D), least({at[0]}, {at[1]}))", f"if({d} = 0D, if({flat}, 1D, 0D), greatest({at[0]}, {at[1]}))"

    (a, b), (c, d) = span("x", x0, x1), span("y", y0, y1)
    through = f"exists({rings}, r -> exists(zip_with(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1), (p, q) -> greatest(0D, {a}, {c}) < least(1D, {b}, {d})), t -> t))"
    return F.expr(through) | contains_point(rings, f"(({x0}) + ({x1})) / 2", f"(({y0}) + ({y1})) / 2")


def edges(rings: list) -> np.ndarray:
    """(xa, ya, xb, yb) of all ring segments of a polygon given as lists of {x, y}."""
    out = []
    for r in rings or ():
        p = np.array([(v["x"], v["y"]) for v in r], float).reshape(-1, 2)
        if len(p) > 1:
            out.append(np.c_[p[:-1], p[1:]])
    return np.concatenate(out) if out else np.zeros((0, 4))


def cut_by_lines(e: np.ndarray, axis: int) -> np.ndarray:
    """Segments cut at every whole number of an axis that they cross."""
    lo, hi = np.minimum(e[:, axis], e[:, axis + 2]), np.maximum(e[:, axis], e[:, axis + 2])
    first, last = np.floor(lo) + 1, np.ceil(hi) - 1  # lines strictly between the ends
    n = np.maximum(0, last - first + 1).astype(np.int64)
    own = np.repeat(np.arange(len(e)), n + 1)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    up = e[own, axis + 2] >= e[own, axis]
    with np.errstate(divide="ignore", invalid="ignore"):
        def at(j):  # the place along the segment of its j-th line
            line = np.where(up, first[own] + j - 1, last[own] - j + 1)
            return np.where(j <= 0, 0.0, np.where(j > n[own], 1.0, (line - e[own, axis]) / (e[own, axis + 2] - e[own, axis])))

        a, b = at(k), at(k + 1)
    d = e[own, 2:] - e[own, :2]
    out = np.c_[e[own, :2] + a[:, None] * d, e[own, :2] + b[:, None] * d]
    out[k == 0, :2] = e[own[k == 0], :2]
    out[k == n[own], 2:] = e[own[k == n[own]], 2:]
    return out


def strip_areas(e: np.ndarray, top: int, rows: int, cols: int) -> np.ndarray:
    """(rows, cols) areas of a polygon within the unit cells of a strip that begins at row top, from its segments in cell units (x right, y down).

    Each piece of an edge adds the area between itself and the right side of its cell, and its height to all cells behind.
    """
    low, high = float(top), float(top + rows)
    e = e[(np.minimum(e[:, 1], e[:, 3]) < high) & (np.maximum(e[:, 1], e[:, 3]) > low)]
    e = cut_by_lines(cut_by_lines(e, 1), 0)
    middle = (e[:, :2] + e[:, 2:]) / 2
    r, c = np.floor(middle[:, 1]).astype(np.int64) - top, np.floor(middle[:, 0]).astype(np.int64)
    here = (r >= 0) & (r < rows) & (c < cols)
    r, c, dy, x = r[here], c[here], (e[:, 3] - e[:, 1])[here], middle[here, 0]
    before = c < 0  # left of the frame: the whole row is behind
    own, behind = np.zeros((rows, cols)), np.zeros((rows, cols + 1))
    np.add.at(own, (r[~before], c[~before]), dy[~before] * (c[~before] + 1 - x[~before]))
    np.add.at(behind, (r, np.where(before, 0, c + 1)), dy)
    return np.abs(own + np.cumsum(behind, axis=1)[:, :cols])


def strip_centres(e: np.ndarray, top: int, rows: int, cols: int) -> np.ndarray:
    """(rows, cols) whether the centres of a strip's unit cells are inside, by the even-odd rule over all rings."""
    flips = np.zeros((rows, cols + 1), np.int64)
    lo, hi = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    first = np.maximum(np.ceil(lo - 0.5), top).astype(np.int64)  # centres y with lo <= y < hi
    last = np.minimum(np.ceil(hi - 0.5) - 1, top + rows - 1).astype(np.int64)
    n = np.maximum(0, last - first + 1)
    own = np.repeat(np.arange(len(e)), n)
    r = np.repeat(first, n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    x = e[own, 0] + (e[own, 2] - e[own, 0]) * (r + 0.5 - e[own, 1]) / (e[own, 3] - e[own, 1])
    np.add.at(flips, (r - top, np.clip(np.ceil(x - 0.5), 0, cols).astype(np.int64)), 1)
    return np.cumsum(flips, axis=1)[:, :cols] % 2 == 1


def strip_near(e: np.ndarray, top: int, rows: int, cols: int, margin: float) -> np.ndarray:
    """(rows, cols) whether the centres of a strip's unit cells are closer than margin to a segment.

    What is within margin of a segment is convex, so a row of centres meets it in one interval, whose ends come from the two
    circles and the rectangle between them; intervals are counted up along the row.
    """
    e = e[(np.minimum(e[:, 1], e[:, 3]) - margin < top + rows) & (np.maximum(e[:, 1], e[:, 3]) + margin > top)]
    lo, hi = np.minimum(e[:, 1], e[:, 3]) - margin, np.maximum(e[:, 1], e[:, 3]) + margin
    first, last = np.maximum(np.ceil(lo - 0.5), top).astype(np.int64), np.minimum(np.floor(hi - 0.5), top + rows - 1).astype(np.int64)
    n = np.maximum(0, last - first + 1)
    own = np.repeat(np.arange(len(e)), n)
    r = np.repeat(first, n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    (ax, ay, bx, by), y = e[own].T, r + 0.5
    left, right = np.full(len(own), np.inf), np.full(len(own), -np.inf)
    with np.errstate(invalid="ignore", divide="ignore"):
        for x, c in ((ax, ay), (bx, by)):
            half = np.sqrt(margin * margin - (y - c) ** 2)
            left, right = np.fmin(left, x - half), np.fmax(right, x + half)
        length = np.hypot(bx - ax, by - ay)
        ux, uy = -(by - ay) / length * margin, (bx - ax) / length * margin
        corners = [(ax + ux, ay + uy), (bx + ux, by + uy), (bx - ux, by - uy), (ax - ux, ay - uy)]
        for (px, py), (qx, qy) in zip(corners, [*corners[1:], corners[0]], strict=True):
            at = np.where((py - y) * (qy - y) <= 0, px + (qx - px) * (y - py) / (qy - py), np.nan)
            at = np.where(np.isfinite(at), at, np.nan)
            left, right = np.fmin(left, at), np.fmax(right, at)
    a, b = np.floor(left - 0.5) + 1, np.ceil(right - 0.5)  # centres strictly between
    some = (b > a) & (b > 0) & (a < cols)
    count = np.zeros((rows, cols + 1), np.int64)
    np.add.at(count, (r[some] - top, np.clip(a[some], 0, cols).astype(np.int64)), 1)
    np.add.at(count, (r[some] - top, np.clip(b[some], 0, cols).astype(np.int64)), -1)
    return np.cumsum(count, axis=1)[:, :cols] > 0
