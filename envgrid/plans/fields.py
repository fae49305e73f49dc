"""Queries over cells and polygons: nearest cells, zonal series, composites, class statistics, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from envgrid.functions import scalars
from envgrid.operators import focal, grid, index, series, zonal
from envgrid.plans.views import AREA, BOXES, CELLS, EVENTS, LAYER, LEG, TRIANGLES, Registry, boxes, cells, events, in_triangle, layer, rounded, table, triangle_area, triangles

reg = Registry()
SPEC = grid.GridSpec(0.0, 60.0, 1.0, 60, 60)


def with_xy(df):
    return df.withColumn("x", SPEC.x(F.col("col"))).withColumn("y", SPEC.y(F.col("row")))


@reg.add("jn09_nearest_cell", f"""WITH {LAYER}, p AS (SELECT o_orderkey AS id, (o_orderkey * 37 % 6000) / 100.0 + 0.003 AS x, (o_custkey * 53 % 6000) / 100.0 + 0.003 AS y FROM orders),
 q AS (SELECT id, least(greatest(CAST(round(y) AS INTEGER), 0), 59) AS row, least(greatest(CAST(round(x) AS INTEGER), 0), 59) AS col FROM p) SELECT row, col, count(*) AS n, round(max(value), 4) AS value FROM q JOIN la USING (row, col) GROUP BY row, col""")
def jn09(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 37 % 6000) / 100.0 + 0.003).alias("x"), ((F.col("o_custkey") * 53 % 6000) / 100.0 + 0.003).alias("y"))
    at = o.select("id", grid.nearest_index(F.col("y"), 0.0, 1.0, 60).alias("row"), grid.nearest_index(F.col("x"), 0.0, 1.0, 60).alias("col"))
    return rounded(at.join(layer(spark, d), ["row", "col"]).groupBy("row", "col").agg(F.count("*").alias("n"), F.max("value").alias("value")))


@reg.add("jn11_nearest_axis", "WITH x AS (SELECT o_orderkey % 5000 / 100.0 AS x FROM orders), a AS (SELECT DISTINCT n_nationkey * n_nationkey / 12.0 AS pos, n_nationkey AS place FROM nation), m AS (SELECT place, (pos + lag(pos) OVER (ORDER BY pos)) / 2 AS lo, (pos + lead(pos) OVER (ORDER BY pos)) / 2 AS hi FROM a) SELECT CAST(place AS INTEGER) AS place, count(*) AS n FROM x JOIN m ON (lo IS NULL OR x.x > lo) AND (hi IS NULL OR x.x <= hi) GROUP BY place")
def jn11(spark, d):
    x = table(spark, d, "orders").select((F.col("o_orderkey") % 5000 / 100.0).alias("x"))
    axis = table(spark, d, "nation").select((F.col("n_nationkey") * F.col("n_nationkey") / 12.0).alias("at"), F.col("n_nationkey").cast("int").alias("place"))
    return grid.nearest_on_axis(x, axis, "x", "at", "place").groupBy("place").agg(F.count("*").alias("n"))


@reg.add("ag26_block_mean", f"WITH {LAYER} SELECT row // 3 AS row, col // 3 AS col, round(CASE WHEN count(value) >= 5 THEN avg(value) END, 4) AS value, count(value) AS n FROM la GROUP BY ALL")
def ag26(spark, d):
    out = grid.block_mean(layer(spark, d), 3, 5)
    return rounded(out.withColumn("row", F.col("row").cast("int")).withColumn("col", F.col("col").cast("int")))


@reg.add("jn19_gather_coarse", f"WITH {LAYER}, co AS (SELECT row // 3 AS r, col // 3 AS c, avg(value) AS coarse FROM la GROUP BY ALL) SELECT row, col, round(value, 4) AS value, round(coarse, 4) AS coarse FROM la LEFT JOIN co ON row // 3 = r AND col // 3 = c")
def jn19(spark, d):
    la = layer(spark, d)
    return rounded(grid.gather_coarse(la, grid.block_mean(la, 3).withColumnRenamed("value", "coarse"), 3, ["coarse"]))


@reg.add("jn18_bilinear", f"""WITH {LAYER}, p AS (SELECT c_custkey AS id, (c_custkey * 31 % 590) / 10.0 AS fy, (c_custkey * 17 % 590) / 10.0 AS fx FROM customer), c AS (SELECT id, CAST(floor(fy) AS INTEGER) + a AS row, CAST(floor(fx) AS INTEGER) + b AS col, (CASE WHEN a = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN b = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM p, (VALUES (0), (1)) t(a), (VALUES (0), (1)) u(b))
 SELECT id, round(sum(w * value) / nullif(sum(w), 0), 7) AS value FROM c JOIN la USING (row, col) GROUP BY id""")
def jn18(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 31 % 590) / 10.0).alias("fy"), ((F.col("c_custkey") * 17 % 590) / 10.0).alias("fx"))
    return rounded(grid.bilinear(p, layer(spark, d)), 7)


_SEVEN = grid.GridSpec(-0.3, 60.5, 7 / 3, 27, 26)


@reg.add("jn18_average", f"""WITH {LAYER}, f AS (SELECT row, col, CASE WHEN (row * 7 + col * 3) % 13 > 2 THEN value END AS value FROM la), t AS (SELECT r, c, 60.5 - (r + 1) * 7.0::DOUBLE / 3 AS y0, -0.3 + c * 7.0::DOUBLE / 3 AS x0, 7.0::DOUBLE / 3 AS s FROM (SELECT unnest(range(26)) AS r) a, (SELECT unnest(range(27)) AS c) b),
 w AS (SELECT r, c, value, greatest(0, least(x0 + s, col + 1) - greatest(x0, col)) * greatest(0, least(y0 + s, 60 - row) - greatest(y0, 59 - row)) AS a, s FROM t, f WHERE value IS NOT NULL)
 SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, round(sum(a * value) / sum(a), 4) AS value, round(sum(a) / any_value(s * s), 4) AS covered FROM w WHERE a > 1e-9 GROUP BY ALL""")
def jn18a(spark, d):
    """Area averages on a grid of 7 to 3 that doesn't nest, with missing cells."""
    holes = layer(spark, d).withColumn("value", F.when((F.col("row") * 7 + F.col("col") * 3) % 13 > 2, F.col("value")))
    return rounded(grid.area_average(holes, SPEC, _SEVEN))


@reg.add("jn14_burn_latest", f"WITH {BOXES} SELECT y AS row, x AS col, max(basin_id) AS value FROM (SELECT basin_id, unnest(range(y0, y0 + 12)) AS yy, x0 FROM bo) t, range(60) g(x), (SELECT unnest(range(60)) AS y) h WHERE 59 - y = yy AND x BETWEEN x0 AND x0 + 11 GROUP BY ALL")
def jn14(spark, d):
    return zonal.burn(boxes(spark, d), SPEC, "basin_id", "basin_id").select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "value")


_WEIGHTS = f"""{BOXES}, wt AS (SELECT basin_id, 59 - r AS row, c AS col, greatest(0, least(x0 + 12.5, c + 1) - greatest(x0 + 0.5, c)) * greatest(0, least(y0 + 12.5, r + 1) - greatest(y0 + 0.5, r)) AS area, 144.0 AS poly_area FROM bo, (SELECT unnest(range(60)) AS r) a, (SELECT unnest(range(60)) AS c) b)"""


@reg.add("jn16_cell_weights", f"WITH {_WEIGHTS} SELECT basin_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(round(area, 4) AS DOUBLE) AS area, CAST(poly_area AS DOUBLE) AS poly_area FROM wt WHERE area > 0")
def jn16(spark, d):
    return rounded(zonal.cell_weights(boxes(spark, d, 0.5), SPEC, "basin_id"))


@reg.add("ag12_polygon_means", f"WITH {LAYER}, {_WEIGHTS} SELECT basin_id, round(CAST(sum(area * value) AS DOUBLE) / nullif(sum(CASE WHEN value IS NOT NULL THEN area END), 0), 4) AS mean, round(CAST(sum(CASE WHEN value IS NOT NULL THEN area END) AS DOUBLE) / 144, 4) AS cover_frac FROM (SELECT * FROM wt WHERE area > 0) JOIN la USING (row, col) GROUP BY basin_id")
def ag12(spark, d):
    return rounded(zonal.polygon_means(layer(spark, d), zonal.cell_weights(boxes(spark, d, 0.5), SPEC, "basin_id"), [], "basin_id"))


_SLANTED = f"""{TRIANGLES}, wt AS (SELECT basin_id, 59 - r AS row, c AS col, {triangle_area('c', 'r', 1)} AS area, {AREA} AS poly_area FROM tr, (SELECT unnest(range(60)) AS r) a, (SELECT unnest(range(60)) AS c) b)"""


@reg.add("jn14_burn_slanted", f"WITH {TRIANGLES} SELECT 59 - y AS row, x AS col, max(basin_id) AS value FROM tr, (SELECT unnest(range(60)) AS x) a, (SELECT unnest(range(60)) AS y) b WHERE {in_triangle('(x + 0.5)', '(y + 0.5)')} GROUP BY ALL")
def jn14s(spark, d):
    """Triangles with holes that overlap: the last one holds."""
    return zonal.burn(triangles(spark, d), SPEC, "basin_id", "basin_id").select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "value")


@reg.add("jn16_slanted_weights", f"WITH {_SLANTED} SELECT basin_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(area, 5) AS area, CAST(poly_area AS DOUBLE) AS poly_area FROM wt WHERE area > 1e-9")
def jn16s(spark, d):
    return rounded(zonal.cell_weights(triangles(spark, d), SPEC, "basin_id"), 5)


@reg.add("ag12_slanted_means", f"WITH {LAYER}, {_SLANTED} SELECT basin_id, round(sum(area * value) / nullif(sum(CASE WHEN value IS NOT NULL THEN area END), 0), 4) AS mean, round(sum(CASE WHEN value IS NOT NULL THEN area END) / {AREA}, 4) AS cover_frac FROM (SELECT * FROM wt WHERE area > 1e-9) JOIN la USING (row, col) GROUP BY basin_id")
def ag12s(spark, d):
    return rounded(zonal.polygon_means(layer(spark, d), zonal.cell_weights(triangles(spark, d), SPEC, "basin_id"), [], "basin_id"))


@reg.add("st05_dissolved_region", f"WITH {TRIANGLES} SELECT DISTINCT CAST(59 - y AS INTEGER) AS row, CAST(x AS INTEGER) AS col FROM tr, (SELECT unnest(range(60)) AS x) a, (SELECT unnest(range(60)) AS y) b WHERE {in_triangle('(x + 0.5)', '(y + 0.5)')}")
def st05(spark, d):
    return zonal.dissolved(triangles(spark, d), SPEC)


@reg.add("wn17_interior_cells", f"WITH {BOXES} SELECT basin_id, CAST(59 - y AS INTEGER) AS row, CAST(x AS INTEGER) AS col FROM bo, (SELECT unnest(range(60)) AS x) a, (SELECT unnest(range(60)) AS y) b WHERE x + 0.5 - x0 BETWEEN 2 AND 10 AND y + 0.5 - y0 BETWEEN 2 AND 10")
def wn17(spark, d):
    return zonal.interior_cells(boxes(spark, d), SPEC, "basin_id", 2.0)


_TO = lambda ax, ay, bx, by: f"sqrt(power(greatest({ax} - px, 0, px - ({bx})), 2) + power(greatest({ay} - py, 0, py - ({by})), 2))"
_HOLE = "CASE WHEN px BETWEEN x0 + 2 AND x0 + 4 AND py BETWEEN y0 + 2 AND y0 + 4 THEN 0 ELSE " + _TO("x0 + 2", "y0 + 2", "x0 + 4", "y0 + 4") + " END"


@reg.add("wn17_interior_slanted", f"""WITH {TRIANGLES}, c AS (SELECT basin_id, x, y, x0, y0, x + 0.5 AS px, y + 0.5 AS py FROM tr, (SELECT unnest(range(60)) AS x) a, (SELECT unnest(range(60)) AS y) b WHERE {in_triangle('(x + 0.5)', '(y + 0.5)')})
 SELECT basin_id, CAST(59 - y AS INTEGER) AS row, CAST(x AS INTEGER) AS col FROM c WHERE least(px - x0, py - y0, ({LEG} - (px - x0) - (py - y0)) / sqrt(2), {_HOLE}) >= 1.1""")
def wn17s(spark, d):
    """Cells of slanted outlines with holes that keep 1.1 from the boundary: inside, the nearest of the sides and the hole decides."""
    return zonal.interior_cells(triangles(spark, d), SPEC, "basin_id", 1.1)


SERIES = f"""{CELLS}, {BOXES}, se AS (SELECT day AS report_date, basin_id, any_value(kind) AS kind, count(*) AS n_hours, 3 AS n_hours_expected, sum(value) AS mm FROM ce JOIN bo ON col BETWEEN x0 AND x0 + 11 AND 59 - row BETWEEN y0 AND y0 + 11 GROUP BY ALL)"""


def basin_series(spark, d):
    """Daily records of each box from the cells in it; three reports make a day complete."""
    hits = zonal.burn(boxes(spark, d), SPEC, "basin_id", "basin_id").withColumnRenamed("value", "basin_id")
    c = cells(spark, d).join(hits, ["row", "col"]).groupBy(F.col("day").alias("report_date"), "basin_id").agg(F.count("*").alias("n_hours"), F.sum("value").alias("precip_mm"))
    kinds = boxes(spark, d).select("basin_id", "kind")
    return c.join(kinds, "basin_id").withColumn("n_hours_expected", F.lit(3)).withColumn("precip_in", scalars.mm_to_in(F.col("precip_mm"))).withColumn("volume_m3", scalars.volume_m3(F.col("precip_mm"), F.lit(144.0e6))).withColumn("volume_flux_m3s", scalars.flux_m3s(F.col("volume_m3"), F.lit(24)))


@reg.add("pl05_basin_series", f"WITH {SERIES} SELECT report_date, basin_id, n_hours, round(mm, 4) AS precip_mm, round(mm / 25.4, 4) AS precip_in, round(mm / 1000 * 144e6, 1) AS volume_m3, round(mm / 1000 * 144e6 / 86400, 2) AS volume_flux_m3s FROM se")
def pl05(spark, d):
    s = basin_series(spark, d)
    return s.select("report_date", "basin_id", "n_hours", F.round("precip_mm", 4).alias("precip_mm"), F.round("precip_in", 4).alias("precip_in"), F.round("volume_m3", 1).alias("volume_m3"), F.round("volume_flux_m3s", 2).alias("volume_flux_m3s"))


@reg.add("ag29_basin_period", f"WITH {SERIES} SELECT basin_id, count(*) AS n_days, CAST(sum(CASE WHEN n_hours = 3 THEN 0 ELSE 1 END) AS BIGINT) AS n_partial, round(avg(mm), 4) AS mean_mm, round(sum(mm), 4) AS total_mm, round(sum(mm) / 25.4, 3) AS total_in, arg_max(report_date, (mm, -epoch(report_date))) AS wettest FROM se WHERE report_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY basin_id")
def ag29(spark, d):
    out = series.basin_period(basin_series(spark, d), F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date"))
    return out.select("basin_id", "n_days", "n_partial", F.round("mean_mm", 4).alias("mean_mm"), F.round("total_mm", 4).alias("total_mm"), F.round("total_in", 3).alias("total_in"), "wettest")


@reg.add("jn04_keyed_range_join", f"WITH {SERIES} SELECT concat(n_nationkey, '_', n_regionkey) AS basin_key, report_date, round(mm, 4) AS precip_mm, n_name AS name FROM nation n JOIN se ON concat(n_nationkey, '_', n_regionkey) = concat(se.basin_id, '_', se.kind) WHERE report_date BETWEEN DATE '1995-03-01' AND DATE '1995-03-31' AND n_regionkey = 1")
def jn04(spark, d):
    s = basin_series(spark, d).withColumn("basin_key", scalars.series_key(F.col("basin_id").cast("string"), F.col("kind").cast("string")))
    n = table(spark, d, "nation").where("n_regionkey = 1").select(scalars.series_key(F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")).alias("basin_key"), F.col("n_name").alias("name"))
    some = s.where(F.col("report_date").between("1995-03-01", "1995-03-31"))
    return n.join(some, "basin_key").select("basin_key", "report_date", F.round("precip_mm", 4).alias("precip_mm"), "name")


@reg.add("ag28_completeness", f"WITH {SERIES} SELECT CAST(year(report_date) AS INTEGER) AS year, round(100 * avg(CASE WHEN n_hours = 3 THEN 1.0 ELSE 0.0 END), 4) AS pct_complete FROM se GROUP BY 1")
def ag28(spark, d):
    return rounded(basin_series(spark, d).groupBy(F.year("report_date").alias("year")).agg((100 * F.avg(F.when(series.complete(), 1.0).otherwise(0.0))).alias("pct_complete")))


@reg.add("ag36_totals_by_kind", f"WITH {SERIES} SELECT report_date, round(sum(CASE WHEN kind <> 0 THEN mm / 1000 * 144e6 END) / 1e6, 5) AS land, round(sum(CASE WHEN kind = 0 THEN mm / 1000 * 144e6 END) / 1e6, 5) AS water FROM se GROUP BY report_date")
def ag36(spark, d):
    """Regions stand for land and, the first of them, for water."""
    return rounded(series.totals_by_kind(basin_series(spark, d).withColumn("water", F.col("kind") == 0), "water"), 5)


@reg.add("ag38_default_period", f"WITH {SERIES} SELECT min(report_date) AS first, max(report_date) AS last, count(DISTINCT basin_id) AS n_basins, count(DISTINCT report_date) AS n_dates, greatest(max(report_date) - 364, min(report_date)) AS default_first FROM se")
def ag38(spark, d):
    return series.default_period(basin_series(spark, d))


@reg.add("wn11_latest_date", f"WITH {SERIES} SELECT basin_id, report_date, round(mm, 4) AS precip_mm FROM se WHERE report_date = (SELECT max(report_date) FROM se)")
def wn11(spark, d):
    s = basin_series(spark, d)
    return rounded(s.join(F.broadcast(s.agg(F.max("report_date").alias("report_date"))), "report_date").select("basin_id", "report_date", "precip_mm"))


@reg.add("jn05_upsert", f"WITH {SERIES}, o AS (SELECT report_date, basin_id, round(mm, 4) AS v FROM se WHERE report_date < DATE '1996-01-01'), n AS (SELECT report_date, basin_id, round(2 * mm, 4) AS v FROM se WHERE report_date >= DATE '1995-12-01' AND basin_id % 2 = 0) SELECT * FROM o WHERE report_date NOT IN (SELECT report_date FROM n) UNION ALL SELECT * FROM n")
def jn05(spark, d):
    s = basin_series(spark, d)
    old = s.where("report_date < DATE '1996-01-01'").select("report_date", "basin_id", F.round("precip_mm", 4).alias("v"))
    new = s.where("report_date >= DATE '1995-12-01' AND basin_id % 2 = 0").select("report_date", "basin_id", F.round(2 * F.col("precip_mm"), 4).alias("v"))
    return series.upsert(old, new)


@reg.add("pf13_violations", "SELECT 'duplicate key' AS rule, concat(l_orderkey, '|', l_linenumber) AS detail, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'outside domain', l_returnflag, count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') OR l_returnflag IS NULL GROUP BY l_returnflag UNION ALL SELECT 'missing', CAST(o_orderkey AS VARCHAR), 1 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pf13(spark, d):
    return series.violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ("l_returnflag", ["A", "N"]), table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")))


@reg.add("io18_covered_dates", "WITH s AS (SELECT min(date_trunc('hour', ts)) AS a, max(date_trunc('hour', ts)) AS b FROM events), g AS (SELECT a, b, CAST(unnest(generate_series(CAST(a AS DATE), CAST(b AS DATE) + 1, INTERVAL 1 DAY)) AS DATE) AS day FROM s) SELECT day FROM g WHERE CAST(day - 1 AS TIMESTAMP) + INTERVAL 13 HOUR >= a AND CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR <= b ORDER BY day DESC LIMIT 5")
def io18(spark, d):
    e = table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("t"))
    return series.last_dates(series.covered_dates(e.agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"))), 5)


@reg.add("wn09_date_runs", "WITH d AS (SELECT DISTINCT CAST(c AS DATE) AS day FROM (SELECT o_orderdate AS c FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 250000)), g AS (SELECT day, CASE WHEN day - lag(day) OVER (ORDER BY day) > 3 THEN 1 ELSE 0 END AS s FROM d), r AS (SELECT day, sum(s) OVER (ORDER BY day) AS g FROM g), b AS (SELECT day, g, (row_number() OVER (PARTITION BY g ORDER BY day) - 1) // 12 AS b FROM r) SELECT day, CAST(dense_rank() OVER (ORDER BY g, b) AS INTEGER) AS run FROM b")
def wn09(spark, d):
    """Runs of the dates on which large orders came in."""
    o = table(spark, d, "orders").where("o_totalprice > 300000 OR (o_orderpriority = '1-URGENT' AND o_totalprice > 250000)")
    return series_runs(o.select(F.to_date("o_orderdate").alias("day")))


def series_runs(dates):
    from envgrid.operators.moisture import date_runs

    return date_runs(dates, 3, 12)


@reg.add("ag25_site_statistics", f"WITH {LAYER}, s AS (SELECT s_suppkey AS site, s_suppkey * 7 % 60 + 0.5 AS x, s_suppkey * 13 % 60 + 0.5 AS y FROM supplier), r AS (SELECT unnest([1.0, 3.0]) AS radius) SELECT site, CAST(radius AS DOUBLE) AS radius, count(value) AS n, round(median(value), 4) AS median, round(avg(value), 4) AS mean FROM s, r, la WHERE abs(col + 0.5 - x) <= radius AND abs(60 - (row + 0.5) - y) <= radius GROUP BY ALL")
def ag25(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), (F.col("s_suppkey") * 7 % 60 + 0.5).alias("x"), (F.col("s_suppkey") * 13 % 60 + 0.5).alias("y"))
    return rounded(zonal.site_statistics(s, layer(spark, d), SPEC, [1.0, 3.0], circle=False))


@reg.add("ag25_circle_statistics", f"WITH {LAYER}, s AS (SELECT s_suppkey AS site, s_suppkey * 7 % 60 + 0.5 AS x, s_suppkey * 13 % 60 + 0.5 AS y FROM supplier) SELECT site, CAST(4 AS DOUBLE) AS radius, count(value) AS n, round(median(value), 4) AS median, round(avg(value), 4) AS mean FROM s, la WHERE (col + 0.5 - x) * (col + 0.5 - x) + (60 - (row + 0.5) - y) * (60 - (row + 0.5) - y) <= 16 GROUP BY ALL")
def ag25c(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), (F.col("s_suppkey") * 7 % 60 + 0.5).alias("x"), (F.col("s_suppkey") * 13 % 60 + 0.5).alias("y"))
    return rounded(zonal.site_statistics(s, layer(spark, d), SPEC, [4.0], circle=True))


#: Digital numbers of the two bands, and reflectance of the kept scene classes.
_DN = "dn AS (SELECT row, col, day, scl, CAST(red * 10000 AS INTEGER) * 1e-4 AS red, CAST(nir * 10000 AS INTEGER) * 1e-4 AS nir, red > 0 AS a, nir > 0 AS b FROM ce)"
_NDVI = "CASE WHEN scl IN (4, 5, 7) AND a AND b AND nir + red > 0.05 THEN greatest(-1, least(1, (nir - red) / (nir + red))) END"
_COMPOSITE = f"{CELLS}, {_DN}, s AS (SELECT row, col, median(CASE WHEN month(day) BETWEEN 5 AND 9 THEN {_NDVI} END) AS a, median(CASE WHEN month(day) IN (11, 12, 1, 2, 3, 4) THEN {_NDVI} END) AS b, count(CASE WHEN month(day) BETWEEN 5 AND 9 THEN {_NDVI} END) AS n_summer, count(CASE WHEN month(day) IN (11, 12, 1, 2, 3, 4) THEN {_NDVI} END) AS n_leaf_off FROM dn GROUP BY row, col)"


def composites(spark, d):
    """Summer and leaf-off medians of the vegetation index from digital numbers and scene classes."""
    c = cells(spark, d)
    red, nir = (scalars.valid_reflectance((F.col(b) * 10000).cast("int"), F.col("scl")) for b in ("red", "nir"))
    return index.seasonal_composite(c, scalars.ndvi(nir, red), {"summer": (5, 6, 7, 8, 9), "leaf_off": (11, 12, 1, 2, 3, 4)})


@reg.add("ag23_composite", f"WITH {_COMPOSITE} SELECT row, col, round(a, 5) AS summer, round(b, 5) AS leaf_off, round(a - b, 5) AS decid, n_summer FROM s")
def ag23(spark, d):
    both = composites(spark, d)
    return rounded(both.select("row", "col", "summer", "leaf_off", scalars.decid_index(F.col("summer"), F.col("leaf_off")).alias("decid"), "n_summer"), 5)


@reg.add("pl08_gated_index", f"""WITH {_COMPOSITE}, {TRIANGLES}, v AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_custkey % 50 <= 20 AND o_custkey % 50 + 8 >= 10), basin AS (SELECT row, col FROM s WHERE EXISTS (SELECT 1 FROM tr WHERE {in_triangle('(col + 0.5)', '(59.5 - row)')})),
 sd AS (SELECT row, col, median(CASE WHEN month(day) BETWEEN 5 AND 9 THEN {_NDVI} END) AS a, median(CASE WHEN month(day) IN (11, 12, 1, 2, 3, 4) THEN {_NDVI} END) AS b FROM dn JOIN v USING (day) GROUP BY row, col)
 SELECT row, col, round(CASE WHEN a > 0.6 AND (row + col) % 5 <> 1 THEN a - b END, 5) AS oak_index FROM sd JOIN basin USING (row, col)""")
def pl08(spark, d):
    """Scenes of a catalogue to a deciduous index: scene days, masked reflectances, composites, canopy gate, basin mask."""
    o = table(spark, d, "orders")
    x = F.col("o_custkey") % 50
    scenes = o.select(F.col("o_orderdate").alias("datetime"), x.alias("x0"), (x + 8).alias("x1"), F.lit(0).alias("y0"), F.lit(9).alias("y1"), F.lit(0).alias("cloud_cover"))
    days = index.scene_filter(scenes, (10, 0, 20, 9), "1900-01-01", "2100-01-01", 30).select(F.col("solar_day").alias("day"))
    red, nir = (scalars.valid_reflectance((F.col(b) * 10000).cast("int"), F.col("scl")) for b in ("red", "nir"))
    both = index.seasonal_composite(cells(spark, d).join(days, "day", "left_semi"), scalars.ndvi(nir, red), {"summer": (5, 6, 7, 8, 9), "leaf_off": (11, 12, 1, 2, 3, 4)})
    marsh = F.when((F.col("row") + F.col("col")) % 5 == 1, 1).otherwise(0)
    gated = both.select("row", "col", scalars.canopy_gate(scalars.decid_index(F.col("summer"), F.col("leaf_off")), F.col("summer"), marsh, 0.6).alias("oak_index"))
    return rounded(zonal.inside_any(gated, triangles(spark, d), SPEC), 5)


@reg.add("ag24_date_curve", "SELECT l_returnflag AS site, CAST(l_shipdate AS DATE) AS date, median(l_discount) AS median, count(l_discount) AS n_valid FROM lineitem GROUP BY ALL HAVING count(l_discount) > 0.5 * 12")
def ag24(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("site"), F.to_date("l_shipdate").alias("date"), "l_discount")
    return index.date_curve(li, "l_discount", 12, 0.5)


@reg.add("ag32_season_medians", "WITH w AS (SELECT 'cold' AS season, unnest([11, 12, 1, 2, 3]) AS m UNION ALL SELECT 'spring', unnest([3, 4, 5]) UNION ALL SELECT 'summer', unnest([6, 7, 8])) SELECT o_orderpriority AS site, season, round(median(o_totalprice), 4) AS median, count(*) AS n FROM orders JOIN w ON month(o_orderdate) = m GROUP BY ALL")
def ag32(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("site"), F.col("o_orderdate").alias("date"), "o_totalprice")
    return rounded(index.season_medians(o, [("cold", [11, 12, 1, 2, 3]), ("spring", [3, 4, 5]), ("summer", [6, 7, 8])], "o_totalprice"))


@reg.add("ag16_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, count(*) AS n FROM lineitem GROUP BY l_returnflag HAVING count(*) >= 1000")
def ag16(spark, d):
    return rounded(index.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.1, 0.25, 0.5, 0.9]).where("n >= 1000"))


@reg.add("ag17_describe", "SELECT p_brand, count(p_retailprice) AS count, round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS std, round(min(p_retailprice), 4) AS min, round(quantile_cont(p_retailprice, 0.25), 4) AS p25, round(quantile_cont(p_retailprice, 0.5), 4) AS p50, round(quantile_cont(p_retailprice, 0.75), 4) AS p75, round(max(p_retailprice), 4) AS max FROM part GROUP BY p_brand")
def ag17(spark, d):
    return rounded(index.describe(table(spark, d, "part"), "p_retailprice", ["p_brand"]))


@reg.add("ag18_exceedance", f"WITH {LAYER} SELECT CAST(cut AS DOUBLE) AS cut, CAST(sum(CASE WHEN value > cut THEN 1 ELSE 0 END) * 0.09 AS DOUBLE) AS area, round(100.0 * sum(CASE WHEN value > cut THEN 1 ELSE 0 END) / count(value), 4) AS pct_given, round(100.0 * sum(CASE WHEN value > cut THEN 1 ELSE 0 END) / count(*), 4) AS pct_total FROM la, (SELECT unnest([20.0, 25.0, 30.0]) AS cut) GROUP BY cut")
def ag18(spark, d):
    return rounded(index.exceedance(layer(spark, d), "value", [20.0, 25.0, 30.0], 0.09, F.count("*")))


@reg.add("ag19_presence", "WITH u AS (SELECT unnest(['l_discount', 'l_tax']) AS layer, unnest([l_discount, l_tax]) AS value FROM lineitem) SELECT layer, CAST(count(*) * 0.5 AS DOUBLE) AS area, round(100.0 * count(*) * 0.5 / 1e6, 4) AS pct, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.9), 5) AS p90 FROM u WHERE value > 0 GROUP BY layer")
def ag19(spark, d):
    out = index.presence(table(spark, d, "lineitem").select("l_discount", "l_tax"), ["l_discount", "l_tax"], 0.5, 1e6)
    return out.select("layer", F.col("area").cast("double").alias("area"), F.round("pct", 4).alias("pct"), F.round("mean", 5).alias("mean"), F.round("p90", 5).alias("p90"))


@reg.add("ag20_separability", """WITH s AS (SELECT l_linestatus, quantile_cont(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END, [0.25, 0.5, 0.75]) AS a, quantile_cont(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END, [0.25, 0.5, 0.75]) AS b FROM lineitem GROUP BY 1),
 k AS (SELECT l.l_linestatus, avg(CASE WHEN l_extendedprice > b[2] THEN 1.0 ELSE 0.0 END) AS skill FROM lineitem l JOIN s ON s.l_linestatus = l.l_linestatus WHERE l_returnflag = 'R' GROUP BY 1) SELECT s.l_linestatus, round(a[2] - b[2], 3) AS gap, round((a[2] - b[2]) / ((a[3] - a[1] + b[3] - b[1]) / 2), 5) AS separation, round(skill, 5) AS skill FROM s JOIN k ON s.l_linestatus = k.l_linestatus""")
def ag20(spark, d):
    out = index.separability(table(spark, d, "lineitem"), "l_extendedprice", "R", "A", ["l_linestatus"], "l_returnflag")
    return out.select("l_linestatus", F.round("gap", 3).alias("gap"), F.round("separation", 5).alias("separation"), F.round("skill", 5).alias("skill"))


@reg.add("ag22_percentile_rank", "SELECT CAST(n_nationkey AS INTEGER) AS id, round(100 * avg(CASE WHEN o_totalprice < n_nationkey * 10000.0 THEN 1.0 ELSE 0.0 END), 4) AS rank FROM orders, nation GROUP BY n_nationkey")
def ag22(spark, d):
    at = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), (F.col("n_nationkey") * 10000.0).alias("at"))
    return rounded(index.percentile_rank(table(spark, d, "orders"), "o_totalprice", at, "at").select("id", "rank"))


@reg.add("ag15_value_shares", "SELECT p_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM part GROUP BY p_type")
def ag15(spark, d):
    return rounded(index.value_shares(table(spark, d, "part"), "p_type"))


@reg.add("ag27_class_totals_top", "WITH g AS (SELECT p_brand, sum(p_size) AS area, avg(p_retailprice) AS attr FROM part GROUP BY p_brand) SELECT p_brand, CAST(area AS BIGINT) AS area, round(attr, 4) AS mean_attr, round(100.0 * area / sum(area) OVER (), 4) AS pct FROM g ORDER BY area DESC, p_brand LIMIT 12")
def ag27(spark, d):
    return rounded(index.class_totals(table(spark, d, "part"), "p_brand", "p_size", "p_retailprice", 12))


@reg.add("ag31_confusion", "WITH t AS (SELECT CAST(l_linenumber % 3 AS INTEGER) AS y, CAST(l_quantity AS INTEGER) % 3 AS pred FROM lineitem) SELECT y, pred, count(*) AS n, round(1.0 * count(*) / sum(count(*)) OVER (PARTITION BY y), 5) AS share FROM t GROUP BY y, pred")
def ag31(spark, d):
    return rounded(index.confusion(table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("y"), (F.col("l_quantity").cast("int") % 3).alias("pred"))), 5)


@reg.add("ag31_balanced_accuracy", "WITH t AS (SELECT l_linenumber % 3 AS y, CAST(l_quantity AS INTEGER) % 3 AS pred FROM lineitem), h AS (SELECT y, avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS hit FROM t GROUP BY y) SELECT round(avg(hit), 5) AS balanced_accuracy FROM h")
def ag31b(spark, d):
    return rounded(index.balanced_accuracy(index.confusion(table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).alias("y"), (F.col("l_quantity").cast("int") % 3).alias("pred")))), 5)


@reg.add("ag33_verdict", "WITH m AS (SELECT l_linestatus, median(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS s, median(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS g, median(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS b FROM lineitem GROUP BY 1) SELECT l_linestatus, s > (g + b) / 2 AS pass, round((s - b) / nullif(g - b, 0), 4) AS way FROM m")
def ag33(spark, d):
    med = lambda f: F.median(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")))
    m = table(spark, d, "lineitem").groupBy("l_linestatus").agg(med("N").alias("s"), med("R").alias("g"), med("A").alias("b"))
    ok, way = index.verdict(F.col("s"), F.col("g"), F.col("b"))
    return m.select("l_linestatus", ok.alias("pass"), F.round(way, 4).alias("way"))


@reg.add("ag37_coverage", "SELECT round(avg(CASE WHEN l_discount > 0.02 THEN 1.0 ELSE 0.0 END), 5) AS given, min(CASE WHEN l_discount > 0.02 THEN l_discount END) AS min, median(CASE WHEN l_discount > 0.02 THEN l_discount END) AS median, max(l_discount) AS max, CAST(sum(CASE WHEN l_discount > 0.02 THEN 0 ELSE 1 END) AS BIGINT) AS missing FROM lineitem")
def ag37(spark, d):
    return rounded(index.coverage(table(spark, d, "lineitem").select(F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("v")), "v"), 5)


@reg.add("jn23_layer_stack", f"WITH {CELLS}, a AS (SELECT row, col, avg(value) AS v FROM ce WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT row, col, max(red) AS v FROM ce WHERE l_returnflag = 'N' GROUP BY ALL) SELECT coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, round(a.v, 4) AS depth, b.v AS red FROM a FULL JOIN b ON a.row = b.row AND a.col = b.col")
def jn23(spark, d):
    c = cells(spark, d)
    one = c.where("l_returnflag = 'A'").groupBy("row", "col").agg(F.avg("value").alias("value"))
    two = c.where("l_returnflag = 'N'").groupBy("row", "col").agg(F.max("red").alias("value"))
    return rounded(grid.stack({"depth": one, "red": two}))


@reg.add("jn24_product_agreement", f"WITH {CELLS}, a AS (SELECT row, col, avg(value) AS s, max(red) AS f FROM ce GROUP BY ALL) SELECT count(*) AS n, CAST(sum(CASE WHEN s > 25 AND f < 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS only_s, CAST(sum(CASE WHEN s > 25 AND f >= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS both FROM a")
def jn24(spark, d):
    a = cells(spark, d).groupBy("row", "col").agg(F.avg("value").alias("s"), F.max("red").alias("f"))
    return a.agg(F.count("*").alias("n"), F.sum(F.when((F.col("s") > 25) & (F.col("f") < 0.1), 1).otherwise(0)).alias("only_s"), F.sum(F.when((F.col("s") > 25) & (F.col("f") >= 0.1), 1).otherwise(0)).alias("both"))


@reg.add("jn22_parameter_sweep", f"WITH {LAYER}, v AS (SELECT unnest([20.0, 25.0]) AS gate), k AS (SELECT unnest([1, 2, 3]) AS step) SELECT CAST(gate AS DOUBLE) AS gate, step, count(*) AS n, round(avg(value), 4) AS mean FROM la, v, k WHERE value > gate AND row % step = 0 GROUP BY ALL")
def jn22(spark, d):
    both = spark.createDataFrame([(g, s) for g in (20.0, 25.0) for s in (1, 2, 3)], "gate double, step int")
    return rounded(layer(spark, d).join(F.broadcast(both), (F.col("value") > F.col("gate")) & (F.col("row") % F.col("step") == 0)).groupBy("gate", "step").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@reg.add("wn12_first_tile_wins", f"WITH {CELLS} SELECT row, col, min_by(value, l_orderkey * 1000 + scl * 100 + value) AS value FROM ce GROUP BY row, col")
def wn12(spark, d):
    return grid.first_wins(cells(spark, d).withColumn("tile", F.col("l_orderkey") * 1000 + F.col("scl") * 100 + F.col("value")), "tile")


@reg.add("wn13_solid_windows", f"WITH {LAYER}, m AS (SELECT row, col, CASE WHEN value > 20 THEN 1 ELSE 0 END AS m FROM la), s AS (SELECT row, col, sum(m) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM m), t AS (SELECT row, col, sum(s) OVER (PARTITION BY col ORDER BY row RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS t FROM s) SELECT row, col FROM t WHERE t = 25 AND row % 2 = 0 AND col % 3 = 0")
def wn13(spark, d):
    return grid.solid_cells(layer(spark, d), F.col("value") > 20, 2, (2, 3)).select("row", "col")


_OFF = "(VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) o(a, b)"


@reg.add("wn14_opening", f"WITH {LAYER}, m AS (SELECT row, col FROM la WHERE value > 18), e AS (SELECT row + a AS row, col + b AS col FROM m, {_OFF} GROUP BY ALL HAVING count(*) = 5) SELECT DISTINCT row + a AS row, col + b AS col FROM e, {_OFF}")
def wn14(spark, d):
    return grid.opening(layer(spark, d).where("value > 18").select("row", "col"))


@reg.add("pl11_wet_patches", f"""WITH RECURSIVE {LAYER}, m AS (SELECT row, col, value, row * 2147483648 + col AS id FROM la WHERE value > 29), r(id, row, col, root) AS (SELECT id, row, col, id FROM m UNION SELECT m.id, m.row, m.col, r.root FROM r JOIN m ON abs(m.row - r.row) + abs(m.col - r.col) = 1),
 l AS (SELECT id, min(root) AS label FROM r GROUP BY id) SELECT CAST(label AS BIGINT) AS label, CAST(count(*) * 900 AS DOUBLE) AS area, round(avg(value), 4) AS mean_value FROM l JOIN m USING (id) GROUP BY label HAVING count(*) * 900 >= 1800""")
def pl11(spark, d):
    la = layer(spark, d)
    found = grid.patches(grid.components(la.where("value > 29").select("row", "col")), la, 900.0, 1800.0, ["value"])
    return rounded(found)


@reg.add("wn16_focal_median", f"WITH {LAYER}, p AS (SELECT s_suppkey AS id, CAST(s_suppkey * 7 % 60 AS INTEGER) AS r, CAST(s_suppkey * 13 % 60 AS INTEGER) AS c FROM supplier) SELECT id, CAST(trunc(coalesce(median(value), -1)) AS INTEGER) AS median FROM p LEFT JOIN la ON (row - r) * (row - r) + (col - c) * (col - c) <= 25 GROUP BY id")
def wn16(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7 % 60).cast("int").alias("row"), (F.col("s_suppkey") * 13 % 60).cast("int").alias("col"))
    return zonal.focal_median(p, layer(spark, d), 5)


@reg.add("wn16_focal_statistics", f"WITH {LAYER}, f AS (SELECT row, col, CASE WHEN (row * 5 + col) % 11 > 1 THEN value * 0.9871313::DOUBLE END AS value FROM la), r AS (SELECT unnest([2.0, 4.5]) AS radius) SELECT a.row, a.col, CAST(radius AS DOUBLE) AS radius, count(b.value) AS n, round(median(b.value), 4) AS median, round(avg(b.value), 4) AS mean FROM f a, r, f b WHERE power(a.row - b.row, 2) + power(a.col - b.col, 2) <= radius * radius GROUP BY ALL")
def wn16s(spark, d):
    """Number, median and mean of the disks around all cells, at two radii, some cells missing."""
    holes = layer(spark, d).withColumn("value", F.when((F.col("row") * 5 + F.col("col")) % 11 > 1, F.col("value") * 0.9871313))
    return rounded(focal.focal_statistics(holes, [2.0, 4.5]))


@reg.add("ag25_box_statistics", f"WITH {LAYER}, f AS (SELECT row, col, value * 0.9871313::DOUBLE AS value FROM la), r AS (SELECT unnest([1, 3, 7]) AS radius) SELECT a.row, a.col, CAST(radius AS DOUBLE) AS radius, count(b.value) AS n, round(median(b.value), 4) AS median, round(avg(b.value), 4) AS mean FROM f a, r, f b WHERE abs(a.row - b.row) <= radius AND abs(a.col - b.col) <= radius GROUP BY ALL")
def ag25b(spark, d):
    """The boxes around all cells, at three radii."""
    return rounded(focal.focal_statistics(layer(spark, d).withColumn("value", F.col("value") * 0.9871313), [1, 3, 7], circle=False))


@reg.add("jn13_inside_outside", f"""WITH {TRIANGLES}, p AS (SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS tag, o_orderkey % 7000 / 100.0 + 0.003 AS x, o_custkey * 53 % 6500 / 100.0 + 0.003 AS y FROM orders)
 SELECT tag, basin_id, count(*) AS n FROM p LEFT JOIN tr ON {in_triangle('x', 'y')} GROUP BY tag, basin_id""")
def jn13(spark, d):
    """Points of any number at one place, some with missing columns, by the polygons that they lie in; null: outside of all."""
    p = table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("tag"), (F.col("o_orderkey") % 7000 / 100.0 + 0.003).alias("x"), (F.col("o_custkey") * 53 % 6500 / 100.0 + 0.003).alias("y")
    )
    found = zonal.points_inside(p, triangles(spark, d), grid.GridSpec(0.0, 75.0, 1.0, 75, 75), "basin_id")
    return found.groupBy("tag", "basin_id").agg(F.count("*").alias("n"))


@reg.add("jn20_polygon_distance", f"WITH {BOXES}, p AS (SELECT c_custkey AS id, c_custkey * 7 % 1900 / 10.0 - 40 AS x, c_custkey * 3 % 1900 / 10.0 - 40 AS y FROM customer) SELECT id, round(sqrt(min(pow(greatest(x0 - x, 0, x - x0 - 12), 2) + pow(greatest(y0 - y, 0, y - y0 - 12), 2))), 4) AS distance FROM p, bo GROUP BY id")
def jn20(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % 1900 / 10.0 - 40).alias("x"), (F.col("c_custkey") * 3 % 1900 / 10.0 - 40).alias("y"))
    return rounded(zonal.nearest_distance(p, boxes(spark, d), "id", 4.0))


@reg.add("sl03_strided", "WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) SELECT s_suppkey FROM r WHERE k % 13 = 1")
def sl03(spark, d):
    return index.strided(table(spark, d, "supplier").select("s_suppkey"), 13, "s_suppkey")


@reg.add("sl04_capped_sample", "SELECT o_orderpriority, least(count(*), 40) AS n, least(count(*), 40) AS n_same, 0 AS n_foreign FROM orders GROUP BY o_orderpriority")
def sl04(spark, d):
    """Rows of each group in the sample, how many of them a second draw has, and how many are not of the table."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    one, two = index.capped_sample(o, ["o_orderpriority"], 40, F.col("o_orderkey"), 7), index.capped_sample(o.repartition(5), ["o_orderpriority"], 40, F.col("o_orderkey"), 7)
    kept = one.join(two.withColumn("_two", F.lit(1)), ["o_orderpriority", "o_orderkey"], "left").join(o.withColumn("_of", F.lit(1)), ["o_orderpriority", "o_orderkey"], "left")
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("_two").alias("n_same"), F.sum(F.when(F.col("_of").isNull(), 1).otherwise(0)).alias("n_foreign"))


@reg.add("st_set_operations", "SELECT 'union' AS op, day FROM (SELECT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click' UNION SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'view') UNION ALL SELECT 'missing', day FROM (SELECT CAST(ts AS DATE) AS day FROM events EXCEPT SELECT CAST(ts AS DATE) FROM events WHERE user_id = 7)")
def st(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    some = e.where("event_type = 'click'").select("day").union(e.where("event_type = 'view'").select("day")).distinct()
    gone = e.select("day").distinct().join(e.where("user_id = 7").select("day").distinct(), "day", "left_anti")
    return some.select(F.lit("union").alias("op"), "day").unionByName(gone.select(F.lit("missing").alias("op"), "day"))


@reg.add("wn10_best_row", f"WITH {EVENTS} SELECT station, max_by(event_id, (value, -event_id)) AS event_id, round(max(value), 4) AS value FROM ev GROUP BY station")
def wn10(spark, d):
    return rounded(events(spark, d).groupBy("station").agg(F.max_by("event_id", F.struct("value", F.negative("event_id"))).alias("event_id"), F.max("value").alias("value")))
