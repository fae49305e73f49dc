"""Queries that run whole pipelines, and the remaining filters and joins of the inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envgrid.functions import codes, geo, scalars
from envgrid.functions.timebuckets import lead_day, report_day
from envgrid.operators import grid, index, land, moisture, series, verify, zonal
from envgrid.plans.climate import _RA
from envgrid.plans.fields import SERIES, SPEC, basin_series
from envgrid.plans.verification import PEARSON
from envgrid.plans.views import AREA, BOXES, CELLS, EVENTS, HOURLY, LAYER, TRIANGLES, Registry, boxes, cells, events, hourly, in_triangle, layer, rounded, table, triangle_area, triangles, wall7
from envgrid.sources import io

reg = Registry()


def snapped_domain(polygons, pad: float, res: float):
    """(x0, y0, x1, y1) of all polygons, padded and snapped outwards to the grid step."""
    b = polygons.select(geo.bounds("rings").alias("b")).agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))
    return b.select(*[(F.floor((F.col(c) - pad) / res) * res).cast("double").alias(c) for c in ("x0", "y0")], *[(F.ceil((F.col(c) + pad) / res) * res).cast("double").alias(c) for c in ("x1", "y1")])


@reg.add("pf02_snapped_domain", f"WITH {BOXES} SELECT CAST(floor((min(x0) - 1.3) / 5.0) * 5 AS DOUBLE) AS x0, CAST(floor((min(y0) - 1.3) / 5.0) * 5 AS DOUBLE) AS y0, CAST(ceil((max(x0) + 12 + 1.3) / 5.0) * 5 AS DOUBLE) AS x1, CAST(ceil((max(y0) + 12 + 1.3) / 5.0) * 5 AS DOUBLE) AS y1 FROM bo WHERE kind > 0")
def pf02(spark, d):
    return snapped_domain(boxes(spark, d).where("kind > 0"), 1.3, 5.0)


@reg.add("pf01_bbox_filter", f"WITH {CELLS} SELECT row, col, count(*) AS n FROM ce WHERE row BETWEEN 10 AND 19 AND col BETWEEN 5 AND 44 AND value IS NOT NULL GROUP BY ALL")
def pf01(spark, d):
    return cells(spark, d).where(F.col("row").between(10, 19) & F.col("col").between(5, 44)).dropna(subset=["value"]).groupBy("row", "col").agg(F.count("*").alias("n"))


@reg.add("io13_grid_window", "SELECT event_id, user_id AS i, CAST(event_id % 60 AS BIGINT) AS j FROM events WHERE ts > TIMESTAMP '2024-01-05 07:00:00' AND ts <= TIMESTAMP '2024-01-08 07:00:00' AND user_id BETWEEN 3 AND 90 AND event_id % 60 BETWEEN 10 AND 39")
def io13(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("time"), F.col("user_id").alias("i"), (F.col("event_id") % 60).alias("j"))
    return io.grid_window(e, "2024-01-05 07:00:00", "2024-01-08 07:00:00", (3, 90), (10, 39)).select("event_id", "i", "j")


@reg.add("io16_scene_days", "WITH s AS (SELECT o_orderdate AS dt, o_custkey % 50 AS x0, o_custkey % 50 + 8 AS x1, o_orderkey % 50 AS y0, o_orderkey % 50 + 8 AS y1, o_totalprice % 100 AS cloud FROM orders) SELECT DISTINCT CAST(dt AS DATE) AS solar_day FROM s WHERE x0 <= 20 AND x1 >= 10 AND y0 <= 20 AND y1 >= 10 AND CAST(dt AS DATE) BETWEEN DATE '1995-11-15' AND DATE '1996-04-15' AND cloud < 30")
def io16(spark, d):
    k, c = F.col("o_orderkey") % 50, F.col("o_custkey") % 50
    s = table(spark, d, "orders").select(F.col("o_orderdate").alias("datetime"), c.alias("x0"), (c + 8).alias("x1"), k.alias("y0"), (k + 8).alias("y1"), (F.col("o_totalprice") % 100).alias("cloud_cover"))
    return index.scene_filter(s, (10, 10, 20, 20), "1995-11-15", "1996-04-15", 30)


@reg.add("jn10_projected_cell", "WITH p AS (SELECT c_custkey AS id, radians(-71.5 + c_custkey % 200 / 100.0) * 6378137 AS x, ln(tan(pi() / 4 + radians(41.0 + c_custkey % 170 / 100.0) / 2)) * 6378137 AS y FROM customer) SELECT id, CAST(least(greatest(round((y - 5012345.6) / 1234.5), 0), 149) AS INTEGER) AS row, CAST(least(greatest(round((x + 7959123.4) / 1234.5), 0), 149) AS INTEGER) AS col FROM p")
def jn10(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (-71.5 + F.col("c_custkey") % 200 / 100.0).alias("lon"), (41.0 + F.col("c_custkey") % 170 / 100.0).alias("lat"))
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    return p.select("id", grid.nearest_index(y, 5012345.6, 1234.5, 150).alias("row"), grid.nearest_index(x, -7959123.4, 1234.5, 150).alias("col"))


@reg.add("jn15_masked_layer", f"WITH {LAYER}, {TRIANGLES} SELECT row, col, round(value, 4) AS value FROM la WHERE EXISTS (SELECT 1 FROM tr WHERE {in_triangle('(col + 0.5)', '(59.5 - row)')})")
def jn15(spark, d):
    return rounded(zonal.inside_any(layer(spark, d), triangles(spark, d), SPEC))


@reg.add("jn17_boxes_that_meet", f"""WITH {TRIANGLES}, t AS (SELECT s_suppkey AS tile, s_suppkey * 7 % 550 / 10.0 AS x, s_suppkey * 11 % 550 / 10.0 AS y FROM supplier) SELECT tile, basin_id FROM t, tr WHERE x + 3 > x0 AND y + 3 > y0 AND greatest(x, x0) - x0 + greatest(y, y0) - y0 < 14
 AND NOT (x >= x0 + 2 AND x + 3 <= x0 + 4 AND y >= y0 + 2 AND y + 3 <= y0 + 4)""")
def jn17(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile"), (F.col("s_suppkey") * 7 % 550 / 10.0).alias("x0"), (F.col("s_suppkey") * 11 % 550 / 10.0).alias("y0"))
    tiles = t.withColumn("x1", F.col("x0") + 3).withColumn("y1", F.col("y0") + 3)
    return zonal.boxes_that_meet(tiles, triangles(spark, d), SPEC, "basin_id", "tile")


@reg.add("ag13_valid_hours", f"WITH {CELLS}, {BOXES}, h AS (SELECT row, col, l_orderkey % 24 AS time, CASE WHEN value > 10 THEN value END AS v FROM ce) SELECT basin_id, CAST(count(DISTINCT CASE WHEN v IS NOT NULL THEN time END) AS BIGINT) AS n_hours FROM h JOIN bo ON col >= x0 AND col < x0 + 12 AND 59 - row >= y0 AND 59 - row < y0 + 12 GROUP BY basin_id")
def ag13(spark, d):
    h = cells(spark, d).select("row", "col", (F.col("l_orderkey") % 24).alias("time"), F.when(F.col("value") > 10, F.col("value")).alias("value"))
    return zonal.valid_hours(h, zonal.cell_weights(boxes(spark, d), SPEC, "basin_id"), [], "basin_id")


@reg.add("ag14_distinct_stations", f"WITH {EVENTS} SELECT kind, count(DISTINCT station) AS n_stations, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM ev GROUP BY kind")
def ag14(spark, d):
    return events(spark, d).groupBy("kind").agg(F.countDistinct("station").alias("n_stations"), F.countDistinct(F.to_date("ts")).alias("n_days"))


@reg.add("ag21_class_pairs", "WITH q AS (SELECT l_returnflag AS c, count(*) AS n, quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem GROUP BY 1 HAVING count(*) > 1000) SELECT a.c AS one, b.c AS two, round(a.m - b.m, 3) AS gap FROM q a JOIN q b ON a.c < b.c")
def ag21(spark, d):
    return rounded(index.class_gaps(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", 1000), 3)


@reg.add("sc18_stretch", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, (l_extendedprice - lo) / (hi - lo))), 6) AS v FROM lineitem, q")
def sc18(spark, d):
    li = table(spark, d, "lineitem")
    q = index.quantiles(li, [], "l_extendedprice", (0.02, 0.98))
    return li.crossJoin(F.broadcast(q)).select("l_orderkey", "l_linenumber", F.round(scalars.stretch(F.col("l_extendedprice"), F.col("p02"), F.col("p98")), 6).alias("v"))  # one row


@reg.add("pf12_unit_toggle", f"WITH {EVENTS} SELECT event_id, concat_ws('_', CAST(user_id AS VARCHAR), kind) AS series_key, CASE WHEN station % 2 = 0 THEN round(value / 25.4, 7) ELSE value END AS shown, CASE WHEN station % 2 = 0 THEN 'in' ELSE 'mm' END AS unit FROM ev")
def pf12(spark, d):
    e, inch = events(spark, d), F.col("station") % 2 == 0
    return e.select("event_id", scalars.series_key(F.col("user_id").cast("string"), F.col("kind")).alias("series_key"), F.when(inch, F.round(scalars.mm_to_in(F.col("value")), 7)).otherwise(F.col("value")).alias("shown"), F.when(inch, "in").otherwise("mm").alias("unit"))


_FC = f"""{EVENTS}, c AS (SELECT date_trunc('day', ts) AS init, event_id % 50 AS lead_h, station, value FROM ev WHERE source = 'product'), v AS (SELECT station, CASE WHEN lead_h BETWEEN 1 AND 24 THEN 1 WHEN lead_h BETWEEN 25 AND 48 THEN 2 END AS lead, CAST(timezone('America/New_York', timezone('UTC', init + to_hours(CAST(lead_h AS INTEGER)) - INTERVAL 7 HOUR)) AS DATE) + 1 AS day, value FROM c),
 f AS (SELECT station, lead, day, sum(value) AS est FROM v WHERE lead IS NOT NULL GROUP BY ALL), g AS (SELECT station, {wall7('ts')} AS day, sum(value) AS obs FROM ev WHERE source = 'gauge' GROUP BY ALL), pr AS (SELECT * FROM f JOIN g USING (station, day))"""


@reg.add("pl02_verify_forecast", f"WITH {_FC} SELECT lead, CASE WHEN grouping(station) = 1 THEN 'ALL' ELSE CAST(station AS VARCHAR) END AS who, count(*) AS n, round({PEARSON.format(a='obs', b='est')}, 4) AS r, round(avg(est - obs), 4) AS bias FROM pr GROUP BY GROUPING SETS ((lead), (lead, station))")
def pl02(spark, d):
    """A forecast cube by valid time: lead classes, report dates, then a pooled row and one for each station."""
    e = events(spark, d)
    cube = e.where("source = 'product'").select("station", F.date_trunc("day", "ts").alias("init"), (F.col("event_id") % 50).cast("int").alias("lead_h"), "value")
    f = cube.withColumn("valid", F.col("init") + F.make_dt_interval(hours=F.col("lead_h"))).withColumn("lead", lead_day(F.col("lead_h"))).where("lead IS NOT NULL").groupBy("station", "lead", report_day("valid", "abs7").alias("day")).agg(F.sum("value").alias("est"))
    g = e.where("source = 'gauge'").groupBy("station", report_day("ts", "wall7_left").alias("day")).agg(F.sum("value").alias("obs"))
    pr = f.join(g, ["station", "day"])
    out = pr.groupingSets([[F.col("lead")], [F.col("lead"), F.col("station")]], "lead", "station").agg(F.count("*").alias("n"), verify.pearson("obs", "est").alias("r"), F.avg(F.col("est") - F.col("obs")).alias("bias"), F.grouping("station").alias("pooled"))
    return rounded(out.select("lead", F.when(F.col("pooled") == 1, "ALL").otherwise(F.col("station").cast("string")).alias("who"), "n", "r", "bias"))


_MOIST = f"""ev AS (SELECT CAST(ts AS DATE) AS day, user_id % 9 AS i, CASE WHEN value > 3 THEN value END AS rain, value * 0.6 - 6 AS temp FROM events),
 g AS (SELECT day, i, coalesce(sum(rain), 0) AS p, count(rain) AS n FROM ev GROUP BY ALL), t AS (SELECT day, i, max(temp) AS hi, min(temp) AS lo, count(temp) AS n FROM ev GROUP BY ALL),
 ok AS (SELECT day FROM g GROUP BY day HAVING max(n) >= 4), full_ AS (SELECT day FROM t GROUP BY day HAVING min(n) >= 2), x AS (SELECT t.day, i, CASE WHEN f.day IS NOT NULL THEN hi END AS hi, CASE WHEN f.day IS NOT NULL THEN lo END AS lo FROM t LEFT JOIN full_ f ON f.day = t.day),
 w AS (SELECT day, bool_and(hi IS NOT NULL AND lo IS NOT NULL) AS whole FROM x GROUP BY day), e AS (SELECT x.day, i, lo, dayofyear(x.day) AS doy, CASE WHEN whole THEN greatest(0.0023 * 0.408 * {_RA.replace("doy", "dayofyear(x.day)")} * ((hi + lo) / 2 + 17.8) * sqrt(hi - lo), 0) ELSE 2.35 + 2.05 * cos(2 * pi() * (dayofyear(x.day) - 196) / 365.25) END AS pet FROM x JOIN w ON w.day = x.day),
 da AS (SELECT g.i, CAST(g.day - (SELECT min(day) FROM ok) AS INTEGER) AS n, p, e.pet, e.lo, row_number() OVER (PARTITION BY g.i ORDER BY g.day) AS k FROM g JOIN ok ON ok.day = g.day JOIN e ON e.day = g.day AND e.i = g.i)"""


@reg.add("pl07_moisture_layers", f"""WITH RECURSIVE {_MOIST}, f AS (SELECT i, 0::BIGINT AS k, 20.0::DOUBLE AS s, TRUE AS armed, CAST(NULL AS INTEGER) AS wet FROM (SELECT DISTINCT i FROM da) UNION ALL
 SELECT f.i, d.k, greatest(least(f.s + 0.85::DOUBLE * d.p, 40.0) - d.pet * least(f.s + 0.85::DOUBLE * d.p, 40.0) / 40.0, 0), CASE WHEN d.p >= 12.7 AND (f.armed OR f.s / 40 < 0.3) THEN FALSE ELSE f.armed OR f.s / 40 < 0.3 END, CASE WHEN d.p >= 12.7 AND (f.armed OR f.s / 40 < 0.3) THEN d.n ELSE f.wet END FROM f JOIN da d ON d.i = f.i AND d.k = f.k + 1),
 z AS (SELECT i, max(k) AS k, max(n) AS n FROM da GROUP BY i), r AS (SELECT da.i, {", ".join(f"sum(CASE WHEN da.n > z.n - {w} THEN p END) AS rain_{w}" for w in (7, 14, 21, 30))}, avg(CASE WHEN da.n > z.n - 7 THEN lo END) AS tmin_7, max(z.n) - max(CASE WHEN lo <= -2 THEN da.n END) AS days_since_frost FROM da JOIN z ON z.i = da.i GROUP BY da.i)
 SELECT c.c_custkey AS cell, round(CAST(f.s / 40 AS DOUBLE), 6) AS sm, CAST(z.n - f.wet AS INTEGER) AS days_since_wetup, {", ".join(f"round(rain_{w}, 4) AS rain_{w}" for w in (7, 14, 21, 30))}, round(tmin_7, 4) AS tmin_7, CAST(days_since_frost AS INTEGER) AS days_since_frost FROM customer c JOIN z ON z.i = c.c_custkey % 9 JOIN f ON f.i = z.i AND f.k = z.k JOIN r ON r.i = z.i""")
def pl07(spark, d):
    """Soil water, clocks, trailing rain and cold from hourly rain and temperature: folded on the coarse cells, then gathered to the fine ones (the customers)."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), (F.col("user_id") % 9).alias("i"), F.when(F.col("value") > 3, F.col("value")).alias("rain"), (F.col("value") * 0.6 - 6).alias("temp"))
    days = e.select("day").distinct()
    state = moisture.soil_moisture_state(e.select("day", "i", F.col("rain").alias("value")), e.select("day", "i", F.col("temp").alias("value")), e.select("i").distinct().withColumn("cap", F.lit(40.0)), days, ["i"], 4, 2, spin_up=5)
    fine = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), (F.col("c_custkey") % 9).alias("i"))
    out = fine.join(state, "i").select("cell", F.round("sm", 6).alias("sm"), "days_since_wetup", *[F.round(f"rain_{w}", 4).alias(f"rain_{w}") for w in (7, 14, 21, 30)], F.round("tmin_7", 4).alias("tmin_7"), "days_since_frost")
    return out


COARSE = grid.GridSpec(0.0, 60.0, 5.0, 12, 12)


BASIN_DAYS = f"""{HOURLY}, {TRIANGLES}, h AS (SELECT *, {wall7("time - INTERVAL 1 MICROSECOND")} AS day FROM ho), dy AS (SELECT day, row, col, sum(value) AS value FROM h GROUP BY ALL),
 wt AS (SELECT * FROM (SELECT basin_id, r AS row, c AS col, {triangle_area("(5 * c)", "(55 - 5 * r)", 5)} AS area FROM tr, (SELECT unnest(range(12)) AS r) a, (SELECT unnest(range(12)) AS c) b) WHERE area > 1e-7),
 m AS (SELECT day, basin_id, sum(area * value) / nullif(sum(CASE WHEN value IS NOT NULL THEN area END), 0) AS mean, coalesce(sum(CASE WHEN value IS NOT NULL THEN area END), 0) / {AREA} AS cover FROM dy JOIN wt USING (row, col) GROUP BY ALL),
 n AS (SELECT day, basin_id, count(DISTINCT CASE WHEN value IS NOT NULL THEN time END) AS n FROM h JOIN wt USING (row, col) GROUP BY ALL)"""


@reg.add("pl05_basin_daily", f"""WITH {BASIN_DAYS}
 SELECT day AS report_date, basin_id, round_even(mean, 3) AS precip_mm, round_even(mean / 25.4, 4) AS precip_in, round_even(mean / 1000 * {AREA} * 1000003.0, 1) AS volume_m3, round_even(mean / 1000 * {AREA} * 1000003.0 / 86400, 4) AS volume_flux_m3s, round(round_even(cover, 4), 2) AS cover_frac, n AS n_hours, CAST(24 AS INTEGER) AS n_hours_expected FROM m JOIN n USING (day, basin_id)""")
def pl05d(spark, d):
    """An hourly grid to day records of slanted basins with holes: weights, covered share, valid and expected hours, volume, flux."""
    # an odd unit and fewer decimals of the share: nothing lies half-way between two decimals
    return series.basin_daily(hourly(spark, d), triangles(spark, d), COARSE, unit_m2=1000003.0).withColumn("cover_frac", F.round("cover_frac", 2))


_OFFS = "(VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) o(a, b)"
_ERODE = "SELECT row + a AS row, col + b AS col FROM {0}, " + _OFFS + " GROUP BY ALL HAVING count(*) = 5"
_DILATE = "SELECT DISTINCT row + a AS row, col + b AS col FROM {0}, " + _OFFS
_WAY = [(0.3, 52.2), (40.7, 3.1), (59.1, 44.6)]
_WAYS = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for (a, b), (c, e) in zip(_WAY, _WAY[1:], strict=False))


@reg.add("pl11_wet_ground", f"""WITH RECURSIVE {LAYER}, {BOXES}, m0 AS (SELECT row, col FROM la WHERE value > 20 AND row % 20 < 14 AND col % 20 < 13), m1 AS ({_ERODE.format("m0")}), m2 AS ({_DILATE.format("m1")}), m3 AS ({_DILATE.format("m2")}), m4 AS ({_DILATE.format("m3")}), m5 AS ({_ERODE.format("m4")}), m6 AS ({_ERODE.format("m5")}),
 m AS (SELECT row, col, row::BIGINT * 2147483648 + col AS id FROM m6), r(id, row, col, root) AS (SELECT id, row, col, id FROM m UNION SELECT m.id, m.row, m.col, r.root FROM r JOIN m ON abs(m.row - r.row) + abs(m.col - r.col) = 1), l AS (SELECT id, row, col, min(root) AS label FROM r GROUP BY ALL),
 p AS (SELECT label, count(*) * 1.0 AS area, avg(value) AS mean, CAST(floor(avg(l.row)) AS INTEGER) AS row, CAST(floor(avg(l.col)) AS INTEGER) AS col FROM l LEFT JOIN la ON la.row = l.row AND la.col = l.col GROUP BY label HAVING count(*) >= 4),
 f AS (SELECT label, CAST(trunc(coalesce(median(value), -1)) AS INTEGER) AS median FROM p LEFT JOIN la ON (la.row - p.row) * (la.row - p.row) + (la.col - p.col) * (la.col - p.col) <= 25 GROUP BY label),
 q AS (SELECT label, sqrt(min(pow(greatest(x0 - (col + 0.5), 0, col + 0.5 - x0 - 12), 2) + pow(greatest(y0 - (59.5 - row), 0, 59.5 - row - y0 - 12), 2))) AS distance FROM p, bo WHERE kind = 0 GROUP BY label),
 s AS (SELECT label, l.col AS x, 59 - l.row AS y FROM l), k AS (SELECT * FROM (VALUES {_WAYS}) t(ax, ay, ex, ey)),
 t AS (SELECT label, sqrt(power(ex - ax, 2) + power(ey - ay, 2)) AS n, greatest(0, least((x - ax) / (ex - ax), (x + 1 - ax) / (ex - ax)), least((y - ay) / (ey - ay), (y + 1 - ay) / (ey - ay))) AS lo, least(1, greatest((x - ax) / (ex - ax), (x + 1 - ax) / (ex - ax)), greatest((y - ay) / (ey - ay), (y + 1 - ay) / (ey - ay))) AS hi FROM s, k),
 c AS (SELECT label, sum(n * (hi - lo)) AS length FROM t WHERE hi > lo GROUP BY label)
 SELECT CAST(p.label AS BIGINT) AS label, CAST(area AS DOUBLE) AS area, round(mean, 4) AS mean, p.row, p.col, median, round(distance, 4) AS distance, round(coalesce(length, 0), 4) AS length FROM p JOIN f USING (label) JOIN q USING (label) LEFT JOIN c USING (label)""")
def pl11w(spark, d):
    """Wet ground: opened and closed mask, patches, what is around their middle, how far the water is, how much of a line is in them."""
    wet = (F.col("value") > 20) & (F.col("row") % 20 < 14) & (F.col("col") % 20 < 13)
    return rounded(land.wet_patches(layer(spark, d), wet, SPEC, 4.0, boxes(spark, d).where("kind = 0"), _WAY))


_SOIL = f"""{TRIANGLES}, u AS (SELECT n_nationkey AS mukey, n_name AS muname, CASE n_nationkey % 8 {" ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(codes.DRAINAGE.values()))} END AS drainage, greatest(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 5 * 10.0 ELSE (n_nationkey % 7 + 1) * 10 * 0.3 END, 8) AS capacity FROM nation),
 b AS (SELECT x, y, max(basin_id) AS mukey FROM tr, (SELECT unnest(range(60)) AS x) a, (SELECT unnest(range(60)) AS y) c WHERE {in_triangle("(x + 0.5)", "(y + 0.5)")} GROUP BY ALL), l AS (SELECT x, y, u.* FROM b JOIN u USING (mukey))"""


def soil(spark, d):
    """Map units as a header-row table, their triangles, and the layers of both."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    name = F.get(F.array(*map(F.lit, codes.DRAINAGE)), (k % 8).cast("int"))
    rows = F.array(k.cast("string"), F.col("n_name"), F.coalesce(name, F.lit("Not rated")), (k % 7 + 1).cast("string"), F.when(k % 3 == 0, (k % 5).cast("string")).otherwise(""))
    texts = n.select(F.to_json(F.array(F.array(*map(F.lit, ("mukey", "muname", "drainagecl", "aws100", "aws25"))), rows)).alias("value"))
    polygons = triangles(spark, d).select(F.col("basin_id").cast("string").alias("mukey"), "basin_id", "rings")
    return land.soil_layers(land.soil_units(texts), polygons, SPEC, "basin_id")


@reg.add("pl12_soil_layers", f"WITH {_SOIL} SELECT CAST(59 - y AS INTEGER) AS row, CAST(x AS INTEGER) AS col, CAST(mukey AS VARCHAR) AS mukey, muname, CAST(drainage AS INTEGER) AS drainage, CAST(capacity AS DOUBLE) AS capacity FROM l")
def pl12s(spark, d):
    return soil(spark, d)


@reg.add("pl12_soil_summary", f"WITH {_SOIL} SELECT 'drainage' AS kind, coalesce(CAST(drainage AS VARCHAR), 'none') AS label, CAST(count(*) AS DOUBLE) AS area, round(avg(capacity), 4) AS mean_attr, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM l GROUP BY drainage UNION ALL SELECT * FROM (SELECT 'unit', muname, CAST(count(*) AS DOUBLE), round(avg(capacity), 4), round(100.0 * count(*) / sum(count(*)) OVER (), 4) FROM l GROUP BY muname ORDER BY count(*) DESC, muname LIMIT 12)")
def pl12t(spark, d):
    layers = soil(spark, d)
    one, two = land.soil_summary(layers, SPEC), land.soil_summary(layers, SPEC, "muname", 12)
    return rounded(one.select(F.lit("drainage").alias("kind"), F.coalesce(F.col("drainage").cast("string"), F.lit("none")).alias("label"), "area", "mean_attr", "pct").unionByName(two.select(F.lit("unit").alias("kind"), F.col("muname").alias("label"), "area", "mean_attr", "pct")))


@reg.add("pl12_forest_summary", f"WITH {LAYER}, f AS (SELECT row, col, (row * 7 + col) % 12 * 100 AS code, value FROM la), g AS (SELECT CASE code {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in codes.FOREST_TYPE_GROUPS.items())} ELSE concat('unmapped ', code) END AS forest, CASE WHEN value > 22 THEN value END AS s FROM f) SELECT forest, CAST(count(*) * 0.09 AS DOUBLE) AS area, round(avg(s), 4) AS mean_attr, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM g GROUP BY forest")
def pl12f(spark, d):
    la = layer(spark, d)
    kinds = la.select("row", "col", ((F.col("row") * 7 + F.col("col")) % 12 * 100).alias("value"))
    return rounded(land.forest_summary(kinds, la, 0.09, 22.0))


@reg.add("pl12_public_land", f"WITH {LAYER}, {BOXES}, o AS (SELECT x0, y0, CASE WHEN n_name LIKE '%A%' THEN 2 ELSE 1 END AS v, basin_id FROM bo JOIN nation ON n_nationkey = basin_id) SELECT coalesce(v, 0) AS code, count(*) AS n, CAST(count(*) * 0.0009 AS DOUBLE) AS km2 FROM la LEFT JOIN o ON col >= x0 AND col < x0 + 12 AND 59 - row >= y0 AND 59 - row < y0 + 12 GROUP BY 1")
def pl12(spark, d):
    """Owner patterns on polygons, burnt to cells, counted by code; cells outside all are 0."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("basin_id"), "n_name")
    own = boxes(spark, d).join(names, "basin_id").withColumn("v", F.when(scalars.like_any(F.col("n_name"), ["%A%"]), 2).otherwise(1))
    burnt = zonal.burn(own, SPEC, "v", "basin_id").withColumnRenamed("value", "v")
    return layer(spark, d).join(burnt, ["row", "col"], "left").groupBy(F.coalesce("v", F.lit(0)).alias("code")).agg(F.count("*").alias("n")).withColumn("km2", F.round(F.col("n") * 0.0009, 6))


@reg.add("pl06_explorer_top", f"WITH {SERIES} SELECT basin_id, round(mm, 4) AS precip_mm, round(100.0 * n_hours / n_hours_expected, 3) AS pct_hours FROM se WHERE report_date = (SELECT max(report_date) FROM se) ORDER BY mm DESC, basin_id LIMIT 5")
def pl06(spark, d):
    s = basin_series(spark, d)
    last = s.join(F.broadcast(s.agg(F.max("report_date").alias("report_date"))), "report_date")  # one row
    return last.select("basin_id", "precip_mm", (100 * F.try_divide(F.col("n_hours"), F.col("n_hours_expected"))).alias("pct_hours")).orderBy(F.desc("precip_mm"), "basin_id").limit(5).select("basin_id", F.round("precip_mm", 4).alias("precip_mm"), F.round("pct_hours", 3).alias("pct_hours"))


@reg.add("pl06_explorer_tables", f"""WITH {SERIES}, x AS (SELECT min(report_date) AS first, max(report_date) AS last, count(DISTINCT basin_id) AS n_basins, greatest(max(report_date) - 364, min(report_date)) AS "from" FROM se), i AS (SELECT se.* FROM se, x WHERE report_date BETWEEN "from" AND last),
 l AS (SELECT basin_id, mm, 100.0 * n_hours / n_hours_expected AS h FROM se WHERE report_date = (SELECT last FROM x) ORDER BY mm DESC, basin_id LIMIT 5)
 SELECT 'extent' AS part, CAST("from" AS VARCHAR) AS key, CAST(n_basins AS DOUBLE) AS a, CAST(last - first AS DOUBLE) AS b FROM x UNION ALL
 SELECT 'period', CAST(basin_id AS VARCHAR), round(sum(mm), 4), round(100 * avg(CASE WHEN n_hours = n_hours_expected THEN 1.0 ELSE 0.0 END), 4) FROM i GROUP BY basin_id UNION ALL
 SELECT 'years', CAST(year(report_date) AS VARCHAR), round(100 * avg(CASE WHEN n_hours = n_hours_expected THEN 1.0 ELSE 0.0 END), 4), count(*) FROM se GROUP BY year(report_date) UNION ALL
 SELECT 'totals', CAST(report_date AS VARCHAR), round(sum(CASE WHEN kind <> 0 THEN mm / 1000 * 144e6 END) / 1e6, 4), round(sum(CASE WHEN kind = 0 THEN mm / 1000 * 144e6 END) / 1e6, 4) FROM i GROUP BY report_date UNION ALL
 SELECT 'latest', CAST(basin_id AS VARCHAR), round(mm, 4), round(h, 4) FROM l""")
def pl06t(spark, d):
    """All tables of the explorer by one operator, one below the other."""
    t = series.explorer(basin_series(spark, d).withColumn("water", F.col("kind") == 0), "water")
    shown = {
        "extent": ("default_first", F.col("n_basins"), F.datediff("last", "first")), "period": ("basin_id", F.col("total_mm"), F.col("pct_complete")), "years": ("year", F.col("pct_complete"), F.col("n")),
        "totals": ("report_date", F.col("land"), F.col("water")), "latest": ("basin_id", F.col("precip_mm"), F.col("pct_hours")),
    }
    rows = [t[part].select(F.lit(part).alias("part"), F.col(key).cast("string").alias("key"), a.cast("double").alias("a"), b.cast("double").alias("b")) for part, (key, a, b) in shown.items()]
    return rounded(reduce(DataFrame.unionByName, rows))


#: Twelve o'clock cycles with every fifth day's missing, on a forecast grid of 3 km; stations in it.
_CYCLE = "date_trunc('day', ts) + INTERVAL 12 HOUR"
_HRRR = """sp AS (SELECT CAST(n_nationkey AS INTEGER) AS station, -71.5 + n_nationkey * 17 % 25 * 0.04 AS lon, radians(41.0 + n_nationkey * 11 % 25 * 0.03) AS lat FROM nation WHERE n_nationkey < 16), k AS (SELECT sin(radians(38.5)) AS n, 6371229.0 AS a, cos(radians(38.5)) * power(tan(pi() / 4 + radians(38.5) / 2), sin(radians(38.5))) / sin(radians(38.5)) AS f),
 q AS (SELECT station, a * f / power(tan(pi() / 4 + lat / 2), n) AS r, a * f / power(tan(pi() / 4 + radians(38.5) / 2), n) AS r0, n * (radians(lon) - radians(-97.5)) AS t FROM sp, k),
 st AS (SELECT station, CAST(least(greatest(round_even((r0 - r * cos(t) - 600000) / 60000, 0), 0), 3) AS INTEGER) AS row, CAST(least(greatest(round_even((r * sin(t) - 2100000) / 60000, 0), 0), 3) AS INTEGER) AS col FROM q)"""


@reg.add("pl02_forecast_table", f"""WITH {EVENTS}, {_HRRR}, cu AS (SELECT {_CYCLE} AS init, CAST(event_id // 16 % 50 AS INTEGER) AS lead_h, event_id % 4 AS row, event_id // 4 % 4 AS col, avg(value) AS value FROM ev WHERE dayofyear(ts) % 5 <> 0 GROUP BY ALL),
 w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 12:00:00', TIMESTAMP '2024-01-25 12:00:00', INTERVAL 1 DAY)) AS wanted), c AS (SELECT DISTINCT init FROM cu), n AS (SELECT DISTINCT arg_min(init, (abs(epoch(init) - epoch(wanted)), init)) AS init FROM w, c GROUP BY wanted),
 f AS (SELECT st.station, CASE WHEN lead_h BETWEEN 1 AND 24 THEN 1 WHEN lead_h BETWEEN 25 AND 48 THEN 2 END AS lead, {wall7("(init + to_hours(lead_h) - INTERVAL 1 MICROSECOND)")} AS day, sum(value) AS est FROM cu JOIN n USING (init) JOIN st ON st.row = cu.row AND st.col = cu.col WHERE lead_h BETWEEN 1 AND 48 GROUP BY ALL),
 g AS (SELECT station, {wall7('ts')} AS day, sum(value) AS obs FROM ev WHERE source = 'gauge' GROUP BY ALL), pr AS (SELECT * FROM f JOIN g USING (station, day) WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'),
 s AS (SELECT lead, CASE WHEN grouping(station) = 1 THEN 'ALL' ELSE CAST(station AS VARCHAR) END AS who, count(*) AS n, {PEARSON.format(a='obs', b='est')} AS r, avg(est - obs) AS bias FROM pr GROUP BY GROUPING SETS ((lead), (lead, station))),
 o AS (SELECT CAST(station AS VARCHAR) AS who FROM sp UNION ALL SELECT 'ALL')
 SELECT who, CAST(coalesce(max(CASE WHEN lead = 1 THEN n END), 0) AS BIGINT) AS n_lead1, round(max(CASE WHEN lead = 1 THEN r END), 4) AS r_lead1, round(max(CASE WHEN lead = 1 THEN bias END), 4) AS bias_lead1, CAST(coalesce(max(CASE WHEN lead = 2 THEN n END), 0) AS BIGINT) AS n_lead2, round(max(CASE WHEN lead = 2 THEN r END), 4) AS r_lead2, round(max(CASE WHEN lead = 2 THEN bias END), 4) AS bias_lead2 FROM o LEFT JOIN s USING (who) GROUP BY who""")
def pl02t(spark, d):
    """From a projected forecast cube with missing cycles and stations by longitude and latitude to the table of leads."""
    e = events(spark, d)
    k = F.col("event_id")
    cube = e.where(F.dayofyear("ts") % 5 != 0).groupBy((F.date_trunc("day", "ts") + F.expr("interval 12 hours")).alias("init"), (F.floor(k / 16) % 50).cast("int").alias("lead_h"), (k % 4).cast("int").alias("row"), (F.floor(k / 4) % 4).cast("int").alias("col")).agg(F.avg("value").alias("value"))
    n = F.col("n_nationkey")
    stations = table(spark, d, "nation").where("n_nationkey < 16").select(n.cast("int").alias("station"), (-71.5 + n * 17 % 25 * 0.04).alias("lon"), (41.0 + n * 11 % 25 * 0.03).alias("lat"))
    gauge = e.where("source = 'gauge'").groupBy("station", report_day("ts", "wall7_left").alias("day")).agg(F.sum("value").alias("obs"))
    axes = verify.ForecastGrid(600000.0, 2100000.0, 60000.0, 4, 4)
    return rounded(verify.verify_forecast(cube, stations, gauge, axes, "2024-01-05", "2024-01-25"))
