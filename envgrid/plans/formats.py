"""Queries of the formats, lookups and orders of the inventory, each a round trip through what the library writes."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from envgrid.functions import codes, geo, scalars
from envgrid.operators import deliver, grid, index, moisture, score, series, verify, zonal
from envgrid.plans.climate import _LAYERS, _SCORED, _TERMS, SPECIES_SQL, scored_cells
from envgrid.plans.fields import SERIES, SPEC, basin_series
from envgrid.plans.views import AREA, DAILY, EVENTS, LAYER, LEG, TRIANGLES, Registry, daily, events, in_triangle, layer, rounded, table, triangles
from envgrid.sources import io, stages

reg = Registry()


def folder(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{stages.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@reg.add("io01_series_round_trip", f"WITH {SERIES} SELECT report_date, basin_id, round(mm, 4) AS precip_mm FROM se WHERE report_date BETWEEN DATE '1995-02-01' AND DATE '1995-05-31'")
def io01(spark, d):
    """The series written by date and sorted by polygon, and a range of it read back with three columns."""
    path = folder(spark, "series")
    io.write_series(basin_series(spark, d).select("report_date", "basin_id", F.round("precip_mm", 4).alias("precip_mm"), "n_hours"), path)
    return io.read_series(spark, path, "1995-02-01", "1995-05-31", ["report_date", "basin_id", "precip_mm"])


_GAUGE = "SELECT concat('MA-', station) AS \"stationNumber\", concat('Gauge \"', station, '\", north') AS \"stationName\", 41 + station / 64.0 AS latitude, -71 - station / 64.0 AS longitude, CAST(ts AS DATE) AS date, max(value) AS precip_in FROM ev GROUP BY station, CAST(ts AS DATE)"


def gauges(spark, d):
    e, s = events(spark, d), F.col("station")
    return e.groupBy("station", F.to_date("ts").alias("date")).agg(F.max("value").alias("precip_in")).select(
        F.concat(F.lit("MA-"), s).alias("stationNumber"), F.concat(F.lit('Gauge "'), s, F.lit('", north')).alias("stationName"), (41 + s / 64.0).alias("latitude"), (-71 - s / 64.0).alias("longitude"), "date", "precip_in"
    )


@reg.add("io03_csv_round_trip", f"WITH {EVENTS} {_GAUGE}")
def io03(spark, d):
    """Gauge days with quotes and commas in their names, through CSV."""
    path = folder(spark, "csv")
    io.write_csv(gauges(spark, d), path)
    return io.read_csv(spark, path)


def feature_texts(spark, d):
    """Triangles as feature collections, one for each region: rings as coordinate lists."""
    t = triangles(spark, d).withColumn("c", F.expr("transform(rings, r -> transform(r, p -> array(p.x, p.y)))"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col("c").alias("coordinates"))
    f = F.struct(F.struct(F.col("basin_id").cast("string").alias("id"), F.col("n_name").alias("name")).alias("properties"), geometry.alias("geometry"))
    return t.groupBy("kind").agg(F.to_json(F.struct(F.collect_list(f).alias("features"))).alias("value"))


@reg.add("io07_polygon_features", f"SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 2 AS n_rings, {AREA} AS area FROM nation")
def io07(spark, d):
    f = io.polygon_features(feature_texts(spark, d), ["id", "name"])
    return f.select("id", "name", F.size("rings").alias("n_rings"), F.round(geo.polygon_area("rings"), 6).alias("area"))


@reg.add("io08_feature_attributes", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def io08(spark, d):
    return io.features(feature_texts(spark, d), ["id", "name"])


@reg.add("io09_ring_roles", f"SELECT CAST(n_nationkey AS INTEGER) AS basin_id, t.\"outer\", CAST(t.area AS DOUBLE) AS area, round(t.length, 6) AS length FROM nation, (VALUES (TRUE, {LEG * LEG / 2}, {2 * LEG + LEG * math.sqrt(2)}::DOUBLE), (FALSE, 4.0, 8.0::DOUBLE)) t(\"outer\", area, length)")
def io09(spark, d):
    """Clockwise rings are outer, the others holes; areas with their sign's meaning, and lengths."""
    r = triangles(spark, d).select("basin_id", F.explode(geo.ring_roles("rings")).alias("x")).select("basin_id", "x.outer", "x.ring")
    return r.select("basin_id", "outer", F.round(F.abs(geo.signed_area("ring")), 6).alias("area"), F.round(geo.line_length("ring"), 6).alias("length"))


@reg.add("io10_wkt_polygons", f"WITH {TRIANGLES} SELECT basin_id, 2 AS n_rings, {AREA} AS area, x0, y0 FROM tr")
def io10(spark, d):
    text = F.expr("concat('POLYGON(', array_join(transform(rings, r -> concat('(', array_join(transform(r, p -> concat(p.x, ' ', p.y)), ', '), ')')), ', '), ')')")
    w = triangles(spark, d).select("basin_id", text.alias("wkt")).select("basin_id", geo.wkt_rings("wkt").alias("rings"))
    return w.select("basin_id", F.size("rings").alias("n_rings"), F.round(geo.polygon_area("rings"), 6).alias("area"), geo.bounds("rings")["x0"].alias("x0"), geo.bounds("rings")["y0"].alias("y0"))


@reg.add("io12_observations", "SELECT DISTINCT event_type AS \"stationNumber\", concat('n', user_id % 16) AS \"stationName\", CAST(user_id % 16 AS DOUBLE) AS latitude, -CAST(user_id % 16 AS DOUBLE) AS longitude, CAST(ts AS DATE) AS date, round(value, 3) AS precip_in FROM events")
def io12(spark, d):
    """Landed pages to distinct reports."""
    s = F.col("user_id") % 16
    r = F.struct(F.col("event_type").alias("stationNumber"), F.concat(F.lit("n"), s).alias("stationName"), F.col("event_id").alias("stationId"), s.cast("double").alias("latitude"), (-s).cast("double").alias("longitude"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("obsDateTime"), F.round("value", 3).alias("precip"))
    pages = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.to_json(F.struct(F.collect_list(r).alias("results"))).alias("value"))
    return io.observations(pages.unionByName(pages.where("user_id % 5 = 0")))  # some pages landed twice


@reg.add("io14_layer_windows", f"WITH {LAYER}, n AS (SELECT row, col, CASE WHEN value > 20 THEN round(value, 4) END AS v FROM la) SELECT 'missing' AS policy, row, col, v AS value FROM n WHERE row BETWEEN 5 AND 40 AND col BETWEEN 10 AND 30 UNION ALL SELECT 'zero', row, col, coalesce(v, 0) FROM n")
def io14(spark, d):
    """A layer with a nodata number, written by tiles; a window read with it as missing, the whole with it as zero."""
    path = folder(spark, "layers")
    io.write_layer(layer(spark, d).select("row", "col", F.when(F.col("value") > 20, F.round("value", 4)).otherwise(F.lit(-9999.0)).alias("value")), path, "depth", 16)
    part = io.read_layer(spark, path, "depth", (5, 40), (10, 30), nodata=-9999.0)
    whole = io.read_layer(spark, path, "depth", nodata=-9999.0, nodata_value=0.0)
    return part.select(F.lit("missing").alias("policy"), "row", "col", "value").unionByName(whole.select(F.lit("zero").alias("policy"), "row", "col", "value"))


@reg.add("io18_chosen_dates", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-03-01' OR CAST(o_orderdate AS DATE) BETWEEN DATE '1995-04-10' AND DATE '1995-06-20' GROUP BY 1")
def io18(spark, d):
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return o.join(series.parse_dates(spark, "1995-03-01,1995-04-10:1995-06-20,1995-05-01"), "day")


@reg.add("io20_reused_stage", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, 1 AS n_made FROM orders GROUP BY 1")
def io20(spark, d):
    """A stage that is made once: the second call reads it, another fingerprint of the inputs would make it anew."""
    made, path = [], folder(spark, "once")

    def make():
        made.append(1)
        return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))

    stages.stage_once(spark, path, make, "orders")
    again = stages.stage_once(spark, path, make, "orders")
    return again.withColumn("n_made", F.lit(len(made)))


@reg.add("io21_display_table", f"""WITH {LAYER}, {TRIANGLES}, g AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM (SELECT unnest(range(30)) AS r) a, (SELECT unnest(range(30)) AS c) b WHERE EXISTS (SELECT 1 FROM tr WHERE {in_triangle('(2 * c + 1.0)', '(60 - (2 * r + 1.0))')})),
 v AS (SELECT g.row, g.col, CASE WHEN value IS NOT NULL THEN greatest(0, least(1, (value - 15) / 20.0)) END AS x FROM g LEFT JOIN la ON la.row = 2 * g.row + 1 AND la.col = 2 * g.col + 1)
 SELECT row, col, CAST(coalesce(1 + round_even(254 * x, 0), 0) AS INTEGER) AS twin, CAST(coalesce(1 + round_even(x * 7, 0), 0) AS INTEGER) AS palette FROM v""")
def io21(spark, d):
    """A layer on the display grid: aligned to its cells, clipped to a region of polygons, quantised."""
    return deliver.display_table(layer(spark, d), SPEC, triangles(spark, d), grid.GridSpec(0.0, 60.0, 2.0, 30, 30), 15.0, 35.0, 8)


_OWNERS = "SELECT c_custkey, concat(CASE c_custkey % 9 WHEN 0 THEN 'TOWN OF ' WHEN 1 THEN 'CITY OF ' WHEN 2 THEN 'USA ' WHEN 3 THEN 'MASSACHUSETTS ' WHEN 4 THEN 'THE COUNTY OF ' WHEN 5 THEN 'US ARMY ' WHEN 6 THEN 'OLD NATIONAL PARK SERVICE ' ELSE '' END, n_name, CASE WHEN c_custkey % 7 = 0 THEN ' FIRE DISTRICT' ELSE '' END) AS owner FROM customer JOIN nation ON n_nationkey = c_nationkey"


def owners(spark, d):
    k = F.col("c_custkey")
    kinds = ["TOWN OF ", "CITY OF ", "USA ", "MASSACHUSETTS ", "THE COUNTY OF ", "US ARMY ", "OLD NATIONAL PARK SERVICE ", "", ""]
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.select("c_custkey", F.concat(F.element_at(F.array(*map(F.lit, kinds)), (k % 9 + 1).cast("int")), "n_name", F.when(k % 7 == 0, " FIRE DISTRICT").otherwise("")).alias("owner"))


PUBLIC_SQL = "(" + " OR ".join(f"owner LIKE '{p}'" for p in codes.PUBLIC_OWNERS) + ")"


@reg.add("pf10_public_owners", f"SELECT c_custkey, owner FROM ({_OWNERS}) WHERE {PUBLIC_SQL}")
def pf10(spark, d):
    return owners(spark, d).where(scalars.public_owner(F.col("owner")))


_DRAIN = list(codes.DRAINAGE)
_CASE = lambda x, pairs, other: f"CASE {x} " + " ".join(f"WHEN {k} THEN {v}" for k, v in pairs) + f" ELSE {other} END"


@reg.add("pf11_drainage_and_forest", "SELECT {} AS ordinal, {} AS forest, count(*) AS n FROM lineitem GROUP BY 1, 2".format(_CASE("l_linenumber", [(k + 1, v) for k, v in enumerate(codes.DRAINAGE.values()) if k < 5], "NULL"), _CASE("l_linenumber * 100 + l_suppkey % 3 * 20", [(k, f"'{v}'") for k, v in codes.FOREST_TYPE_GROUPS.items()], "concat('unmapped ', l_linenumber * 100 + l_suppkey % 3 * 20)")))
def pf11(spark, d):
    n = F.col("l_linenumber")
    name = F.get(F.array(*[F.lit(x) for x in _DRAIN[:5]], F.lit("not rated"), F.lit("unknown")), (n - 1).cast("int"))
    code = (n * 100 + F.col("l_suppkey") % 3 * 20).cast("int")
    return table(spark, d, "lineitem").groupBy(scalars.drainage_ordinal(name).alias("ordinal"), scalars.forest_group(code).alias("forest")).agg(F.count("*").alias("n"))


@reg.add("pf15_valid_polygons", "SELECT CAST(n_nationkey AS INTEGER) AS basin_id, n_nationkey % 5 = 4 AS valid FROM nation")
def pf15(spark, d):
    """Open, empty, missing and flat outlines among whole ones."""
    k = F.col("basin_id") % 5
    flat = F.expr("array(array(named_struct('x', x0, 'y', y0), named_struct('x', x0 + 1, 'y', y0), named_struct('x', x0 + 2, 'y', y0), named_struct('x', x0, 'y', y0)))")
    broken = F.when(k == 0, F.expr("transform(rings, r -> slice(r, 1, size(r) - 1))")).when(k == 1, F.slice("rings", 1, 0)).when(k == 2, F.lit(None)).when(k == 3, flat).otherwise(F.col("rings"))
    return triangles(spark, d).withColumn("r", broken).select("basin_id", geo.polygon_valid("r").alias("valid"))


@reg.add("jn07_ordered_lookup", "SELECT t.place, s_suppkey, s_name FROM supplier JOIN (VALUES (1, 7), (2, 3), (3, 9), (4, 1)) t(place, k) ON k = s_suppkey")
def jn07(spark, d):
    """Stations in a given order; an unknown one would be an error."""
    return verify.ordered_lookup([7, 3, 9, 1], table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")


_LONLAT = "p AS (SELECT c_custkey AS id, radians(-71.5 + c_custkey % 200 / 100.0) AS lon, radians(41.0 + c_custkey % 170 / 100.0) AS lat FROM customer)"


def lonlat(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (-71.5 + F.col("c_custkey") % 200 / 100.0).alias("lon"), (41.0 + F.col("c_custkey") % 170 / 100.0).alias("lat"))


@reg.add("jn10_forecast_cell", f"""WITH {_LONLAT}, k AS (SELECT sin(radians(38.5)) AS n, 6371229.0 AS a, cos(radians(38.5)) * power(tan(pi() / 4 + radians(38.5) / 2), sin(radians(38.5))) / sin(radians(38.5)) AS f),
 q AS (SELECT id, a * f / power(tan(pi() / 4 + lat / 2), n) AS r, a * f / power(tan(pi() / 4 + radians(38.5) / 2), n) AS r0, n * (lon - radians(-97.5)) AS t FROM p, k)
 SELECT id, CAST(least(greatest(round_even((r0 - r * cos(t) - 500000) / 3000, 0), 0), 399) AS INTEGER) AS row, CAST(least(greatest(round_even((r * sin(t) - 1900000) / 3000, 0), 0), 399) AS INTEGER) AS col FROM q""")
def jn10(spark, d):
    """Cells of the forecast grid, on its Lambert projection."""
    x, y = geo.to_hrrr(F.col("lon"), F.col("lat"))
    return lonlat(spark, d).select("id", grid.nearest_index(y, 500000.0, 3000.0, 400).alias("row"), grid.nearest_index(x, 1900000.0, 3000.0, 400).alias("col"))


@reg.add("sc16_lambert_mainland", f"""WITH {_LONLAT}, e AS (SELECT sqrt(2 / 298.257222101 - power(1 / 298.257222101, 2)) AS e, radians(42.683333333333334) AS p1, radians(41.71666666666667) AS p2, radians(41.0) AS p0),
 k AS (SELECT *, cos(p1) / sqrt(1 - power(e * sin(p1), 2)) AS m1, cos(p2) / sqrt(1 - power(e * sin(p2), 2)) AS m2, tan(pi() / 4 - p1 / 2) / power((1 - e * sin(p1)) / (1 + e * sin(p1)), e / 2) AS t1, tan(pi() / 4 - p2 / 2) / power((1 - e * sin(p2)) / (1 + e * sin(p2)), e / 2) AS t2, tan(pi() / 4 - p0 / 2) / power((1 - e * sin(p0)) / (1 + e * sin(p0)), e / 2) AS t0 FROM e),
 n AS (SELECT *, ln(m1 / m2) / ln(t1 / t2) AS n FROM k), f AS (SELECT *, 6378137.0 * m1 / (n * power(t1, n)) AS f FROM n),
 q AS (SELECT id, f * power(tan(pi() / 4 - lat / 2) / power((1 - e * sin(lat)) / (1 + e * sin(lat)), e / 2), n) AS r, f * power(t0, n) AS r0, n * (lon - radians(-71.5)) AS t FROM p, f)
 SELECT id, round(200000 + r * sin(t), 3) AS x, round(750000 + r0 - r * cos(t), 3) AS y FROM q""")
def sc16_lambert(spark, d):
    x, y = geo.to_mass_mainland(F.col("lon"), F.col("lat"))
    return lonlat(spark, d).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_SERIES = lambda f, g: " + ".join(f"{a!r}::DOUBLE * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))


@reg.add("sc16_utm", f"""WITH {_LONLAT}, c AS (SELECT id, lon - radians(-69) AS l, atanh(sin(lat)) - {2 * math.sqrt(_N) / (1 + _N)!r}::DOUBLE * atanh({2 * math.sqrt(_N) / (1 + _N)!r}::DOUBLE * sin(lat)) AS u FROM p), t AS (SELECT id, l, (exp(u) - exp(-u)) / 2 AS t FROM c),
 q AS (SELECT id, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM t), s AS (SELECT *, (exp(2 * eta) - exp(-2 * eta)) / 2 AS s2, 1 AS one FROM q)
 SELECT id, round(500000 + 0.9996::DOUBLE * {6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)!r}::DOUBLE * (eta + {_SERIES('cos', 'sinh')}), 3) AS x, round(0.9996::DOUBLE * {6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)!r}::DOUBLE * (xi + {_SERIES('sin', 'cosh')}), 3) AS y FROM s""")
def sc16_utm(spark, d):
    x, y = geo.to_utm(F.col("lon"), F.col("lat"))
    return lonlat(spark, d).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_LEGS = """SELECT CAST(n_nationkey AS INTEGER) AS line, n_nationkey * 7 % 59 + 0.31::DOUBLE AS ax, n_nationkey * 11 % 59 + 0.23::DOUBLE AS ay, (n_nationkey * 23 + 17) % 59 + 0.57::DOUBLE AS bx, (n_nationkey * 29 + 31) % 59 + 0.71::DOUBLE AS "by",
 (n_nationkey * 41 + 5) % 59 + 0.13::DOUBLE AS cx, (n_nationkey * 13 + 47) % 59 + 0.89::DOUBLE AS cy FROM nation"""


@reg.add("jn21_line_in_patches", f"""WITH {TRIANGLES}, c AS (SELECT basin_id AS label, x, y FROM tr, (SELECT unnest(range(60)) AS x) a, (SELECT unnest(range(60)) AS y) b WHERE {in_triangle('(x + 0.5)', '(y + 0.5)')}), w AS ({_LEGS}),
 l AS (SELECT line, 0 AS leg, ax, ay, bx AS ex, "by" AS ey FROM w UNION ALL SELECT line, 1, bx, "by", cx, cy FROM w),
 t AS (SELECT line, leg, label, sqrt(power(ex - ax, 2) + power(ey - ay, 2)) AS n, greatest(0, least((x - ax) / (ex - ax), (x + 1 - ax) / (ex - ax)), least((y - ay) / (ey - ay), (y + 1 - ay) / (ey - ay))) AS lo, least(1, greatest((x - ax) / (ex - ax), (x + 1 - ax) / (ex - ax)), greatest((y - ay) / (ey - ay), (y + 1 - ay) / (ey - ay))) AS hi FROM c, l),
 p AS (SELECT line, label, n * (hi - lo) AS len, leg + lo AS s, lag(leg + hi) OVER (PARTITION BY line, label ORDER BY leg + lo) AS before FROM t WHERE hi > lo)
 SELECT line, label, round(sum(len), 5) AS length, CAST(sum(CASE WHEN before IS NULL OR s > before + 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS crossings FROM p GROUP BY line, label""")
def jn21(spark, d):
    """Length of bent lines within patches of cells, and how often each enters."""
    n = F.col("n_nationkey")
    at = lambda k, a, x: ((n * k + a) % 59 + x).cast("double")
    corners = [(at(7, 0, 0.31), at(11, 0, 0.23)), (at(23, 17, 0.57), at(29, 31, 0.71)), (at(41, 5, 0.13), at(13, 47, 0.89))]
    lines = table(spark, d, "nation").select(n.cast("int").alias("line"), F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners]).alias("points"))
    cells = zonal.centre_cells(triangles(spark, d), SPEC, ["basin_id"]).withColumnRenamed("basin_id", "label")
    return rounded(zonal.line_crossings(cells, lines, SPEC), 5)


@reg.add("sl01_sorted", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders")
def sl01(spark, d):
    """Places in an order of several keys, up and down."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return index.numbered(o, F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey"), name="place").select("o_orderkey", "place")


@reg.add("sl05_first_match", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 ORDER BY o_orderdate, o_orderkey LIMIT 1")
def sl05(spark, d):
    return index.first_match(table(spark, d, "orders"), F.col("o_totalprice") > 200000, "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@reg.add("ag02_missing_stays_missing", "SELECT l_orderkey, round(sum(CASE WHEN l_tax > 0.06 THEN l_quantity END), 4) AS total, count(CASE WHEN l_tax > 0.06 THEN l_quantity END) AS n FROM lineitem GROUP BY l_orderkey")
def ag02(spark, d):
    """Sums of groups, missing where all of their values are."""
    return rounded(table(spark, d, "lineitem").withColumn("v", F.when(F.col("l_tax") > 0.06, F.col("l_quantity"))).groupBy("l_orderkey").agg(F.sum("v").alias("total"), F.count("v").alias("n")))


@reg.add("wn03_trailing_minimum", f"WITH {DAILY} SELECT user_id, day, round(avg(CASE WHEN n % 4 <> 1 THEN rain - 5 END) OVER (PARTITION BY user_id ORDER BY n RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS tmin_7 FROM da WHERE n % 5 <> 3")
def wn03(spark, d):
    """Mean minimum temperature of seven days, by date: days without a row or a value are left out, the window stays seven days."""
    t = daily(spark, d).where("n % 5 <> 3").withColumn("tmin", F.when(F.col("n") % 4 != 1, F.col("rain") - 5))
    return rounded(t.select("user_id", "day", moisture.trailing_mean("tmin", 7, "user_id", "day").alias("tmin_7")))


@reg.add("sc12_strict_classes", f"WITH {SPECIES_SQL}, {_LAYERS}, {_TERMS}, {_SCORED} SELECT species, CASE WHEN canopy AND score IS NULL THEN NULL ELSE class END AS class, count(*) AS n FROM li GROUP BY ALL")
def sc12(spark, d):
    """Classes of the strict rule: a missing score on canopy has none."""
    return score.score_species(scored_cells(spark, d), score.species_table(spark), strict=True).groupBy("species", "class").agg(F.count("*").alias("n"))
