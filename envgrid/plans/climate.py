"""Queries over time and scores: trailing windows, the soil fold, seasons, suitability, conversions, formats, classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from envgrid.functions import codes, geo, scalars
from envgrid.operators import moisture, score
from envgrid.plans.views import DAILY, EVENTS, Registry, daily, events, rounded, table
from envgrid.sources import io

reg = Registry()

_VALUES = ", ".join("(" + ", ".join("NULL::DOUBLE" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in row) + ")" for row in codes.SPECIES)
SPECIES_SQL = f"sp AS (SELECT * FROM (VALUES {_VALUES}) t(species, host_kind, oak_lo, oak_hi, a, b, c, d, none_at, full_at, win, sm_lo, sm_hi, rain_lo, rain_hi, lag_days))"


_W = "OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@reg.add("wn01_trailing_windows", f"WITH {DAILY} SELECT user_id, day, round(sum(rain) {_W.format(6)}, 3) AS rain_7, round(sum(rain) {_W.format(20)}, 3) AS rain_21, round(avg(CASE WHEN rain > 0 THEN rain END) {_W.format(6)}, 4) AS wet_mean_7 FROM da")
def wn01(spark, d):
    t = daily(spark, d).withColumn("wet", F.when(F.col("rain") > 0, F.col("rain")))
    return t.select("user_id", "day", *[F.round(moisture.trailing_sum("rain", w, "user_id", "day"), 3).alias(f"rain_{w}") for w in (7, 21)], F.round(moisture.trailing_mean("wet", 7, "user_id", "day"), 4).alias("wet_mean_7"))


@reg.add("wn04_days_since", f"WITH {DAILY} SELECT user_id, day, n - max(CASE WHEN rain >= 12.7 AND n >= 5 THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS since_soak, n - max(CASE WHEN rain <= 0 THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS since_frost FROM da")
def wn04(spark, d):
    t = daily(spark, d)
    return t.select("user_id", "day", moisture.days_since((F.col("rain") >= 12.7) & (F.col("n") >= 5), "n", "user_id").alias("since_soak"), moisture.days_since(F.col("rain") <= 0, "n", "user_id").alias("since_frost"))


@reg.add("wn07_soil_fold", f"""WITH RECURSIVE {DAILY}, c AS (SELECT unnest([30.0::DOUBLE, 80.0::DOUBLE]) AS cap), f AS (SELECT user_id, cap, -1 AS n, 0.5::DOUBLE * cap AS s, TRUE AS armed, CAST(NULL AS INTEGER) AS wet, CAST(NULL AS INTEGER) AS soak FROM (SELECT DISTINCT user_id FROM da), c
 UNION ALL SELECT f.user_id, f.cap, d.n, greatest(least(f.s + 0.85::DOUBLE * d.rain, f.cap) - 3.0::DOUBLE * least(f.s + 0.85::DOUBLE * d.rain, f.cap) / f.cap, 0), CASE WHEN d.rain >= 12.7 AND (f.armed OR f.s / f.cap < 0.3) THEN FALSE ELSE f.armed OR f.s / f.cap < 0.3 END,
 CASE WHEN d.rain >= 12.7 AND (f.armed OR f.s / f.cap < 0.3) THEN d.n ELSE f.wet END, CASE WHEN d.rain >= 12.7 AND d.n >= 5 THEN d.n ELSE f.soak END FROM f JOIN da d ON d.user_id = f.user_id AND d.n = f.n + 1)
 SELECT user_id, CAST(cap AS DOUBLE) AS cap, round(CAST(s / cap AS DOUBLE), 7) AS sm, CAST(29 - wet AS INTEGER) AS days_since_wetup, CAST(29 - soak AS INTEGER) AS days_since_soak, round((SELECT avg(CAST(g.s / g.cap AS DOUBLE)) FROM f g WHERE g.user_id = f.user_id AND g.cap = f.cap AND g.n > 22), 7) AS mean_7 FROM f WHERE n = 29""")
def wn07(spark, d):
    forcing = daily(spark, d).select("user_id", "n", F.col("rain").alias("p"), F.lit(3.0).alias("pet"))
    caps = forcing.select("user_id").distinct().withColumn("cap", F.explode(F.array(F.lit(30.0), F.lit(80.0))))
    out = moisture.soil_state(forcing, caps, ["user_id"], spin_up=5)
    return out.select("user_id", "cap", F.round("sm", 7).alias("sm"), "days_since_wetup", "days_since_soak", F.round("mean_7", 7).alias("mean_7"))


@reg.add("ag03_complete_days", f"WITH {EVENTS}, x AS (SELECT CAST(ts AS DATE) AS day, station AS i, CASE WHEN value > 5 THEN value END AS v FROM ev), g AS (SELECT day, i, coalesce(sum(v), 0) AS total, count(v) AS n FROM x GROUP BY ALL) SELECT day, i, round(total, 4) AS total, n FROM g WHERE day IN (SELECT day FROM g GROUP BY day HAVING max(n) >= 24)")
def ag03(spark, d):
    x = events(spark, d).select(F.to_date("ts").alias("day"), F.col("station").alias("i"), F.when(F.col("value") > 5, F.col("value")).alias("value"))
    return rounded(moisture.complete_day_totals(x, 24, ["i"]))


@reg.add("ag04_complete_extremes", f"WITH {EVENTS}, g AS (SELECT CAST(ts AS DATE) AS day, station AS i, max(value) AS hi, min(value) AS lo, count(value) AS n FROM ev GROUP BY ALL), f AS (SELECT day FROM g GROUP BY day HAVING min(n) >= 2), c AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day) SELECT c.day, g.i, CASE WHEN f.day IS NOT NULL THEN hi END AS hi, CASE WHEN f.day IS NOT NULL THEN lo END AS lo FROM c LEFT JOIN g ON c.day = g.day LEFT JOIN f ON c.day = f.day")
def ag04(spark, d):
    x = events(spark, d).select(F.to_date("ts").alias("day"), F.col("station").alias("i"), "value")
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-02-02')) AS day")
    return moisture.complete_day_extremes(x, days, 2, ["i"])


_RA = f"24 * 60 * 0.0820 / pi() * (1 + 0.033 * cos(2 * pi() * doy / 365)) * (acos(-tan(radians(41.7)) * tan(0.409 * sin(2 * pi() * doy / 365 - 1.39))) * sin(radians(41.7)) * sin(0.409 * sin(2 * pi() * doy / 365 - 1.39)) + cos(radians(41.7)) * cos(0.409 * sin(2 * pi() * doy / 365 - 1.39)) * sin(acos(-tan(radians(41.7)) * tan(0.409 * sin(2 * pi() * doy / 365 - 1.39)))))"


@reg.add("sc06_pet", f"WITH t AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus AS cell, dayofyear(o_orderdate) AS doy, max(o_totalprice) / 15000 AS hi, CASE WHEN count(*) > 1 THEN min(o_totalprice) / 15000 END AS lo FROM orders GROUP BY ALL), w AS (SELECT day, bool_and(hi IS NOT NULL AND lo IS NOT NULL) AS whole FROM t GROUP BY day) SELECT t.day, cell, round(CASE WHEN whole THEN greatest(0.0023 * 0.408 * {_RA} * ((hi + lo) / 2 + 17.8) * sqrt(hi - lo), 0) ELSE 2.35 + 2.05 * cos(2 * pi() * (doy - 196) / 365.25) END, 4) AS pet FROM t JOIN w ON t.day = w.day")
def sc06(spark, d):
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("cell"))
    t = o.agg((F.max("o_totalprice") / 15000).alias("hi"), F.when(F.count("*") > 1, F.min("o_totalprice") / 15000).alias("lo"))
    doy = F.dayofyear("day")
    return moisture.pet_with_fallback(t, scalars.hargreaves(F.col("hi"), F.col("lo"), doy), scalars.pet_climatology(doy)).select("day", "cell", F.round("pet", 4).alias("pet"))


_SEASON = "CASE WHEN doy <= a OR doy >= d THEN 0.0 WHEN doy < b THEN (doy - a) * 1.0 / (b - a) WHEN doy <= c THEN 1.0 ELSE (d - doy) * 1.0 / (d - c) END"
_PHASE = "CASE WHEN doy <= a OR doy >= d THEN 'out of season' WHEN doy < b THEN 'season just starting' WHEN doy <= c THEN 'in season' ELSE 'season winding down' END"


@reg.add("sc02_season", f"WITH {SPECIES_SQL}, o AS (SELECT dayofyear(o_orderdate) AS doy, count(*) AS n FROM orders GROUP BY 1) SELECT species, CAST(doy AS INTEGER) AS doy, n, round(CAST({_SEASON} AS DOUBLE), 5) AS season, {_PHASE} AS phase FROM o, sp")
def sc02(spark, d):
    o = table(spark, d, "orders").groupBy(F.dayofyear("o_orderdate").alias("doy")).agg(F.count("*").alias("n"))
    s = [F.col(c) for c in "abcd"]
    return o.crossJoin(F.broadcast(score.species_table(spark))).select("species", "doy", "n", F.round(scalars.season_score(F.col("doy"), *s), 5).alias("season"), scalars.season_phase(F.col("doy"), *s).alias("phase"))


_LAYERS = """l AS (SELECT o_orderkey AS cell, max(l_discount) * 4 AS oak, CASE WHEN count(*) > 1 THEN least(1, min(l_tax) * 8) END AS nonhost, max(l_tax) * 10 AS evergreen, min(l_quantity) / 50 AS sm_14, avg(l_quantity) / 50 AS sm_21, max(l_quantity) AS rain_14,
 CASE WHEN o_orderkey % 13 > 0 THEN sum(l_quantity) END AS rain_21, CASE WHEN count(*) > 2 THEN CAST(o_orderkey % 12 AS INTEGER) END AS wetup, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 23 END AS tmin7,
 CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 60 AS INTEGER) END AS frost, o_orderkey % 3 > 0 AS canopy, 278 AS doy FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""
_RAMP = "CASE WHEN {x} IS NOT NULL THEN greatest(0::DOUBLE, least(1::DOUBLE, ({x} - {lo}) / ({hi} - {lo}))) END"
_OAK = f"({_RAMP.format(x='oak', lo='oak_lo', hi='oak_hi')}) * (1 - coalesce(nonhost, 0))"
_CONIFER = f"CASE WHEN nonhost IS NOT NULL THEN {_RAMP.format(x='evergreen', lo='0.3::DOUBLE', hi='0.7::DOUBLE')} ELSE 1 - ({_RAMP.format(x='oak', lo='0.04::DOUBLE', hi='0.22::DOUBLE')}) END"
_TERMS = f"""w AS (SELECT *, CASE WHEN win = 14 THEN sm_14 ELSE sm_21 END AS sm, CASE WHEN win = 14 THEN rain_14 ELSE rain_21 END AS rain, coalesce(wetup, 9999) AS wet FROM l, sp), t AS (SELECT species, cell, canopy, CASE WHEN host_kind = 'oak_or_conifer' THEN greatest({_OAK}, {_CONIFER}) ELSE {_OAK} END AS host,
 least(CASE WHEN coalesce(frost, 9999) <= doy - 244 THEN 0.0 ELSE {_SEASON} END, CASE WHEN none_at IS NULL OR tmin7 IS NULL THEN 1.0 ELSE greatest(0, least(1, (none_at - tmin7) / (none_at - full_at))) END) AS season,
 CASE WHEN sm IS NOT NULL AND rain IS NOT NULL THEN least({_RAMP.format(x="sm", lo="sm_lo", hi="sm_hi")}, {_RAMP.format(x="rain", lo="rain_lo", hi="rain_hi")}) END AS sustained, {_RAMP.format(x="wet", lo="0::DOUBLE", hi="lag_days")} AS lag FROM w)"""
_LEAST = "least(host, season, sustained, lag)"
_SCORED = f"""s AS (SELECT *, CASE WHEN host IS NULL OR season IS NULL OR sustained IS NULL OR lag IS NULL OR NOT canopy THEN NULL ELSE {_LEAST} END AS score FROM t), k AS (SELECT *, CASE WHEN NOT canopy THEN 0 WHEN score >= 0.6 THEN 3 WHEN score >= 0.35 THEN 2 ELSE 1 END AS class FROM s),
 li AS (SELECT *, CASE WHEN class IN (1, 2) THEN CASE WHEN host IS NULL THEN 1 WHEN season IS NULL THEN 2 WHEN sustained IS NULL THEN 3 WHEN lag IS NULL THEN 4 WHEN host = {_LEAST} THEN 1 WHEN season = {_LEAST} THEN 2 WHEN sustained = {_LEAST} THEN 3 ELSE 4 END ELSE 0 END AS limiter FROM k)"""


def scored_cells(spark, d):
    """The layers of each cell (an order)."""
    o, li = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey", "l_discount", "l_tax", "l_quantity")
    key, many = F.col("o_orderkey"), F.count("*")
    la = o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_orderkey").agg(
        (F.max("l_discount") * 4).alias("oak"), F.when(many > 1, F.least(F.lit(1.0), F.min("l_tax") * 8)).alias("nonhost"), (F.max("l_tax") * 10).alias("evergreen"), (F.min("l_quantity") / 50).alias("sm_14"), (F.avg("l_quantity") / 50).alias("sm_21"),
        F.max("l_quantity").alias("rain_14"), F.sum("l_quantity").alias("rain"), many.alias("n"),
    )
    return la.select(
        key.alias("cell"), "oak", "nonhost", "evergreen", "sm_14", "sm_21", "rain_14", F.when(key % 13 > 0, F.col("rain")).alias("rain_21"), F.when(F.col("n") > 2, key % 12).alias("wetup"), F.when(key % 11 > 0, key % 23).alias("tmin7"),
        F.when(key % 7 == 0, key % 60).alias("frost"), (key % 3 > 0).alias("canopy"), F.lit(278).alias("doy"),
    )


def scored(spark, d):
    """Score, class and limiting term of each cell and species."""
    return score.score_species(scored_cells(spark, d), score.species_table(spark))


@reg.add("pl13_score_species", f"WITH {SPECIES_SQL}, {_LAYERS}, {_TERMS}, {_SCORED} SELECT species, cell, round(CAST(score AS DOUBLE), 7) AS score, class, limiter FROM li")
def pl13(spark, d):
    return scored(spark, d).select("species", "cell", F.round("score", 7).alias("score"), "class", "limiter")


@reg.add("ag30_class_areas", f"WITH {SPECIES_SQL}, {_LAYERS}, {_TERMS}, {_SCORED} SELECT species, round(sum(CASE WHEN class = 3 THEN 0.0009 ELSE 0 END), 6) AS good, round(sum(CASE WHEN class = 2 THEN 0.0009 ELSE 0 END), 6) AS fair, round(sum(CASE WHEN class = 1 THEN 0.0009 ELSE 0 END), 6) AS poor, round(100.0 * sum(CASE WHEN limiter = 3 THEN 1 ELSE 0 END) / sum(CASE WHEN canopy THEN 1 ELSE 0 END), 4) AS pct_dry FROM li GROUP BY species")
def ag30(spark, d):
    area = lambda k: F.round(F.sum(F.when(F.col("class") == k, 1).otherwise(0)) * 0.0009, 6)
    return scored(spark, d).groupBy("species").agg(area(3).alias("good"), area(2).alias("fair"), area(1).alias("poor"), F.round(100 * F.sum(F.when(F.col("limiter") == 3, 1).otherwise(0)) / F.sum(F.when(F.col("canopy"), 1).otherwise(0)), 4).alias("pct_dry"))


@reg.add("sc04_phase_now", f"WITH {SPECIES_SQL}, {_LAYERS}, f AS (SELECT avg(CASE WHEN frost IS NULL THEN 1.0 ELSE 0.0 END) AS frac, median(tmin7) AS t FROM l) SELECT species, CASE WHEN {_PHASE} = 'out of season' THEN {_PHASE} WHEN frac < 0.5 THEN 'season ended by frost' WHEN full_at IS NOT NULL AND t > full_at THEN 'waiting for cooler nights (7-day mean low ' || CAST(CAST(round(t) AS INTEGER) AS VARCHAR) || ' C, full credit at ' || CAST(CAST(full_at AS INTEGER) AS VARCHAR) || ' C)' ELSE {_PHASE} END AS phase FROM f, (SELECT *, 260 AS doy FROM sp)")
def sc04(spark, d):
    key = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey")
    f = o.agg(F.avg(F.when(key % 7 == 0, 0.0).otherwise(1.0)).alias("frac"), F.median(F.when(key % 11 > 0, key % 23)).alias("t"))
    s = score.species_table(spark).crossJoin(F.broadcast(f))
    phase = scalars.season_phase(F.lit(260), *[F.col(c) for c in "abcd"])
    return s.select("species", scalars.phase_now(phase, F.col("frac"), F.col("t"), F.col("full_at")).alias("phase"))


@reg.add("sc17_quantise", "WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.01 THEN l_discount END AS v FROM lineitem), r AS (SELECT *, CASE WHEN v IS NOT NULL THEN greatest(0, least(1, v / 0.1)) END AS r FROM x) SELECT l_orderkey, l_linenumber, CAST(coalesce(1 + round_even(254 * r, 0), 0) AS INTEGER) AS twin, CAST(coalesce(round_even(255 * r, 0), 0) AS INTEGER) AS map, CAST(coalesce(1 + round_even(r * 7, 0), 0) AS INTEGER) AS palette FROM r")
def sc17(spark, d):
    v = F.when(F.col("l_tax") > 0.01, F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.twin_byte(v, 0.0, 0.1).alias("twin"), scalars.map_byte(v, 0.0, 0.1).alias("map"), scalars.palette_index(v, 0.0, 0.1, 8).alias("palette"))


@reg.add("pf09_conversions", "SELECT event_id, round(value * 3600, 3) AS mm_h, round(value / 25.4, 7) AS inch, round(CASE WHEN event_type IN ('click', 'view') THEN value * 3600 ELSE value END, 3) AS by_unit, round(greatest(coalesce(CASE WHEN user_id % 2 = 0 THEN value * 10 END, value * 10 * 0.3), 8), 4) AS capacity, round(value / 1000 * 9e6 / (24 * 3600), 8) AS flux FROM events")
def pf09(spark, d):
    v = F.col("value")
    unit = F.when(F.col("event_type").isin("click", "view"), "mm/s").otherwise("mm")
    return table(spark, d, "events").select(
        "event_id", F.round(scalars.rate_to_mm(v, 3600), 3).alias("mm_h"), F.round(scalars.mm_to_in(v), 7).alias("inch"), F.round(scalars.depth_in(v, unit), 3).alias("by_unit"),
        F.round(scalars.capacity_mm(v, F.when(F.col("user_id") % 2 == 0, v)), 4).alias("capacity"), F.round(scalars.flux_m3s(scalars.volume_m3(v, F.lit(9e6)), F.lit(24)), 8).alias("flux"),
    )


@reg.add("pf10_name_patterns", "SELECT p_partkey FROM part WHERE p_type LIKE '%BRASS%' OR p_name LIKE 'a%' OR p_brand LIKE 'Brand#1_' OR p_type = 'STEEL'")
def pf10(spark, d):
    p = table(spark, d, "part")
    return p.where(scalars.like_any(F.col("p_type"), ["%BRASS%", "STEEL"]) | F.col("p_name").like("a%") | F.col("p_brand").like("Brand#1_")).select("p_partkey")


@reg.add("pf11_code_labels", "SELECT CASE l_linenumber WHEN 1 THEN 'well drained' WHEN 2 THEN 'hydric' ELSE concat('unmapped ', l_linenumber) END AS label, count(*) AS n FROM lineitem GROUP BY 1")
def pf11(spark, d):
    return table(spark, d, "lineitem").groupBy(scalars.code_label(F.col("l_linenumber"), {1: "well drained", 2: "hydric"}).alias("label")).agg(F.count("*").alias("n"))


@reg.add("pf17_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 0) AS eighths FROM lineitem")
def pf17(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.round_even(F.col("l_quantity") / 8, 0).alias("eighths"))


@reg.add("pf18_numbers_and_json", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%m%d') AS mmdd, substr(event_type, 1, 3) AS prefix FROM events")
def pf18(spark, d):
    e = table(spark, d, "events").withColumn("t", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string")))
    return e.select("event_id", io.numeric("t").alias("number"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.date_format("ts", "MMdd").alias("mmdd"), F.substring("event_type", 1, 3).alias("prefix"))


@reg.add("pf22_land_code", "SELECT CASE WHEN c_nationkey < 20 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END ELSE 0 END AS code, count(*) AS n FROM customer GROUP BY 1")
def pf22(spark, d):
    return table(spark, d, "customer").groupBy(scalars.land_code(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") < 20).alias("code")).agg(F.count("*").alias("n"))


@reg.add("sc16_projections", "WITH p AS (SELECT c_custkey AS id, -71.5 + c_custkey % 200 / 100.0 AS lon, 41.0 + c_custkey % 170 / 100.0 AS lat FROM customer) SELECT id, round(radians(lon) * 6378137, 3) AS mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS my FROM p")
def sc16(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (-71.5 + F.col("c_custkey") % 200 / 100.0).alias("lon"), (41.0 + F.col("c_custkey") % 170 / 100.0).alias("lat"))
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    return p.select("id", F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"))


@reg.add("sc24_blocks", "SELECT CAST(floor(o_totalprice / 5000) * 100000 + floor(o_custkey * 91 / 5000.0) AS BIGINT) AS block, count(*) AS n FROM orders GROUP BY 1")
def sc24(spark, d):
    return table(spark, d, "orders").groupBy(scalars.block_id(F.col("o_totalprice"), F.col("o_custkey") * 91).alias("block")).agg(F.count("*").alias("n"))


@reg.add("sc23_valid_embeddings", "SELECT label, count(*) AS n FROM embeddings WHERE isfinite(embedding[1]) AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY label")
def sc23(spark, d):
    return table(spark, d, "embeddings").where(scalars.embedding_valid(F.col("embedding"))).groupBy("label").agg(F.count("*").alias("n"))


@reg.add("io05_roster_round_trip", "SELECT concat('S', s_suppkey) AS \"stationNumber\", s_suppkey AS \"stationId\", s_name AS \"stationName\", s_acctbal AS latitude, -s_acctbal AS longitude FROM supplier")
def io05(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("stationNumber"), F.col("s_suppkey").alias("stationId"), F.col("s_name").alias("stationName"), F.col("s_acctbal").alias("latitude"), (-F.col("s_acctbal")).alias("longitude"))
    return io.roster(io.roster_json(s))


@reg.add("io11_header_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS mukey, round(o_totalprice, 2) AS area, CAST(NULL AS DOUBLE) AS name_as_number FROM orders")
def io11(spark, d):
    o = table(spark, d, "orders").select(F.to_json(F.array(F.array(F.lit("muname"), F.lit("mukey"), F.lit("area")), F.array("o_orderpriority", F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")))).alias("value"))
    rows = io.header_rows(o, ["mukey", "area", "muname"])
    return rows.select("mukey", F.round(io.numeric("area"), 2).alias("area"), io.numeric("muname").alias("name_as_number"))


@reg.add("io12_pages", "SELECT CAST(user_id AS VARCHAR) AS request, count(*) AS n_rows, count(*) + CAST(user_id % 2 AS BIGINT) AS n_expected, user_id % 2 = 0 AS complete FROM events GROUP BY user_id")
def io12(spark, d):
    e = table(spark, d, "events")
    r = F.struct(F.col("event_type").alias("stationNumber"), F.col("event_type").alias("stationName"), F.col("event_id").alias("stationId"), F.col("value").alias("latitude"), F.col("value").alias("longitude"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("obsDateTime"), F.col("value").alias("precip"))
    pages = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list(r).alias("results"))
    total = e.groupBy("user_id").agg((F.count("*") + F.max(F.col("user_id") % 2)).alias("total"))
    landed = pages.join(total, "user_id").select(F.col("user_id").cast("string").alias("request"), F.to_json(F.struct("results", F.struct(F.struct(F.col("total").alias("totalCount")).alias("resultset")).alias("metadata"))).alias("value"))
    return io.page_completeness(landed)


@reg.add("io19_summary_json", "SELECT concat('{\"station\":', station, ',\"n\":', count(*), '}') AS value FROM (SELECT user_id % 16 AS station FROM events) GROUP BY station")
def io19(spark, d):
    return io.summary_json(events(spark, d).groupBy("station").agg(F.count("*").alias("n")))
