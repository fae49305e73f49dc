"""Verification queries: products against gauges."""

from __future__ import annotations

from pyspark.sql import functions as F

from envgrid.functions.timebuckets import RULES, expected_hours, hourly_stamps, report_day
from envgrid.operators import verify
from envgrid.operators.grid import GridSpec
from envgrid.plans.views import EVENTS, HOURLY, Registry, events, hourly, rounded, table, wall7

reg = Registry()
PEARSON = "covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
PAIRS = (
    f"WITH {EVENTS}, g AS (SELECT station, {wall7('ts')} AS day, sum(value) AS obs FROM ev WHERE source = 'gauge' GROUP BY ALL), p AS (SELECT station, {wall7('ts')} AS day, sum(value) AS est FROM ev WHERE source = 'product' GROUP BY ALL), "
    "pr AS (SELECT g.station, g.day, obs, est FROM g JOIN p ON g.station = p.station AND g.day = p.day)"
)


def pairs(spark, d):
    """Gauge and product sums by station and report date."""
    e = events(spark, d).withColumn("day", report_day("ts", "wall7_left"))
    g = verify.daily_sums(e.where("source = 'gauge'"), ["station", "day"], "value", "obs").drop("n_values")
    p = verify.daily_sums(e.where("source = 'product'"), ["station", "day"], "value", "est").drop("n_values")
    return g.join(p, ["station", "day"])


BIAS = f"count(*) AS n_days, round({PEARSON.format(a='obs', b='est')}, 4) AS corr, round(sum(obs), 4) AS obs_total, round(sum(est), 4) AS est_total, round(avg(est - obs), 4) AS mean_bias, round(sum(est) - sum(obs), 4) AS bias, round(100 * (sum(est) - sum(obs)) / sum(obs), 4) AS pct_bias"


@reg.add("pl01_verify_product", f"{PAIRS} SELECT station, {BIAS} FROM pr GROUP BY station")
def pl01(spark, d):
    return rounded(verify.station_summary(pairs(spark, d), "obs", "est"))


@reg.add("ag07_pooled_positive", f"{PAIRS} SELECT {BIAS} FROM pr WHERE obs > 0")
def ag07(spark, d):
    return rounded(pairs(spark, d).where("obs > 0").agg(*verify.bias_columns("obs", "est")))


_DAYS = {"utc_day": "CAST(ts AS DATE)", "abs7": "CAST(timezone('America/New_York', timezone('UTC', ts - INTERVAL 7 HOUR)) AS DATE) + 1", "wall7_left": wall7("ts"), "wall7_right": wall7("ts - INTERVAL 1 MICROSECOND"), "utc12_right": "CAST(ts - INTERVAL 12 HOUR - INTERVAL 1 MICROSECOND AS DATE) + 1"}


@reg.add("sc14_report_days", f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT '{r}' AS rule, {x} AS day, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time AS ts, value FROM ev) GROUP BY ALL" for r, x in _DAYS.items()))
def sc14(spark, d):
    e = events(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), report_day("time", r).alias("day")) for r in RULES])).alias("x")
    return rounded(e.select("value", each).groupBy("x.rule", "x.day").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@reg.add("ag01_hours_by_day", f"WITH {EVENTS}, h AS (SELECT station, time, sum(value) AS v FROM ev GROUP BY ALL) SELECT station, {wall7('time - INTERVAL 1 MICROSECOND')} AS day, round(sum(v), 4) AS total, count(v) AS n_values FROM h GROUP BY ALL")
def ag01(spark, d):
    h = events(spark, d).groupBy("station", "time").agg(F.sum("value").alias("v"))
    return rounded(verify.daily_sums(h.withColumn("day", report_day("time", "wall7_right")), ["station", "day"], "v", "total"))


@reg.add("ag35_short_days", f"WITH {EVENTS}, h AS (SELECT DISTINCT station, time FROM ev), c AS (SELECT station, {wall7('time - INTERVAL 1 MICROSECOND')} AS day, count(*) AS n FROM h GROUP BY ALL) SELECT n AS n_hours, count(*) AS n_groups, CAST(sum(CASE WHEN n < 23 THEN 1 ELSE 0 END) AS BIGINT) AS n_short FROM c GROUP BY n")
def ag35(spark, d):
    h = events(spark, d).select("station", "time", F.lit(1).alias("v")).distinct().withColumn("day", report_day("time", "wall7_right"))
    return verify.hours_histogram(h, ["station", "day"], "v").withColumn("n_short", F.when(F.col("n_hours") < 23, F.col("n_groups")).otherwise(0).cast("bigint"))


@reg.add("jn06_missing_stamps", f"""WITH {EVENTS}, have AS (SELECT DISTINCT time AS stamp FROM ev WHERE kind = 'click'), days AS (SELECT DISTINCT {wall7('time - INTERVAL 1 MICROSECOND')} AS day FROM ev),
 ex AS (SELECT day, unnest(generate_series(CAST(day - 1 AS TIMESTAMP) + INTERVAL 13 HOUR, CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR, INTERVAL 1 HOUR)) AS stamp FROM days)
 SELECT day, count(*) AS n_expected, CAST(sum(CASE WHEN have.stamp IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM ex LEFT JOIN have ON ex.stamp = have.stamp GROUP BY day""")
def jn06(spark, d):
    e = events(spark, d)
    days = e.select(report_day("time", "wall7_right").alias("day")).distinct()
    return verify.missing_stamps(days.select("day", F.explode(hourly_stamps(F.col("day"))).alias("stamp")), e.where("kind = 'click'").select(F.col("time").alias("stamp")))


@reg.add("sc15_expected_hours", f"WITH {EVENTS} SELECT {wall7('ts')} AS day, CAST(24 AS INTEGER) AS n_hours, count(*) AS n FROM ev GROUP BY ALL")
def sc15(spark, d):
    return events(spark, d).groupBy(report_day("ts", "wall7_left").alias("day")).agg(F.count("*").alias("n")).select("day", expected_hours(F.col("day")).alias("n_hours"), "n")


_LEADS = PAIRS.replace("SELECT station, ", "SELECT station, half + 1 AS lead, ").replace("SELECT g.station, g.day", "SELECT g.station, g.lead, g.day").replace("g.station = p.station", "g.station = p.station AND g.lead = p.lead")
_CELLS = f"c AS (SELECT lead, CASE WHEN grouping(station) = 1 THEN 'ALL' ELSE CAST(station AS VARCHAR) END AS who, count(*) AS n, round({PEARSON.format(a='obs', b='est')}, 4) AS r, round(avg(est - obs), 4) AS b FROM pr GROUP BY GROUPING SETS ((lead), (lead, station)))"


@reg.add("ag10_lead_summary", f"""{_LEADS}, {_CELLS}, w AS (SELECT who, max(CASE WHEN lead = 1 THEN n END) AS n1, max(CASE WHEN lead = 1 THEN r END) AS r_lead1, max(CASE WHEN lead = 1 THEN b END) AS bias_lead1, max(CASE WHEN lead = 2 THEN n END) AS n2, max(CASE WHEN lead = 2 THEN r END) AS r_lead2, max(CASE WHEN lead = 2 THEN b END) AS bias_lead2 FROM c GROUP BY who),
 s AS (SELECT CAST(unnest(range(20)) AS VARCHAR) AS who UNION ALL SELECT 'ALL') SELECT s.who, coalesce(n1, 0) AS n_lead1, r_lead1, bias_lead1, coalesce(n2, 0) AS n_lead2, r_lead2, bias_lead2 FROM s LEFT JOIN w ON s.who = w.who""")
def ag10(spark, d):
    e = events(spark, d).withColumn("day", report_day("ts", "wall7_left")).withColumn("lead", F.col("half") + 1)
    g, p = (e.where(F.col("source") == s).groupBy("station", "lead", "day").agg(F.sum("value").alias(n)) for s, n in (("gauge", "obs"), ("product", "est")))
    return rounded(verify.lead_summary(g.join(p, ["station", "lead", "day"]), spark.range(20).select(F.col("id").alias("station")), [1, 2]))


@reg.add("pl04_three_sources", f"""WITH {EVENTS}, a AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS v FROM ev WHERE kind = 'click' GROUP BY ALL), b AS (SELECT CAST(ts AS DATE) AS day, max(value) AS v FROM ev WHERE kind = 'view' AND value <= 150 AND day(ts) > 3 GROUP BY ALL), c AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS v FROM ev WHERE kind = 'purchase' AND day(ts) < 25 GROUP BY ALL)
 SELECT coalesce(a.day, b.day, c.day) AS day, round(a.v, 4) AS aorc, round(b.v, 4) AS gauge, round(c.v, 4) AS imerg FROM a FULL JOIN b ON a.day = b.day FULL JOIN c ON coalesce(a.day, b.day) = c.day""")
def pl04(spark, d):
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    gauge = e.where("kind = 'view' AND value <= 150 AND day(ts) > 3").groupBy("day").agg(F.max("value").alias("value"))
    aorc, imerg = (e.where(f"kind = '{k}' AND day(ts) < {m}").groupBy("day").agg(F.sum("value").alias("value")) for k, m in (("click", 40), ("purchase", 25)))
    return rounded(verify.full_outer_days([("aorc", aorc), ("gauge", gauge), ("imerg", imerg)]))


_THREE = reg.oracles["pl04_three_sources"]


@reg.add("pl04_source_correlations", " UNION ALL ".join(f"SELECT '{a}' AS one, '{b}' AS two, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, round({PEARSON.format(a=f'CASE WHEN {b} IS NOT NULL THEN {a} END', b=f'CASE WHEN {a} IS NOT NULL THEN {b} END')}, 3) AS r FROM ({_THREE})" for a, b in (("aorc", "gauge"), ("aorc", "imerg"), ("gauge", "imerg"))))
def pl04c(spark, d):
    """How the three daily series go together, over the days that two have."""
    return rounded(verify.pairwise(pl04(spark, d), ["aorc", "gauge", "imerg"]), 3)


@reg.add("pl03_day_against_grid", f"""WITH {EVENTS}, {HOURLY}, g AS (SELECT station, station * 3.7 AS x, station * station % 60 + 0.3 AS y, sum(value) AS obs FROM ev WHERE source = 'gauge' AND {wall7('ts')} = DATE '2024-01-15' GROUP BY station), h AS (SELECT * FROM ho WHERE {wall7('time - INTERVAL 1 MICROSECOND')} = DATE '2024-01-15'),
 t AS (SELECT row, col, sum(value) AS est FROM h GROUP BY ALL), p AS (SELECT station, obs, est FROM g LEFT JOIN t ON row = CAST(floor((60 - y) / 5) AS INTEGER) AND col = CAST(floor(x / 5) AS INTEGER)), f AS (SELECT {PEARSON.format(a='CASE WHEN est IS NOT NULL THEN obs END', b='est')} AS r FROM p)
 SELECT station, round(obs, 4) AS obs, round(est, 4) AS est, round(est - obs, 4) AS diff, 24 - (SELECT count(DISTINCT time) FROM h) AS n_missing, round(r, 3) AS r FROM p, f""")
def pl03g(spark, d):
    """One report day of gauges against an hourly grid: nearest cells, missing hours, differences, correlation."""
    e = events(spark, d).where((F.col("source") == "gauge") & (report_day("ts", "wall7_left") == F.lit("2024-01-15").cast("date")))
    s = F.col("station")
    gauges = e.groupBy("station").agg(F.sum("value").alias("obs")).select("station", (s * 3.7).alias("x"), (s * s % 60 + 0.3).alias("y"), "obs")
    out = verify.day_against_grid(gauges, hourly(spark, d), GridSpec(0.0, 60.0, 5.0, 12, 12), "2024-01-15")
    return rounded(out.withColumn("r", F.round("r", 3)))


@reg.add("jn12_nearest_cycle", """WITH w AS (SELECT DISTINCT ts AS wanted FROM events WHERE event_type = 'view'), c AS (SELECT DISTINCT ts AS cycle FROM events WHERE event_type = 'purchase'),
 b AS (SELECT wanted, c.cycle AS lo FROM w ASOF LEFT JOIN c ON w.wanted >= c.cycle), a AS (SELECT wanted, c.cycle AS hi FROM w ASOF LEFT JOIN c ON w.wanted <= c.cycle)
 SELECT b.wanted, CASE WHEN hi IS NULL OR epoch_us(wanted) - epoch_us(lo) <= epoch_us(hi) - epoch_us(wanted) THEN lo ELSE hi END AS cycle, b.wanted <> CASE WHEN hi IS NULL OR epoch_us(wanted) - epoch_us(lo) <= epoch_us(hi) - epoch_us(wanted) THEN lo ELSE hi END AS substituted FROM b JOIN a USING (wanted)""")
def jn12(spark, d):
    e = table(spark, d, "events")
    return verify.nearest_cycle(e.where("event_type = 'view'").select(F.col("ts").alias("wanted")).distinct(), e.where("event_type = 'purchase'").select(F.col("ts").alias("cycle")).distinct())


@reg.add("pl03_observed_vs_grid", f"""WITH {EVENTS}, o AS (SELECT station, sum(value) AS obs FROM ev WHERE source = 'gauge' AND {wall7('ts')} = DATE '2024-01-15' GROUP BY station), p AS (SELECT station, sum(value) AS est FROM ev WHERE source = 'product' AND {wall7('ts')} = DATE '2024-01-15' GROUP BY station)
 SELECT o.station, round(obs, 4) AS obs_in, round(est, 4) AS grid_in, round(round(est, 4) - round(obs, 4), 4) AS diff_in, o.station IN (1, 3, 5) AS curated FROM o LEFT JOIN p ON o.station = p.station""")
def pl03(spark, d):
    e = events(spark, d).where(report_day("ts", "wall7_left") == F.lit("2024-01-15").cast("date"))
    o, p = (e.where(F.col("source") == s).groupBy("station").agg(F.round(F.sum("value"), 4).alias(n)) for s, n in (("gauge", "obs_in"), ("product", "grid_in")))
    return o.join(p, "station", "left").withColumn("diff_in", F.round(F.col("grid_in") - F.col("obs_in"), 4)).withColumn("curated", F.col("station").isin(1, 3, 5))


@reg.add("ag34_roster", f"WITH {EVENTS} SELECT station, count(*) AS n_reports, min_by(kind, event_id) AS first_kind, max(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-10' THEN 1 ELSE 0 END) = 1 AS has_0110 FROM ev GROUP BY station")
def ag34(spark, d):
    return events(spark, d).groupBy("station").agg(F.count("*").alias("n_reports"), F.min_by("kind", "event_id").alias("first_kind"), F.bool_or(F.to_date("ts") == F.lit("2024-01-10").cast("date")).alias("has_0110"))


@reg.add("jn08_day_lookup", f"WITH {EVENTS}, s AS (SELECT station, CAST(ts AS DATE) AS day, sum(value) AS v FROM ev GROUP BY ALL) SELECT n.n_nationkey AS station, round(a.v, 4) AS precip_0105, round(b.v, 4) AS precip_0106 FROM nation n LEFT JOIN s a ON a.station = n.n_nationkey AND a.day = DATE '2024-01-05' LEFT JOIN s b ON b.station = n.n_nationkey AND b.day = DATE '2024-01-06'")
def jn08(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("station"))
    s = events(spark, d).withColumn("k", F.concat(F.lit("precip_"), F.date_format("ts", "MMdd"))).where(F.col("k").isin("precip_0105", "precip_0106")).groupBy("station").pivot("k", ["precip_0105", "precip_0106"]).agg(F.sum("value"))
    return rounded(names.join(s, "station", "left"))
