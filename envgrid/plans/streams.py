"""The daily refresh as streams over the events: each query runs its stream to the end of what is there and reads back what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envgrid.operators import zonal
from envgrid.plans.fields import SERIES, basin_series
from envgrid.plans.formats import folder
from envgrid.plans.pipelines import BASIN_DAYS, COARSE
from envgrid.plans.views import DAILY, Registry, daily, hourly, rounded, table, triangles, wall7
from envgrid.sources import io, stages, versions
from envgrid.streaming import refresh

reg = Registry()


def event_stream(spark, d) -> DataFrame:
    """The events as a stream: station, ts, hour-ending time, kind."""
    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    return e.select((F.col("user_id") % 16).alias("station"), F.col("ts").cast("timestamp").alias("ts"), (F.date_trunc("hour", "ts") + F.expr("interval 1 hour")).alias("time"), F.col("event_type").alias("kind"), "value")


def drained(spark, stream: DataFrame, name: str, arrivals=(lambda: None,)) -> DataFrame:
    """What a stream has written when all of its input is read. Each of arrivals is called before a run that goes on where the last one ended."""
    path, key = folder(spark, name), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for arrive in arrivals:
            arrive()
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(path)


_HOURS = f"h AS (SELECT DISTINCT user_id % 16 AS station, date_trunc('hour', ts) + INTERVAL 1 HOUR AS time FROM events), w AS (SELECT station, time, {wall7('time - INTERVAL 1 MICROSECOND')} AS day FROM h), t AS (SELECT day, CAST(timezone('UTC', timezone('America/New_York', CAST(day AS TIMESTAMP) + INTERVAL 7 HOUR)) AS TIMESTAMP) AS window_end, station, CAST(sum(hour(time)) AS DOUBLE) AS total, count(*) AS n_hours FROM w GROUP BY ALL), e AS (SELECT max(window_end) - INTERVAL 2 DAY AS mark FROM t)"


@reg.add("sr01_report_day_totals", f"WITH {_HOURS} SELECT window_end, station, total, n_hours FROM t, e WHERE window_end <= mark")
def sr01(spark, d):
    """Totals of report days that the watermark has closed; an hour that comes twice counts once (here by its number)."""
    s = event_stream(spark, d).withColumn("value", F.hour("time").cast("double"))
    return drained(spark, refresh.report_day_totals(s, "station"), "days")


@reg.add("sr05_gap_alerts", f"WITH {_HOURS} SELECT day AS report_date, station, n_hours, CAST(24 AS INTEGER) AS expected FROM t, e WHERE window_end <= mark AND n_hours < 24")
def sr05(spark, d):
    s = event_stream(spark, d).withColumn("value", F.hour("time").cast("double"))
    return drained(spark, refresh.gap_alerts(refresh.report_day_totals(s, "station")).select("report_date", "station", "n_hours", "expected"), "gaps")


@reg.add("sr06_unique_reports", "SELECT DISTINCT user_id % 16 AS station, event_type AS kind, date_trunc('hour', ts) + INTERVAL 1 HOUR AS time FROM events")
def sr06(spark, d):
    return drained(spark, refresh.unique_reports(event_stream(spark, d).select("station", "kind", "time"), ["station", "kind", "time"], "time"), "unique")


@reg.add("sr04_trailing_totals", """WITH e AS (SELECT user_id % 16 AS station, ts, value FROM events), k AS (SELECT station, value, date_trunc('day', ts) - to_days(CAST(o AS INTEGER)) AS first FROM e, (SELECT unnest(range(21)) AS o)),
 t AS (SELECT CAST(first AS TIMESTAMP) AS first, station, sum(value) AS total FROM k GROUP BY ALL) SELECT first, station, round(total, 3) AS total FROM t WHERE first + INTERVAL 21 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM e)""")
def sr04(spark, d):
    """Sums of sliding windows of 21 days that the watermark has closed."""
    t = refresh.trailing_totals(event_stream(spark, d), "station", 21, "ts")
    return rounded(drained(spark, t.select(F.col("window.start").alias("first"), "station", "total"), "trailing"), 3)


@reg.add("sr03_soil_stream", f"""WITH RECURSIVE {DAILY}, f AS (SELECT user_id, -1 AS n, 20.0::DOUBLE AS s, TRUE AS armed, CAST(NULL AS INTEGER) AS wet FROM (SELECT DISTINCT user_id FROM da)
 UNION ALL SELECT f.user_id, d.n, greatest(least(f.s + 0.85::DOUBLE * d.rain, 40.0) - 3.0::DOUBLE * least(f.s + 0.85::DOUBLE * d.rain, 40.0) / 40.0, 0), CASE WHEN d.rain >= 12.7 AND (f.armed OR f.s / 40 < 0.3) THEN FALSE ELSE f.armed OR f.s / 40 < 0.3 END,
 CASE WHEN d.rain >= 12.7 AND (f.armed OR f.s / 40 < 0.3) THEN d.n ELSE f.wet END FROM f JOIN da d ON d.user_id = f.user_id AND d.n = f.n + 1)
 SELECT user_id AS cell, n, round(CAST(s AS DOUBLE), 6) AS s, armed, CAST(wet AS INTEGER) AS wet FROM f WHERE n >= 0""")
def sr03(spark, d):
    """Soil water and the wet-spell clock as state of each cell, its days coming from a table of daily rain."""
    path = folder(spark, "rain")
    rain = stages.stage(daily(spark, d).select(F.col("user_id").alias("cell"), F.col("n").cast("int").alias("n"), F.col("rain").alias("p"), F.lit(3.0).alias("pet"), F.lit(40.0).alias("cap")), "daily")
    # ten days after ten days, each dealt by cell: a cell is in one file of each, however many there are
    for first in (0, 10, 20):
        rain.where(F.col("n").between(first, first + 9)).repartition("cell").write.mode("append").parquet(path)
    stream = spark.readStream.schema(rain.schema).option("maxFilesPerTrigger", 4).parquet(path)
    return drained(spark, refresh.soil_stream(stream), "soil").select("cell", "n", F.round("s", 6).alias("s"), "armed", "wet")


_REVISED = f"WITH {SERIES}, old AS (SELECT report_date, basin_id, n_hours, round(mm, 4) AS mm FROM se), late AS (SELECT report_date, basin_id, n_hours + 1 AS n_hours, round(mm + 1, 4) AS mm FROM se WHERE report_date > (SELECT max(report_date) FROM se) - 2) SELECT * FROM old WHERE report_date NOT IN (SELECT report_date FROM late) UNION ALL SELECT * FROM late"


@reg.add("sr02_late_revision", _REVISED)
def sr02(spark, d):
    """The last two dates come again as a stream, whose batches replace them in the stored series."""
    path, later = folder(spark, "series"), folder(spark, "late")
    s = stages.stage(basin_series(spark, d).select("report_date", "basin_id", "n_hours", F.round("precip_mm", 4).alias("mm")), "series")
    io.write_series(s, path)
    end = F.broadcast(s.agg(F.max("report_date").alias("_end")))  # one row
    late = s.crossJoin(end).where(F.col("report_date") > F.date_sub("_end", 2)).select("report_date", "basin_id", (F.col("n_hours") + 1).alias("n_hours"), F.round(F.col("mm") + 1, 4).alias("mm"))
    late.write.parquet(later)
    stream = spark.readStream.schema(s.schema).parquet(later)
    stream.writeStream.foreachBatch(refresh.upsert_batches(path)).option("checkpointLocation", f"{later}-log").trigger(availableNow=True).start().awaitTermination()
    return io.read_series(spark, path, columns=("report_date", "basin_id", "n_hours", "mm"))


@reg.add("io17_versioned_commit", _REVISED)
def io17v(spark, d):
    """The same revision as commits of a versioned table: a batch that comes twice and one that dies before its commit change nothing."""
    path, later = folder(spark, "versioned"), folder(spark, "late")
    s = stages.stage(basin_series(spark, d).select("report_date", "basin_id", "n_hours", F.round("precip_mm", 4).alias("mm")), "series")
    versions.commit(s, path, "record")
    end = F.broadcast(s.agg(F.max("report_date").alias("_end")))  # one row
    late = s.crossJoin(end).where(F.col("report_date") > F.date_sub("_end", 2)).select("report_date", "basin_id", (F.col("n_hours") + 1).alias("n_hours"), F.round(F.col("mm") + 1, 4).alias("mm"))
    late.write.parquet(later)
    stream = spark.readStream.schema(s.schema).parquet(later)
    stream.writeStream.foreachBatch(versions.commit_batches(path, "late")).option("checkpointLocation", f"{later}-log").trigger(availableNow=True).start().awaitTermination()
    versions.commit(s.withColumn("mm", F.lit(-1.0)), path, "late/0")
    versions.write_rows(s.withColumn("mm", F.lit(-2.0)), path, "dead", "report_date")
    return versions.read_table(spark, path).select("report_date", "basin_id", "n_hours", "mm")


@reg.add("sr01_basin_stream", f"""WITH {BASIN_DAYS}, e AS (SELECT max(CAST(timezone('UTC', timezone('America/New_York', CAST(day AS TIMESTAMP) + INTERVAL 7 HOUR)) AS TIMESTAMP)) - INTERVAL 2 DAY AS mark FROM h)
 SELECT day AS report_date, basin_id, round(mean, 4) AS mean, round(cover, 2) AS cover_frac, n AS n_hours FROM m JOIN n USING (day, basin_id), e WHERE CAST(timezone('UTC', timezone('America/New_York', CAST(day AS TIMESTAMP) + INTERVAL 7 HOUR)) AS TIMESTAMP) <= mark""")
def sr01b(spark, d):
    """Days of slanted basins from a stream of hourly cells: stored weights, covered share and valid hours, as the watermark closes them."""
    path = folder(spark, "hours")
    hourly(spark, d).write.parquet(path)
    weights = stages.stage(zonal.cell_weights(triangles(spark, d), COARSE, "basin_id"), "weights")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    days = refresh.basin_days(stream, weights).select("report_date", "basin_id", "mean", "cover_frac", "n_hours")
    return rounded(drained(spark, days, "basins").withColumn("cover_frac", F.round("cover_frac", 2)))


_GONE = "(user_id * 3 + n) % 7 = 2"


@reg.add("sr03_soil_gaps", f"""WITH RECURSIVE {DAILY}, k AS (SELECT user_id, n, rain, row_number() OVER (PARTITION BY user_id ORDER BY n) AS i FROM da WHERE NOT {_GONE}),
 f AS (SELECT user_id, 0 AS i, -1 AS n, 20.0::DOUBLE AS s, TRUE AS armed, CAST(NULL AS INTEGER) AS wet FROM (SELECT DISTINCT user_id FROM da)
 UNION ALL SELECT f.user_id, d.i, d.n, greatest(least(f.s + 0.85::DOUBLE * d.rain, 40.0) - 3.0::DOUBLE * least(f.s + 0.85::DOUBLE * d.rain, 40.0) / 40.0, 0), CASE WHEN d.rain >= 12.7 AND (f.armed OR f.s / 40 < 0.3) THEN FALSE ELSE f.armed OR f.s / 40 < 0.3 END,
 CASE WHEN d.rain >= 12.7 AND (f.armed OR f.s / 40 < 0.3) THEN d.n ELSE f.wet END FROM f JOIN k d ON d.user_id = f.user_id AND d.i = f.i + 1),
 w AS (SELECT user_id, min(n) AS stop FROM da WHERE {_GONE} AND n > 29 - 2 GROUP BY user_id)
 SELECT f.user_id AS cell, n, round(CAST(s AS DOUBLE), 6) AS s, armed, CAST(wet AS INTEGER) AS wet FROM f LEFT JOIN w USING (user_id) WHERE n >= 0 AND n < coalesce(stop, 30)""")
def sr03g(spark, d):
    """The soil fold where every cell lacks a seventh of its days: they are passed over when the watermark has, and refused when they come after all."""
    path = folder(spark, "rain")
    gone = (F.col("user_id") * 3 + F.col("n")) % 7 == 2
    rain = stages.stage(daily(spark, d), "daily")
    shown = lambda df: df.select(F.col("user_id").alias("cell"), F.col("n").cast("int").alias("n"), F.col("day").cast("timestamp").alias("day"), F.col("rain").alias("p"), F.lit(3.0).alias("pet"), F.lit(40.0).alias("cap"))
    # three arrivals, each a run of the stream; the last one brings missing days of the first, with other rain
    parts = (rain.where(~gone & (F.col("n") < 10)), rain.where(~gone & F.col("n").between(10, 19)), rain.where(~gone & (F.col("n") > 19)).unionByName(rain.where(gone & (F.col("n") < 10)).withColumn("rain", F.lit(99.0))))
    arrivals = [lambda part=part: shown(part).repartition("cell").write.mode("append").parquet(path) for part in parts]
    shown(rain).where("false").write.parquet(path)  # the folder must be there
    stream = spark.readStream.schema(shown(rain).schema).parquet(path)
    return drained(spark, refresh.soil_stream(stream, day="day"), "soil", arrivals).select("cell", "n", F.round("s", 6).alias("s"), "armed", "wet")
