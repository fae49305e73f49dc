"""Per-polygon daily series: date selection, day records, upsert, and the explorer's questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from envgrid.functions import geo, scalars
from envgrid.functions.timebuckets import expected_hours, report_day, window_end, window_start
from envgrid.operators import zonal
from envgrid.operators.grid import GridSpec
from envgrid.sources.stages import stage


def parse_dates(spark: SparkSession, spec: str) -> DataFrame:
    """(day) of a list such as ``2024-01-03,2024-02-01:2024-02-04``; ranges hold both ends; no date twice."""
    ends = spark.createDataFrame([(spec,)], "spec string").select(F.explode(F.split("spec", ",")).alias("part")).where("trim(part) <> ''")
    pair = F.split(F.trim("part"), ":")
    return ends.select(F.explode(F.sequence(F.to_date(pair[0]), F.to_date(F.coalesce(F.get(pair, F.lit(1)), pair[0])))).alias("day")).distinct()


def covered_dates(span: DataFrame, first: str = "t_min", last: str = "t_max") -> DataFrame:
    """(day): report dates whose whole window lies in the record [t_min, t_max] of hour-ending stamps."""
    days = span.select(first, last, F.explode(F.sequence(F.to_date(first), F.date_add(F.to_date(last), 1))).alias("day"))
    return days.where((window_start(F.col("day")) + F.expr("interval 1 hour") >= F.col(first)) & (window_end(F.col("day")) <= F.col(last))).select("day")


def last_dates(days: DataFrame, n: int) -> DataFrame:
    return days.orderBy(F.desc("day")).limit(n)


def day_records(means: DataFrame, hours: DataFrame, areas: DataFrame, poly: str = "basin_id", day: str = "report_date") -> DataFrame:
    """Depth in mm and inch, volume, mean flux, covered share and hours, expected hours of each polygon and date."""
    joined = means.join(hours, [day, poly], "left").join(areas.select(poly, "area_m2"), poly, "left").withColumn("n_hours_expected", expected_hours(F.col(day)))
    volume = scalars.volume_m3(F.col("mean"), F.col("area_m2"))
    return joined.select(
        day, poly, F.bround("mean", 3).alias("precip_mm"), F.bround(scalars.mm_to_in(F.col("mean")), 4).alias("precip_in"), F.bround(volume, 1).alias("volume_m3"),
        F.bround(scalars.flux_m3s(volume, F.col("n_hours_expected")), 4).alias("volume_flux_m3s"), F.bround("cover_frac", 4).alias("cover_frac"), F.coalesce("n_hours", F.lit(0)).alias("n_hours"), "n_hours_expected",
    )


def basin_daily(hourly: DataFrame, polygons: DataFrame, grid: GridSpec, key: str = "basin_id", unit_m2: float = 1e6, rings: str = "rings") -> DataFrame:
    """Day records of each polygon from an hourly grid (row, col, time, value): report days, area weights, covered share, valid hours, volumes. unit_m2 is the area of a unit square of the grid."""
    h = hourly.withColumn("report_date", report_day("time", "wall7_right"))
    weights = stage(zonal.cell_weights(polygons, grid, key, rings), "weights")
    daily = h.groupBy("report_date", "row", "col").agg(F.sum("value").alias("value"))  # missing where all hours are
    means = zonal.polygon_means(daily, weights, ["report_date"], key)
    hours = zonal.valid_hours(h, weights, ["report_date"], key)
    areas = polygons.select(key, (F.abs(geo.polygon_area(rings)) * unit_m2).alias("area_m2"))
    return day_records(means, hours, areas, key)


def upsert(old: DataFrame, new: DataFrame, day: str = "report_date") -> DataFrame:
    """All rows of dates that new has come from new, other dates stay."""
    return old.join(new.select(day).distinct(), day, "left_anti").unionByName(new)


def complete(n: str = "n_hours", expected: str = "n_hours_expected") -> Column:
    return F.col(n) == F.col(expected)


def basin_period(series: DataFrame, first: Column | str, last: Column | str) -> DataFrame:
    """Days, partial days, mean and total rain, wettest date, mean flux and volume of each polygon between two dates."""
    part = series.where(F.col("report_date").between(first, last) & F.col("precip_mm").isNotNull())
    return part.groupBy("basin_id").agg(
        F.count("*").alias("n_days"), F.sum(F.when(complete(), 0).otherwise(1)).alias("n_partial"), F.avg("precip_mm").alias("mean_mm"), F.sum("precip_mm").alias("total_mm"),
        F.sum("precip_in").alias("total_in"), F.max_by("report_date", F.struct("precip_mm", F.negative(F.unix_date("report_date")))).alias("wettest"), F.avg("volume_flux_m3s").alias("mean_flux"), (F.sum("volume_m3") / 1000).alias("total_1000_m3"),
    )


def totals_by_kind(series: DataFrame, water: str, day: str = "report_date") -> DataFrame:
    """(report_date, land, water): volumes in millions of cubic metres by date."""
    part = lambda hit: F.sum(F.when(hit, F.col("volume_m3"))) / 1e6
    return series.groupBy(day).agg(part(~F.col(water)).alias("land"), part(F.col(water)).alias("water"))


def default_period(series: DataFrame, days: int = 365) -> DataFrame:
    """First and last date, numbers of polygons and dates, and the default first date: the last ``days`` dates, not before the record."""
    return series.agg(F.min("report_date").alias("first"), F.max("report_date").alias("last"), F.countDistinct("basin_id").alias("n_basins"), F.countDistinct("report_date").alias("n_dates")).withColumn("default_first", F.greatest(F.date_sub("last", days - 1), F.col("first")))


def explorer(series: DataFrame, water: str, days: int = 365, top: int = 5, first: Column | str | None = None, last: Column | str | None = None) -> dict[str, DataFrame]:
    """The explorer's tables of a daily series: extent, period, years, totals and latest.

    The period is the one given or the last days of the record. extent has one row; period one for each polygon, with the share of
    complete days; years the percent of complete basin-days of each year; totals land and water by date within the period; latest the
    top polygons of the last date by depth, with the percent of hours that they have and their rank. The period's bounds come
    from the extent, one row, so the series is read once for it and once for each table.
    """
    extent = default_period(series, days)
    bounds = extent.select((F.col("default_first") if first is None else F.lit(first).cast("date")).alias("_from"), (F.col("last") if last is None else F.lit(last).cast("date")).alias("_to"), F.col("last").alias("_last"))
    within = series.crossJoin(F.broadcast(bounds))  # one row
    inside = within.where(F.col("report_date").between(F.col("_from"), F.col("_to")))
    period = basin_period(inside, F.col("_from"), F.col("_to")).withColumn("pct_complete", 100 * (1 - F.col("n_partial") / F.col("n_days")))
    years = series.groupBy(F.year("report_date").alias("year")).agg((100 * F.avg(F.when(complete(), 1.0).otherwise(0.0))).alias("pct_complete"), F.count("*").alias("n"))
    hours = 100 * F.try_divide(F.col("n_hours"), F.col("n_hours_expected"))
    latest = within.where(F.col("report_date") == F.col("_last")).select("basin_id", "report_date", "precip_mm", hours.alias("pct_hours")).orderBy(F.desc_nulls_last("precip_mm"), "basin_id").limit(top)
    ranked = latest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("precip_mm"), "basin_id")))  # top rows
    return {"extent": extent, "period": period, "years": years, "totals": totals_by_kind(inside, water), "latest": ranked}


def violations(df: DataFrame, key: list[str], domain: tuple[str, list] | None = None, expected: DataFrame | None = None) -> DataFrame:
    """(rule, detail, n) of broken rules: keys that repeat, values outside their domain, expected ids that are missing."""
    text = lambda cols: F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    out = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate key").alias("rule"), text(key).alias("detail"), "n")
    if domain:
        out = out.unionByName(df.where(~F.col(domain[0]).isin(domain[1]) | F.col(domain[0]).isNull()).groupBy(domain[0]).agg(F.count("*").alias("n")).select(F.lit("outside domain").alias("rule"), F.col(domain[0]).cast("string").alias("detail"), "n"))
    if expected is not None:
        k = expected.columns
        out = out.unionByName(expected.join(df.select(*k).distinct(), k, "left_anti").select(F.lit("missing").alias("rule"), text(k).alias("detail"), F.lit(1).cast("long").alias("n")))
    return out
