"""Gauge-versus-product verification: sums by day, correlation, bias, per-lead summaries, gap checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envgrid.functions.geo import to_hrrr
from envgrid.functions.timebuckets import TZ, hourly_stamps, lead_day, report_day
from envgrid.operators.grid import GridSpec, nearest_index


def pearson(a: str, b: str) -> Column:
    """Correlation over rows where both are given; NULL for one row or a constant column."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def bias_columns(obs: str, est: str) -> list[Column]:
    """n, correlation, totals, mean and total bias and percent bias over rows where both are given."""
    both = F.col(obs).isNotNull() & F.col(est).isNotNull()
    o, e = F.when(both, F.col(obs)), F.when(both, F.col(est))
    return [
        F.count(o).alias("n_days"), pearson(obs, est).alias("corr"), F.sum(o).alias("obs_total"), F.sum(e).alias("est_total"), F.avg(e - o).alias("mean_bias"),
        (F.sum(e) - F.sum(o)).alias("bias"), (100 * F.try_divide(F.sum(e) - F.sum(o), F.sum(o))).alias("pct_bias"),
    ]


def total_or_zero(c: str) -> Column:
    """A sum that is 0 where nothing is given."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def daily_sums(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum and number of given values by keys."""
    return df.groupBy(*keys).agg(total_or_zero(value).alias(out), F.count(value).alias("n_values"))


def station_summary(pairs: DataFrame, obs: str, est: str, first: Sequence[str] = ()) -> DataFrame:
    """One record for each station; its attributes are those of its earliest day."""
    return pairs.groupBy("station").agg(*[F.min_by(c, "day").alias(c) for c in first], *bias_columns(obs, est))


def lead_summary(pairs: DataFrame, stations: DataFrame, leads: Sequence[int], obs: str = "obs", est: str = "est") -> DataFrame:
    """A pooled row and one for each station, n, r and bias of each lead side by side; stations without rows stay with n = 0."""
    both = pairs.where(F.col(obs).isNotNull() & F.col(est).isNotNull())
    cells = both.groupingSets([[F.col("lead")], [F.col("lead"), F.col("station")]], "lead", "station").agg(
        F.count("*").alias("n"), pearson(obs, est).alias("r"), F.avg(F.col(est) - F.col(obs)).alias("b"), F.grouping("station").alias("pooled")
    )
    cells = cells.withColumn("who", F.when(F.col("pooled") == 1, "ALL").otherwise(F.col("station").cast("string")))
    wide = cells.groupBy("who").pivot("lead", list(leads)).agg(F.first("n").alias("n"), F.first("r").alias("r"), F.first("b").alias("bias"))
    names = stations.select(F.col("station").cast("string").alias("who")).unionByName(stations.sparkSession.createDataFrame([("ALL",)], "who string"))
    out = names.join(wide, "who", "left")
    for k in leads:
        out = out.withColumn(f"{k}_n", F.coalesce(f"{k}_n", F.lit(0)))
    return out.select("who", *[F.col(f"{k}_{c}").alias(f"{c}_lead{k}") for k in leads for c in ("n", "r", "bias")])


def full_outer_days(series: Sequence[tuple[str, DataFrame]], key: str = "day") -> DataFrame:
    """Daily series (key, value) side by side on every day that one of them has."""
    long = None
    for name, df in series:
        part = df.select(key, F.lit(name).alias("series"), F.col("value"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy(key).pivot("series", [n for n, _ in series]).agg(F.first("value"))


def pairwise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(one, two, n, r): days that both of two series have, and their correlation, for each pair of columns; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    sums = df.agg(*[x for k, (a, b) in enumerate(pairs) for x in (F.count(F.when(both(a, b), 1)).alias(f"n{k}"), pearson(a, b).alias(f"r{k}"))])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("one"), F.lit(b).alias("two"), F.col(f"n{k}").alias("n"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def day_against_grid(gauges: DataFrame, hourly: DataFrame, grid: GridSpec, day: str, value: str = "value") -> DataFrame:
    """(station, obs, est, diff, n_missing, r) of one report day: each gauge (station, x, y, obs) beside the total of its grid cell.

    n_missing are the hours of the day that the store has no cell of; r is the correlation over all gauges with both.
    """
    date = F.lit(day).cast("date")
    h = hourly.where(report_day("time", "wall7_right") == date)
    stamps = hourly.sparkSession.range(1).select(date.alias("day")).select("day", F.explode(hourly_stamps(F.col("day"))).alias("stamp"))
    missing = missing_stamps(stamps, h.select(F.col("time").alias("stamp"))).select("n_missing")
    at = gauges.withColumn("row", grid.row(F.col("y"))).withColumn("col", grid.col(F.col("x")))
    pairs = at.join(h.groupBy("row", "col").agg(F.sum(value).alias("est")), ["row", "col"], "left")
    facts = missing.crossJoin(F.broadcast(pairs.agg(pearson("obs", "est").alias("r"))))  # one row each
    return pairs.crossJoin(F.broadcast(facts)).select("station", "obs", "est", (F.col("est") - F.col("obs")).alias("diff"), "n_missing", "r")


def nearest_cycle(wanted: DataFrame, cycles: DataFrame, want: str = "wanted", have: str = "cycle") -> DataFrame:
    """For each wanted time the cycle nearest to it (the earlier of two), and whether it stands in for the one asked for.

    As-of in both directions on one merged order: the last cycle at or before and the first one after, without a cross join.
    Times are dealt by hour, and each hour knows the last and first cycle of the hours around it, so no single task sorts all.
    The first one after is the last one before in the reversed order: frames that end at the current row grow row by row,
    while those that begin there are gone through anew for each row.
    """
    from pyspark.sql import Window

    merged = wanted.select(F.col(want).alias("t"), F.lit(1).alias("w"), F.lit(None).cast(cycles.schema[have].dataType).alias("c")).unionByName(cycles.select(F.col(have).alias("t"), F.lit(0).alias("w"), F.col(have).alias("c"))).withColumn("hour", F.date_trunc("hour", "t"))
    hours = merged.groupBy("hour").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("hour"), F.desc("hour")))  # one row for each hour
    around = hours.select("hour", F.last("hi", True).over(up).alias("before_hour"), F.last("lo", True).over(down).alias("after_hour"))
    inside = Window.partitionBy("hour")
    past, coming = (inside.orderBy(o("t"), o("w")).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc, F.desc))
    near = merged.join(around, "hour").select(
        "t", "w",
        F.coalesce(F.last("c", True).over(past), "before_hour").alias("before"),
        F.coalesce(F.last("c", True).over(coming), "after_hour").alias("after"),
    ).where("w = 1")
    gap = lambda c: F.abs(F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp")))
    pick = F.when(F.col("after").isNull() | (gap("before") <= gap("after")), F.col("before")).otherwise(F.coalesce("after", "before"))
    return near.select(F.col("t").alias(want), pick.alias(have)).withColumn("substituted", F.col(want) != F.col(have))


@dataclass(frozen=True)
class ForecastGrid:
    """A forecast's regular grid on its Lambert projection: the centre of cell (0, 0), the step, and its size."""

    y0: float
    x0: float
    step: float
    ny: int
    nx: int


def verify_forecast(cube: DataFrame, stations: DataFrame, gauge: DataFrame, grid: ForecastGrid, first: str, last: str, hour: int = 12, before: int = 3, leads: Sequence[int] = (1, 2), tz: str = TZ) -> DataFrame:
    """A pooled row and one for each station, n, r and bias of each lead side by side, for report days from first to last.

    cube is (init, lead_h, row, col, value), stations (station, lon, lat), gauge (station, day, obs). Each station takes the cell
    nearest to it on the projection. Of each day from ``before`` days before the first one the cycle of ``hour`` UTC is asked for, and the nearest one that the
    cube has stands in for a missing one, once; the hours of a cycle are totalled by report day and lead class.
    """
    x, y = to_hrrr(F.col("lon"), F.col("lat"))
    at = stations.select("station", nearest_index(y, grid.y0, grid.step, grid.ny).alias("row"), nearest_index(x, grid.x0, grid.step, grid.nx).alias("col"))
    dates = F.explode(F.sequence(F.date_sub(F.lit(first).cast("date"), before), F.lit(last).cast("date"))).alias("day")
    wanted = cube.sparkSession.range(1).select(dates).select((F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.lit(hour))).alias("wanted"))
    kept = nearest_cycle(wanted, cube.select(F.col("init").alias("cycle")).distinct()).select(F.col("cycle").alias("init")).distinct()
    # cycles are as many as days, stations a roster
    valid = cube.join(F.broadcast(kept), "init").withColumn("lead", lead_day(F.col("lead_h"))).where(F.col("lead").isin(*leads)).join(at, ["row", "col"])
    stamp = F.col("init") + F.make_dt_interval(hours=F.col("lead_h"))
    est = valid.groupBy("station", "lead", report_day(stamp, "wall7_right", tz).alias("day")).agg(F.sum("value").alias("est"))
    pairs = est.join(gauge, ["station", "day"]).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return lead_summary(pairs, stations.select("station"), leads)


def short_days(df: DataFrame, keys: Sequence[str], value: str, least: int = 23) -> DataFrame:
    """Groups with fewer than ``least`` given values."""
    return df.groupBy(*keys).agg(F.count(value).alias("n_hours")).where(F.col("n_hours") < least)


def hours_histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How many groups have how many given values."""
    return df.groupBy(*keys).agg(F.count(value).alias("n_hours")).groupBy("n_hours").agg(F.count("*").alias("n_groups"))


def ordered_lookup(ids: Sequence, dimension: DataFrame, key: str) -> DataFrame:
    """(place, columns of dimension) of each id, in their given order (place, from 1); an id that dimension hasn't is an error. The ids are a list in the program, so they are few."""
    kind = dimension.schema[key].dataType.simpleString()
    wanted = dimension.sparkSession.createDataFrame([(k + 1, i) for k, i in enumerate(ids)], f"place int, _want {kind}")
    found = wanted.join(dimension.withColumn("_has", F.lit(True)), F.col("_want") == F.col(key), "left")
    known = F.when(F.col("_has"), F.col("place")).otherwise(F.raise_error(F.concat(F.lit(f"no {key} "), F.col("_want").cast("string"))).cast("int"))
    return found.select(known.alias("place"), *dimension.columns)


def missing_stamps(expected: DataFrame, available: DataFrame, key: str = "stamp") -> DataFrame:
    """(day, n_expected, n_missing): stamps of a window that the store has not."""
    return expected.join(available.select(key).distinct().withColumn("_has", F.lit(1)), key, "left").groupBy("day").agg(F.count("*").alias("n_expected"), F.sum(F.when(F.col("_has").isNull(), 1).otherwise(0)).alias("n_missing"))
