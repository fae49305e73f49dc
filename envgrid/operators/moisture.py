"""Daily soil-water state: complete-day forcing, the bucket fold, event clocks and trailing windows.

Time is folded within a cell, never across cells. The fold runs once for each distinct (forcing cell, capacity), whose
day array is short, and its results are joined to the fine cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envgrid.functions.scalars import hargreaves, pet_climatology
from envgrid.sources.stages import stage

SOAK_MM, INTERCEPT, REARM, SPIN_UP, KEEP_DAYS, FROST = 12.7, 0.85, 0.30, 90, 21, -2.0


def complete_day_totals(hourly: DataFrame, least: int = 24, cell: Sequence[str] = ("i", "j")) -> DataFrame:
    """Daily totals by cell, missing hours skipped, of the days on which some cell has ``least`` hours."""
    daily = hourly.groupBy("day", *cell).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.count("value").alias("n"))
    return daily.join(daily.groupBy("day").agg(F.max("n").alias("_most")).where(F.col("_most") >= least).select("day"), "day", "left_semi")


def complete_day_extremes(hourly: DataFrame, days: DataFrame, least: int = 20, cell: Sequence[str] = ("i", "j")) -> DataFrame:
    """Daily highest and lowest value by cell; none on days where a cell has fewer than ``least`` hours, nor on days of the list without data."""
    daily = hourly.groupBy("day", *cell).agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.count("value").alias("n"))
    full = daily.groupBy("day").agg(F.min("n").alias("_least")).where(F.col("_least") >= least).select("day", F.lit(True).alias("_full"))
    every = days.select("day").distinct().join(F.broadcast(full), "day", "left")
    ok = F.col("_full").isNotNull()
    return every.join(daily, "day", "left").select("day", *cell, F.when(ok, F.col("hi")).alias("hi"), F.when(ok, F.col("lo")).alias("lo"))


def days_between(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """df on every day from its first to its last for each key; missing days have value 0."""
    ends = df.groupBy(key).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return ends.select(key, F.explode(F.sequence("a", "b")).alias(day)).join(df, [key, day], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def last_days(days: int, key: str, day: str):
    """The window of the last days by date, whether each has a row or not."""
    return Window.partitionBy(key).orderBy(F.unix_date(F.col(day).cast("date"))).rangeBetween(1 - days, 0)


def trailing_sum(value: str, days: int, key: str, day: str) -> Column:
    return F.sum(value).over(last_days(days, key, day))


def trailing_mean(value: str, days: int, key: str, day: str) -> Column:
    """Mean of the given values of the last days."""
    return F.avg(value).over(last_days(days, key, day))


def days_since(event: Column, number: str, key: str) -> Column:
    """Days since the event last held; NULL before it first does."""
    w = Window.partitionBy(key).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return F.col(number) - F.max(F.when(event, F.col(number))).over(w)


def bucket_fold(days: str = "days", cap: str = "cap", spin_up: int = SPIN_UP, keep: int = KEEP_DAYS) -> Column:
    """struct<s, armed, wet, soak, k> after an array of days struct<n, p, pet>.

    A day first re-arms the clock if the soil is drier than REARM, then starts it if it is armed and the rain soaks, then
    adds the rain that gets through up to the capacity, then takes the water that evaporates, down to nothing. wet is the
    day of the last start of a wet spell, soak that of the last soaking rain after the spin-up, k the states of the last
    days after it. A cell without capacity has no state; its clock starts once and never re-arms.
    """
    return F.expr(
        f"""aggregate({days}, named_struct('s', 0.5D * {cap}, 'armed', true, 'wet', cast(null AS int), 'soak', cast(null AS int), 'k', cast(array() AS array<double>)),
        (a, d) -> aggregate(array(named_struct('armed', a.armed OR coalesce(a.s / {cap} < {REARM}D, false), 'hit', coalesce(d.p >= {SOAK_MM}D, false), 'full', if({cap} IS NULL, cast(null AS double), least(a.s + {INTERCEPT}D * d.p, {cap})))), a,
        (x, e) -> aggregate(array(if({cap} IS NULL, cast(null AS double), greatest(e.full - d.pet * e.full / {cap}, 0D))), a, (y, s) -> named_struct(
            's', s, 'armed', if(e.armed AND e.hit, false, e.armed), 'wet', if(e.armed AND e.hit, d.n, a.wet), 'soak', if(e.hit AND d.n >= {spin_up}, d.n, a.soak),
            'k', if(d.n >= {spin_up}, slice(concat(a.k, array(s / {cap})), greatest(1, size(a.k) + 2 - {keep}), {keep}), a.k)))))"""
    )


def soil_state(forcing: DataFrame, capacity: DataFrame, key: Sequence[str] = ("i", "j"), spin_up: int = SPIN_UP, keep: int = KEEP_DAYS) -> DataFrame:
    """(key, cap, sm, mean_7/14/21, days_since_wetup, days_since_soak): forcing is (key, n, p, pet), capacity the distinct (key, cap)."""
    day = F.array_sort(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), F.col("p").cast("double").alias("p"), F.col("pet").cast("double").alias("pet")))).alias("days")
    state = forcing.groupBy(*key).agg(day, F.max("n").alias("_last")).join(capacity, list(key)).withColumn("_f", bucket_fold(spin_up=spin_up, keep=keep))
    mean = lambda w: F.expr(f"aggregate(filter(slice(_f.k, greatest(1, size(_f.k) - {w - 1}), {w}), v -> v IS NOT NULL), named_struct('t', 0D, 'n', 0), (a, v) -> named_struct('t', a.t + v, 'n', a.n + 1), a -> a.t / nullif(a.n, 0))")
    return state.select(*key, "cap", (F.col("_f.s") / F.col("cap")).alias("sm"), *[mean(w).alias(f"mean_{w}") for w in (7, 14, 21)], (F.col("_last") - F.col("_f.wet")).alias("days_since_wetup"), (F.col("_last") - F.col("_f.soak")).alias("days_since_soak"))


def pet_with_fallback(temps: DataFrame, hargreaves: Column, climatology: Column) -> DataFrame:
    """Adds pet: by temperature on days on which every cell has one, else by the day of the year alone."""
    whole = temps.groupBy("day").agg(F.bool_and(F.col("hi").isNotNull() & F.col("lo").isNotNull()).alias("_all"))
    return temps.join(whole, "day").withColumn("pet", F.when(F.col("_all"), hargreaves).otherwise(climatology)).drop("_all")


def soil_moisture_state(rain: DataFrame, temperature: DataFrame, capacity: DataFrame, days: DataFrame, cell: Sequence[str] = ("i", "j"), rain_hours: int = 24, temperature_hours: int = 20, spin_up: int = SPIN_UP, windows: Sequence[int] = (7, 14, 21, 30)) -> DataFrame:
    """The state of each cell and capacity after its last complete day.

    rain and temperature are hourly (day, cell, value), capacity is (cell, cap), days the calendar. Complete days of rain
    are totalled; evapotranspiration follows the days' highest and lowest temperature where every cell has both, else the
    day of the year; the soil fold gives water, its means and the clocks. Beside them stand the rain of the last days by
    date, the mean lowest temperature of seven days, and the days since frost.
    """
    total = complete_day_totals(rain, rain_hours, cell)
    extremes = complete_day_extremes(temperature, days, temperature_hours, cell)
    doy = F.dayofyear("day")
    pet = pet_with_fallback(extremes, hargreaves(F.col("hi"), F.col("lo"), doy), pet_climatology(doy)).select("day", *cell, "lo", "pet")
    first = total.agg(F.min("day").alias("_first"))
    daily = stage(total.join(pet, ["day", *cell], "left").withColumn("pet", F.coalesce("pet", pet_climatology(doy))).crossJoin(F.broadcast(first)).withColumn("n", F.datediff("day", "_first")).drop("_first"), "soil-days")  # one row
    state = soil_state(daily.select(*cell, "n", F.col("total").alias("p"), "pet"), capacity, cell, spin_up)
    last = daily.groupBy(*cell).agg(F.max("n").alias("_last"))
    within = lambda w, v: F.when(F.col("n") > F.col("_last") - w, v)
    now = daily.join(last, list(cell)).groupBy(*cell).agg(
        *[F.sum(within(w, F.col("total"))).alias(f"rain_{w}") for w in windows], F.avg(within(7, F.col("lo"))).alias("tmin_7"),
        (F.max("_last") - F.max(F.when(F.col("lo") <= FROST, F.col("n")))).alias("days_since_frost"),
    )
    return state.join(now, list(cell))


def date_runs(dates: DataFrame, max_gap: int = 3, max_days: int = 120, day: str = "day") -> DataFrame:
    """(day, run): a run ends where the gap is over max_gap days, and after max_days dates.

    Dates are few (days of a record), but their rows may be many: they are made distinct first.
    """
    d = dates.select(day).distinct()
    w = Window.orderBy(day)
    gap = d.withColumn("_g", F.sum(F.when(F.datediff(day, F.lag(day).over(w)) > max_gap, 1).otherwise(0)).over(w))
    in_gap = Window.partitionBy("_g").orderBy(day)
    cut = gap.withColumn("_b", F.floor((F.row_number().over(in_gap) - 1) / max_days))
    return cut.select(day, F.dense_rank().over(Window.orderBy("_g", "_b")).alias("run"))
